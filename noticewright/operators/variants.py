"""Rows of the survey that differ from a neighbour by an order, a window or a default, each with a
query of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import folded_title, without_punctuation
from ..plans.views import ACTIONS_SQL, NOTICES_SQL, actions, notices, table
from ..registry import query
from .aggregates import _DEADLINE_SQL, _with_deadline, dealt, page, sorted_notices
from .extraction import tags
from .joins import CATEGORY_RULES, argmax_rule

AS_OF = "2024-06-15"


def _sorted(spark, d, mode: str) -> DataFrame:
    return sorted_notices(_with_deadline(notices(spark, d)), mode, AS_OF)


# -- Orders and pages --------------------------------------------------------------------------------


@query("H01_publish_desc", f"WITH {NOTICES_SQL} SELECT id, publish_date FROM notices ORDER BY publish_date DESC, id LIMIT 30")
def publish_desc(spark, d):
    return _sorted(spark, d, "publish_desc").limit(30).select("id", "publish_date")


@query("H04_default_page", f"WITH {NOTICES_SQL} SELECT id FROM notices ORDER BY publish_date DESC, id LIMIT 10 OFFSET 10")
def default_page(spark, d):
    return page(_sorted(spark, d, "default"), 2).select("id")


@query("H05_publish_asc", f"WITH {NOTICES_SQL} SELECT id, publish_date FROM notices ORDER BY publish_date, id LIMIT 30")
def publish_asc(spark, d):
    return _sorted(spark, d, "publish_asc").limit(30).select("id", "publish_date")


@query(
    "H09_favorites_order",
    f"""WITH {_DEADLINE_SQL}, {ACTIONS_SQL} SELECT id, CASE WHEN deadline IS NULL OR deadline < DATE '{AS_OF}' THEN 9999 ELSE date_diff('day', DATE '{AS_OF}', deadline) END AS days FROM n
        WHERE id IN (SELECT item FROM actions WHERE action = 'favorite') ORDER BY days, publish_date DESC, id LIMIT 20""",
)
def favorites_order(spark, d):
    """The favorites of all users, by nearest deadline."""
    liked = actions(spark, d).where("action = 'favorite'").select(F.col("item").alias("id"))
    days = F.datediff("deadline", F.lit(AS_OF).cast("date"))
    rows = sorted_notices(_with_deadline(notices(spark, d)).join(liked, "id", "left_semi"), "deadline_nearest", AS_OF).limit(20)
    return rows.select("id", F.when(days.isNull() | (days < 0), 9999).otherwise(days).cast("long").alias("days"))


@query("H10_timeline", f"WITH {_DEADLINE_SQL} SELECT id, deadline FROM n ORDER BY deadline NULLS LAST, id LIMIT 30")
def timeline(spark, d):
    return _sorted(spark, d, "deadline_earliest").limit(30).select("id", "deadline")


@query("H12_history_page", f"WITH {ACTIONS_SQL} SELECT event_id, user_id FROM actions ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 10")
def history_page(spark, d):
    return page(actions(spark, d).orderBy(F.desc("ts"), F.desc("event_id")), 2).select("event_id", "user_id")


@query("H14_recall_fifty", "SELECT p_partkey, p_size + 0.3 * p_retailprice AS score FROM part WHERE p_size > 10 ORDER BY score DESC, p_partkey LIMIT 50")
def recall_fifty(spark, d):
    """Rows with a positive match only, the best fifty."""
    return table(spark, d, "part").where("p_size > 10").select("p_partkey", (F.col("p_size") + 0.3 * F.col("p_retailprice")).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


@query("H15_newest_six", f"WITH {NOTICES_SQL} SELECT id, source FROM notices ORDER BY publish_date DESC, id LIMIT 6")
def newest_six(spark, d):
    return _sorted(spark, d, "publish_desc").limit(6).select("id", "source")


@query("H16_hot_ten", f"WITH {ACTIONS_SQL} SELECT item, sum(CASE action WHEN 'view' THEN 1 WHEN 'favorite' THEN 3 WHEN 'useful' THEN 2 ELSE 0 END)::BIGINT AS total FROM actions WHERE item IS NOT NULL GROUP BY item ORDER BY total DESC, item LIMIT 10")
def hot_ten(spark, d):
    weight = F.when(F.col("action") == "view", 1).when(F.col("action") == "favorite", 3).when(F.col("action") == "useful", 2).otherwise(0)
    return actions(spark, d).where("item is not null").groupBy("item").agg(F.sum(weight).alias("total")).orderBy(F.desc("total"), "item").limit(10)


@query("H17_shortlist_twelve", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part) WHERE place <= 12")
def shortlist_twelve(spark, d):
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    return table(spark, d, "part").withColumn("place", place).where("place <= 12").select("p_brand", "p_partkey")


# -- Filters -----------------------------------------------------------------------------------------


@query("D05_within_window", f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE publish_date BETWEEN DATE '2024-03-01' AND DATE '2024-05-31'")
def within_window(spark, d):
    return notices(spark, d).where(F.col("publish_date").between(F.lit("2024-03-01").cast("date"), F.lit("2024-05-31").cast("date"))).select("id")


@query("D12_review_pending", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'P'")
def review_pending(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query("D13_reviewed_newest", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def reviewed_newest(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey")


@query("D17_relative_time", f"WITH {NOTICES_SQL} SELECT id, CASE WHEN publish_date >= DATE '2024-12-31' - 7 THEN 7 WHEN publish_date >= DATE '2024-12-31' - 30 THEN 30 ELSE 90 END AS window_days FROM notices WHERE publish_date >= DATE '2024-12-31' - 90")
def relative_time(spark, d):
    """The narrowest of the three windows that a notice is in."""
    since = lambda n: F.col("publish_date") >= F.date_sub(F.lit("2024-12-31").cast("date"), n)
    return notices(spark, d).where(since(90)).select("id", F.when(since(7), 7).when(since(30), 30).otherwise(90).alias("window_days"))


@query("D18_month", f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE strftime(publish_date, '%Y-%m') = '2024-05'")
def of_month(spark, d):
    """A month as a range of days, so that a scan can skip by date."""
    return notices(spark, d).where("publish_date >= date'2024-05-01' and publish_date < date'2024-06-01'").select("id")


@query("D19_favorites_filters", f"WITH {NOTICES_SQL}, {ACTIONS_SQL} SELECT id FROM notices WHERE source = 'src1' AND publish_date >= DATE '2024-12-31' - 300 AND id IN (SELECT item FROM actions WHERE action = 'favorite')")
def favorites_filters(spark, d):
    liked = actions(spark, d).where("action = 'favorite'").select(F.col("item").alias("id"))
    return notices(spark, d).where("source = 'src1' and publish_date >= date_sub(date'2024-12-31', 300)").join(liked, "id", "left_semi").select("id")


@query("D20_calendar_source", f"WITH {_DEADLINE_SQL} SELECT id, deadline FROM n WHERE source IN ('src2', 'src4') AND deadline IS NOT NULL")
def calendar_source(spark, d):
    return _with_deadline(notices(spark, d)).where("source in ('src2', 'src4') and deadline is not null").select("id", "deadline")


# -- Aggregates --------------------------------------------------------------------------------------


@query("F02_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))


@query("F06_count_and_range", f"WITH {NOTICES_SQL} SELECT spider, count(*) AS n, min(publish_date) AS first, max(publish_date) AS last FROM notices GROUP BY spider")
def count_and_range(spark, d):
    return notices(spark, d).groupBy("spider").agg(F.count("*").alias("n"), F.min("publish_date").alias("first"), F.max("publish_date").alias("last"))


@query("F08_newest_and_dated", f"WITH {_DEADLINE_SQL} SELECT source, max(deadline) AS newest, count(deadline) AS dated FROM n GROUP BY source")
def newest_and_dated(spark, d):
    return _with_deadline(notices(spark, d)).groupBy("source").agg(F.max("deadline").alias("newest"), F.count("deadline").alias("dated"))


@query("F11_deadlines_by_month", f"WITH {_DEADLINE_SQL} SELECT strftime(deadline, '%Y-%m') AS month, count(*) AS n FROM n WHERE deadline IS NOT NULL GROUP BY 1")
def deadlines_by_month(spark, d):
    return _with_deadline(notices(spark, d)).where("deadline is not null").groupBy(F.date_format("deadline", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("F12_this_month", f"WITH {NOTICES_SQL} SELECT source, count(*) FILTER (WHERE strftime(publish_date, '%Y-%m') = '2024-06') AS n FROM notices GROUP BY source")
def this_month(spark, d):
    return notices(spark, d).groupBy("source").agg(F.count_if(F.date_format("publish_date", "yyyy-MM") == AS_OF[:7]).alias("n"))


STOP_LONG = ["and", "con", "das", "der", "des", "die", "est", "for", "les", "los", "por", "que", "the", "und", "was", "with"]
PRONOUNS = ["er", "he", "her", "his", "it", "its", "she", "that", "they", "this", "sie", "ich", "elle", "ella"]


def commonest_tokens(df: DataFrame, id_col: str, text, k: int, stop: list[str], shortest: int = 2) -> DataFrame:
    """The ``k`` commonest tokens of each text, ties by token (F13b to F13d). Texts
    are dealt by id, so that they are all that moves: tokens are counted and ranked where their text is."""
    token = F.filter(F.split(F.lower("_text"), r"[^\p{L}]+"), lambda x: (F.length(x) >= shortest) & ~x.isin(stop))
    counts = dealt(df.select(id_col, text.alias("_text")), id_col).select(id_col, F.explode(token).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), "token"))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def _top_sql(text: str, k: int, stop: list[str]) -> str:
    return f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower({text}), '[^\\p{{L}}]+')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t WHERE length(token) >= 2 AND token NOT IN ({', '.join(f"'{w}'" for w in stop)}) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS place FROM c) SELECT doc_id, token, n, place FROM r WHERE place <= {k}"""


@query("F13b_top_tokens_head", _top_sql("substr(text, 1, 60) || ' ' || substr(text, 1, 500)", 5, STOP_LONG))
def top_tokens_head(spark, d):
    """Title and first 500 characters, the longer stop list."""
    return commonest_tokens(table(spark, d, "documents"), "doc_id", F.concat_ws(" ", F.substring("text", 1, 60), F.substring("text", 1, 500)), 5, STOP_LONG)


@query("F13c_top_tokens_plain", _top_sql("regexp_replace(text, 'https?://[^ \\n]+', ' ', 'g')", 5, STOP_LONG))
def top_tokens_plain(spark, d):
    """Links go first; ties by count, then token."""
    return commonest_tokens(table(spark, d, "documents"), "doc_id", F.regexp_replace("text", r"https?://[^ \n]+", " "), 5, STOP_LONG)


@query("F13d_top_ten_tokens", _top_sql("text", 10, PRONOUNS))
def top_ten_tokens(spark, d):
    return commonest_tokens(table(spark, d, "documents"), "doc_id", F.col("text"), 10, PRONOUNS)


@query(
    "F17_token_weights",
    f"""WITH {NOTICES_SQL}, {ACTIONS_SQL}, k AS (SELECT id, list_filter(string_split_regex(lower(title), '[ ,.;:!?|]+')[1:40], lambda x: length(x) BETWEEN 2 AND 12) AS ws FROM notices),
        j AS (SELECT user_id, unnest(ws) AS keyword, CASE WHEN action = 'other' THEN -1 ELSE 1 END AS v FROM actions JOIN k ON id = item) SELECT user_id, keyword, sum(v)::BIGINT AS weight FROM j GROUP BY ALL""",
)
def token_weights(spark, d):
    """Feedback of +1 or -1 on the first 40 tokens of a title, those of 2 to 12 letters."""
    words = F.filter(F.slice(F.split(F.lower("title"), "[ ,.;:!?|]+"), 1, 40), lambda x: F.length(x).between(2, 12))
    titled = notices(spark, d).select(F.col("id").alias("item"), words.alias("ws"))
    joined = actions(spark, d).select("user_id", "item", F.when(F.col("action") == "other", -1).otherwise(1).alias("v")).join(titled, "item")
    return joined.select("user_id", F.explode("ws").alias("keyword"), "v").groupBy("user_id", "keyword").agg(F.sum("v").alias("weight"))


@query("G02_first_favorite", f"WITH {ACTIONS_SQL} SELECT user_id, item, min(event_id) AS event_id FROM actions WHERE action = 'favorite' AND item IS NOT NULL GROUP BY ALL")
def first_favorite(spark, d):
    """The first event of a favorite counts; later ones of the same id don't."""
    return actions(spark, d).where("action = 'favorite' and item is not null").groupBy("user_id", "item").agg(F.min("event_id").alias("event_id"))


@query("G03_first_of_name", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def first_of_name(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("I02_union_all", "SELECT spider, count(*) AS n FROM (SELECT doc_id, lang AS spider FROM documents UNION ALL SELECT page_id, 'page' FROM pages) GROUP BY spider")
def union_all(spark, d):
    """Tables of several spiders one under the other, no row lost to a shared key."""
    docs, pages = table(spark, d, "documents").select("doc_id", F.col("lang").alias("spider")), table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("page").alias("spider"))
    return docs.unionByName(pages).groupBy("spider").agg(F.count("*").alias("n"))


# -- Scalars -----------------------------------------------------------------------------------------


@query(
    "C17_reminder_text",
    f"""WITH {_DEADLINE_SQL}, x AS (SELECT id, title, date_diff('day', DATE '{AS_OF}', deadline) AS days FROM n) SELECT id, CASE days WHEN 0 THEN 'Last day: ' WHEN 1 THEN 'One day left: ' ELSE 'Three days left: ' END || substr(title, 1, 12) AS message FROM x WHERE days IN (3, 1, 0)""",
)
def reminder_text(spark, d):
    n = _with_deadline(notices(spark, d)).withColumn("days", dates.days_left(F.col("deadline"), AS_OF)).where("days in (3, 1, 0)")
    return n.select("id", F.concat(F.when(F.col("days") == 0, "Last day: ").when(F.col("days") == 1, "One day left: ").otherwise("Three days left: "), F.substring("title", 1, 12)).alias("message"))


@query(
    "C18_days_label",
    f"""WITH {_DEADLINE_SQL}, x AS (SELECT id, date_diff('day', DATE '{AS_OF}', deadline) AS days FROM n)
        SELECT id, CASE WHEN days IS NULL THEN 'unknown' WHEN days < 0 THEN 'expired' WHEN days = 0 THEN 'today' ELSE days || ' days left' END AS label, CASE WHEN days IS NULL OR days < 0 THEN 'expired' WHEN days <= 7 THEN 'urgent' WHEN days <= 14 THEN 'soon' ELSE 'normal' END AS class FROM x""",
)
def days_label(spark, d):
    n = _with_deadline(notices(spark, d)).withColumn("days", dates.days_left(F.col("deadline"), AS_OF))
    return n.select("id", dates.days_left_label(F.col("days")).alias("label"), dates.days_left_class(F.col("days")).alias("class"))


@query("J28_days_left_rounded_up", f"WITH {_DEADLINE_SQL} SELECT id, CASE WHEN deadline IS NULL THEN -1 ELSE CAST(ceil((epoch(CAST(deadline AS TIMESTAMP)) - epoch(TIMESTAMP '{AS_OF} 15:30:00')) / 86400.0) AS BIGINT) END AS days FROM n")
def days_left_rounded_up(spark, d):
    """From an instant, part days count as whole ones; -1 without a deadline."""
    left = F.ceil((F.unix_timestamp(F.col("deadline").cast("timestamp")) - F.unix_timestamp(F.lit(f"{AS_OF} 15:30:00").cast("timestamp"))) / 86400.0)
    return _with_deadline(notices(spark, d)).select("id", F.coalesce(left, F.lit(-1)).cast("long").alias("days"))


@query("J29_days_left_or_null", f"WITH {_DEADLINE_SQL} SELECT id, date_diff('day', DATE '{AS_OF}', deadline) AS days FROM n")
def days_left_or_null(spark, d):
    return _with_deadline(notices(spark, d)).select("id", dates.days_left(F.col("deadline"), AS_OF).cast("long").alias("days"))


@query("J31_iso_date_in_text", "SELECT doc_id, nullif(regexp_extract(text, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS iso FROM documents")
def iso_date_in_text(spark, d):
    return table(spark, d, "documents").select("doc_id", dates.ambiguous_iso(F.col("text")).alias("iso"))


#: Java's Unicode white space as RE2 writes it.
_WHITE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query("J03_loose_title", f"""WITH {NOTICES_SQL} SELECT id, lower(regexp_replace(title, '[{_WHITE},.;:!?"''()\\[\\]，。；：！？、“”‘’（）【】《》\\-]+', '', 'g')) AS loose FROM notices""")
def loose_title(spark, d):
    return notices(spark, d).select("id", without_punctuation(F.col("title")).alias("loose"))


@query("J33_deadline_score", f"WITH {_DEADLINE_SQL}, x AS (SELECT id, date_diff('day', DATE '{AS_OF}', deadline) AS days FROM n) SELECT id, CASE WHEN days IS NULL THEN 0.5 WHEN days < 0 THEN 0 WHEN days <= 7 THEN 1.2 WHEN days <= 30 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM x")
def deadline_score(spark, d):
    days = dates.days_left(F.col("deadline"), AS_OF)
    return _with_deadline(notices(spark, d)).select("id", dates.deadline_score(days, F.col("deadline").isNotNull()).alias("score"))


@query("J05_bare_title", f"WITH {NOTICES_SQL} SELECT id, regexp_replace(translate(title, '（）【】〔〕', '()[][]'), '[{_WHITE}\"“”''《》]+', '', 'g') AS bare FROM notices")
def bare_title(spark, d):
    return notices(spark, d).select("id", folded_title(F.col("title")).alias("bare"))


@query("C09_listed_fields", "SELECT c_custkey, list_filter(list_transform(string_split(c_name || ', ' || c_mktsegment, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM customer")
def listed_fields(spark, d):
    """A comma string as a list, blanks dropped."""
    parts = F.transform(F.split(F.concat("c_name", F.lit(", "), "c_mktsegment"), ","), lambda x: F.trim(x))
    return table(spark, d, "customer").select("c_custkey", F.filter(parts, lambda x: x != "").alias("items"))


@query("C06_truthy_defaults", "SELECT p_partkey, coalesce(nullif(p_name, ''), 'untitled') AS title, CASE WHEN p_size IS NULL OR p_size = 0 THEN 1 ELSE p_size END AS size FROM part")
def truthy_defaults(spark, d):
    """Empty texts and zeros count as missing."""
    size = F.when(F.col("p_size").isNull() | (F.col("p_size") == 0), 1).otherwise(F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.nullif("p_name", F.lit("")), F.lit("untitled")).alias("title"), size.alias("size"))


def _plain_hits_sql() -> str:
    one = lambda w: f"CAST(contains(text, '{w}') AS INTEGER)"
    return ", ".join(f"({' + '.join([one(w) for w in yes] or ['0'])}) AS s{i}" for i, (_, yes, _) in enumerate(CATEGORY_RULES))


@query(
    "E18_rule_argmax",
    f"WITH s AS (SELECT doc_id, {_plain_hits_sql()} FROM documents), m AS (SELECT *, greatest(s0, s1, s2, s3) AS best FROM s) SELECT doc_id, CASE WHEN s0 = best THEN 'legal' WHEN s1 = best THEN 'prose' WHEN s2 = best THEN 'data' ELSE 'other' END AS category, CAST(best AS DOUBLE) AS hits FROM m WHERE best > 0",
)
def rule_argmax(spark, d):
    """Plain hit counts; a text without a hit has no category."""
    rules = [(name, yes, []) for name, yes, _ in CATEGORY_RULES]
    return argmax_rule(table(spark, d, "documents"), rules, F.col("text"), plus=1.0).where("category_score > 0").select("doc_id", "category", F.col("category_score").alias("hits"))


@query(
    "L12_assistant_category",
    f"WITH s AS (SELECT doc_id, {_plain_hits_sql()} FROM documents), m AS (SELECT *, greatest(s0, s1, s2, s3) AS best FROM s) SELECT doc_id, CASE WHEN s0 = best THEN 'legal' WHEN s1 = best THEN 'prose' WHEN s2 = best THEN 'data' ELSE 'other' END AS category FROM m",
)
def assistant_category(spark, d):
    """As above, but a text without a hit takes the first rule."""
    rules = [(name, yes, []) for name, yes, _ in CATEGORY_RULES]
    return argmax_rule(table(spark, d, "documents"), rules, F.col("text"), plus=1.0).select("doc_id", "category")


@query("K37_tag_rules", "SELECT doc_id, list_filter([CASE WHEN contains(text, 'icensed') OR contains(text, 'reserved') THEN 'legal' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS tags FROM documents WHERE text IS NOT NULL")
def tag_rules(spark, d):
    rules = [("legal", ["icensed", "reserved"]), ("mail", ["@"]), ("table", ["|"])]
    return table(spark, d, "documents").where("text is not null").select("doc_id", tags(F.col("text"), rules).alias("tags"))
