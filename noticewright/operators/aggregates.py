"""Aggregations (survey section F), windows (G), sorts and paging (H), set operations (I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SEPARATORS, contains_any, hits, runs
from ..plans.views import ACTIONS_SQL, NOTICES_SQL, actions, notices, table
from ..registry import query
from .joins import first_per

STOP = ["the", "and", "of", "der", "die", "les", "des", "que", "los"]


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to as many tasks as a shuffle has, which adaptive execution doesn't merge."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def top_tokens(df: DataFrame, key: str, text: Column, k: int, stop: list[str] = STOP) -> DataFrame:
    """The ``k`` most frequent tokens of each row, ties by token (F13). Texts are dealt by key, so that
    they are all that moves: tokens are counted and ranked where their text is."""
    words = F.filter(F.split(F.lower("_text"), r"[^\p{L}]+"), lambda w: (F.length(w) >= 2) & ~w.isin(stop))
    counts = dealt(df.select(key, text.alias("_text")), key).select(key, F.explode(words).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "token"))
    return counts.withColumn("place", place.cast("long")).where(F.col("place") <= k)


@query("F01_statistics", "SELECT CASE WHEN GROUPING(source) = 0 THEN 'source' WHEN GROUPING(lang) = 0 THEN 'lang' ELSE 'all' END AS what, coalesce(source, lang, '') AS name, count(*) AS n FROM documents GROUP BY GROUPING SETS ((), (source), (lang))")
def statistics(spark, d):
    """Total and counts by source and language in one pass."""
    cells = table(spark, d, "documents").select("source", "lang").groupingSets([[], ["source"], ["lang"]], "source", "lang").agg(F.grouping("source").alias("gs"), F.grouping("lang").alias("gl"), F.count("*").alias("n"))
    what = F.when(F.col("gs") == 0, "source").when(F.col("gl") == 0, "lang").otherwise("all")
    return cells.select(what.alias("what"), F.coalesce("source", "lang", F.lit("")).alias("name"), "n")


@query("F03_by_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC")
def by_month(spark, d):
    """Month buckets, newest first."""
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n")).orderBy(F.desc("month"))


@query("F05_high_water_mark", f"WITH {NOTICES_SQL} SELECT spider, CAST(max(publish_date) AS VARCHAR) AS mark, count(*) AS n, CAST(min(publish_date) AS VARCHAR) AS first FROM notices GROUP BY spider")
def high_water_mark(spark, d):
    """Newest, oldest and number per spider."""
    return notices(spark, d).groupBy("spider").agg(F.max("publish_date").cast("string").alias("mark"), F.count("*").alias("n"), F.min("publish_date").cast("string").alias("first"))


@query("F07_inside_window", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01') AS inside, count(*) FILTER (WHERE NOT (o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01')) AS outside FROM orders GROUP BY 1")
def inside_window(spark, d):
    """Counts inside and outside of a window."""
    inside = (F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1996-01-01")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query("F09_crawl_statistics", "SELECT count(*) AS total, count(DISTINCT text) AS valid, count(*) - count(DISTINCT text) AS repeated FROM documents")
def crawl_statistics(spark, d):
    one = table(spark, d, "documents").groupBy(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.length("text").alias("c")).agg(F.count("*").alias("n"))
    return one.agg(F.sum("n").alias("total"), F.count("*").alias("valid"), (F.sum("n") - F.count("*")).alias("repeated"))


@query("F10_by_category", "SELECT coalesce(nullif(CASE WHEN p_size > 25 THEN p_type ELSE '' END, ''), 'other') AS category, count(*) AS n FROM part GROUP BY 1")
def by_category(spark, d):
    category = F.coalesce(F.nullif(F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""), F.lit("")), F.lit("other"))
    return table(spark, d, "part").groupBy(category.alias("category")).agg(F.count("*").alias("n"))


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


@query(
    "F13_top_tokens",
    f"""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t WHERE length(token) >= 2 AND token NOT IN ({_STOP_SQL}) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS place FROM c) SELECT doc_id, token, n, place FROM r WHERE place <= 5""",
)
def top_tokens_query(spark, d):
    return top_tokens(table(spark, d, "documents"), "doc_id", F.col("text"), 5)


@query(
    "F14_word_weights",
    f"""WITH {NOTICES_SQL}, t AS (SELECT unnest(regexp_extract_all(lower(title), '[a-z]{{4,8}}')) AS w, 5.0 AS v FROM notices UNION ALL SELECT unnest(regexp_extract_all(lower(content), '[a-z]{{4,8}}')), 0.5 FROM notices),
        s AS (SELECT w, sum(v) * CASE WHEN w IN ('that', 'with') THEN 2.0 WHEN w IN ('from', 'this') THEN 0.5 ELSE 1.0 END AS weight FROM t GROUP BY w)
        SELECT w AS word, weight FROM s WHERE weight >= 2 ORDER BY weight DESC, w LIMIT 30""",
)
def word_weights(spark, d):
    """Word cloud: 5 for each title token, 0.5 for each content token, boosts and brakes."""
    n = notices(spark, d)
    part = lambda col, v: n.select(F.explode(runs(F.lower(col), "a-z", 4, 8)).alias("word"), F.lit(v).alias("v"))
    factor = F.when(F.col("word").isin("that", "with"), 2.0).when(F.col("word").isin("from", "this"), 0.5).otherwise(1.0)
    summed = part("title", 5.0).unionByName(part("content", 0.5)).groupBy("word").agg(F.sum("v").alias("weight")).withColumn("weight", F.col("weight") * factor)
    return summed.where("weight >= 2").orderBy(F.desc("weight"), "word").limit(30)


@query(
    "F15_hotness",
    f"WITH {ACTIONS_SQL} SELECT item, count(*) FILTER (WHERE action = 'view') AS views, count(*) FILTER (WHERE action = 'favorite') AS favorites, count(*) FILTER (WHERE action = 'useful') AS useful, CAST(sum(CASE action WHEN 'view' THEN 1 WHEN 'favorite' THEN 3 WHEN 'useful' THEN 2 ELSE 0 END) AS BIGINT) AS total FROM actions GROUP BY item",
)
def hotness_counters(spark, d):
    weight = F.when(F.col("action") == "view", 1).when(F.col("action") == "favorite", 3).when(F.col("action") == "useful", 2).otherwise(0)
    n = lambda a, name: F.count_if(F.col("action") == a).alias(name)
    return actions(spark, d).groupBy("item").agg(n("view", "views"), n("favorite", "favorites"), n("useful", "useful"), F.sum(weight).alias("total"))


@query(
    "F16_profile_weights",
    f"WITH {ACTIONS_SQL} SELECT user_id, d.source AS keyword, CAST(sum(CASE WHEN action = 'other' THEN -1 ELSE 1 END) AS BIGINT) AS weight FROM actions a JOIN documents d ON d.doc_id = a.item GROUP BY ALL",
)
def profile_weights(spark, d):
    """Feedback of +1 or -1 summed by user and keyword, the source (F16 without tags and categories)."""
    joined = actions(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), F.col("item") == F.col("doc_id"))
    return joined.groupBy("user_id", F.col("source").alias("keyword")).agg(F.sum(F.when(F.col("action") == "other", -1).otherwise(1)).alias("weight"))


def decayed_weights(acts: DataFrame, by: list[str], as_of: str, last: int = 300) -> DataFrame:
    """Recent actions weigh more: delta x exp(-days / 30), days at least 1, over each user's last
    ``last`` actions (F18, N10). Recomputed from the log, so that it can be run again."""
    delta = F.when(F.col("action") == "favorite", 2.2).when(F.col("action") == "useful", 1.6).when(F.col("action") == "view", 0.8).otherwise(0.5)
    recent = acts.withColumn("_rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("_rn") <= last)
    days = F.greatest(F.lit(1), F.datediff(F.lit(as_of).cast("date"), F.col("ts").cast("date")))
    return recent.groupBy(*by).agg(F.round(F.sum(delta * F.exp(-days / 30.0)), 6).alias("weight"))


@query(
    "F18_decayed_weights",
    f"""WITH {ACTIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM actions)
        SELECT user_id, round(sum(CASE action WHEN 'favorite' THEN 2.2 WHEN 'useful' THEN 1.6 WHEN 'view' THEN 0.8 ELSE 0.5 END * exp(-greatest(1, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')) / 30.0)), 6) AS weight FROM r WHERE rn <= 300 GROUP BY user_id""",
)
def decayed_weights_query(spark, d):
    """Over the last 300 actions, as surveyed."""
    return decayed_weights(actions(spark, d), ["user_id"], "2024-02-01")


@query(
    "F16_weights_of_words",
    f"""WITH {ACTIONS_SQL}, {NOTICES_SQL}, t AS (SELECT id, source, spider, list_filter(string_split_regex(lower(title), '[\\s,，。；;、]+')[1:40], lambda x: length(x) BETWEEN 2 AND 12) AS words FROM notices),
        k AS (SELECT id, unnest(list_transform(words, lambda w: {{'kind': 'token', 'word': w}}) || [{{'kind': 'tag', 'word': source}}, {{'kind': 'category', 'word': spider}}], recursive := true) FROM t)
        SELECT user_id, kind, word, CAST(sum(CASE WHEN action = 'other' THEN -1 ELSE 1 END) AS BIGINT) AS weight FROM actions JOIN k ON k.id = item WHERE word IS NOT NULL GROUP BY ALL""",
)
def token_weights(spark, d):
    """Feedback of +1 or -1 summed by user over a notice's tag, category and the first forty tokens of its
    title, those of 2 to 12 letters (F16, F17). Actions are summed by user and notice before they
    meet the words."""
    words = F.filter(F.slice(F.split(F.lower("title"), SEPARATORS), 1, 40), lambda x: F.length(x).between(2, 12))
    said = lambda kind, w: F.struct(F.lit(kind).alias("kind"), w.alias("word"))
    every = F.concat(F.transform(words, lambda w: said("token", w)), F.array(said("tag", F.col("source")), said("category", F.col("spider"))))
    known = notices(spark, d).select("id", F.explode(every).alias("k")).select("id", "k.kind", "k.word").where("word is not null")
    acts = actions(spark, d).groupBy("user_id", "item").agg(F.sum(F.when(F.col("action") == "other", -1).otherwise(1)).alias("delta"))
    return acts.join(known, F.col("item") == F.col("id")).groupBy("user_id", "kind", "word").agg(F.sum("delta").alias("weight"))


@query("F20_keyword_hits", "SELECT doc_id, len(list_filter(['the', 'und', 'que', 'les', 'http'], lambda k: contains(text, k))) AS hits FROM documents")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(hits(F.col("text"), ["the", "und", "que", "les", "http"])).cast("long").alias("hits"))


@query("F22_weight_range", "SELECT min(n_chars) AS least, max(n_chars) AS most, count(*) FILTER (WHERE n_chars > 1000) AS large FROM documents")
def weight_range(spark, d):
    return table(spark, d, "documents").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count_if(F.col("n_chars") > 1000).alias("large"))


@query("F23_distinct_in_order", "WITH f AS (SELECT conv_id, turn, regexp_extract_all(text, '[a-z]{5}') AS l FROM conversations) SELECT conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) AS runs FROM f")
def distinct_in_order(spark, d):
    """Distinct values of a text in the order of their first places."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{5}"), F.lit(0))).alias("runs"))


# -- Windows -----------------------------------------------------------------------------------------


@query("G01_keep_first", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def keep_first(spark, d):
    """First row per text (G1 to G3). Grouping by digest moves no text."""
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("k")


@query("G04_longest_first", "SELECT n_regionkey, n_name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY length(n_name) DESC, n_nationkey) AS rn FROM nation) WHERE rn = 1")
def longest_first(spark, d):
    return first_per(table(spark, d, "nation"), ["n_regionkey"], [F.desc(F.length("n_name")), F.col("n_nationkey")]).select("n_regionkey", "n_name")


@query("G05_argmax_first_wins", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS best FROM orders GROUP BY o_custkey")
def argmax_first_wins(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


@query("G06_last_n", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 20")
def last_n(spark, d):
    """A ring buffer of the last 20 rows of a key."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("rn", rn).where("rn <= 20").select("event_id")


@query("G07_rank_display", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def rank_display(spark, d):
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long").alias("place"))


@query("G08_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def retention(spark, d):
    return table(spark, d, "events").where(F.col("ts") >= "2024-01-24").select("event_id")


@query(
    "G09_latest_or_earliest",
    "SELECT o_custkey, coalesce(max(o_orderdate) FILTER (WHERE o_orderstatus = 'O'), min(o_orderdate)) AS chosen FROM orders GROUP BY o_custkey",
)
def latest_or_earliest(spark, d):
    """The latest of the preferred candidates, else the earliest of all."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate"))), F.min("o_orderdate")).alias("chosen"))


@query(
    "G10_category_quota",
    """WITH r AS (SELECT p_partkey, p_brand, p_type, p_size, row_number() OVER (PARTITION BY p_brand, p_size > 25 ORDER BY p_retailprice DESC, p_partkey) AS own FROM part)
       SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size > 25 AND own <= 2 THEN 0 ELSE 1 END, own, p_partkey) AS place FROM r) WHERE place <= 3""",
)
def category_quota(spark, d):
    """At least two of three places for the wanted category, where it has that many."""
    own = F.row_number().over(Window.partitionBy("p_brand", F.col("p_size") > 25).orderBy(F.desc("p_retailprice"), "p_partkey"))
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.when((F.col("p_size") > 25) & (F.col("own") <= 2), 0).otherwise(1), "own", "p_partkey"))
    return table(spark, d, "part").withColumn("own", own).withColumn("place", place).where("place <= 3").select("p_brand", "p_partkey")


# -- Sorts and paging --------------------------------------------------------------------------------


def sorted_notices(df: DataFrame, mode: str, as_of: str) -> DataFrame:
    """The seven orders of a list page (H1, H4 to H10); ties go to the smaller id."""
    days = F.datediff("deadline", F.lit(as_of).cast("date"))
    nearest = F.when(days.isNull() | (days < 0), 9999).otherwise(days)
    orders = {
        "publish_desc": [F.desc("publish_date")], "publish_asc": [F.asc("publish_date")], "default": [F.desc("publish_date")],
        "deadline_nearest": [nearest.asc(), F.desc("publish_date")], "deadline_earliest": [F.asc_nulls_last("deadline")], "deadline_latest": [F.desc_nulls_last("deadline")],
        "title": [F.asc("title")],
    }
    return df.orderBy(*orders[mode], "id")


def page(df: DataFrame, number: int, size: int = 10) -> DataFrame:
    """One page of a sorted list (H11); the offset is limited before anything is moved."""
    return df.offset((number - 1) * size).limit(size)


def _with_deadline(df: DataFrame) -> DataFrame:
    return df.withColumn("deadline", F.when(F.col("id") % 7 != 0, F.date_add("publish_date", (F.col("n_chars") % 60).cast("int"))))


_DEADLINE_SQL = f"{NOTICES_SQL}, n AS (SELECT *, CASE WHEN id % 7 <> 0 THEN publish_date + CAST(n_chars % 60 AS INTEGER) END AS deadline FROM notices)"


@query(
    "H06_deadline_nearest",
    f"""WITH {_DEADLINE_SQL}, k AS (SELECT id, publish_date, CASE WHEN deadline IS NULL OR deadline < DATE '2024-06-15' THEN 9999 ELSE date_diff('day', DATE '2024-06-15', deadline) END AS days FROM n)
        SELECT id, days FROM k ORDER BY days, publish_date DESC, id LIMIT 10 OFFSET 10""",
)
def deadline_nearest(spark, d):
    """Second page by nearest deadline, expired and unknown ones last."""
    rows = page(sorted_notices(_with_deadline(notices(spark, d)), "deadline_nearest", "2024-06-15"), 2)
    days = F.datediff("deadline", F.lit("2024-06-15").cast("date"))
    return rows.select("id", F.when(days.isNull() | (days < 0), 9999).otherwise(days).cast("long").alias("days"))


@query("H07_deadline_latest", f"WITH {_DEADLINE_SQL} SELECT id, CAST(deadline AS VARCHAR) AS deadline FROM n ORDER BY n.deadline DESC NULLS LAST, id LIMIT 25")
def deadline_latest(spark, d):
    return sorted_notices(_with_deadline(notices(spark, d)), "deadline_latest", "2024-06-15").limit(25).select("id", F.col("deadline").cast("string").alias("deadline"))


@query("H02_newest_five", f"WITH {NOTICES_SQL} SELECT id FROM notices ORDER BY publish_date DESC, id DESC LIMIT 5")
def newest_five(spark, d):
    return notices(spark, d).orderBy(F.desc("publish_date"), F.desc("id")).limit(5).select("id")


@query("H08_title_order", f"WITH {NOTICES_SQL} SELECT id, title FROM notices ORDER BY title, id LIMIT 40")
def title_order(spark, d):
    return sorted_notices(notices(spark, d).withColumn("deadline", F.lit(None).cast("date")), "title", "2024-01-01").limit(40).select("id", "title")


@query("H11_third_page", "SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 20")
def third_page(spark, d):
    return page(table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id"), 3).select("doc_id")


@query("H18_page_count", "SELECT source, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM documents GROUP BY source")
def page_count(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.ceil(F.count("*") / 10.0).alias("pages"))


@query("H13_top_by_score", "SELECT p_partkey, p_size * 0.5 + p_retailprice * 0.1 AS score FROM part ORDER BY score DESC, p_partkey LIMIT 50")
def top_by_score(spark, d):
    """Stable top n."""
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") * 0.5 + F.col("p_retailprice") * 0.1).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


# -- Sets --------------------------------------------------------------------------------------------


def union_of(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("I01_union_of_silos", "SELECT doc_id, lang AS silo, CASE WHEN lang = 'en' THEN n_chars END AS n_chars FROM documents WHERE lang IN ('en', 'de', 'fr')")
def union_of_silos(spark, d):
    docs = table(spark, d, "documents")
    silo = lambda lang, *cols: docs.where(F.col("lang") == lang).select("doc_id", F.col("lang").alias("silo"), *cols)
    return union_of([silo("en", "n_chars"), silo("de"), silo("fr")])


@query("I04_last_interests", "SELECT user_id, list(event_type ORDER BY ts DESC, event_id DESC)[1:8] AS latest FROM events GROUP BY user_id")
def last_interests(spark, d):
    """The last eight, the newest first: a group limit, then at most eight rows are collected."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    few = table(spark, d, "events").withColumn("rn", rn).where("rn <= 8")
    return few.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "event_type"))), lambda x: x["event_type"]).alias("latest"))


@query("I05_array_difference", "SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]{5,}')), lambda x: NOT list_contains(regexp_extract_all(text, '([0-9]+)@', 1), x))) AS n FROM documents")
def array_difference(spark, d):
    """Numbers of a text that aren't local parts of its mail addresses."""
    left = F.array_except(F.regexp_extract_all("text", F.lit("[0-9]{5,}"), F.lit(0)), F.regexp_extract_all("text", F.lit("([0-9]+)@"), F.lit(1)))
    return table(spark, d, "documents").select("doc_id", F.size(left).cast("long").alias("n"))


@query("I06_links_not_in_text", "WITH l AS (SELECT page_id, html, list_distinct(regexp_extract_all(html, '<a href=\"/([^\"]*)\"', 1)) AS links FROM pages) SELECT page_id, len(list_filter(links, lambda x: NOT contains(html, ' ' || x || ' '))) AS missing FROM l")
def links_not_in_text(spark, d):
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)))
    missing = F.filter(links, lambda x: ~F.contains("html", F.concat(F.lit(" "), x, F.lit(" "))))
    return table(spark, d, "pages").select("page_id", F.size(missing).cast("long").alias("missing"))


@query(
    "I07_word_overlap",
    "WITH w AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b)) * 1.0 / len(b) AS ratio, len(list_intersect(a, b)) * 1.0 / len(b) >= 0.7 AS same FROM w",
)
def word_overlap(spark, d):
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower("p_type"), " "))
    ratio = F.size(F.array_intersect(a, b)) * 1.0 / F.size(b)
    return table(spark, d, "part").select("p_partkey", ratio.cast("double").alias("ratio"), (ratio >= 0.7).alias("same"))


@query("D24_any_word_by_source", "SELECT source, count(*) FILTER (WHERE regexp_matches(text, 'reserved|Licensed')) AS n FROM documents GROUP BY source")
def any_word_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(contains_any(F.col("text"), ["reserved", "Licensed"])).alias("n"))
