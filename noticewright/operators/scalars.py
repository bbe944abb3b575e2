"""Scalar functions (survey section J) and projections (C) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, text
from ..plans.views import NOTICES_SQL, notices, table
from ..registry import query

AS_OF = "2024-06-15"

#: Source ids and shown names (E8, C7): a parameter of the export.
SOURCE_NAMES = {"src0": "Main office", "src1": "Archive", "src2": "Library"}


def or_default(c: Column, default) -> Column:
    """Null, empty and blank text count as missing."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


@query("J01_normalised", "SELECT doc_id, sha256(lower(regexp_replace(text, '[\\s\"“”]+', '', 'g'))) AS h FROM documents")
def normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.normalised(F.col("text")), 256).alias("h"))


@query("J02_without_punctuation", "SELECT doc_id, length(lower(regexp_replace(text, '[\\s,.;:!?\"''()\\[\\]-]+', '', 'g'))) AS n FROM documents")
def without_punctuation(spark, d):
    """Loose normalisation of titles and messages."""
    return table(spark, d, "documents").select("doc_id", F.length(text.without_punctuation(F.col("text"))).cast("long").alias("n"))


@query("J04_folded_title", "SELECT p_partkey, replace(replace(p_name, ' ', ''), '\"', '') AS t FROM part")
def folded_title(spark, d):
    """Bracket folding and quote removal."""
    return table(spark, d, "part").select("p_partkey", text.folded_title(F.col("p_name")).alias("t"))


@query("J06_collapsed", "SELECT doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS h FROM documents")
def collapsed(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.collapsed(F.col("text")), 256).alias("h"))


@query("J07_tidy_lines", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS t FROM documents")
def tidy_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tidy_lines(F.col("text")).alias("t"))


@query("J08_few_newlines", "SELECT doc_id, length(trim(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS n FROM documents")
def few_newlines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(text.few_newlines(F.col("text"))).cast("long").alias("n"))


@query("J09_no_tail_punctuation", f"WITH {NOTICES_SQL} SELECT id, regexp_replace(title, '[.,;:!?\\s]+$', '') AS t FROM notices")
def no_tail_punctuation(spark, d):
    return notices(spark, d).select("id", text.no_tail_punctuation(F.col("title")).alias("t"))


@query("J10_no_ordinals", "SELECT conv_id, turn, regexp_replace(text, '\\([0-9]+\\)', '', 'g') AS t FROM conversations")
def no_ordinals(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.no_ordinals(F.col("text")).alias("t"))


@query("J12_tokens", "SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[\\s,;]+'), lambda x: length(x) >= 2) AS t FROM conversations")
def tokens(spark, d):
    """Tokens between separators."""
    return table(spark, d, "conversations").select("conv_id", "turn", text.tokens(F.col("text")).alias("t"))


@query("J13_letter_runs", "SELECT doc_id, len(regexp_extract_all(text, '[a-z]{2,6}')) AS n FROM documents")
def letter_runs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.runs(F.col("text"))).cast("long").alias("n"))


@query("J15_summary", "WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS summary FROM c")
def summary(spark, d):
    return table(spark, d, "documents").select("doc_id", text.summary(F.col("text")).alias("summary"))


@query("J18_url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, d):
    part = lambda p: F.try_parse_url(F.col("url"), F.lit(p))
    return table(spark, d, "pages").select("page_id", part("HOST").alias("host"), part("QUERY").alias("query"), part("PATH").alias("path"))


@query("J17_absolute_url", "WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') || href AS link FROM l")
def absolute_url(spark, d):
    """Links from the root of a host, made absolute by built-in functions. Relative ones go through
    ``sources.html.joined_url``."""
    links = table(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), "href").alias("link"))


@query("J21_parsed_date", "SELECT doc_id, TRY_CAST((2000 + doc_id % 30) || '-' || (doc_id % 14) || '-' || (doc_id % 33) AS DATE) AS parsed FROM documents")
def parsed_date(spark, d):
    """Dates from text, null for days that don't exist."""
    t = F.concat_ws("-", 2000 + F.col("doc_id") % 30, F.col("doc_id") % 14, F.col("doc_id") % 33)
    return table(spark, d, "documents").select("doc_id", dates.parsed_date(t).alias("parsed"))


@query(
    "J26_completed_year",
    f"""WITH {NOTICES_SQL}, x AS (SELECT id, publish_date, 1 + id % 12 AS m, 1 + id % 28 AS dd FROM notices), y AS (SELECT *, make_date(year(publish_date), m, dd) AS same, make_date(year(publish_date) + 1, m, dd) AS nxt FROM x)
        SELECT id, CASE WHEN date_diff('day', same, publish_date) > 180 THEN nxt ELSE same END AS completed FROM y""",
)
def completed_year(spark, d):
    return notices(spark, d).select("id", dates.completed_date(F.col("id") % 12 + 1, F.col("id") % 28 + 1, F.col("publish_date")).alias("completed"))


@query(
    "J27_days_left",
    f"""WITH {NOTICES_SQL}, x AS (SELECT id, date_diff('day', DATE '{AS_OF}', publish_date) AS days_left FROM notices)
        SELECT id, days_left, CASE WHEN days_left < 0 THEN 'expired' WHEN days_left = 0 THEN 'today' ELSE days_left || ' days left' END AS label, CASE WHEN days_left < 0 THEN 'expired' WHEN days_left <= 7 THEN 'urgent' WHEN days_left <= 14 THEN 'soon' ELSE 'normal' END AS class FROM x""",
)
def days_left(spark, d):
    """Days left, their label and class."""
    n = notices(spark, d).withColumn("days_left", dates.days_left(F.col("publish_date"), AS_OF))
    return n.select("id", F.col("days_left").cast("long"), dates.days_left_label(F.col("days_left")).alias("label"), dates.days_left_class(F.col("days_left")).alias("class"))


@query(
    "J32_recency_and_deadline",
    f"""WITH {NOTICES_SQL}, x AS (SELECT id, date_diff('day', publish_date, DATE '{AS_OF}') AS age FROM notices)
        SELECT id, CASE WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.7 WHEN age <= 90 THEN 0.4 ELSE 0.1 END::DOUBLE AS recency,
               CASE WHEN id % 9 = 0 THEN 0.5 WHEN id % 9 = 1 THEN 0.6 WHEN -age < 0 THEN 0 WHEN -age <= 7 THEN 1.2 WHEN -age <= 30 THEN 1.0 ELSE 0.5 END::DOUBLE AS deadline FROM x""",
)
def recency_and_deadline(spark, d):
    n = notices(spark, d).withColumn("age", F.datediff(F.lit(AS_OF).cast("date"), "publish_date"))
    days = F.when(F.col("id") % 9 == 1, F.lit(None)).otherwise(-F.col("age"))
    return n.select("id", dates.recency_score(F.col("age")).alias("recency"), dates.deadline_score(days, F.col("id") % 9 != 0).alias("deadline"))


@query("J34_hotness_norm", "SELECT p_partkey, least(1.0, greatest(0.0, (p_size - 10) / 20.0))::DOUBLE AS hot FROM part")
def hotness_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("p_size") - 10) / 20.0)).alias("hot"))


@query("J35_level_bonus", "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, '1-') THEN 20 WHEN contains(o_orderpriority, '2-') THEN 10 WHEN contains(o_orderpriority, '5-') THEN 0 ELSE 5 END AS bonus FROM orders")
def level_bonus(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.when(p.contains("1-"), 20).when(p.contains("2-"), 10).when(p.contains("5-"), 0).otherwise(5).alias("bonus"))


def title_similarity(a: Column, b: Column) -> Column:
    """100 for equal titles, 92 if one holds the other, else 15 for a shared year and 6 for each
    shared token (J36)."""
    shared = F.size(F.array_intersect(text.tokens(a), text.tokens(b)))
    years = F.size(F.array_intersect(F.regexp_extract_all(a, F.lit(r"20\d{2}"), F.lit(0)), F.regexp_extract_all(b, F.lit(r"20\d{2}"), F.lit(0))))
    return F.when(a == b, 100).when(a.contains(b) | b.contains(a), 92).otherwise(F.when(years > 0, 15).otherwise(0) + 6 * shared)


@query(
    "J36_title_similarity",
    """WITH x AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part)
       SELECT p_partkey, CASE WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 92 ELSE 6 * len(list_intersect(list_filter(string_split(a, ' '), lambda t: length(t) >= 2), list_filter(string_split(b, ' '), lambda t: length(t) >= 2))) END::BIGINT AS score FROM x""",
)
def title_similarity_query(spark, d):
    return table(spark, d, "part").select("p_partkey", title_similarity(F.lower("p_name"), F.lower("p_type")).cast("long").alias("score"))


@query("J37_year_tokens", "WITH f AS (SELECT doc_id, regexp_extract_all(text, '20[0-9]{2}') AS l FROM documents) SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS years FROM f")
def year_tokens(spark, d):
    """Years that a text names, each once."""
    return table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all("text", F.lit("20[0-9]{2}"), F.lit(0))).alias("years"))


@query("J38_fallback_chain", "SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'none') AS title FROM pages")
def fallback_chain(spark, d):
    """The first extraction that gives something."""
    first = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.coalesce(first("<h1>([^<]*)</h1>"), first("<title>([^<]*)</title>"), F.lit("none")).alias("title"))


@query("J40_json_arrays", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, '[\"' || event_type || '\",\"' || user_id || '\"]' AS encoded FROM events")
def json_arrays(spark, d):
    ev = table(spark, d, "events").withColumn("p", F.from_json("props", "struct<k: bigint>"))
    return ev.select("event_id", F.col("p.k").alias("k"), F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("encoded"))


@query("J41_lenient_json", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN [turn, conv_id] END AS ids FROM conversations")
def lenient_json(spark, d):
    """A JSON array inside model text: fences and prose around it go; what isn't JSON is null."""
    said = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here:\n```json\n["), "turn", F.lit(", "), "conv_id", F.lit("]\n```"))).otherwise(F.lit("no list"))
    return table(spark, d, "conversations").select("conv_id", "turn", lenient_array(said).alias("ids"))


def lenient_array(t: Column, kind: str = "array<bigint>") -> Column:
    return F.from_json(F.nullif(F.regexp_extract(t, r"(?s)\[.*\]", 0), F.lit("")), kind)


@query("J44_label_migration", "SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'opened' ELSE event_type END AS label FROM events")
def label_migration(spark, d):
    """Old labels to new ones by a literal map, others unchanged."""
    new = F.create_map(*map(F.lit, ("view", "seen", "click", "opened")))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(new, F.col("event_type")), "event_type").alias("label"))


@query("J20_valid_utf8", "SELECT doc_id, length(text) AS n FROM documents")
def valid_utf8(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(F.make_valid_utf8(F.col("text").cast("binary").cast("string"))).cast("long").alias("n"))


# -- Projections -------------------------------------------------------------------------------------


@query("C01_decode_arrays", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN [] ELSE [role] END AS tags FROM conversations WHERE turn = 1")
def decode_arrays(spark, d):
    """A JSON array in a text column; what isn't one is an empty array."""
    stored = F.when(F.col("conv_id") % 3 == 0, F.lit("broken[")).otherwise(F.to_json(F.array("role")))
    tags = F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>"))
    return table(spark, d, "conversations").where("turn = 1").select("conv_id", tags.alias("tags"))


@query("C03_fill_missing", "SELECT doc_id, coalesce(trim(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ' ' || source || ' ' END), '') AS source, coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE lang END), ''), 'unknown') AS lang FROM documents")
def fill_missing(spark, d):
    """Trimmed, with defaults for what is missing or blank."""
    return table(spark, d, "documents").select(
        "doc_id",
        F.coalesce(F.trim(F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit(" "), "source", F.lit(" ")))), F.lit("")).alias("source"),
        or_default(F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("lang")), "unknown").alias("lang"),
    )


@query("C04_normalised_fields", f"WITH {NOTICES_SQL}, c AS (SELECT id, replace(title, chr(10), ' ') AS title, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM notices) SELECT id, title, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '...' ELSE t END AS summary, CASE WHEN contains(t, 'icensed') THEN 'legal' ELSE 'other' END AS category FROM c")
def normalised_fields(spark, d):
    return notices(spark, d).select("id", F.replace("title", F.lit("\n"), F.lit(" ")).alias("title"), text.summary(F.col("content")).alias("summary"), F.when(F.contains("content", F.lit("icensed")), "legal").otherwise("other").alias("category"))


@query("C05_export_projection", f"WITH {NOTICES_SQL} SELECT id, 'notice/' || id AS url, CASE source WHEN 'src0' THEN 'Main office' WHEN 'src1' THEN 'Archive' WHEN 'src2' THEN 'Library' ELSE source END AS source_department, CAST(publish_date AS VARCHAR) AS sign_up_deadline, '[]' AS tags FROM notices")
def export_projection(spark, d):
    names = F.create_map(*[F.lit(x) for kv in SOURCE_NAMES.items() for x in kv])
    return notices(spark, d).select("id", F.concat(F.lit("notice/"), "id").alias("url"), F.coalesce(F.try_element_at(names, F.col("source")), "source").alias("source_department"), F.col("publish_date").cast("string").alias("sign_up_deadline"), F.lit("[]").alias("tags"))


@query("C10_candidates", "SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN user_id % 7 = 0 THEN 0.0 ELSE value END AS score FROM events WHERE event_type <> 'error'")
def candidates(spark, d):
    """Rows without an id go; a score that is no number is 0."""
    ev = table(spark, d, "events").withColumn("id", F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_id").cast("string")))
    said = F.when(F.col("user_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return ev.where(F.trim("id") != "").select("event_id", "id", F.coalesce(F.expr("try_cast(1 as double)") * said.try_cast("double"), F.lit(0.0)).alias("score"))


@query("C12_calendar_event", f"WITH {NOTICES_SQL} SELECT id, 'deadline: ' || CASE WHEN length(title) > 12 THEN substr(title, 1, 12) || '…' ELSE title END AS label, CASE WHEN date_diff('day', DATE '{AS_OF}', publish_date) < 0 THEN 'expired' WHEN date_diff('day', DATE '{AS_OF}', publish_date) <= 7 THEN 'urgent' WHEN date_diff('day', DATE '{AS_OF}', publish_date) <= 14 THEN 'soon' ELSE 'normal' END AS class FROM notices")
def calendar_event(spark, d):
    short = F.when(F.length("title") > 12, F.concat(F.substring("title", 1, 12), F.lit("…"))).otherwise(F.col("title"))
    return notices(spark, d).select("id", F.concat(F.lit("deadline: "), short).alias("label"), dates.days_left_class(dates.days_left(F.col("publish_date"), AS_OF)).alias("class"))


@query("C13_prompt_rows", "SELECT p_brand, count(*) AS n, sum(length('{\"id\":' || p_partkey || ',\"title\":\"' || p_name || '\"}'))::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 12 GROUP BY p_brand")
def prompt_rows(spark, d):
    """Compact JSON of at most a dozen candidates per prompt."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    one = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))
    few = table(spark, d, "part").withColumn("rn", rn).where("rn <= 12").select("p_brand", one.alias("one"))
    return few.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.length("one")).alias("chars"))


@query("C15_score_reasons", "SELECT p_partkey, concat_ws('；', CASE WHEN p_size >= 40 THEN 'large' END, CASE WHEN p_retailprice >= 1200 THEN 'dear' END, CASE WHEN contains(p_type, 'BRASS') THEN 'brass' END) AS reasons FROM part")
def score_reasons(spark, d):
    return table(spark, d, "part").select("p_partkey", F.concat_ws("；", F.when(F.col("p_size") >= 40, "large"), F.when(F.col("p_retailprice") >= 1200, "dear"), F.when(F.contains("p_type", F.lit("BRASS")), "brass")).alias("reasons"))


@query("C19_escaped_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS t FROM pages")
def escaped_html(spark, d):
    return table(spark, d, "pages").select("page_id", text.escaped_html(F.col("html")).alias("t"))


@query("C20_stars", "SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 5 WHEN p_size * 2 >= 75 THEN 4 ELSE 3 END AS stars FROM part")
def stars(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") * 2 >= 90, 5).when(F.col("p_size") * 2 >= 75, 4).otherwise(3).alias("stars"))


#: Pattern and phrase, the first that fits (C21): rows of a rule table.
REASONS = [("(?i)licen[cs]ed|Released", "names a licence"), ("@", "has an address"), (r"\|", "holds a table")]


@query("C21_reason_text", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)licen[cs]ed|Released') THEN 'names a licence' WHEN contains(text, '@') THEN 'has an address' WHEN contains(text, '|') THEN 'holds a table' ELSE 'plain' END AS reason FROM documents")
def reason_text(spark, d):
    reason = F.lit("plain")
    for pattern, phrase in reversed(REASONS):
        reason = F.when(F.col("text").rlike(pattern), phrase).otherwise(reason)
    return table(spark, d, "documents").select("doc_id", reason.alias("reason"))
