"""Filters and predicates over notices (survey section D)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.views import NOTICES_SQL, notices, table
from ..registry import query


def ilike_all(**wanted: str | None) -> Column:
    """Every given column holds its value somewhere, letter case aside; blank values ask nothing and
    ``%`` and ``_`` are wildcards (D7)."""
    return reduce(lambda a, b: a & b, [F.col(c).ilike(f"%{v}%") for c, v in wanted.items() if v], F.lit(True))


def field_keyword(df: DataFrame, test: str) -> DataFrame:
    """``field:keyword``; no row passes if there is no such column."""
    field, _, keyword = test.partition(":")
    return df.where(F.col(field).cast("string").contains(keyword)) if field in df.columns else df.limit(0)


def keyword_search(df: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Case-insensitive, over the columns joined by spaces."""
    return df.where(F.lower(F.concat_ws(" ", *columns)).contains(words.lower()))


def relaxed_cascade(df: DataFrame, tiers: list[Column], least: int = 3) -> DataFrame:
    """Rows of the strictest tier with ``least`` rows; ``tiers`` go from strict to loose, and all
    rows pass if none has that many (D23, D25). One aggregate of one row decides, no collect."""
    counts = df.agg(*[F.count_if(t).alias(f"_n{i}") for i, t in enumerate(tiers)])
    pick = reduce(lambda rest, i: F.when(F.col(f"_n{i}") >= least, i).otherwise(rest), reversed(range(len(tiers))), F.lit(len(tiers)))
    passes = reduce(lambda rest, i: F.when(F.col("_tier") == i, tiers[i]).otherwise(rest), range(len(tiers)), F.lit(True))
    return df.join(F.broadcast(counts.select(pick.alias("_tier"))), F.lit(True)).where(passes)


@query("D01_date_window", f"WITH {NOTICES_SQL} SELECT id, publish_date FROM notices WHERE publish_date BETWEEN DATE '2024-03-01' AND DATE '2024-05-31'")
def date_window(spark, d):
    return notices(spark, d).where(F.col("publish_date").between("2024-03-01", "2024-05-31")).select("id", "publish_date")


@query("D02_after_watermark", f"WITH {NOTICES_SQL} SELECT id, spider FROM notices WHERE publish_date > DATE '2024-06-30' AND publish_date <= DATE '2024-12-31'")
def after_watermark(spark, d):
    return notices(spark, d).where((F.col("publish_date") > "2024-06-30") & (F.col("publish_date") <= "2024-12-31")).select("id", "spider")


@query("D03_page_stop_rule", "SELECT o_custkey, count(*) AS items, bool_and(o_orderdate < TIMESTAMP '1996-01-01') AS all_old FROM orders GROUP BY o_custkey")
def page_stop_rule(spark, d):
    """A list page (here the orders of a customer) ends the crawl if all its items are too old."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("items"), F.bool_and(F.col("o_orderdate") < "1996-01-01").alias("all_old"))


@query(
    "D06_pending_review",
    """SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'passed' ELSE 'rejected' END AS status
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality = 0""",
)
def pending_review(spark, d):
    """Rows not decided or decided against."""
    status = F.when(F.col("quality").isNull(), "pending").when(F.col("quality") == 1, "passed").otherwise("rejected")
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", status.alias("status")).where(F.col("status") != "passed")


@query("D07_ilike_all", f"WITH {NOTICES_SQL} SELECT id, title FROM notices WHERE title ILIKE '%the%' AND source ILIKE '%src1%' ORDER BY publish_date DESC")
def ilike_query(spark, d):
    return notices(spark, d).where(ilike_all(title="the", source="src1", spider=None)).orderBy(F.desc("publish_date")).select("id", "title")


@query("D08_field_keyword", f"WITH {NOTICES_SQL} SELECT id, source FROM notices WHERE contains(source, 'c7')")
def field_keyword_query(spark, d):
    return field_keyword(notices(spark, d), "source:c7").select("id", "source")


@query("D09_same_day", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10'")
def same_day(spark, d):
    """A half-open range on the column itself, which reaches the scan, not a cast of it."""
    return table(spark, d, "events").where((F.col("ts") >= "2024-01-10") & (F.col("ts") < "2024-01-11")).select("event_id")


@query("D10_url_exists", "SELECT p.page_id FROM pages p WHERE EXISTS (SELECT 1 FROM pages q WHERE q.url = p.url AND q.page_id < p.page_id)")
def url_exists(spark, d):
    """Pages whose url was seen on an earlier page (D10): the first id per url, then a semi join."""
    pages = table(spark, d, "pages").select("page_id", "url")
    first = pages.groupBy("url").agg(F.min("page_id").alias("first"))
    return pages.join(first, "url").where("page_id > first").select("page_id")


@query("D11_has_any_row", "SELECT count(*) > 0 AS any_row FROM events WHERE event_type = 'purchase'")
def has_any_row(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").limit(1).agg((F.count("*") > 0).alias("any_row"))


@query("D14_keyword_search", f"WITH {NOTICES_SQL} SELECT id, source FROM notices WHERE contains(lower(concat_ws(' ', title, content, source)), 'license') AND spider = 'en'")
def keyword_search_query(spark, d):
    return keyword_search(notices(spark, d), "License", ["title", "content", "source"]).where("spider = 'en'").select("id", "source")


@query("D15_keyword_any_field", f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE contains(title, 'The') OR contains(substr(content, 1, 160), 'with') OR list_contains(string_split(title, ' '), 'and')")
def keyword_any_field(spark, d):
    """Case-sensitive, in the title, the summary or one of the keywords."""
    words = F.split("title", " ")
    return notices(spark, d).where(F.contains("title", F.lit("The")) | F.contains(F.substring("content", 1, 160), F.lit("with")) | F.exists(words, lambda w: w == "and")).select("id")


@query("D16_browse_filters", f"WITH {NOTICES_SQL} SELECT id FROM notices WHERE source = 'src3' AND publish_date >= DATE '2024-12-31' - 90 AND strftime(publish_date, '%Y-%m') = '2024-11'")
def browse_filters(spark, d):
    """Source, age and month of a browse page."""
    return notices(spark, d).where((F.col("source") == "src3") & (F.col("publish_date") >= F.date_sub(F.lit("2024-12-31").cast("date"), 90)) & (F.date_format("publish_date", "yyyy-MM") == "2024-11")).select("id")


@query("D21_upcoming", f"WITH {NOTICES_SQL} SELECT id, date_diff('day', DATE '2024-06-01', publish_date) AS days_left FROM notices WHERE date_diff('day', DATE '2024-06-01', publish_date) BETWEEN 0 AND 3")
def upcoming(spark, d):
    return notices(spark, d).withColumn("days_left", F.datediff("publish_date", F.lit("2024-06-01")).cast("long")).where("days_left between 0 and 3").select("id", "days_left")


@query("D22_valid_rows", "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND trim(text) <> '' AND trim(text) IS NOT NULL")
def valid_rows(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isNotNull() & (F.trim("text") != "")).select("doc_id")


@query(
    "D23_recency_with_guard",
    f"""WITH {NOTICES_SQL}, c AS (SELECT count(*) FILTER (WHERE publish_date >= DATE '2024-12-25') AS n FROM notices WHERE spider = 'es')
        SELECT id FROM notices, c WHERE spider = 'es' AND (c.n < 3 OR publish_date >= DATE '2024-12-25')""",
)
def recency_with_guard(spark, d):
    """The filter is taken back when it leaves fewer than three rows."""
    return relaxed_cascade(notices(spark, d).where("spider = 'es'"), [F.col("publish_date") >= "2024-12-25"]).select("id")


@query(
    "D25_relaxed_cascade",
    f"""WITH {NOTICES_SQL}, n AS (SELECT *, source = 'src2' AS c, contains(content, 'zzz') AS k, publish_date >= DATE '2024-09-01' AS r FROM notices),
        t AS (SELECT count(*) FILTER (WHERE c AND k AND r) AS t0, count(*) FILTER (WHERE c AND r) AS t1, count(*) FILTER (WHERE c) AS t2 FROM n)
        SELECT id FROM n, t WHERE CASE WHEN t0 >= 3 THEN c AND k AND r WHEN t1 >= 3 THEN c AND r WHEN t2 >= 3 THEN c ELSE true END""",
)
def cascade_query(spark, d):
    c, k, r = F.col("source") == "src2", F.contains("content", F.lit("zzz")), F.col("publish_date") >= "2024-09-01"
    return relaxed_cascade(notices(spark, d), [c & k & r, c & r, c]).select("id")


@query("D24_veto_words", f"WITH {NOTICES_SQL} SELECT id, regexp_matches(content, 'reserved|Licensed|Released') AS administrative FROM notices")
def veto_words(spark, d):
    from ..functions.text import contains_any

    return notices(spark, d).select("id", contains_any(F.col("content"), ["reserved", "Licensed", "Released"]).alias("administrative"))


@query("D26_same_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages WHERE regexp_matches(url, '^[a-z]+://([^/?#]*\\.)?example\\.com([/?#]|$)')")
def same_host(spark, d):
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    return table(spark, d, "pages").withColumn("host", host).where((F.col("host") == "example.com") | F.endswith("host", F.lit(".example.com"))).select("page_id", "host")


@query("D27_document_links", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) SELECT page_id, href FROM l WHERE regexp_matches(href, '(?i)\\.(pdf|docx?|xlsx?|zip|rar)($|[?#])') OR href LIKE '%.'")
def document_links(spark, d):
    """Links to documents by extension; here also those that end in a dot, which the tables have."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.where(F.col("href").rlike(r"(?i)\.(pdf|docx?|xlsx?|zip|rar)($|[?#])") | F.endswith("href", F.lit(".")))


@query("D28_meaningful", "SELECT doc_id FROM documents WHERE lower(trim(text)) NOT IN ('', '-', 'none', 'null', 'n/a', 'nan', 'unknown')")
def meaningful(spark, d):
    return table(spark, d, "documents").where(~F.lower(F.trim("text")).isin("", "-", "none", "null", "n/a", "nan", "unknown")).select("doc_id")


@query("D30_url_like", "SELECT page_id FROM pages WHERE url LIKE '%.example.net/%/9%'")
def url_like(spark, d):
    return table(spark, d, "pages").where(F.col("url").like("%.example.net/%/9%")).select("page_id")


@query("D31_unread_count", "SELECT user_id, count(*) FILTER (WHERE event_type <> 'view') AS unread FROM events GROUP BY user_id")
def unread_count(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") != "view").alias("unread"))


@query("D32_optional_filters", "SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id BETWEEN 10 AND 700")
def optional_filters(spark, d, spider="de", lowest=10, highest=700):
    """Each filter is added only if asked for."""
    df = table(spark, d, "documents")
    for value, test in ((spider, F.col("lang") == spider), (lowest, F.col("doc_id") >= lowest), (highest, F.col("doc_id") <= highest)):
        df = df if value is None else df.where(test)
    return df.select("doc_id")


@query("D33_point_lookup", "SELECT page_id, length(html) AS n_chars FROM pages WHERE url = (SELECT min(url) FROM pages) ORDER BY page_id LIMIT 1")
def point_lookup(spark, d):
    pages = table(spark, d, "pages")
    return pages.join(F.broadcast(pages.agg(F.min("url").alias("url"))), "url").orderBy("page_id").limit(1).select("page_id", F.length("html").cast("long").alias("n_chars"))


@query("D34_is_favorite", "SELECT doc_id, CAST(doc_id AS VARCHAR) IN (SELECT regexp_extract(props, '([0-9]+)', 1) FROM events WHERE event_type = 'purchase') AS favorite FROM documents")
def is_favorite(spark, d):
    """Ids are compared as text."""
    marked = table(spark, d, "events").where("event_type = 'purchase'").select(F.get_json_object("props", "$.k").alias("k")).distinct().withColumn("favorite", F.lit(True))
    return table(spark, d, "documents").join(marked, F.col("doc_id").cast("string") == F.col("k"), "left").select("doc_id", F.coalesce("favorite", F.lit(False)).alias("favorite"))
