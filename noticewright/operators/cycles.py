"""Whole cycles: a crawl's batch, merge with counts, decorated answers, policies with a guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.dates import parsed_date
from ..plans.views import NOTICES_SQL, notices, table
from ..registry import query
from .joins import first_per, insert_or_ignore


def crawl_batch(found: DataFrame, stored: DataFrame, mark: str | None, start: str, end: str) -> DataFrame:
    """Rows of one crawl to store: inside the window, later than the mark if there is one, the first
    of each url, not stored yet (A6, D2 to D5, E1)."""
    inside = found.where(F.col("publish_date").between(start, end))
    return insert_or_ignore(inside.where(F.col("publish_date") > mark) if mark else inside, stored, "url", ["id"])


def lenient_object(t: Column, schema: str) -> Column:
    """The JSON object inside model text, null if there is none that parses."""
    return F.from_json(F.nullif(F.regexp_extract(t, r"(?s)\{.*\}", 0), F.lit("")), schema)


def loose_ids(t: Column, most: int = 6) -> Column:
    """The first numbers of a text, when it isn't JSON at all."""
    return F.transform(F.slice(F.regexp_extract_all(t, F.lit(r"\d+"), F.lit(0)), 1, most), lambda x: x.try_cast("bigint"))


def year_policy(df: DataFrame, key: str, good: Column, least: int = 3) -> DataFrame:
    """Rows of the wanted year only where a group has ``least`` of them, else all its rows."""
    enough = F.count_if(good).over(Window.partitionBy(key)) >= least
    return df.withColumn("_ok", ~enough | good).where("_ok").drop("_ok")


@query(
    "A06_crawl_batch",
    f"""WITH {NOTICES_SQL}, f AS (SELECT id, sha256(content) AS url, publish_date FROM notices WHERE id % 3 <> 0), w AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM f WHERE publish_date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30' AND publish_date > DATE '2024-03-31')
        SELECT id FROM w WHERE rn = 1 AND url NOT IN (SELECT sha256(content) FROM notices WHERE id % 3 = 0)""",
)
def crawl_batch_query(spark, d):
    n = notices(spark, d).select("id", F.sha2("content", 256).alias("url"), "publish_date")
    return crawl_batch(n.where("id % 3 <> 0"), n.where("id % 3 = 0"), "2024-03-31", "2024-02-01", "2024-11-30").select("id")


@query("D04_bad_dates_go", "SELECT doc_id FROM documents WHERE TRY_CAST((2024 + doc_id % 2) || '-' || (doc_id % 14) || '-' || (doc_id % 33) AS DATE) BETWEEN DATE '2024-02-01' AND DATE '2025-06-30'")
def bad_dates_go(spark, d):
    """Rows without a date, with one that doesn't exist or out of the window go."""
    day = parsed_date(F.concat_ws("-", 2024 + F.col("doc_id") % 2, F.col("doc_id") % 14, F.col("doc_id") % 33))
    return table(spark, d, "documents").where(day.between("2024-02-01", "2025-06-30")).select("doc_id")


@query("C02_mapped_columns", "SELECT doc_id AS id, source AS publisher, 'documents' AS spider FROM documents")
def mapped_columns(spark, d):
    """Columns renamed, the spider taken from the file's path."""
    spider = F.regexp_extract("_metadata.file_path", r"([A-Za-z_]+)\.parquet", 1)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("publisher"), spider.alias("spider"))


@query("C16_decorated", "WITH m AS (SELECT doc_id, list_sort(list(DISTINCT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END)) AS matched FROM labels GROUP BY doc_id) SELECT d.doc_id, coalesce(m.matched, []) AS matched FROM documents d LEFT JOIN m USING (doc_id)")
def decorated(spark, d):
    """Match metadata joined to the rows of an answer, empty where there is none."""
    m = table(spark, d, "labels").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))).alias("matched"))
    return table(spark, d, "documents").select("doc_id").join(m, "doc_id", "left").select("doc_id", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"))


@query("F19_observed_counts", "SELECT count(*) AS rows_in, count(*) FILTER (WHERE quality = 1) AS rows_out FROM labels")
def observed_counts(spark, d):
    """Counters that a job fills while it runs, without a pass of their own."""
    seen = Observation("filter")
    watched = table(spark, d, "labels").observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("quality") == 1).alias("rows_out"))
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows_in"], seen.get["rows_out"])], "rows_in long, rows_out long")


@query("F21_upcoming_favorites", f"WITH {NOTICES_SQL} SELECT source, count(*) FILTER (WHERE date_diff('day', DATE '2024-06-01', publish_date) BETWEEN 0 AND 30) AS upcoming FROM notices GROUP BY source")
def upcoming_favorites(spark, d):
    days = F.datediff("publish_date", F.lit("2024-06-01").cast("date"))
    return notices(spark, d).groupBy("source").agg(F.count_if(days.between(0, 30)).alias("upcoming"))


@query("G11_year_policy", "WITH n AS (SELECT o_custkey, o_orderkey, year(o_orderdate) = 1997 AS good, count(*) FILTER (WHERE year(o_orderdate) = 1997) OVER (PARTITION BY o_custkey) AS k FROM orders) SELECT o_orderkey FROM n WHERE k < 3 OR good")
def year_policy_query(spark, d):
    return year_policy(table(spark, d, "orders"), "o_custkey", F.year("o_orderdate") == 1997).select("o_orderkey")


@query("H03_first_ids", "SELECT doc_id FROM documents WHERE lang <> 'en' ORDER BY doc_id LIMIT 75")
def first_ids(spark, d):
    return table(spark, d, "documents").where("lang <> 'en'").orderBy("doc_id").limit(75).select("doc_id")


@query("J42_lenient_object", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN conv_id END AS id, CASE WHEN turn % 3 = 1 THEN [turn, conv_id] ELSE CASE WHEN turn % 3 = 0 THEN [conv_id] ELSE [] END END AS loose FROM conversations")
def lenient_object_query(spark, d):
    said = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('Sure:\n```json\n{"id": '), "conv_id", F.lit("}\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("rank "), "turn", F.lit(" then "), "conv_id")).otherwise(F.lit("no idea {"))
    return table(spark, d, "conversations").select("conv_id", "turn", lenient_object(said, "id bigint")["id"].alias("id"), loose_ids(said).alias("loose"))


@query("L09_level_and_name", "SELECT p_partkey, nullif(regexp_extract(p_type, '(BRASS|STEEL|COPPER|NICKEL|TIN)', 1), '') AS name, CASE regexp_extract(p_type, '(BRASS|STEEL|COPPER|NICKEL|TIN)', 1) WHEN 'BRASS' THEN 'A+' WHEN 'STEEL' THEN 'A' WHEN 'COPPER' THEN 'B' WHEN 'NICKEL' THEN 'C' ELSE NULL END AS level FROM part")
def level_and_name(spark, d):
    """Name and level by one pattern over a small dictionary, longest names first."""
    from .joins import alternation

    name = F.nullif(F.regexp_extract("p_type", f"({alternation(['BRASS', 'STEEL', 'COPPER', 'NICKEL', 'TIN'])})", 1), F.lit(""))
    levels = F.create_map(*map(F.lit, ("BRASS", "A+", "STEEL", "A", "COPPER", "B", "NICKEL", "C")))
    return table(spark, d, "part").select("p_partkey", name.alias("name"), F.try_element_at(levels, name).alias("level"))


@query("B27_profile_rows", "SELECT user_id, max(value) AS value, min(event_type) AS setting FROM events GROUP BY user_id")
def profile_rows(spark, d):
    """A user's settings as one row, the first per key after an overwrite."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("value"), F.min("event_type").alias("setting"))
    return first_per(rows, ["user_id"], ["value"])
