"""The driver's tables as the relations of a notice catalogue, in Spark and as SQL.

``notices``: documents with a title (the first 60 characters), a spider (the language) and a
publish date (spread over a year by id). ``actions``: events as an activity log on items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTICES_SQL = """notices AS (
  SELECT doc_id AS id, replace(substr(text, 1, 60), chr(10), ' ') AS title, text AS content, source, lang AS spider,
         DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS publish_date, n_chars
  FROM documents
)"""

ACTIONS_SQL = """actions AS (
  SELECT event_id, user_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item,
         CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'favorite' WHEN 'click' THEN 'useful' ELSE 'other' END AS action
  FROM events
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.replace(F.substring("text", 1, 60), F.lit("\n"), F.lit(" ")).alias("title"),
        F.col("text").alias("content"),
        "source",
        F.col("lang").alias("spider"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")).alias("publish_date"),
        "n_chars",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view"), "view").when(F.col("event_type") == "purchase", "favorite").when(F.col("event_type") == "click", "useful").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("item"), kind.alias("action"))
