"""Exact duplicates by skew-safe combining.

Equal rows are first combined inside each input split, then inside (digest, salt) groups, and the
winners of the salts last. Each of the three stages groups by the digest *and* the text, so two
texts that shared a digest would stay apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_spaced, table, written

#: Of n rows, at most this many digests can each have more than n / HOT_DIGESTS rows.
HOT_DIGESTS = 10_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_salt: int = 1024) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    A null text is an empty one. Of rows with equal texts the smallest id is kept (a null id sorts
    last); of repeated rows with that same id one is kept. An empty table gives an empty result,
    and further columns of ``docs`` are ignored, whatever their names.

    A digest with more than max(rows_per_salt, rows / 10,000) rows is hot. There are at most 10,000
    such digests at any size, so the table of their salt counts may be broadcast. A salted group
    holds about ``rows_per_salt`` rows; only the winners of hot groups move a second time.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), one_spaced(F.col(text_col)).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    limit = max(rows_per_salt, docs.count() // HOT_DIGESTS)
    hot = base.groupBy("digest").count().where(F.col("count") > limit).select("digest", F.ceil(F.col("count") / rows_per_salt).alias("salts"))

    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    parts = (
        base.join(F.broadcast(hot), "digest", "left")
        .withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), "salts")))
        .groupBy("digest", "salt", "norm")
        .agg(F.sort_array(F.collect_list(who)).alias("ids"))
        .select("digest", F.when(F.col("salt").isNotNull(), F.col("norm")).alias("norm"), "ids", F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"))
    )
    parts = written(parts, "dedup-parts")
    # Texts of hot groups only: a row for each salt, compared by content once more.
    salted = parts.where(F.col("norm").isNotNull())
    winners = salted.groupBy("digest", "norm").agg(F.min("first").alias("keep"), F.sum("n").alias("group_size"))
    combined = salted.join(winners, ["digest", "norm"]).select("digest", "ids", "first", "keep", "group_size")
    alone = parts.where(F.col("norm").isNull()).select("digest", "ids", "first", F.col("first").alias("keep"), F.col("n").alias("group_size"))
    return (
        alone.unionByName(combined)
        .select("*", F.posexplode("ids").alias("pos", "who"))
        .select(
            F.col("who.id").alias("doc_id"),
            F.col("keep.id").alias("keep_id"),
            "group_size",
            ((F.col("pos") == 0) & (F.col("first") == F.col("keep"))).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
