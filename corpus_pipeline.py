"""A training corpus in five stages, each written as Parquet and read again by the next one."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticewright.llm import line_dedup, mixing, near_dedup, packing, toxicity
from noticewright.llm.common import ARROW_BYTES, BATCH_BYTES, WORD, columns, free_name, new_path, table, written

def small_batches(stage):
    """The stage with Arrow batches of ``BATCH_BYTES``. Its result is computed when it is written, so
    the setting stays in the session."""

    @functools.wraps(stage)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def toxic_out(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.7 or more go. The classifier learns from the labelled
    documents of the corpus that aren't held out.

    A null or empty text has the score of the bias alone; a row without an id is judged like others,
    and repeated rows are judged each. Without labels nothing goes. An empty table stays empty.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    out = free_name(docs, "_score")
    return toxicity.score(docs, model, out=out).where(F.col(out) < toxicity.THRESHOLD).select(*columns(docs))


@small_batches
def lines_out(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; so does a document that had words and has none left.

    A null or empty text stays as it is, and so does a row without an id. Of rows that share an id
    each loses its own lines only; repeated rows (id and text) lose the same ones. Ties (equal lines)
    go to the smaller id, then the smaller line number. An empty table stays empty.
    """
    lines, removed, left = (free_name(docs, n) for n in ("_lines", "_removed", "_left"))
    marked = line_dedup.line_dedup(docs, lines_col=lines, removed_col=removed)
    marked = marked.withColumn(left, line_dedup.remaining_text(removed_col=removed))
    kept = marked.where((F.size(removed) == 0) | F.col(left).rlike(WORD))
    return kept.withColumn("text", F.col(left)).withColumn("n_chars", F.length("text").cast("long")).select(*columns(docs))


@small_batches
def near_out(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id.

    Texts without words and rows without an id stay. Rows that share an id are told apart by their
    texts; of repeated rows (id and text) with words one stays. An empty table stays empty.
    """
    found = written(near_dedup.near_dedup(docs).where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "pipeline-near")
    gone, many = found.where(~F.col("stays")).select("doc_id", "text_hash"), found.where("stays and n > 1").select("doc_id", "text_hash")
    names = {c: free_name(docs, f"_near_{c}") for c in gone.columns}
    same = lambda df: (F.col("doc_id").cast("long") == df[names["doc_id"]]) & (F.hash("text").cast("long") == df[names["text_hash"]])
    sided = lambda df: F.broadcast(df.withColumnsRenamed(names)) if df.count() <= near_dedup.BROADCAST_IDS else df.withColumnsRenamed(names)
    left = docs.join(g := sided(gone), same(g), "left_anti")
    if many.isEmpty():
        return left.select(*columns(docs))
    m = sided(many)
    once = left.join(m, same(m), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(m, same(m), "left_anti").select(*columns(docs)).unionByName(once.select(*columns(docs)))


@small_batches
def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: never, once or twice.

    A null text has size 0 and is taken by the whole part of its source's rate; a null source is one
    of its own. Repeated rows and rows without an id are rounded each. An empty table stays empty.
    """
    return mixing.mix(docs)


@small_batches
def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens.

    A null or empty text is the end token alone; long texts are cut, none is shortened. Repeated rows
    and rows without an id are packed each. An empty table gives no piece.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line dedup", lines_out),
    ("near dedup", near_out),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The fitted classifier, the forest and the packing can't be written as SQL.
ORACLE_SQL = None
