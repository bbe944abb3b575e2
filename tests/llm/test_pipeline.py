"""The stages of the pipeline send whole texts to Python in batches bounded by bytes."""

import corpus_pipeline
from pyspark.sql import functions as F

from noticewright.llm.common import ARROW_BYTES, BATCH_BYTES


def test_batches_are_bounded_by_bytes(spark):
    key = ARROW_BYTES
    before = spark.conf.get(key)
    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 20000)").alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    try:
        stage = corpus_pipeline.small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "bytes long, rows long"))
        got = stage(spark, docs, "").collect()
    finally:
        spark.conf.set(key, before)
    assert sum(r["rows"] for r in got) == 400 and max(r["bytes"] for r in got) <= BATCH_BYTES + 200_000
    assert all(hasattr(f, "__wrapped__") for _, f in corpus_pipeline.STAGES)
