"""Toxicity: a linear classifier over character n-grams, naive Bayes scaled.

The features of a text are the hashed n-grams that it holds (each counts once). A feature's value
is its log-count ratio: the log of how much likelier it is in texts of label 1 than of label 0,
counted over all labelled rows that may be learned from. A logistic regression over the scaled
features gives the score. Scoring reads whole texts, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table, written

#: n-gram lengths, in characters, and the hashed feature space.
GRAMS = (3, 4, 5, 6)
SPACE_BITS = 20
#: Features kept, by the size of their log-count ratio; fewest texts that a feature is in.
FEATURES, LEAST_TEXTS = 1 << 14, 5
#: Bound of the sample that the regression is fitted on, for each label; counts cover all rows.
SAMPLE_PER_LABEL = 10_000
THRESHOLD = 0.7
#: Labels (some 20 bytes each) that may be broadcast to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def hashed(text: str | None, wanted: np.ndarray | None = None, grams=GRAMS, bits: int = SPACE_BITS) -> np.ndarray:
    """The distinct hashed n-grams of a whole text, only the ``wanted`` ones if a mask is given.
    Lower case; white space is one space, also at both ends, so that word starts and ends are
    n-grams of their own."""
    plain = f" {' '.join((text or '').lower().split())} "
    x = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    parts, h = [], np.zeros(len(x), dtype=np.uint64)
    for n in range(1, max(grams) + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] + x[n - 1 :]) * _MIX
        h ^= h >> np.uint64(29)
        if n in grams:
            at = ((h * _TURN) >> np.uint64(64 - bits)).astype(np.int64)
            parts.append(at if wanted is None else at[wanted[at]])
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)


def _texts(frames: Iterator[pd.DataFrame]):
    for f in frames:
        yield f, [None if t is None or t is pd.NA else t for t in f["text"]]


def log_count_ratios(labelled: DataFrame, features: int = FEATURES, least: int = LEAST_TEXTS) -> pd.DataFrame:
    """feature, ratio: the ``features`` largest ratios. ``labelled``: text, label (0 or 1).

    Each task counts the n-grams of several splits (a row per feature and task is shuffled, so fewer
    tasks shuffle less), the counts are summed by feature, and the bounded table of features is all
    that reaches the driver.
    """
    spark = labelled.sparkSession
    totals = {int(r["label"]): r["count"] for r in labelled.groupBy("label").count().collect()}

    def count(frames):
        seen = np.zeros((2, 1 << SPACE_BITS), dtype=np.int32)
        for f, texts in _texts(frames):
            for text, label in zip(texts, f["label"], strict=True):
                seen[int(label), hashed(text)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        for lo in range(0, len(at), 50_000):
            i = at[lo : lo + 50_000]
            yield pd.DataFrame({"feature": i, "no": seen[0, i], "yes": seen[1, i]})

    n0, n1 = totals.get(0, 0) + 2.0, totals.get(1, 0) + 2.0
    ratio = F.log((F.col("yes") + 1) / F.lit(n1)) - F.log((F.col("no") + 1) / F.lit(n0))
    return (
        labelled.select("text", "label").coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
        .mapInPandas(count, "feature long, no long, yes long")
        .groupBy("feature").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        .where(F.col("yes") + F.col("no") >= least)
        .withColumn("ratio", ratio)
        .orderBy(F.desc(F.abs("ratio")), "feature").limit(features)
        .select("feature", "ratio").toPandas()
    )


def _design(texts, index: np.ndarray):
    """Per text the positions of its kept features."""
    wanted = index >= 0
    for text in texts:
        yield index[hashed(text, wanted)].astype(np.int32)


def fit(labelled: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL, rounds: int = 300, penalty: float = 1e-3) -> dict[str, np.ndarray]:
    """{weight: by hashed n-gram, bias}. ``labelled``: key, text, label.

    Without rows of both labels every score is that of the known share (0.5 if there is none).
    The regression sees at most ``sample_per_label`` rows of each label (the smallest hashes of
    their keys); each label counts as much as the other.
    """
    empty = {"weight": np.zeros(1 << SPACE_BITS), "bias": 0.0}
    kept = log_count_ratios(labelled)
    if kept.empty:
        return empty
    index = np.full(1 << SPACE_BITS, -1, dtype=np.int64)
    index[kept["feature"]] = np.arange(len(kept))

    def features(frames):
        for f, texts in _texts(frames):
            yield pd.DataFrame({"label": f["label"], "at": [x.tolist() for x in _design(texts, index)]})

    keys = labelled.select("key", "label").distinct()
    order = [F.xxhash64("key"), F.col("key")]
    sample = keys.where("label = 0").orderBy(*order).limit(sample_per_label).unionByName(keys.where("label = 1").orderBy(*order).limit(sample_per_label))
    # At most 2 x sample_per_label short rows.
    rows = labelled.join(F.broadcast(sample), ["key", "label"], "left_semi").select("text", "label").mapInPandas(features, "label int, at array<int>").toPandas()
    y = rows["label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return empty
    size = np.array([len(a) for a in rows["at"]])
    row, col = np.repeat(np.arange(len(rows)), size), np.concatenate([np.asarray(a, dtype=np.int64) for a in rows["at"]])
    value = kept["ratio"].to_numpy()[col]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, b = np.zeros(len(kept)), 0.0
    # Accelerated gradient descent on the mean logistic loss; the step follows the data's curvature.
    norm = np.bincount(row, weights=value**2, minlength=len(rows))
    step = 1.0 / (0.25 * float((share * (norm + 1)).sum()) + penalty)
    w0, b0 = w, b
    for k in range(rounds):
        go = k / (k + 3)
        v, c = w + go * (w - w0), b + go * (b - b0)
        w0, b0 = w, b
        z = np.bincount(row, weights=value * v[col], minlength=len(rows)) + c
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        w = v - step * (np.bincount(col, weights=g[row] * value, minlength=len(w)) + penalty * v)
        b = c - step * g.sum()
    weight = np.zeros(1 << SPACE_BITS)
    weight[kept["feature"]] = w * kept["ratio"].to_numpy()
    return {"weight": weight, "bias": float(b)}


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", out: str = "score") -> DataFrame:
    """Add ``out`` (0 to 1; with underscores behind it if the name is taken) to ``docs``.

    A null text is an empty one and gets the bias alone. Whole texts count, whatever their length;
    rows are independent, so repeated rows get equal scores, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weight, bias = shared.value["weight"], shared.value["bias"]
        wanted = weight != 0
        for texts in batches:
            z = np.array([weight[hashed(None if t is None or t is pd.NA else t, wanted)].sum() + bias for t in texts])
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -700, 700))))

    return docs.withColumn(free_name(docs, out), scored(F.col(text_col)))


def held_out(doc_id: Column) -> Column:
    """Rows that the contract keeps from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **how) -> dict:
    """Fit on the rows of ``docs`` that have a 0/1 label and aren't held out.

    A document that is labelled twice counts once per label; null labels and ids don't join. Of
    repeated rows each counts. Without rows of both labels, empty tables included, all scores are 0.5.
    Further columns are no matter.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    known = written(known.where(~held_out(F.col("_id"))), "toxic-labels")
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    few = known.count() <= BROADCAST_LABELS
    return fit(rows.join(F.broadcast(known) if few else known, F.col("key") == F.col("_id")).select("key", "text", "label"), **how)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
