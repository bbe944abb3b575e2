"""Exact top-k search by inner product: columnar branch and bound.

Vectors become whole numbers, floor(scale * x). Queries are cut into blocks; each (query block,
slot) pair is one unit of work that streams its share of the candidates. Scores grow one block of
dimensions at a time over a vertical (dimension-major) layout. What the dimensions still missing
can add is at most the product of the two remaining norms; candidates whose bound lies under the
query's k-th best score are compacted away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

QUERY_BLOCK = 16_384
DIMS = 16
#: Queries whose partial scores are held at once; memory is this times an Arrow batch's rows.
TOGETHER = 128
#: Below this share of live (query, candidate) pairs, pairs are scored singly.
SPARSE = 0.05
EXACT = float(1 << 53)

OUT = "query_id long, query_key long, vec_id long, score long"


class _Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, ids, keys, vecs, k):
        self.ids, self.keys, self.q, self.k = ids, keys, vecs, k
        # 64 bits of precision: whole numbers of 64 bits are exact.
        self.score = np.full((len(ids), k), -np.inf, dtype=np.longdouble)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def floor(self):
        return self.score[:, -1]

    def merge(self, row, score, vec):
        """Add scored pairs; ties go to the smaller id."""
        rows = np.unique(row)
        row = np.concatenate([row, np.repeat(rows, self.k)])
        score = np.concatenate([score.astype(np.longdouble), self.score[rows].ravel()])
        vec = np.concatenate([vec, self.vec[rows].ravel()])
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.k
        self.score[row[keep], place[keep]] = score[keep]
        self.vec[row[keep], place[keep]] = vec[keep]


def _norms(m, dims):
    """Norm of what follows each block of dimensions, a little enlarged against rounding."""
    squares = np.add.reduceat(m * m, np.arange(0, m.shape[1], dims), axis=1)
    rest = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([rest[:, 1:], np.zeros((len(m), 1))])) * (1 + 1e-9)


def _search(best, ids, vecs, dims):
    """Score one batch of candidates against every query of the block."""
    if not len(ids):
        return
    big = max(np.abs(best.q).max(), 1) * max(np.abs(vecs).max(), 1) * vecs.shape[1] >= EXACT
    if big:  # beyond what doubles hold exactly: whole numbers of any size
        whole = np.array([[int(x) for x in v] for v in vecs], dtype=object)
        for i, q in enumerate(best.q):
            score = whole @ np.array([int(x) for x in q], dtype=object)
            ok = ids != best.ids[i]
            clipped = np.array([max(-(2**63), min(2**63 - 1, s)) for s in score[ok]], dtype=np.longdouble)
            best.merge(np.full(ok.sum(), i), clipped, ids[ok])
        return
    tall, c_rest = np.ascontiguousarray(vecs.T), _norms(vecs, dims)
    for lo in range(0, len(best.ids), TOGETHER):
        rows = slice(lo, lo + TOGETHER)
        q, q_rest = best.q[rows], _norms(best.q[rows], dims)
        floor = best.floor()[rows].astype(float)
        live = np.arange(len(ids))
        score = np.zeros((len(q), len(live)))
        own = best.ids[rows][:, None] == ids[None, :]
        pairs = None
        for b, at in enumerate(range(0, vecs.shape[1], dims)):
            part = slice(at, at + dims)
            if pairs is None:
                score += q[:, part] @ tall[part][:, live]
                ok = score + np.outer(q_rest[:, b], c_rest[live, b]) >= floor[:, None] - 0.5
                if ok.mean() < SPARSE:
                    i, j = np.nonzero(ok)
                    pairs = (i, live[j], score[i, j])
                else:
                    some = ok.any(axis=0)
                    if some.mean() < 0.8:
                        live, score = live[some], score[:, some]
            else:
                i, j, s = pairs
                s = s + np.einsum("ij,ji->i", q[i, part], tall[part][:, j])
                ok = s + q_rest[i, b] * c_rest[j, b] >= floor[i] - 0.5
                pairs = (i[ok], j[ok], s[ok])
        if pairs is None:
            score[own[:, live]] = -np.inf
            if len(live) > best.k:
                floor = np.maximum(floor, np.partition(score, len(live) - best.k, axis=1)[:, -best.k])
            i, j = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
            pairs = (i, live[j], score[i, j])
        i, j, s = pairs
        ok = ~own[i, j] & (s >= floor[i])
        if ok.any():
            best.merge(i[ok] + lo, s[ok], ids[j[ok]])


def _work(k: int, scale: int, dims: int):
    def run(batches):
        """Rows come sorted by (unit of work, kind): queries first, then candidates."""
        unit, best, waiting = None, None, []

        def emit():
            if best is None:
                return
            i, j = np.nonzero(best.score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[i]), pa.array(best.keys[i]), pa.array(best.vec[i, j]), pa.array(best.score[i, j].astype(np.int64))], names=["query_id", "query_key", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("dim", "block", "slot", "kind", "id", "key")}
            change = np.flatnonzero(np.any([np.diff(cols[n]) != 0 for n in ("dim", "block", "slot", "kind")], axis=0)) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            flat = batch.column("vec")
            for a, b in zip(bounds, bounds[1:], strict=False):
                at = tuple(int(cols[n][a]) for n in ("dim", "block", "slot"))
                vecs = np.floor(scale * flat.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(b - a, at[0])
                if at != unit:
                    yield from emit()
                    unit, best, waiting = at, None, []
                if cols["kind"][a] == 0:
                    waiting.append((cols["id"][a:b], cols["key"][a:b], vecs))
                    continue
                if waiting:
                    best = _Best(*(np.concatenate(x) for x in zip(*waiting, strict=False)), k)
                    waiting = []
                if best is not None:
                    _search(best, cols["id"][a:b], vecs, dims)
        yield from emit()

    return run


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, fewer if there are fewer.

    Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows
    without an id; vectors of unequal length aren't compared. A candidate with the query's own id
    is skipped. Ties go to the smaller id; repeated candidate rows are candidates each, repeated
    query rows (same id and vector) are one query. Scores are exact; such as exceed 64 bits are
    returned as the nearest 64-bit number. Empty tables give an empty result.

    A query block of at most ``QUERY_BLOCK`` rows (by hash, so about) goes to every slot, and each
    slot sees each candidate of its share once per query block.
    """
    spark = queries.sparkSession
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull() & (F.size("vec") > 0) & fine).withColumn("dim", F.size("vec"))
    asked = vectors(queries).withColumn("key", F.xxhash64("vec")).dropDuplicates(["id", "key"])
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.select("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(0).alias("kind"), "id", "key", "vec")
    # A slot is a share of the rows, not of the values: copies of one vector spread over all slots.
    given = vectors(candidates).select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(slots)).cast("int").alias("slot"), F.lit(1).alias("kind"), "id", F.lit(0).cast("long").alias("key"), "vec")
    found = (
        asked.unionByName(given)
        .repartition(slots, "dim", "block", "slot")
        .sortWithinPartitions("dim", "block", "slot", "kind")
        .mapInArrow(_work(k, scale, dims), OUT)
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
