"""Counts of hashed character pairs, as a stage of an MLlib pipeline."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasNumFeatures, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters (texts times features) that are filled together.
TOGETHER = 1 << 18


def _utf8(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of UTF-16 code units as little-endian numbers, and how many bytes they have. Half a
    surrogate pair is a question mark, as Spark writes it."""
    u = np.where((unit >= 0xD800) & (unit < 0xE000), 63, unit).astype(np.uint64)
    low = lambda x: (x & np.uint64(63)) | np.uint64(128)
    s = [np.uint64(n) for n in (6, 8, 12, 16)]
    two = (u >> s[0] | np.uint64(192)) | low(u) << s[1]
    three = (u >> s[2] | np.uint64(224)) | low(u >> s[0]) << s[1] | low(u) << s[3]
    return np.where(u < 128, u, np.where(u < 2048, two, three)), np.where(u < 128, 1, np.where(u < 2048, 2, 3)).astype(np.uint64)


_BYTES, _SIZE = _utf8(np.arange(1 << 16))


def _mixed(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(0xCC9E2D51)
    return (k << np.uint32(15) | k >> np.uint32(17)) * np.uint32(0x1B873593)


def buckets(first: np.ndarray, second: np.ndarray, features: int) -> np.ndarray:
    """Where ``HashingTF`` counts the term ``"a b"``: MurmurHash3 with seed 42 of 3 to 7 bytes."""
    size = _SIZE[first] + np.uint64(1)
    data = _BYTES[first] | np.uint64(32) << (np.uint64(8) * (size - np.uint64(1))) | _BYTES[second] << (np.uint64(8) * size)
    size = (size + _SIZE[second]).astype(np.uint32)
    low, high = data.astype(np.uint32), (data >> np.uint64(32)).astype(np.uint32)
    h = np.uint32(42) ^ _mixed(low)
    whole = (h << np.uint32(13) | h >> np.uint32(19)) * np.uint32(5) + np.uint32(0xE6546B64)
    h = np.where(size < 4, h, whole ^ _mixed(high)) ^ size
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return (h ^ h >> np.uint32(16)).view(np.int32) % features


def counted(texts: list[str | None], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of each text, their buckets (ascending) and counts."""
    units = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    at = np.repeat(np.arange(len(units)), [len(u) // 2 for u in units])
    unit = np.frombuffer(b"".join(units), dtype="<u2")
    inside = np.flatnonzero(at[1:] == at[:-1])
    spot = at[inside] * features + buckets(unit[inside], unit[inside + 1], features)
    count = np.bincount(spot, minlength=len(units) * features)
    found = np.flatnonzero(count)
    return np.bincount(found // features, minlength=len(units)), found % features, count[found]


class PairCounts(Transformer, HasInputCol, HasOutputCol, HasNumFeatures, DefaultParamsReadable, DefaultParamsWritable):
    """What ``RegexTokenizer`` (by character), ``NGram`` of 2 and ``HashingTF`` make one after the
    other, in one step over Arrow batches and without a string per character. Null counts as empty."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, numFeatures: int = 1 << 18):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = self.getNumFeatures()
        step = max(1, TOGETHER // features)

        def vectors(texts: pa.Array) -> pa.Array:
            parts = [counted(texts.slice(lo, step).to_pylist(), features) for lo in range(0, len(texts), step)]
            entries, index, count = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, dtype=np.int64)] * 3
            offsets = pa.array(np.concatenate([[0], np.cumsum(entries)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (index.astype(np.int32), count.astype(np.float64))]
            return pa.StructArray.from_arrays([pa.array(np.zeros(len(texts), dtype=np.int8)), pa.array(np.full(len(texts), features, dtype=np.int32)), *lists], names=["type", "size", "indices", "values"])

        return dataset.withColumn(self.getOutputCol(), F.arrow_udf(vectors, VectorUDT())(F.lower(self.getInputCol())))
