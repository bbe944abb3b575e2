"""Packing token sequences by the configuration linear program.

Only the histogram of piece lengths reaches the driver: at most ``capacity`` numbers, whatever the
corpus holds. A configuration says how many pieces of each length share a sequence. The covering
program over all configurations is solved by multiplicative weights until primal and dual meet, its
pricing problem being a knapsack; the fractional multiplicities are rounded, and best fit fills what
rounding leaves, again on the histogram. The plan then maps (length, rank among the pieces of that length) to a
place, and the ranks are numbered on the executors.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

CAPACITY = 2048
END_ID = 0
#: Steps of the multiplicative weights, how far a step may move them, and the gap to end at.
STEPS, STEP, GAP = 1000, 0.3, 0.015
#: Classes of lengths that the program tells apart.
CLASSES = 256
#: Parts of texts whose ids a Python worker remembers (some 150 bytes each).
REMEMBERED = 300_000
#: Pieces that are numbered together.
RANKED = 256

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: How the tokenizer splits lower-cased text without white space, for Latin-1.
_LETTER, _NUMBER = "a-zªµºà-öø-ÿß", "0-9²³¹¼½¾"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\t-\r \x85\xa0{_LETTER}{_NUMBER}]+")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: What the tokenizer is asked once, kept while the Python worker lives.
_KNOWN: dict[str, dict[str, bytes]] = {}


class _Ids:
    """Token ids of texts as little-endian 32-bit words.

    A text's ids are those of its parts in turn, and each distinct part is tokenized once. Parts are
    what the tokenizer itself splits a Latin-1 text into, and words between white space of other
    texts and of those that may hold a special token: no part of its ids spans white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), _KNOWN.setdefault(path, {})
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def parts(self, text: str) -> list[str]:
        if "<|" not in text:
            if text.isascii():
                return _SPLIT.findall(text.lower())
            try:
                text.encode("latin-1")
                return _SPLIT.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return _CHUNK.findall(text)

    def learn(self, texts: list[list[str]]) -> None:
        """Ask for all parts not yet known, many in one call: parts that the tokenizer wouldn't
        split again are joined by spaces, and each one's ids end where a word end is."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({p for parts in texts for p in parts if p not in known})
        plain = [p for p in new if _SPLIT.fullmatch(p)]
        asked = [plain[at : at + 200] for at in range(0, len(plain), 200)]
        for some, e in zip(asked, self.tokenizer.encode_batch_fast([" ".join(x) for x in asked], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, dtype="<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(some):
                data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                known.update((p, data[a:b]) for p, a, b in zip(some, bounds, bounds[1:], strict=False))
        rest = [p for p in new if p not in known]
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[p] = np.asarray(e.ids, dtype="<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for at in range(0, len(texts), 256):
            parts = [self.parts(t or "") for t in texts[at : at + 256]]
            self.learn(parts)
            for p in parts:
                yield b"".join(map(self.known.__getitem__, p))


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenize whole texts and cut what is longer than ``capacity``: one row per piece."""

    def run(frames: Iterator[pd.DataFrame]):
        ids, end = _Ids(tokenizer), np.asarray([end_id], dtype="<u4").tobytes()
        for frame in frames:
            rows = []
            texts = [None if t is None or t is pd.NA else t for t in frame["text"]]
            for doc_id, data in zip(frame["doc_id"], (x + end for x in ids(texts)), strict=True):
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, PIECE)


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each item the multiset of the largest value within ``capacity`` that holds it: a row of
    counts, and its value. ``size`` ascends. One table of the dynamic program serves them all; the
    largest of the values is that of the best multiset."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    ends = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if end := ends[room]:
            got = best[room - size[:end]] + value[:end]
            i = int(got.argmax())
            if got[i] > best[room]:
                best[room], last[room] = got[i], i
    filled = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0))
    rows = np.eye(len(size), dtype=np.int32)
    room = filled[capacity - size]
    while (going := np.flatnonzero(room)).size:
        i = last[room[going]]
        rows[going, i] += 1
        room[going] = filled[room[going] - size[i]]
    return rows, value + best[capacity - size]


def fractional(size: np.ndarray, count: np.ndarray, capacity: int, steps: int = STEPS, step: float = STEP, gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Configurations ({index: times}) with multiplicities that cover every size ``count`` times,
    and a lower bound on the sum of the multiplicities.

    Multiplicative weights: a size's weight falls as it gets covered. A step prices all
    configurations by one knapsack and takes those within half a ``step`` of the best, so much of
    them that the most covered size gains one ``step``. The weights over the best value are a dual
    solution, the source of the bound; the cover, scaled up to cover its scarcest size, is a primal
    one. Steps end when both are within ``gap``, or after ``steps`` of them that cover all sizes.
    """
    weight = size / capacity
    covered, found, total, lower = np.zeros(len(size)), {}, 0.0, 0.0
    done = 0
    while done < steps or not covered.min() > 0:
        rows, worth = knapsack(weight, size, capacity)
        top = worth.max()
        lower = max(lower, float((weight * count).sum() / top))
        good = np.unique(rows[worth >= (1 - step / 2) * top], axis=0)
        times = (count / np.maximum(good, 1e-9)).min(axis=1)
        gain = good.T @ times / count
        times, gain = times * step / gain.max(), gain * step / gain.max()
        covered += gain
        total += times.sum()
        for row, t in zip(good, times, strict=True):
            key = row.tobytes()
            found[key] = found.get(key, 0.0) + t
        weight *= np.exp(-gain)
        weight /= weight.max()
        done += 1
        if covered.min() > 0 and total <= lower * (1 + gap) * covered.min():
            break
    out = []
    for key, t in found.items():
        row = np.frombuffer(key, dtype=np.int32)
        out.append(({int(i): int(row[i]) for i in np.flatnonzero(row)}, t / covered.min()))
    return out, lower


class _Left:
    """Pieces that no sequence holds yet, by length and by size class."""

    def __init__(self, histogram: dict[int, int], unit: int, classes: int):
        self.count = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.count)
        self.classes: dict[int, list[int]] = {}
        for n in self.lengths:
            self.classes.setdefault(min(classes, max(1, round(n / unit))), []).append(n)
        self.class_of = {n: s for s, some in self.classes.items() for n in some}

    def fill(self, taken: dict[int, int], room: int) -> int:
        """Best fit: the longest piece that still fits, again and again."""
        while room and (i := bisect.bisect_right(self.lengths, room)):
            while i and taken.get(self.lengths[i - 1], 0) >= self.count[self.lengths[i - 1]]:
                i -= 1
            if not i:
                break
            n = self.lengths[i - 1]
            more = min(room // n, self.count[n] - taken.get(n, 0))
            taken[n] = taken.get(n, 0) + more
            room -= more * n
        return room

    def free(self, taken: dict[int, int], size: int, room: int) -> list[int]:
        """Lengths of a size class that fit and have pieces left, the most frequent first."""
        some = [(self.count[n] - taken.get(n, 0), n) for n in self.classes.get(size, ()) if n <= room]
        return [n for c, n in sorted(some, reverse=True) if c > 0]

    def sequence(self, slots: list[int], capacity: int, empty: int) -> dict[int, int] | None:
        """Pieces for a configuration (classes, the largest first) that leave at most ``empty``
        places: those of its classes but the last, the last but one by trial, then best fit. None
        where a class has run out or no trial fills the sequence."""
        taken: dict[int, int] = {}
        for s in slots[:-2]:
            if not (some := self.free(taken, s, capacity)):
                return None
            taken[some[0]] = taken.get(some[0], 0) + 1
            capacity -= some[0]
        for n in self.free(taken, slots[-2], capacity) if len(slots) > 1 else (0,):
            tried = taken | {n: taken.get(n, 0) + 1} if n else {}
            if self.fill(tried, capacity - n) <= empty:
                return tried
        return None

    def remove(self, taken: dict[int, int], times: int) -> None:
        for n, a in taken.items():
            self.count[n] -= a * times
            if not self.count[n]:
                self.lengths.pop(bisect.bisect_left(self.lengths, n))
                self.classes[self.class_of[n]].remove(n)
                del self.count[n]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS, report: dict | None = None) -> list[tuple[list[int], int]]:
    """[(lengths that share a sequence, how many such sequences)], covering ``histogram`` exactly.

    The program works on size classes: lengths over ``unit``, to the nearest. Multiplicities are
    rounded in order, what one loses the next one gains, so that small ones count too. A
    configuration becomes sequences of real lengths that are as full as it is; where that isn't
    possible, the pieces stay free, and best fit packs what is left after all configurations.
    ``report`` gets the number of sequences, the bounds and the share of the tokens that stand where
    the program put them.
    """
    if not any(c > 0 for c in histogram.values()):
        return []
    unit = max(1, -(-capacity // CLASSES))
    classes = capacity // unit
    left = _Left(histogram, unit, classes)
    size = np.array(sorted(left.classes), dtype=np.int64)
    count = np.array([sum(left.count[n] for n in left.classes[int(s)]) for s in size], dtype=float)
    found, bound = fractional(size, count, classes, steps)
    out, by_program, carry = [], 0, 0.0
    for config, times in sorted(found, key=lambda x: sorted(x[0].items(), reverse=True), reverse=True):
        whole = int(times + carry)
        carry += times - whole
        slots = [int(size[i]) for i in sorted(config, reverse=True) for _ in range(config[i])]
        while whole and left.count:
            if not (taken := left.sequence(slots, capacity, (classes - sum(slots)) * unit)):
                break  # its pieces stay free for other sequences
            n_times = min(whole, *(left.count[n] // a for n, a in taken.items()))
            out.append(([n for n, a in taken.items() for _ in range(a)], n_times))
            by_program += sum(n * a for n, a in taken.items()) * n_times
            left.remove(taken, n_times)
            whole -= n_times
    # Each pattern repeats until one of its lengths runs short, so the number of patterns is bounded.
    while left.count:
        taken = {}
        left.fill(taken, capacity)
        times = min(left.count[n] // a for n, a in taken.items())
        out.append(([n for n, a in taken.items() for _ in range(a)], times))
        left.remove(taken, times)
    if report is not None:
        tokens = sum(n * c for n, c in histogram.items())
        report.update(sequences=sum(t for _, t in out), at_least=-(-tokens // capacity), bound=bound, share=by_program / tokens, patterns=len(out), configurations=len(found))
    return out


def _places(configs: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as runs of ranks: pieces of ``length`` ranked from ``lo`` on go to sequence
    ``first``, ``first`` + 1, ... at ``offset``. Sorted by (length, lo)."""
    runs, used, first = [], dict.fromkeys(range(1, capacity + 1), 0), 0
    for config, times in configs:
        offset = 0
        for n in config:
            runs.append((n, used[n], first, offset))
            used[n] += times
            offset += n
        first += times
    runs.sort()
    return {k: np.array([r[i] for r in runs], dtype=np.int64) for i, k in enumerate(("length", "lo", "first", "offset"))}


def pack(cut: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """Add sequence_id and offset to ``cut`` (doc_id, piece, length, ...), a written table.

    Nothing is dropped or cut further. Pieces of one length are interchangeable: they are ranked in
    groups of about ``RANKED`` and the groups' sizes are summed up, so that a length that a third
    of all pieces have is numbered by many tasks. Repeated rows are pieces each.
    """
    spark = cut.sparkSession
    histogram = {int(r["length"]): int(r["count"]) for r in cut.groupBy("length").count().collect()}
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity, steps), capacity))
    groups = F.element_at(F.lit([max(1, -(-histogram.get(n, 0) // RANKED)) for n in range(1, capacity + 1)]), F.col("length").cast("int"))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), groups))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_group").count().select("length", "_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_group").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("_n", number).join(sizes, ["length", "_group"]).withColumn("rank", F.col("_before") + F.col("_n") - 1).drop("_group", "_n", "_before")

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = places.value
        wide = np.int64(1) << 46
        at = np.searchsorted(p["length"] * wide + p["lo"], length.to_numpy() * wide + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": p["first"][at] + rank.to_numpy() - p["lo"][at], "offset": p["offset"][at]})

    return ranked.withColumn("_p", placed("length", "rank")).select(*cut.columns, "_p.sequence_id", "_p.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    A null or empty text is the end id alone. An empty table gives an empty result; repeated rows
    are packed each; further columns are ignored. ``tokenizer`` is the path of a vocabulary file.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(written(pieces(docs, tokenizer, id_col, text_col, capacity), "pack-pieces"), capacity)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
