"""Near-duplicates by an LSH forest.

A document's set of shingles has ``TREES`` signatures of ``DEPTH`` MinHash values each. Every tree
is one sorted order of all documents by signature. Documents that share the first ``LEAST`` values
are a region of the order; a region of more than ``REGION`` documents is cut where the common prefix
is longer, level by level, so that the depth follows how dense the order is there. A sketch of 416
bits estimates which pairs of a region are worth a comparison. Links are confirmed on the full sets.

The first round compares the pairs of a maximum spanning forest of each such part (one per document
and tree at most, however large a group of copies is). The rounds after it go through whole regions
of the first ``LEAST`` values, however large, for pairs of different components: first a few of each
document, then, among the documents of pairs that were left out, all likely pairs by falling estimate.
Those are compared where they meet, on the full sets, and only links that join something go on: the
pairs of a family may be many, what is written isn't.
A large region is dealt out as cells, blocks of documents against blocks of documents. Links join components between the
rounds, so that only pairs still of different components are compared, but none of those is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, table, written
from .components import components
from .shingles import SHINGLE, mixed, shingles

#: Chance that documents of similarity 0.75 share no region: (1 - 0.75^3)^24 = 2e-6.
TREES, DEPTH, LEAST, REGION = 24, 6, 3, 1024
#: A sketch: one bit of each of ``BITS`` MinHash values, and two bits of each value of the trees.
#: The estimate of a similarity of 0.75 has a deviation of 0.035; pairs below 0.625 aren't compared.
BITS, TWOS, LIKELY = 128, TREES * DEPTH, 0.625
WORDS = BITS // 64 + -(-TWOS // 32)
#: Where a document of the second round has more than 16 likely partners in a region: so many of the
#: likeliest in each other component, in each of the trees, and ``MOST`` at most. What this leaves out is
#: for later rounds.
FEW, MOST = 5, 64
#: Rounds after the first: the least estimate of their pairs, and the ``few`` of above if there is one.
SURE = 0.715
ROUNDS = [(LIKELY, FEW), (SURE, None), (LIKELY, None)]
#: Candidate ids (8 bytes each) that may be broadcast to pick their texts; more are shuffled.
BROADCAST_IDS = 1_000_000

_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, TREES * DEPTH + BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH + BITS, dtype=np.uint64)

BASE = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary, sketch binary"
CELL = ["region", "row", "col"]
#: Shingles that weigh as much as a document in the size of a cell, where sets are dealt out too; sets
#: that are compared with another one in one go.
WEIGHT, TOGETHER = 1024, 64
#: Documents that are described, and that get their rows of all trees, in one go.
DESCRIBED, GROWN = 500, 500


def minhash(found: np.ndarray) -> np.ndarray:
    least = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(found), 1024):
        np.minimum(least, (found[lo : lo + 1024, None] * _A + _B).min(axis=0), out=least)
    return least


def _describe(size: int):
    def run(frames: Iterator[pd.DataFrame]):
        for frame in (f.iloc[lo : lo + DESCRIBED] for f in frames for lo in range(0, len(f), DESCRIBED)):
            rows = []
            for doc_id, kind, text in zip(frame["doc_id"], frame["text_hash"], frame["text"], strict=True):
                found = shingles(None if text is None or text is pd.NA else text, size)
                if not len(found):
                    rows.append((doc_id, kind, 0, 0, 0, None, None))
                    continue
                least = minhash(found)
                values = (least[: TREES * DEPTH] >> np.uint64(32)).astype(">u4")
                spread = mixed(least)
                twos = np.zeros(32 * (WORDS - BITS // 64), dtype=np.uint64)
                twos[:TWOS] = spread[:TWOS] & np.uint64(3)
                words = (twos.reshape(-1, 32) << (np.uint64(2) * np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)
                bits = np.packbits((spread[TWOS:] & np.uint64(1)).astype(np.uint8)).tobytes() + words.tobytes()
                with np.errstate(over="ignore"):
                    h = np.array([found.sum(), mixed(found * _A[0]).sum()], dtype=np.uint64).astype(np.int64)
                rows.append((doc_id, kind, len(found), int(h[0]), int(h[1]), values.tobytes(), bits))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in BASE.split(", ")]).astype({"doc_id": "Int64"})

    return run


def _grow(batches):
    """A row per document and tree: tree, key, then the columns other than ``sig``, as they are. A few
    documents at a time, as each makes ``TREES`` rows."""
    wide = 4 * DEPTH
    for whole in batches:
        for lo in range(0, whole.num_rows, GROWN):
            batch = whole.slice(lo, GROWN)
            n = batch.num_rows
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=f"S{wide}").reshape(n, TREES)
            keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide), n * TREES, [None, pa.py_buffer(np.ascontiguousarray(sig.T).tobytes())]).cast(pa.binary())
            again, rest = pa.array(np.tile(np.arange(n), TREES)), [c for c in batch.schema.names if c != "sig"]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), keys, *[batch.column(c).take(again) for c in rest]], names=["tree", "key", *rest])


def _cut(lcp: np.ndarray, lo: int, hi: int, depth: int, region: int) -> Iterator[tuple[int, int]]:
    """Parts of the region lo..hi, deeper where it is too large."""
    if hi - lo <= region:
        if hi - lo > 1:
            yield lo, hi
    elif depth == DEPTH:
        for at in range(lo, hi, region - 1):  # neighbouring blocks share a document
            if min(at + region, hi) - at > 1:
                yield at, min(at + region, hi)
    else:
        cuts = [lo, *(np.flatnonzero(lcp[lo + 1 : hi] <= depth) + lo + 1).tolist(), hi]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from _cut(lcp, a, b, depth + 1, region)


def _alike(sketch: np.ndarray, i, j) -> np.ndarray:
    """Estimated similarity: of both kinds of bits, weighed by how exact each is."""
    x = sketch[i] ^ sketch[j]
    ones, twos = x[..., : BITS // 64], x[..., BITS // 64 :]
    a = 1 - np.bitwise_count(ones).sum(axis=-1, dtype=np.int64) * (2 / BITS)
    unlike = np.bitwise_count((twos | (twos >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)
    return 0.36 * a + 0.64 * (1 - unlike * (4 / 3 / TWOS))


def _forest(sketch: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest over the pairs that are likely enough."""
    n = len(sketch)
    best, via, free, pairs = np.full(n, -9.0), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), []
    here = 0
    while True:
        free[here] = False
        if not free.any():
            return pairs
        got = _alike(sketch, here, slice(None))
        better = free & (got > best)
        best[better], via[better] = got[better], here
        here = int(np.where(free, best, -10.0).argmax())
        if best[here] >= LIKELY:
            pairs.append((int(via[here]), here))


def _between(sketch: np.ndarray, comp: np.ndarray, size: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float, few: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs (i, j) of different components, i from ``rows``, j from ``cols``, and the documents
    of pairs left out. A pair is met from its document in the smaller component (``size``: of a
    document's component in the region), the later one of equal ones."""
    i_out, j_out, left = [], [], np.zeros(len(sketch), dtype=bool)
    for i in rows:
        j = cols[(size[cols] > size[i]) | ((size[cols] == size[i]) & (comp[cols] < comp[i]))]
        got = _alike(sketch, i, j)
        j, got = j[got >= LIKELY], got[got >= LIKELY]
        now = got >= least
        if few and len(j) > 16:
            order = np.lexsort((-got, comp[j]))
            j, now = j[order], now[order]
            now &= np.arange(len(j)) - np.searchsorted(comp[j], comp[j]) < few
            now[np.flatnonzero(now)[np.argsort(-got[order][now], kind="stable")[MOST:]]] = False
        if not now.all():
            left[i] = True
            left[j[~now]] = True
        i_out.append(np.full(now.sum(), i))
        j_out.append(j[now])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *i_out]), np.concatenate([none, *j_out]), np.flatnonzero(left)


def _links(sketch: np.ndarray, comp: np.ndarray, size: np.ndarray, rows: np.ndarray, cols: np.ndarray, least: float, alike: tuple[int, int], tree: int, start: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``_between`` without ``few``, but pairs are confirmed on their full ``sets``, and a link is
    given only if those before it don't join its components already. ``start``: a document's region in
    each tree; a pair is compared in the first of the trees where it shares one."""
    joined, left, found = comp.copy(), np.zeros(len(sketch), dtype=bool), []
    n = np.array([len(x) for x in sets])
    for i in rows:
        j = cols[((size[cols] > size[i]) | ((size[cols] == size[i]) & (comp[cols] < comp[i]))) & (joined[cols] != joined[i])]
        j = j[np.minimum(n[i], n[j]) * alike[1] >= np.maximum(n[i], n[j]) * alike[0]]
        got = _alike(sketch, i, j)
        j, got = j[got >= LIKELY], got[got >= LIKELY]
        mine = (start[j] == start[i]).argmax(axis=1) == tree
        j, got = j[mine], got[mine]
        if (got < least).any():
            left[i] = True
            left[j[got < least]] = True
        j = j[got >= least][np.argsort(-got[got >= least], kind="stable")]
        while len(j):
            now, j = j[:TOGETHER], j[TOGETHER:]
            theirs = np.concatenate([sets[k] for k in now])
            same = sets[i][np.minimum(np.searchsorted(sets[i], theirs), n[i] - 1)] == theirs
            shared = np.add.reduceat(same, np.cumsum(n[now]) - n[now], dtype=np.int64)
            for k in now[shared * alike[1] >= alike[0] * (n[i] + n[now] - shared)]:
                if joined[k] != joined[i]:
                    found.append((i, k))
                    joined[joined == joined[k]] = joined[i]
            j = j[joined[j] != joined[i]]
    i, j = np.array(found, dtype=np.int64).reshape(-1, 2).T
    return i, j, np.flatnonzero(left)


def _pairs(region: int = REGION):
    def run(batches):
        """Rows come sorted by (tree, key, id). Whole regions are worked on; the last one of a batch
        waits for what follows."""
        held = None
        for table_ in _with_end(batches):
            rows = held if table_ is None else table_ if held is None else tuple(np.concatenate(x) for x in zip(held, table_, strict=True))
            if rows is None:
                continue
            tree, key, ids, sketch = rows
            n = len(ids)
            same = np.zeros((n, DEPTH), dtype=bool)
            same[1:] = (key[1:] == key[:-1]) & (tree[1:] == tree[:-1])[:, None]
            lcp = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
            starts = np.flatnonzero(lcp < LEAST)
            if table_ is not None and n - starts[-1] <= 64 * region:
                last = int(starts[-1])
                held = tuple(x[last:] for x in rows)
                bounds = starts
            else:
                held = None
                bounds = np.append(starts, n)
            size = np.diff(bounds)
            a_out, b_out = [], []
            two = bounds[:-1][size == 2]
            ok = two[_alike(sketch, two, two + 1) >= LIKELY]
            a_out.append(ids[ok])
            b_out.append(ids[ok + 1])
            for k in np.flatnonzero(size > 2):
                for lo, hi in _cut(lcp, int(bounds[k]), int(bounds[k + 1]), LEAST, region):
                    i, j = np.array(_forest(sketch[lo:hi]), dtype=np.int64).reshape(-1, 2).T
                    a_out.append(ids[lo + i])
                    b_out.append(ids[lo + j])
            a, b = np.concatenate(a_out), np.concatenate(b_out)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _cells(*how):
    def run(batches):
        """Rows come sorted by cell, which is worked on when its last row is there."""
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys = np.stack([t.column(c).to_numpy() for c in CELL])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            if held and any(held[0].column(c)[0] != t.column(c)[0] for c in CELL):
                yield from _cell(held, *how)
                held = []
            at = 0
            for end in new.tolist():
                yield from _cell([*held, t.slice(at, end - at)], *how)
                held, at = [], end
            held.append(t.slice(at))
        if held:
            yield from _cell(held, *how)

    return run


def _cell(parts: list[pa.Table], least: float, few: int | None, alike: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    t = pa.concat_tables(parts)
    ids, comp, size, of_row, of_col = (t.column(c).to_numpy() for c in ("id", "comp", "size", "of_row", "of_col"))
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
    cell = sketch, comp, size, np.flatnonzero(of_row), np.flatnonzero(of_col), least
    if alike:
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=">u4").reshape(-1, TREES, DEPTH)
        start = np.ascontiguousarray(sig[:, :, :LEAST]).view(f"S{4 * LEAST}")[:, :, 0]
        i, j, left = _links(*cell, alike, t.column("tree")[0].as_py(), start, [np.frombuffer(x, dtype=np.uint64) for x in t.column("found").to_pylist()])
    else:
        i, j, left = _between(*cell, few)
    i, j = np.append(i, left), np.append(j, left)  # (a, a): a is in a pair left out
    if len(i):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])


def _with_end(batches):
    for b in batches:
        if n := b.num_rows:
            yield (
                b.column("tree").to_numpy(),
                np.frombuffer(b"".join(b.column("key").to_pylist()), dtype=">u4").reshape(n, DEPTH),
                b.column("id").to_numpy(),
                np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=np.uint64).reshape(n, WORDS),
            )
    yield None


def candidates(reps: DataFrame, region: int = REGION) -> DataFrame:
    """(a, b) with a < b of the first round. ``reps``: id, comp, sig, sketch. Ranges of the orders are
    dealt out by signature and id, so that no region, however dense, has to fit in one task."""
    return (
        reps.select("id", "sketch", "sig").mapInArrow(_grow, "tree int, key binary, id long, sketch binary")
        .repartitionByRange("tree", "key", "id")
        .sortWithinPartitions("tree", "key", "id")
        .mapInArrow(_pairs(region), "a long, b long")
        .distinct()
    )


def sets_of(reps: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """id, found: the full sets of the documents that ``reps`` (id, doc_id, text_hash) stand for."""
    named = written(reps.select("id", "doc_id", "text_hash"), "near-named")
    few = named.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(named) if few else named, ["doc_id", "text_hash"]).select("id", "text")

    def run(frames):
        for f in frames:
            for lo in range(0, len(f), 100):
                part = f.iloc[lo : lo + 100]
                yield pd.DataFrame({"id": part["id"], "found": [shingles(t, size).tobytes() for t in part["text"]]})

    sets = written(texts.mapInPandas(run, "id long, found binary").dropDuplicates(["id"]), "near-sets")
    dropped(named)
    return sets


def between(reps: DataFrame, least: float, few: int | None, region: int = REGION, sets: DataFrame | None = None, alike: tuple[int, int] | None = None) -> DataFrame:
    """(a, b) with a < b of a later round, and (a, a) for documents of pairs left out. With the full
    ``sets`` (and ``n_shingles`` in ``reps``), of the pairs only links that are ``alike`` enough.

    Every pair of different components of a region meets in one cell. The largest component of a
    region has no rows of its own in it, so that cells grow with the documents outside it.
    """
    key = F.xxhash64("tree", F.substring("key", 1, 4 * LEAST))
    weight = F.lit(1.0) if sets is None else F.greatest(F.lit(1.0), F.col("n_shingles") / WEIGHT)
    grown = reps.select("id", "comp", weight.alias("weight"), "sig").mapInArrow(_grow, "tree int, key binary, id long, comp long, weight double")
    grown = grown.select("tree", key.alias("region"), "id", "comp", "weight").repartition("region")
    whole, part = Window.partitionBy("region"), Window.partitionBy("region", "comp")
    mixed_ = grown.withColumns({"lo": F.min("comp").over(whole), "hi": F.max("comp").over(whole), "n": F.sum("weight").over(whole)}).where("lo < hi").drop("lo", "hi")
    sized = mixed_.withColumns({"size": F.count("*").over(part), "part": F.sum("weight").over(part)})
    # The largest component, the smallest id of equal ones.
    sized = sized.withColumn("top", F.max(F.struct("size", -F.col("comp"), "part")).over(whole)).withColumn("outside", F.col("comp") != -F.col("top")["col2"])
    sized = sized.withColumns({"rows": F.ceil((F.col("n") - F.col("top")["part"]) / region), "cols": F.ceil(F.col("n") / region)}).drop("top")
    small, hashed = F.col("n") <= region, F.xxhash64("id")
    cell = lambda row, col, of_row, of_col: F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), of_row.alias("of_row"), of_col.alias("of_col"))
    mine_row, mine_col = F.pmod(hashed, F.col("rows")), F.pmod(hashed, F.col("cols"))
    one, yes, no = F.array(cell(F.lit(0), F.lit(0), F.col("outside"), F.lit(True))), F.lit(True), F.lit(False)
    # Where a document is of the row and the column of one cell, it stands there once.
    as_col = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda r: cell(r, mine_col, F.col("outside") & (r == mine_row), yes))
    as_row = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1), lambda c: F.col("outside") & (c != mine_col)), lambda c: cell(mine_row, c, yes, no))
    dealt = sized.withColumn("c", F.explode(F.when(small, one).otherwise(F.concat(as_col, as_row)))).select("tree", "region", "id", "comp", "size", "c.*")
    facts = reps.select("id", "sketch") if sets is None else reps.select("id", "sketch", "sig").join(sets, "id")
    return (
        dealt.join(facts, "id").repartition(*CELL).sortWithinPartitions(*CELL)
        .mapInArrow(_cells(least, few, alike), "a long, b long")
        .distinct()
    )


def confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, least: tuple[int, int], size: int) -> DataFrame:
    """The (u, v) of ``pairs`` (a written table) whose full sets are similar enough.
    ``docs``: doc_id, text_hash, text; ``reps`` says which of them an id stands for."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = written(reps.select("id", "doc_id", "text_hash").join(ids, "id", "left_semi"), "near-named")
    few = named.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(named) if few else named, ["doc_id", "text_hash"])

    def packed(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "text": [zlib.compress(("" if t is None or t is pd.NA else t).encode("utf-8", "surrogatepass"), 1) for t in f["text"]]})

    texts = written(texts.select("id", "text").mapInPandas(packed, "id long, text binary").dropDuplicates(["id"]), "near-texts")
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")

    def compared(frames):
        known: dict[int, np.ndarray] = {}

        def of(i, data):
            if i not in known:
                if len(known) > 500:
                    known.clear()
                known[i] = shingles(zlib.decompress(data).decode("utf-8", "surrogatepass"), size)
            return known[i]

        for f in frames:
            yes = []
            for a, b, ta, tb in zip(f["a"], f["b"], f["ta"], f["tb"], strict=True):
                x, y = of(a, ta), of(b, tb)
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if small * least[1] < large * least[0]:
                    yes.append(False)
                    continue
                shared = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(shared * least[1] >= least[0] * (len(x) + len(y) - shared))
            ok = f[yes]
            yield pd.DataFrame({"u": ok["a"], "v": ok["b"]})

    links = written(both.mapInPandas(compared, "u long, v long"), "near-links")
    dropped(named, texts)
    return links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: tuple[int, int] = (75, 100), size: int = SHINGLE, region: int = REGION) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash, stays: one row per row of ``docs``.

    Texts without words (null, empty) have no shingle and are linked with nothing. Rows with equal
    sets, repeated rows included, are one document of the forest and share its component. Rows that
    share an id are told apart by their texts; ``text_hash`` (Spark's hash of the text) goes with
    the id for that. ``stays`` marks the first (id, text_hash) of a component, ``kept`` the rows with
    its smallest id. A row without an id links with nothing, is kept and stays. An empty table gives
    an empty result; further columns are ignored. Whole texts count, whatever their length.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.hash(F.col(text_col)).cast("long").alias("text_hash"), F.col(text_col).alias("text"))
    described = written(base.mapInPandas(_describe(size), BASE), "near-base")
    grouped = (
        described.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    )
    # The id of a set is any number; written, it stays the same.
    reps = written(grouped.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "n_shingles", "at.doc_id", "at.text_hash", "sig", "sketch"), "near-reps")
    pairs = written(candidates(reps.withColumn("comp", F.col("id")), region=region), "near-pairs")
    stars, open_ = components(confirm(pairs, base, reps, least, size)), reps
    for estimate, few in ROUNDS:
        now = open_.join(stars, open_["id"] == stars["u"], "left").select("id", F.coalesce("v", "id").alias("comp"), "n_shingles", "sig", "sketch")
        if few:
            found = written(between(now, estimate, few, region), "near-found")
            links = confirm(written(found.where("a < b").join(pairs, ["a", "b"], "left_anti"), "near-more"), base, reps, least, size)
        else:
            sets = sets_of(open_, base, size)
            found = written(between(now, estimate, None, region, sets, least), "near-found")
            links = found.where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))
            dropped(sets)
        stars = components(stars.unionByName(links))
        left = found.where("a = b").select(F.col("a").alias("id"))
        if left.isEmpty():
            break
        open_ = reps.join(left, "id", "left_semi")
    rooted = written(reps.select("id", "h1", "h2", "n_shingles", "doc_id", "text_hash").join(stars, F.col("id") == F.col("u"), "left").select("h1", "h2", "n_shingles", "doc_id", "text_hash", F.coalesce("v", "id").alias("root")), "near-rooted")
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    named = described.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(rooted.join(first, "root").select("h1", "h2", "n_shingles", "first"), ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    stays = F.col("doc_id").isNull() | F.col("first").isNull() | ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash")))
    return named.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash", stays.alias("stays")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
