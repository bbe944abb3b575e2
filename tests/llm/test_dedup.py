"""Exact, line and near duplicates against brute force, with nulls, ties, clashing columns."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noticewright.llm import exact_dedup, line_dedup, near_dedup
from noticewright.llm.components import components
from noticewright.llm.shingles import shingles, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"norm": F.lit("x"), "digest": F.lit(1), "salt": F.lit(None).cast("int"), "id": F.lit(7), "n": F.lit(0), "sig": F.lit("s")}) if extra else df


def test_exact_dedup(spark):
    rows = [(1, "a  b"), (2, "a\tb"), (3, None), (4, ""), (5, " "), (6, " a b"), (None, "a b"), (2, "a\nb"), (7, "z" * 200_000)] + [(i, "hot text") for i in range(100, 140)]
    got = exact_dedup.exact_dedup(frame(spark, rows), rows_per_salt=8).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    assert len(got) == len(rows)
    want = {}
    for t, ids in groups.items():
        for i in ids:
            want.setdefault(i, []).append((min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()))
    for r in got:
        assert (r["keep_id"], r["group_size"], r["text_sha256"]) in want[r["doc_id"]]
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def brute_lines(docs, percent, least):
    seen, gone = [], {}
    for i, t in sorted((i, t) for i, t in docs if i is not None and t is not None):
        for k, line in enumerate(t.split("\n")):
            x = frozenset(WORD.findall(line.translate(LOW)))
            if len(x) >= least:
                if any(len(x & y) * (100 + percent) >= percent * (len(x) + len(y)) for y in seen):
                    gone.setdefault(i, []).append(k)
                seen.append(x)
    return gone


@pytest.mark.parametrize("seed", [0, 1])
def test_line_dedup(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 8
    line = lambda: " ".join(rng.choices(words, k=rng.choice((1, 3, 5, 8, 14, 30))))
    pool = [line() for _ in range(40)]
    def varied(x):
        w = x.split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return rng.choice((str, str.upper, str.title))(" ".join(w))
    rows = [(i, "\n".join(varied(rng.choice(pool)) for _ in range(rng.randint(1, 5)))) for i in range(80)] + [(900, None), (901, ""), (902, "\n\n"), (None, pool[0]), (903, " ".join(f"x{i}" for i in range(30_000)))]
    got = {r["doc_id"]: r["_removed"] for r in line_dedup.line_dedup(frame(spark, rows)).collect() if r["_removed"]}
    assert got == brute_lines(rows, line_dedup.PERCENT, line_dedup.LEAST_WORDS)
    assert line_dedup.line_dedup(frame(spark, [])).count() == 0


def test_remaining_text(spark):
    df = line_dedup.line_dedup(frame(spark, [(1, "one two three four\nkept line only here"), (2, "ONE two three four\nanother line stays here"), (3, None)], extra=False))
    got = {r["doc_id"]: r["t"] for r in df.select("doc_id", line_dedup.remaining_text().alias("t")).collect()}
    assert got == {1: "one two three four\nkept line only here", 2: "another line stays here", 3: None}


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_near(rows):
    sets, up = sets_of(rows), {i: i for i, _ in rows}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup(spark):
    rng = random.Random(5)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    rows, at = [], 0
    for size in (1, 1, 2, 3, 5, 40):
        base = text(rng.choice((60, 120)))
        for _ in range(size):
            w = base[:]
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
            rows.append((at := at + 1, rng.choice((" ", "\n")).join(w)))
    rows += [(at + 1, None), (at + 2, ""), (at + 3, "Few words"), (at + 4, "few\tWORDS"), (at + 5, " ".join(text(20_000))), (at + 6, rows[5][1]), (at + 7, " \n ")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == brute_near(rows)
    nobody = near_dedup.near_dedup(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in nobody) == [("3", "3", True), ("3", "3", True), ("None", "None", True)]
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0


def test_dense_region_is_cut(spark):
    """Regions larger than their bound are cut deeper and lose no link of a chain of copies."""
    base = [f"v{i}" for i in range(80)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(60)]
    got = near_dedup.near_dedup(frame(spark, rows), region=8).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7)] + [(i + 1, i) for i in range(100, 160)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {5: 2, 4: 2, 3: 2, 9: 8} | {i: 100 for i in range(101, 161)}


def test_shingle_hashes():
    assert len(word_hashes("A b c \x1cD")) == 3
    assert list(word_hashes("ABC é")) == list(word_hashes("abc é")) and list(word_hashes("É")) != list(word_hashes("é"))
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(None)) == 0
    assert len(shingles(" ".join(["x"] * 500))) == 1


def one_link_family(seed, n=100):
    """Sets of 300 words: X, and a family whose members are all alike (0.79) but for one about 0.70 like X."""
    rng = random.Random(seed)
    core = [f"c{i}" for i in range(300)]
    off = rng.sample(core, 37)
    rows = [[w for w in core if w not in off] + [f"x{i}" for i in range(37)]]
    inside = [w for w in core if w not in off]
    for k in range(n):
        lost = set(rng.sample(off, 13) + rng.sample(inside, 5)) if k == 0 else set(rng.sample(core, 18))
        rows.append([w for w in core if w not in lost] + [f"f{k}_{i}" for i in range(18)])
    return rows


def alike(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y))


def test_near_dedup_tests_every_likely_pair(spark):
    """The only true link of X has an estimate below those of many other partners."""
    rows = one_link_family(0)
    assert [k for k in range(1, 101) if alike(rows[0], rows[k]) >= 0.75] == [1]
    got = near_dedup.near_dedup(frame(spark, [(k, " ".join(r)) for k, r in enumerate(rows)]), size=1).collect()
    assert {r["component_id"] for r in got} == {0}


def two_dense_families(n=60):
    """Copies of X and a family around it, each alike throughout; one pair of the two is a true link."""
    first, *family = one_link_family(0, n)
    rng, core = random.Random(1), [w for w in first if w[0] == "c"]
    rows = [first]
    for k in range(n):
        lost = set(rng.sample(core, 8))
        rows.append([w for w in first if w not in lost] + [f"y{k}_{i}" for i in range(8)])
    return rows, family


def test_dense_regions_joined_by_one_link(spark):
    """Regions of many blocks: every pair of blocks is compared."""
    ones, others = two_dense_families()
    links = [(i, j) for i, x in enumerate(ones) for j, y in enumerate(others) if alike(x, y) >= 0.75]
    assert links == [(0, 0)]
    rows = [(i, " ".join(r)) for i, r in enumerate(ones + others)]
    random.Random(2).shuffle(rows)
    got = near_dedup.near_dedup(frame(spark, rows), size=1, region=8).collect()
    assert {r["component_id"] for r in got} == {0}


def test_cells_meet_every_pair(spark):
    """Each pair of different components of a region larger than its bound meets, whatever its block."""
    one = frame(spark, [(0, "a b c d e f g")]).select("doc_id", F.lit(0).alias("text_hash"), "text").mapInPandas(near_dedup._describe(1), near_dedup.BASE).first()
    reps = spark.createDataFrame([(i, i if i % 3 else 0, one["sig"], one["sketch"]) for i in range(50)], "id long, comp long, sig binary, sketch binary")
    comp = lambda i: i if i % 3 else 0
    got = [(r["a"], r["b"]) for r in near_dedup.between(reps, near_dedup.LIKELY, None, 8).collect()]
    assert sorted(got) == [(i, j) for i in range(50) for j in range(i + 1, 50) if comp(i) != comp(j)]


def test_later_rounds_write_links_only(spark):
    """Pairs are compared where they meet: a family of n documents writes n - 1 links, or none, and no pairs."""
    one = frame(spark, [(0, "a b c d e f g")]).select("doc_id", F.lit(0).alias("text_hash"), "text").mapInPandas(near_dedup._describe(1), near_dedup.BASE).first()
    reps = spark.createDataFrame([(i, i if i % 3 else 0, 7 if i < 40 else 40_000, one["sig"], one["sketch"]) for i in range(50)], "id long, comp long, n_shingles long, sig binary, sketch binary")
    whole, other = shingles("a b c d e f g", 1).tobytes(), lambda i: shingles(f"a b c d x{i} y{i} z{i}", 1).tobytes()
    for sets, want in ((lambda i: whole, 33), (other, 0)):
        found = spark.createDataFrame([(i, sets(i)) for i in range(50)], "id long, found binary")
        got = near_dedup.between(reps, near_dedup.LIKELY, None, 1024, found, (75, 100)).collect()
        assert len(got) == want and all(r["a"] < r["b"] for r in got)
        links = near_dedup.between(reps, near_dedup.LIKELY, None, 8, found, (75, 100)).unionByName(reps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        assert [r["v"] for r in components(links.toDF("u", "v")).collect()] == [0] * (49 if want else 16)


def test_keys_asked_again_hold_what_may_fit(spark):
    """Sets that no asking set can match, too long, too short or later ones, have no row."""
    docs = frame(spark, [(i, " ".join(f"v{k}" for k in range(10 + i))) for i in range(40)], extra=False).withColumn("kind", F.lit(0).cast("long"))
    classes, lines_log = line_dedup.word_classes(docs)
    sets = line_dedup.lines_of(docs, classes).withColumn("asks", F.col("doc_id") == 20)
    only = line_dedup._asked(line_dedup.keys_of(sets.where("asks").drop("asks"), lines_log, 85)).toPandas()
    got = {r["doc_id"] for r in line_dedup.keys_of(sets, lines_log, 85, None, only).select("doc_id").collect()}
    assert got == {j for j in range(21) if (10 + j) * 100 >= 85 * 30}


def test_later_rounds_join_facts_only(spark):
    """The weight of a document goes along with its rows of all trees; joined to them, it made a row a document and tree again."""
    one = frame(spark, [(0, "a b c d e f g")]).select("doc_id", F.lit(0).alias("text_hash"), "text").mapInPandas(near_dedup._describe(1), near_dedup.BASE).first()
    reps = spark.createDataFrame([(i, i, 40_000, one["sig"], one["sketch"]) for i in range(3)], "id long, comp long, n_shingles long, sig binary, sketch binary")
    found = spark.createDataFrame([(i, b"") for i in range(3)], "id long, found binary")
    plan = near_dedup.between(reps, near_dedup.LIKELY, None, 8, found, (75, 100))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # reps with their sets, and these with the rows of cells


def test_documents_grow_a_few_at_a_time():
    """However many documents a batch holds, what is described and dealt to the trees at once stays small."""
    n = 3 * near_dedup.GROWN + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([bytes(4 * near_dedup.DEPTH * near_dedup.TREES)] * n), pa.array([2.0] * n)], names=["id", "sig", "weight"])
    got = list(near_dedup._grow([batch]))
    assert max(b.num_rows for b in got) == near_dedup.GROWN * near_dedup.TREES and sum(b.num_rows for b in got) == n * near_dedup.TREES
    assert sorted(i for b in got for i in b.column("id").to_pylist()) == sorted([*range(n)] * near_dedup.TREES) and got[0].schema.names == ["tree", "key", "id", "weight"]
    texts = pd.DataFrame({"doc_id": range(n), "text_hash": 0, "text": "a b"})
    assert [len(f) for f in near_dedup._describe(5)(iter([texts]))] == [near_dedup.DESCRIBED] * (n // near_dedup.DESCRIBED) + [n % near_dedup.DESCRIBED]


def test_packed_keys_are_the_keys(spark):
    """Keys shuffled by buckets are those of a row each, with and without asking sets, and those of a bucket meet whole."""
    docs = frame(spark, [(i, " ".join(f"v{k}" for k in range(i % 7, 10 + i))) for i in range(60)], extra=False).withColumn("kind", F.lit(0).cast("long"))
    classes, lines_log = line_dedup.word_classes(docs)
    sets = line_dedup.lines_of(docs, classes)
    for s in (sets, sets.withColumn("asks", F.col("doc_id") % 3 == 0)):
        plain = [tuple(r) for r in line_dedup.keys_of(s, lines_log, 85).collect()]
        kind = line_dedup._record("asks" in s.columns)
        batches = [b for b in line_dedup.keys_of(s, lines_log, 85, buckets=5).repartition(1).sortWithinPartitions("bucket").toArrow().to_batches(max_chunksize=2)]
        got = np.concatenate(list(line_dedup._buckets(batches, kind)))
        want = [(*r[:8], *([tuple(np.frombuffer(r[8] or bytes(8 * line_dedup.WIDE), dtype=np.uint64).tolist())] if len(r) > 8 else [])) for r in plain]
        wide = ["wide"] if len(kind) > 8 else []
        assert sorted((*(int(x[c]) for c in kind.names[:8]), *(tuple(x[c].tolist()) for c in wide)) for x in got) == sorted((*map(int, r[:8]), *r[8:]) for r in want)


def test_equal_lines_are_combined_in_tasks_and_over_them(spark):
    rows = [(i, f"common line {i % 3}\nCOMMON  line {i % 3}\n\nline of {i}\n{' '.join(f'w{k}' for k in range(40))}") for i in range(1, 60)]
    docs = frame(spark, rows + rows[:2]).repartition(6).select("doc_id", F.lit(0).alias("kind"), "text")
    classes, lines_log = line_dedup.word_classes(docs)
    got = line_dedup.sets_of(docs, classes, lines_log).collect()
    words = {(i, n): frozenset(x.lower().split()) for i, t in rows for n, x in enumerate(t.split("\n")) if x}
    first = {}
    for at, w in sorted(words.items()):
        first.setdefault(w, at)
    alone = {(r["doc_id"], r["place"]): r for r in got if r["e_doc"] is None}
    pairs = [((r["doc_id"], r["place"]), (r["e_doc"], r["e_place"])) for r in got if r["e_doc"] is not None]
    assert set(alone) == set(first.values()) and {a for a, _ in pairs} == set(words) - set(alone)
    assert all(e < a and words[e] == words[a] for a, e in pairs)
    plain = {(r["doc_id"], r["place"]): r for r in line_dedup.lines_of(docs, classes).collect()}
    assert all(r[c] == plain[at][c] for at, r in alone.items() for c in ("n", "b1", "b2", "wide", "prefix"))
    one = line_dedup.lines_of(docs, classes).coalesce(1).toArrow().combine_chunks().to_batches()
    assert len({b for b in line_dedup._dealt(one, 7).column("bucket").to_pylist()}) == line_dedup._dealt(one, 7).num_rows <= 7
    assert sum(len(x) for x in line_dedup._dealt(one, 7).column("rows").to_pylist()) == len(first) * line_dedup._LINE.itemsize


def test_keys_come_in_turns_of_bounded_size(spark):
    """Keys that are more than the texts are dealt to turns, each key to one of them; all turns hold all keys."""
    docs = frame(spark, [(i, " ".join(f"v{k}" for k in range(i % 7, 30 + i))) for i in range(60)], extra=False).withColumn("kind", F.lit(0).cast("long"))
    classes, lines_log, length = line_dedup.word_counts(docs)
    assert length == sum(len(r["text"]) for r in docs.collect())
    sets = line_dedup.lines_of(docs, classes)
    for log in (lines_log, 0.0):  # keys of one word, and of up to three
        whole = sorted(map(tuple, line_dedup.keys_of(sets, log, 85).collect()))
        parts = [[tuple(r) for r in line_dedup.keys_of(sets, log, 85, turn=(i, 3)).collect()] for i in range(3)]
        assert sorted(r for p in parts for r in p) == whole and all(parts)
        assert not any({r[0] for r in a} & {r[0] for r in b} for a in parts for b in parts if a is not b)
    turns, buckets = line_dedup._dealing(23_000_000_000 // 49, 8_200_000_000, 500)
    assert 23_000_000_000 / turns <= line_dedup.TURN_SHARE * 8_200_000_000 and 23_000_000_000 // 49 // turns // buckets <= line_dedup.IN_BUCKET + 100
    assert line_dedup._dealing(0, 0, 4) == (1, 16) and line_dedup._dealing(10**12, 1, 4)[0] == line_dedup.CLASSES


def test_lines_are_the_same_in_turns_and_by_bits(spark, monkeypatch):
    """Beyond the bounds of a broadcast neither keys nor texts are shuffled at once; the result stays."""
    words = [f"é{k}" if k % 5 else f"w{k}" for k in range(60)]
    rng = random.Random(4)
    rows = [(i, "\n".join(" ".join(w for w in words[j : j + 24] if rng.random() > 0.04) if rng.random() < 0.8 else "" for j in rng.choices(range(30), k=rng.randrange(1, 5)))) for i in range(80)]
    docs = frame(spark, [*rows, (500, ""), (501, None), (502, "\n"), (503, "one\n\ntwo\n"), *rows[:3]])
    result = lambda: sorted((r["doc_id"], r["text"] or "", r["_lines"], tuple(r["_removed"])) for r in line_dedup.line_dedup(docs).collect())
    want = result()
    assert sum(len(r[3]) for r in want) > 50
    read, turns = [], []
    lines_at, keys_of = line_dedup._lines_at, line_dedup.keys_of
    monkeypatch.setattr(line_dedup, "_lines_at", lambda *a: read.append(1) or lines_at(*a))
    monkeypatch.setattr(line_dedup, "keys_of", lambda *a, **k: turns.append(k.get("turn")) or keys_of(*a, **k))
    for name, value in (("BROADCAST_ROWS", 3), ("SAMPLED", 1), ("TURN_SHARE", 0.5)):
        monkeypatch.setattr(line_dedup, name, value)
    assert result() == want and read and max(t[1] for t in turns if t) > 1


def test_lines_at_bits_are_the_lines_of_texts(spark):
    rows = [(i, "\n".join(["ä" * (i % 3), "", f"line {i}", "b"][: i % 5])) for i in range(40)] + [(50, "\n\n"), (51, "")]
    docs = frame(spark, rows, extra=False).withColumn("kind", F.hash("text").cast("long")).repartition(3)
    kinds = {r["doc_id"]: r["kind"] for r in docs.collect()}
    every = {(i, (kinds[i] << 32) + n): x.encode() for i, t in rows for n, x in enumerate(t.split("\n"))}
    asked = dict(sorted(every.items())[::3])
    bits = line_dedup._bits(spark.createDataFrame(list(asked), "doc_id long, place long"), len(asked))
    got = {(r["doc_id"], r["place"]): bytes(r["line"]) for r in line_dedup._lines_at(docs, bits).collect()}
    assert asked.items() <= got.items() <= every.items() and len(got) <= len(asked) + 2
    assert line_dedup._lines_at(docs, np.full(8192, 255, dtype=np.uint8)).count() == len(every)


def test_numbers_of_lines_are_joined_without_texts(spark, sf, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    node = line_dedup.op5_line_dedup(spark, sf)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().apply(0)
    assert "text" not in node.children().apply(0).output().mkString(" ")
