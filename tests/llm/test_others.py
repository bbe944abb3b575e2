"""Licences, toxicity, top-k, WARC, packing, mixing and HTML."""

import itertools
import json
import random
import time
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from noticewright.llm import html_extract, license_scan, mixing, packing, topk, toxicity, warc
from noticewright.llm.license_texts import TEMPLATES


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# -- Licences ----------------------------------------------------------------------------------------


def test_every_wording_is_found(spark):
    rows = [(i, f"Some prose stands here first.\nAnd more of it, quite plain. {t.replace('<...>', 'Jane Doe')}\nThen other prose follows it.\nNothing else.") for i, (_, _, t) in enumerate(TEMPLATES)]
    found = {}
    for r in license_scan.scan(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], set()).add((r["license"], r["exact"]))
    for i, (name, _, _) in enumerate(TEMPLATES):
        assert any(n == name for n, _ in found.get(i, ())), (name, found.get(i))


def test_license_edges(spark):
    rows = [(1, None), (2, ""), (3, "no such thing"), (4, "The licence of poets is a different matter entirely."), (5, "Licensed under the Apache License, Version 3.0."), (None, "Released under the MIT License."), (7, "x " * 50_000 + "\nAll rights reserved.")]
    got = license_scan.scan(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["license"]) for r in got if r["exact"]} == {(None, "MIT"), (7, "all-rights-reserved")}
    five = [r for r in got if r["doc_id"] == 5]
    assert [(r["license"], r["missing"], r["exact"]) for r in five] == [("Apache-2.0", 1, False)]
    seven = next(r for r in got if r["doc_id"] == 7)
    assert rows[6][1][seven["start"] : seven["end"]] == "All rights reserved."
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_many_licenses_of_one_text(spark):
    full = {name: t.replace("<...>", "Jane Doe") for name, _, t in sorted(TEMPLATES, key=lambda x: len(x[2])) if len(t) > 400}
    rows = [
        (1, "Licensed under the MIT License. Licensed under the Apache License, Version 2.0."),
        (2, "\n\n".join(full.values())),
        (3, " ".join(f"The permission of party {i} is void without a licence of court {i}." for i in range(60)) + " " + full["MIT"]),
    ]
    found = {}
    for r in license_scan.scan(frame(spark, rows)).collect():
        found.setdefault(r["doc_id"], set()).add(r["license"])
    assert {"MIT", "Apache-2.0"} <= found[1] and set(full) <= found[2] and "MIT" in found[3]


# -- Toxicity ----------------------------------------------------------------------------------------


def test_toxicity_learns_stems(spark):
    rng = random.Random(1)
    plain = ["river", "house", "green", "walk", "table", "stone", "cloud", "paper"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = rng.choices(plain, k=40) + ([f"grumf{rng.choice(('el', 'ot', 'ik'))}"] * 2 if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = frame(spark, rows), frame(spark, labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.unionByName(frame(spark, [(1000, None), (1001, ""), (1002, "a grumfzz river"), (1003, "river " * 30_000)])), model).collect()}
    for i, toxic in labels:
        assert (got[i] >= toxicity.THRESHOLD) == bool(toxic)
    assert got[1000] == got[1001] < 0.7 and got[1002] > got[1003] and all(0 <= s <= 1 for s in got.values())


def test_toxicity_without_labels(spark):
    docs, none = frame(spark, [(1, "x"), (None, None)]), frame(spark, [], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(docs, toxicity.train(docs, none)).collect()] == [0.5, 0.5]
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none)).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    n = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    got = spark.range(300).where(toxicity.held_out(F.col("id"))).collect()
    assert [r["id"] for r in got] == n


def test_toxicity_on_held_out_documents(spark, sf):
    from noticewright.llm.toxicity import op3_toxicity

    big = sf.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(r["score"], labels[r["doc_id"]]) for r in op3_toxicity(spark, big).collect() if r["held_out"] and r["doc_id"] in labels]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no]) > 0.9


# -- Top-k -------------------------------------------------------------------------------------------


def brute_topk(rows, every, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in ok if c != q and len(b) == len(a))[:k]
            out[q] = [(c, -s) for s, c in best]
    return out


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_topk_equals_brute_force(spark, scale):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 40) / 8]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 330)] + [(400, None), (401, []), (402, [float("nan")] * 40), (403, [None] * 40), (404, [1.0, 2.0]), (410, [3.0, 1.0]), (None, rows[0][1])]
    df = frame(spark, rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "dim": F.lit(2), "key": F.lit("k"), "rank": F.lit(0)})
    got = {}
    for r in topk.exact_topk(df.where("vec_id % 10 = 0"), df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute_topk(rows, 10)
    assert {q: v for q, v in want.items() if v} == got if scale < 1e9 else got.keys() == {q for q, v in want.items() if v}
    assert topk.exact_topk(df.limit(0), df).count() == 0 and topk.exact_topk(df, df.limit(0)).count() == 0


# -- WARC --------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big = "ä" * 90
    rows = [(5, "http://a/", big), (3, "http://b/", big), (4, None, big), (6, "u", "short"), (7, "u", "short"), (8, "x", None), (9, "x", ""), (None, "n", big), (10, "y", "a\r\n\r\nWARC/1.1\r\n" * 20), (11, "z", "q" * 300_000)]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "first": F.lit(1), "bytes": F.lit(2)})
    index, folder = warc.round_trip(pages)
    got = {r["page_id"]: r for r in warc.read_archives(index, folder).collect()}
    texts = {i: t or "" for i, _, t in rows}
    assert set(got) == set(texts)
    for i, r in got.items():
        again = texts[i] == big and i != 3
        assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (3 if again else None)
        assert r["payload_bytes"] == len(texts[i].encode())
        assert bytes(r["payload"]) == (b"" if again else texts[i].encode())
    some = warc.read_archives(index.where("page_id in (10, 3)"), folder).collect()
    assert sorted(r["page_id"] for r in some) == [3, 10]
    none, folder = warc.round_trip(pages.limit(0))
    assert warc.read_archives(none, folder).count() == 0


def test_spans_are_joined():
    assert list(warc._spans([(0, 10), (10, 5), (200_000, 5)])) == [(0, 15, [0, 1]), (200_000, 5, [2])]
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


# -- Packing -----------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(2)
    odd = ["it's DON'T we'LL !'s ''s", "İstanbul ΣΑΣ café ½²x3", "a<|endoftext|>b <|x", "Ünï b\u0085c \x1c d\xa0e", "ß Ÿ µ 1a2 __a_b", "日本語", "", "   ", None, "word " * 9000]
    rows = [(i, x) for i, x in enumerate(odd)] + [(100 + i, " ".join(rng.choices(odd[0].split() + ["alpha", "Beta,"], k=rng.randint(0, 900)))) for i in range(60)] + [(1, odd[1]), (None, "x y")]
    got = packing.pack_documents(frame(spark, rows).withColumns({"rank": F.lit(1), "count": F.lit(2), "length": F.lit(3)}), path).toPandas()
    want = {}
    for i, x in rows:
        ids = np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            want.setdefault((i, k), []).append((at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())))
    for r in got.itertuples():
        key = (None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r.piece)
        want[key].remove((r.start, r.length, r.ids_crc32))
    assert not any(want.values())
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id")["length"].cumsum() - got["length"] == got["offset"]).all()
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_plan_covers_the_histogram():
    rng = random.Random(0)
    for counts in ({}, {2048: 7}, {1: 5000}, {1025: 40}, {rng.randint(1, 900): rng.randint(1, 50) for _ in range(300)}):
        made: dict[int, int] = {}
        for lengths, times in (plan := packing.plan(counts, steps=60)):
            assert sum(lengths) <= 2048
            for n in lengths:
                made[n] = made.get(n, 0) + times
        assert made == counts
        if len(counts) > 100:
            assert sum(t for _, t in plan) <= 1.01 * -(-sum(n * c for n, c in counts.items()) // 2048) + 2


def test_program_does_the_packing():
    """Most tokens stand where the program put them, with hardly more sequences than best fit alone
    would make, on even counts of all lengths and on few lengths."""

    def best_fit(counts):
        left, made = packing._Left(counts, 8, 256), 0
        while left.count:
            left.fill(taken := {}, 2048)
            times = min(left.count[n] // a for n, a in taken.items())
            left.remove(taken, times)
            made += times
        return made

    rng = random.Random(5)
    dense, sparse = {n: rng.randint(1, 3000) for n in range(1, 2049)}, {rng.randint(1, 2048): rng.randint(100, 3000) for _ in range(700)}
    for counts, share in ((dense, 0.85), (sparse, 0.5)):
        report = {}
        packing.plan(counts, report=report)
        assert report["share"] > share
        assert report["at_least"] <= report["sequences"] <= 1.001 * best_fit(counts)


def test_fractional_is_near_its_bound():
    size, count = np.arange(1, 41), np.arange(1, 41)[::-1].astype(float)
    found, lower = packing.fractional(size, count, 40, gap=0.03)
    assert lower <= sum(t for _, t in found) <= 1.03 * lower
    covered = np.zeros(len(size))
    for config, times in found:
        assert sum(size[i] * a for i, a in config.items()) <= 40
        for i, a in config.items():
            covered[i] += a * times
    assert (covered >= count * (1 - 1e-9)).all()


def test_knapsack():
    value, length = np.array([1.0, 1.9, 3.5]), np.array([3, 5, 9])
    rows, worth = packing.knapsack(value, length, 14)
    brute = lambda i: max(value @ np.add(x, np.eye(3)[i]) for x in itertools.product(range(5), repeat=3) if length @ np.add(x, np.eye(3)[i]) <= 14)
    assert worth.max() == pytest.approx(5.4) and (rows @ length <= 14).all() and (rows.diagonal() > 0).all()
    assert rows @ value == pytest.approx(worth) and worth == pytest.approx([brute(i) for i in range(3)])


# -- Mixing ------------------------------------------------------------------------------------------


def fill(sizes, weights=(3, 1, 2)):
    """Targets by resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * w[s] + 1e-9}
        for s in full or free:
            target[s] = 2 * sizes[s] if full else level * w[s]
        if not full:
            break
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return target


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), rng.choice(("a", "a", "a", "b", "c", "d", "é", "", None))) for i in range(1500)]
    rows += [(2000, None, "a"), (2001, "", "only-empty"), (5, "twice same id", "b"), (None, "no id here", "c"), (2002, "long " * 30_000, "zz")]
    df = frame(spark, rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "sid": F.lit("x"), "n": F.lit(0)})
    got = mixing.mixing_plan(df).toPandas()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s, part in got.groupby(got["source"].where(got["source"].notna(), "<none>")):
        s = None if s == "<none>" else s
        assert (part["source_size"] == sizes[s]).all() and part["target"].iloc[0] == pytest.approx(want[s])
        assert abs(part["taken"].sum() - want[s]) <= part["size"].max()
        assert (part["taken"] <= 2 * part["size"]).all()
    key = ["doc_id", "source", "size", "copies"]
    again = mixing.mixing_plan(df.repartition(7)).toPandas()
    assert got.sort_values(key)[key].reset_index(drop=True).equals(again.sort_values(key)[key].reset_index(drop=True))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == got["copies"].sum()
    assert mixing.mixing_plan(df.limit(0)).count() == 0


def test_mixing_many_equal_rows(spark):
    """Equal rows, and rows without an id, are dealt over the tree; the time is in proportion to their number."""
    same = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    none = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"), F.lit("t").alias("source"))
    began = time.time()
    plan = mixing.mixing_plan(same.unionByName(none)).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert time.time() - began < 60
    got = {r["source"]: r for r in plan}
    want = fill({"s": 600_000, "t": 40_000})
    assert {s: r["n"] for s, r in got.items()} == {"s": 200_000, "t": 20_000} and max(r["most"] for r in plan) <= 2
    assert all(abs(r["taken"] - want[s]) <= 3 and r["target"] == pytest.approx(want[s]) for s, r in got.items())


def test_mixing_without_broadcast(spark, monkeypatch):
    df = frame(spark, [(i, "a b c d", f"s{i % 7}" if i % 11 else None) for i in range(300)], "doc_id long, text string, source string")
    key = ["doc_id", "copies"]
    one = mixing.mixing_plan(df).toPandas().sort_values(key)[key].values.tolist()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert mixing.mixing_plan(df).toPandas().sort_values(key)[key].values.tolist() == one


# -- HTML --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_held_out_pages(model):
    rng = random.Random(123)
    good = 0
    for _ in range(200):
        page = html_extract.parse(source := html_extract.authored_page(rng))
        want = html_extract.text_of(page, [bool(y) for y in html_extract.labels_of(page)])
        good += html_extract.extract_many([source], model)[0] == want
    assert good >= 180


def test_pages_by_another_hand(model):
    prose = "This is a sentence of the story, and it goes on for a while. "
    page = f"<html><body><header><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Title &amp; more</h1><p>{prose * 2}<p>{prose}<b>bold</b>text&nbsp;end<br>next</p><div class=ad>Buy this now</div></article><aside class=sidebar><a href=/x>Other</a></aside><form class=newsletter>Join us <input></form><section id=comments><p>First! I liked it a lot.</p></section><footer>&copy; Site</footer></body></html>"
    want = f"Title & more {prose.strip()} {prose.strip()} {prose.strip()} boldtext end next"
    assert html_extract.extract_many([page], model)[0] == want


def test_text_inside_lines_stays(model):
    """Marked words, formulas and open buttons in an article."""
    page = """<html><head><title>x</title></head><body><nav class="menu"><a href=/>Home</a> <a href=/b>News</a></nav>
    <article class="post"><h1>A day at the old harbour</h1>
    <p><span class="dropcap">T</span>he wo<span class="hl">rd</span> split here, and <ins class="upd">an added remark</ins> stands in the line.</p>
    <p>It holds that <math><mi>a</mi><mo>=</mo><mi>b</mi></math> whenever <span class="q">the boats come home at night and all the men of the town look out</span>, says one.</p>
    <button>Like<p>The second paragraph follows an open button, and it has a number of words in it, too.</p>
    <p>A third one, with <object>plain words</object> and a full stop at the end of it, comes last.</p></article>
    <footer class="site-footer">&copy; nobody</footer></body></html>"""
    assert html_extract.extract_many([page], model)[0] == (
        "A day at the old harbour The word split here, and an added remark stands in the line. It holds that a = b whenever the boats come home at night"
        " and all the men of the town look out, says one. The second paragraph follows an open button, and it has a number of words in it, too."
        " A third one, with plain words and a full stop at the end of it, comes last."
    )


def test_names_that_are_taken(spark, model):
    rows = [(1, html_extract.authored_page(random.Random(3)), "mine")]
    got = html_extract.extract(frame(spark, rows, "page_id long, html string, text string"), model).first()
    assert got["text"] == "mine" and got["text_"] == html_extract.extract_many([rows[0][1]], model)[0] != ""
    docs = frame(spark, [(1, "a word", 3.0)], "doc_id long, text string, score double")
    got = toxicity.score(docs, {"weight": np.zeros(1 << toxicity.SPACE_BITS), "bias": 0.0}).first()
    assert got["score"] == 3.0 and got["score_"] == 0.5
    docs = frame(spark, [(1, "a b c", "s", 7, "x"), (1, "d e f", "s", 8, "y")], "doc_id long, text string, source string, copies int, _id string")
    got = mixing.mix(docs).collect()
    assert all((r["copies"], r["_id"]) in ((7, "x"), (8, "y")) for r in got) and got


def test_html_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "<<<>>> <p"), (4, "<script>x"), (5, "<div" * 2000), (6, "<!-- " * 500), (7, "<a href='" * 300)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(frame(spark, rows, "page_id long, html string"), model).collect()}
    assert got[1] == got[2] == got[4] == "" and len(got) == 7
    assert html_extract.extract(frame(spark, [], "page_id long, html string"), model).count() == 0


def test_decoding_never_contradicts(model):
    rng = np.random.default_rng(1)
    page = html_extract.parse(html_extract.authored_page(random.Random(5)))
    for _ in range(50):
        kept = html_extract.decode(page, rng.random(len(page.tag)))
        state = {}
        for i in range(1, len(kept)):
            p = page.parent[i]
            if kept[i] and state.get(p):  # a kept node inside a kept one has kept nodes all the way
                assert kept[p]
            state[i] = kept[i]


# -- Registered queries ------------------------------------------------------------------------------


def test_queries_equal_sql(spark, sf):
    import sys
    from pathlib import Path

    sys.path.insert(0, str(Path(__file__).parent.parent))
    from compare import connect, spark_rows, sql_rows

    from noticewright.llm import catalog

    duck = connect(sf)
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, sf)
        names, want = sql_rows(duck, sql)
        assert sorted(df.columns) == sorted(names) and spark_rows(df) == want, name


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in c.STAGES:
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert json.dumps(pq.read_schema(next((tmp_path / "packing").glob("*.parquet"))).names)


def test_pipeline_edges(spark, sf):
    """Rows that share an id, repeated rows, nulls, empty texts, taken names, empty tables."""
    import corpus_pipeline as c

    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "a"), (5, long + " end", "en", "a"), (5, "unique words stand here\nand a second line", "en", "a"), (6, "unique words stand here\nsix has its own", None, None), (7, None, None, "b"), (8, "", None, "b"), (None, long, "en", "a"), (9, "twice the same row of words here", "en", "a"), (9, "twice the same row of words here", "en", "a")]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.length("text").cast("long"), "_removed": F.lit("r"), "_doc": F.lit(1), "copies": F.lit(2), "_score": F.lit(0.1), "_left": F.lit("l"), "stays": F.lit(True), "text_hash": F.lit(4)})
    once = lambda stage, df: sorted((r["doc_id"] or 0, r["text"] or "") for r in stage(spark, df, sf).collect())
    every = sorted((i or 0, t or "") for i, t, *_ in rows)
    near = once(c.near_out, docs)
    assert near == sorted((i or 0, t or "") for i, t, *_ in [*rows[:1], *rows[2:8]])
    lines = once(c.lines_out, docs)
    assert (5, "unique words stand here\nand a second line") in lines and (6, "six has its own") in lines
    assert (0, long) in lines and (7, "") in lines and (8, "") in lines and lines.count((9, "twice the same row of words here")) == 2
    assert once(c.toxic_out, docs) == every
    assert {i for i, _ in once(c.mixed, docs)} <= {i for i, _ in every}
    assert {r["doc_id"] for r in c.packed(spark, docs, sf).collect()} == {r[0] for r in rows}
    for name, stage in c.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
