import random

from pyspark.sql import functions as F

from noticewright.operators.filters import field_keyword, ilike_all
from noticewright.operators.joins import best_title, first_per, insert_or_ignore, longest_contained, numbered, or_anti
from noticewright.sources.html import block_text, decoded, joined_url, page_text
from noticewright.sources.tables import coalesce_columns, delete, latest_status, read_csv, scratch, upsert, write_csv


def test_block_text():
    html = "<head><title>x</title></head><body><nav>menu</nav><article><h1>T&amp;A</h1><p>one<br>two <b>bold</b></p><script>var a='</p>'</script><ol><li>a</li><li>b</li></ol><table><tr><td>1</td><td>2</td></tr></table><a href='/f/x.pdf'>file</a></article></body>"
    text, links = block_text(html, "http://h.org/d/")
    assert text == "T&A\n\none\ntwo bold\n\n1. a\n\n2. b\n\n1\t2\n\nfile http://h.org/f/x.pdf"
    assert links == ["http://h.org/f/x.pdf"]
    assert block_text(None) == ("", []) and block_text("") == ("", [])


def test_page_udfs(spark):
    df = spark.createDataFrame([("http://h.org/a/b", "../c", bytearray("日".encode("gb18030")), "<p>x</p>"), (None, None, None, None)], "u string, h string, raw binary, html string")
    a, b = df.select(joined_url("u", "h").alias("j"), decoded("raw").alias("t"), page_text("html", "u").alias("p")).collect()
    assert (a["j"], a["t"], a["p"]["text"]) == ("http://h.org/c", "日", "x")
    assert (b["j"], b["t"], b["p"]["text"]) == (None, None, "")


def test_keyed_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(2, None), (3, "z"), (4, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "z"), (4, "d")]
    assert [r["k"] for r in delete(old, new, "k").collect()] == [1]
    log = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "x")], "k int, at int, s string")
    assert sorted(map(tuple, latest_status(log, "k", ["at"], "s").collect())) == [(1, "y"), (2, "x")]


def test_insert_or_ignore_twice(spark):
    batch = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "id int, url string")
    first = insert_or_ignore(batch, batch.limit(0), "url", ["id"])
    assert sorted(r["id"] for r in first.collect()) == [1, 3]
    assert insert_or_ignore(batch, first, "url", ["id"]).count() == 0
    assert or_anti(batch, batch.limit(0), ("id", "url"), ["id"]).count() == 2
    assert first_per(batch.orderBy(F.desc("id")), ["url"], ["id"]).where("id = 2").count() == 0


def test_longest_contained(spark):
    docs = spark.createDataFrame([(1, "here abcdefghijklmno and more"), (2, "nothing"), (3, None)], "id int, t string")
    names = spark.createDataFrame([("abcdefghijkl",), ("abcdefghijklmno",)], "name string")
    got = dict(map(tuple, longest_contained(docs, names, F.col("t"), "name").select("id", "match").collect()))
    assert got == {1: "abcdefghijklmno", 2: None, 3: None}


def test_longest_contained_short_names(spark):
    """Names of any length, in running text without spaces too, against brute force."""
    texts = [(1, "第十二届蓝桥杯全国软件大赛报名通知"), (2, "关于蓝桥杯"), (3, "xab"), (4, ""), (5, None), (6, "全国大学生数学建模竞赛获奖名单及数学建模"), (7, "a" * 30)]
    some = ["蓝桥杯", "蓝桥杯全国软件大赛", "数学建模", "全国大学生数学建模竞赛", "ab", "b", "", "a" * 13, "a" * 31]
    docs, names = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(n,) for n in some], "name string")
    got = dict(map(tuple, longest_contained(docs, names, F.col("t"), "name").select("id", "match").collect()))
    assert got == {i: max((n for n in some if n and n in (t or "")), key=lambda n: (len(n), n), default=None) for i, t in texts}
    assert longest_contained(docs, names.limit(0), F.col("t"), "name").where("match is null").count() == len(texts)


def test_best_title(spark):
    rng = random.Random(3)
    titles = [(i, " ".join(rng.choices("ab cd ef gh ij kl".split(), k=rng.randint(1, 5)))) for i in range(80)] + [(90, ""), (91, None), (92, "zz yy"), (93, "ZZ yy zz")]
    got = {r["key"]: (r["item"], r["score"]) for r in best_title(spark.createDataFrame(titles, "key long, title string")).collect()}
    words = {i: set(t.lower().split(" ")) for i, t in titles if t is not None}
    want = {}
    for i, a in words.items():
        score, item = max((15 * len(a & b), -j) for j, b in words.items() if j != i)
        if score >= 30:
            want[i] = (-item, score)
    assert got == want


def test_numbered_splits_frequent_keys(spark):
    rows = [(rng_key, i) for i in range(2000) for rng_key in [1 if i % 3 else 1000000 + i]]
    df = spark.createDataFrame(rows, "key long, id long")
    got = {(r["key"], r["id"]): r["n"] for r in numbered(df, ["key", "id"], "n").collect()}
    assert got == {row: n for n, row in enumerate(sorted(rows), 1)}
    assert numbered(df.limit(0), ["key", "id"], "n").count() == 0


def test_csv_round_trip(spark):
    df = spark.createDataFrame([(1, 'quote " and\nbreak, comma'), (2, " spaces "), (3, "")], "k int, t string")
    write_csv(df, path := scratch(spark, "csv"))
    got = dict(map(tuple, read_csv(spark, path, df.schema).collect()))
    assert got[1] == 'quote " and\nbreak, comma' and got[2] == " spaces "


def test_missing_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, link string")
    assert df.select(coalesce_columns(df, ["url", "link"]).alias("u"), coalesce_columns(df, ["none"]).alias("n")).first().asDict() == {"u": "x", "n": None}
    assert field_keyword(df, "nope:x").count() == 0 and field_keyword(df, "link:x").count() == 1
    assert df.where(ilike_all(link="X", a=None)).count() == 1
