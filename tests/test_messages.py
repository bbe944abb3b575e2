"""Profiles, names either way, decodings and collated titles on cases of our own."""

import random

from pyspark.sql import functions as F

from noticewright.operators import messages as M
from noticewright.sources.html import best_decoding


def test_profiles_keep_the_last_of_each_field(spark):
    rows = [
        (1, 1, "我是会计专业的大一新手"), (1, 2, "其实读数学系，每周 6 小时，想冲奖"), (1, 3, None), (1, 4, "会运动会也会英语演讲"), (2, 1, ""),
        (3, 2, "大二了，目标 A+"), (3, 1, "大三，校级；每周有 12小时"), (4, 1, "外国语学院，做过翻译，还想创业和建模"),
    ]
    got = {r["user"]: r for r in M.profiles(spark.createDataFrame(rows, "user int, turn int, text string")).collect()}
    names = list(M.INTERESTS)
    assert [got[1][c] for c in M.FIELDS] == ["英语", None, "新手", "大一", "冲奖", "6"]
    assert got[1]["interests"] == [names[1], names[0], names[6]]
    assert [got[2][c] for c in M.FIELDS] == [None] * 6 and got[2]["interests"] == []
    assert (got[3]["year"], got[3]["target"], got[3]["hours"]) == ("大二", "A+", "2")
    assert got[4]["college"] == "外国语学院" and got[4]["interests"] == [names[0], names[1], names[4]]


def test_contained_either_way_equals_all_pairs(spark):
    rng = random.Random(6)
    word = lambda lo, hi: "".join(rng.choices("ab", k=rng.randint(lo, hi)))
    texts = [(i, word(0, 14)) for i in range(150)] + [(900, None), (901, "ababab"), (902, "ababab")]
    names = sorted({word(0, 14) for _ in range(80)})
    got = {(r["id"], r["name"]) for r in M.contained_either_way(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = {(i, n) for i, t in texts for n in names if t and n and (t in n or n in t)}
    assert got == want and len(want) > 200


def test_interest_is_the_first_category(spark):
    names = spark.createDataFrame([("Chess Open", "games", 2), ("open", "any", 5), ("Spring Chess Open 2025", "cups", 1), ("", "none", 0)], "name string, category string, ordinal int")
    texts = spark.createDataFrame([(1, "the chess  open"), (2, "CHESS"), (3, "it is open"), (4, "go"), (5, None)], "id int, text string")
    assert {r["id"]: r["category"] for r in M.interest_of(texts, names).collect()} == {1: "games", 2: "cups", 3: "any", 4: None, 5: None}


def test_best_decoding(spark):
    text = "学院关于春季学生活动的通知：传播工作公告"
    rows = [("utf-8", text), ("gb18030", text), ("big5", "學院工作活動，請同學參加"), ("utf-8", "plain"), ("latin-1", "café à l'école"), ("utf-8", "café à l'école"), ("utf-8", "")]
    df = spark.createDataFrame([(i, bytearray(t.encode(e))) for i, (e, t) in enumerate(rows)] + [(99, None)], "i int, raw binary")
    got = {r["i"]: r["b"] for r in df.select("i", best_decoding(F.col("raw"), ["utf-8", "gb18030", "big5", "latin-1"]).alias("b")).collect()}
    assert [(got[i]["encoding"], got[i]["text"]) for i in (0, 1, 3, 6)] == [rows[i] for i in (0, 1, 3, 6)]
    assert got[99] is None
    # Without Chinese candidates the fewest replacements decide.
    two = {r["i"]: r["b"]["encoding"] for r in df.where("i in (4, 5)").select("i", best_decoding(F.col("raw"), ["utf-8", "latin-1"]).alias("b")).collect()}
    assert two == {4: "latin-1", 5: "utf-8"}
    words = {r["i"]: r["b"]["text"] for r in df.where("i = 2").select("i", best_decoding(F.col("raw"), ["utf-8", "gb18030", "big5"], ["同學", "工作"]).alias("b")).collect()}
    assert words == {2: rows[2][1]}


def test_titles_in_the_order_of_a_language(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["张", "李", "王", "安", "bee", "Ant", "éclair", "zoo"])], "id int, title string")
    assert [r["title"] for r in M.title_order(df.where("id < 4"), "title", "id").collect()] == ["安", "李", "王", "张"]
    assert [r["title"] for r in M.title_order(df.where("id > 3"), "title", "id", collation="UNICODE").collect()] == ["Ant", "bee", "éclair", "zoo"]


def test_rows_have_the_category_of_their_own_text(spark):
    texts = spark.createDataFrame([(1, "aaab"), (1, "b b"), (2, "aaab"), (3, None), (4, "q")], "id int, text string")
    names = spark.createDataFrame([("aaa", "x", "1"), ("bb", "y", "2"), ("aaabc", "z", "3")], "name string, category string, ordinal string")
    got = sorted(((r.id, r.text, r.category) for r in M.interest_of(texts, names).collect()), key=str)
    assert got == sorted([(1, "aaab", "x"), (1, "b b", "y"), (2, "aaab", "x"), (3, None, None), (4, "q", None)], key=str)
