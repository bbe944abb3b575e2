"""Hosts of notices of our own wording."""

from pyspark.sql import functions as F

from noticewright.operators import organizers as O
from noticewright.sources.tables import once_each

NAMED = [
    ("本届论坛由共青团中央、教育部、全国学联和中国科协共同主办", "共青团中央、教育部、全国学联、中国科协"),
    ("由某市科协主办的夏令营", None),
    ("文学院、历史学院联合主办朗诵会", "文学院、历史学院"),
    ("论坛由（各级）学院、文学院和外语协会联合主办", "文学院、外语协会联合"),  # the first pattern takes what stands before "host"
    ("主办单位：文学院，则另行安排", "文学院"),
    ("主办单位：全国比赛通知", None),
    ("主办：本次活动。承办单位：校团委，其中校内三人", "校团委"),
    ("协办单位：学生会 一、参赛对象为全体学生", "学生会"),
    ("指导单位：图书馆中心。报名方式见附件", "图书馆中心"),
    ("数理学院承办，校团委协办", "数理学院"),
    ("关于组织学生参加论坛，政法学院在年会上发言", "政法学院"),
    ("现将法学院有关事项通知如下", None),
    ("本次大赛组委会", None),
    ("就业指导中心发布招募", "大学生就业指导中心"),
    ("中国人工智能学会与竞赛组委会联合主办", "中国人工智能学会、竞赛组委会"),
    ("中国高等教育学会、中国教育国际交流协会联合发起并主办", "中国教育国际交流协会、中国高等教育学会"),
    ("关于编制手册，教务处", "教务处"),
    ("没有单位", None), ("", None), (None, None),
]


def test_hosts_named(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NAMED)], "id int, text string")
    got = {r["id"]: r["parsed"] for r in O.with_organizer(df).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(NAMED)] == NAMED


def test_validity(spark):
    yes = ["文学院", "信息中心", "共青团中央委员会、教育厅和省学生联合会以及其他一共十二个参与的单位部门", "电子协会，"]
    no = ["", "院", "中国", "比赛组委会", "在文学院", "第三学院", "第3届文学院", "2024学院", "管理系", "文学院。中心", "a" * 29 + "学院", None]
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    got = {r["v"]: r["ok"] for r in df.select("v", O.valid(F.col("v")).alias("ok")).collect()}
    assert [v for v in yes + no if got[v]] == yes


def test_core_names_and_units(spark):
    names = {"主办单位： 由理学院主办": "理学院", "“文学院 （一）": "文学院", "是由校学生会组织": "校学生会", "": ""}
    units = {"校办公处与文学院、大外语学院同行": "大外语学院", "大赛组委会": None, "无": None}
    df = spark.createDataFrame([(v,) for v in [*names, *units]], "v string")
    got = {r["v"]: (r["name"], r["unit"]) for r in df.select("v", O.core_name(F.col("v")).alias("name"), O.core_unit(F.col("v")).alias("unit")).collect()}
    assert {v: got[v][0] for v in names} == names and {v: got[v][1] for v in units} == units
    # A home institution is the best suffix, and has to be a valid name as others.
    own = lambda name: df.limit(1).select(O.core_unit(F.lit("甲乙大学 山城学校 丙丁学院"), own=name).alias("u")).first()["u"]
    assert own("山城学校") == "山城学校" and own("山城研究所") == "丙丁学院"


def test_fragments_and_joint_candidates(spark):
    fragments = ["", "旨在学院", "学院的老师和学生在一起开会", "某某国际科技大学", "中国大学", None]
    names = ["文学院", "北京某某大学", "学院的老师和学生"]
    joint = ["文学院、校团委", "a会、b院、"]
    single = ["文学院", "文学院、", "甲、乙", "文学院、" + "长" * 31 + "会", None]
    one = lambda f, vs: [r["x"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v string").select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]
    assert all(one(O.sentence_fragment, fragments)) and not any(one(O.sentence_fragment, names))
    assert all(one(O.joint_candidate, joint)) and not any(one(O.joint_candidate, single))


def test_fallback(spark):
    rows = [
        (0, "https://a.example.org/x", "s1", "文学院", "理学院"), (1, "https://a.example.org/x", "s1", "文学院", None), (2, "https://b.example.org:80/x", " S1", "文学院", "旨在学院"),
        (3, "", None, "文学院 ", None), (4, None, "s9", "王", None), (5, None, None, None, "文学院、校团委"), (6, "https://a.example.org", None, None, "中国大学"),
    ]
    parsed = spark.createDataFrame(rows, "id int, url string, spider string, publisher string, parsed string")
    table = lambda rows: spark.createDataFrame(rows, "key string, organizer string")
    got = {r["id"]: r["organizer"] for r in O.with_fallback(parsed, table([("a.example.org", "甲处")]), table([("s1", "乙处")])).collect()}
    assert got == {0: "理学院", 1: "甲处", 2: "乙处", 3: "文学院", 4: None, 5: "文学院、校团委", 6: "甲处"}


def test_equal_texts_are_judged_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def slow(t):
        seen.add(1)
        return None if t is None else t.upper()

    texts = ["文学院a", "b", None, ""]
    df = spark.createDataFrame([(i, texts[i % 4], i % 2) for i in range(4000)], "id int, text string, other int")
    got = once_each(df, ["text", "other"], lambda t: t.withColumn("up", slow("text")))
    assert sorted((r.id, r.text, r.up) for r in got.collect()) == [(i, texts[i % 4], texts[i % 4] and texts[i % 4].upper()) for i in range(4000)]
    assert seen.value == 4


def test_hosts_of_equal_notices_are_parsed_once(spark, sf, monkeypatch):
    given, parse = [], O.with_organizer
    monkeypatch.setattr(O, "with_organizer", lambda t: given.append(t.count()) or parse(t))
    rows = O.organizer_query(spark, sf).count()
    assert given[0] < rows / 2 and rows == O.host_notices(spark, sf).count()
