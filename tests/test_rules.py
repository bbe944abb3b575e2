"""Rules on notices of our own wording, and the score against a plain specification."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from noticewright.functions import vocabulary as V
from noticewright.operators import classification as C
from noticewright.operators import extraction as K


def normal(t):
    for q in '"“”':
        t = t.replace(q, "")
    return "".join(t.split()).lower()


def spec(title, content):
    """The score, step by step, of one notice."""
    nt, nc, text = normal(title), normal(content), normal(title + " " + content)
    has = lambda t, ws: any(w in t for w in ws)
    if has(nt, V.TEACHERS) or has(nc, V.TEACHERS):
        return 0.0
    if has(nt, V.SPORTS) and has(nt, V.STAFF):
        return 0.0
    if has(nt, V.SPORTS) and has(nt, V.STUDENTS):
        return 0.9
    if has(nt, V.TITLE_MARKS) and not has(nt, V.AWARD_REPORTS):
        return 0.85
    if has(nt, V.EXCLUDED):
        return 0.0
    strong = sum(2 * n if w in nt else n if w in nc else 0 for w, n in V.STRONG.items()) + 2 * sum(f in nc for f in V.FEATURES)
    if strong > 0:
        strong += 3 * sum(b in nt for b in V.BONUS)
    second = sum(1.5 * n if w in nt else n if w in nc else 0 for w, n in V.SECONDARY.items())
    raw = min(1.0, max(0.0, (strong + second) / 20))
    titled = has(title.lower(), V.STRONG)
    if has(title + " " + content, V.MEETINGS):
        raw *= 0.8 if titled else 0.5
    if sum(w in text for w in V.EXCLUDED) >= 2 and sum(w in nt or w in nc for w in V.STRONG) <= 1:
        raw *= 0.6
    if not titled:
        n = sum(w in content.lower() for w in V.STRONG)
        raw *= 0.5 if n == 0 else 0.6 if n <= 2 else 0.8 if n <= 4 else 1
    n = sum(w in content.lower() for w in V.LECTURES)
    if n >= 2:
        raw *= 0.4
    elif n == 1 and not titled:
        raw *= 0.6
    return raw


def test_vocabulary_sizes():
    assert (len(V.STRONG), len(V.SECONDARY), len(V.EXCLUDED)) == (78, 13, 154)


def test_confidence_equals_specification(spark):
    rng = random.Random(3)
    words = [*V.STRONG, *V.SECONDARY, *V.EXCLUDED, *V.FEATURES, *V.MEETINGS, *V.LECTURES, *V.TITLE_MARKS, *V.AWARD_REPORTS, *V.SPORTS, *V.STAFF, "学生", "通知", "关于", " ", "“", "ABC"]
    rows = [("".join(rng.choices(words, k=rng.choice((0, 1, 1, 2, 3)))), "".join(rng.choices(words, k=rng.randint(0, 8)))) for _ in range(200)]
    rows += [("关于参加的通知", "".join(rng.choices([*V.STRONG, *V.SECONDARY, *V.FEATURES, *V.LECTURES], k=rng.randint(0, 5)))) for _ in range(100)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, content string")
    got = {r["id"]: r["confidence"] for r in C.with_confidence(df, "title", "content", C.Rules()).collect()}
    for i, (t, c) in enumerate(rows):
        assert got[i] == pytest.approx(spec(t, c)), (t, c)


@pytest.mark.parametrize(
    ("title", "content", "want"),
    [
        ("关于举办校园编程大赛的通知", "报名截止 参赛对象 一等奖", "accepted"),
        ("本周学工例会召开", "会议强调安全", "rejected"),
        ("主题团日活动", "大家参加", "rejected"),
        ("我院学生荣获一等奖", "", "rejected"),
        ("关于缴费的通知", "请按时", "rejected"),
        (None, None, "rejected"),
    ],
)
def test_decisions(spark, title, content, want):
    df = spark.createDataFrame([(title, content)], "title string, content string")
    assert C.classified(df, C.Rules()).first()["decision"] == want


@pytest.mark.parametrize(
    ("text", "kind", "day"),
    [
        ("报名截止时间：2025年4月10日，请按时提交", "deadline", "2025-04-10"),
        ("报名时间：2025年3月1日至2025年3月20日", "deadline", "2025-03-20"),
        ("请于5月6日前提交作品", "deadline", "2025-05-06"),
        ("即日起至2025年6月1日", "deadline", "2025-06-01"),
        ("活动时间：2025年5月9日", "activity", "2025-05-09"),
        ("大会将于2025年9月1日举行", "activity", "2025-09-01"),
        ("apply by 2025-11-30 please", "deadline", "2025-11-30"),
        ("截止日期：2025年2月30日", None, None),
        ("没有日期", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_dates(spark, text, kind, day):
    df = spark.createDataFrame([(text, datetime.date(2025, 1, 1))], "t string, p date")
    got = df.select(K.notice_date(F.col("t"), F.col("p")).alias("x")).first()["x"]
    assert (got and got["kind"], got and str(got["date"])) == (kind, day)


def test_fields(spark):
    text = "主办单位：某某大学教务处，承办方另行通知\n参赛对象：全体本科生\n联系电话：027-1234567 邮箱 a.b@c.edu.cn 网站 http://x.cn/a\n设一等奖 3名，奖金500元"
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(K.organizer(F.col("t")).alias("o"), K.contacts(F.col("t")).alias("c"), K.contact_line(K.contacts(F.col("t"))).alias("line"), K.awards(F.col("t")).alias("a"), K.tags(F.col("t")).alias("tags")).first()
    assert r["o"] == "某某大学教务处"
    assert (r["c"]["mails"], r["c"]["phones"], r["c"]["sites"]) == (["a.b@c.edu.cn"], ["027-1234567"], ["http://x.cn/a"])
    assert r["line"] == "phone:027-1234567;mail:a.b@c.edu.cn;site:http://x.cn/a"
    assert (r["a"]["levels"], r["a"]["counts"], r["a"]["money"]) == (["一等奖"], ["一等奖 3名"], ["500元"])
    assert r["tags"] == ["award", "mail"]


def test_naive_bayes_learns(spark, sf):
    from noticewright import catalog

    rows = catalog.queries()["L13_naive_bayes"](spark, sf).collect()
    held = [r for r in rows if r["doc_id"] % 5 == 0]
    assert sum(r["prediction"] == r["label"] for r in held) >= 0.8 * len(held)


def test_pairs_are_counted_as_by_mllib(spark, tmp_path):
    """One step over batches, without a row of characters, counts what three stages of MLlib count."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    from noticewright.functions.pairs import PairCounts
    from noticewright.operators.classification import text_classifier

    assert any(isinstance(s, PairCounts) for s in text_classifier().getStages())
    texts = ["", "a", "ab", "Öl  \n\x00\x00z", "报名截止 2025年", "😀x😀😀", "İSTANBUL ΣΑΣ", "the cat sat on the mat " * 400, "\x7f\x80\u07ff\u0800\uffff"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 9)], "i int, text string")
    old = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="chars", pattern="", minTokenLength=1), NGram(n=2, inputCol="chars", outputCol="pairs"), HashingTF(inputCol="pairs", outputCol="tf", numFeatures=4096)])
    want = {r["i"]: r["tf"] for r in old.fit(df).transform(df).collect()}
    new = Pipeline(stages=[PairCounts(inputCol="text", outputCol="tf", numFeatures=4096)]).fit(df)
    new.write().save(f"file://{tmp_path}/model")
    assert {r["i"]: r["tf"] for r in PipelineModel.load(f"file://{tmp_path}/model").transform(df).collect()} == want
    assert PairCounts(inputCol="text", outputCol="tf").transform(df.where("i < 0")).count() == 0


def test_decayed_weights_take_300_actions(spark, sf):
    from noticewright import catalog
    from noticewright.operators.aggregates import decayed_weights
    from noticewright.plans.views import actions

    acts = actions(spark, sf)
    counts = {r["user_id"]: r["count"] for r in acts.groupBy("user_id").count().collect()}
    assert 40 < max(counts.values()) <= 300
    whole = {r["user_id"]: r["weight"] for r in decayed_weights(acts, ["user_id"], "2024-02-01", last=10**9).collect()}
    assert {r["user_id"]: r["weight"] for r in catalog.queries()["F18_decayed_weights"](spark, sf).collect()} == pytest.approx(whole, abs=2e-6)
