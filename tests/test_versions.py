"""Tables that change together: readers see one version, whatever fails."""

import pytest
from pyspark.sql import functions as F

from noticewright.operators.classification import Rules
from noticewright.sources.versions import Versions, rebuild, scored


def tables(spark, n):
    return {"a": spark.range(n).withColumn("v", F.lit(n)), "b": spark.range(2 * n).withColumn("v", F.lit(n))}


def test_a_failure_between_the_writes_leaves_the_old_version(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    with pytest.raises(ValueError):
        store.read("a")
    first = store.replace(tables(spark, 3))
    held = store.read("b")
    broken = tables(spark, 4) | {"b": spark.range(5).withColumn("v", F.raise_error(F.lit("lost")).cast("int"))}
    with pytest.raises(Exception, match="lost"):
        store.replace(broken)
    assert store.current() == first and [store.read(t).agg(F.max("v")).first()[0] for t in "ab"] == [3, 3]
    second = store.replace(tables(spark, 5))
    assert [store.read(t).agg(F.max("v"), F.count("*")).first()[:] for t in "ab"] == [(5, 5), (5, 10)]
    assert held.count() == 6  # a reader of the old version still reads it
    third = store.replace({t: store.read(t).where("id < 2") for t in "ab"})
    assert store.read("b").count() == 2 and store.read("b", second).count() == 10
    store.clean(keep=1)
    assert store.current() == third and store.read("a").count() == 2
    kept = [p.name for p in (tmp_path / "store" / "versions").iterdir()]
    assert kept == [third]


def test_two_writers_both_come_into_force(spark, tmp_path):
    one, two = (Versions(spark, f"file://{tmp_path}/store") for _ in range(2))
    versions = [w.replace(tables(spark, n)) for n, w in enumerate((one, two, one, two), 1)]
    assert one.current() == two.current() == versions[-1]
    assert [n.partition("-")[2] for n in one._pointers()] == versions


def test_rebuild(spark, tmp_path):
    rows = [(1, "关于举办程序设计大赛的通知", "报名参赛", "a"), (2, "会议纪要", "讨论", "a"), (3, "关于举办数学建模竞赛的通知", "参赛报名", "b"), (1, "重复", "", "b")]
    df = spark.createDataFrame(rows, "id int, title string, content string, spider string")
    sources = [df.where("spider = 'a'"), df.where("spider = 'b'")]
    store = Versions(spark, f"file://{tmp_path}/store")
    rebuild(store, sources, Rules())
    want = {r["id"]: r["status"] for r in scored(sources, Rules()).collect()}
    assert {r["id"]: r["status"] for r in store.read("decisions").collect()} == want and set(want) == {1, 2, 3}
    assert {r["id"] for r in store.read("curated").collect()} == {i for i, s in want.items() if s == "passed"} == {1, 3}
    before = store.current()
    rebuild(store, [df.where("id = 2")], Rules())
    assert store.current() != before and store.read("curated").count() == 0 and store.read("decisions").count() == 1
