"""The date program on notices of our own wording, a case for each of the surveyed shapes and stages."""

import datetime

import pytest

from noticewright.functions.text import running_sums
from noticewright.operators import deadlines as D

A, B, NONE = "activity", "deadline", None
#: (text, year of publication, kind, date, stage)
CASES = [
    ("2025年10月18日，商学院篮球联赛...热闹开赛", 2025, A, "2025-10-18", "11"),
    ("2025年10月9日...顺利举行", 2025, A, "2025-10-09", None),
    ("报名截止时间：2025年9月12日（星期五）18:00", 2025, B, "2025-09-12", "2"),
    ("学院于9月26日在北区体育场顺利举办第九届田径选拔", 2025, A, "2025-09-26", "11"),
    ("截止时间为2025年9月30日", 2025, B, "2025-09-30", "2"),
    ("5月6日，我系在图书馆报告厅成功举办经典诵读案例大赛", 2025, A, "2025-05-06", None),
    ("报名时间及方式：4月15日17：00前（不是4月19日）", 2025, B, "2025-04-15", "2"),
    ("报送截止日期为2025年5月8日", 2025, B, "2025-05-08", "2"),
    ("4月2日----5月11日 → 以后一天为准", 2026, A, "2026-05-11", "7"),
    ("愿意参加的同学请于2025年11月20日20:00前", 2025, B, "2025-11-20", "5"),
    ("听力试音时间为5月7日-9日 → 以后一天为准", 2026, A, "2026-05-09", "9"),
    ("报名：3月9日－4月20日下午3点", 2026, A, "2026-04-20", "9"),
    ("无明确日期", 2025, NONE, None, None),
    ("内容为空 3月4日", 2025, NONE, None, None),
    ("考试的时间是5月11日上午8：30点至10：30点", 2025, A, "2025-05-11", "12"),
    ("各系请于10月12日12:00前将表格发送至邮箱", 2025, B, "2025-10-12", "5"),
    ("6月3日，第二届'最美班长'评选活动...举行", 2025, A, "2025-06-03", "11"),
    ("10月8日至9日...顺利举行", 2025, A, "2025-10-09", "9"),
    ("报名时间：2025年4月1日—4月15日 → 取后者", 2025, B, "2025-04-15", "2"),
    ("3月18日...院赛顺利举行", 2025, A, "2025-03-18", None),
    ("参赛队报名时间：2025年5月6日-2025年5月10日 → 取后者", 2025, B, "2025-05-10", "2"),
    ("4月8日前，将申请表提交至办公室", 2026, B, "2026-04-08", "5"),
    ("统计时段为2024年1月1日至2024年12月31日", 2025, NONE, None, None),
    ("报名时间 2025年7月1日—9月15日", 2025, B, "2025-09-15", "2"),
    ("免考系统将于2025年3月3日至2025年3月7日开放", 2025, NONE, None, None),
    ("请各单位于2025年4月11日前", 2025, B, "2025-04-11", "5"),
    ("获奖报道，无日期", 2025, NONE, None, None),
    ("并于7月4日前以附件形式寄出", 2025, B, "2025-07-04", "2"),
    ("报名截止：2026年4月22日晚10点", 2026, B, "2026-04-22", "5"),
    ("报道，没有具体日期", 2025, NONE, None, None),
    ("10月30日，第五届运动会在主体育场盛大开幕", 2025, A, "2025-10-30", "11"),
    ("11月8日，我系在三号楼举办...院赛", 2025, A, "2025-11-08", "11"),
    ("个人/团队申报（2025年10月15日前）", 2025, B, "2025-10-15", "2"),
    ("三、个人/团队申报（2025年10月15日前）", 2025, B, "2025-10-15", "2"),
    ("个人/团队申报材料须在2025年10月16日17点之前交齐", 2025, B, "2025-10-16", "2"),
    ("2025年11月4日中午...成功举办了校运动会预赛", 2025, A, "2025-11-04", "11"),
    ("5月3日晚...合唱比赛在大礼堂开幕", 2025, A, "2025-05-03", "11"),
    ("5月9日...朗诵大赛决赛...隆重举行", 2025, A, "2025-05-09", "11"),
    ("初赛 5月20日前", 2026, B, "2026-05-20", "5"),
    ("提交作品（2026年4月1日前）", 2026, B, "2026-04-01", "5"),
    ("参与者请于2025年10月31日前将作品发送至邮箱", 2025, B, "2025-10-31", "2"),
    ("请各队于6月1日前完成作品", 2026, B, "2026-06-01", "5"),
    ("2026年6月2日前，组委会组织专家评审", 2026, B, "2026-06-02", "5"),
    ("7月1日...大赛西部赛区省赛...落幕", 2025, A, "2025-07-01", "12"),
    ("6月11日...选拔赛圆满落下帷幕", 2025, A, "2025-06-11", None),
    ("6月14日至15日...总决赛在会展中心...举行", 2025, A, "2025-06-15", "9"),
    ("学习委员将本班报名表电子版于7月2日前", 2025, B, "2025-07-02", "2"),
    ("报名截止时间为4月9日18:00（不是5月1日）", 2025, B, "2025-04-09", "2"),
    ("作品提交截止时间：2026年5月15日 23:59", 2026, B, "2026-05-15", "2"),
    ("动画组报名、缴费及作品上传截止时间：5月30日 14:00点", 2026, B, "2026-05-30", "2"),
    ("不得晚于8月1日（不是7月31日）", 2025, B, "2025-08-01", "2"),
    ("8月12日...评审会在我校隆重举行", 2025, A, "2025-08-12", "11"),
    ("“挑战杯”章程：在举办竞赛终审决赛的当年6月1日以前正式注册的学生", 2025, NONE, None, None),
    # Further stages and guards.
    ("参赛对象：2025年7月1日以前正式注册的本科生", 2025, NONE, None, None),
    ("出生日期2003年9月1日以后，报名截止日期：9月20日", 2025, B, "2025-09-20", "5"),
    ("身份证有效期2025-06-01，活动时间：2025年6月1日", 2025, NONE, None, None),
    ("申报书请各系汇总，2025年9月9日前交", 2025, B, "2025-09-09", "3a"),
    ("征集截止日期：9月10日，8月1日前可修改", 2025, B, "2025-09-10", "3b"),
    ("报名截止日期：9月1日至9月5日", 2025, B, "2025-09-05", "7"),
    ("即日起至10月7日接受投稿，成果展示另行通知", 2025, B, "2025-10-07", "5"),
    ("报名截止：5月1日。补报名截止时间：5月9日。", 2025, B, "2025-05-09", "2"),
    ("作品请在5月20日前寄出，5月10日截止", 2025, B, "2025-05-10", "5"),
    ("提交时间：2025年3月1日至2025年4月2日", 2025, B, "2025-04-02", "4"),
    ("作品提交时间：3月1日—4月3日", 2025, B, "2025-04-03", "4"),
    ("逾期不再受理。命名格式见下。2025年3月1日-2025年3月9日", 2025, B, "2025-03-09", "7"),
    ("活动时间：6月1日至6月3日", 2025, A, "2025-06-03", "7"),
    ("活动时间：6月1日，决赛时间：6月20日", 2025, A, "2025-06-01", "12"),
    ("2025年6月31日举行。另见6月30日，开幕", 2025, A, "2025-06-30", "12"),
    ("x" * 400 + "2025年4月1日" + "y" * 400, 2025, A, "2025-04-01", "10"),
    ("x" * 400 + "编辑：张 2025年4月1日" + "y" * 400, 2025, A, "2025-04-01", "11"),
    ("x" * 400 + "4月1日提交" + "y" * 400, 2025, B, "2025-04-01", "11"),
    ("教务处 2025年4月1日", 2025, NONE, None, None),
    ("比赛时间另行通知。教务处 2025年4月1日", 2025, A, "2025-04-01", "10"),
    ("3月28日发文。时间是2025年12月30日-1月4日", 2025, A, "2025-01-04", "7"),
    ("", 2025, NONE, None, None),
    (None, 2025, NONE, None, None),
]


def test_date_program(spark):
    rows = [(i, t, datetime.date(y, 1, 1)) for i, (t, y, *_) in enumerate(CASES)]
    got = {r["id"]: r["when"] for r in D.with_notice_date(spark.createDataFrame(rows, "id int, text string, published date")).collect()}
    wrong = []
    for i, (text, _, kind, day, stage) in enumerate(CASES):
        w = got[i]
        found = (w["kind"], str(w["date"]), w["stage"]) if w else (None, None, None)
        if found[:2] != (kind, day) or stage and found[2] != stage:
            wrong.append((text, found, (kind, day, stage)))
    assert not wrong, "\n".join(map(str, wrong))


def test_years_are_completed_from_the_publication(spark):
    rows = [(0, "请各队于1月5日前完成", datetime.date(2025, 12, 20)), (1, "请各队于8月5日前完成", datetime.date(2025, 12, 20)), (2, "请各队于8月5日前完成", None)]
    got = {r["id"]: r["when"] and str(r["when"]["date"]) for r in D.with_notice_date(spark.createDataFrame(rows, "id int, text string, published date")).collect()}
    assert got == {0: "2026-01-05", 1: "2025-08-05", 2: None}


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    (r,) = spark.createDataFrame([([i % 7 for i in range(n)],)], "a array<int>").select(running_sums(__import__("pyspark.sql.functions", fromlist=["col"]).col("a")).alias("s")).collect()
    assert r["s"] == [sum(i % 7 for i in range(k + 1)) for k in range(n)]
