"""The date of a notice: a table of staged rules over the dates of a text (survey rows K10, K11).

A text is cut once into its *mentions*: every ``[year]month day`` with its place, the text before and
behind it, and the mention that follows with what stands between. A rule is a row of data: what must
end the text before the date, begin the text behind it, or link it with the next date, and what it
makes of the first mention that fits: a date at once, or a candidate among which a later stage
picks. Days that don't exist are no dates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import completed_date
from ..functions.text import running_sums
from ..plans.views import table
from ..registry import query
from ..sources.tables import once_each
from .blocks import with_following
from .extraction import labelled

#: Characters of a mention's surroundings that rules may look at.
AROUND = 200
MENTION = r"(?:\d{4}年)?\d{1,2}月\d{1,2}日"
FULL = r"\d{4}年\d{1,2}月\d{1,2}日"
ISO = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
RANGE = r"\s*[至\-—]+\s*"

# Fixed values from here on: words and patterns of the surveyed program, in its order.
NO_DATE = ("无明确日期", "内容为空", "统计时段，非竞赛日期，应排除", "免考系统开放时间，非竞赛日期", "获奖报道，无日期", "评价报道，无日期", "竞赛简介，无日期")
PERSONAL = r"(?:年龄|周岁|生于|出生|有效期|身份证)[^0-9年月日]*?"
OTHER_PERIODS = r"统计时段|免考系统|课程免考|期末免考|开放时间|获奖时间"
ELIGIBLE = r"参赛对象[：:]*[\s\S]*?(\d{1,2}月\d{1,2}日)"
ELIGIBLE_WORDS = r"正式注册|学籍|年龄|周岁|在职|研究生|本科生"
FINALS_YEAR = "在举办竞赛终审决赛的当年"
FINALS_CUP = "挑战杯"
DEADLINE_WORDS = ((3, r"报名截止|提交截止|截止日期|逾期|不再受理|截止时间|最后期限"), (2, r"报名|提交|上传|报送|交稿|发送|命名格式|材料提交|作品提交"))
ACTIVITY_WORDS = (
    (3, r"举办|举行|开幕|开赛|活动时间|比赛时间|决赛时间|初赛时间|校赛|院赛|总决赛|半决赛|小组赛|预选赛|选拔赛"),
    (2, r"活动|大赛|比赛|决赛|运动会|展示|答辩|路演|成功举办|顺利举行|成功举行|评选活动|评选大赛|圆满落下帷幕|圆满落幕|成功落幕|落下帷幕|盛大开幕|歌咏比赛|读书演讲大赛|评审会|研讨会|交流会"),
    (1, r"将|于|在|定于|暂定"),
)
INTERVAL_ACTIVE = ACTIVITY_WORDS[0][1] + r"|活动|大赛|比赛|决赛|运动会|展示|答辩|路演|成功举办|顺利举行"
INTERVAL_DUE = "|".join(p for _, p in DEADLINE_WORDS)
HELD = r"(?:举办|举行|开幕|开赛|拉开帷幕|启动|拉开序幕|开幕赛|成功举办|顺利举行|成功举行|评选活动|评选大赛|圆满落下帷幕|圆满落幕|成功落幕|落下帷幕|盛大开幕|歌咏比赛|读书演讲大赛|评审会|选拔赛)"
ENDED = r"(?:圆满落下帷幕|圆满落幕|成功落幕|落下帷幕)"
ACTIVITY_LABELS = (
    "活动时间", "比赛时间", "决赛时间", "初赛时间", "复赛时间", "预选赛时间", "运动会时间", "开幕时间", "闭幕时间", "展示时间", "大赛时间", "竞赛时间", "赛事时间", "选拔赛时间",
    "举办日期", "举行日期", "召开日期", "开展日期", "校赛时间", "院赛时间", "总决赛时间", "半决赛时间", "小组赛时间", "答辩时间", "路演时间", "现场赛时间",
)
LABELS_FROM_YEAR = ("活动时间", "比赛时间", "校赛时间", "院赛时间", "总决赛时间")
LABELS_BOTH_YEARS = ("活动时间", "比赛时间")
ENTRY_LABELS = ("报名时间", "报名", "提交时间", "作品提交时间")
SIGNALS_BEFORE = r"报名|截止|提交|即日起|前|举办|举行|活动时间|比赛时间"
PUBLICATION = r"发布时间|发布日期|发文日期|通知时间|撰稿人|编辑|审核|打印|下载"
ATTACHMENT = r"附件|表|图|参考文献|注|说明|备注|附录"
ALONE_DEADLINE = r"截止|提交|报名|申报"
ALONE_EVENT = r"举办|举行|开幕|开赛|活动时间|比赛时间|圆满落幕|落下帷幕|成功举办|顺利举行"
# End of the fixed values.

COLON = r"[：:]*\s*"
CLOCK = r"\s*(?:[时分秒]?\d{1,2}:\d{2})?\s*前"


@dataclass(frozen=True)
class DateRule:
    """The first mention that fits decides; if its date is missing or invalid, the rule gives nothing.

    ``before`` must end the text before the date, ``after`` begin the text behind it; ``year`` says
    whether the date must (not) have one. With ``link`` the next date must follow with that
    between, ``next_year`` as ``year``, and its date is taken: in the first one's year where it has none
    (``inherit``) or in the year of publication. ``whole``: a pattern of the whole text instead, with the
    date in its group. ``veto``: must not occur in so many characters before and behind that mention.
    """

    stage: str
    kind: str
    before: str = ""
    after: str = ""
    year: bool | None = None
    link: str = ""
    next_year: bool | None = None
    inherit: bool = True
    whole: str = ""
    veto: tuple[str, int, int] = field(default=("", 0, 0))


def _label(stage, before, kind="deadline", **more):
    return DateRule(stage, kind, before=before, **more)


_DASH = r"\s*[—-]\s*"
#: Stage 2: labels, each decides at once.
LABELS = [
    _label("2", rf"报送截止日期{COLON}为?\s*"),
    _label("2", r"截止时间[为:：]*\s*"),
    _label("2", r"请于\s*", after=r"\s*前"),
    _label("2", r"并于\s*", after=r"\s*前"),
    _label("2", r"各参赛队须于\s*", after=r"\s*前"),
    _label("2", r"学习委员将本班报名表电子版于\s*", after=r"\s*前"),
    _label("2", rf"报名时间及方式{COLON}"),
    _label("2", rf"报名时间{COLON}", year=True, link=_DASH, next_year=False),
    _label("2", rf"参赛队报名时间{COLON}", year=True, link=r"\s*-\s*", next_year=True),
    _label("2", rf"报名时间{COLON}", after=r"(?:\z|[^\s—-]|\s+(?:\z|[^\s—-]))", veto=(r"[—-]", 0, 10)),
    _label("2", r"[0-9]+[、.]\s*个人/团队申报\s*[（(]\s*", after=r"\s*前\s*[）)]", year=True),
    _label("2", r"个人/团队申报\s*[（(]\s*", after=r"\s*前\s*[）)]", year=True),
    DateRule("2", "deadline", whole=rf"(?s)个人/团队申报.*?({FULL}).*?前"),
    _label("2", rf"个人/团队申报\s*{COLON}", after=r"\s*前", year=True),
    _label("2", r"不得晚于", year=False),
]
_ASKED = (r"报名截止时间|截止时间", 100, 0)
#: Stage 3a: "before" phrases: candidates, for registration if its words stand before, at once after 申报.
BEFORE = [
    DateRule("3a", "deadline", after=CLOCK, veto=_ASKED),
    DateRule("3a", "deadline", before=r"\(\s*", after=rf"{CLOCK}\s*\)", veto=_ASKED),
    DateRule("3a", "deadline", before=r"(?:个人|团队)申报\s*\(\s*", after=rf"{CLOCK}\s*\)", veto=_ASKED),
]
#: Stage 3b: at once. 3c: a candidate. 3d: candidates, two of them for registration.
COLLECTED = [_label("3b", rf"征集截止日期{COLON}"), _label("3b", rf"申报截止日期{COLON}"), _label("3b", rf"截止时间{COLON}")]
FROM_NOW = _label("3c", r"即日起至\s*")
_START = (r"[至\-—]", 0, 10)
STRONG = [
    (_label("3d", rf"报名截止时间{COLON}", veto=_START), True),
    (_label("3d", rf"报名截止{COLON}", veto=_START), True),
    (_label("3d", rf"截止日期{COLON}", veto=_START), False),
    (_label("3d", rf"提交截止{COLON}", veto=_START), False),
    (_label("3d", rf"作品提交截止{COLON}", veto=_START), False),
    (DateRule("3d", "deadline", after=r"\s*截止", veto=_START), False),
]
#: Stage 4: intervals of registration and submission end with the deadline. The program's veto of
#: activity words never holds, since the label itself waives it, and so isn't here.
INTERVALS = [
    _label("4", rf"报名时间{COLON}", link=_DASH, next_year=False),
    _label("4", rf"参赛队报名时间{COLON}", year=True, link=r"\s*-\s*", next_year=True),
    *(_label("4", rf"{w}{COLON}", year=y, link=RANGE, next_year=n) for y, n in ((False, False), (True, False), (True, True)) for w in ENTRY_LABELS),
]
#: Stage 6: labelled activity times, candidates.
ACTIVITY_TIMES = [
    *(_label("6", rf"{w}{COLON}", "activity", year=y, link=RANGE, next_year=n) for y, n, ws in ((False, False, ACTIVITY_LABELS), (True, False, LABELS_FROM_YEAR), (True, True, LABELS_BOTH_YEARS)) for w in ws),
    *(_label("6", rf"{w}{COLON}", "activity") for w in ACTIVITY_LABELS),
]
#: Stage 7: intervals without a label; the words around decide the kind.
UNLABELLED = [
    DateRule("7", "", link=RANGE, next_year=False, inherit=False),
    DateRule("7", "", year=True, link=RANGE, next_year=False),
    DateRule("7", "", year=True, link=RANGE, next_year=True),
]
#: Stage 8: dates with verbs, candidates.
VERBS = [
    DateRule("8", "activity", after=rf"\s*[,，]?\s*{HELD}"),
    DateRule("8", "activity", before=r"(?:于|在|定于|暂定于)\s*", after=rf"\s*{HELD}"),
    DateRule("8", "activity", before=r"将于\s*", after=rf"\s*{HELD}"),
    DateRule("8", "activity", after=r"\s*(?:上午|下午|中午|晚上|\d{1,2}点)"),
    DateRule("8", "activity", after=rf"\s*[,，]?\s*{ENDED}"),
    DateRule("8", "activity", before=r"(?:于|在)\s*", after=rf"\s*{ENDED}"),
    *(DateRule("8", "activity", before=rf"{w}\s*") for w in ("成功举办", "顺利举办", "成功举行", "顺利举行", "于", "在")),
    DateRule("8", "activity", after=r"\s*[,，]"),
    DateRule("8", "activity", before=r"考试的时间是\s*"),
    *(DateRule("8", "activity", whole=rf"({MENTION})\s*[^\n]*?{w}") for w in ("隆重举行", "开幕", "落幕")),
]
ANY_INTERVAL = DateRule("8b", "activity", link=RANGE)
#: Stage 9: further intervals, at once. The second and fourth end with a day of the same month.
LAST_INTERVALS = [
    DateRule("9", "activity", before=r"听力试音时间为\s*", link=r"\s*[-至]\s*", inherit=False),
    DateRule("9", "activity", whole=r"听力试音时间为\s*(\d{1,2}月)\d{1,2}日-(\d{1,2}日)"),
    DateRule("9", "activity", link=r"\s*至\s*"),
    DateRule("9", "activity", whole=r"((?:\d{4}年)?\d{1,2}月)\d{1,2}日\s*至\s*(\d{1,2}日)"),
    DateRule("9", "activity", before=rf"报名{COLON}", link=r"\s*[－-]\s*", inherit=False),
]

_NONE = "array()"


def _day(raw: Column, published: Column) -> Column:
    """Text of a date, its year completed where there is none."""
    part = lambda p: F.nullif(F.regexp_extract(raw, p, 1), F.lit(""))
    month, day, year = part(r"(\d{1,2})月"), part(r"(\d{1,2})日"), part(r"(\d{4})年")
    return F.when(year.isNotNull(), F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")).otherwise(completed_date(month, day, published))


def mentions(text: Column, published: Column, found: Column, gaps: Column, ends: Column) -> Column:
    """The dates of a text: per mention at (0-based), raw, year, own (its day), plain (its day in the year
    of publication), before, after, and gap (up to the next one). ``found``, ``gaps`` and ``ends`` are columns
    that hold the dates as written, what stands between them, and where each ends but for the last gaps."""
    at = lambda raw, i: F.element_at(ends, i + 1) - F.length(raw)
    return F.transform(
        found,
        lambda raw, i: F.struct(
            at(raw, i).alias("at"), raw.alias("raw"), F.nullif(F.regexp_extract(raw, r"(\d{4})年", 1), F.lit("")).alias("year"),
            _day(raw, published).alias("own"), _day(F.regexp_replace(raw, r"\d{4}年", ""), published).alias("plain"),
            F.substring(text, F.greatest(F.lit(1), at(raw, i) - AROUND + 1), F.least(at(raw, i), F.lit(AROUND))).alias("before"),
            F.substring(text, F.element_at(ends, i + 1) + 1, F.lit(AROUND)).alias("after"), F.element_at(gaps, i + 2).alias("gap"),
        ),
    )


def linked(m: Column) -> Column:
    """Each mention with the day of the next one: ``next`` (null at the last), in its own or the
    publication's year, and ``inherited``, in this one's year where the next has none."""
    def one(x, i):
        n = F.try_element_at(m, i + 2)
        same = F.try_to_date(F.concat(x["year"], F.lit("-"), F.regexp_extract(n["raw"], r"(\d{1,2})月", 1), F.lit("-"), F.regexp_extract(n["raw"], r"(\d{1,2})日", 1)), "y-M-d")
        return F.struct(*(x[c].alias(c) for c in ("at", "raw", "year", "own", "plain", "before", "after", "gap")), n["raw"].isNotNull().alias("followed"), n["year"].alias("next_year"), n["own"].alias("next"), F.when(n["year"].isNull() & x["year"].isNotNull(), same).otherwise(n["own"]).alias("inherited"))

    return F.transform(m, one)


def _right(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.lit(1), F.length(text) - n + 1), F.lit(n))


def _window(x: Column, before: int, after: int) -> Column:
    """So many characters before the mention, and behind its first character on."""
    return F.concat(_right(x["before"], before), F.substring(F.concat(x["raw"], x["after"]), 1, after))


FIRST_FULL = DateRule("10", "activity", year=True)
#: Every rule, in the order in which their dates stand in the column ``days``.
RULES = [*LABELS, *BEFORE, *COLLECTED, FROM_NOW, *(r for r, _ in STRONG), *INTERVALS, *UNLABELLED, *ACTIVITY_TIMES, *VERBS, ANY_INTERVAL, *LAST_INTERVALS, FIRST_FULL]


WHOLE = [r for r in RULES if r.whole]


def first_fit(r: DateRule) -> str:
    """SQL for the first linked mention that fits a rule, null if none does. The literal text that a
    pattern starts with is looked for before the pattern is."""
    word = re.match(r"[^\\\[\](){}?*+|.^$]*", r.before)[0]
    tests = [f"contains(x.before, '{word}')"] if word else []
    tests += [rf"x.before rlike r'(?:{r.before})\z'"] if r.before else []
    tests += [f"x.after rlike r'^(?:{r.after})'"] if r.after else []
    tests += [f"(x.year is not null) = {r.year}"] if r.year is not None else []
    tests += [rf"x.followed and x.gap rlike r'^(?:{r.link})\z'"] if r.link else []
    tests += [f"(x.next_year is not null) = {r.next_year}"] if r.link and r.next_year is not None else []
    return f"try_element_at(filter(m, x -> {' and '.join(tests) or 'true'}), 1)"


def groups_of(pattern: str) -> int:
    return pattern.replace("(?", "").count("(")


class Program:
    """The stages over ``text``, ``published``, ``m`` (linked mentions), ``hits`` (the first mention of each
    of ``RULES``), ``wholes`` (what those of the whole text cut out) and ``days`` (their dates, null where
    invalid)."""

    def __init__(self):
        self.m, self.place = F.col("m"), {id(r): i + 1 for i, r in enumerate(RULES)}
        self.whole = {id(r): i + 1 for i, r in enumerate(WHOLE)}

    def hit(self, r: DateRule) -> Column:
        return F.element_at("hits", self.place[id(r)])

    def day(self, r: DateRule) -> Column:
        return F.element_at("days", self.place[id(r)])

    def found(self, r: DateRule) -> Column:
        """What ``days`` has for a rule, before invalid days leave."""
        if r.whole:
            return F.when(F.element_at("wholes", self.whole[id(r)]) != "", _day(F.element_at("wholes", self.whole[id(r)]), F.col("published")))
        x = f"hits[{self.place[id(r)] - 1}]"
        day = f"{x}.own" if not r.link else f"{x}.inherited" if r.inherit else f"{x}.next"
        pattern, before, after = r.veto
        around = f"right({x}.before, {before})" if before else f"substring({x}.after, 1, {after})"
        return F.expr(f"case when not {around} rlike r'{pattern}' then {day} end" if pattern else day)

    def result(self, r: DateRule, day: Column, kind: Column | None = None) -> Column:
        return F.when(day.isNotNull(), F.struct((F.lit(r.kind) if kind is None else kind).alias("kind"), day.alias("date"), F.lit(r.stage).alias("stage")))

    def at_once(self, rules) -> list[Column]:
        one = "case when {0} is not null then named_struct('kind', '{1}', 'date', {0}, 'stage', '{2}') end"
        return [F.expr(f"coalesce({', '.join(one.format(f'days[{self.place[id(r)] - 1}]', r.kind, r.stage) for r in rules)})")]

    def picked_deadline(self) -> Column:
        """Stage 5: the latest candidate for registration, else the earliest."""
        registering = [F.when(_right(self.hit(r)["before"], 100).rlike("报名|申报"), self.day(r)) for r in BEFORE] + [self.day(r) for r, flag in STRONG if flag]
        all_ = [self.day(r) for r in [*BEFORE, FROM_NOW, *(r for r, _ in STRONG)]]
        return self.result(DateRule("5", "deadline"), F.coalesce(F.array_max(F.array(*registering)), F.array_min(F.array(*all_))))

    def by_words(self, r: DateRule) -> Column:
        """Stage 7: a deadline if its words around weigh more than those of an activity, and one."""
        around = _window(self.hit(r), AROUND, AROUND)
        weigh = lambda words: sum((F.when(around.rlike(p), n).otherwise(0) for n, p in words), F.lit(0))
        return self.result(r, self.day(r), F.when(weigh(DEADLINE_WORDS) > weigh(ACTIVITY_WORDS) + 1, "deadline").otherwise("activity"))

    def interval_candidate(self) -> Column:
        """Stage 8b: an interval near activity words, or not near those of a deadline."""
        around = _window(self.hit(ANY_INTERVAL), AROUND, AROUND)
        return F.when(around.rlike(INTERVAL_ACTIVE) | ~around.rlike(INTERVAL_DUE), self.day(ANY_INTERVAL))

    def first_full_date(self) -> Column:
        """Stage 10: near the end only after a signal, elsewhere not near words of publication."""
        x = self.hit(FIRST_FULL)
        near_end = F.length("text") - x["at"] < 300
        good = F.when(near_end, _right(x["before"], 100).rlike(SIGNALS_BEFORE)).otherwise(~_window(x, 50, 50).rlike(PUBLICATION) & ~_right(x["before"], 150).rlike(ATTACHMENT))
        return self.result(FIRST_FULL, F.when(good, self.day(FIRST_FULL)))

    def only_date(self) -> Column:
        """Stage 11: the one date of a text."""
        x = F.try_element_at(self.m, F.lit(1))
        near_end = F.length("text") - x["at"] < 300
        kind = F.when(~near_end, F.when(_window(x, 50, 50).rlike(ALONE_DEADLINE), "deadline").otherwise("activity")).when(_window(x, 100, 100).rlike(ALONE_EVENT), "activity")
        good = (F.size(self.m) == 1) & kind.isNotNull() & ~F.array_contains("invalid", x["own"])
        return self.result(DateRule("11", ""), F.when(good, x["own"]), kind)

    def earliest_activity(self) -> Column:
        return self.result(DateRule("12", "activity"), F.array_min(F.array(*(self.day(r) for r in ACTIVITY_TIMES + VERBS), self.interval_candidate())))

    def run(self) -> Column:
        applied = [self.result(r, F.when(_right(self.hit(r)["before"], 100).contains("申报"), self.day(r))) for r in BEFORE]
        stages = [*self.at_once(LABELS), *applied, *self.at_once(COLLECTED + INTERVALS), self.picked_deadline()]
        stages += [*(self.by_words(r) for r in UNLABELLED), *self.at_once(LAST_INTERVALS), self.first_full_date(), self.only_date(), self.earliest_activity()]
        return F.coalesce(*stages)


def invalid_dates(text: Column, published: Column, m: Column) -> Column:
    """Stage 1: dates that are about persons, other periods or eligibility."""
    days = lambda p: F.regexp_extract_all(text, F.lit(p), 1)
    near = F.transform(days(rf"{PERSONAL}({FULL})"), lambda d: _day(d, published))
    iso = F.transform(days(rf"{PERSONAL}({ISO})"), lambda d: F.try_to_date(F.regexp_replace(d, "[/.]", "-"), "y-M-d"))
    none = F.array().cast("array<date>")
    all_of = lambda where, which, c: F.when(where, F.transform(F.filter(m, which), lambda x: x[c])).otherwise(none)
    eligible = F.regexp_extract(text, ELIGIBLE, 0)
    by_clause = F.when(eligible.rlike(ELIGIBLE_WORDS), F.array(_day(F.regexp_extract(text, ELIGIBLE, 1), published))).otherwise(none)
    finals = text.contains(FINALS_YEAR)
    return F.concat(
        near, iso, by_clause,
        all_of(text.rlike(OTHER_PERIODS), lambda x: x["year"].isNotNull(), "own"),
        all_of(finals & text.contains(FINALS_CUP), lambda x: F.lit(True), "plain"),
        all_of(finals, lambda x: x["before"].rlike(rf"{FINALS_YEAR}\z"), "own"),
    )


def with_notice_date(notices: DataFrame, out: str = "when") -> DataFrame:
    """Add ``out``, struct(kind, date, stage), to ``notices`` (text, published). Null where a text has no date
    that a stage accepts. Texts without any are told by one pass; no row moves."""
    text, published = F.col("text"), F.col("published")
    none = F.lit(False)
    for words in NO_DATE:
        none = none | text.contains(words)
    there = lambda c: F.when(F.col("m").isNotNull(), c)
    found, gaps, ends = F.col("found"), F.col("gaps"), F.col("ends")
    step = notices.withColumn("found", F.when(~none, F.regexp_extract_all(text, F.lit(MENTION), 0)))
    step = step.withColumn("found", F.when(F.size("found") > 0, found)).withColumn("gaps", F.when(found.isNotNull(), F.split(text, MENTION, -1)))
    step = step.withColumn("ends", F.when(found.isNotNull(), running_sums(F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.length(m) + F.length(g)))))
    step = step.withColumn("m", F.when(found.isNotNull(), mentions(text, published, found, gaps, ends))).drop("found", "gaps", "ends")
    step = step.withColumn("invalid", there(invalid_dates(text, published, F.col("m")))).withColumn("m", there(linked(F.col("m"))))
    p = Program()
    step = step.withColumn("hits", there(F.expr(f"array({', '.join('null' if r.whole else first_fit(r) for r in RULES)})")))
    step = step.withColumn("wholes", there(F.array(*(F.concat(*(F.regexp_extract("text", r.whole, g + 1) for g in range(groups_of(r.whole)))) for r in WHOLE))))
    step = step.withColumn("days", there(F.transform(F.array(*map(p.found, RULES)), lambda v: F.when(~F.array_contains("invalid", v), v))))
    return step.withColumn(out, there(p.run())).drop("m", "invalid", "hits", "wholes", "days")


def order_notices(spark, d) -> DataFrame:
    """Orders as notices (id, text, published): what is said depends on priority, status and number
    of lines, and the days are those of the order and of its first and last shipment."""
    cn = lambda c: F.concat(F.year(c), F.lit("年"), F.month(c), F.lit("月"), F.day(c), F.lit("日"))
    md = lambda c: F.concat(F.month(c), F.lit("月"), F.day(c), F.lit("日"))
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"), F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    days = {"{a}": cn("a"), "{b}": cn("b"), "{o}": cn("o_orderdate"), "{ma}": md("a"), "{mb}": md("b")}

    def said(column, wordings):
        out = F.lit("")
        for value, words in wordings.items():
            for name, day in days.items():
                words = words if isinstance(words, Column) else F.lit(words)
                words = F.replace(words, F.lit(name), F.coalesce(day, F.lit("")))
            out = F.when(F.col(column) == value, words).otherwise(out)
        return out

    parts = [said(c, w) for c, w in WORDINGS]
    return o.select(F.col("o_orderkey").alias("id"), F.concat(*parts).alias("text"), F.col("o_orderdate").cast("date").alias("published"))


#: What notices made of orders say: by number of lines, priority and status. {a}, {b}: first and last
#: shipment, with {ma}, {mb} without a year; {o}: the order.
WORDINGS = (
    ("n", {
        1: "参赛者名单见附件，{a}，比赛在体育馆举行。", 2: "出生日期{a}以后的学生可以参加。", 3: "请各队于{ma}前完成作品。", 4: "活动时间：{ma}，决赛时间：{b}。",
        5: "申报书由各系汇总，{a}前交。", 6: "参赛对象：{ma}以前正式注册的学生。", 7: "征集截止日期：{a}。",
    }),
    ("o_orderpriority", {"1-URGENT": "报名时间：{a}至{b}。", "2-HIGH": "即日起至{mb}接受投稿。", "3-MEDIUM": "{ma}-{mb}展示作品。", "5-LOW": "第二届大赛{mb}隆重开幕。"}),
    ("o_orderstatus", {"F": "报名截止：{mb}晚。发布日期{o}", "P": "开放时间：{a}—{b}。"}),
)


def deadline_sql() -> str:
    """The same program in SQL, from the same table of rules: mentions as a list of structs."""
    q = lambda p: "'" + p.replace("'", "''") + "'"

    def day(raw, published="published"):
        part = lambda p: f"nullif(regexp_extract({raw}, '{p}', 1), '')"
        month, number, year = part(r"(\d{1,2})月"), part(r"(\d{1,2})日"), part(r"(\d{4})年")
        at = lambda y: f"try_cast({y} || '-' || {month} || '-' || {number} AS DATE)"
        same, later = at(f"year({published})"), at(f"(year({published}) + 1)")
        return f"CASE WHEN {year} IS NOT NULL THEN {at(year)} WHEN date_diff('day', {same}, {published}) > 180 THEN coalesce({later}, {same}) ELSE coalesce({same}, {later}) END"

    def first(r):
        tests = [f"regexp_matches(x.before, {q(f'(?:{r.before})' + chr(92) + 'z')})"] if r.before else []
        tests += [f"regexp_matches(x.after, {q(f'^(?:{r.after})')})"] if r.after else []
        tests += [f"(x.year IS NOT NULL) = {r.year}"] if r.year is not None else []
        tests += [f"x.next_raw IS NOT NULL AND regexp_matches(x.gap, {q(f'^(?:{r.link})' + chr(92) + 'z')})"] if r.link else []
        tests += [f"(regexp_matches(x.next_raw, '年')) = {r.next_year}"] if r.link and r.next_year is not None else []
        return f"list_filter(m, lambda x: {' AND '.join(tests) or 'true'})[1]"

    place = {id(r): i + 1 for i, r in enumerate(RULES)}
    hit, got = (lambda r: f"hits[{place[id(r)]}]"), (lambda r: f"days[{place[id(r)]}]")
    right = lambda t, n: f"right({t}, {n})"

    def date(r):
        if r.whole:
            return day("(" + " || ".join(f"regexp_extract(text, {q(r.whole)}, {g + 1})" for g in range(groups_of(r.whole))) + ")")
        x = hit(r)
        e = f"{x}.own" if not r.link else f"{x}.inherited" if r.inherit else f"{x}.next"
        pattern, before, after = r.veto
        around = right(f"{x}.before", before) if before else f"left({x}.after, {after})"
        return f"CASE WHEN NOT regexp_matches({around}, {q(pattern)}) THEN {e} END" if pattern else e

    def result(r, e, kind=None):
        return f"CASE WHEN {e} IS NOT NULL THEN {{'kind': {kind or q(r.kind)}, 'date': {e}, 'stage': {q(r.stage)}}} END"

    window = lambda x, b, a: f"({right(f'{x}.before', b)} || left({x}.raw || {x}.after, {a}))"
    once = [result(r, f"(CASE WHEN contains({right(f'{hit(r)}.before', 100)}, '申报') THEN {got(r)} END)") for r in BEFORE]
    registering = [f"CASE WHEN regexp_matches({right(f'{hit(r)}.before', 100)}, '报名|申报') THEN {got(r)} END" for r in BEFORE] + [got(r) for r, flag in STRONG if flag]
    due = [got(r) for r in [*BEFORE, FROM_NOW, *(r for r, _ in STRONG)]]
    picked = f"coalesce(list_max([{', '.join(registering)}]), list_min([{', '.join(due)}]))"
    weigh = lambda ws, x: " + ".join(f"CASE WHEN regexp_matches({window(x, AROUND, AROUND)}, {q(p)}) THEN {n} ELSE 0 END" for n, p in ws)
    by_words = lambda r: result(r, got(r), f"CASE WHEN {weigh(DEADLINE_WORDS, hit(r))} > {weigh(ACTIVITY_WORDS, hit(r))} + 1 THEN 'deadline' ELSE 'activity' END")
    x, y, z = hit(FIRST_FULL), "m[1]", hit(ANY_INTERVAL)
    good = f"CASE WHEN length(text) - {x}.at < 300 THEN regexp_matches({right(f'{x}.before', 100)}, {q(SIGNALS_BEFORE)}) ELSE NOT regexp_matches({window(x, 50, 50)}, {q(PUBLICATION)}) AND NOT regexp_matches({right(f'{x}.before', 150)}, {q(ATTACHMENT)}) END"
    alone = f"CASE WHEN length(text) - {y}.at >= 300 THEN CASE WHEN regexp_matches({window(y, 50, 50)}, {q(ALONE_DEADLINE)}) THEN 'deadline' ELSE 'activity' END WHEN regexp_matches({window(y, 100, 100)}, {q(ALONE_EVENT)}) THEN 'activity' END"
    interval = f"CASE WHEN regexp_matches({window(z, AROUND, AROUND)}, {q(INTERVAL_ACTIVE)}) OR NOT regexp_matches({window(z, AROUND, AROUND)}, {q(INTERVAL_DUE)}) THEN {got(ANY_INTERVAL)} END"
    activities = f"list_min([{', '.join([*map(got, ACTIVITY_TIMES + VERBS), interval])}])"
    stages = [result(r, got(r)) for r in LABELS] + once + [result(r, got(r)) for r in COLLECTED + INTERVALS]
    stages += [result(DateRule("5", "deadline"), picked), *map(by_words, UNLABELLED), *(result(r, got(r)) for r in LAST_INTERVALS)]
    stages += [result(FIRST_FULL, f"(CASE WHEN {good} THEN {got(FIRST_FULL)} END)"), result(DateRule("11", ""), f"(CASE WHEN len(m) = 1 AND ({alone}) IS NOT NULL AND NOT list_contains(invalid, {y}.own) THEN {y}.own END)", f"({alone})"), result(DateRule("12", "activity"), activities)]
    days = lambda p, g=1: f"regexp_extract_all(text, {q(p)}, {g})"
    said = " || ".join(
        "CASE " + " ".join(f"WHEN {c} = {v if isinstance(v, int) else q(v)} THEN " + "replace(replace(replace(replace(replace(" + q(w) + ", '{a}', coalesce(ca, '')), '{b}', coalesce(cb, '')), '{o}', co), '{ma}', coalesce(ma, '')), '{mb}', coalesce(mb, ''))" for v, w in ws.items()) + " ELSE '' END"
        for c, ws in WORDINGS
    )
    cn = lambda c: f"year({c}) || '年' || month({c}) || '月' || day({c}) || '日'"
    md = lambda c: f"month({c}) || '月' || day({c}) || '日'"
    inherited = "CASE WHEN NOT regexp_matches(found[i + 1], '年') AND regexp_matches(found[i], '年') THEN " + day("(regexp_extract(found[i], '(\\d{4}年)', 1) || found[i + 1])") + f" ELSE {day('found[i + 1]')} END"
    plain = day("regexp_replace(found[i], '\\d{4}年', '')")
    return rf"""
WITH s AS (SELECT l_orderkey, min(l_shipdate) AS a, max(l_shipdate) AS b, count(*) AS n FROM lineitem GROUP BY 1),
w AS (SELECT *, {cn('a')} AS ca, {cn('b')} AS cb, {cn('o_orderdate')} AS co, {md('a')} AS ma, {md('b')} AS mb FROM orders LEFT JOIN s ON o_orderkey = l_orderkey),
t AS (SELECT o_orderkey AS id, {said} AS text, CAST(o_orderdate AS DATE) AS published FROM w),
f AS (SELECT *, regexp_extract_all(text, {q(MENTION)}) AS found, string_split_regex(text, {q(MENTION)}) AS gaps FROM t),
p AS (SELECT *, list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0)) AS places FROM f),
e AS (SELECT *, list_transform(range(1, len(found) + 1), lambda i: {{
  'at': places[i], 'raw': found[i], 'year': nullif(regexp_extract(found[i], '(\d{{4}})年', 1), ''), 'own': {day('found[i]')}, 'plain': {plain},
  'before': right(left(text, CAST(places[i] AS BIGINT)), {AROUND}), 'after': substr(text, CAST(places[i] + length(found[i]) + 1 AS BIGINT), {AROUND}), 'gap': gaps[i + 1],
  'next_raw': found[i + 1], 'next': {day('found[i + 1]')}, 'inherited': {inherited}}}) AS m FROM p),
i AS (SELECT *,
  list_transform({days(PERSONAL + '(' + FULL + ')')}, lambda v: {day('v')}) || list_transform({days(PERSONAL + '(' + ISO + ')')}, lambda v: try_cast(regexp_replace(v, '[/.]', '-', 'g') AS DATE))
  || CASE WHEN regexp_matches(regexp_extract(text, {q(ELIGIBLE)}, 0), {q(ELIGIBLE_WORDS)}) THEN [{day(f'regexp_extract(text, {q(ELIGIBLE)}, 1)')}] ELSE [] END
  || CASE WHEN regexp_matches(text, {q(OTHER_PERIODS)}) THEN list_transform(list_filter(m, lambda x: x.year IS NOT NULL), lambda x: x.own) ELSE [] END AS invalid
  FROM e),
h AS (SELECT *, [{', '.join('NULL' if r.whole else first(r) for r in RULES)}] AS hits FROM i),
c AS (SELECT *, list_transform([{', '.join(map(date, RULES))}], lambda v: CASE WHEN NOT list_contains(invalid, v) THEN v END) AS days FROM h)
SELECT id, r.kind AS kind, r.date AS date, r.stage AS stage FROM (SELECT id, coalesce({', '.join(stages)}) AS r FROM c)
"""


@query("K11_date_program", deadline_sql())
def date_program(spark, d):
    """The date of every order's notice by all stages."""
    return once_each(order_notices(spark, d), ["text", "published"], with_notice_date).select("id", "when.kind", "when.date", "when.stage")


_NOTICES = deadline_sql().split("f AS (SELECT")[0].rstrip().rstrip(",")


@query(
    "K34_label_block",
    _NOTICES + r""" SELECT id, nullif(trim(regexp_extract(text, '(?:活动时间|报名时间|征集截止日期)\s*[:：]\s*([^\n]{1,200}?)(?:\s*(?:决赛时间|报名截止|开放时间)\s*[:：]|\n|$)', 1)), '') AS value FROM t""",
)
def label_block(spark, d):
    """What follows a label in every order's notice, to the next label or the end of its line."""
    return order_notices(spark, d).select("id", labelled(F.col("text"), ["活动时间", "报名时间", "征集截止日期"], ["决赛时间", "报名截止", "开放时间"]).alias("value"))


@query(
    "K38_label_and_lines",
    _NOTICES + r""", u AS (SELECT id, string_split(regexp_extract(regexp_replace(text, '。', chr(10), 'g'), '(?:活动时间|征集截止日期|出生日期)\s*[:：]([^\n]*(?:\n[^\n]+){0,2})', 1), chr(10)) AS l, regexp_matches(text, '(?:活动时间|征集截止日期|出生日期)\s*[:：]') AS hit FROM t),
        v AS (SELECT *, len(l) > 1 AND NOT regexp_matches(l[2], '^[^\n:：]{1,12}[:：]') AS two, len(l) > 2 AND NOT regexp_matches(l[3], '^[^\n:：]{1,12}[:：]') AS three FROM u)
        SELECT id, nullif(trim(CASE WHEN hit THEN l[1] || CASE WHEN two THEN chr(10) || l[2] || CASE WHEN three THEN chr(10) || l[3] ELSE '' END ELSE '' END END), '') AS head FROM v""",
)
def label_and_lines(spark, d):
    """The rest of a label's line and what follows it without a label; sentences are lines here."""
    text = F.replace("text", F.lit("。"), F.lit("\n"))
    return order_notices(spark, d).select("id", with_following(text, "(?:活动时间|征集截止日期|出生日期)").alias("head"))
