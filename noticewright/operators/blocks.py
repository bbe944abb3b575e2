"""Fields that span lines: award lists, tables, sections and sentences, participants, labels with what
follows (survey rows K21 to K28, K38).

A text's lines are folded from the first to the last with a state of a few fields, inside the JVM;
texts that name no award or group aren't split at all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..plans.views import table
from ..registry import query

# Fixed values from here on: names of awards and columns, headings, and words that veto.
LEVELS = r"特等奖|一等奖|二等奖|三等奖|优秀奖"
LEVEL_LINE = rf"^({LEVELS})\s*[：:]\s*(.+)$"
NOT_WINNERS = r"通知|如下|评选|现场|证书|老师|同学|学院|活动|比赛|大赛"
WINNERS = ("获奖名单", "获奖人员")
NAME_COLUMNS = ("姓名", "成员", "队员", "获奖人", "获奖者", "选手", "作品", "项目", "题目")
AWARD_COLUMNS = ("奖项", "奖次", "奖级", "奖别", "获奖等级")
OTHER_COLUMNS = ("团队名称", "团队", "指导老师", "学院", "专业", "班级")
TABLE_END = r"^(?:(?:备注|说明|联系方式|联系人|报名|参赛|时间安排|附件)(?![\p{L}\p{N}_])|注[:：](?=[\p{L}\p{N}_]))"
ORDINAL = r"(?:[（(]?[一二三四五六七八九十0-9]+[)）][、.]?\s*|[一二三四五六七八九十0-9]+[、.．]\s*)"
SECTION = rf"^\s*{ORDINAL}?(奖项介绍|奖项设置|奖励设置|奖励办法|奖项说明|奖项及奖励|奖励标准|奖项与奖励)\s*[:：]?\s*(.*)$"
OTHER_SECTION = rf"^\s*{ORDINAL}?(?:参赛对象|参与对象|竞赛对象|奖励对象|参赛资格|报名条件|报名方式|报名要求|联系方式|联系渠道|比赛流程|时间安排|提交方式|组织单位|主办单位|承办单位)(?![\p{{L}}\p{{N}}_])"
ANY_SECTION = rf"^\s*{ORDINAL}"
BRACKETED, BRACKETED_WORDS = r"^\s*[（(][一二三四五六七八九十0-9]+[)）]", r"省赛|国赛|证书发放|获奖|奖项|比例|综测|校赛"
NUMBERED, NUMBERED_WORDS = r"^\s*\d+\s*[.．、]\s*", r"一等奖|二等奖|三等奖|优秀奖|获奖|奖项|证书|奖品|比例|综测|校赛"
LEAD_IN = r"^(?:及晋级|如下|如下所示|说明如下)\s*"
SENTENCES = (
    r"((?:校赛|比赛|本次|本赛|赛事|活动)?设置[^。]{0,220}?(?:特等奖|一等奖|二等奖|三等奖|优秀奖)[^。]{0,260}?获奖比例[^。]{0,260}?。)",
    r"((?:校赛|比赛|本次|本赛|赛事|活动)?设置[^。]{0,220}?(?:特等奖|一等奖|二等奖|三等奖|优秀奖)[^。]{0,260}?。)",
    r"((?:校赛|校赛决赛|决赛|比赛|本次|本赛|赛事|活动)?设[^。]{0,260}?(?:一等奖|二等奖|三等奖|优秀指导(?:老|教)师奖)[^。]{0,260}?等奖项。)",
)
NOT_AWARDS = r"联系人|报名|时间|地点|附件|缴费|收费"
TEACHERS = r"^\s*([^。]{0,120}(?:优秀指导(?:老|教)师)[^。]{0,160})。"
PEOPLE_LABEL = r"(?:参赛对象|参加对象|面向对象|参赛资格|(?i:who may enter|open to))\s*[:：]?\s*(.*)$"
PEOPLE = r"(?:全体|全校|在校|全日制)?(?:本科生|研究生|本专科生|大学生|学生)|(?i:\b(?:all students|undergraduates|graduates)\b)"
HEADING = r"^\s*(?:[一二三四五六七八九十]+[、.．]|[（(][一二三四五六七八九十\d]+[)）]|\d+[、.．](?!\d)|#+ )\s*\S"
EVERYONE = "全体学生"
# End of the fixed values.

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
TAIL = r"[，。；;、\s]+\z"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), BREAK, -1)


def _empty(v: Column) -> Column:
    return F.nullif(v, F.lit(""))


def _trim(v: Column) -> Column:
    return F.regexp_replace(v, r"^\s+|\s+\z", "")


def award_levels(lines: Column) -> Column:
    """The first two consecutive lines and more "level: names", blank lines between them allowed."""
    state = lambda done, run: F.struct(done.alias("done"), run.alias("run"))
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("array<string>")

    def step(s, raw):
        line = _trim(raw)
        names = F.regexp_replace(F.regexp_extract(line, LEVEL_LINE, 2), TAIL, "")
        winners = line.rlike(LEVEL_LINE) & (names != "") & (F.length(names) <= 120) & ~names.rlike(NOT_WINNERS)
        said = F.concat(F.regexp_extract(line, LEVEL_LINE, 1), F.lit("："), names)
        return F.when(s["done"].isNotNull() | ((line == "") & (F.size(s["run"]) > 0)), s).when(winners, state(s["done"], F.concat(s["run"], F.array(said)))).otherwise(state(F.when(F.size(s["run"]) >= 2, s["run"]), none))

    last = lambda s: F.coalesce(s["done"], F.when(F.size(s["run"]) >= 2, s["run"]))
    run = F.aggregate(lines, state(nothing, none), step, last)
    return F.when(run.isNotNull(), F.concat(F.array_join(run, "；\n\n"), F.lit("。")))


def award_table(lines: Column) -> Column:
    """A header of three columns and more, of awards and of names or works, and the rows under it that
    name a level; a list of winners has to be announced before, or further columns be there (K25)."""
    state = lambda phase, seen, rows: F.struct(phase.cast("int").alias("phase"), seen.alias("seen"), rows.alias("rows"))
    none = F.array().cast("array<string>")

    def step(s, raw):
        line, cells = _trim(raw), F.regexp_replace(raw, r"\s+\z", "").rlike(r"\t|\s{2,}")
        columns = F.filter(F.split(line, r"[\t|]+|\s{2,}"), lambda c: F.trim(c) != "")
        has = lambda words: F.exists(columns, lambda c: contains_any(c, words))
        seen = s["seen"] | contains_any(line, WINNERS)
        header = cells & (F.size(columns) >= 3) & has(AWARD_COLUMNS) & has(NAME_COLUMNS) & (seen | has(OTHER_COLUMNS))
        ends = line.rlike(TABLE_END) | (~cells & (F.length(line) >= 18))
        looking = F.when(header, state(F.lit(1), seen, F.array(line))).otherwise(state(F.lit(0), seen, none))
        inside = F.when(ends, state(F.lit(2), s["seen"], s["rows"])).when(cells & line.rlike(LEVELS), state(F.lit(1), s["seen"], F.concat(s["rows"], F.array(line)))).otherwise(s)
        return F.when((s["phase"] == 2) | (line == ""), s).when(s["phase"] == 0, looking).otherwise(inside)

    return F.aggregate(lines, state(F.lit(0), F.lit(False), none), step, lambda s: F.when(F.size(s["rows"]) > 1, F.array_join(s["rows"], "\n")))


def award_section(lines: Column) -> Column:
    """The lines under a heading of awards, up to the next section; numbered clauses about awards
    belong to it (K26)."""
    state = lambda phase, label, tail, rows: F.struct(phase.cast("int").alias("phase"), label.alias("label"), tail.alias("tail"), rows.alias("rows"))
    none = F.array().cast("array<string>")

    def step(s, raw):
        line = _trim(raw)
        tail = _trim(F.regexp_extract(line, SECTION, 2))
        start = state(F.lit(1), F.regexp_extract(line, SECTION, 1), tail, F.when(tail != "", F.array(tail)).otherwise(none))
        clause = (line.rlike(BRACKETED) & line.rlike(BRACKETED_WORDS)) | (line.rlike(NUMBERED) & line.rlike(NUMBERED_WORDS))
        ends = line.rlike(OTHER_SECTION) | line.rlike(SECTION) | (line.rlike(ANY_SECTION) & ~clause)
        more = state(F.lit(1), s["label"], s["tail"], F.concat(s["rows"], F.array(line)))
        done = state(F.lit(2), s["label"], s["tail"], s["rows"])
        return F.when((s["phase"] == 2) | (line == ""), s).when(s["phase"] == 0, F.when(line.rlike(SECTION), start).otherwise(s)).when(ends, done).otherwise(more)

    def told(s):
        text = _trim(F.regexp_replace(F.trim(F.regexp_replace(F.array_join(s["rows"], "\n"), r"[ \t]+", " ")), LEAD_IN, ""))
        clauses = text.rlike(r"^\s*(?:[（(][一二三四五六七八九十0-9]+[)）]|\d+\s*[.．、])")
        return F.when(text == "", F.lit(None)).when(clauses, text).otherwise(F.concat(s["label"], F.lit("："), text))

    return F.aggregate(lines, state(F.lit(0), F.lit(""), F.lit(""), none), step, told)


def award_sentence(text: Column) -> Column:
    """A sentence that sets up awards, of a dozen characters and more and of nothing else, with the
    next one if that is about teachers (K27)."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))

    def of(pattern):
        said = F.regexp_replace(_trim(F.regexp_extract(t, pattern, 1)), TAIL, "")
        after = F.element_at(F.split(t, pattern, 2), 2)
        extra = F.regexp_replace(_trim(F.regexp_extract(after, TEACHERS, 1)), TAIL, "")
        more = F.when((extra != "") & ~said.contains(extra), F.concat(extra, F.lit("。"))).otherwise("")
        return F.when((F.length(said) >= 12) & ~said.rlike(NOT_AWARDS), F.concat(said, F.lit("。"), more))

    return F.coalesce(*map(of, SENTENCES))


def participants(text: Column, lines: Column) -> Column:
    """After a label, to the end of its line or on the next one; else the groups named in passing (part of K21)."""
    state = lambda done, waits: F.struct(done.alias("done"), waits.alias("waits"))
    nothing = F.lit(None).cast("string")
    cut = lambda v: _empty(_trim(F.element_at(F.split(v, "[。；;]"), 1)))
    good = lambda v: F.when((v != "") & ~v.rlike(HEADING), cut(v))

    def step(s, raw):
        own = _trim(F.regexp_extract(raw, PEOPLE_LABEL, 1))
        label = raw.rlike(PEOPLE_LABEL)
        waited = F.when(s["waits"], good(_trim(raw)))
        found = F.coalesce(waited, F.when(label, good(own)))
        return F.when(s["done"].isNotNull(), s).otherwise(state(found, F.coalesce(found.isNull() & label & (own == ""), F.lit(False))))

    labelled = F.aggregate(lines, state(nothing, F.lit(False)), step, lambda s: s["done"])
    named = F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(PEOPLE), 0)), "；")
    return F.coalesce(labelled, _empty(named))


def blocks(text: Column) -> Column:
    """struct(levels, table, section, sentence, participants) of a text."""
    lines = _lines(text)
    awards = lambda c: F.when(text.contains("奖"), c)
    people = F.when(text.rlike(r"(?i)对象|资格|生|who may enter|open to|graduates|all students"), participants(text, lines))
    return F.struct(awards(award_levels(lines)).alias("levels"), awards(award_table(lines)).alias("table"), awards(award_section(lines)).alias("section"), awards(award_sentence(text)).alias("sentence"), people.alias("participants"))


def award_text(b: Column) -> Column:
    """Level list, else table, else section, else sentence."""
    return F.coalesce(b["levels"], b["table"], b["section"], b["sentence"])


def with_following(text: Column, label: str, lines: int = 2) -> Column:
    """The rest of a label's line and up to ``lines`` more that hold no label."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"{label}\s*[:：]([^\n]*(?:\n(?![^\n:：]{{1,12}}[:：])[^\n]+){{0,{lines}}})", 1)), F.lit(""))


@query("K24_award_blocks")
def award_blocks(spark, d):
    """Award text and participants of every document (K21 to K27); the rules are held against brute
    force and notices in tests."""
    found = table(spark, d, "documents").select("doc_id", blocks(F.col("text")).alias("b"))
    return found.select("doc_id", award_text(F.col("b")).alias("awards"), F.coalesce("b.participants", F.lit(EVERYONE)).alias("participants"))
