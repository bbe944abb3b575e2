"""Award blocks and participants against plain loops over lines, and on notices."""

import random
import re

from pyspark.sql import functions as F

from noticewright.operators import blocks as B

TAIL = re.compile(r"[，。；;、\s]+\Z")


def levels(lines):
    run = []
    for line in [*map(str.strip, lines), "end"]:
        m = re.match(r"(特等奖|一等奖|二等奖|三等奖|优秀奖)\s*[：:]\s*(.+)$", line)
        names = TAIL.sub("", m[2]) if m else ""
        if names and len(names) <= 120 and not re.search(B.NOT_WINNERS, names):
            run.append(f"{m[1]}：{names}")
        elif line or not run:
            if len(run) >= 2:
                return "；\n\n".join(run) + "。"
            run = []
    return None


def table(lines):
    seen, rows = False, []
    for raw in lines:
        line, cells = raw.strip(), re.search(r"\t|\s{2,}", raw.rstrip())
        if not line:
            continue
        if not rows:
            seen = seen or any(w in line for w in B.WINNERS)
            columns = [c for c in re.split(r"[\t|]+|\s{2,}", line) if c.strip()]
            has = lambda words, columns=columns: any(w in c for c in columns for w in words)
            if cells and len(columns) >= 3 and has(B.AWARD_COLUMNS) and has(B.NAME_COLUMNS) and (seen or has(B.OTHER_COLUMNS)):
                rows = [line]
        elif re.match(r"(?:备注|说明|联系方式|联系人|报名|参赛|时间安排|附件)(?!\w)|注[:：](?=\w)", line) or not cells and len(line) >= 18:
            break
        elif cells and re.search(B.LEVELS, line):
            rows.append(line)
    return "\n".join(rows) if len(rows) > 1 else None


ORDINAL = r"(?:[（(]?[一二三四五六七八九十0-9]+[)）][、.]?\s*|[一二三四五六七八九十0-9]+[、.．]\s*)"


def section(lines):
    label, rows = None, []
    for raw in lines:
        line = raw.strip()
        m = re.match(B.SECTION, line)
        if not line:
            continue
        if label is None:
            if m:
                label, rows = m[1], [m[2].strip()] if m[2].strip() else []
            continue
        about = lambda start, words, line=line: re.match(start, line) and re.search(words, line)
        if m or re.match(B.OTHER_SECTION.replace(r"[\p{L}\p{N}_]", r"\w"), line):
            break
        if re.match(ORDINAL, line) and not about(B.BRACKETED, B.BRACKETED_WORDS) and not about(B.NUMBERED, B.NUMBERED_WORDS):
            break
        rows.append(line)
    text = re.sub(B.LEAD_IN, "", re.sub(r"[ \t]+", " ", "\n".join(rows)).strip()).strip()
    if not text:
        return None
    return text if re.match(r"[（(][一二三四五六七八九十0-9]+[)）]|\d+\s*[.．、]", text) else f"{label}：{text}"


def people(text, lines):
    for i, line in enumerate(lines):
        if m := re.search(B.PEOPLE_LABEL, line):
            value = m[1].strip() or (lines[i + 1].strip() if i + 1 < len(lines) else "")
            if value and not re.match(B.HEADING, value) and (found := re.split("[。；;]", value)[0].strip()):
                return found
    return "；".join(dict.fromkeys(m[0] for m in re.finditer(B.PEOPLE, text))) or None


PIECES = [
    "一等奖：张三、李四；", "二等奖: 王五", "三等奖 ：赵六", "一等奖：见通知", "优秀奖：", "", "  ", "一、奖项设置", "二、奖励办法：如下 设三等", "奖项介绍", "1. 一等奖两名", "2. 其他", "（一）获奖比例另行规定", "（二）别的", "三、参赛对象：全体本科生。另", "联系方式",
    "获奖名单如下", "姓名\t学院\t奖项", "张三\t文学院\t一等奖", "李四  理学院  二等奖", "王五\t无\t无", "备注：无", "报名方式", "这是一行没有分列的很长的说明文字一共二十个字以上", "短句", "注：略", "参赛资格：", "在校研究生；", "open to all students", "普通一行", "作品  题目  奖次  班级", "及晋级 前三名",
]


def test_folds_equal_loops(spark):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).select("i", B.blocks(F.col("t")).alias("b"))
    got = {r["i"]: r["b"] for r in df.collect()}
    seen = {"levels": 0, "table": 0, "section": 0, "participants": 0}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        want = {"levels": levels(lines), "table": table(lines), "section": section(lines), "participants": people(t, lines)}
        for k, v in want.items():
            assert got[i][k] == v, (k, t, got[i][k], v)
            seen[k] += v is not None
    assert all(n > 20 for n in seen.values()), seen


def test_sentences_and_order(spark):
    cases = [
        ("大赛说明。比赛设置一等奖2名、二等奖4名，获奖比例为参赛者的百分之十。优秀指导教师若干，另行评选。其他。", "比赛设置一等奖2名、二等奖4名，获奖比例为参赛者的百分之十。优秀指导教师若干，另行评选。"),
        ("决赛设一等奖、二等奖和优秀指导教师奖等奖项。", "决赛设一等奖、二等奖和优秀指导教师奖等奖项。"),
        ("设置一等奖。", None),
        ("活动设置一等奖三名，报名截止另行通知。", None),
        ("一等奖：甲乙\n二等奖：丙丁\n奖项设置：比赛设置一等奖三名，二等奖五名。", "一等奖：甲乙；\n\n二等奖：丙丁。"),
        ("奖项设置：如下 一等奖三名", "奖项设置：一等奖三名"),
        ("没有内容", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r["i"]: r["a"] for r in df.select("i", B.award_text(B.blocks(F.col("t"))).alias("a")).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases
