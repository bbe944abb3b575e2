"""Fields from text by ordered rules (survey section K)."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapsed, contains_any
from ..plans.views import table
from ..registry import query

DATE = r"(\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?)"
SHORT = r"((?:\d{4}[-/.年])?\d{1,2}[-/.月]\d{1,2}日?)"


@dataclass(frozen=True)
class DateRule:
    """A pattern with the date in its group 1. ``kind``: deadline or activity. Text right before the
    match may forbid it (``never_after``)."""

    kind: str
    pattern: str
    never_after: str = ""


#: First hit wins: labels, "before" phrases, ends of intervals, then activity times.
DATE_RULES = [
    DateRule("deadline", rf"(?:报名|申报|提交|征集|投稿)?截[止至](?:时间|日期)?[^0-9]{{0,10}}{SHORT}"),
    DateRule("deadline", rf"(?:报名|申报|提交|征集)(?:时间|日期)[^0-9]{{0,6}}{SHORT}\s*[-—~至到]+\s*{SHORT}"),
    DateRule("deadline", rf"(?:于|在|请)?\s*{SHORT}(?:[^0-9，。]{{0,12}})?(?:之?前|以前)"),
    DateRule("deadline", rf"即日起?[^0-9]{{0,4}}至\s*{SHORT}"),
    DateRule("deadline", rf"(?i)(?:deadline|due|closes?|apply by|until)[^0-9]{{0,12}}{SHORT}"),
    DateRule("activity", rf"(?:比赛|活动|举办|决赛|初赛|竞赛)(?:时间|日期)[^0-9]{{0,6}}{SHORT}"),
    DateRule("activity", rf"{SHORT}[^0-9。]{{0,10}}(?:举行|举办|开展|进行|召开)"),
    DateRule("activity", DATE),
]

_NEVER = r"(出生|年龄|身份证|周岁)[^。]{0,12}$"


def _iso(found: Column, published: Column) -> Column:
    """Text of a date, the year completed from the publish date, -> date or null."""
    parts = F.filter(F.split(found, r"\D+"), lambda x: x != "")
    full, short = F.size(parts) == 3, F.size(parts) == 2
    same = F.try_to_date(F.concat_ws("-", F.year(published), F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))), "y-M-d")
    after = F.try_to_date(F.concat_ws("-", F.year(published) + 1, F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))), "y-M-d")
    return F.when(full, F.try_to_date(F.array_join(parts, "-"), "y-M-d")).when(short, F.when(F.datediff(published, same) > 180, after).otherwise(same))


def notice_date(text: Column, published: Column, rules=None) -> Column:
    """struct(kind, date) of the first rule that gives an existing day, else null (K10, K11). Rules
    with two groups are intervals and give their end."""
    out = F.lit(None).cast("struct<kind: string, date: date>")
    for r in reversed(rules or DATE_RULES):
        group = min(2, re.compile(r.pattern).groups)
        found = F.regexp_extract(text, r.pattern, group)
        # The text before the match decides whether it is a birthday or the like.
        before = F.split_part(text, found, F.lit(1))
        day = F.when((found != "") & ~before.rlike(r.never_after or _NEVER), _iso(found, published))
        out = F.coalesce(F.when(day.isNotNull(), F.struct(F.lit(r.kind).alias("kind"), day.alias("date"))), out)
    return out


def labelled(text: Column, labels: list[str], stops: list[str], most: int = 200) -> Column:
    """What follows a label, to the next heading or the end of the line."""
    names = "|".join(map(re.escape, labels))
    ends = "|".join(map(re.escape, stops))
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?:{names})\s*[:：]\s*([^\n]{{1,{most}}}?)(?=\s*(?:{ends})\s*[:：]|\n|$)", 1)), F.lit(""))


#: Names of hosts of events end in one of these.
UNITS = ["大学", "学院", "委员会", "协会", "学会", "中心", "部", "处", "厅", "局", "University", "College", "Committee", "Society"]


def organizer(text: Column) -> Column:
    """Labelled hosts, cut at punctuation, valid if short and named like an organisation (parts of K12 to K15)."""
    value = labelled(text, ["主办单位", "主办方", "主办", "organizer", "Organizer"], ["承办单位", "协办单位", "承办", "协办"])
    first = F.trim(F.regexp_replace(F.split(value, "[,，;；。]")[0], r"^(由|为|是)", ""))
    digits = F.length(F.regexp_replace(first, r"\D", ""))
    return F.when((F.length(first) <= 60) & (digits < 3) & contains_any(first, UNITS), first)


def contacts(text: Column) -> Column:
    """struct(mails, phones, sites): distinct, in order."""
    find = lambda p: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))
    return F.struct(
        find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}").alias("mails"),
        find(r"(?<![0-9])(?:1[3-9][0-9]{9}|[0-9]{3,4}-[0-9]{7,8}|[0-9]{3}-[0-9]{4})(?![0-9])").alias("phones"),
        find(r"https?://[A-Za-z0-9./?=&_%-]+").alias("sites"),
    )


def contact_line(c: Column) -> Column:
    """Contacts as one line, null if there are none."""
    part = lambda name, label: F.when(F.size(c[name]) > 0, F.concat(F.lit(label), F.array_join(c[name], ",")))
    return F.nullif(F.concat_ws(";", part("phones", "phone:"), part("mails", "mail:"), part("sites", "site:")), F.lit(""))


AWARDS = r"(特等奖|一等奖|二等奖|三等奖|优秀奖|金奖|银奖|铜奖)"


def awards(text: Column) -> Column:
    """struct(levels, counts, money): distinct, in order."""
    find = lambda p, g=0: F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(g)))
    return F.struct(find(AWARDS, 1).alias("levels"), find(AWARDS + r"\s*\d+\s*[名项个]").alias("counts"), find(r"\d+(?:\.\d+)?\s*万?元").alias("money"))


TAGS = [("online", ["线上", "online"]), ("team", ["团队", "组队", "team"]), ("award", ["一等奖", "奖金", "award"]), ("license", ["icensed", "License"]), ("mail", ["@"]), ("table", ["|"])]


def tags(text: Column, rules=None, most: int = 10) -> Column:
    """Tags of which a trigger occurs, in the order of the rules."""
    return F.slice(F.array_compact(F.array(*[F.when(contains_any(text, ws), tag) for tag, ws in (rules or TAGS)])), 1, most)


INTENTS = [("explain", ["why", "warum", "pourquoi"]), ("plan", ["plan", "step"]), ("list", ["list", "all", "und"]), ("faq", ["how", "?", "wie"])]


def intent(text: Column, rules=None, default: str = "recommend") -> Column:
    """The first intent one of whose words occurs."""
    out = F.lit(default)
    for name, words in reversed(rules or INTENTS):
        out = F.when(contains_any(F.lower(text), words), name).otherwise(out)
    return out


def parse_all(title: Column, content: Column, publisher: Column, published: Column) -> Column:
    """All fields of a notice in one struct."""
    text = F.concat_ws(" ", title, content, publisher)
    return F.struct(notice_date(text, published).alias("when"), organizer(content).alias("organizer"), labelled(content, ["参赛对象", "参加对象", "面向对象"], ["奖项", "报名", "联系"]).alias("participants"), awards(text).alias("awards"), contacts(text).alias("contacts"), tags(text).alias("tags"))


@query("K30_contacts", "SELECT doc_id, list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}')) IS NOT NULL AS ok, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'))) AS mails, len(list_distinct(regexp_extract_all(text, 'https?://[A-Za-z0-9./?=&_%-]+'))) AS sites FROM documents")
def contacts_query(spark, d):
    c = contacts(F.col("text"))
    return table(spark, d, "documents").withColumn("c", c).select("doc_id", F.col("c").isNotNull().alias("ok"), F.size("c.mails").cast("long").alias("mails"), F.size("c.sites").cast("long").alias("sites"))


@query("K32_tags", "SELECT doc_id, list_filter([CASE WHEN regexp_matches(text, '线上|online') THEN 'online' END, CASE WHEN regexp_matches(text, '团队|组队|team') THEN 'team' END, CASE WHEN regexp_matches(text, '一等奖|奖金|award') THEN 'award' END, CASE WHEN regexp_matches(text, 'icensed|License') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'mail' END, CASE WHEN contains(text, '|') THEN 'table' END], lambda x: x IS NOT NULL) AS tags FROM documents")
def tags_query(spark, d):
    return table(spark, d, "documents").select("doc_id", tags(F.col("text")).alias("tags"))


@query("K42_intent", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'why|warum|pourquoi') THEN 'explain' WHEN regexp_matches(lower(text), 'plan|step') THEN 'plan' WHEN regexp_matches(lower(text), 'list|all|und') THEN 'list' WHEN regexp_matches(lower(text), 'how|\\?|wie') THEN 'faq' ELSE 'recommend' END AS intent FROM conversations WHERE role = 'user'")
def intent_query(spark, d):
    """Intent of user messages."""
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", intent(F.col("text")).alias("intent"))


@query("K43_signals", "SELECT conv_id, turn, len(list_filter(string_split_regex(lower(text), '[\\s,;]+'), lambda x: length(x) >= 2)) AS tokens, regexp_matches(lower(text), 'new|recent|neu') AS recent FROM conversations")
def signals(spark, d):
    from ..functions.text import tokens

    return table(spark, d, "conversations").select("conv_id", "turn", F.size(tokens(F.col("text"))).cast("long").alias("tokens"), F.lower("text").rlike("new|recent|neu").alias("recent"))


@query("K33_parse_all")
def parse_all_query(spark, d):
    """Every field of every document in one projection; the fields' rules are tested on notices."""
    docs = table(spark, d, "documents").withColumn("day", F.lit("2024-06-15").cast("date"))
    return docs.select("doc_id", parse_all(F.substring("text", 1, 60), F.col("text"), F.col("source"), F.col("day")).alias("p")).select("doc_id", F.col("p.when.kind").alias("kind"), F.col("p.when.date").alias("date"), "p.organizer", F.size("p.contacts.mails").alias("mails"), "p.tags")


@query("J16_clean_text", "SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages")
def clean_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(collapsed(F.regexp_replace("html", "<[^>]*>", " "))).cast("long").alias("n"))
