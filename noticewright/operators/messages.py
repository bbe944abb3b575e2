"""What messages say about their writers (survey rows K40, K41), names inside texts and texts inside
names (E17, E18), and titles in the order of a language (H8).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, normalised
from ..plans.views import notices, table
from ..registry import query

#: A pattern for each field of a profile, and categories by their words.
FIELDS = {
    "major": r"(会计|统计|数学|外语|英语|计算机|软件|金融|工商管理|旅游|酒店|艺术|设计|信息工程|信息管理|经济学|经济|经贸)[学院系专业]?",
    "college": r"(会计学院|统计与数学学院|外国语学院|信息工程学院|信息管理学院|工商管理学院|旅游与酒店管理学院|艺术学院|金融学院|经济与贸易学院)",
    "experience": r"(无参赛经验|无经验|没经验|有参赛经验|有经验|新手|入门|熟练|经验丰富)",
    "year": r"(大一|大二|大三|大四|研一|研二|研三)",
    "target": r"(?i)(校级|省级|国家级|a\+|a类|冲奖|保底)",
    "hours": r"每周.{0,3}(\d+)\s*小时",
}
INTERESTS = {
    "英语外语学科竞赛": ("英语", "外语", "演讲", "翻译"), "数学建模、统计调研类专业竞赛": ("数学", "建模", "统计", "调研"), "经管商科、企业运营模拟类竞赛": ("经管", "商科", "企业", "运营"),
    "计算机、软件、数字设计艺术类竞赛": ("计算机", "软件", "设计"), "创新创业高水平A+/A类竞赛": ("创新", "创业", "挑战杯"), "心理健康&思政德育类活动": ("心理", "思政", "德育"), "文体体育类赛事活动": ("文体", "体育", "运动会"),
}
MOST_INTERESTS = 8
#: Characters of a text by which names that may hold it are looked up.
GRAM = 6


def profiles(messages: DataFrame, fields=None, interests=None) -> DataFrame:
    """One row per user of ``messages`` (user, turn, text): the last capture of each field over the turns, and
    the interests in the order in which they came up (K40).

    Aggregates only, so a user of any number of messages is combined before anything is shuffled.
    There are fewer categories than ``MOST_INTERESTS``, so none is pushed out and comes again.
    """
    fields, interests = fields or FIELDS, interests or INTERESTS
    if len(interests) > MOST_INTERESTS:
        raise ValueError(f"at most {MOST_INTERESTS} categories")
    text = F.coalesce(F.col("text"), F.lit(""))
    found = {name: F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for name, p in fields.items()}
    last = [F.max_by(c, F.when(c.isNotNull(), F.col("turn"))).alias(name) for name, c in found.items()]
    hit = [F.min(F.when(contains_any(text, words), F.struct("turn", F.lit(i).alias("at"), F.lit(name).alias("name")))).alias(f"_{i}") for i, (name, words) in enumerate(interests.items())]
    grouped = messages.groupBy("user").agg(*last, *hit)
    listed = F.transform(F.array_sort(F.array_compact(F.array(*(F.col(f"_{i}") for i in range(len(interests)))))), lambda x: x["name"])
    return grouped.select("user", *fields, listed.alias("interests"))


def contained_either_way(texts: DataFrame, names: DataFrame, gram: int = GRAM) -> DataFrame:
    """(id, name) where the text of ``texts`` (id, text) holds a name of ``names`` (name), or a name holds the text; both
    are compared as they stand, empty ones match nothing (E17, E18, K41).

    Distinct strings are compared, through an index with counts: of the pieces of up to ``gram``
    characters of the shorter side, the one that is in the fewest strings of the longer side is looked
    up there, and what meets is verified. A string with a piece that is nowhere meets nothing.
    """
    pieces = lambda v: F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(gram), F.length(v))), lambda n: F.transform(F.sequence(F.lit(1), F.length(v) - n + 1), lambda i: F.substring(v, i, n))))
    own = lambda v: F.when(F.length(v) <= gram, F.array(v)).otherwise(F.transform(F.sequence(F.lit(1), F.length(v) - gram + 1), lambda i: F.substring(v, i, F.lit(gram))))

    def inside(short: DataFrame, long: DataFrame) -> DataFrame:
        """(short, long) pairs of distinct strings."""
        index = long.select("long", F.explode(F.array_distinct(pieces(F.col("long")))).alias("piece"))
        counts = index.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
        asked = short.select("short", F.explode(F.array_distinct(own(F.col("short")))).alias("piece")).join(counts, "piece", "left")
        rarest = asked.groupBy("short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).where("r.n > 0").select("short", F.col("r.piece").alias("piece"))
        return rarest.join(index, "piece").where(F.contains("long", F.col("short"))).select("short", "long")

    t, n = texts.select("text").where("text <> ''").distinct(), names.select("name").where("name <> ''").distinct()
    named = inside(n.select(F.col("name").alias("short")), t.select(F.col("text").alias("long"))).select(F.col("long").alias("text"), F.col("short").alias("name"))
    within = inside(t.select(F.col("text").alias("short")), n.select(F.col("name").alias("long"))).select(F.col("short").alias("text"), F.col("long").alias("name"))
    return texts.select("id", "text").join(named.unionByName(within).distinct(), "text").select("id", "name")


def interest_of(texts: DataFrame, names: DataFrame) -> DataFrame:
    """``texts`` (id, text) with the category of the smallest ordinal one of whose names (name, category, ordinal) meets the
    normalised text either way; null if none does (K41). Each distinct text is decided once: a text meets many names,
    and the rows that have it meet none of them but its category."""
    rows = texts.withColumn("_plain", normalised(F.col("text")))
    plain = rows.select(F.col("_plain").alias("id"), F.col("_plain").alias("text")).distinct()
    known = names.select(normalised(F.col("name")).alias("name"), "category", "ordinal")
    met = contained_either_way(plain, known).join(known, "name").groupBy("id").agg(F.min_by("category", F.struct("ordinal", "category")).alias("category"))
    return rows.join(met.withColumnRenamed("id", "_plain"), "_plain", "left").select(*texts.columns, "category")


def title_order(df: DataFrame, title: str, *ties: str, collation: str = "zh") -> DataFrame:
    """Sorted by ``title`` as readers of a language expect, not by code points (H8)."""
    return df.orderBy(F.collate(F.col(title), collation), *ties)


#: Fields and categories that the given conversations hold.
SAID = {"major": "(thing|tion|ment)", "college": "(mente|heit|keit)", "experience": "(nicht|que|and)", "year": "(des|les|los)", "target": "(?i)(ein|est|an)", "hours": "([0-9]+) "}
LIKED = {"b": ("zzz", "heit"), "a": ("the",), "c": ("que", "mente"), "d": ("nichts da",)}


@query(
    "K40_profile",
    "WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'), f AS (SELECT *, "
    + ", ".join(f"nullif(regexp_extract(t, '{p}', 1), '') AS {n}" for n, p in SAID.items())
    + " FROM m), h AS (SELECT conv_id, name, min(turn) AS turn, any_value(i) AS i FROM (SELECT conv_id, turn, unnest([{'i': 0, 'name': 'b', 'hit': contains(t, 'zzz') OR contains(t, 'heit')}, {'i': 1, 'name': 'a', 'hit': contains(t, 'the')}, {'i': 2, 'name': 'c', 'hit': contains(t, 'que') OR contains(t, 'mente')}, {'i': 3, 'name': 'd', 'hit': contains(t, 'nichts da')}], recursive := true) FROM m) WHERE hit GROUP BY ALL), "
    + "l AS (SELECT conv_id, list(name ORDER BY turn, i) AS interests FROM h GROUP BY conv_id) SELECT f.conv_id AS user_id, "
    + ", ".join(f"arg_max({n}, turn) FILTER ({n} IS NOT NULL) AS {n}" for n in SAID)
    + ", coalesce(any_value(interests), []) AS interests FROM f LEFT JOIN l ON l.conv_id = f.conv_id GROUP BY f.conv_id",
)
def profile_query(spark, d):
    """The profile of every conversation's user."""
    messages = table(spark, d, "conversations").where("role = 'user'").withColumnRenamed("conv_id", "user")
    return profiles(messages, SAID, LIKED).withColumnRenamed("user", "user_id")


@query(
    "K41_interest",
    r"""WITH p AS (SELECT p_partkey, regexp_replace(lower(p_name), '\s+', '', 'g') AS t, lower(p_type) AS c FROM part),
        n AS (SELECT regexp_replace(lower(p_name || p_type), '\s+', '', 'g') AS name, lower(p_type) AS c FROM part WHERE p_size > 25
              UNION SELECT unnest(string_split(lower(p_name), ' ')), lower(p_type) FROM part WHERE p_size <= 3),
        m AS (SELECT t, min(n.c) AS category FROM (SELECT DISTINCT t FROM p) JOIN n ON contains(t, name) OR contains(name, t) WHERE name <> '' GROUP BY t)
        SELECT p_partkey, category FROM p LEFT JOIN m USING (t)""",
)
def interest_query(spark, d):
    """Parts as messages; the names that they are held against are longer and shorter ones of parts, by type."""
    part = table(spark, d, "part")
    longer = part.where("p_size > 25").select(F.concat("p_name", "p_type").alias("name"), F.lower("p_type").alias("category"))
    shorter = part.where("p_size <= 3").select(F.explode(F.split("p_name", " ")).alias("name"), F.lower("p_type").alias("category"))
    names = longer.unionByName(shorter).distinct().withColumn("ordinal", F.col("category"))
    return interest_of(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")), names).select(F.col("id").alias("p_partkey"), "category")


@query("H08_title_collation")
def title_collation(spark, d):
    """The first forty titles in the order of a language; DuckDB has no such collation, a test has orders."""
    return title_order(notices(spark, d).select("id", "title"), "title", "id", collation="UNICODE").limit(40)
