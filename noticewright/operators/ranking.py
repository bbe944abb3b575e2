"""Scoring and recommendation (survey section M)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import deadline_score, recency_score
from ..functions.text import tokens
from ..plans.views import ACTIONS_SQL, NOTICES_SQL, actions, notices, table
from ..registry import query
from .joins import HOT_SQL, hotness


@dataclass(frozen=True)
class Profile:
    """What is known of a user: weights of keywords, tags and categories, and interests."""

    keywords: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    categories: dict[str, float] = field(default_factory=dict)
    interests: dict[str, list[str]] = field(default_factory=dict)


def _literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.expr("cast(map() as map<string, double>)")


def _weights(words: Column, values: dict[str, float]) -> Column:
    known = _literal_map(values)
    return F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(known, w), F.lit(0.0)))


def profile_score(p: Profile, keywords: Column, tags: Column, category: Column, days: Column) -> Column:
    """0.5 keywords + 0.3 tags + 0.2 category + 0.1 (30 - days) while a deadline is near (M1)."""
    near = F.when((days > 0) & (days <= 30), 0.1 * (30 - days)).otherwise(0.0)
    return 0.5 * _weights(keywords, p.keywords) + 0.3 * _weights(tags, p.tags) + 0.2 * F.coalesce(F.try_element_at(_literal_map(p.categories), category), F.lit(0.0)) + near


def word_score(text: Column, words: list[str]) -> Column:
    """Number of query words that the text holds (M3)."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def rule_score(p: Profile, text: Column) -> Column:
    """One for each interest of which a word occurs, 0.3 of the weight of each keyword found (M4)."""
    hit = sum((F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(text, w)), 1.0).otherwise(0.0) for ws in p.interests.values()), F.lit(0.0))
    return hit + sum((F.when(F.contains(text, F.lit(k)), 0.3 * v).otherwise(0.0) for k, v in p.keywords.items()), F.lit(0.0))


def rerank_score(score: Column, text: Column, asked: list[str], level: Column) -> Column:
    """Score + 1.8 for each contained token of two letters or more + 0.8 or 0.5 by level (M7)."""
    found = sum((F.when(F.contains(text, F.lit(w)), 1.8).otherwise(0.0) for w in asked if len(w) >= 2), F.lit(0.0))
    return score + found + F.when(level == "A+", 0.8).when(level == "A", 0.5).otherwise(0.0)


def hybrid_score(static: Column, dynamic: Column, quality: Column) -> Column:
    """0.55 static + 0.35 dynamic + 0.10 quality."""
    return 0.55 * static + 0.35 * dynamic + 0.10 * quality


def top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The ``n`` best, ties to the smaller key: each partition keeps n rows before they meet."""
    return df.orderBy(F.desc(score), key).limit(n)


USER = Profile(
    keywords={"the": 0.5, "license": 4.0, "thon": 1.0}, tags={"src1": 2.0, "src7": -1.0}, categories={"en": 3.0, "de": 1.0}, interests={"legal": ["icensed", "reserved"], "contact": ["@"]},
)


@query(
    "M01_profile_top",
    f"""WITH {NOTICES_SQL}, k AS (SELECT id, source, spider, date_diff('day', DATE '2024-06-15', publish_date) AS days, list_filter(string_split_regex(lower(title), '[\\s,;]+'), lambda x: length(x) >= 2) AS w FROM notices),
        s AS (SELECT id, round(0.5 * (0.5 * len(list_filter(w, lambda x: x = 'the')) + 4.0 * len(list_filter(w, lambda x: x = 'license')) + 1.0 * len(list_filter(w, lambda x: x = 'thon'))) + 0.3 * CASE source WHEN 'src1' THEN 2.0 WHEN 'src7' THEN -1.0 ELSE 0 END
              + 0.2 * CASE spider WHEN 'en' THEN 3.0 WHEN 'de' THEN 1.0 ELSE 0 END + CASE WHEN days > 0 AND days <= 30 THEN 0.1 * (30 - days) ELSE 0 END, 6)::DOUBLE AS score FROM k)
        SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20""",
)
def profile_top(spark, d):
    """The best twenty for a profile (M1, M2)."""
    n = notices(spark, d)
    days = F.datediff("publish_date", F.lit("2024-06-15").cast("date"))
    score = profile_score(USER, tokens(F.col("title")), F.array("source"), F.col("spider"), days)
    return top(n.select("id", F.round(score, 6).alias("score")), "score", "id", 20)


@query("M03_word_search", f"WITH {NOTICES_SQL}, s AS (SELECT id, len(list_filter(['license', 'the', 'version'], lambda w: contains(lower(title || ' ' || content), w))) AS score FROM notices) SELECT id, score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 50")
def word_search(spark, d):
    """Rows that hold most of the query's words."""
    scored = notices(spark, d).select("id", word_score(F.lower(F.concat_ws(" ", "title", "content")), ["license", "the", "version"]).cast("long").alias("score"))
    return top(scored.where("score > 0"), "score", "id", 50)


@query(
    "M04_rule_recall",
    """WITH s AS (SELECT doc_id, round(CAST(CASE WHEN contains(text, 'icensed') OR contains(text, 'reserved') THEN 1.0 ELSE 0 END + CASE WHEN contains(text, '@') THEN 1.0 ELSE 0 END + CASE WHEN contains(text, 'the') THEN 0.15 ELSE 0 END + CASE WHEN contains(text, 'license') THEN 1.2 ELSE 0 END + CASE WHEN contains(text, 'thon') THEN 0.3 ELSE 0 END AS DOUBLE), 6) AS score FROM documents)
       SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 50""",
)
def rule_recall(spark, d):
    """Rule recall, the best fifty (M4 to M6)."""
    return top(table(spark, d, "documents").select("doc_id", F.round(rule_score(USER, F.col("text")), 6).alias("score")), "score", "doc_id", 50)


@query(
    "M07_rule_rerank",
    """WITH c AS (SELECT p_partkey, p_size / 10.0 AS s, lower(p_name || ' ' || p_type) AS t, CASE WHEN p_size >= 40 THEN 'A+' WHEN p_size >= 30 THEN 'A' ELSE 'B' END AS level FROM part),
       r AS (SELECT p_partkey, round(CAST(s + CASE WHEN contains(t, 'brass') THEN 1.8 ELSE 0 END + CASE WHEN contains(t, 'small') THEN 1.8 ELSE 0 END + CASE level WHEN 'A+' THEN 0.8 WHEN 'A' THEN 0.5 ELSE 0 END AS DOUBLE), 6) AS score FROM c)
       SELECT p_partkey, score FROM r ORDER BY score DESC, p_partkey LIMIT 12""",
)
def rule_rerank(spark, d):
    """Rule rerank of candidates, the shortlist of a dozen."""
    level = F.when(F.col("p_size") >= 40, "A+").when(F.col("p_size") >= 30, "A").otherwise("B")
    score = rerank_score(F.col("p_size") / 10.0, F.lower(F.concat_ws(" ", "p_name", "p_type")), ["brass", "small", "x"], level)
    return top(table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score")), "score", "p_partkey", 12)


@query(
    "M11_hybrid_score",
    f"""WITH {NOTICES_SQL}, {ACTIONS_SQL}, {HOT_SQL}, x AS (SELECT id, title, coalesce(total, 0) AS total, date_diff('day', publish_date, DATE '2024-12-31') AS age, date_diff('day', DATE '2024-06-15', publish_date) AS days, CASE WHEN n_chars > 4000 THEN 6.0 WHEN n_chars > 2000 THEN 4.0 ELSE 0.0 END AS q FROM notices LEFT JOIN hot ON item = id)
        SELECT id, round(CAST(0.55 * (7 * (CAST(contains(title, 'The') AS INTEGER) + CAST(contains(title, 'and') AS INTEGER)))
          + 0.35 * (10 * least(1.0, total / 20.0) + 8 * CASE WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.7 WHEN age <= 90 THEN 0.4 ELSE 0.1 END)
          + 0.10 * (q + CASE WHEN days < 0 THEN 0 WHEN days <= 7 THEN 1.2 WHEN days <= 30 THEN 1.0 ELSE 0.5 END) AS DOUBLE), 6) AS score FROM x""",
)
def hybrid(spark, d):
    """Static (two title words), dynamic and quality parts in one expression (part of M11); the hot list is aggregated before
    it is joined."""
    n = notices(spark, d).join(hotness(actions(spark, d)), F.col("id") == F.col("item"), "left")
    static = 7 * (F.contains("title", F.lit("The")).cast("int") + F.contains("title", F.lit("and")).cast("int"))
    days = F.datediff("publish_date", F.lit("2024-06-15").cast("date"))
    dynamic = 10 * F.least(F.lit(1.0), F.coalesce("total", F.lit(0)) / 20.0) + 8 * recency_score(F.datediff(F.lit("2024-12-31").cast("date"), "publish_date"))
    quality = F.when(F.col("n_chars") > 4000, 6.0).when(F.col("n_chars") > 2000, 4.0).otherwise(0.0) + deadline_score(days, F.lit(True))
    return n.select("id", F.round(hybrid_score(static, dynamic, quality), 6).alias("score"))


@query(
    "M13_shortlist",
    """WITH s AS (SELECT p_partkey, p_brand, 40 + CASE WHEN contains(p_type, 'STEEL') THEN 45 ELSE 0 END + CASE WHEN p_size > 40 THEN 20 WHEN p_size > 30 THEN 10 ELSE 0 END - CASE WHEN p_retailprice > 1500 THEN 15 ELSE 0 END AS score FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS place FROM s) SELECT p_brand, p_partkey, CAST(score AS BIGINT) AS score, place FROM r WHERE place <= 3""",
)
def shortlist(spark, d):
    """Additive rules on a base of 40, the best three of each group."""
    score = 40 + F.when(F.contains("p_type", F.lit("STEEL")), 45).otherwise(0) + F.when(F.col("p_size") > 40, 20).when(F.col("p_size") > 30, 10).otherwise(0) - F.when(F.col("p_retailprice") > 1500, 15).otherwise(0)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey")).cast("long")
    return table(spark, d, "part").select("p_brand", "p_partkey", score.cast("long").alias("score")).withColumn("place", place).where("place <= 3")


@query("M15_year_bonus", "SELECT o_orderkey, CASE WHEN year(o_orderdate) = 1997 THEN 35 WHEN year(o_orderdate) = 1996 THEN 12 ELSE -15 END + CASE o_orderstatus WHEN 'F' THEN 18 WHEN 'O' THEN 10 ELSE 0 END AS bonus FROM orders")
def year_bonus(spark, d):
    """Bonus by year window and state."""
    y = F.year("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", (F.when(y == 1997, 35).when(y == 1996, 12).otherwise(-15) + F.when(F.col("o_orderstatus") == "F", 18).when(F.col("o_orderstatus") == "O", 10).otherwise(0)).alias("bonus"))
