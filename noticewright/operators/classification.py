"""Rule-driven classification of notices (survey section L).

Vocabularies are data: ``Rules`` holds the published word lists by default, and any other lists can
be given, as the queries on the driver's tables do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import IDF, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.pairs import PairCounts
from ..functions.text import contains_any, normalised
from ..plans.views import NOTICES_SQL, notices, table
from ..registry import query


@dataclass(frozen=True)
class Rules:
    """Word lists of the confidence score, in the order in which they are tried."""

    names: list[str] = field(default_factory=list)
    teachers: list[str] = field(default_factory=lambda: V.TEACHERS)
    sports: list[str] = field(default_factory=lambda: V.SPORTS)
    staff: list[str] = field(default_factory=lambda: V.STAFF)
    students: list[str] = field(default_factory=lambda: V.STUDENTS)
    title_marks: list[str] = field(default_factory=lambda: V.TITLE_MARKS)
    award_reports: list[str] = field(default_factory=lambda: V.AWARD_REPORTS)
    excluded: list[str] = field(default_factory=lambda: V.EXCLUDED)
    strong: dict[str, float] = field(default_factory=lambda: V.STRONG)
    secondary: dict[str, float] = field(default_factory=lambda: V.SECONDARY)
    features: list[str] = field(default_factory=lambda: V.FEATURES)
    bonus: list[str] = field(default_factory=lambda: V.BONUS)
    meetings: list[str] = field(default_factory=lambda: V.MEETINGS)
    lectures: list[str] = field(default_factory=lambda: V.LECTURES)


def _any(t: Column, words) -> Column:
    return contains_any(t, list(words)) if words else F.lit(False)


def _found(text: Column, words: dict[str, float]) -> Column:
    """The words that occur, with their weights."""
    listed = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(float(n)).alias("n")) for w, n in words.items()])
    return F.when(contains_any(text, list(words)), F.filter(listed, lambda x: F.contains(text, x["w"]))).otherwise(F.filter(listed, lambda x: F.lit(False)))


def _weighed(title: Column, found: Column, factor: float) -> Column:
    """Sum of weights over the words found, times ``factor`` for those in the title."""
    return F.aggregate(found, F.lit(0.0), lambda acc, x: acc + F.when(F.contains(title, x["w"]), x["n"] * factor).otherwise(x["n"]))


def _count(t: Column, words) -> Column:
    return F.when(_any(t, words), F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(t, w)))).otherwise(0)


def with_confidence(df: DataFrame, title: str, content: str, rules: Rules, out: str = "confidence") -> DataFrame:
    """Confidence in [0, 1] that a notice announces a contest: a decision list whose first hit
    counts, then a weighted sum that is damped (L1, L5). Names of the guide are matched in title and
    content together. Null texts are empty ones.

    The normalised texts are columns of their own, so that each is made once per row and not once
    per word of the lists."""
    t, c = F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit(""))
    both = F.concat(t, F.lit(" "), c)
    made = {"_nt": normalised(t), "_nc": normalised(c), "_text": normalised(both), "_tl": F.lower(t), "_cl": F.lower(c), "_both": both}
    nt, nc, text, tl, cl = (F.col(x) for x in ("_nt", "_nc", "_text", "_tl", "_cl"))
    either = F.concat(nt, F.lit("\n"), nc)
    base = df.withColumns(made).withColumns({"_found": _found(either, rules.strong), "_found2": _found(either, rules.secondary)}).withColumns(
        {
            "_strong": _weighed(nt, F.col("_found"), 2.0) + 2.0 * _count(nc, rules.features),
            "_n_strong": F.size("_found"),
            "_second": _weighed(nt, F.col("_found2"), 1.5),
            "_titled": _any(tl, rules.strong),
            "_in_content": _count(cl, list(rules.strong)),
            "_lectures": _count(cl, rules.lectures),
        }
    )
    strong, titled, in_content, lectures = F.col("_strong"), F.col("_titled"), F.col("_in_content"), F.col("_lectures")
    raised = strong + F.when(strong > 0, 3.0 * _count(nt, rules.bonus)).otherwise(0.0)
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raised + F.col("_second")) / 20.0))
    damped = (
        raw
        * F.when(~_any(F.col("_both"), rules.meetings), 1.0).when(titled, 0.8).otherwise(0.5)
        * F.when((_count(text, rules.excluded) >= 2) & (F.col("_n_strong") <= 1), 0.6).otherwise(1.0)
        * F.when(titled | (in_content > 4), 1.0).when(in_content == 0, 0.5).when(in_content <= 2, 0.6).otherwise(0.8)
        * F.when(lectures >= 2, 0.4).when((lectures == 1) & ~titled, 0.6).otherwise(1.0)
    )
    score = (
        F.when(_any(F.concat(nt, nc), [n.lower() for n in rules.names]), 0.95)
        .when(_any(nt, rules.teachers) | _any(nc, rules.teachers), 0.0)
        .when(_any(nt, rules.sports) & _any(nt, rules.staff), 0.0)
        .when(_any(nt, rules.sports) & _any(nt, rules.students), 0.9)
        .when(_any(nt, rules.title_marks) & ~_any(nt, rules.award_reports), 0.85)
        .when(_any(nt, rules.excluded), 0.0)
        .otherwise(damped)
    )
    return base.withColumn(out, score).select(*df.columns, out)


def _in_one_pass(pattern: str) -> str:
    """"(A).*(B)" as a pattern that looks for B behind the first A of a line only, which finds the
    same texts without trying every A again."""
    m = re.fullmatch(r"\(([^()]*)\)\.\*\(([^()]*)\)", pattern)
    return rf"(?m)^(?>.*?(?:{m[1]})).*(?:{m[2]})" if m else pattern


def vetoed(title: Column, content: Column, table_=None, strong=None, text: Column | None = None) -> Column:
    """Whether a notice is plainly no contest: the first pattern that fits decides (L3). ``text``:
    title and content normalised, where a column has that already."""
    title, content = F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))
    strong = list(strong or V.STRONG)
    of = {"title": title, "content": content, "text": normalised(F.concat(title, content)) if text is None else text}
    out = F.lit(False)
    for what, pattern, spare, verdict in reversed(V.VETO if table_ is None else table_):
        hit = of[what].rlike(_in_one_pass(pattern))
        if spare:
            hit = hit & ~(_any(of[what], strong) if spare == "STRONG" else of[what].rlike(spare))
        out = F.when(hit, verdict).otherwise(out)
    return out


def decision(score: Column, veto: Column) -> Column:
    """accepted from 0.6, review from 0.3, else rejected; a veto rejects (L2)."""
    return F.when(veto, "rejected").when(score >= 0.6, "accepted").when(score >= 0.3, "review").otherwise("rejected")


def classified(df: DataFrame, rules: Rules, title: str = "title", content: str = "content") -> DataFrame:
    """Score and decision of every row."""
    text = normalised(F.concat(F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(content), F.lit(""))))
    scored = with_confidence(df, title, content, rules).withColumn("_veto_text", text)
    veto = vetoed(F.col(title), F.col(content), text=F.col("_veto_text"))
    return scored.withColumn("decision", decision(F.col("confidence"), veto)).drop("_veto_text")


def first_category(t: Column, table_: list[tuple[str, list[str]]], default: str) -> Column:
    """The first category one of whose words occurs."""
    return reduce(lambda rest, row: F.when(_any(t, row[1]), row[0]).otherwise(rest), reversed(table_), F.lit(default))


def text_classifier(features: int = 1 << 16) -> Pipeline:
    """Character 1- and 2-grams, TF-IDF, naive Bayes (L13 to L15). ``model.write()`` stores all of it."""
    tf = PairCounts(inputCol="text", outputCol="tf", numFeatures=features)
    return Pipeline(stages=[StringIndexer(inputCol="category", outputCol="label", handleInvalid="keep"), tf, IDF(inputCol="tf", outputCol="features"), NaiveBayes(featuresCol="features", labelCol="label")])


LATIN = Rules(
    names=["allrightsreserved"], teachers=["zzteacher"], sports=["und der"], staff=["qqstaff"], students=["derund"], title_marks=["tion"], award_reports=["stion", "ation"],
    excluded=["ould", "quel", "ment", "icht"], strong={"the": 5, "der": 8, "con": 8, "les": 10, "thon": 8}, secondary={"and": 3, "und": 2, "est": 6}, features=["license", "http", "er"],
    bonus=["th", "de"], meetings=["nd st", "en er"], lectures=["ing", "able", "eaux"],
)


def _confidence_sql(r: Rules) -> str:
    q = lambda w: "'" + w.replace("'", "''") + "'"
    has = lambda t, ws: "(" + " OR ".join(f"contains({t}, {q(w)})" for w in ws) + ")"
    cnt = lambda t, ws: "(" + " + ".join(f"CAST(contains({t}, {q(w)}) AS INTEGER)" for w in ws) + ")"
    wsum = lambda d, f: "(" + " + ".join(f"CASE WHEN contains(nt, {q(w)}) THEN {n * f} WHEN contains(nc, {q(w)}) THEN {n} ELSE 0 END" for w, n in d.items()) + ")"
    norm = lambda t: f"lower(regexp_replace({t}, '[\\s\"“”]+', '', 'g'))"
    return f"""WITH {NOTICES_SQL}, b AS (SELECT id, title || ' ' || content AS both_, lower(title) AS tl, lower(content) AS cl, {norm('title')} AS nt, {norm('content')} AS nc, {norm("title || content")} AS guide FROM notices),
      s AS (SELECT *, {wsum(r.strong, 2.0)} + 2.0 * {cnt('nc', r.features)} AS strong0, {cnt("(nt || chr(10) || nc)", r.strong)} AS n_strong, {wsum(r.secondary, 1.5)} AS second, {has('tl', r.strong)} AS titled, {cnt('cl', r.strong)} AS inc, {cnt('cl', r.lectures)} AS lec FROM b),
      t AS (SELECT *, least(1.0, greatest(0.0, (strong0 + CASE WHEN strong0 > 0 THEN 3.0 * {cnt('nt', r.bonus)} ELSE 0 END + second) / 20.0)) AS raw FROM s)
      SELECT id, round(CAST(CASE WHEN {has('guide', r.names)} THEN 0.95 WHEN {has('nt', r.teachers)} OR {has('nc', r.teachers)} THEN 0 WHEN {has('nt', r.sports)} AND {has('nt', r.staff)} THEN 0
        WHEN {has('nt', r.sports)} AND {has('nt', r.students)} THEN 0.9 WHEN {has('nt', r.title_marks)} AND NOT {has('nt', r.award_reports)} THEN 0.85 WHEN {has('nt', r.excluded)} THEN 0
        ELSE raw * CASE WHEN NOT {has('both_', r.meetings)} THEN 1.0 WHEN titled THEN 0.8 ELSE 0.5 END * CASE WHEN {cnt('(nt || nc)', r.excluded)} >= 2 AND n_strong <= 1 THEN 0.6 ELSE 1.0 END
          * CASE WHEN titled OR inc > 4 THEN 1.0 WHEN inc = 0 THEN 0.5 WHEN inc <= 2 THEN 0.6 ELSE 0.8 END * CASE WHEN lec >= 2 THEN 0.4 WHEN lec = 1 AND NOT titled THEN 0.6 ELSE 1.0 END END AS DOUBLE), 6) AS confidence FROM t"""


@query("L01_confidence", _confidence_sql(LATIN))
def confidence_query(spark, d):
    """The score with a Latin vocabulary, which the tables' texts hold."""
    return with_confidence(notices(spark, d), "title", "content", LATIN).select("id", F.round("confidence", 6).alias("confidence"))


LATIN_VETO = [("title", "eserved", "", False), ("title", "^The.*of", "icense", True), ("text", "(th|der).*(meeting|ung)", "STRONG", True), ("content", "eleased under", "", True)]


@query(
    "L02_veto_and_decision",
    f"""WITH {NOTICES_SQL}, n AS (SELECT *, lower(regexp_replace(title || content, '[\\s"“”]+', '', 'g')) AS t FROM notices)
        SELECT id, CASE WHEN regexp_matches(title, 'eserved') THEN false WHEN regexp_matches(title, '^The.*of') AND NOT regexp_matches(title, 'icense') THEN true
          WHEN regexp_matches(t, '(th|der).*(meeting|ung)') AND NOT regexp_matches(t, 'quelle|ción') THEN true WHEN regexp_matches(content, 'eleased under') THEN true ELSE false END AS vetoed FROM n""",
)
def veto_query(spark, d):
    """Ordered keep and reject rules (L2, L3)."""
    return notices(spark, d).select("id", vetoed(F.col("title"), F.col("content"), LATIN_VETO, ["quelle", "ción"]).alias("vetoed"))


@query("L03_published_rules")
def published_rules(spark, d):
    """The published vocabularies over all documents: score and decision (L4, L19 to L21). The word
    lists hold no Latin words, so the tables give few hits; tests hold the rules against notices."""
    return classified(notices(spark, d), Rules()).select("id", "confidence", "decision")


@query("L06_analysis_record", f"WITH {NOTICES_SQL} SELECT id, list_filter(['the', 'der', 'les'], lambda w: contains(content, w)) AS strong, list_filter(['and', 'und'], lambda w: contains(content, w)) AS secondary FROM notices")
def analysis_record(spark, d):
    """The words that were found, as lists."""
    found = lambda ws: F.filter(F.array(*map(F.lit, ws)), lambda w: F.contains("content", w))
    return notices(spark, d).select("id", found(["the", "der", "les"]).alias("strong"), found(["and", "und"]).alias("secondary"))


@query("L10_category", "SELECT doc_id, CASE WHEN contains(text, 'icensed') OR contains(text, 'reserved') THEN 'legal' WHEN contains(text, '@') THEN 'contact' WHEN contains(text, '|') THEN 'table' ELSE 'other' END AS category FROM documents")
def category(spark, d):
    rules = [("legal", ["icensed", "reserved"]), ("contact", ["@"]), ("table", ["|"])]
    return table(spark, d, "documents").select("doc_id", first_category(F.col("text"), rules, "other").alias("category"))


@query("L13_naive_bayes")
def naive_bayes(spark, d):
    """Language of each document by the text classifier, learned from four documents in five: MLlib
    trains by tree aggregation, the model is as large as the feature space."""
    docs = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.lower("text").alias("text"), F.col("lang").alias("category"))
    model = text_classifier(1 << 12).fit(docs.where("doc_id % 5 <> 0"))
    return model.transform(docs).select("doc_id", F.col("prediction").cast("int").alias("prediction"), F.col("label").cast("int").alias("label"))


@query("L16_rule_level", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'STEEL|BRASS') THEN 'high' WHEN regexp_matches(p_type, 'COPPER') THEN 'mid' WHEN regexp_matches(p_type, 'TIN') THEN 'low' ELSE 'unknown' END AS level FROM part")
def rule_level(spark, d):
    """Level from a table of patterns, the first that fits."""
    out = F.lit("unknown")
    for level, pattern in (("low", "TIN"), ("mid", "COPPER"), ("high", "STEEL|BRASS")):
        out = F.when(F.col("p_type").rlike(pattern), level).otherwise(out)
    return table(spark, d, "part").select("p_partkey", out.alias("level"))
