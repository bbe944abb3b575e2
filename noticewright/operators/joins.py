"""Joins of the notice catalogue (survey section E)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalised
from ..plans.views import ACTIONS_SQL, NOTICES_SQL, actions, notices, table
from ..registry import query

#: Dictionary rows that may be broadcast (names of some 100 bytes).
BROADCAST_NAMES = 100_000


def first_per(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Keep the first row of each key (G1): a group limit of one, partial before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def insert_or_ignore(new: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that ``stored`` lacks."""
    return first_per(new, [key], order).join(stored.select(key).distinct(), key, "left_anti")


def insert_or_precede(new: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``new`` to append: the first of each key that ``stored`` lacks, or that comes before what is stored."""
    known = stored.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    joined = first_per(new, [key], order).join(known, key, "left")
    return joined.where(F.col("_first").isNull() | (F.struct(*order) < F.col("_first"))).select(*new.columns)


def or_anti(new: DataFrame, stored: DataFrame, keys: tuple[str, str], order: list[str]) -> DataFrame:
    """Rows that match ``stored`` in neither key: two anti joins, since one OR join would compare
    every pair. In the batch the first row of either key wins (E3)."""
    a, b = keys
    left = first_per(first_per(new, [a], order), [b], order)
    return left.join(stored.select(a).distinct(), a, "left_anti").join(stored.select(b).distinct(), b, "left_anti")


def longest_contained(docs: DataFrame, names: DataFrame, text: Column, name: str, window: int = 12) -> DataFrame:
    """For each row of ``docs`` (``id`` tells rows apart) the longest ``name`` that its text contains
    anywhere, ties by name (E4, E5). Empty names match nothing; a null text has no match.

    The first ``window`` characters of a name, or the whole of a shorter one, are an equi-join key,
    so that no text meets every name: the substrings of those lengths at every position of a text
    are matched to the keys with its id alone, and only hits meet the text again, for the whole name.
    """
    keyed = names.select(F.col(name).alias("_name")).where(F.length("_name") > 0).distinct().withColumn("_key", F.substring("_name", 1, window))
    lengths = sorted(r[0] for r in keyed.select(F.length("_key")).distinct().collect())  # at most ``window`` numbers
    if not lengths:
        return docs.withColumn("match", F.lit(None).cast("string"))
    parts = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths])
    hits = docs.select("id", F.explode(parts).alias("_key")).join(keyed, "_key").select("id", "_name").distinct()
    found = docs.select("id", text.alias("_text")).join(hits, "id").where(F.contains("_text", F.col("_name")))
    best = found.groupBy("id").agg(F.max_by("_name", F.struct(F.length("_name"), "_name")).alias("match"))
    return docs.join(best, "id", "left")


def argmax_rule(df: DataFrame, rules: list[tuple[str, list[str], list[str]]], text: Column, plus: float = 2.0, minus: float = 1.5) -> DataFrame:
    """Best category by hits: ``plus`` for each word found, ``minus`` off for each veto word, at
    least 0; the first of equal ones. A small rule table is an array in the plan, not a join
    (E16, E18, L11)."""
    count = lambda words: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))
    scores = F.array(*[F.struct(F.greatest(F.lit(0.0), plus * count(yes) - minus * count(no)).alias("score"), F.lit(-i).alias("at"), F.lit(name).alias("category")) for i, (name, yes, no) in enumerate(rules)])
    best = F.array_max(scores)
    return df.withColumn("category", best["category"]).withColumn("category_score", best["score"])


@query("E01_anti_join", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def anti_join(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.join(pages.where("page_id % 3 = 0").select("url").distinct(), "url", "left_anti").select("page_id")


@query(
    "E02_insert_or_ignore",
    """WITH b AS (SELECT doc_id, sha256(text) AS url, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 4 <> 0)
       SELECT doc_id FROM b WHERE rn = 1 AND url NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 4 = 0)""",
)
def insert_or_ignore_query(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("url"))
    return insert_or_ignore(docs.where("doc_id % 4 <> 0"), docs.where("doc_id % 4 = 0"), "url", ["doc_id"]).select("doc_id")


@query(
    "E03_or_anti_join",
    """WITH n AS (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r1 FROM orders WHERE o_orderkey % 5 <> 0),
       m AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o_orderkey) AS r2 FROM n WHERE r1 = 1),
       s AS (SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 2 = 0)
       SELECT o_orderkey, o_custkey FROM m WHERE r2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM s) AND p NOT IN (SELECT p FROM s)""",
)
def or_anti_query(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor("o_totalprice").alias("p"))
    return or_anti(orders.where("o_orderkey % 5 <> 0"), orders.where("o_orderkey % 5 = 0 and o_custkey % 2 = 0"), ("o_custkey", "p"), ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(
    "E04_dictionary_match",
    """WITH m AS (SELECT d.doc_id AS id, b.text AS name, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(b.text) DESC, b.text DESC) AS rn
                  FROM documents d JOIN benchmark b ON contains(d.text, b.text))
       SELECT d.doc_id AS id, m.name AS match FROM documents d LEFT JOIN m ON m.id = d.doc_id AND rn = 1""",
)
def dictionary_match(spark, d):
    """Dictionary passages contained in documents, the longest of each."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return longest_contained(docs, table(spark, d, "benchmark"), F.col("text"), "text").select("id", "match")


@query(
    "E06_alias_expansion",
    """SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS level, coalesce(list_sort(list(n_name) FILTER (WHERE n_name IS NOT NULL)), []) AS aliases
       FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def alias_expansion(spark, d):
    aliases = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("aliases"))
    joined = table(spark, d, "region").join(aliases, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return joined.select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("level"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


@query(
    "E07_host_to_owner",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages), o AS (SELECT host, min(page_id) AS owner FROM p GROUP BY host)
       SELECT p.page_id, p.host, o.owner FROM p JOIN o USING (host)""",
)
def host_to_owner(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.try_parse_url(F.col("url"), F.lit("HOST")).alias("host"))
    return pages.join(pages.groupBy("host").agg(F.min("page_id").alias("owner")), "host").select("page_id", "host", "owner")


@query("E08_display_name", "SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS shown FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 1")
def display_name(spark, d):
    names = table(spark, d, "nation").where("n_regionkey <> 1")
    return table(spark, d, "customer").join(names, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("shown"))


def hotness(acts: DataFrame) -> DataFrame:
    """Views count 1, favourites 3, useful marks 2."""
    weight = F.when(F.col("action") == "view", 1).when(F.col("action") == "favorite", 3).when(F.col("action") == "useful", 2).otherwise(0)
    return acts.groupBy("item").agg(F.sum(weight).alias("total"))


HOT_SQL = "hot AS (SELECT item, CAST(sum(CASE action WHEN 'view' THEN 1 WHEN 'favorite' THEN 3 WHEN 'useful' THEN 2 ELSE 0 END) AS BIGINT) AS total FROM actions GROUP BY item)"


@query("E09_hot_list", f"WITH {ACTIONS_SQL}, {HOT_SQL} SELECT doc_id, coalesce(total, 0) AS total FROM documents LEFT JOIN hot ON item = doc_id ORDER BY total DESC, doc_id LIMIT 10")
def hot_list(spark, d):
    """Left join, default 0, the ten hottest."""
    joined = table(spark, d, "documents").select("doc_id").join(hotness(actions(spark, d)), F.col("doc_id") == F.col("item"), "left")
    return joined.select("doc_id", F.coalesce("total", F.lit(0)).alias("total")).orderBy(F.desc("total"), "doc_id").limit(10)


@query("E10_status_assignment", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'passed' ELSE 'rejected' END AS status FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON l.doc_id = d.doc_id")
def status_assignment(spark, d):
    passed = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("ok", F.lit(True))
    return table(spark, d, "documents").join(passed, "doc_id", "left").select("doc_id", F.when(F.col("ok"), "passed").otherwise("rejected").alias("status"))


@query("E11_semi_join_six", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY doc_id LIMIT 6")
def semi_join_six(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(6).select("doc_id")


@query("E12_log_join_items", f"WITH {ACTIONS_SQL} SELECT a.event_id, d.source FROM actions a JOIN documents d ON d.doc_id = a.item")
def log_join_items(spark, d):
    return actions(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), F.col("item") == F.col("doc_id")).select("event_id", "source")


@query(
    "E13_overlay",
    """WITH n AS (SELECT user_id, max(value) AS note FROM events WHERE event_type = 'click' GROUP BY user_id), p AS (SELECT user_id, min(value) AS progress FROM events WHERE event_type = 'view' GROUP BY user_id)
       SELECT c_custkey, coalesce(note, -1) AS note, coalesce(progress, 0) AS progress FROM customer LEFT JOIN n ON n.user_id = c_custkey LEFT JOIN p ON p.user_id = c_custkey""",
)
def overlay(spark, d):
    """Notes and progress of each key over the defaults."""
    ev = table(spark, d, "events")
    notes = ev.where("event_type = 'click'").groupBy("user_id").agg(F.max("value").alias("note"))
    progress = ev.where("event_type = 'view'").groupBy("user_id").agg(F.min("value").alias("progress"))
    base = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("user_id"))
    return base.join(notes, "user_id", "left").join(progress, "user_id", "left").select("c_custkey", F.coalesce("note", F.lit(-1.0)).alias("note"), F.coalesce("progress", F.lit(0.0)).alias("progress"))


@query(
    "E14_model_order",
    """WITH ids AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}')) AS x FROM conversations WHERE role = 'assistant'),
       r AS (SELECT conv_id, min(turn) AS pos FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
       c AS (SELECT DISTINCT conv_id FROM conversations)
       SELECT c.conv_id, row_number() OVER (ORDER BY coalesce(r.pos, 1000000 + c.conv_id), c.conv_id) AS place FROM c LEFT JOIN r USING (conv_id)""",
)
def model_order(spark, d):
    """Ranked ids first, ids without a rank after them in their own order. The ranks run over the
    whole list, which the reference bounds at a dozen candidates; here conversations stand for them
    and ranges are numbered without one task that sees all."""
    conv = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("pos"))
    ordered = conv.select("conv_id", F.coalesce("pos", F.lit(1000000) + F.col("conv_id")).alias("key"))
    return numbered(ordered, ["key", "conv_id"], "place").select("conv_id", "place")


def numbered(df: DataFrame, order: list[str], name: str, parts: int = 64) -> DataFrame:
    """Consecutive numbers from 1 in a total order of two numeric columns, without one task that sees
    every row: ranges between sampled quantiles of the first column, their sizes summed up, then a
    row number in each range. A value that is itself a quantile is a range of its own, cut further
    at the quantiles of the second column, so that frequent values are split too. The driver gets
    the quantiles, at most 2 * ``parts`` numbers.
    """
    at = [i / parts for i in range(1, parts)]
    first, second = (sorted(set(bounds)) for bounds in df.approxQuantile(order, at, 1 / (4 * parts)))
    below = lambda c, bounds: sum(((F.col(c) > b).cast("int") for b in bounds), F.lit(0))
    own = F.col(order[0]).isin(first) if first else F.lit(False)
    ranged = df.withColumns({"_a": 2 * below(order[0], first) + own.cast("int"), "_b": F.when(own, below(order[1], second)).otherwise(0)})
    before = Window.orderBy("_a", "_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_a", "_b").count().select("_a", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_a", "_b").orderBy(*order))
    return ranged.withColumn("_n", number).join(F.broadcast(sizes), ["_a", "_b"]).withColumn(name, (F.col("_n") + F.col("_before")).cast("long")).drop("_a", "_b", "_n", "_before")


CATEGORY_RULES = [("legal", ["icensed", "reserved", "Released"], ["zzz"]), ("prose", [" the ", " und ", " que ", " les "], ["icensed"]), ("data", ["|", "@", "http"], []), ("other", [], [])]


def _rules_sql(text: str) -> str:
    one = lambda w: f"CAST(contains({text}, '{w}') AS INTEGER)"
    return ", ".join(f"greatest(0, 2.0 * ({' + '.join([one(w) for w in yes] or ['0'])}) - 1.5 * ({' + '.join([one(w) for w in no] or ['0'])})) AS s{i}" for i, (_, yes, no) in enumerate(CATEGORY_RULES))


@query(
    "E16_taxonomy_argmax",
    f"""WITH s AS (SELECT doc_id, {_rules_sql('text')} FROM documents), m AS (SELECT *, greatest(s0, s1, s2, s3) AS best FROM s)
        SELECT doc_id, CASE WHEN s0 = best THEN 'legal' WHEN s1 = best THEN 'prose' WHEN s2 = best THEN 'data' ELSE 'other' END AS category, CAST(best AS DOUBLE) AS category_score FROM m""",
)
def taxonomy_argmax(spark, d):
    return argmax_rule(table(spark, d, "documents"), CATEGORY_RULES, F.col("text")).select("doc_id", "category", "category_score")


@query(
    "E17_interest_match",
    """WITH m AS (SELECT c_custkey, n_name, CASE WHEN lower(n_name) = lower(c_mktsegment) THEN 2.0 WHEN contains(c_name, CAST(n_nationkey AS VARCHAR)) THEN 1.0 ELSE 0.0 END AS score, n_nationkey FROM customer JOIN nation ON n_regionkey = c_custkey % 5)
       SELECT c_custkey, arg_max(n_name, score * 1000 - n_nationkey) AS best FROM m GROUP BY c_custkey""",
)
def interest_match(spark, d):
    """Interests against the categories of one group: equality 2, containment 1, the first of the best. Customers are dealt
    by key before they are multiplied, so that pairs are made and compared in as many tasks as there are."""
    nations = table(spark, d, "nation")
    if nations.count() <= BROADCAST_NAMES:
        nations = F.broadcast(nations)
    customers = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    customers = customers.repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    pairs = customers.join(nations, F.col("n_regionkey") == F.col("c_custkey") % 5)
    score = F.when(F.lower("n_name") == F.lower("c_mktsegment"), 2.0).when(F.contains("c_name", F.col("n_nationkey").cast("string")), 1.0).otherwise(0.0)
    return pairs.groupBy("c_custkey").agg(F.max_by("n_name", score * 1000 - F.col("n_nationkey")).alias("best"))


@query(
    "E19_fuzzy_title",
    """WITH a AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS w, p_size FROM part),
       b AS (SELECT p_brand, list_distinct(string_split(lower(p_name), ' ')) AS w, p_partkey AS kb FROM part),
       t AS (SELECT a.p_partkey, b.kb, count(*) * 15 AS score FROM (SELECT p_partkey, unnest(w) AS t FROM a) a JOIN (SELECT kb, unnest(w) AS t FROM b) b ON a.t = b.t AND a.p_partkey <> b.kb GROUP BY ALL)
       SELECT kb, arg_max(p_partkey, score * 1000000 - p_partkey) AS item, max(score) AS score FROM t WHERE score >= 30 GROUP BY kb""",
)
def fuzzy_title(spark, d):
    """For every title the best other one by shared words, 15 points each and at least 30, the
    smaller key of equal ones."""
    best = best_title(table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title")))
    return best.select(F.col("key").alias("kb"), "item", "score")


def best_title(titles: DataFrame) -> DataFrame:
    """key, item, score: for each row of ``titles`` (key, title) the other row that shares the most
    words (E19, M17).

    Titles of the same words are one set, however many rows have them; sets meet on pairs of words,
    since 30 points take two, and the number of pairs they share gives that of the words.
    """
    words = F.array_sort(F.array_distinct(F.split(F.lower("title"), " ")))
    rows = titles.select("key", words.alias("words"))
    two = rows.withColumn("_n", F.row_number().over(Window.partitionBy("words").orderBy("key"))).where("_n <= 2")
    sets = two.groupBy("words").agg(F.min("key").alias("set"), F.max(F.when(F.col("_n") == 2, F.col("key"))).alias("second"))
    pairs = F.flatten(F.transform("words", lambda a, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    keyed = sets.select("set", F.explode(pairs).alias("pair"))
    met = keyed.join(keyed.withColumnRenamed("set", "other"), "pair").where("set <> other").groupBy("set", "other").count()
    shared = ((1 + F.sqrt(1 + 8 * F.col("count"))) / 2).cast("long")
    other = met.groupBy("set").agg(F.max(F.struct((15 * shared).alias("score"), (-F.col("other")).alias("item"))).alias("other"))
    mates = rows.join(sets, "words").join(other, "set", "left")
    mate = F.when(F.col("key") == F.col("set"), F.col("second")).otherwise(F.col("set"))
    same = F.when(mate.isNotNull() & (F.size("words") >= 2), F.struct((15 * F.size("words")).cast("long").alias("score"), (-mate).alias("item")))
    best = F.greatest(F.coalesce(same, "other"), F.coalesce("other", same))
    return mates.select("key", best.alias("best")).where("best is not null").select("key", (-F.col("best.item")).alias("item"), F.col("best.score").alias("score"))


@query(
    "E20_full_outer_merge",
    """WITH l AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), c AS (SELECT o_custkey, max(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
       SELECT coalesce(l.o_custkey, c.o_custkey) AS o_custkey, coalesce(c.v, l.v) AS v FROM l FULL OUTER JOIN c ON l.o_custkey = c.o_custkey""",
)
def full_outer_merge(spark, d):
    """Both sides' keys, the second side wins."""
    orders = table(spark, d, "orders")
    side = lambda r, v: orders.where(F.col("o_orderkey") % 2 == r).groupBy("o_custkey").agg(F.max("o_totalprice").alias(v))
    return side(0, "local").join(side(1, "cloud"), "o_custkey", "full_outer").select("o_custkey", F.coalesce("cloud", "local").alias("v"))


@query("E21_merge_max", "SELECT p_name, max(p_retailprice) AS score FROM (SELECT p_name, p_retailprice FROM part UNION ALL SELECT p_name, p_retailprice * 0.9 FROM part) GROUP BY p_name")
def merge_max(spark, d):
    part = table(spark, d, "part").select("p_name", F.col("p_retailprice").alias("score"))
    return part.unionByName(part.select("p_name", (F.col("score") * 0.9).alias("score"))).groupBy("p_name").agg(F.max("score").alias("score"))


@query(
    "E23_shortlist_top_up",
    """WITH u AS (SELECT p_mfgr, p_partkey, 0 AS pri FROM (SELECT p_brand AS p_mfgr, p_partkey, p_size FROM part WHERE p_size > 45) UNION ALL SELECT p_brand, p_partkey, 1 FROM part WHERE p_size <= 45),
       r AS (SELECT p_mfgr, p_partkey, row_number() OVER (PARTITION BY p_mfgr ORDER BY pri, p_partkey) AS place FROM u)
       SELECT p_mfgr AS brand, p_partkey, place FROM r WHERE place <= 3""",
)
def shortlist_top_up(spark, d):
    """Preferred rows first, others fill up to three of a group."""
    ranked = table(spark, d, "part").select(F.col("p_brand").alias("brand"), "p_partkey", F.when(F.col("p_size") > 45, 0).otherwise(1).alias("pri"))
    place = F.row_number().over(Window.partitionBy("brand").orderBy("pri", "p_partkey")).cast("long")
    return ranked.withColumn("place", place).where("place <= 3").select("brand", "p_partkey", "place")


@query(
    "E05_title_with_veto",
    f"""WITH {NOTICES_SQL} SELECT id, CASE WHEN regexp_matches(title, '(?i)reserved') THEN NULL WHEN contains(lower(regexp_replace(title, '\\s+', '', 'g')), 'thethe') THEN 'thethe' WHEN contains(lower(regexp_replace(title, '\\s+', '', 'g')), 'the') THEN 'the' END AS name FROM notices""",
)
def title_with_veto(spark, d):
    """A veto word first, then the longest of the names that the normalised title contains."""
    t = normalised(F.col("title"))
    name = F.when(F.col("title").rlike("(?i)reserved"), F.lit(None)).when(F.contains(t, F.lit("thethe")), "thethe").when(F.contains(t, F.lit("the")), "the")
    return notices(spark, d).select("id", name.alias("name"))


def alternation(names: list[str]) -> str:
    """One pattern for a small dictionary, longest names first."""
    return "|".join(re.escape(n) for n in sorted(set(names), key=lambda n: (-len(n), n)))
