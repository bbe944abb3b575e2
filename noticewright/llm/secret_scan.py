"""Secrets in texts: three fixed patterns, and Markov models of characters for all other keys.

The models are first-order chains over the characters of keys, one of random strings and one of
ordinary identifiers, both counted from labelled samples. A run of such characters is a secret too
when the log-likelihood ratio of the two chains reaches ``LEAST_RATIO``. Everything runs as
DataFrame functions: runs are cut out by regular expressions, places are running sums over the
rows of a text, and a run is scored by adding up cells of one table of numbers.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, table, written

#: The base kinds in the contract's order. Runs of hex digits and of capitals are
#: maximal, so their least lengths may stand in the pattern; that of ``assign`` may not. What looks
#: ahead or behind only tells earlier where no match can start.
BASE = {
    "assign": r"""(?=[apstAPST])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
#: Every match of ``assign`` holds one of these, in lower case.
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 8
#: The kind that the models add, and the runs that they judge.
ADDED = "random"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
#: Characters of the chains, after the start of a run; others end no run and don't occur.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Samples of ordinary identifiers: runs of 8 characters and more that are words, joined words or
#: numbers, or words with a number behind them.
ORDINARY_RUN, ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}+", r"^[A-Za-z]*([+/_=-][A-Za-z]+)*[0-9]*$"
WORD = r"^[A-Za-z]+$"
#: Random strings of each of five alphabets in the samples.
RANDOM_STRINGS = 4096
#: Log-likelihood ratio, in thousandths of a nat, from which a run is a secret.
LEAST_RATIO = 20_000

_N = len(LETTERS)


def random_strings(spark, n: int = RANDOM_STRINGS) -> DataFrame:
    """value: ``n`` strings for each of hex digits in either case, base 64, letters and digits, and
    capitals and digits. Digests of numbers, so every run makes the same ones."""
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    plain = F.translate(base64, "+/=", "")
    kinds = [digest, F.upper(digest), base64, plain, F.upper(plain)]
    return spark.range(n).select(F.explode(F.array(*kinds)).alias("value"))


def ordinary_identifiers(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """value: the distinct ordinary identifiers of all texts."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(ORDINARY_RUN), 0)).alias("value"))
    return runs.where(F.col("value").rlike(ORDINARY)).distinct()


def transitions(samples: DataFrame) -> DataFrame:
    """label, a, b, second, n: how often character ``b`` follows ``a`` (empty: at the start) in the
    samples (value, label) of a label; ``second``: at the second place of a word of letters.

    A null value or label, and an empty value, are no matter.
    """
    known = samples.where("value <> '' and label in (0, 1)").select("label", "value", F.col("value").rlike(WORD).alias("word"))
    at = known.select("*", F.explode(F.sequence(F.lit(1), F.length("value"))).alias("at"))
    before = F.when(F.col("at") > 1, F.expr("substring(value, at - 1, 1)")).otherwise("")
    return at.groupBy("label", before.alias("a"), F.expr("substring(value, at, 1)").alias("b"), (F.col("word") & (F.col("at") == 2)).alias("second")).agg(F.count(F.lit(1)).alias("n")).where(F.col("a").isin("", *LETTERS) & F.col("b").isin(*LETTERS))


def styled(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """label, a, b, n: transitions of ordinary words in further styles: capitalised and joined, in
    capitals, and joined by an underline, a hyphen or a slash. They follow from ``counts`` and from
    the first and last letters of words, two tables that the alphabet bounds.
    """
    ordinary = counts.where("label = 0").select(F.col("a"), F.col("b"), "second", "n")
    letters = ordinary.where(F.col("a").rlike(WORD) & F.col("b").rlike(WORD))
    ends = samples.where(F.col("label") == 0).where(F.col("value").rlike(WORD)).groupBy(F.lower(F.substring("value", 1, 1)).alias("first"), F.lower(F.expr("right(value, 1)")).alias("last")).agg(F.count(F.lit(1)).alias("n"))
    first, last, up = F.col("first"), F.col("last"), F.upper
    joins = [(last, up(first)), (F.lit(""), up(first)), (F.lit(""), F.lit("/")), (up(last), F.lit("_")), (F.lit("_"), up(first))]
    joins += [pair for c in "_-/" for pair in ((last, F.lit(c)), (F.lit(c), first))]
    parts = [ends.select(a.alias("a"), b.alias("b"), "n") for a, b in joins]
    parts += [letters.select(up("a").alias("a"), up("b").alias("b"), "n"), letters.where("second").select(up("a").alias("a"), F.lower("b").alias("b"), "n")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(0).alias("label"), "a", "b", "n")


def numbers_and_dividers(spark, n: int = RANDOM_STRINGS) -> DataFrame:
    """label, a, b, n: further ordinary samples, ``n`` of 64 characters each: decimal numbers, all of
    whose digits are equally likely, and rows of each single mark."""
    digits, rows = [str(d) for d in range(10)], []
    rows += [("", c, n) for c in LETTERS[62:]] + [(c, c, 63 * n) for c in LETTERS[62:]]
    rows += [("", d, n // 10) for d in digits] + [(d, e, 63 * n // 100) for d in digits for e in digits]
    return spark.createDataFrame(rows, "a string, b string, n long").select(F.lit(0).alias("label"), "a", "b", "n")


def train(counts: DataFrame) -> np.ndarray:
    """The table of ratios: row 0 for the first character of a run, row i for what follows the i-th
    of ``LETTERS``, in thousandths of a nat.

    ``counts``: label (1: random, 0: ordinary), a, b, n; each pair counts as seen once more. Only
    the sums of the at most ``2 * (k + 1) * k`` cells for ``k`` letters reach the driver. Without
    samples all ratios are 0.
    """
    seen = np.ones((2, _N + 1, _N))
    place = {"": 0} | {c: i + 1 for i, c in enumerate(LETTERS)}
    for r in counts.groupBy("label", "a", "b").agg(F.sum("n").alias("n")).collect():
        seen[int(r["label"]), place[r["a"]], place[r["b"]] - 1] += r["n"]
    share = np.log(seen / seen.sum(axis=2, keepdims=True))
    return np.floor(1000 * (share[1] - share[0]) + 0.5).astype(np.int64)


def ratio(value: Column, model: np.ndarray) -> Column:
    """The log-likelihood ratio of a run of ``LETTERS``, in thousandths of a nat."""
    place = np.zeros(128, dtype=np.int64)
    place[[ord(c) for c in LETTERS]] = np.arange(1, _N + 1)
    cells, places = F.lit(model.ravel()), F.lit(place)
    code = lambda at: F.element_at(places, F.ascii(F.substring(value, at, F.lit(1))) + 1)
    first = F.element_at(cells, code(F.lit(1)).cast("int"))
    step = lambda s, i: s + F.element_at(cells, (code(i - 1) * _N + code(i)).cast("int"))
    return F.when(F.length(value) < 2, first).otherwise(F.aggregate(F.sequence(F.lit(2), F.length(value)), first, step))


def _cut(text: Column, found: Column, pattern: str, value: bool, ok) -> Column:
    """Per match of ``pattern``: the length of what stands before it since the last match, its own
    length, whether it counts, and itself if ``value``."""
    return F.when(
        F.size(found) > 0,
        F.zip_with(
            found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)),
            lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), ok(m).alias("ok"), (m if value else F.lit(None).cast("string")).alias("value")),
        ),
    )


def find_spans(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_RATIO) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): ``row``, doc_id of every row of ``docs``, and ``row``, kind, rank, start, end of
    every secret, in code points, the end exclusive.

    Base kinds are the leftmost non-overlapping matches. A run that overlaps none of them and whose
    ratio reaches ``least`` is of kind ``ADDED``. Null texts are empty. Repeated rows are rows of
    their own; so are rows without an id. Texts of any length are read whole, and what a text's
    windows hold is its own matches, never those of others. Further columns are ignored.
    """
    always = lambda m: F.lit(True)
    long_value = lambda m: F.length(F.regexp_extract(m, BASE["assign"], 2)) >= LEAST_VALUE
    kinds = [(k, p, False, long_value if k == "assign" else always) for k, p in BASE.items()] + [(ADDED, RUN, True, always)]
    found = lambda k, p, where: F.when(where, F.regexp_extract_all("text", F.lit(p), 0)).alias(f"found_{k}")
    low = F.lower("text")
    named = functools.reduce(Column.__or__, (low.contains(w) for w in ASSIGN_WORDS))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.select("*", found("assign", BASE["assign"], named), found(ADDED, RUN, F.lit(True)))
    # Matches of the other two kinds are parts of runs.
    base = base.select("*", *(found(k, BASE[k], F.size(f"found_{ADDED}") > 0) for k in ("access", "hex")))
    cut = written(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(_cut(F.col("text"), F.col(f"found_{k}"), p, v, ok).alias(k) for k, p, v, ok in kinds)), "secret-matches")
    ranked = lambda r: lambda m, at: F.struct(F.lit(r).alias("rank"), at.alias("at"), m.alias("m"))
    some = F.concat(*(F.transform(F.coalesce(F.col(k), F.array().cast(cut.schema[k].dataType)), ranked(r)) for r, (k, *_) in enumerate(kinds)))
    rows = cut.where(" or ".join(f"{k} is not null" for k, *_ in kinds)).select("row", F.explode(some).alias("s")).select("row", "s.rank", "s.at", "s.m.*")
    running = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(running)).withColumn("start", F.col("end") - F.col("len")).where("ok")
    is_base = F.col("rank") < len(BASE)
    scored = placed.where(is_base | (ratio(F.col("value"), model) >= least))
    # A base span overlaps a run if it ends behind the run's start and doesn't start behind its end.
    by_start = Window.partitionBy("row").orderBy("start", "rank")
    reached = F.max(F.when(is_base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(is_base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    spans = (
        scored.withColumn("free", (F.coalesce(reached, F.lit(0)) <= F.col("start")) & (F.coalesce(ahead, F.col("end")) >= F.col("end")))
        .where(is_base | F.col("free"))
        .select("row", F.element_at(F.array(*(F.lit(k) for k, *_ in kinds)), F.col("rank") + 1).alias("kind"), "rank", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    )
    return cut.select("row", "doc_id"), spans


def scan(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_RATIO) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are ``kind:start:end`` by start, then kind, joined by commas; a text without any has an
    empty string, and the digest of one. An empty table gives an empty result; null ids stay null.
    """
    texts, spans = find_spans(docs, model, id_col, text_col, least)
    kinds = [*BASE, ADDED]
    listed = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    by_text = (
        spans.groupBy("row")
        .agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds), F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("all"))
        .select("row", *(f"n_{k}" for k in kinds), listed(F.filter("all", lambda s: s["rank"] < len(BASE))).alias("base"), listed(F.col("all")).alias("spans"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.join(by_text, "row", "left").select("doc_id", *(zero(f"n_{k}") for k in kinds), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def model_of(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The models of a corpus: its own ordinary identifiers, all of them, against random strings."""
    spark = docs.sparkSession
    ordinary = written(ordinary_identifiers(docs, text_col).withColumn("label", F.lit(0)), "secret-ordinary")
    samples = ordinary.unionByName(random_strings(spark).withColumn("label", F.lit(1)))
    counts = written(transitions(samples), "secret-transitions")
    model = train(counts.select("label", "a", "b", "n").unionByName(styled(counts, ordinary)).unionByName(numbers_and_dividers(spark)))
    dropped(ordinary, counts)
    return model


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, model_of(docs))


def _sql() -> str:
    """The same in SQL: counts of transitions, the table of ratios, and spans by running sums."""
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join([either("password"), either("passwd"), either("secret"), either("token"), either("api") + "_?" + either("key")])
    assign = f"""({words})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = [("assign", assign), ("access", BASE["access"]), ("hex", "[0-9a-f]{32,}"), (ADDED, "[A-Za-z0-9+/_=-]{16,}")]
    joins = [("lst", "upper(fst)"), ("''", "upper(fst)"), ("''", "'/'"), ("upper(lst)", "'_'"), ("'_'", "upper(fst)")]
    joins += [pair for c in "_-/" for pair in (("lst", f"'{c}'"), (f"'{c}'", "fst"))]
    n, marks = RANDOM_STRINGS, ", ".join(f"'{c}'" for c in LETTERS[62:])
    spans = " UNION ALL ".join(
        f"""SELECT r, {k} AS rank, '{name}' AS kind, unnest(list_transform(range(1, len(f) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda v: length(v))), 0), 'v': f[i]}}), recursive := true)
            FROM (SELECT r, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS g FROM d)"""
        for k, (name, p) in enumerate(patterns)
    )
    listed = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank){where}, '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
ordinary AS (SELECT DISTINCT v FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{{8,}}')) AS v FROM d) WHERE regexp_matches(v, '{ORDINARY}')),
digests AS (SELECT sha256('sample ' || i) AS h, to_base64(unhex(sha256('sample ' || i))) AS b FROM range({n}) x(i)),
samples AS (SELECT 0 AS label, v FROM ordinary UNION ALL SELECT 1, unnest([h, upper(h), b, translate(b, '+/=', ''), upper(translate(b, '+/=', ''))]) FROM digests),
steps AS (SELECT label, v, unnest(range(1, length(v) + 1)) AS pos FROM samples),
pairs AS (SELECT label, CASE WHEN pos > 1 THEN substr(v, pos - 1, 1) ELSE '' END AS a, substr(v, pos, 1) AS b, pos = 2 AND regexp_matches(v, '{WORD}') AS scnd, count(*) AS n FROM steps GROUP BY ALL),
ends AS (SELECT lower(left(v, 1)) AS fst, lower(right(v, 1)) AS lst, count(*) AS n FROM ordinary WHERE regexp_matches(v, '{WORD}') GROUP BY ALL),
letters AS (SELECT * FROM pairs WHERE label = 0 AND regexp_matches(a, '{WORD}') AND regexp_matches(b, '{WORD}')),
marks AS (SELECT unnest([{marks}]) AS c), digits AS (SELECT CAST(i AS VARCHAR) AS c FROM range(10) x(i)),
counts AS (SELECT label, a, b, n FROM pairs UNION ALL SELECT 0, upper(a), upper(b), n FROM letters UNION ALL SELECT 0, upper(a), lower(b), n FROM letters WHERE scnd
  {' '.join(f'UNION ALL SELECT 0, {x}, {y}, n FROM ends' for x, y in joins)}
  UNION ALL SELECT 0, '', c, {n} FROM marks UNION ALL SELECT 0, c, c, {63 * n} FROM marks UNION ALL SELECT 0, '', c, {n // 10} FROM digits UNION ALL SELECT 0, x.c, y.c, {63 * n // 100} FROM digits x, digits y),
alphabet AS (SELECT unnest(string_split('{LETTERS}', '')) AS c), places AS (SELECT c FROM alphabet UNION ALL SELECT ''),
grid AS (SELECT l.label, p.c AS a, q.c AS b FROM (SELECT unnest([0, 1]) AS label) l, places p, alphabet q),
seen AS (SELECT g.label, g.a, g.b, 1 + coalesce(sum(c.n), 0) AS n FROM grid g LEFT JOIN counts c ON c.label = g.label AND c.a = g.a AND c.b = g.b GROUP BY ALL),
shares AS (SELECT label, a, b, ln(n / sum(n) OVER (PARTITION BY label, a)) AS s FROM seen),
cells AS (SELECT x.a, x.b, floor(1000 * (x.s - y.s) + 0.5) AS m FROM shares x JOIN shares y ON x.a = y.a AND x.b = y.b WHERE x.label = 1 AND y.label = 0),
spans AS (SELECT r, rank, kind, s, v, s + length(v) AS e FROM ({spans}) WHERE rank > 0 OR length(regexp_extract(v, '{assign}', 2)) >= {LEAST_VALUE}),
runs AS (SELECT DISTINCT v FROM spans WHERE rank = 3), chars AS (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM runs),
scores AS (SELECT v, sum(m) AS m FROM chars JOIN cells ON a = CASE WHEN i > 1 THEN substr(v, i - 1, 1) ELSE '' END AND b = substr(v, i, 1) GROUP BY v),
kept AS (SELECT * FROM spans WHERE rank < 3 UNION ALL SELECT c.* FROM spans c JOIN scores USING (v) WHERE rank = 3 AND m >= {LEAST_RATIO} AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.rank < 3 AND b.r = c.r AND b.s < c.e AND c.s < b.e)),
texts AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, _ in patterns)}, {listed(' FILTER (rank < 3)')} AS base, {listed('')} AS spans FROM kept GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, _ in patterns)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN texts USING (r)
"""


SQL = _sql()
