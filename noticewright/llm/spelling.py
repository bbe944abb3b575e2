"""Spelling variants: words that differ by one character, and the frequent form each stands for.

Every word has its bigrams in one order, the rarest first. Its *prefix* is the three rarest and
those that share the last one's place; its *pivots* are two disjoint ones of them with the smallest
total frequency. Of two words that differ by one edit, the one whose prefix ends earlier keeps a
pivot that is in the other's prefix: an edit before the second pivot leaves that one and all behind it, any other
edit leaves the first one and all before it. The place of the pivot then shifts by the difference in
length, and of the rest of the word, cut in the middle, one half is equal as well. Pivots are
indexed with those equal parts, and what meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, table, written

#: Maximal runs of these are words; only A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, TIMES, ERROR = 7, 2, 10, 31

#: A word's place in the order at which its prefix ends, the prefix and the pivots, by place.
PIVOTS = "last long, prefix array<int>, first int, second int"


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, error: int = ERROR) -> DataFrame:
    """word: every run of ``least`` letters and more, one character taken out where ``error`` divides
    the checksum of id and run. A null id is written as nothing."""
    low = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"(?<![{LETTERS}])[{LETTERS}]{{{least},}}+"), 0)).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    hit = runs.withColumn("h", h).withColumn("at", F.when(F.col("h") % error == 0, (F.col("h") % F.length("run")).cast("int")))
    word = F.when(F.col("at").isNull(), F.col("run")).otherwise(F.expr("concat(substring(run, 1, at), substring(run, at + 2))"))
    return hit.select(word.alias("word")).where(F.length("word") >= least)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, error: int = ERROR) -> DataFrame:
    """word, n: the distinct words that occur twice at least."""
    counted = occurrences(docs, id_col, text_col, least, error).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], int, int]:
    """See ``PIVOTS``. ``order``: per bigram its place in the order and its frequency.

    A bigram's own place is its second key. The prefix holds what comes up to one place behind its
    third bigram, since an edit may shift the equal bigram of another word by one.
    """
    grams = sorted((order[word[i : i + 2]][0] << 32 | i, i) for i in range(len(word) - 1))
    last = grams[2][0]
    prefix = sorted(i for at, i in grams[:4] if at <= last + 1)
    # Dynamic program over places: the cheapest choice of k disjoint bigrams of the three rarest.
    best: list[list[tuple[int, tuple[int, ...]]]] = []
    for i in sorted(i for _, i in grams[:3]):
        cost = order[word[i : i + 2]][1]
        before = [c for own in best for c in own if len(c[1]) == 1 and c[1][0] + 2 <= i]
        pair = [(c + cost, (*p, i)) for c, p in [min(before)]] if before else []
        best.append([(cost, (i,)), *pair])
    first, second = min(c for own in best for c in own if len(c[1]) == 2)[1]
    return last, prefix, first, second


def _keys(at: Column, length: Column, shift: Column, before: Column, behind: Column) -> Column:
    """Hashes of the equal parts of ``word``, for a bigram at ``at`` of a word of ``length``, of which
    ``word`` is one of ``length - shift`` characters: two for an edit before the bigram, if
    ``before``, and two for one behind it, if ``behind``."""
    left = lambda n: F.substring("word", F.lit(1), n)
    from_ = lambda n: F.substring("word", n + 1, F.length("word"))
    half = F.floor(at / 2).cast("int")
    rest = (at + 2 + F.floor((length - at - 2) / 2)).cast("int")
    hashed = lambda side, *parts: F.xxhash64(F.lit(side), at, length, *parts)
    ahead = F.array(
        hashed(0, left(half), from_(at - shift)),
        F.when(half >= shift, hashed(1, from_(half - shift))),
    )
    after = F.array(
        F.when(rest - shift >= at + 2, hashed(2, left(at + 2), from_(rest - shift))),
        F.when(rest <= F.length("word"), hashed(3, left(rest))),
    )
    none = F.array().cast("array<bigint>")
    return F.explode(F.filter(F.concat(F.when(before, ahead).otherwise(none), F.when(behind, after).otherwise(none)), lambda k: k.isNotNull()))


def near_words(counted: DataFrame) -> DataFrame:
    """word, near, n, near_n: all pairs of ``counted`` (word, n; a written table of distinct words of
    four characters and more) that differ by one edit, once in one of both directions at least.

    Bigrams of the alphabet are at most its size squared (8,100), so their order may be sent to
    the tasks. A word makes 12 index rows and at most 16 rows that ask, whatever the others are.
    """
    spark = counted.sparkSession
    grams = counted.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    seen = sorted((r["count"], r["gram"]) for r in grams.groupBy("gram").count().collect())
    shared = spark.sparkContext.broadcast({g: (i, n) for i, (n, g) in enumerate(seen)})

    def run(batches: Iterator[pd.DataFrame]):
        for f in batches:
            found = [prefix_and_pivots(w, shared.value) for w in f["word"]]
            yield pd.concat([f, pd.DataFrame(found, columns=["last", "prefix", "first", "second"], index=f.index)], axis=1)

    known = written(counted.mapInPandas(run, f"word string, n long, {PIVOTS}"), "variant-pivots")
    yes, no = F.lit(True), F.lit(False)
    shifts = known.withColumn("shift", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    length = F.length("word") + F.col("shift")
    index = shifts.select("word", "n", "last", _keys(F.col("first"), length, F.col("shift"), no, yes).alias("key")).unionByName(
        shifts.where("second + shift >= 0").select("word", "n", "last", _keys(F.col("second") + F.col("shift"), length, F.col("shift"), yes, no).alias("key"))
    )
    asking = known.withColumn("at", F.explode("prefix")).select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("last").alias("near_last"), _keys(F.col("at"), F.length("word"), F.lit(0), yes, yes).alias("near_key"))
    same = (F.col("key") == F.col("near_key")) & (F.col("last") <= F.col("near_last")) & (F.col("word") != F.col("near"))
    met = index.join(asking, same).where(F.abs(F.length("word") - F.length("near")) <= 1)
    pairs = written(met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "n", "near_n"), "variant-pairs")
    dropped(known)
    return pairs


def rooted(forms: DataFrame) -> DataFrame:
    """Add ``root`` to ``forms`` (word, form, ...), a written table: forms followed to the last.

    A form occurs ``TIMES`` times as often as its word, so a chain has at most 19 steps for any
    count of 64 bits. Each round doubles the steps and the rounds end when none leads further.
    """
    up = written(forms.where("form is not null").select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        further = up.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        joined = up.join(further, F.col("root") == F.col("_at"), "left")
        again = written(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "variant-roots")
        dropped(up)
        moved, up = not again.where("moved").isEmpty(), again
        if not moved:
            break
    found = up.select("word", "root")
    return forms.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, error: int = ERROR) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per distinct word of the corpus.

    A word's form is its near word of largest n (ties: the smallest by code points) if that n is
    ``times`` its own at least; its root is where forms lead. Null and empty texts have no words,
    rows without an id have theirs counted, repeated rows count each, an empty table gives an empty result, and
    further columns are ignored. Words are of any length. A group never holds more than the near
    words of one word, which the alphabet and its length bound.
    """
    counted = written(words(docs, id_col, text_col, error=error), "variant-words")
    pairs = near_words(counted)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("near_n").alias("n"), F.col("n").alias("near_n")))
    # The largest n first, then the smallest word: a struct of -n and the word, least first.
    best = both.groupBy("word").agg(F.collect_set(F.struct((-F.col("near_n")).alias("less"), "near")).alias("all")).select("word", F.size("all").cast("long").alias("n_near"), F.array_min("all").alias("best"))
    form_n = -F.col("best.less")
    good = form_n >= times * F.col("n")
    forms = written(
        counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, form_n).alias("form_n")),
        "variant-forms",
    )
    dropped(counted, pairs)
    return rooted(forms).select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Checksums by a table made from its rule; near words by what is left when one character goes.
SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
runs AS (SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]{{{LEAST_LENGTH},}}')) AS run FROM documents) GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM runs),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT CASE WHEN h % {ERROR} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n) AS n FROM sums GROUP BY 1),
w AS (SELECT word, CAST(n AS BIGINT) AS n FROM words WHERE length(word) >= {LEAST_LENGTH} AND n >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
less AS (SELECT DISTINCT c.word, c.n, w.word AS near, w.n AS near_n FROM cut c JOIN w ON w.word = c.rest),
near AS (SELECT * FROM less UNION SELECT near, near_n, word, n FROM less UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * n THEN form END AS form, CASE WHEN form_n >= {TIMES} * n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (WITH RECURSIVE u AS (SELECT word, word AS root FROM forms UNION ALL SELECT u.word, f.form FROM u JOIN forms f ON f.word = u.root WHERE f.form IS NOT NULL) SELECT u.word, u.root FROM u JOIN forms f ON f.word = u.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN up USING (word)
"""
