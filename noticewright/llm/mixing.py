"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / size times on average. The whole part is taken
anyway; the fraction is a probability. Two fractions are paired and word mass moves from one to the
other, by chance in either direction and with no change on average, until one of them is 0 or 1.
The sum of size x probability never changes, so a source misses its target by less than the one
fraction that is left at the root of its reduction tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free_name, table, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
#: Children of a node in the reduction tree.
FAN = 256
#: Source rows (some 60 bytes each) that may be broadcast; more are joined by a salted shuffle.
BROADCAST_SOURCES = 50_000
SALTS = 64


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """sid, source, source_size, n, target: one row for each source.

    Sources in code point order (null last) take the weights in turn. A source stops at ``most``
    times its size and what is above goes to the others by weight; with the sources in order of
    the level at which each stops, that is one pass of running sums. The windows see one narrow row
    per source, never documents.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(filled.rowsBetween(0, Window.unboundedFollowing))
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        .withColumn("sid", F.row_number().over(by_name).cast("long") - 1)
        .withColumn("w", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .select("sid", "source", "source_size", "n", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")).alias("target"))
    )


def with_source(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Join documents with their source; null matches null. A source may hold any share of the rows."""
    named = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(named), same).drop("_source")
    salted = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_dealt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_dealt") == F.col("_salt"))).drop("_source", "_dealt", "_salt")


def _pivot(level: int, seed: int) -> Column:
    """Fractions ``items`` of one node, the largest document first, -> struct(cur: the one left,
    done: those settled). Large documents settle against many small ones, so what is left is small."""
    chance = f"pmod(xxhash64(s.cur.id, s.cur.size, x.id, x.size, {level}, {seed}), 9007199254740992) / 9007199254740992D"
    # up/down: words of mass that can move to the current document, or from it to the next one.
    moves = "named_struct('up', least(s.cur.size * (1 - s.cur.p), x.size * x.p), 'down', least(s.cur.size * s.cur.p, x.size * (1 - x.p)))"
    settle = lambda who, take: f"concat(s.done, array(named_struct('id', {who}.id, 'size', {who}.size, 'take', {take})))"
    left = lambda who, p: f"named_struct('size', {who}.size, 'id', {who}.id, 'p', greatest(0D, least(1D, {p})))"
    out = lambda cur, done: f"named_struct('cur', {cur}, 'done', {done})"
    step = f"""
      transform(array({moves}), m ->
        if({chance} * (m.up + m.down) < m.down,
           if(s.cur.size * (1 - s.cur.p) <= x.size * x.p,
              {out(left('x', 'x.p - m.up / x.size'), settle('s.cur', 1))},
              {out(left('s.cur', 's.cur.p + m.up / s.cur.size'), settle('x', 0))}),
           if(s.cur.size * s.cur.p <= x.size * (1 - x.p),
              {out(left('x', 'x.p + m.down / x.size'), settle('s.cur', 0))},
              {out(left('s.cur', 's.cur.p - m.down / s.cur.size'), settle('x', 1))})))[0]
    """
    return F.expr(f"aggregate(slice(items, 2, size(items)), named_struct('cur', items[0], 'done', cast(array() as array<struct<id: bigint, size: bigint, take: int>>)), (s, x) -> {step})")


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``.

    A null text has size 0; null is a source of its own, the last in order. An empty table gives an
    empty result; repeated rows are rounded one by one, each dealt to a node of its own number. Chance
    is a hash of ids and ``seed``, so reruns agree. No document is taken more than twice. Further
    columns are ignored, whatever their names, and texts are counted whole, however long.

    A node of the tree has at most about 256 children, whatever a source holds, and a level leaves
    one fraction per node: three levels do for 16 million documents of a source, five for 10^12.
    """
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sized")
    sources = written(source_targets(sized), "mix-sources")
    n_sources, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = with_source(sized, sources.withColumn("rate", rate), n_sources).withColumn("p", F.col("rate") - F.floor("rate"))
    open_ = (F.col("size") > 0) & (F.col("p") > 0)
    settled = [rated.where(~open_).select("sid", F.col("doc_id").alias("id"), "size", F.lit(0).alias("take"))]
    nodes = F.ceil(F.col("n") / FAN)
    # Rows of one id and size are counted and dealt out one by one, so that no node gets them all.
    alike = rated.where(open_).groupBy("sid", "doc_id", "size", "p", "n").agg(F.count(F.lit(1)).alias("alike"))
    each = alike.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    items = each.select("sid", F.pmod(F.xxhash64("doc_id", "size", "nth", F.lit(seed)), nodes).alias("node"), F.struct("size", F.col("doc_id").alias("id"), "p").alias("item"))
    width, level = -(-most // FAN), 0
    while True:
        level += 1
        tree = written(items.groupBy("sid", "node").agg(F.sort_array(F.collect_list("item"), False).alias("items")).select("sid", "node", _pivot(level, seed).alias("s")).select("sid", "node", "s.cur", "s.done"), f"mix-level{level}")
        settled.append(tree.select("sid", F.explode("done").alias("d")).select("sid", "d.*"))
        if width <= 1:
            break
        items = tree.select("sid", F.floor(F.col("node") / FAN).alias("node"), F.col("cur").alias("item"))
        width = -(-width // FAN)
    settled.append(tree.select("sid", "cur.id", "cur.size", (F.col("cur.p") >= 0.5).cast("int").alias("take")))
    taken = settled[0]
    for part in settled[1:]:
        taken = taken.unionByName(part)
    small = sources.select("sid", "source", "source_size", "target", F.floor(rate).cast("int").alias("whole"))
    if n_sources <= BROADCAST_SOURCES:
        joined = taken.join(F.broadcast(small), "sid")
    else:
        salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = taken.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["sid", "_salt"])
    copies = F.col("whole") + F.col("take")
    return joined.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """The mixed rows themselves: every row of ``docs`` as often as the plan takes it, all columns
    kept, whatever their names.

    Rows that share an id are told apart by their rank within that id (by source, size, content);
    which of equal rows is taken makes no difference. An empty table gives an empty result.
    """
    plan = mixing_plan(docs, id_col, text_col, source_col, seed)
    own = {c: free_name(docs, f"_mix_{c}") for c in ("id", "size", "rank", "pid", "prank", "copies", "copy")}
    rank = lambda who, *by: F.row_number().over(Window.partitionBy(who).orderBy(*by))
    plan = plan.withColumn("rank", rank("doc_id", "source", "size", "copies")).select(F.col("doc_id").alias(own["pid"]), F.col("rank").alias(own["prank"]), F.col("copies").alias(own["copies"]))
    keyed = docs.withColumn(own["id"], F.col(id_col).cast("long")).withColumn(own["size"], word_count(F.col(text_col))).withColumn(own["rank"], rank(own["id"], source_col, own["size"], F.xxhash64(text_col)))
    joined = keyed.join(plan, F.col(own["id"]).eqNullSafe(F.col(own["pid"])) & (F.col(own["rank"]) == F.col(own["prank"])))
    return joined.where(F.col(own["copies"]) > 0).withColumn(own["copy"], F.explode(F.sequence(F.lit(1), F.col(own["copies"])))).select(*columns(docs))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixing_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
