"""Scans and sinks (survey sections A and B): files, schema differences, keyed changes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import insert_or_ignore, or_anti
from ..plans.views import table
from ..registry import query


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``). Without that setting a
    temporary folder serves executors that are the driver's own threads; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="noticewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def coalesce_columns(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """The first of the columns that ``df`` has, row by row; resolved when the plan is made."""
    there = [F.col(n) for n in names if n in df.columns]
    default = F.lit(None).cast("string") if default is None else default
    return F.coalesce(*there, default) if there else default


#: Bytes of judged values that may be broadcast.
BROADCAST_JUDGED = 32 << 20


def once_each(rows: DataFrame, given: list[str], judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``judge`` adds to a table of the columns ``given``, which it keeps. Equal values are
    judged once and joined to all rows that have them, nulls too. For rules that take more time than a join: they are dealt to
    more tasks than their size asks for."""
    spark = rows.sparkSession
    values = rows.select(*given).distinct().repartition(4 * spark.sparkContext.defaultParallelism, *given)
    judged = judge(values)
    judged.write.parquet(path := scratch(spark, "judged"))
    judged = spark.read.schema(judged.schema).parquet(path)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 64 for c in given), F.lit(0))
    added = judged.select(*(F.col(c).alias(f"_given_{c}") for c in given), *(c for c in judged.columns if c not in given))
    if (judged.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_JUDGED:
        added = F.broadcast(added)
    same = [F.col(c).eqNullSafe(F.col(f"_given_{c}")) for c in given]
    return rows.join(added, same, "left").drop(*(f"_given_{c}" for c in given))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; non-ASCII text stays as it is."""
    df.write.mode("overwrite").json(path)


#: What stands for null in CSV files.
NULL = "\\N"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and line breaks kept."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option("lineSep", "\n").option("nullValue", NULL).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n").option("nullValue", NULL).option("emptyValue", "").csv(path)


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``stored`` by key, a null in ``new`` keeps the stored value
    (B8, B30 to B32)."""
    names = [c for c in stored.columns if c != key]
    joined = stored.join(new.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "full_outer")
    return joined.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def latest_status(log: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last status of each key of an append-only log."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


@query("A07_one_silo", "SELECT doc_id, text FROM documents WHERE lang = 'fr' AND source = 'src4'")
def one_silo(spark, d):
    return table(spark, d, "documents").where("lang = 'fr' and source = 'src4'").select("doc_id", "text")


@query("A08_schema_probe", "SELECT doc_id AS id, source AS publisher, CAST(NULL AS VARCHAR) AS link FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def schema_probe(spark, d):
    """Tables with unlike columns read by one projection."""
    one = lambda df: df.select(coalesce_columns(df, ["id", "doc_id", "page_id"]).alias("id"), coalesce_columns(df, ["publisher", "source", "org"]).alias("publisher"), coalesce_columns(df, ["url", "notice_url", "link"]).alias("link"))
    return one(table(spark, d, "documents")).unionByName(one(table(spark, d, "pages")))


@query("A09_key_range", "SELECT doc_id, source FROM documents WHERE doc_id BETWEEN 100 AND 900 AND lang = 'en' ORDER BY doc_id LIMIT 100")
def key_range(spark, d):
    return table(spark, d, "documents").where("doc_id between 100 and 900 and lang = 'en'").orderBy("doc_id").limit(100).select("doc_id", "source")


@query("A10_json_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_round_trip(spark, d):
    """JSON export and import (A10, A14, B19, B20, B28); broken lines would be null rows."""
    docs = table(spark, d, "documents")
    write_json(docs, path := scratch(spark, "json"))
    return spark.read.schema(docs.schema).option("mode", "PERMISSIVE").json(path)


def csv_safe(t: Column) -> Column:
    """Text whose carriage returns no CSV reader takes for line ends; ``csv_text`` is the inverse."""
    return F.replace(F.replace(t, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D"))


def csv_text(t: Column) -> Column:
    return F.replace(F.replace(t, F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))


@query("B17_csv_round_trip", "SELECT doc_id, text, lang, n_chars FROM documents")
def csv_round_trip(spark, d):
    """All texts, empty ones and those with carriage returns too; null has a mark of its own."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    write_csv(docs.withColumn("text", csv_safe(F.col("text"))), path := scratch(spark, "csv"))
    return read_csv(spark, path, docs.schema).withColumn("text", csv_text(F.col("text")))


@query("A12_map_to_rows", "SELECT n_name AS name, CASE n_regionkey % 4 WHEN 0 THEN 'A+' WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS level FROM nation")
def map_to_rows(spark, d):
    """A map of names to levels as rows."""
    level = F.element_at(F.array(*map(F.lit, ("A+", "A", "B", "C"))), (F.col("n_regionkey") % 4 + 1).cast("int"))
    one = table(spark, d, "nation").select(F.create_map("n_name", level).alias("m"))
    return one.select(F.explode("m").alias("name", "level"))


@query("A15_read_with_default", "SELECT c_custkey, coalesce(o_totalprice, -1) AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def read_with_default(spark, d):
    stored = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value"))
    return table(spark, d, "customer").join(stored, "c_custkey", "left").select("c_custkey", F.coalesce("value", F.lit(-1.0)).alias("value"))


@query("A17_catalogue", "SELECT 'documents' AS name, count(*) AS n, 5 AS columns FROM documents UNION ALL SELECT 'pages', count(*), 3 FROM pages UNION ALL SELECT 'events', count(*), 6 FROM events UNION ALL SELECT 'orders', count(*), 6 FROM orders")
def catalogue(spark, d):
    """Tables with their number of rows and columns."""
    parts = [table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n", F.lit(len(table(spark, d, n).columns)).alias("columns")) for n in ("documents", "pages", "events", "orders")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "B01_ingest_twice",
    "WITH b AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text) SELECT doc_id, 1 AS run FROM b",
)
def ingest_twice(spark, d):
    """Insert-or-ignore is idempotent: the second run of the same batch adds nothing."""
    batch = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("url"))
    nothing = batch.limit(0)
    first = insert_or_ignore(batch, nothing, "url", ["doc_id"]).withColumn("run", F.lit(1))
    second = insert_or_ignore(batch, first, "url", ["doc_id"]).withColumn("run", F.lit(2))
    return first.unionByName(second).select("doc_id", "run")


@query(
    "B08_upsert",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v, coalesce(b.w, a.w) AS w FROM (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS w FROM customer WHERE c_custkey % 3 <> 0) a
       FULL OUTER JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal + 1 END AS v, c_name AS w FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""",
)
def upsert_query(spark, d):
    c = table(spark, d, "customer")
    stored = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("w"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("v"), F.col("c_name").alias("w"))
    return upsert(stored, new, "k")


@query("B09_delete", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 10 = 0)")
def delete_query(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return delete(pages, pages.where("page_id % 10 = 0"), "url").select("page_id")


@query("B10_replace_partition", "SELECT doc_id, CASE WHEN lang = 'de' THEN n_chars + 1 ELSE n_chars END AS n_chars, lang FROM documents WHERE lang <> 'de' OR doc_id % 2 = 0")
def replace_partition(spark, d):
    """One spider's rows are replaced by a recrawl, the others stay (B10, B11, B15, B16): dynamic
    partition overwrite, set for this write alone."""
    docs, path = table(spark, d, "documents").select("doc_id", "n_chars", "lang"), scratch(spark, "silos")
    docs.write.partitionBy("lang").parquet(path)
    again = docs.where("lang = 'de' and doc_id % 2 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lang").parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


@query("B12_latest_status", "SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS status FROM events GROUP BY user_id")
def latest_status_query(spark, d):
    return latest_status(table(spark, d, "events").withColumnRenamed("event_type", "status"), "user_id", ["ts", "event_id"], "status")


@query("B24_user_data_json", "SELECT user_id, '{\"user_id\":' || user_id || ',\"n\":' || count(*) || '}' AS data FROM events GROUP BY user_id")
def user_data_json(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.to_json(F.struct("user_id", "n")).alias("data"))


def merge_patch(stored: DataFrame, patch: DataFrame, key: str, watched: str, flag: str) -> DataFrame:
    """``upsert`` of the fields of ``patch``; where ``watched`` gets another value, ``flag`` is cleared."""
    old = stored.select(F.col(key), F.col(watched).alias("_old"))
    merged = upsert(stored, patch.withColumn(flag, F.lit(None).cast(stored.schema[flag].dataType)), key).join(old, key, "left")
    changed = F.col("_old").isNotNull() & ~F.col(watched).eqNullSafe(F.col("_old"))
    return merged.withColumn(flag, F.when(~changed, F.col(flag))).drop("_old")


@query(
    "B32_merge_patch",
    """WITH e AS (SELECT *, CAST(floor(value / 50) AS BIGINT) AS level, ts >= TIMESTAMP '2024-01-20' AS late FROM events),
        s AS (SELECT user_id, arg_max(level, (ts, event_id)) FILTER (event_type = 'view') AS level, max(value) FILTER (event_type = 'click') AS click, bool_or(event_type = 'signup') AS sent FROM e WHERE NOT late GROUP BY user_id),
        p AS (SELECT user_id, arg_max(level, (ts, event_id)) FILTER (event_type = 'view') AS level, max(value) FILTER (event_type = 'click') AS click FROM e WHERE late GROUP BY user_id)
        SELECT user_id, coalesce(p.level, s.level) AS level, coalesce(p.click, s.click) AS click, CASE WHEN s.level IS NULL OR p.level IS NULL OR p.level = s.level THEN s.sent END AS sent FROM s FULL JOIN p USING (user_id)""",
)
def merge_patch_query(spark, d):
    """What is known of users, patched by their later events; another level clears what was sent."""
    e = table(spark, d, "events").withColumn("level", F.floor(F.col("value") / 50).cast("long"))
    last = F.max_by("level", F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))).alias("level")
    click = F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("click")
    late = F.col("ts") >= F.lit("2024-01-20").cast("timestamp")
    stored = e.where(~late).groupBy("user_id").agg(last, click, F.bool_or(F.col("event_type") == "signup").alias("sent"))
    return merge_patch(stored, e.where(late).groupBy("user_id").agg(last, click), "user_id", "level", "sent").select("user_id", "level", "click", "sent")


@query("B35_newest_twenty", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'view') WHERE rn <= 20")
def newest_twenty(spark, d):
    """History, the newest twenty of each key."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").where("event_type = 'view'").withColumn("rn", rn).where("rn <= 20").select("event_id", "user_id")


@query("B21_export_with_filter", "SELECT doc_id, source, coalesce(nullif(trim(lang), ''), 'unknown') AS lang FROM documents WHERE contains(source, 'src1')")
def export_with_filter(spark, d):
    """Filtered export, written and read back."""
    from ..operators.filters import field_keyword

    rows = field_keyword(table(spark, d, "documents"), "source:src1").select("doc_id", "source", F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("unknown")).alias("lang"))
    write_json(rows, path := scratch(spark, "export"))
    return spark.read.schema(rows.schema).json(path)


@query(
    "B05_two_key_insert",
    """WITH n AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS BIGINT) // 100 AS price FROM orders WHERE o_orderstatus <> 'F'), s AS (SELECT o_custkey, CAST(o_totalprice AS BIGINT) // 100 AS price FROM orders WHERE o_orderstatus = 'F'),
        a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS x FROM n), b AS (SELECT *, row_number() OVER (PARTITION BY price ORDER BY o_orderkey) AS y FROM a WHERE x = 1)
        SELECT o_orderkey FROM b WHERE y = 1 AND o_custkey NOT IN (SELECT o_custkey FROM s) AND price NOT IN (SELECT price FROM s)""",
)
def two_key_insert(spark, d):
    """Insert unless either of two keys is stored already."""
    o = table(spark, d, "orders").withColumn("price", F.floor(F.round("o_totalprice").cast("long") / 100).cast("long"))
    return or_anti(o.where("o_orderstatus <> 'F'"), o.where("o_orderstatus = 'F'"), ("o_custkey", "price"), ["o_orderkey"]).select("o_orderkey")
