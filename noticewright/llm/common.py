"""What the operators share: the shared folder, written tables, white space, words."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract in this package, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


#: Spark's setting that deletes the shuffle files of a job when the job ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting of the bytes of an Arrow batch, and what whole texts are sent in. Ten thousand of them (Spark's own limit)
#: would stand in the JVM's direct memory, in the Python worker and as its strings at once, for each task.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves a session whose executors are the
    driver's own threads, and is kept in the session; a cluster without the setting is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not (m := spark.sparkContext.master).startswith("local") or m.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="noticewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/noticewright/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def freed_shuffles(spark: SparkSession):
    """Jobs in here leave no shuffle files behind: what they write has replaced them."""
    return _setting(spark, FREE_SHUFFLES, "true")


def small_batches(spark: SparkSession):
    """Jobs in here send rows to Python in batches of ``BATCH_BYTES``."""
    return _setting(spark, ARROW_BYTES, BATCH_BYTES)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    with freed_shuffles(spark):
        df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.written_path = path
    return again


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it where columns of ``df`` have it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def one_spaced(text: Column) -> Column:
    """Null is empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def word_count(text: Column) -> Column:
    """Words of ``text`` (null: 0): each becomes one letter and the letters are counted, so that
    no array of a long text's words is built."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(letters, SPACES, "")).cast("long")
