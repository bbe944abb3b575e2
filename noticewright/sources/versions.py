"""Several tables that change together (survey rows L19, L20): a version is written aside, and one
pointer says which version readers see.

``<root>/versions/<id>/<table>`` holds a version's tables, ``<root>/pointers/<number>`` names the
versions in the order in which they came into force. A pointer is made under another name and
renamed, which file systems of clusters do at once or not at all; so a reader sees all
tables of one version, and a run that fails before that leaves the last version in force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classification import LATIN, with_confidence, _confidence_sql
from ..operators.joins import first_per
from ..plans.views import notices
from ..registry import query
from .tables import scratch

PASSED = 0.6


class Versions:
    """Tables under ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.paths = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.paths(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _pointers(self) -> list[str]:
        folder = self.paths(f"{self.root}/pointers")
        if not self.files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return sorted(n for n in names if not n.startswith("_"))

    def current(self) -> str | None:
        """The version in force, null before the first."""
        names = self._pointers()
        return names[-1].partition("-")[2] if names else None

    def read(self, table: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise ValueError(f"no version of {self.root} is in force")
        return self.spark.read.parquet(f"{self.root}/versions/{version}/{table}")

    def replace(self, tables: dict[str, DataFrame]) -> str:
        """Write all ``tables`` as a new version and put it in force. What they read may be the version in force."""
        version = uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/versions/{version}/{name}")
        self.switch(version)
        return version

    def switch(self, version: str) -> None:
        """A writer that lost a race for the next number takes the one after it."""
        while True:
            names = self._pointers()
            number = int(names[-1].partition("-")[0]) + 1 if names else 0
            made, name = self.paths(f"{self.root}/pointers/_{version}"), self.paths(f"{self.root}/pointers/{number:012d}-{version}")
            self.files.create(made, True).close()
            if self.files.rename(made, name):
                return

    def clean(self, keep: int = 2) -> None:
        """Delete versions that aren't among the last ``keep`` in force, unfinished ones of failed runs too. Not to be
        run beside a writer."""
        names = self._pointers()
        kept = {n.partition("-")[2] for n in names[-keep:]}
        folder = self.paths(f"{self.root}/versions")
        for s in self.files.listStatus(folder) if self.files.exists(folder) else []:
            if s.getPath().getName() not in kept:
                self.files.delete(s.getPath(), True)
        for n in names[:-keep]:
            self.files.delete(self.paths(f"{self.root}/pointers/{n}"), False)


def scored(sources: list[DataFrame], rules) -> DataFrame:
    """Rows of all sources (id, title, content, spider), each id once, with confidence and status."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    out = with_confidence(first_per(rows, ["id"], ["spider"]), "title", "content", rules)
    return out.withColumn("status", F.when(F.col("confidence") >= PASSED, "passed").otherwise("rejected"))


def rebuild(store: Versions, sources: list[DataFrame], rules) -> str:
    """Score all sources again and replace the log of decisions and the curated table together (L20). The scores are
    written once; the curated table reads them there."""
    version = uuid.uuid4().hex
    path = f"{store.root}/versions/{version}"
    every = scored(sources, rules)
    every.select("id", "spider", F.round("confidence", 6).alias("confidence"), "status").write.parquet(f"{path}/decisions")
    passed = store.read("decisions", version).where("status = 'passed'").select("id", "confidence")
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    first_per(rows, ["id"], ["spider"]).select("id", "title", "spider").join(passed, "id").write.parquet(f"{path}/curated")
    store.switch(version)
    return version


@query("L20_rebuild", _confidence_sql(LATIN).rsplit("SELECT", 1)[0] + "SELECT * FROM (SELECT n.id, n.title, n.spider, c.confidence FROM (" + _confidence_sql(LATIN) + ") c JOIN notices n ON n.id = c.id) WHERE confidence >= 0.6")
def rebuild_query(spark, d):
    """The curated table after a rebuild from one table per language."""
    store = Versions(spark, scratch(spark, "rebuild"))
    n = notices(spark, d).select("id", "title", "content", "spider")
    by_language = [n.where(F.col("spider") == lang) for lang in ("de", "en", "es")] + [n.where(F.col("spider").isNull() | ~F.col("spider").isin("de", "en", "es"))]
    rebuild(store, by_language, LATIN)
    return store.read("curated")
