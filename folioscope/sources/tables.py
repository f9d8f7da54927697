"""Tables: readers, versioned directories, upserts and deletes without a transactional format.

A versioned table is a folder of directories ``v=<n>``; a reader pins the newest complete one (it has a
success marker), a writer makes the next.  Nothing is changed in place, so a lost job leaves no trace.
An appended version holds the new rows alone and names the version that it adds to; after
``CHAIN`` of them the next one is written whole.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """Names of the catalogue's tables; ``pattern`` is SQL LIKE with ``!`` as escape."""
    names = spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()] or [("",)], "name string").filter("name != ''")
    return names if pattern is None else names.filter(F.like(F.col("name"), F.lit(pattern), F.lit("!")))


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder; machine-local only where none is set and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/folioscope-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


#: Appended versions in a row; and the name, without its number, of the file that tells the version before.
CHAIN = 16
_BASE = "_base_"


class Versioned:
    """A table as a folder of versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        fs, root = _fs(self.spark, self.path)
        if not fs.exists(root):
            return []
        out = []
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if name.startswith("v=") and fs.exists(marker):
                out.append(int(name[2:]))
        return sorted(out)

    def exists(self) -> bool:
        return bool(self.versions())

    def _base(self, version: int) -> int | None:
        """The version that this one adds to."""
        fs, folder = _fs(self.spark, f"{self.path}/v={version}")
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return next((int(n[len(_BASE) :]) for n in names if n.startswith(_BASE)), None)

    def _chain(self, version: int) -> list[int]:
        out = [version]
        while (base := self._base(out[-1])) is not None:
            out.append(base)
        return out

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known:
            raise FileNotFoundError(self.path)
        parts = [self.spark.read.parquet(f"{self.path}/v={v}") for v in reversed(self._chain(known[-1] if version is None else version))]
        return reduce(merge_schema, parts)

    def _next(self, known: list[int]) -> int:
        return (known[-1] if known else 0) + 1

    def write(self, df: DataFrame, keep: int = 2) -> int:
        """Writes the next version whole and deletes all that the newest ``keep`` don't need."""
        known = self.versions()
        new = self._next(known)
        df.write.mode("overwrite").parquet(f"{self.path}/v={new}")
        needed = {v for newest in [*known, new][-keep:] for v in self._chain(newest)}
        for old in set(known) - needed:
            fs, path = _fs(self.spark, f"{self.path}/v={old}")
            fs.delete(path, True)
        return new

    def append(self, df: DataFrame) -> int:
        """Adds rows, and columns that are new, without touching those that are there."""
        known = self.versions()
        if not known or len(self._chain(known[-1])) > CHAIN:
            return self.write(merge_schema(self.read(), df) if known else df)
        new = self._next(known)
        fs, marker = _fs(self.spark, f"{self.path}/v={new}/{_BASE}{known[-1]}")
        fs.delete(marker.getParent(), True)  # what a lost job left
        fs.create(marker).close()
        df.write.mode("append").parquet(f"{self.path}/v={new}")
        return new

    def upsert(self, df: DataFrame, keys: list[str], order: list[str] | None = None) -> int:
        return self.write(upserted(self.read(), df, keys, order) if self.exists() else df)

    def delete(self, gone: DataFrame, keys: list[str]) -> int:
        return self.write(self.read().join(gone.select(*keys).distinct(), keys, "left_anti"))


def merge_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Additive migration: columns of either side, null where a side lacks one."""
    return old.unionByName(new, allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """INSERT OR REPLACE: rows of ``new`` replace rows of the same keys; the last by ``order`` wins."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(F.desc(c) for c in order or []))
    return both.withColumn("_place", F.row_number().over(last)).filter("_place = 1").drop("_new", "_place")


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """INSERT OR IGNORE: only rows of ``new`` whose keys are unknown are added, one for each key."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def by_id_list(df: DataFrame, ids: list[int], key: str = "rowid") -> DataFrame:
    """Rows of an id list in its order; ids that are missing are dropped.  The list is a query's page."""
    wanted = df.sparkSession.createDataFrame([(int(x), i) for i, x in enumerate(ids)] or [(None, None)], f"{key} long, ord long").filter("ord IS NOT NULL")
    return df.join(F.broadcast(wanted), key).orderBy("ord").drop("ord")


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """Count and order-free hash of a table, to key caches by its content."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("digest"))
