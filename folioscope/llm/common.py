"""Helpers shared by the training-data operators: tables, word rules, shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte table of the word rule ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lowering A-Z:
#: digits, a-z and every byte of a non-ASCII character stay, all else becomes a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: Byte table of the word rule ``[^\x20\x09-\x0D]+`` after lowering A-Z.
BLANK_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def split_words(data: bytes) -> list[bytes]:
    """Lower-cased words of the letter-and-digit rule."""
    return data.translate(WORD_BYTES).split()


def slices(batch, rows: int = 512):
    """An Arrow batch in parts, so that only few texts are Python objects at a time."""
    for at in range(0, batch.num_rows if hasattr(batch, "num_rows") else len(batch), rows):
        yield batch.slice(at, rows)


def release_memory() -> None:
    """Gives freed memory back to the system, since a worker lives on after a task that needed much."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set (single machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark.sparkContext, "_folioscope_checkpoints", None)
    if own is None:
        own = spark.sparkContext._folioscope_checkpoints = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


class Shelf:
    """Intermediate tables, written to the shared folder so that lineage ends there.

    ``put`` writes and rereads a frame; ``drop`` deletes a table that is no longer read, ``sweep`` the
    shuffle files of queries that are over, ``clear`` all.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/folioscope-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_shelf_path", None)
            if path:
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of queries that are over; it does so as their plans are collected."""
        import gc

        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        """Deletes all tables, and lets Spark delete the shuffle files of queries that are over."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.sweep()
