"""What the operators of this subpackage share: the shared folder, tables written in it, words."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space and the ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which every executor sees.

    Where that is unset, a session in local mode, whose one machine sees its own folders, gets one below its warehouse;
    on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them again, which cuts the lineage and outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Bound what Spark hands to a Python worker at once: long texts make the default of 10,000 rows too much.

    The operators return plans that run later, so that the session keeps the bounds; smaller ones that it has stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", mb << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Give memory that a Python worker has freed back to the machine: workers are kept for later tasks of any kind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    c = ctypes.CDLL(None)
    if hasattr(c, "malloc_trim"):
        c.malloc_trim(0)


def released(batches: Iterator, rows: int = 1 << 15) -> Iterator:
    """The Arrow batches in parts of so many rows; after the last, what making them took is given back.

    Spark's side keeps the memory that the largest batches took for later ones.
    """
    for b in batches:
        for a in range(0, max(1, b.num_rows), rows):
            yield b.slice(a, rows)
    del batches
    trim()


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def buckets(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
