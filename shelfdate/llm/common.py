"""What the operators of this subpackage share: word rule, row packing, tables kept between jobs."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space; bytes.split() cuts UTF-8 at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of its own only for a local session without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="cut-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def keep(rows: DataFrame) -> DataFrame:
    """Writes rows as a Parquet table into the shared folder and reads it back: later jobs start from the table,
    lost executors recompute nothing before it. The table goes when the session's file system closes."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    kept = spark.read.schema(rows.schema).parquet(path)
    kept.kept_at = path
    return kept


def forget(*kept: DataFrame) -> None:
    """Deletes kept tables that nothing reads any more: what was made from them must itself be kept."""
    for rows in kept:
        spark = rows.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(rows.kept_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: What tasks remember between batches and tasks, by the module that does.
_remembered: dict[str, dict] = {}


def remembers(owner: str, cache: dict) -> dict:
    _remembered[owner] = cache
    return cache


def settle(owner: str = "") -> None:
    """At the start of a task: a worker process that served another operator before forgets what that one remembered."""
    for name, cache in _remembered.items():
        if name != owner:
            cache.clear()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """The whole row as one column, so that no name an operator adds can clash with the caller's columns."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def crc_remainder(value, divisor: int) -> int:
    """The same on a Python value."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % divisor


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width: parts of the data follow it, so they stay alike at every size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
