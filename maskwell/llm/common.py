"""Shared folder, staging tables and small native expressions used by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Where that is unset, a local master (tests) gets one of this machine, and
    a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        where = "file://" + tempfile.mkdtemp(prefix="maskwell-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Paths made since a caller last emptied this list; a caller that knows them to be read to the end may remove them early.
made_paths: list[str] = []


def run_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/maskwell/{name}-{uuid.uuid4().hex}"
    hadoop_fs(spark, path)[0].deleteOnExit(hadoop_fs(spark, path)[1])
    made_paths.append(path)
    return path


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path) of a URI; driver-side metadata calls only."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = hadoop_fs(spark, path)
        fs.delete(p, True)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = run_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def local_table(spark: SparkSession, **columns) -> DataFrame:
    """A small table of Arrow arrays, as part of the plan. (``createDataFrame`` of a list would start a daemon and workers of
    plain Python on the executors, which stay beside those that are there.)"""
    import pyarrow as pa

    return spark.createDataFrame(pa.table(columns))


def give_back() -> None:
    """Return freed memory of this Python process to the system: workers outlive their stage, and what they hold counts beside all later ones."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def temp_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (compared without case)."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, records: int = 512, size: str = "8m") -> None:
    """Let Python workers of this session get few documents at a time: whole texts can be long."""
    for k, v in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(records)), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        spark.conf.set(k, v)


def word_count(text: Column) -> Column:
    """Number of contract words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(0))), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
