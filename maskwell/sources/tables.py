"""String-typed table sources and sinks, row identity, windows, blocks and samples of rows."""

from __future__ import annotations

import glob
import io
import itertools
import os
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

if TYPE_CHECKING:
    import pyarrow as pa

BLOCK, SAMPLE_ROWS, CHUNK = 2000, 20_000, 50_000


def read_csv(spark: SparkSession, path: str, null_value: str | None = "NA", sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Every column a string; only ``null_value`` is null, empty fields stay empty. Files without line breaks in fields can be
    split: pass ``multi_line=False`` for them."""
    reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("emptyValue", "")
    # the parser gives null for an empty field: null words are made null after it, so that they stay apart
    out = reader.option("nullValue", "\x00").csv(path)
    text = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in out.columns}
    return out.select(*[(v if null_value is None else F.when(v != null_value, v)).alias(c) for c, v in text.items()])


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV, Parquet, ORC, JSON or XLSX by the name's end. A local CSV file without line breaks in fields is read in splits."""
    end = path.lower().rsplit(".", 1)[-1]
    if end == "xlsx":
        return read_xlsx(spark, path, **options)
    if end in ("parquet", "orc", "json"):
        df = getattr(spark.read, end)(path)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    if os.path.isfile(path):
        options.setdefault("multi_line", not newline_safe(path))
    return read_csv(spark, path, **options)


def read_xlsx(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet as text: the first row names the columns. Driver-side: a workbook is one small file."""
    from .workbook import read_sheet

    names, rows = read_sheet(path, sheet)
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))


def sheets(path: str) -> list[str]:
    from .workbook import sheet_names

    return sheet_names(path)


def write_xlsx(df: DataFrame, path: str, row_id: str | None = None) -> None:
    """One workbook of text cells, in row-id order if one is named. Rows stream through the driver, partition by partition; a
    sheet holds at most 1,048,575 of them, so larger tables are an error: use ``write_workbooks``, CSV or Parquet."""
    from .workbook import write_sheet

    out = df if row_id is None else df.orderBy(row_id).drop(row_id)
    write_sheet(path, out.columns, out.select(*[F.col(f"`{c}`").cast("string") for c in out.columns]).toLocalIterator())


def write_workbooks(df: DataFrame, path: str, row_id: str | None = None) -> None:
    """A folder of workbooks for a table of any size, written by the executors: each has the names and at most 100,000 rows. With a
    row id, rows are in its order over the files by name, and the id is left out."""
    from .workbook import write_parts

    spark = df.sparkSession
    out = df if row_id is None else df.orderBy(row_id).drop(row_id)
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for made in write_parts(names, (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))):
            yield pa.RecordBatch.from_arrays([pa.array([made.removesuffix(b"\n")], pa.binary())], ["workbook"])

    made = out.select(*[F.col(f"`{c}`").cast("string") for c in names]).mapInArrow(run, "workbook binary")
    if not _put_workbooks(made, path):  # a table without rows
        _put_workbooks(spark.createDataFrame([(next(write_parts(names, [])).removesuffix(b"\n"),)], "workbook binary"), path)


def _put_workbooks(made: DataFrame, path: str) -> int:
    """The text writer puts any bytes into a file, and commits what a task has written at once; the line break that it adds is the
    workbook's own last byte."""
    made.select(F.col("workbook").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", "\n").option("compression", "none").text(path)
    spark = made.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, n = where.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for found in fs.listStatus(where):
        old = found.getPath()
        if old.getName().endswith(".txt") and found.getLen() == 0:  # what a first partition without rows leaves
            fs.delete(old, False)
        elif old.getName().endswith(".txt"):
            new = spark._jvm.org.apache.hadoop.fs.Path(where, old.getName().removesuffix(".txt") + ".xlsx")
            if not fs.rename(old, new):
                raise OSError(f"{old} could not be renamed")
            n += 1
    return n


def read_workbooks(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One table of a folder's workbooks as text, read by the executors, a workbook at a time. All have the same names in their first row."""
    from .workbook import column_name, read_lines

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)

    def cut(names: list[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import pyarrow as pa

            for batch in batches:
                for file, content in zip(batch.column(0), batch.column(1), strict=True):
                    lines = read_lines(io.BytesIO(content.as_py()), sheet)
                    head = next(lines, {})
                    own = [head.get(k, column_name(k)) for k in range(max(head, default=-1) + 1)]
                    if names is None:
                        yield pa.RecordBatch.from_pydict({"names": [own]})
                        continue
                    if own != names:
                        raise ValueError(f"{file}: its columns are {own}, not {names}")
                    while rows := list(itertools.islice(lines, 10_000)):
                        if any(max(x, default=0) >= len(names) for x in rows):
                            raise ValueError(f"{file}: a cell stands beyond the named columns")
                        yield pa.RecordBatch.from_arrays([pa.array([x.get(k) for x in rows], pa.string()) for k in range(len(names))], names)

        return run

    first = files.select("path", "content").limit(1).mapInArrow(cut(None), "names array<string>").first()
    if first is None:
        raise FileNotFoundError(f"{path}: no workbooks")
    names = list(first["names"])
    return files.select("path", "content").mapInArrow(cut(names), StructType([StructField(c, StringType()) for c in names]))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, xml of the text files under a path: a row for each file, read by the executors."""
    return spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def preview(df: DataFrame, n: int = 50, row_id: str = "row_id") -> DataFrame:
    """The first ``n`` rows for display: by row id if the table has it."""
    return (df.orderBy(row_id) if row_id in df.columns else df).limit(n)


def header(df: DataFrame) -> list[str]:
    return df.columns


def with_row_id(df: DataFrame, name: str = "row_id", order: Sequence[str] | None = None) -> DataFrame:
    """Places 1..n: by the ``order`` columns, or else as the rows come."""
    from ..operators.ranks import dense_position, numbered

    return dense_position(df, order, name) if order else numbered(df, name)


def newline_safe(path: str, sep: str = ",") -> bool:
    """True if no field of a local CSV file holds a line break, so that it may be split anywhere: quotes are even on each line."""
    with open(path, "rb") as f:
        return all(line.count(b'"') % 2 == 0 for line in f)


@dataclass(frozen=True)
class Chunk:
    number: int
    start: int
    n: int


def plan_chunks(n_rows: int, size: int = CHUNK) -> list[Chunk]:
    """Row ranges (start from 1); an empty table has one chunk of no rows."""
    return [Chunk(k + 1, a, min(size, n_rows - a + 1)) for k, a in enumerate(range(1, n_rows + 1, size))] or [Chunk(1, 1, 0)]


def read_window(df: DataFrame, start: int = 1, n: int = 1000, row_id: str = "row_id") -> DataFrame:
    """Rows start .. start+n-1 by row id; a range filter, so it is pushed to the source."""
    start = max(1, start)
    return df.where(F.col(row_id).between(start, start + max(0, n) - 1)) if n > 0 else df.limit(0)


def read_blocks(df: DataFrame, blocks: Sequence[tuple[int, int]], row_id: str = "row_id") -> DataFrame:
    """Rows of several (start, n) ranges."""
    if not blocks:
        return df.limit(0)
    hit = F.lit(False)
    for start, n in blocks:
        hit = hit | F.col(row_id).between(start, start + n - 1)
    return df.where(hit)


def sample_blocks(n_rows: int, max_rows: int = SAMPLE_ROWS, block: int = BLOCK, seed: int = 1) -> list[tuple[int, int]]:
    """The whole range if it is small, else a seeded pick of whole, disjoint blocks in order; the same blocks replay on any table."""
    if n_rows <= max_rows:
        return [(1, n_rows)] if n_rows else []
    slots = range(n_rows // block)
    picked = sorted(random.Random(seed).sample(slots, min(len(slots), max(1, max_rows // block))))
    return [(s * block + 1, block) for s in picked]


def sample_table(df: DataFrame, n_rows: int, max_rows: int = SAMPLE_ROWS, block: int = BLOCK, seed: int = 1, row_id: str = "row_id") -> DataFrame:
    return read_blocks(df, sample_blocks(n_rows, max_rows, block, seed), row_id)


def write_csv(df: DataFrame, path: str, row_id: str | None = None) -> None:
    """CSV with nulls empty, in row-id order over the files if one is named (the id itself is left out)."""
    out = df if row_id is None else df.orderBy(row_id).drop(row_id)
    # the writer would cut white space off by itself
    out.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def file_type(path: str) -> str:
    end = path.lower().rsplit(".", 1)[-1]
    return "table" if end in ("csv", "xlsx", "xls", "parquet", "orc", "json") else end if end in ("pdf", "xml") else "skip"


def plan_files(inputs: str | Sequence[str], recursive: bool = False) -> list[tuple[str, str]]:
    """(path, type) of the files that folders, patterns and paths name, each once."""
    found: list[str] = []
    for x in [inputs] if isinstance(inputs, str) else inputs:
        if os.path.isdir(x):
            found += sorted(p for p in glob.glob(os.path.join(x, "**" if recursive else "", "*"), recursive=recursive) if os.path.isfile(p))
        else:
            found += sorted(glob.glob(x)) if glob.has_magic(x) else [x] if os.path.exists(x) else []
    return [(p, file_type(p)) for p in dict.fromkeys(map(os.path.abspath, found))]
