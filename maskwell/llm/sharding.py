"""Immutable shards with size-tiered compaction and versioned manifests, native.

Arrivals are appended as small Parquet shards, never changed. Shards of similar size (a tier
spans a factor of ``fanout``) are merged once ``fanout`` of them are there, into files of about
the target size; a file of half the target or more is final. Every change is one new manifest,
a JSON file made under a temporary name and renamed to its version, which fails if another
writer was first; then the change is tried again on the newer version. Readers use the files of
one version. Files that no kept version names are removed by ``vacuum``.

Data passes through DataFrame reads and writes only; the driver handles names and sizes of
files. Rows are kept as they are: nulls, empty and long texts, repeated rows, any columns. An
empty arrival adds no shard; an empty store reads as no rows. Ties have no meaning here. The rename that fails if the
version exists is what HDFS and local file systems give; a store without such a rename (most object stores) needs another
commit. Files of a failed or lost commit are named by no version and stay.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import hadoop_fs, temp_name

TARGET_BYTES, FANOUT = 128 << 20, 4


@dataclass(frozen=True)
class File:
    path: str
    size: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout

    # manifests

    def versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.root}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "schema": None, "files": []}
        fs, p = hadoop_fs(self.spark, f"{self.root}/manifest/v{known[-1] if version is None else version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: int, schema: str, files: list[File]) -> bool:
        """True if this version is ours; False if it exists already."""
        name = f"{self.root}/manifest/v{version:012d}.json"
        fs, temporary = hadoop_fs(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}.tmp")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version, "schema": schema, "files": [[f.path, f.size] for f in files]}).encode()))
        out.close()
        _, final = hadoop_fs(self.spark, name)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            # without the overwrite option this fails if the version exists
            context.rename(temporary, final, self._no_options())
        except Exception as e:
            fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _no_options(self):
        return self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _change(self, schema: str, gone: list[File], new: list[File]) -> bool:
        """Commit a change on the latest version. False: what should go is no longer there."""
        while True:
            now = self.manifest()
            files = [File(*x) for x in now["files"]]
            if not set(gone) <= set(files):
                return False
            if now["schema"] not in (None, schema):
                raise ValueError("an arrival has another schema than the store")
            if self._commit(now["version"] + 1, schema, [f for f in files if f not in set(gone)] + new):
                return True

    # data

    def _written(self, folder: str) -> list[File]:
        fs, p = hadoop_fs(self.spark, folder)
        if not fs.exists(p):
            return []
        return sorted((File(s.getPath().toString(), s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")), key=lambda f: f.path)

    def append(self, df: DataFrame) -> None:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        files = self._written(folder)
        if files:
            self._change(df.schema.json(), [], files)

    def append_arrivals(self, df: DataFrame, arrival, arrivals: int) -> None:
        """Append ``df`` as several arrivals, numbered 0 to ``arrivals`` - 1 by the column expression ``arrival``, in one
        pass over it; after each the store is compacted."""
        folder, name = f"{self.root}/data/{uuid.uuid4().hex}", temp_name(df, "arrival")
        df.withColumn(name, arrival).write.partitionBy(name).parquet(folder)
        for k in range(arrivals):
            files = self._written(f"{folder}/{name}={k}")
            if files:
                self._change(df.schema.json(), [], files)
                self.compact()
                self.vacuum()

    def tier(self, size: int) -> int:
        """Number of the size tier, counted from the smallest; -1: final."""
        return -1 if 2 * size >= self.target else int(math.log(max(1, size), self.fanout))

    def compact(self) -> int:
        """Merge tiers until none has ``fanout`` shards. Returns the number of merges."""
        merges = 0
        while True:
            now = self.manifest()
            tiers: dict[int, list[File]] = {}
            for path, size in now["files"]:
                if (t := self.tier(size)) >= 0:
                    tiers.setdefault(t, []).append(File(path, size))
            full = [t for t, files in sorted(tiers.items()) if len(files) >= self.fanout]
            if not full:
                return merges
            run = tiers[full[0]]
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            total = sum(f.size for f in run)
            self._read(now["schema"], run).coalesce(max(1, math.ceil(total / self.target))).write.parquet(folder)
            if self._change(now["schema"], run, self._written(folder)):
                merges += 1

    def _read(self, schema: str | None, files: list[File]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType([])
        if not files:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f.path for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        return self._read(m["schema"], [File(*x) for x in m["files"]])

    def vacuum(self, keep: int = 1) -> int:
        """Remove data files that none of the last ``keep`` versions names, and older manifests. Only while no
        append or merge runs. Returns the number of files."""
        known = self.versions()
        live = {x[0] for v in known[-keep:] for x in self.manifest(v)["files"]}
        # data of earlier versions only: a file that no version has named yet may be an arrival's
        old = {x[0] for v in known[:-keep] for x in self.manifest(v)["files"]} - live
        for path in old:
            fs, p = hadoop_fs(self.spark, path)
            fs.delete(p, False)
        for v in known[:-keep]:
            fs, p = hadoop_fs(self.spark, f"{self.root}/manifest/v{v:012d}.json")
            fs.delete(p, False)
        return len(old)
