"""Exact deduplication as a stateful stream over a store of arrivals.

A store is a folder: arrivals as Parquet, with the digest of their normalised text; the checkpoint of a
structured stream over them; and the stream's updates. The stream keeps, in RocksDB state without
expiry, one entry per digest: the best document (most code points, then smallest doc_id), its
content locator (file and row) and the number of documents. A later arrival goes on from the state of
the earlier ones. Every hit is then checked by its full bytes: the hit's normalised text is
compared with that of the document the locator points to. Texts that share a digest but differ are
grouped again by their bytes, so the result is exact for any digest.

Hits of large groups are dealt over ``SALT`` parts by their row, and the one text they are compared with
is repeated for each part, so no group meets in one task.

Null texts count as empty; empty texts are one group; very long texts are compared whole. Of repeated rows
exactly one stays. Ties go to the smallest doc_id, null first, then the earliest row. Columns of any
name pass through ``deduplicate``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hadoop_fs, remove, run_path, temp_name, write_table

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.metricsEnabled": "false",
}
MAX_FILES = 2000
#: Parts of a group of more than so many documents in the check of bytes.
SALT, LARGE = 16, 256
ENTRY = "digest string, best struct<less:bigint,id:{id},row_key:bigint,file:string>, group_size bigint"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _best() -> Column:
    return F.struct((-F.col("n_points")).alias("less"), F.col("doc_id").alias("id"), F.col("row_key"), F.col("file"))


class DedupStore:
    """Arrivals, keyed state and its updates in a folder that all executors see."""

    def __init__(self, spark: SparkSession, root: str, digest_chars: int = 64, max_files: int = MAX_FILES):
        self.spark, self.root, self.digest_chars, self.max_files = spark, root.rstrip("/"), digest_chars, max_files

    def _exists(self, path: str) -> bool:
        fs, p = hadoop_fs(self.spark, path)
        return fs.exists(p)

    def add(self, docs: DataFrame) -> None:
        """An arrival: rows (doc_id, text, any others; the same columns each time) join the store, and its state."""
        norm, text = temp_name(docs, "norm"), F.coalesce("text", F.lit(""))
        row = docs.withColumn(norm, normalised(F.col("text")))
        row = row.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.length(text).cast("long").alias("n_points"), F.sha2(norm, 256).alias("text_sha256"))
        row = row.withColumns({"digest": F.substring("text_sha256", 1, self.digest_chars), "row_key": F.monotonically_increasing_id()})
        row.write.mode("append").parquet(f"{self.root}/arrivals")
        self._advance()

    def arrivals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/arrivals").withColumn("file", F.col("_metadata.file_path"))

    def _advance(self) -> None:
        """Let the stream read what has arrived since it last ran."""
        spark, old = self.spark, {k: self.spark.conf.get(k, None) for k in STATE}
        try:
            for k, v in STATE.items():
                spark.conf.set(k, v)
            schema = spark.read.parquet(f"{self.root}/arrivals").schema
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", self.max_files).parquet(f"{self.root}/arrivals")
            stream = stream.select("digest", "n_points", "doc_id", "row_key", F.col("_metadata.file_path").alias("file"))
            state = stream.groupBy("digest").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size"))

            def save(batch: DataFrame, n: int) -> None:
                batch.write.mode("overwrite").parquet(f"{self.root}/updates/batch={n}")

            query = state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in old.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    def entries(self) -> DataFrame:
        """digest, best, group_size: the state as it is now. An entry is sent again whenever it changes; the last one holds."""
        kind = self.arrivals().schema["doc_id"].dataType.simpleString()
        schema = T.StructType.fromDDL(ENTRY.format(id=kind))
        if not self._exists(f"{self.root}/updates"):
            return self.spark.createDataFrame([], schema)
        updates = self.spark.read.schema(schema.add("batch", "long")).parquet(f"{self.root}/updates")
        return updates.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "batch").alias("u")).select("digest", "u.best", "u.group_size")

    def close(self) -> None:
        """Give the state up; arrivals stay."""
        remove(self.spark, f"{self.root}/state")

    def groups(self) -> DataFrame:
        """Every arrived row: doc_id, keep_id, group_size, kept, text_sha256 and its locator (file, row_key)."""
        arrivals, entries = self.arrivals(), write_table(self.entries(), "dedup-groups")[0]
        salt = F.when(F.col("group_size") > LARGE, F.pmod("row_key", F.lit(SALT))).otherwise(0)
        many = entries.where("group_size > 1").select("digest", "group_size", F.col("best.file").alias("keep_file"), F.col("best.row_key").alias("keep_key"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
        # only texts of groups of several move, a large group in parts
        texts = arrivals.select("digest", "file", "row_key", F.col("row.text").alias("text"), F.pmod("row_key", F.lit(SALT)).cast("int").alias("part"))
        hits, hit_path = write_table(texts.join(many, ["digest", "part"]).withColumn("part", salt.cast("int")), "dedup-hits")
        own = F.expr("file = keep_file and row_key = keep_key")
        parts = F.when(F.col("group_size") > LARGE, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
        kept = hits.where(own).select("digest", F.col("text").alias("keep_text"), F.explode(parts).alias("part"))
        same = normalised(F.col("text")).eqNullSafe(normalised(F.col("keep_text")))
        collided, _ = write_table(hits.where(~own).join(kept, ["digest", "part"]).where(~same).select("digest").distinct(), "dedup-collided")
        remove(self.spark, hit_path)
        names = ["doc_id", "digest", "file", "row_key", "n_points", "text_sha256"]
        grouped = arrivals.select(*names).join(entries, "digest")
        if not collided.isEmpty():
            again = arrivals.join(collided, "digest", "left_semi").withColumn("norm", normalised(F.col("row.text")))
            exact = again.groupBy("digest", "norm").agg(F.min(_best()).alias("best"), F.count("*").alias("group_size"))
            grouped = grouped.join(collided, "digest", "left_anti").unionByName(again.select(*names, "norm").join(exact, ["digest", "norm"]).drop("norm"))
        stays = F.expr("row_key = best.row_key and file = best.file")
        return grouped.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256", "file", "row_key")


def _store(docs: DataFrame, digest_chars: int, max_files: int) -> DedupStore:
    store = DedupStore(docs.sparkSession, run_path(docs.sparkSession, "dedup"), digest_chars, max_files)
    store.add(docs)
    store.close()
    return store


def exact_groups(docs: DataFrame, digest_chars: int = 64, max_files: int = MAX_FILES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text), as one arrival."""
    return _store(docs.select("doc_id", "text"), digest_chars, max_files).groups().drop("file", "row_key")


def deduplicate(docs: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) that stay, with its columns."""
    store = _store(docs, 64, max_files)
    kept = store.groups().where("kept").select("file", "row_key")
    return store.arrivals().join(kept, ["file", "row_key"], "left_semi").select(*[F.col(f"row.`{c}`") for c in docs.columns])
