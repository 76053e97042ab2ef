"""Mix sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the i-th golden-ratio point; the cumulative shares of the sources'
targets map it to a source, and slots are ranked per source. Each source's documents, in a
seeded hash order, form one endless token stream (it starts again at its end) cut into blocks
of equal size; the slot of rank r takes block r. The last block of a source is cut at its
target, and the few slots by which the schedule is short of a source follow at its end, so a
source's taken tokens equal its rounded target.

Sizes are word counts; null and empty texts have size 0 and are never taken. Null is a source
of its own, sorted last. Repeated rows are documents of their own. Very long texts fill several
blocks. Ties in the seeded order go by doc_id, then row. Columns of any name pass through
``mixed_documents``. Empty tables give no rows. The driver holds a row for each source (its size,
target and quota). Everything else is keyed by (source, bucket) or (source, block): no source,
however large, meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, local_table, temp_name, word_count, write_table

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0
BLOCK = 1024
#: Slots per unit of the schedule; documents per bucket of a source's order.
CHUNK, BUCKET = 1 << 16, 4_000
#: The sources' table is broadcast up to this many rows, else joined.
BROADCAST_SOURCES = 100_000
GOLDEN = 0x9E3779B97F4A7C15


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Split ``share`` times all sizes by weight; what exceeds ``cap`` times a size is shared again among the others."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        unit = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * unit > cap * sizes[k]]
        if not over:
            for k in open_:
                out[k] = weights[k] * unit
            break
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        open_ = [k for k in open_ if k not in set(over)]
    return out


def schedule(first: int, n: int, cumulative: np.ndarray) -> np.ndarray:
    """Source of slots first .. first+n-1: golden-ratio points, as exact 64-bit fractions, through cumulative shares."""
    points = np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(GOLDEN)
    return np.minimum(np.searchsorted(cumulative, points, side="right"), len(cumulative) - 1)


@dataclass
class Mix:
    """docs: row_key, doc_id, source, size, source_size, target. taken: slot, k (source's number), block, row_key,
    doc_id, epoch, first_word, words."""

    docs: DataFrame
    taken: DataFrame
    slots: int
    sources: list = field(default_factory=list)


def _slots(spark, quotas: list[int]) -> DataFrame:
    """(k, block, slot): for every source k as many slots as its quota, by the schedule."""
    total = sum(quotas)
    shares = np.cumsum(np.array(quotas, object))
    cumulative = np.array([min((int(c) << 64) // max(1, total), (1 << 64) - 1) for c in shares], np.uint64)
    chunks = spark.range(0, math.ceil(total / CHUNK), 1, max(1, math.ceil(total / CHUNK / 16)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["id"]:
                n = np.bincount(schedule(c * CHUNK, min(CHUNK, total - c * CHUNK), cumulative), minlength=len(cumulative))
                k = np.nonzero(n)[0]
                yield pd.DataFrame({"chunk": c, "k": k, "n": n[k]})

    counts, _ = write_table(chunks.mapInPandas(count, "chunk long, k int, n long"), "mix-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.withColumn("base", before).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("k", "base"))).alias("bases"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = np.array(quotas, np.int64)
        for pdf in batches:
            for c, own in zip(pdf["chunk"], pdf["bases"], strict=True):
                k = schedule(c * CHUNK, min(CHUNK, total - c * CHUNK), cumulative)
                rank = np.zeros(len(k), np.int64)
                order = np.argsort(k, kind="stable")
                starts = np.concatenate(([0], np.cumsum(np.bincount(k, minlength=len(limit)))))
                rank[order] = np.arange(len(k)) - starts[k[order]]
                base = np.zeros(len(limit), np.int64)
                for x in own:
                    base[x["k"]] = x["base"]
                rank += base[k]
                good = rank < limit[k]
                yield pd.DataFrame({"k": k[good], "block": rank[good], "slot": np.nonzero(good)[0] + c * CHUNK})

    dealt = bases.mapInPandas(deal, "k int, block long, slot long")
    have = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a row for each source
    short = [k for k, q in enumerate(quotas) if have.get(k, 0) < q]
    if short:
        lack = local_table(spark, k=pa.array(short, pa.int32()), a=pa.array([have.get(k, 0) for k in short], pa.int64()), b=pa.array([quotas[k] for k in short], pa.int64()))
        rest = lack.select("k", F.explode(F.expr("sequence(a, b - 1)")).alias("block"))
        dealt = dealt.unionByName(rest.withColumn("slot", F.lit(total) + F.col("block")))
    return dealt


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> Mix:
    """Mix ``docs`` (doc_id, source, text). Weights repeat over the sources in code-point order, null last."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    rows, _ = write_table(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size")), "mix-docs")
    return mix_rows(rows, weights, share, cap, block)


def mix_rows(rows: DataFrame, weights: Sequence[float], share: float, cap: float, block: int) -> Mix:
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(found))], share, cap)
    whole = [min(round(t), math.floor(cap * n)) for t, n in zip(goal, sizes, strict=True)]
    names = pa.array([r["source"] for r in found], pa.string())
    table = local_table(spark, k=pa.array(range(len(found)), pa.int32()), name=names, source_size=pa.array(sizes, pa.int64()), target=pa.array(goal, pa.float64()), whole=pa.array(whole, pa.int64()))
    table = F.broadcast(table) if len(found) <= BROADCAST_SOURCES else table
    marked = rows.join(table, rows["source"].eqNullSafe(table["name"])).drop("name")
    buckets = max(1, math.ceil(sum(r["docs"] for r in found) / BUCKET))
    # place of each document in its source's stream: within its bucket of the hash order, then the buckets before it
    marked = marked.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 11)).cast("double") / float(1 << 53) * buckets).cast("long"))
    order = Window.partitionBy("k", "bucket").orderBy(F.shiftrightunsigned("h", 11), "h", "doc_id", "row_key")
    within = marked.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    sums = marked.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).drop("n")
    placed = within.join(sums, ["k", "bucket"]).where("size > 0").withColumn("at", F.col("at") + F.col("before"))
    passes = placed.select("k", "row_key", "doc_id", "at", "size", "source_size", "whole", F.explode(F.expr("sequence(0L, greatest(0L, cast(ceil(whole / source_size) as long) - 1))")).alias("epoch"))
    spans = passes.selectExpr("k", "row_key", "doc_id", "epoch", "epoch * source_size + at as a", "least(epoch * source_size + at + size, whole) as b").where("a < b")
    cut = spans.select("*", F.explode(F.expr(f"sequence(a div {block}, (b - 1) div {block})")).alias("block"))
    pieces = cut.selectExpr("k", "block", "row_key", "doc_id", "epoch", f"greatest(a, block * {block}) - a as first_word", f"least(b, (block + 1) * {block}) - greatest(a, block * {block}) as words")
    quotas = [math.ceil(w / block) for w in whole]
    slots = _slots(spark, quotas)
    return Mix(marked.select("row_key", "doc_id", "source", "size", "source_size", "target"), slots.join(pieces.hint("merge"), ["k", "block"]), sum(quotas), found)


def taken_words(mixed: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot (the schedule's slot in which it comes first; null: never)
    of every document."""
    sums = mixed.taken.groupBy("row_key").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return mixed.docs.join(sums, "row_key", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The documents that the mix takes, with the columns of ``docs``, in the order of the schedule (of the slots in which they
    begin): a row each time one is taken, its text cut (after whole words, joined by spaces) where its source's target ends
    within it. n_chars, if there, follows."""
    key, size = temp_name(docs, "row_key"), temp_name(docs, "size")
    kept, _ = write_table(docs.withColumns({key: F.monotonically_increasing_id(), size: word_count(F.col("text"))}), "mix-full")
    rows = kept.select(F.col(key).alias("row_key"), "doc_id", "source", F.col(size).alias("size")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size"))
    mixed = mix_rows(rows, weights, share, cap, block)
    n, slot = temp_name(kept, "taken"), temp_name(kept, "slot")
    takes = mixed.taken.groupBy("row_key", "epoch").agg(F.sum("words").alias(n), F.min(F.struct("slot", "first_word", "row_key")).alias(slot)).select(F.col("row_key").alias(key), n, slot)
    text = F.when(F.col(n) < F.col(size), F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col(n).cast("int")), " ")).otherwise(F.col("text"))
    out = kept.join(takes, key).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n) < F.col(size), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    # slots are dense, so their ranges are known without a look at the rows
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = F.least(F.lit(parts - 1), F.floor(F.col(f"{slot}.slot") * parts / max(1, mixed.slots))).cast("int")
    ordered = out.repartitionById(parts, part).sortWithinPartitions(slot)
    return ordered.select(*[F.col(f"`{c}`") for c in docs.columns])
