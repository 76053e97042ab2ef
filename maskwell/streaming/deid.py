"""The row-level policy on streams: the same projection as on tables, with Spark's checkpoints for restarts.

Disclosure measures need whole tables, so they run on each micro-batch only where asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.disclosure import gate
from ..operators.transform import deidentify
from ..plans.policy import Policy


def transform_stream(stream: DataFrame, policy: Policy, key: bytes | str) -> DataFrame:
    return deidentify(stream, policy, key).data()


def write_stream(stream: DataFrame, policy: Policy, key: bytes | str, path: str, checkpoint: str, available_now: bool = True):
    writer = transform_stream(stream, policy, key).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def gated_stream(stream: DataFrame, policy: Policy, key: bytes | str, quasi: Sequence[str], k: int, release: Callable[[DataFrame, int], None], hold: Callable[[DataFrame, int, dict], None], checkpoint: str):
    """Each micro-batch is released if it passes the gate, else held with the reasons."""

    def batch(df: DataFrame, n: int) -> None:
        verdict = gate(df, quasi, k)
        release(df, n) if verdict["pass"] else hold(df, n, verdict)

    return transform_stream(stream, policy, key).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, by: Sequence[str], width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")
