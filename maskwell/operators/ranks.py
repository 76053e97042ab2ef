"""Positions in a total order without one task for all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staging import staged

#: ``monotonically_increasing_id`` has the partition above this bit and the place in it below.
_BITS = 33


def spare(df: DataFrame, *bases: str) -> list[str]:
    """Column names like ``bases`` that ``df`` does not have (compared without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in bases:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with places 1..n in the order of its partitions and of the rows in them. Written once: the places within
    partitions and the partitions' sizes must come from one evaluation."""
    pos, part_of, rows, before_ = spare(df, "__pos", "__part", "__n", "__before")
    marked = staged(df.withColumn(pos, F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright(pos, _BITS), F.col(pos).bitwiseAND((1 << _BITS) - 1) + 1
    sizes = marked.groupBy(part.alias(part_of)).agg(F.max(place).alias(rows))
    # a row for each partition: the running sum over them, and its broadcast, stay small
    before = sizes.withColumn(before_, F.sum(rows).over(Window.orderBy(part_of).rowsBetween(Window.unboundedPreceding, 0)) - F.col(rows)).drop(rows)
    out = marked.join(F.broadcast(before), part == F.col(part_of))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (place + F.col(before_)).cast("long").alias(name))


def dense_position(df: DataFrame, order: Sequence[str], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with its rows' places 1..n by the ``order`` columns, which should be unique together: one range shuffle."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return numbered(df.repartitionByRange(n, *order).sortWithinPartitions(*order), name)
