"""Disclosure risk: k-anonymity, l-diversity, uniques, individual risk, distance to closest record, and the gate.

Group keys are SQL's: nulls form one group of their own, other than the text 'NA'. Groups are
counted by partial aggregation, so a group of any size is a row for each task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_SAMPLE = 500


def _existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def group_sizes(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """The quasi columns and n."""
    return df.groupBy(*_existing(df, quasi)).agg(F.count("*").alias("n"))


def kanon(df: DataFrame, quasi: Sequence[str], k: int = 5) -> DataFrame | None:
    """One row: k_achieved, n_groups, n_unique, n_below_k, frac_below_k (records). None without quasi columns."""
    if not _existing(df, quasi):
        return None
    n = F.col("n")
    below = F.sum(F.when(n < k, n).otherwise(0))
    return group_sizes(df, quasi).agg(F.min(n).alias("k_achieved"), F.count("*").alias("n_groups"), F.sum(F.when(n == 1, 1).otherwise(0)).alias("n_unique"), below.alias("n_below_k"), (below / F.sum(n)).alias("frac_below_k"))


def ldiversity(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame | None:
    """One row: l_min, l_mean over the groups; a null counts as a value."""
    quasi = _existing(df, quasi)
    if not quasi:
        return None
    distinct = df.groupBy(*quasi, sensitive).agg(F.lit(1).alias("one")).groupBy(*quasi).agg(F.count("*").alias("l"))
    return distinct.agg(F.min("l").alias("l_min"), F.avg("l").alias("l_mean"))


def sample_uniques(df: DataFrame, quasi: Sequence[str]) -> DataFrame | None:
    """One row: full (share of records alone in their group) and leave_one_out (the largest share without one column; null
    if there is one column only). One grouping-sets pass."""
    quasi = _existing(df, quasi)
    if not quasi:
        return None
    sets = [list(quasi), *([[c for c in quasi if c != x] for x in quasi] if len(quasi) > 1 else [])]
    got = df.groupingSets([[F.col(f"`{c}`") for c in s] for s in sets], *[F.col(f"`{c}`") for c in quasi]).agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    per = got.groupBy("g").agg((F.sum(F.when(F.col("n") == 1, 1).otherwise(0)) / F.sum("n")).alias("share"))
    return per.agg(F.max(F.when(F.col("g") == 0, F.col("share"))).alias("full"), F.max(F.when(F.col("g") > 0, F.col("share"))).alias("leave_one_out"))


def individual_risk(df: DataFrame, quasi: Sequence[str]) -> DataFrame | None:
    """One row: mean, max and sum of 1 / group size over the records."""
    if not _existing(df, quasi):
        return None
    n = F.col("n")
    return group_sizes(df, quasi).agg((F.count("*") / F.sum(n)).alias("mean_risk"), (F.lit(1.0) / F.min(n)).alias("max_risk"), F.count("*").cast("double").alias("sum_risk"))


def dcr(released: DataFrame, reference: DataFrame, columns: Sequence[str], order: Sequence[str], sample: int = MAX_SAMPLE, seed: int = 1) -> DataFrame:
    """One row: min, mean and frac_exact of each released record's smallest share of differing columns from any reference
    record. A sampling measure: the ``sample`` (at most 500) released records with the smallest SHA-256 of ``seed`` and the
    ``order`` columns, against all of ``reference``; the sample is a constant of the plan."""
    columns = [c for c in columns if c in released.columns and c in reference.columns]
    drawn = F.sha2(F.concat_ws(chr(1), F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(chr(2))) for c in order]), 256)
    few = released.orderBy(drawn, *order).limit(min(sample, MAX_SAMPLE)).select(*[F.col(f"`{c}`").cast("string").alias(f"_{k}") for k, c in enumerate(columns)])
    few = few.withColumn("_id", F.monotonically_increasing_id())
    packed = few.agg(F.collect_list(F.struct("_id", *[f"_{k}" for k in range(len(columns))])).alias("few"))
    different = lambda s: sum((F.when(s[f"_{k}"].eqNullSafe(F.col(f"r_{k}")), 0).otherwise(1) for k in range(len(columns))), F.lit(0))
    other = reference.select(*[F.col(f"`{c}`").cast("string").alias(f"r_{k}") for k, c in enumerate(columns)]).distinct()
    rows = packed.collect()[0]["few"]  # at most 500 records
    if not rows or not columns:
        return released.sparkSession.createDataFrame([], "min_distance double, mean_distance double, frac_exact double")
    # one constant: a structure for each record would be compiled 500 times
    literal = F.from_json(F.lit(json.dumps([r.asDict() for r in rows])), f"array<struct<_id:bigint,{','.join(f'_{k}:string' for k in range(len(columns)))}>>")
    away = other.select(F.explode(F.transform(literal, lambda s: F.struct(s["_id"].alias("id"), different(s).alias("d")))).alias("x")).groupBy("x.id").agg((F.min("x.d") / F.lit(len(columns))).alias("d"))
    return away.agg(F.min("d").alias("min_distance"), F.avg("d").alias("mean_distance"), F.avg(F.when(F.col("d") == 0, 1.0).otherwise(0.0)).alias("frac_exact"))


def gate(df: DataFrame, quasi: Sequence[str], k: int = 5, max_risk: float | None = None) -> dict:
    """pass and reasons: the smallest group has k records and, if a limit is given, no record's risk is over it."""
    stats = kanon(df, quasi, k)
    if stats is None:
        return {"pass": True, "reasons": ["no quasi-identifiers"], "k_achieved": None, "max_risk": None}
    least = stats.first()["k_achieved"]
    risk, reasons = (1.0 / least if least else None), []
    if least is not None and least < k:
        reasons.append(f"k-anonymity {least} is below {k}")
    if max_risk is not None and risk is not None and risk > max_risk:
        reasons.append(f"largest individual risk {risk:.4f} is over {max_risk}")
    return {"pass": not reasons, "reasons": reasons, "k_achieved": least, "max_risk": risk}
