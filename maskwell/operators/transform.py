"""Apply a policy to a table: data, change summary, crosswalk, re-identification."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import seal, unseal
from ..plans.policy import Policy, compile_column
from .ranks import spare

REVERSIBLE = ("pseudonymize", "fpe")


@dataclass
class Deidentified:
    """One projection with original and new values; data, summary and crosswalk are read off it."""

    both: DataFrame
    columns: list[str]
    policy: Policy
    made: dict[str, str]

    def _pair(self, column: str) -> tuple[Column, Column]:
        return F.col(f"`{column}`"), F.col(f"`{self.made[column]}`")

    def data(self) -> DataFrame:
        return self.both.select(*[(self._pair(c)[1].alias(c) if c in self.policy.columns else F.col(f"`{c}`")) for c in self.columns])

    def summary(self) -> DataFrame:
        """column, identifier, action, n_changed (value or null-ness) of every column with a rule: one pass."""
        rules = [(c, r) for c, r in self.policy.columns.items() if c in self.columns]
        counts = [F.sum(F.when(~old.cast("string").eqNullSafe(new), 1).otherwise(0)).cast("long").alias(f"n{k}") for k, (c, _) in enumerate(rules) for old, new in [self._pair(c)]]
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r.identifier).alias("identifier"), F.lit(r.action).alias("action"), F.coalesce(F.col(f"n{k}"), F.lit(0)).alias("n_changed")) for k, (c, r) in enumerate(rules)])
        if not rules:
            return self.both.sparkSession.createDataFrame([], "column string, identifier string, action string, n_changed long")
        return self.both.agg(*counts).select(F.explode(each).alias("s")).select("s.*")

    def crosswalk(self) -> DataFrame:
        """column, original, token: the distinct pairs of reversible columns and of shifted dates."""
        kept = [c for c, r in self.policy.columns.items() if c in self.columns and (r.action in REVERSIBLE or r.options.get("method") == "date_shift")]
        if not kept:
            return self.both.sparkSession.createDataFrame([], "column string, original string, token string")
        each = F.array(*[F.struct(F.lit(c).alias("column"), old.cast("string").alias("original"), new.alias("token")) for c in kept for old, new in [self._pair(c)]])
        return self.both.select(F.explode(each).alias("x")).select("x.*").where("original is not null and token is not null").distinct()


def deidentify(df: DataFrame, policy: Policy, key: bytes | str | None = None) -> Deidentified:
    ruled = [c for c in policy.columns if c in df.columns]
    made = dict(zip(ruled, spare(df, *[f"__new_{c}" for c in ruled]), strict=True))
    new = [compile_column(c, policy.columns[c], policy, key).cast("string").alias(made[c]) for c in ruled]
    return Deidentified(df.select("*", *new), df.columns, policy, made)


def side_by_side(before: DataFrame, after: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """row, column, before, after of every cell that differs (null-safe), for review. Rows are matched by their id; a row that only
    one side has shows null on the other."""
    have = [c for c in (columns or before.columns) if c != row_id and c in before.columns and c in after.columns]
    cells = lambda df: df.select(F.col(f"`{row_id}`").alias("row"), F.struct(*[F.col(f"`{c}`").cast("string").alias(f"c{k}") for k, c in enumerate(have)]).alias("v"))
    if not have:
        return before.select(F.col(f"`{row_id}`").alias("row"), *[F.lit(None).cast("string").alias(x) for x in ("column", "before", "after")]).limit(0)
    both = cells(before).alias("a").join(cells(after).alias("b"), "row", "full")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a.v.c{k}").alias("before"), F.col(f"b.v.c{k}").alias("after")) for k, c in enumerate(have)])
    return both.select("row", F.explode(F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))).alias("x")).select("row", "x.*")


def merge_crosswalks(*parts: DataFrame) -> DataFrame:
    """Union without repeats, by the whole triple: a shifted date may have several tokens."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["column", "original", "token"])


def seal_crosswalk(crosswalk: DataFrame, key: bytes | str) -> DataFrame:
    """blob: each row sealed."""
    return crosswalk.select(seal(F.to_json(F.struct("column", "original", "token")), key).alias("blob"))


def open_crosswalk(sealed: DataFrame, key: bytes | str) -> DataFrame:
    return sealed.select(F.from_json(unseal(F.col("blob"), key), "column string, original string, token string").alias("x")).select("x.*")


def reidentify(df: DataFrame, crosswalk: DataFrame, column: str) -> DataFrame:
    """``df`` with ``<column>_original``; of several originals the smallest. Spark broadcasts the crosswalk if it is small."""
    one = crosswalk.where(F.col("column") == column).groupBy("token").agg(F.min("original").alias(f"{column}_original"))
    return df.join(one.withColumnRenamed("token", column), column, "left")


def policy_summary(policy: Policy) -> list[dict]:
    return [{"column": c, **json.loads(json.dumps(r.__dict__))} for c, r in policy.columns.items()]
