"""Risk-reduction treatments of tables.

Each takes and returns a DataFrame. Random ones draw from hashes of (seed, row id, column): results do
not depend on partitions or plans.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keyed import uniform
from ..functions.values import number
from .ranks import dense_position, spare


def _col(c: str) -> Column:
    return F.col(f"`{c}`")


def suppress(df: DataFrame, quasi: Sequence[str], k: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """Null the chosen quasi columns of records in groups below k. Sizes join back: no group meets in one task."""
    quasi = [c for c in quasi if c in df.columns]
    cols = quasi if cols is None else [c for c in cols if c in quasi]
    if not quasi:
        return df
    n, small_, *own = spare(df, "_n", "_small", *[f"_q{i}" for i in range(len(quasi))])
    sizes = df.groupBy(*[_col(c) for c in quasi]).agg(F.count("*").alias(n)).where(F.col(n) < int(k))
    small = sizes.select(*[_col(c).alias(q) for q, c in zip(own, quasi, strict=True)], F.lit(True).alias(small_))
    on = None
    for i, c in enumerate(quasi):
        same = _col(c).eqNullSafe(F.col(own[i]))
        on = same if on is None else on & same
    out = df.join(small, on, "left")
    return out.select(*[(F.when(F.col(small_), F.lit(None)).otherwise(_col(c)).alias(c) if c in cols else _col(c)) for c in df.columns])


def recode(df: DataFrame, col: str, breaks: Sequence[float] | None = None, labels: Sequence[str] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """Bands ``[a,b)``, the last one ``[a,b]``, null outside; or a mapping, values that are not in it kept."""
    if col not in df.columns:
        return df
    if breaks is not None:
        b = sorted(float(x) for x in breaks)
        names = list(labels) if labels else [f"[{lo:g},{hi:g}{']' if k == len(b) - 2 else ')'}" for k, (lo, hi) in enumerate(zip(b, b[1:], strict=False))]
        v, out = number(_col(col)), F.lit(None).cast("string")
        for k in reversed(range(len(names))):
            inside = (v >= b[k]) & ((v <= b[k + 1]) if k == len(names) - 1 else (v < b[k + 1]))
            out = F.when(inside, F.lit(names[k])).otherwise(out)
        return df.withColumn(col, out)
    if mapping:
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return df.withColumn(col, F.coalesce(F.try_element_at(table, _col(col).cast("string")), _col(col).cast("string")))
    return df


def percentiles(df: DataFrame, v: Column, shares: Sequence[float]) -> list[float]:
    """Exact percentiles (between two neighbours in order, linear) of a numeric expression; none of an empty column. From row
    positions: a range shuffle, not one task for all values."""
    placed = dense_position(df.select(v.cast("double").alias("v")).where("v is not null"), ["v"], "at")
    n = placed.count()
    if not n:
        return []
    places = [p * (n - 1) for p in shares]
    rows = {r["at"] - 1: r["v"] for r in placed.where(F.col("at").isin([x for p in places for x in (int(p) + 1, int(p) + 2)])).collect()}  # two for each share
    return [rows[int(p)] + (p - int(p)) * (rows.get(int(p) + 1, rows[int(p)]) - rows[int(p)]) for p in places]


def topbottom(df: DataFrame, col: str, top_pct: float | None = None, bottom_pct: float | None = None, top: float | None = None, bottom: float | None = None) -> DataFrame:
    """Cap at given limits or at exact percentiles."""
    if col not in df.columns:
        return df
    v = number(_col(col))
    want = [p for p in (None if top_pct is None else 1 - top_pct, bottom_pct) if p is not None]
    if want and (top is None or bottom is None):
        found = percentiles(df, v, want)
        if found and top is None and top_pct is not None:
            top = found[0]
        if found and bottom is None and bottom_pct is not None:
            bottom = found[-1]
    if top is not None:
        v = F.least(v, F.when(v.isNotNull(), F.lit(float(top))))
    if bottom is not None:
        v = F.greatest(v, F.when(v.isNotNull(), F.lit(float(bottom))))
    return df.withColumn(col, v)


def _intish(v: Column) -> Column:
    """Aggregate: all values are whole."""
    return F.coalesce(F.max(F.abs(v - F.bround(v))) < 1e-9, F.lit(False))


def microaggregate(df: DataFrame, row_id: str, cols: Sequence[str], aggr: int = 3, method: str = "mean") -> DataFrame:
    """Each value becomes the mean or median of its group of ``aggr`` neighbours in order, ties by row id; a short last group
    joins the one before it. Whole columns stay whole (half to even)."""
    aggr = max(2, int(aggr))
    for c in [c for c in cols if c in df.columns]:
        v = number(_col(c))
        facts = df.agg(F.count(v).alias("n"), _intish(v).alias("whole")).first()
        if facts["n"] < aggr:
            continue
        last = max(0, facts["n"] // aggr - 1)
        valued = df.select(_col(row_id).alias("_id"), v.alias("_v")).where("_v is not null")
        placed = dense_position(valued, ["_v", "_id"], "_k").withColumn("_g", F.least(F.floor((F.col("_k") - 1) / aggr), F.lit(last)))
        agg = F.avg("_v") if method == "mean" else F.percentile("_v", F.lit(0.5))
        means = placed.groupBy("_g").agg(agg.alias("_m"))
        id_, m = spare(df, "_id", "_m")
        new = placed.join(means, "_g").select(F.col("_id").alias(id_), (F.bround("_m") if facts["whole"] else F.col("_m")).alias(m))
        df = df.join(new, _col(row_id) == F.col(id_), "left").select(*[(F.col(m).alias(x) if x == c else _col(x)) for x in df.columns])
    return df


def pram(df: DataFrame, row_id: str, col: str, retain: float = 0.8, seed: int = 1) -> DataFrame:
    """Keep a value with probability ``retain``, else redraw it from the column's own distribution. Up to ``FEW`` categories are
    a constant table of cumulative shares; beyond, a redraw is the value at a drawn place of the sorted column, which is
    the same value."""
    if col not in df.columns:
        return df
    again, draw = uniform(seed, _col(row_id), F.lit(f"{col}:keep")), uniform(seed, _col(row_id), F.lit(f"{col}:draw"))
    if df.where(_col(col).isNotNull()).select(_col(col)).distinct().limit(FEW + 1).count() > FEW:
        valued = df.select(_col(row_id).alias("_id"), _col(col).cast("string").alias("_v")).where("_v is not null")
        k, value = spare(df, "_k", "_v")
        placed = dense_position(valued, ["_v", "_id"], "_k").select(F.col("_k").alias(k), F.col("_v").alias(value))
        n = valued.count()
        new = df.withColumn(k, (F.floor(draw * n) + 1).cast("long")).join(placed, k)
        return new.select(*[(F.when(_col(c).isNotNull() & (again >= retain), F.col(value)).otherwise(_col(c).cast("string")).alias(c) if c == col else _col(c)) for c in df.columns])
    counts = df.where(_col(col).isNotNull()).groupBy(_col(col).cast("string").alias("_value")).agg(F.count("*").alias("_n"))
    # cumulative shares; a row for each category
    w = Window.orderBy("_value")
    shares = counts.withColumns({"_hi": F.sum("_n").over(w) / F.sum("_n").over(Window.partitionBy()), "_lo": (F.sum("_n").over(w) - F.col("_n")) / F.sum("_n").over(Window.partitionBy())})
    lookup = shares.agg(F.sort_array(F.collect_list(F.struct("_hi", "_value"))).alias("_t"))
    table = lookup.first()["_t"]
    if not table:
        return df
    literal = F.array(*[F.struct(F.lit(float(r["_hi"])).alias("hi"), F.lit(r["_value"]).alias("value")) for r in table])
    pick = F.filter(literal, lambda t: t["hi"] > draw)
    drawn = F.coalesce(F.get(pick, 0)["value"], F.lit(table[-1]["_value"]))
    return df.withColumn(col, F.when(_col(col).isNotNull() & (again >= retain), drawn).otherwise(_col(col).cast("string")))


def noise(df: DataFrame, row_id: str, cols: Sequence[str], method: str = "gaussian", pct: float = 0.1, epsilon: float | None = None, lower: float | None = None, upper: float | None = None, seed: int = 1) -> DataFrame:
    """Gaussian noise of ``pct`` standard deviations, or Laplace noise (clamped and scaled by range / epsilon if epsilon is given)."""
    cols = [c for c in cols if c in df.columns]
    for c in cols:
        v = number(_col(c))
        s = df.agg(F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), _intish(v).alias("whole")).first()
        if s["lo"] is None:
            continue
        u = uniform(seed, _col(row_id), F.lit(f"{c}:noise"))
        if method == "gaussian":
            w = uniform(seed, _col(row_id), F.lit(f"{c}:angle"))
            draw = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * w) * F.lit(pct * (s["sd"] or 0.0))
        else:
            if epsilon:
                lo, hi = s["lo"] if lower is None else lower, s["hi"] if upper is None else upper
                v, scale = F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi))), (hi - lo) / epsilon
                v = F.when(number(_col(c)).isNotNull(), v)
            else:
                scale = pct * (s["sd"] or 0.0)
            x = u - 0.5
            draw = -F.lit(float(scale)) * F.signum(x) * F.log(F.greatest(1 - 2 * F.abs(x), F.lit(1e-300)))
        new = v + draw
        df = df.withColumn(c, F.bround(new) if s["whole"] else new)
    return df


def synth_marginal(df: DataFrame, row_id: str, cols: Sequence[str], seed: int = 1) -> DataFrame:
    """Each column is drawn again, alone, from its own non-null values; null cells are filled too."""
    for c in [c for c in cols if c in df.columns]:
        valued = df.select(_col(row_id).alias("_id"), _col(c).alias("_v")).where("_v is not null")
        k, value = spare(df, "_k", "_v")
        placed = dense_position(valued, ["_v", "_id"], "_k").select(F.col("_k").alias(k), F.col("_v").alias(value))
        n = valued.count()
        if not n:
            continue
        pick = (F.floor(uniform(seed, _col(row_id), F.lit(f"{c}:synth")) * n) + 1).cast("long")
        df = df.withColumn(k, pick).join(placed, k).select(*[(F.col(value).alias(x) if x == c else _col(x)) for x in df.columns])
    return df


def synth_joint(df: DataFrame, row_id: str, cols: Sequence[str], seed: int = 1) -> tuple[DataFrame, str]:
    """No joint synthesiser is built in: the marginal one, and a note that says so."""
    return synth_marginal(df, row_id, cols, seed), "joint synthesis is not available; columns were drawn independently"


#: Categories that a redraw's table may have.
FEW = 10_000

STEPS: dict[str, Callable] = {"suppress": suppress, "recode": recode, "topbottom": topbottom, "microaggregate": microaggregate, "pram": pram, "noise": noise, "synth": synth_marginal}
_WITH_ROW = {"microaggregate", "pram", "noise", "synth"}


def apply_steps(df: DataFrame, row_id: str, steps: Sequence[tuple[str, dict]]) -> tuple[DataFrame, list[str]]:
    """Fold (name, arguments) steps over a table; unknown names are logged and skipped."""
    log = []
    for name, args in steps:
        if name not in STEPS:
            log.append(f"(skipped unknown op '{name}')")
            continue
        df = STEPS[name](df, row_id, **args) if name in _WITH_ROW else STEPS[name](df, **args)
        log.append(f"{name}: {', '.join(f'{k}={v}' for k, v in args.items())}")
    return df, log


def count_changes(before: DataFrame, after: DataFrame, row_id: str, cols: Sequence[str]) -> DataFrame:
    """column, n_changed between two tables of the same row ids."""
    a = before.select(_col(row_id).alias("_id"), *[_col(c).cast("string").alias(f"a{k}") for k, c in enumerate(cols)])
    b = after.select(_col(row_id).alias("_id"), *[_col(c).cast("string").alias(f"b{k}") for k, c in enumerate(cols)])
    counts = a.join(b, "_id").agg(*[F.sum(F.when(F.col(f"a{k}").eqNullSafe(F.col(f"b{k}")), 0).otherwise(1)).alias(f"n{k}") for k in range(len(cols))])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(f"n{k}", F.lit(0)).cast("long").alias("n_changed")) for k, c in enumerate(cols)])).alias("x")).select("x.*")
