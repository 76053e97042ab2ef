"""Column profiles: shapes, types, misplaced values, and a suggested mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import value_shape
from ..plans.detectors import registry
from ..plans.identifiers import TYPE_IDENTIFIER, name_hint
from .spans import classify, top_class

HIGH_RISK = ("nric", "email", "phone", "creditcard", "ip")
LEAST_VALUES, MAJORITY, UNIFORM, RARE = 3, 0.5, 0.7, 0.1


def cells(df: DataFrame, row_id: str, columns: list[str] | None = None) -> DataFrame:
    """row, column, value, shape, type of every non-blank cell: the table is read once."""
    columns = [c for c in (columns or df.columns) if c != row_id]
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]) if columns else F.array().cast("array<struct<column:string,value:string>>")
    flat = df.select(F.col(row_id).alias("row"), F.explode(each).alias("c")).select("row", "c.*").where("value is not null and trim(value) <> ''")
    return flat.withColumns({"shape": value_shape(F.col("value")), "type": top_class(classify(F.col("value"), registry()))})


def frequencies(of: DataFrame, what: str) -> DataFrame:
    """column, <what>, n, total, rank (most frequent first, then by name)."""
    counts = of.where(F.col(what).isNotNull()).groupBy("column", what).agg(F.count("*").alias("n"))
    totals = of.groupBy("column").agg(F.count("*").alias("total"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), what))
    return counts.join(totals, "column").withColumn("rank", rank)


def profile(of: DataFrame) -> DataFrame:
    """column, total, dominant_shape, shape_share, dominant_type, type_share of each column with enough values."""
    shape = frequencies(of, "shape").where("rank = 1").select("column", "total", F.col("shape").alias("dominant_shape"), (F.col("n") / F.col("total")).alias("shape_share"))
    kind = frequencies(of, "type").where(f"rank = 1 and n / total >= {MAJORITY}").select("column", F.col("type").alias("dominant_type"), (F.col("n") / F.col("total")).alias("type_share"))
    return shape.join(kind, "column", "left").where(f"total >= {LEAST_VALUES}")


def outliers(of: DataFrame) -> DataFrame:
    """row, column, value, reason, severity, identifier. High: a high-risk value in a column that is not mostly of its
    kind. Medium: a rare shape in a uniform column."""
    by_name = F.create_map(*[F.lit(x) for d in registry() for x in (d.name, d.identifier)])
    shapes = frequencies(of, "shape").select("column", "shape", F.col("n").alias("shape_n"))
    row = of.join(profile(of), "column").join(shapes, ["column", "shape"])
    high = F.col("type").isin(*HIGH_RISK) & ~F.col("dominant_type").eqNullSafe(F.col("type"))
    medium = (F.col("shape_share") >= UNIFORM) & (F.col("shape") != F.col("dominant_shape")) & (F.col("shape_n") / F.col("total") <= RARE)
    reason = F.when(high, F.format_string("Looks like %s but column is mostly %s", "type", F.coalesce("dominant_type", F.lit("non-PII/other")))).when(medium, F.format_string("Shape '%s' is unusual for this column (mostly '%s')", "shape", "dominant_shape"))
    found = row.withColumns({"reason": reason, "severity": F.when(high, "high").when(medium, "medium"), "identifier": F.when(F.col("type").isNotNull(), F.try_element_at(by_name, F.col("type")))})
    return found.where("reason is not null").select("row", "column", "value", "reason", "severity", "identifier")


def suggest_mapping(df: DataFrame, row_id: str) -> dict[str, str | None]:
    """Identifier of each column: by name, else by the dominant type of its values. Only columns without a hint are read."""
    out = {c: name_hint(c) for c in df.columns if c != row_id}
    open_ = [c for c, i in out.items() if i is None]
    if open_:
        for r in profile(cells(df, row_id, open_)).select("column", "dominant_type").collect():  # a row for each column
            out[r["column"]] = TYPE_IDENTIFIER.get(r["dominant_type"])
    return out
