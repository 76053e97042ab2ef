"""Spans: scan, classify, merge, dedupe and redact, as expressions over arrays of structs.

A span is struct<start, end, match, type, identifier, detector, confidence>, positions from 1,
both ends included, in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import mask_postal
from ..plans.detectors import Detector

SPAN = "struct<start:int,end:int,match:string,type:string,identifier:string,detector:string,confidence:double>"
NONE = f"array<{SPAN}>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it: higher-order functions share nothing else."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _confidence(d: Detector, match: Column, floor: float | None) -> Column:
    if d.validate is None:
        return F.lit(d.confidence)
    low = round(d.confidence - 0.4, 10) if floor is None else max(floor, round(d.confidence - 0.4, 10))
    return F.when(F.coalesce(d.validate(match), F.lit(False)), F.lit(0.99)).otherwise(F.lit(low))


def _matches(text: Column, d: Detector) -> Column:
    """All matches of one detector: each match's place is what lies before it in the split text."""
    pattern = F.lit(d.java)
    hits, rest = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, d.java, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["rest"])
        end = begin + F.length(x["hit"])
        span = F.struct((begin + 1).alias("start"), end.alias("end"), x["hit"].alias("match"), F.lit(d.type).alias("type"), F.lit(d.identifier).alias("identifier"), F.lit(f"rule:{d.name}").alias("detector"), _confidence(d, x["hit"], 0.1).alias("confidence"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.transform(hits, lambda hit, k: F.struct(F.get(rest, k).alias("rest"), hit.alias("hit")))
    found = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    gate = text.rlike(d.gate) if d.gate else F.lit(True)
    return F.when(text.isNotNull() & gate, found).otherwise(F.array().cast(NONE))


def scan(text: Column, detectors: Iterable[Detector]) -> Column:
    """array of all spans of all detectors, in registry order; empty for null."""
    parts = [_matches(text, d) for d in detectors]
    return F.concat(*parts) if parts else F.array().cast(NONE)


def classify(value: Column, detectors: Iterable[Detector]) -> Column:
    """array<struct<detector, identifier, confidence>> of the detectors that match the whole trimmed value."""
    v, parts = F.trim(value), []
    for d in detectors:
        inner = d.java.removeprefix("(?i)")
        one = F.struct(F.lit(d.name).alias("detector"), F.lit(d.identifier).alias("identifier"), _confidence(d, v, None).alias("confidence"))
        parts.append(F.when(v.rlike(f"(?i)^(?:{inner})$"), F.array(one)).otherwise(F.array().cast("array<struct<detector:string,identifier:string,confidence:double>>")))
    return F.concat(*parts)


def top_class(classes: Column) -> Column:
    """Name of the most confident class, the first in registry order; null if there is none."""
    best = F.array_max(F.transform(classes, lambda c, k: F.struct(c["confidence"], (-k).alias("k"), c["detector"])))
    return best["detector"]


def merge(spans: Column) -> Column:
    """Union of overlapping or touching spans; each carries its widest, then most confident member, and ``exact``: the
    union is that member. Spans with null or inverted ends go."""
    good = F.filter(spans, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] <= s["end"]))
    order = F.array_sort(F.transform(good, lambda s, k: F.struct(s["start"].alias("a"), s["end"].alias("z"), k.alias("k"), s.alias("s"))))
    kind = f"array<struct<start:int,end:int,width:int,confidence:double,k:int,s:{SPAN}>>"

    def better(x: Column, last: Column) -> Column:
        width = x["z"] - x["a"]
        return (width > last["width"]) | ((width == last["width"]) & (F.coalesce(x["s"]["confidence"], F.lit(0.0)) > last["confidence"])) | ((width == last["width"]) & (F.coalesce(x["s"]["confidence"], F.lit(0.0)) == last["confidence"]) & (x["k"] < last["k"]))

    def alone(x: Column) -> Column:
        return F.struct(x["a"].alias("start"), x["z"].alias("end"), (x["z"] - x["a"]).alias("width"), F.coalesce(x["s"]["confidence"], F.lit(0.0)).alias("confidence"), x["k"].alias("k"), x["s"].alias("s"))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        won = better(x, last)
        joined = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], x["z"]).alias("end"),
            F.when(won, x["z"] - x["a"]).otherwise(last["width"]).alias("width"),
            F.when(won, F.coalesce(x["s"]["confidence"], F.lit(0.0))).otherwise(last["confidence"]).alias("confidence"),
            F.when(won, x["k"]).otherwise(last["k"]).alias("k"),
            F.when(won, x["s"]).otherwise(last["s"]).alias("s"),
        )
        return F.when((F.size(acc) > 0) & (x["a"] <= last["end"] + 1), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(alone(x))))

    def fold(order: Column) -> Column:
        # element_at of an empty array is an error, so the first element starts the fold
        first = F.transform(F.slice(order, 1, 1), lambda x: alone(x)).cast(kind)
        return F.when(F.size(order) > 0, F.aggregate(F.slice(order, 2, F.greatest(F.size(order) - 1, F.lit(0))), first, step)).otherwise(F.array().cast(kind))

    return F.transform(bound(order, fold), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["s"]["match"].alias("match"), m["s"]["type"].alias("type"), m["s"]["identifier"].alias("identifier"), m["s"]["detector"].alias("detector"), m["s"]["confidence"].alias("confidence"), ((m["end"] - m["start"]) == m["width"]).alias("exact")))


def dedup(spans: Column) -> Column:
    """Greedy: widest, then most confident; a span that overlaps a kept one goes. For display, by start."""
    order = F.array_sort(F.transform(spans, lambda s, k: F.struct((s["start"] - s["end"]).alias("narrow"), (-s["confidence"]).alias("unsure"), k.alias("k"), s.alias("s"))))
    kept = F.aggregate(order, F.array().cast(NONE), lambda acc, x: F.when(F.exists(acc, lambda s: (s["start"] <= x["s"]["end"]) & (s["end"] >= x["s"]["start"])), acc).otherwise(F.concat(acc, F.array(x["s"]))))
    return F.array_sort(kept)


def replace_spans(text: Column, merged: Column, default: str | None = None) -> Column:
    """Text with each merged span replaced: ``[TYPE]`` (or ``default``), or the masked code where a postal span is exact.
    White space at a span's end stays; spans past the text's end go."""
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        cut = F.substr(text, s["start"], s["end"] - s["start"] + 1)
        tail = F.regexp_extract(cut, r"(\s*)$", 1)
        tag = F.lit(default) if default else F.concat(F.lit("["), F.upper(s["type"]), F.lit("]"))
        new = F.when((s["type"] == "postal") & s["exact"], mask_postal(cut)).otherwise(F.concat(tag, tail))
        return F.when((s["start"] < acc["at"]) | (s["start"] > F.length(text)), acc).otherwise(F.struct((s["end"] + 1).alias("at"), F.concat(acc["out"], F.substr(text, acc["at"], s["start"] - acc["at"]), new).alias("out")))

    def rest(done: Column) -> Column:
        return F.concat(done["out"], F.substr(text, done["at"], F.greatest(F.length(text) - done["at"] + 1, F.lit(0))))

    return bound(merged, lambda m: F.when(F.size(m) > 0, bound(F.aggregate(F.array_sort(m), zero, step), rest)).otherwise(text))


def keep_confident(spans: Column, min_conf: float = 0.5, overrides: dict[str, float] | None = None, types: Iterable[str] | None = None, rejects: Column | None = None, review: bool = False) -> Column:
    """Spans at or over their identifier's floor, of the allowed types, and not rejected (``type<TAB>lower-cased match``).
    review: spans have a mark ``needs_review``, and those that carry it stay whatever their confidence is, so that an unsure source
    hides too much rather than too little."""
    floor = lambda s: F.lit(float(min_conf))
    if overrides:
        table = F.create_map(*[F.lit(x) for k, v in overrides.items() for x in (k, float(v))])
        floor = lambda s: F.coalesce(F.try_element_at(table, s["identifier"]), F.lit(float(min_conf)))
    out = F.filter(spans, lambda s: (F.coalesce(s["confidence"], F.lit(0.0)) >= floor(s)) | (F.coalesce(s["needs_review"], F.lit(False)) if review else F.lit(False)))
    if types is not None:
        allowed = F.array(*[F.lit(t) for t in types]).cast("array<string>")
        out = F.filter(out, lambda s: F.array_contains(allowed, s["type"]))
    if rejects is not None:
        out = F.filter(out, lambda s: ~F.array_contains(rejects, F.concat(s["type"], F.lit("\t"), F.lower(s["match"]))))
    return out


def redact_freetext(text: Column, detectors: Iterable[Detector], min_conf: float = 0.5, overrides: dict[str, float] | None = None, types: Iterable[str] | None = None, rejects: Iterable[str] | None = None) -> Column:
    """Scan, keep the confident, merge, replace. Detectors that no kept span can come from are not run."""
    return replace_spans(text, merge(_own(text, detectors, min_conf, overrides, types, rejects)))


def _own(text: Column, detectors: Iterable[Detector], min_conf: float, overrides: dict[str, float] | None, types: Iterable[str] | None, rejects: Iterable[str] | None) -> Column:
    """The rules' spans that are kept."""
    live = []
    types = None if types is None else set(types)
    for d in detectors:
        reach = 0.99 if d.validate else d.confidence
        if reach >= (overrides or {}).get(d.identifier, min_conf) and (types is None or d.type in types):
            live.append(d)
    refused = None if rejects is None else F.array(*[F.lit(r) for r in rejects]).cast("array<string>")
    return keep_confident(scan(text, live), min_conf, overrides, types, refused)


def redact_with_spans(df: DataFrame, row_id: str, column: str, found: DataFrame, detectors: Iterable[Detector] = (), min_conf: float = 0.5, overrides: dict[str, float] | None = None, types: Iterable[str] | None = None, rejects: Iterable[str] | None = None) -> DataFrame:
    """``df`` with ``column`` redacted by the rules' spans and by spans of other sources together. found: findings (row,
    column, start, end, match, type, identifier, detector, confidence, needs_review); theirs are kept by the same floors, or
    by their mark for review. A text's spans are one array; texts without any are joined too."""
    taken, names = {c.lower() for c in df.columns}, []
    for base in ("__spans_row", "__spans"):
        while base.lower() in taken:
            base += "_"
        names.append(base)
    row, given = names
    one = F.struct("start", "end", "match", "type", "identifier", "detector", F.col("confidence").cast("double").alias("confidence"), "needs_review")
    per_row = found.where(F.col("column") == column).groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(one)).alias(given))
    refused = None if rejects is None else F.array(*[F.lit(r) for r in rejects]).cast("array<string>")
    kept = keep_confident(F.col(given), min_conf, overrides, None if types is None else set(types), refused, review=True)
    plain = F.transform(kept, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "match", "type", "identifier", "detector", "confidence")])).cast(NONE)
    text = F.col(f"`{column}`").cast("string")
    every = F.concat(_own(text, detectors, min_conf, overrides, types, rejects), F.coalesce(plain, F.array().cast(NONE)))
    out = df.join(per_row, F.col(f"`{row_id}`") == F.col(row), "left")
    return out.select(*[(replace_spans(text, merge(every)).alias(c) if c == column else F.col(f"`{c}`")) for c in df.columns])


def findings(df: DataFrame, row_id: str, columns: Iterable[str], detectors: Iterable[Detector]) -> DataFrame:
    """row, column and span fields of every span in the given columns: one pass over the table."""
    detectors = list(detectors)
    each = F.array(*[F.struct(F.lit(c).alias("column"), scan(F.col(c).cast("string"), detectors).alias("spans")) for c in columns])
    flat = df.select(F.col(row_id).alias("row"), F.explode(each).alias("c")).select("row", "c.column", F.explode("c.spans").alias("s"))
    return flat.select("row", "column", "s.*")


def dedup_findings(found: DataFrame) -> DataFrame:
    """One finding for each row, column, lower-cased match and type: the most confident; needs_review if any has it."""
    if "needs_review" not in found.columns:
        found = found.withColumn("needs_review", F.lit(False))
    key = Window.partitionBy("row", "column", F.lower("match"), "type")
    first = key.orderBy(F.desc("confidence"), "start", "detector")
    return found.withColumns({"needs_review": F.bool_or(F.coalesce("needs_review", F.lit(False))).over(key), "_k": F.row_number().over(first)}).where("_k = 1").drop("_k")


def merge_rows(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``merge`` for spans as rows (start, end, confidence, ...): clusters by a running maximum."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    good = spans.where("start is not null and end is not null and start <= end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cluster = good.withColumn("_new", F.when(F.col("start") <= reach + 1, 0).otherwise(1)).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("start", "end", "type", "confidence"), F.struct((F.col("end") - F.col("start")).alias("w"), "confidence", (-F.col("start")).alias("s")))
    out = cluster.groupBy(*keys, "_c").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("b"), F.count("*").alias("n_spans"))
    return out.select(*keys, "start", "end", F.col("b.type").alias("type"), F.col("b.confidence").alias("confidence"), "n_spans", ((F.col("b.start") == F.col("start")) & (F.col("b.end") == F.col("end"))).alias("exact"))
