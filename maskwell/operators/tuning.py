"""Feedback-driven tuning of detectors: misses, diagnosis, gold recall, suggestions with a safety preview, apply and revert."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Sequence
from itertools import groupby

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import seal, unseal
from ..plans import detectors as registry
from ..plans.identifiers import freetext_columns
from ..plans.policy import ColumnRule, Policy
from . import spans

FEEDBACK = "ts string, actor string, source string, file string, column string, row long, start int, end int, value string, identifier string, why_missed string, run_id string, tuning_id string"
DEFAULTS = {"global_register": False, "learned_regex": False, "min_support": 2, "max_fp": 0}
LEVERS = {"below_threshold": "threshold", "wrong_column": "column_enable", "detector_off": "column_enable", "known_value": "watchlist", "no_pattern": "watchlist"}


def config(policy: Policy) -> dict:
    return DEFAULTS | policy.autotune


def seal_store(df: DataFrame, key: bytes | str, label: str) -> DataFrame:
    """A store at rest: one sealed blob for each record."""
    return df.select(seal(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), key, label).alias("blob"))


def open_store(sealed: DataFrame, key: bytes | str, label: str, schema: str = FEEDBACK) -> DataFrame:
    return sealed.select(F.from_json(unseal(F.col("blob"), key, label), schema).alias("r")).select("r.*")


def record_misses(misses: DataFrame, store: str, key: bytes | str, actor: str = "unknown", source: str = "reviewer", run_id: str | None = None, log: Callable[[str, str, dict], object] | None = None) -> int:
    """Append missed values (value, identifier and any other columns of ``FEEDBACK``) to a sealed store, a Parquet folder that executors
    see. Returns their number. ``log``(action, actor, detail) is told of it, once for a call, without the values."""
    fixed = {"ts": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "actor": F.lit(actor), "source": F.lit(source), "run_id": F.lit(run_id)}
    kinds = dict(x.split() for x in FEEDBACK.split(", "))
    rows = misses.select(*[(fixed[c] if c in fixed else F.col(f"`{c}`") if c in misses.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
    watch = Observation()
    seal_store(rows, key, "feedback").observe(watch, F.count("*").alias("n")).write.mode("append").parquet(store)
    n = watch.get["n"]
    if log:
        log("feedback_misses_recorded", actor, {"items": n, "source": source})
    return n


def read_misses(spark: SparkSession, store: str, key: bytes | str) -> DataFrame:
    """The records of a store; none where nothing was recorded."""
    where = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], FEEDBACK)
    return open_store(spark.read.schema("blob string").parquet(store), key, "feedback")


def ingest_gold(gold: DataFrame, caught: DataFrame, store: str, key: bytes | str, actor: str = "unknown", log: Callable[[str, str, dict], object] | None = None) -> DataFrame:
    """Recall of ``gold`` (file, column, value, identifier) against ``caught_values``; what is not covered is recorded as missed."""
    covered = gold_coverage(gold, caught)
    missed = record_misses(covered.where("not covered"), store, key, actor, "gold")
    if log:
        log("feedback_gold_ingested", actor, {"missed": missed})
    return gold_recall(covered)


def diagnose(misses: DataFrame, policy: Policy | None = None, min_conf: float = 0.5) -> DataFrame:
    """``misses`` (value, identifier, ...) with why_missed: wrong_column, below_threshold, known_value, detector_off or
    no_pattern. Counts of equal values join back."""
    policy = policy or Policy()
    table = F.create_map(*[F.lit(x) for kv in policy.conf_overrides.items() for x in (kv[0], float(kv[1]))]) if policy.conf_overrides else None
    floor = F.lit(min_conf) if table is None else F.coalesce(F.try_element_at(table, F.col("identifier")), F.lit(min_conf))
    low = F.lower("value")
    counts = misses.groupBy(low.alias("_low")).agg(F.count("*").alias("_n"))
    row = misses.drop("why_missed").withColumn("_low", low).join(counts, "_low").withColumn("_c", spans.classify(F.col("value"), registry.registry()))
    own = F.array_max(F.transform(F.filter("_c", lambda c: c["identifier"] == F.col("identifier")), lambda c: c["confidence"]))
    why = (
        F.when(own >= floor, "wrong_column")
        .when(own < floor, "below_threshold")
        .when(F.col("_n") >= config(policy)["min_support"], "known_value")
        .when(F.size("_c") > 0, "detector_off")
        .otherwise("no_pattern")
    )
    best = F.array_max(F.transform("_c", lambda c: c["confidence"]))
    return row.withColumns({"why_missed": why, "best_confidence": best}).drop("_low", "_n", "_c")


def caught_values(df: DataFrame, columns: Sequence[str], detectors: Iterable[registry.Detector]) -> DataFrame:
    """Distinct lower-cased matches of any detector in any of the columns, at any confidence."""
    detectors = list(detectors)
    every = F.flatten(F.array(*[F.transform(spans.scan(F.col(f"`{c}`").cast("string"), detectors), lambda s: F.lower(s["match"])) for c in columns]))
    return df.select(F.explode(every).alias("low")).distinct()


def gold_coverage(gold: DataFrame, caught: DataFrame) -> DataFrame:
    """``gold`` (value, identifier, ...) with covered: its value is caught anywhere."""
    hit = gold.withColumn("_low", F.lower("value")).join(caught.withColumn("_hit", F.lit(True)), F.col("_low") == F.col("low"), "left")
    return hit.withColumn("covered", F.coalesce("_hit", F.lit(False))).drop("_low", "low", "_hit")


def gold_recall(covered: DataFrame) -> DataFrame:
    """identifier, n, hit, recall."""
    hit = F.sum(F.col("covered").cast("int"))
    return covered.groupBy("identifier").agg(F.count("*").alias("n"), hit.cast("long").alias("hit"), (hit / F.count("*")).alias("recall"))


def gold_recall_strict(gold: DataFrame, found: DataFrame, min_conf: float = 0.5) -> DataFrame:
    """Recall by findings of the same column and identifier with enough confidence."""
    good = found.where(F.col("confidence") >= min_conf).select("column", "identifier", F.lower("match").alias("_low"), F.lit(True).alias("covered")).distinct()
    return gold_recall(gold.withColumn("_low", F.lower("value")).join(good, ["column", "identifier", "_low"], "left").withColumn("covered", F.coalesce("covered", F.lit(False))))


def _runs(value: str) -> list[tuple[str, int]]:
    kind = lambda c: "D" if c in "0123456789" else "L" if c.isascii() and c.isalpha() else "S"
    return [(k, len(list(g))) for k, g in groupby(value, kind)]


def generalize(values: Sequence[str], corpus: Sequence[str] | None = None, max_fp: int = 0) -> dict | None:
    """A pattern of character classes for values of one shape; None if shapes differ, or it hits over half of the corpus or
    more than ``max_fp`` other entries of it."""
    values = list(dict.fromkeys(v for v in values if v))
    shapes = {tuple(_runs(v)) for v in values}
    if len(shapes) != 1:
        return None
    classes = {"D": "[0-9]", "L": "[A-Za-z]", "S": "[^A-Za-z0-9]"}
    pattern = r"\b" + "".join(classes[k] + (f"{{{n}}}" if n > 1 else "") for k, n in shapes.pop()) + r"\b"
    others = [c for c in corpus or () if c]
    hit = [c for c in others if re.search(pattern, c, re.A)]
    wrong = len(set(hit) - set(values))
    if others and (len(hit) / len(others) > 0.5 or wrong > max_fp):
        return None
    return {"pattern": pattern, "coverage": 1, "false_positives": wrong}


def safety(df: DataFrame, columns: Sequence[str], delta: dict) -> DataFrame:
    """One row: new_detections, false_positives (new spans that overlap a span of the shipped detectors) of a change."""
    base = registry.registry()
    if delta["lever"] == "watchlist":
        extra = registry.watchlist((p["identifier"], p["value"]) for p in delta["pairs"])
    elif delta["lever"] == "learned_regex":
        extra = registry.learned([(delta["identifier"], delta["pattern"])])
    else:
        extra = []
    cell = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns])).alias("t")
    row = df.select(cell).where("t is not null and t <> ''").select(spans.scan(F.col("t"), base).alias("b"), spans.scan(F.col("t"), extra).alias("x"))
    if delta["lever"] == "threshold":
        gained = F.filter("b", lambda s: (s["identifier"] == delta["identifier"]) & (s["confidence"] >= delta["floor"]) & (s["confidence"] < 0.5))
    else:
        gained = F.filter("x", lambda s: ~F.exists("b", lambda o: (o["start"] == s["start"]) & (o["end"] == s["end"]) & (o["match"] == s["match"])))
    wrong = F.filter(gained, lambda s: F.exists("b", lambda o: (o["start"] <= s["end"]) & (o["end"] >= s["start"])))
    return row.agg(F.coalesce(F.sum(F.size(gained)), F.lit(0)).cast("long").alias("new_detections"), F.coalesce(F.sum(F.size(wrong)), F.lit(0)).cast("long").alias("false_positives"))


def suggest(misses: DataFrame, policy: Policy | None = None, data: DataFrame | None = None, columns: Sequence[str] | None = None) -> list[dict]:
    """Ranked suggestions from diagnosed misses: id, identifier, lever, cause, support, evidence, delta, new_detections,
    false_positives. Groups come to the driver: identifiers times causes, with their distinct values."""
    policy = policy or Policy()
    cfg, out = config(policy), []
    groups = diagnose(misses, policy).groupBy("identifier", "why_missed").agg(F.count("*").alias("support"), F.sort_array(F.collect_set("value")).alias("values"), F.min("column").alias("column"), F.min(F.coalesce("best_confidence", F.lit(0.3))).alias("least"))
    for g in groups.orderBy("identifier", "why_missed").collect():
        cause = g["why_missed"]
        if g["support"] < cfg["min_support"] and cause != "below_threshold":
            continue
        delta = {"lever": "watchlist", "pairs": [{"identifier": g["identifier"], "value": v} for v in g["values"]]}
        if LEVERS[cause] == "threshold":
            delta = {"lever": "threshold", "identifier": g["identifier"], "floor": round(max(0.1, g["least"] - 0.05), 3)}
        elif LEVERS[cause] == "column_enable":
            delta = {"lever": "column_enable", "column": g["column"], "detectors": [g["identifier"]]}
        elif cause == "no_pattern" and cfg["learned_regex"] and (found := generalize(g["values"], None, cfg["max_fp"])):
            delta = {"lever": "learned_regex", "identifier": g["identifier"], "pattern": found["pattern"]}
        checked = {"new_detections": 0, "false_positives": 0}
        if data is not None:
            checked = safety(data, columns or data.columns, delta).first().asDict()
        out.append({"id": f"sg_{len(out) + 1}", "identifier": g["identifier"], "lever": delta["lever"], "cause": cause, "support": g["support"], "evidence": ", ".join(g["values"][:3]), "delta": json.dumps(delta, sort_keys=True), **checked})
    return sorted(out, key=lambda s: (-s["support"], s["false_positives"]))


def apply(policy: Policy, suggestion: dict) -> Policy:
    """A new version of the policy with a suggestion in it; the version before is kept inside for ``revert``."""
    new, delta = Policy.from_json(policy.to_json()), json.loads(suggestion["delta"])
    before = json.loads(policy.to_json()) | {"applied_tunings": []}
    if delta["lever"] == "threshold":
        new.conf_overrides[delta["identifier"]] = delta["floor"]
    elif delta["lever"] == "watchlist":
        new.watchlist = list(dict.fromkeys([*new.watchlist, *((p["identifier"], p["value"]) for p in delta["pairs"])]))
    elif delta["lever"] == "learned_regex":
        new.learned_patterns.append((delta["identifier"], delta["pattern"]))
    else:
        new.columns[delta["column"]] = ColumnRule("redact_freetext", delta["detectors"][0])
    new.version += 1
    new.applied_tunings.append({"id": suggestion["id"], "lever": delta["lever"], "version": new.version, "before": before})
    return new


def revert(policy: Policy) -> Policy:
    """The policy before the last tuning, under a new version number."""
    if not policy.applied_tunings:
        raise ValueError("no tuning to revert")
    rest = policy.applied_tunings[:-1]
    old = Policy.from_json(json.dumps(policy.applied_tunings[-1]["before"]))
    old.applied_tunings, old.version = rest, policy.version + 1
    return old


def promote(policy: Policy, suggestions: Iterable[dict]) -> list[dict]:
    """Aggregate lessons for a shared register: identifier, lever, cause, support, and floor or pattern. Refused if any value of
    the watchlist is in what would be shared (values are compared before they are serialised)."""
    shared = []
    for s in suggestions:
        delta = json.loads(s["delta"])
        if delta["lever"] == "watchlist":
            continue
        shared.append({"identifier": s["identifier"], "lever": delta["lever"], "cause": s["cause"], "support": s["support"], "floor": delta.get("floor"), "pattern": delta.get("pattern")})
    said = [str(v) for x in shared for v in x.values() if v is not None]
    for _, value in policy.watchlist:
        if any(value and value in t for t in said):
            raise ValueError("a watchlist value would be shared")
    return shared


def write_register(path: str, lessons: Iterable[dict], policy: Policy) -> int:
    """Add promoted lessons to a shared register file (JSON); nothing unless the policy's ``global_register`` is on. A lesson that is there
    already is not repeated. Returns the number of lessons in the file."""
    kept = read_register(path)
    if config(policy)["global_register"]:
        for x in lessons:
            if x not in kept:
                kept.append(x)
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            json.dump(kept, f, indent=1)
        os.replace(path + ".tmp", path)
    return len(kept)


def read_register(path: str) -> list[dict]:
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def from_register(register: Iterable[dict], identifiers: Iterable[str]) -> list[dict]:
    wanted = set(identifiers)
    return [r for r in register if r["identifier"] in wanted]


def enable_columns(policy: Policy, columns: Sequence[str]) -> Policy:
    for c in freetext_columns(list(columns)):
        policy.columns.setdefault(c, ColumnRule("redact_freetext", "other_id"))
    return policy
