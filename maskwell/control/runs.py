"""Checkpointed runs of one table, and batches of files."""

from __future__ import annotations

import csv
import json
import os
import shutil
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import scrub_table
from ..operators.transform import deidentify, merge_crosswalks, open_crosswalk, seal_crosswalk
from ..plans.identifiers import freetext_columns
from ..plans.policy import ColumnRule, Policy
from ..sources import tables
from .project import Project, digest, file_slug, sha256_file


def signature(policy: Policy, key: bytes | str, n_rows: int, chunk: int, source: str) -> dict:
    """What must be equal for finished chunks to count: input, rows, chunk size, policy with its detectors, and key."""
    names = [(d.name, d.pattern, d.confidence) for d in policy.detectors()]
    return {"source": source, "rows": n_rows, "chunk": chunk, "policy": digest(policy.to_json()), "detectors": digest(names), "key": digest(key.hex() if isinstance(key, bytes) else key)}


def run_chunked(df: DataFrame, policy: Policy, key: bytes | str, folder: str, source: str = "", chunk: int = tables.CHUNK, row_id: str = "row_id", progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """De-identify ``df`` in chunks of rows; each finished chunk is a Parquet folder, and a run that starts again skips those of
    the same signature. Returns data in the original columns and row id, lazily, over all chunks."""
    spark, n = df.sparkSession, df.count()
    want, ledger = signature(policy, key, n, chunk, source), os.path.join(folder, "ledger.json")
    done: list[int] = []
    if os.path.exists(ledger):
        with open(ledger, encoding="utf-8") as f:
            kept = json.load(f)
        done = kept["done"] if kept["signature"] == want else []
    if not done and os.path.isdir(folder):
        shutil.rmtree(folder)
    os.makedirs(folder, exist_ok=True)
    plan = tables.plan_chunks(n, chunk)
    for c in plan:
        at = os.path.join(folder, f"chunk={c.number:06d}")
        if c.number not in done or not os.path.exists(os.path.join(at, "data", "_SUCCESS")):
            made = deidentify(tables.read_window(df, c.start, c.n, row_id), policy, key)
            made.data().write.mode("overwrite").parquet(os.path.join(at, "data"))
            made.crosswalk().write.mode("overwrite").parquet(os.path.join(at, "crosswalk"))
            made.summary().write.mode("overwrite").parquet(os.path.join(at, "summary"))
            done = sorted({*done, c.number})
            with open(ledger + ".tmp", "w", encoding="utf-8") as f:
                json.dump({"signature": want, "done": done, "chunks": len(plan)}, f)
            os.replace(ledger + ".tmp", ledger)
        if progress:
            progress(len(done), len(plan))
    return spark.read.parquet(*[os.path.join(folder, f"chunk={c.number:06d}", "data") for c in plan])


def _parts(spark: SparkSession, folder: str, what: str) -> DataFrame:
    with open(os.path.join(folder, "ledger.json"), encoding="utf-8") as f:
        return spark.read.parquet(*[os.path.join(folder, f"chunk={n:06d}", what) for n in json.load(f)["done"]])


def crosswalk(spark: SparkSession, folder: str) -> DataFrame:
    return merge_crosswalks(_parts(spark, folder, "crosswalk"))


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return _parts(spark, folder, "summary").groupBy("column", "identifier", "action").agg(F.sum("n_changed").cast("long").alias("n_changed"))


def status(folder: str) -> dict:
    """done, chunks, complete."""
    try:
        with open(os.path.join(folder, "ledger.json"), encoding="utf-8") as f:
            kept = json.load(f)
    except FileNotFoundError:
        return {"done": 0, "chunks": None, "complete": False}
    return {"done": len(kept["done"]), "chunks": kept["chunks"], "complete": len(kept["done"]) == kept["chunks"]}


def _keep_crosswalk(spark: SparkSession, made: DataFrame, path: str, key: bytes) -> None:
    """The sealed crosswalk of an output, with the pairs of earlier runs: tokens that went out stay readable."""
    if os.path.exists(path):
        made = merge_crosswalks(open_crosswalk(spark.read.parquet(path), key), made)
    seal_crosswalk(made, key).write.mode("overwrite").parquet(path + ".next")
    if os.path.exists(path):
        os.replace(path, path + ".last")
    os.replace(path + ".next", path)
    shutil.rmtree(path + ".last", ignore_errors=True)


def output_path(path: str, folder: str) -> str:
    base, _, end = os.path.basename(path).rpartition(".")
    return os.path.join(folder, f"{file_slug(base)}.deid.{'csv' if tables.file_type(path) == 'table' else end}")


def batch_policy(policy: Policy, columns: list[str], date_shift: dict | None = None, force_detectors: bool = False, min_conf: float | None = None) -> Policy:
    """A copy for a batch: a date shift for columns of dates only, and redaction for free-text columns without a rule."""
    out = Policy.from_json(policy.to_json())
    if min_conf is not None:
        out.freetext["min_conf"] = min_conf
    if date_shift:
        for r in out.columns.values():
            if r.action == "generalize" and r.options.get("method") in ("year", "year_month", None) and r.identifier in ("dob", "date_of_death"):
                r.options.update(date_shift | {"method": "date_shift"})
    if force_detectors:
        for c in freetext_columns(columns):
            if out.columns.get(c, ColumnRule()).action == "keep":
                out.columns[c] = ColumnRule("redact_freetext", "other_id")
    return out


def run_batch(spark: SparkSession, project: Project, inputs, actor: str = "unknown", recursive: bool = False, redo: bool = False, **options) -> list[dict]:
    """De-identify files one after the other. A file that fails is reported and the others go on; one whose output is there is
    skipped. Returns and writes path, type, status, output, rows, seconds, detail."""
    items = []
    for path, kind in tables.plan_files(inputs, recursive):
        began, out = time.time(), output_path(path, project.path("output"))
        item = {"file": path, "type": kind, "status": "skipped", "output": out, "rows": None, "detail": ""}
        try:
            if kind in ("skip", "pdf"):
                item["detail"] = "no reader for this type"
            elif os.path.exists(out) and not redo:
                item["detail"] = "output exists"
            elif kind == "xml":
                with open(project.register_input(path, actor), encoding="utf-8") as f:
                    row = scrub_table(spark.createDataFrame([(path, f.read())], "path string, xml string"), project.key()).first()
                if row["xml"] is None:
                    raise ValueError(row["error"] or "protected content changed")
                with open(out, "w", encoding="utf-8") as f:
                    f.write(row["xml"])
                item |= {"status": "ok", "rows": row["n_changes"]}
            else:
                copy = project.register_input(path, actor)
                df = tables.with_row_id(tables.read_table(spark, copy))
                policy = batch_policy(project.policy, df.columns, **options)
                folder = project.path("chunks", os.path.basename(out))
                data = run_chunked(df, policy, project.key(), folder, sha256_file(copy))
                tables.write_csv(data, out, "row_id")
                _keep_crosswalk(spark, crosswalk(spark, folder), out + ".crosswalk", project.key())
                item |= {"status": "ok", "rows": data.count()}
        except Exception as e:
            item |= {"status": "error", "detail": f"{type(e).__name__}: {str(e)[:300]}"}
        items.append(item | {"seconds": round(time.time() - began, 3)})
        project.log("batch_item", actor, {k: item[k] for k in ("type", "status", "rows")})
    totals = {s: sum(i["status"] == s for i in items) for s in ("ok", "error", "skipped")}
    with open(project.path("output", "batch_summary.json"), "w", encoding="utf-8") as f:
        json.dump({"totals": totals, "items": items}, f, indent=1)
    with open(project.path("output", "batch_summary.csv"), "w", encoding="utf-8", newline="") as f:
        table = csv.DictWriter(f, ["file", "type", "status", "output", "rows", "seconds", "detail"])
        table.writeheader()
        table.writerows(items)
    return items
