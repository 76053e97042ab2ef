"""Hash-chained audit log: JSON lines, each with the hash of the one before."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "GENESIS"


def canonical(entry: dict) -> str:
    return json.dumps({k: v for k, v in entry.items() if k != "hash"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def entry_hash(entry: dict) -> str:
    return hashlib.sha256(canonical(entry).encode()).hexdigest()


def read(path: str) -> list[dict]:
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [json.loads(line) for line in f if line.strip()]


def tip(path: str) -> str:
    entries = read(path)
    return entries[-1]["hash"] if entries else GENESIS


def append(path: str, action: str, actor: str = "unknown", detail: dict | None = None) -> dict:
    with open(path, "a+", encoding="utf-8") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.seek(0)
        lines = [line for line in f if line.strip()]
        entry = {"ts": datetime.now(UTC).isoformat(timespec="seconds"), "action": action, "actor": actor, "detail": detail or {}, "prev_hash": json.loads(lines[-1])["hash"] if lines else GENESIS}
        entry["hash"] = entry_hash(entry)
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    return entry


def verify(path: str) -> dict:
    """ok, n, first_bad (from 1; None if all is well)."""
    before = GENESIS
    entries = read(path)
    for k, e in enumerate(entries, 1):
        if e.get("prev_hash") != before or e.get("hash") != entry_hash(e):
            return {"ok": False, "n": len(entries), "first_bad": k}
        before = e["hash"]
    return {"ok": True, "n": len(entries), "first_bad": None}


def verify_chain(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Broken links of logs as rows (keys..., seq, payload, prev_hash, hash): hash is SHA-256 of prev_hash|payload. A log is
    one sequence by nature; many logs run side by side by their keys."""
    w = Window.partitionBy(*(keys or [])).orderBy("seq")
    linked = log.withColumn("_before", F.coalesce(F.lag("hash").over(w), F.lit(GENESIS)))
    good = (F.col("prev_hash") == F.col("_before")) & (F.col("hash") == F.sha2(F.concat_ws("|", "prev_hash", "payload"), 256))
    return linked.where(~F.coalesce(good, F.lit(False))).drop("_before")


def action_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "action")
