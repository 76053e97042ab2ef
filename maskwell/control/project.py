"""Project folders: stages, keys, manifest, signatures, certificate data, bundles."""

from __future__ import annotations

import hashlib
import json
import os
import re
import secrets
import shutil
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.policy import Policy
from . import audit

STAGES = ("created", "detected", "deidentified", "reviewed", "signed")
#: Who may move a project to a stage.
ROLES = {"detected": ("admin", "analyst"), "deidentified": ("admin", "analyst"), "reviewed": ("admin", "reviewer"), "signed": ("admin",)}
FOLDERS = ("input", "output", "keys", "feedback", "chunks")


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def digest(value) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def read_or_make_key(path: str) -> bytes:
    """32 bytes; made once, for the owner's eyes."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600), "wb") as f:
                f.write(secrets.token_bytes(32))
        except FileExistsError:
            pass
    with open(path, "rb") as f:
        return f.read()


class Project:
    def __init__(self, folder: str):
        self.folder = os.path.abspath(folder)
        with open(self.path("project.json"), encoding="utf-8") as f:
            self.state = json.load(f)
        self.policy = Policy.from_json(json.dumps(self.state["policy"]))

    @classmethod
    def create(cls, folder: str, name: str, actor: str = "unknown", key_scope: str = "project") -> Project:
        for x in FOLDERS:
            os.makedirs(os.path.join(folder, x), exist_ok=True)
        state = {"name": name, "stage": "created", "key_scope": key_scope, "policy": json.loads(Policy().to_json()), "inputs": [], "signatures": []}
        with open(os.path.join(folder, "project.json"), "w", encoding="utf-8") as f:
            json.dump(state, f, indent=1)
        p = cls(folder)
        p.log("project_created", actor, {"name": name})
        return p

    def path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def log(self, action: str, actor: str = "unknown", detail: dict | None = None) -> None:
        audit.append(self.path("audit.jsonl"), action, actor, detail)

    def save(self) -> None:
        # the whole policy, so that tunings survive an edit of the columns
        self.state["policy"] = json.loads(self.policy.to_json())
        temporary = self.path("project.json.tmp")
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump(self.state, f, indent=1)
        os.replace(temporary, self.path("project.json"))

    def advance(self, stage: str, actor: str, role: str) -> None:
        if role not in ROLES[stage]:
            raise PermissionError(f"{role} may not move a project to {stage}")
        if STAGES.index(stage) > STAGES.index(self.state["stage"]) + 1:
            raise ValueError(f"{self.state['stage']} does not lead to {stage}")
        self.state["stage"] = stage
        self.save()
        self.log(f"stage_{stage}", actor, {"role": role})

    def send_back(self, actor: str, reason: str) -> None:
        self.state["stage"] = "detected"
        self.save()
        self.log("returned", actor, {"reason": reason})

    def key(self, global_path: str | None = None) -> bytes:
        if self.state["key_scope"] == "global":
            return read_or_make_key(global_path or os.path.expanduser("~/.maskwell/global.key"))
        return read_or_make_key(self.path("keys", "project.key"))

    def register_input(self, path: str, actor: str = "unknown") -> str:
        copy = self.path("input", os.path.basename(path))
        if os.path.abspath(path) != copy:
            shutil.copyfile(path, copy)
        entry = {"file": os.path.relpath(copy, self.folder), "role": "input", "sha256": sha256_file(copy), "bytes": os.path.getsize(copy)}
        self.state["inputs"] = [e for e in self.state["inputs"] if e["file"] != entry["file"]] + [entry]
        self.save()
        self.log("input_registered", actor, entry)
        return copy

    def manifest(self) -> list[dict]:
        """Every file but keys, with role, digest and size; written to manifest.json."""
        out = []
        for top, folders, names in os.walk(self.folder):
            folders[:] = sorted(d for d in folders if d != "keys")
            for n in sorted(names):
                path = os.path.join(top, n)
                file = os.path.relpath(path, self.folder)
                if file not in ("manifest.json", "audit.jsonl"):
                    out.append({"file": file, "role": file.split(os.sep)[0] if os.sep in file else "project", "sha256": sha256_file(path), "bytes": os.path.getsize(path)})
        out.sort(key=lambda e: e["file"])
        with open(self.path("manifest.json"), "w", encoding="utf-8") as f:
            json.dump(out, f, indent=1)
        return out

    def export(self, path: str) -> list[str]:
        """A bundle without keys."""
        names = [e["file"] for e in self.manifest()] + ["manifest.json", "audit.jsonl"]
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                if os.path.exists(self.path(n)):
                    z.write(self.path(n), n)
        return names

    @classmethod
    def unpack(cls, bundle: str, folder: str) -> Project:
        with zipfile.ZipFile(bundle) as z:
            for n in z.namelist():
                if not os.path.abspath(os.path.join(folder, n)).startswith(os.path.abspath(folder) + os.sep):
                    raise ValueError(f"bad name in bundle: {n}")
            z.extractall(folder)
        for x in FOLDERS:
            os.makedirs(os.path.join(folder, x), exist_ok=True)
        return cls(folder)

    def sign(self, spark: SparkSession, actor: str, private: bytes, public: bytes) -> dict:
        """Sign the manifest and the audit tip. This shows integrity; who holds the key is outside it."""
        body = {"manifest": digest(self.manifest()), "audit_tip": audit.tip(self.path("audit.jsonl")), "actor": actor}
        made = {**body, "public": public.hex(), "signature": sign(spark, private, digest(body).encode()).hex()}
        self.state["signatures"].append(made)
        self.save()
        self.log("signed", actor, {"manifest": body["manifest"]})
        return made

    def certificate(self, spark: SparkSession) -> dict:
        """What a certificate states: policy, inputs, audit and signature checks, counts."""
        entries = audit.read(self.path("audit.jsonl"))
        good = [verify(spark, bytes.fromhex(s["public"]), digest({k: s[k] for k in ("manifest", "audit_tip", "actor")}).encode(), bytes.fromhex(s["signature"])) for s in self.state["signatures"]]
        counts: dict[str, int] = {}
        for e in entries:
            counts[e["action"]] = counts.get(e["action"], 0) + 1
        return {"project": self.state["name"], "stage": self.state["stage"], "columns": {c: r.action for c, r in self.policy.columns.items()}, "inputs": self.state["inputs"], "audit": audit.verify(self.path("audit.jsonl")), "signatures_valid": good, "actions": sorted(counts.items(), key=lambda x: (-x[1], x[0]))}


def file_manifest(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """file, sha256, bytes of the files under a path that only Spark may reach."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def file_slug(name: str) -> str:
    return re.sub(r"^_+|_+$", "", re.sub(r"[^A-Za-z0-9._-]+", "_", name)) or "table"


# Ed25519 by the JVM's own provider


def keypair(spark: SparkSession) -> tuple[bytes, bytes]:
    """(private, public) in PKCS#8 and X.509."""
    pair = spark._jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    # the keys' classes are not open to reflection; a factory states their encodings
    factory = spark._jvm.java.security.KeyFactory.getInstance("Ed25519")
    made = [(pair.getPrivate(), "java.security.spec.PKCS8EncodedKeySpec"), (pair.getPublic(), "java.security.spec.X509EncodedKeySpec")]
    private, public = (bytes(factory.getKeySpec(k, spark._jvm.java.lang.Class.forName(c)).getEncoded()) for k, c in made)
    return private, public


def sign(spark: SparkSession, private: bytes, message: bytes) -> bytes:
    sec = spark._jvm.java.security
    signer = sec.Signature.getInstance("Ed25519")
    signer.initSign(sec.KeyFactory.getInstance("Ed25519").generatePrivate(sec.spec.PKCS8EncodedKeySpec(bytearray(private))))
    signer.update(bytearray(message))
    return bytes(signer.sign())


def verify(spark: SparkSession, public: bytes, message: bytes, signature: bytes) -> bool:
    sec = spark._jvm.java.security
    checker = sec.Signature.getInstance("Ed25519")
    try:
        checker.initVerify(sec.KeyFactory.getInstance("Ed25519").generatePublic(sec.spec.X509EncodedKeySpec(bytearray(public))))
        checker.update(bytearray(message))
        return bool(checker.verify(bytearray(signature)))
    except Exception:
        return False
