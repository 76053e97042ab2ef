"""Policies: what happens to each column, and their compilation to column expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates, fpe, keyed, values
from ..operators import spans
from . import detectors as registry
from .identifiers import BY_ID, token_prefix


@dataclass
class ColumnRule:
    action: str = "keep"
    identifier: str | None = None
    options: dict = field(default_factory=dict)


@dataclass
class Policy:
    columns: dict[str, ColumnRule] = field(default_factory=dict)
    freetext: dict = field(default_factory=lambda: {"min_conf": 0.5})
    conf_overrides: dict[str, float] = field(default_factory=dict)
    learned_patterns: list[tuple] = field(default_factory=list)
    watchlist: list[tuple[str, str]] = field(default_factory=list)
    rejects: list[str] = field(default_factory=list)
    applied_tunings: list[dict] = field(default_factory=list)
    autotune: dict = field(default_factory=dict)
    version: int = 1

    def set(self, column: str, identifier: str | None = None, action: str | None = None, **options) -> Policy:
        """Add a column; without an action, the identifier's own."""
        own = BY_ID.get(identifier)
        if action is None:
            action = own.action if own else "keep"
        if own and action == "generalize" and own.generalize:
            options.setdefault("method", own.generalize)
        self.columns[column] = ColumnRule(action, identifier, options)
        return self

    def to_json(self) -> str:
        return json.dumps({**self.__dict__, "columns": {c: r.__dict__ for c, r in self.columns.items()}}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        raw = json.loads(text)
        raw["columns"] = {c: ColumnRule(**r) for c, r in raw["columns"].items()}
        for k in ("learned_patterns", "watchlist"):
            raw[k] = [tuple(x) for x in raw[k]]
        return cls(**raw)

    def detectors(self) -> list[registry.Detector]:
        """Shipped, watchlist and learned detectors."""
        return registry.registry(extra=[*registry.watchlist(self.watchlist), *registry.learned(self.learned_patterns)])


def _generalize(value: Column, method: str, options: dict) -> Column:
    if method in ("year", "year_month"):
        return dates.generalize_date(value, method)
    if method == "date_shift":
        subject = options.get("subject")
        who = F.col(f"`{subject}`").cast("string") if subject else None
        return dates.shift_date(value, options["_key"], options["_salt"], who, options.get("window", 365))
    if method == "age":
        return values.generalize_age(value, options.get("width", 5), options.get("cap", 90))
    if method in ("region", "geo"):
        return values.generalize_geo(value)
    if method == "postal_mask":
        return values.mask_postal(value, options.get("mask_last", 3))
    return values.redact(value)


def compile_column(column: str, rule: ColumnRule, policy: Policy, key: bytes | str | None) -> Column:
    """Expression of a column's new value. Unknown actions leave it as it is."""
    value = F.col(f"`{column}`").cast("string")
    own = BY_ID.get(rule.identifier)
    salt = own.salt if own else (rule.identifier or column)
    if rule.action in ("pseudonymize", "fpe") or rule.options.get("method") == "date_shift":
        if key is None:
            raise ValueError(f"{column}: {rule.action} needs a key")
    if rule.action == "pseudonymize":
        return keyed.pseudonym(value, key, rule.options.get("prefix") or token_prefix(rule.identifier), salt)
    if rule.action == "fpe":
        mode = rule.options.get("mode") or (own.fpe_mode if own and own.fpe_mode else "alnum_upper")
        # beyond the domain: a pseudonym
        return F.coalesce(fpe.fpe(value, key, mode, salt), keyed.pseudonym(value, key, "ID", salt))
    if rule.action == "generalize":
        return _generalize(value, rule.options.get("method") or (own.generalize if own else None) or "redact", {**rule.options, "_key": key, "_salt": salt})
    if rule.action == "redact":
        return values.redact(value)
    if rule.action == "redact_freetext":
        opts = policy.freetext | rule.options
        mine = [r.split("\t", 1)[1] for r in policy.rejects if r.startswith(f"{column}\t")]
        return spans.redact_freetext(value, policy.detectors(), opts.get("min_conf", 0.5), policy.conf_overrides, opts.get("types"), mine or None)
    return F.col(f"`{column}`")
