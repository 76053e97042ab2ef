"""The registry of detectors: patterns, base confidences and validators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column

from ..functions import dates, values

#: Java's own word boundary knows all scripts' letters; detectors mean ASCII words.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


@dataclass(frozen=True)
class Detector:
    name: str
    type: str
    identifier: str
    pattern: str
    confidence: float
    validate: Callable[[Column], Column] | None = None
    #: A pattern that every text with a match matches, cheap to test; None: none is known.
    gate: str | None = None

    @property
    def java(self) -> str:
        return "(?i)" + self.pattern.replace(r"\b", BOUNDARY)


def _compact(value: Column) -> Column:
    return dates.parse_compact(value).isNotNull()


#: Names, patterns and confidences, in order.
_SHIPPED = (
    Detector("nric", "nric", "national_id", r"\b[STFGMstfgm][0-9]{7}[A-Za-z]\b", 0.6, values.nric_valid, "[0-9]{7}"),
    Detector("temp_ic", "temp_ic", "national_id", r"\b[XYxy][0-9]{7}(?:[0-9]{3})?[A-Za-z]\b", 0.8, None, "[0-9]{7}"),
    Detector("email", "email", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0.97, None, "@"),
    Detector("phone", "phone", "phone", r"(?<![0-9])(?:\+?65[ -]?)?[3689][0-9]{3}[ -]?[0-9]{4}(?![0-9])", 0.7, None, "[0-9]{4}"),
    Detector("postal", "postal", "postal_code", r"\bSingapore\s+[0-9]{6}\b|\bS\(?[0-9]{6}\)?\b", 0.6, None, "[0-9]{6}"),
    Detector("date", "date", "dob", r"\b(?:[0-3]?[0-9][/-][0-1]?[0-9][/-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[/-][0-1]?[0-9][/-][0-3]?[0-9])\b", 0.75, None, "[0-9][/-][0-9]"),
    Detector("date_compact", "date", "dob", r"\b[0-9]{8}(?:[ T][0-9]{6})?\b", 0.55, _compact, "[0-9]{8}"),
    Detector("url", "url", "other_id", r"\bhttps?://[^\s]+\b", 0.95, None, "(?i)https?://"),
    Detector("ip", "ip", "other_id", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.7, values.ipv4_valid, r"[0-9]\.[0-9]"),
    Detector("passport", "passport", "national_id", r"\b[A-Za-z]{1,2}[0-9]{6,8}\b", 0.35, None, "[0-9]{6}"),
    Detector("case", "case", "case_visit", r"\b[0-9]{10}[A-Za-z]\b", 0.7, None, "[0-9]{10}"),
    Detector("mrn", "mrn", "mrn", r"\b[A-Za-z]{0,3}[0-9]{6,10}\b", 0.4, None, "[0-9]{6}"),
    Detector("creditcard", "account", "other_id", r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", 0.6, values.luhn_valid, "[0-9]{4}"),
)
_POSTAL6 = Detector("postal6", "postal", "postal_code", r"\b[0-9]{6}\b", 0.5, None, "[0-9]{6}")
#: Detectors precise enough for sweeps of documents.
SWEEP = ("nric", "email", "phone", "postal", "postal6")


def registry(postal6: bool = False, extra: Iterable[Detector] = ()) -> list[Detector]:
    """Shipped detectors, then the opt-in bare postal code, then a caller's own."""
    return [*_SHIPPED, *([_POSTAL6] if postal6 else []), *extra]


def quote(text: str) -> str:
    """A literal inside a pattern."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def watchlist(pairs: Iterable[tuple[str, str]]) -> list[Detector]:
    """One detector for each identifier over its known values, longest first."""
    by: dict[str, list[str]] = {}
    for identifier, value in pairs:
        if value and value not in by.setdefault(identifier, []):
            by[identifier].append(value)
    return [Detector(f"wl_{i}", i, i, "(?:" + "|".join(quote(v) for v in sorted(vs, key=lambda v: (-len(v), v))) + ")", 0.95) for i, vs in by.items() if vs]


def learned(patterns: Iterable[tuple[str, str] | tuple[str, str, float]]) -> list[Detector]:
    """Approved patterns: (identifier, pattern[, confidence])."""
    return [Detector(f"learned_{k}", p[0], p[0], p[1], p[2] if len(p) > 2 else 0.9) for k, p in enumerate(patterns, 1)]
