"""The catalogue of identifiers and their default actions."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Identifier:
    id: str
    label: str
    category: str
    action: str
    detectors: tuple[str, ...]
    salt: str
    fpe_mode: str | None = None
    generalize: str | None = None


#: Ids, categories, default actions, detectors, salts.
IDENTIFIERS = (
    Identifier("name", "Names and aliases", "direct", "pseudonymize", ("PERSON",), "name"),
    Identifier("national_id", "National ID, passport, birth certificate", "direct", "pseudonymize", ("nric", "temp_ic", "passport"), "natid", fpe_mode="alnum_upper"),
    Identifier("mrn", "Medical record number", "direct", "pseudonymize", ("mrn",), "mrn", fpe_mode="alnum_upper"),
    Identifier("case_visit", "Case or visit number", "direct", "pseudonymize", ("case", "mrn"), "case", fpe_mode="alnum_upper"),
    Identifier("address", "Address", "quasi", "generalize", ("address", "LOCATION"), "addr", generalize="region"),
    Identifier("postal_code", "Postal code", "quasi", "generalize", ("postal",), "postal", generalize="postal_mask"),
    Identifier("phone", "Telephone number", "direct", "pseudonymize", ("phone",), "phone"),
    Identifier("fax", "Fax number", "direct", "redact", ("fax", "phone"), "fax"),
    Identifier("email", "E-mail address", "direct", "redact", ("email",), "email"),
    Identifier("dob", "Date of birth", "quasi", "generalize", ("date",), "dob", generalize="year"),
    Identifier("date_of_death", "Date of death", "quasi", "generalize", ("date",), "dod", generalize="year"),
    Identifier("device", "Device or serial number", "direct", "pseudonymize", ("serial",), "dev"),
    Identifier("biometric", "Biometric identifier", "direct", "redact", ("biometric",), "bio"),
    Identifier("photo", "Full-face photograph", "direct", "redact", ("image",), "photo"),
    Identifier("other_id", "Other identifier, code or free text", "other", "pseudonymize", ("other", "url", "ip", "account"), "other"),
)
BY_ID = {x.id: x for x in IDENTIFIERS}
ACTIONS = ("pseudonymize", "fpe", "generalize", "redact", "redact_freetext", "keep")

#: What column names hint at, in order.
NAME_HINTS = (
    ("name", r"name|alias|initial"),
    ("national_id", r"nric|\bfin\b|passport|birth\s*cert|national.?id"),
    ("mrn", r"mrn|medical.?record|record.?no|hosp.?no|patient.?id"),
    ("case_visit", r"case|visit|episode|admission|encounter|billing"),
    ("fax", r"fax"),
    ("phone", r"phone|tel|mobile|hp\b|contact|pager"),
    ("email", r"email|e-?mail"),
    ("postal_code", r"postal|zip"),
    ("address", r"address|addr|street|block|unit|residen"),
    ("date_of_death", r"death|deceas|expir|demise"),
    ("dob", r"dob|birth|\bbday\b"),
    ("device", r"serial|device|\bsn\b|implant"),
    ("biometric", r"biometric|fingerprint|iris|voiceprint"),
    ("photo", r"photo|image|face|picture|img"),
    ("other_id", r"note|remark|comment|free|text|desc|diagnos"),
)
TYPE_IDENTIFIER = {"nric": "national_id", "email": "email", "phone": "phone", "postal": "postal_code", "date": "dob", "mrn": "mrn"}
FREE_TEXT = re.compile(r"note|remark|comment|text|desc|free")


def name_hint(column: str) -> str | None:
    return next((i for i, p in NAME_HINTS if re.search(p, column.lower())), None)


def freetext_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if FREE_TEXT.search(c.lower())]


def token_prefix(identifier: str | None) -> str:
    """Prefix of a table's pseudonyms."""
    return "ID" if not identifier else identifier[:3].upper()


#: Prefixes of a document's pseudonyms.
_DOCUMENT_PREFIX = {"name": "NAME", "national_id": "ID", "mrn": "MRN", "case_visit": "CASE", "other_id": "UID", "phone": "PHONE"}


def document_prefix(identifier: str) -> str:
    return _DOCUMENT_PREFIX.get(identifier, identifier[:4].upper())
