"""Documents: XML scrubbing and the relational part of page redaction."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keyed
from ..plans.detectors import SWEEP, Detector, registry
from ..plans.identifiers import BY_ID, document_prefix
from .spans import scan

#: What never changes, and the targets of each profile: path of local names, identifier, action, attribute.
PROTECTED = {"philips": ("parsedwaveforms", "waveforms"), "muse": ("WaveFormData", "Waveform")}
TARGETS = {
    "philips": (
        ("name/firstname", "name", "pseudonymize", None),
        ("name/lastname", "name", "pseudonymize", None),
        ("name/middlename", "name", "pseudonymize", None),
        ("acquirer/firstname", "name", "redact", None),
        ("acquirer/lastname", "name", "redact", None),
        ("patientid", "national_id", "pseudonymize", None),
        ("documentid", "other_id", "pseudonymize", None),
        ("dateofbirth", "dob", "generalize_year", None),
        ("institution", "address", "redact", None),
        ("department", "address", "redact", None),
        ("dataacquisition", "date_of_death", "generalize_year", "date"),
        ("dataacquisition", "other_id", "redact", "time"),
    ),
    "muse": (
        ("PatientID", "mrn", "pseudonymize", None),
        ("PatientLastName", "name", "pseudonymize", None),
        ("PatientFirstName", "name", "pseudonymize", None),
        ("DateofBirth", "dob", "generalize_year", None),
        ("AcquisitionDate", "date_of_death", "generalize_year", None),
        ("AcquisitionTime", "other_id", "redact", None),
        ("SiteName", "address", "redact", None),
        ("Location", "address", "redact", None),
        ("AcquisitionTechnician", "name", "redact", None),
        ("OverreadingPhysician", "name", "redact", None),
        ("RequestingMD", "name", "redact", None),
        ("ReferringMD", "name", "redact", None),
        ("EditorID", "other_id", "pseudonymize", None),
    ),
    "cda": (
        ("patientRole/id", "national_id", "pseudonymize", "extension"),
        ("patient//given", "name", "pseudonymize", None),
        ("patient//family", "name", "pseudonymize", None),
        ("birthTime", "dob", "generalize_year", "value"),
        ("addr/streetAddressLine", "address", "redact", None),
        ("addr/postalCode", "postal_code", "mask_postal", None),
        ("telecom", "phone", "redact", "value"),
        ("author//given", "name", "redact", None),
        ("author//family", "name", "redact", None),
    ),
    "fhir": (
        ("identifier/value", "national_id", "pseudonymize", "value"),
        ("name/family", "name", "pseudonymize", "value"),
        ("name/given", "name", "pseudonymize", "value"),
        ("telecom/value", "phone", "redact", "value"),
        ("birthDate", "dob", "generalize_year", "value"),
        ("address/line", "address", "redact", "value"),
        ("address/postalCode", "postal_code", "mask_postal", "value"),
    ),
    "generic": (),
}
SCRUBBED = "path string, xml string, profile string, n_changes int, protected_nodes int, waveform_ok boolean, error string, changes array<struct<xpath:string,identifier:string,action:string,detector:string,before:string,after:string>>"


def local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def xml_profile(root: ET.Element, source: str) -> str:
    name, spaces = local(root.tag).lower(), " ".join(re.findall(r"xmlns(?::\w+)?\s*=\s*[\"']([^\"']*)", source)).lower()
    if name == "restingecgdata" or "medical.philips.com" in spaces:
        return "philips"
    if name == "restingecg":
        return "muse"
    if name == "clinicaldocument" or "hl7-org:v3" in spaces:
        return "cda"
    if "hl7.org/fhir" in spaces or name in ("patient", "bundle"):
        return "fhir"
    return "generic"


def _select(root: ET.Element, path: str) -> list[ET.Element]:
    """Elements of a path of local names of any length: ``a/b`` a child, ``a//b`` any descendant; the first is anywhere."""
    first, *steps = re.split("(//?)", path)
    found = [e for e in root.iter() if local(e.tag) == first]
    for axis, name in zip(steps[::2], steps[1::2], strict=True):
        below = (x for t in found for x in (t.iter() if axis == "//" else t) if x is not t and local(x.tag) == name)
        found = list({id(x): x for x in below}.values())
    return found


@contextmanager
def _prefixes(source: str):
    """A document's own prefixes for its output, and no others: the registry is the whole process's."""
    kept = dict(ET._namespace_map)
    try:
        for prefix, uri in re.findall(r"xmlns(?::(\w+))?\s*=\s*[\"']([^\"']*)", source):
            if not re.fullmatch(r"ns\d+", prefix):
                ET.register_namespace(prefix, uri)
        yield
    finally:
        ET._namespace_map.clear()
        ET._namespace_map.update(kept)


def _mask(value: str, last: int = 3) -> str:
    places = [k for k, c in enumerate(value) if c in "0123456789"][-last:]
    return "".join("X" if k in places else c for k, c in enumerate(value))


def _token(value: str, key: bytes | str, prefix: str, salt: str) -> str:
    import hashlib
    import hmac

    sub = keyed.derive_key(key, f"pseudonym:{salt}")
    return f"{prefix}-{hmac.new(sub, (salt + keyed.SEPARATOR + value).encode(), hashlib.sha256).hexdigest()[:16]}"


def _transform(value: str, action: str, identifier: str, key: bytes | str | None) -> str:
    if not value.strip():
        return value
    if action == "pseudonymize":
        if key is None:
            raise ValueError("pseudonyms need a key")
        own = BY_ID.get(identifier)
        return _token(value, key, document_prefix(identifier), own.salt if own else identifier)
    if action == "generalize_year":
        found = re.search(r"(?:18|19|20)[0-9]{2}", value)
        return found[0] if found else "[DATE]"
    if action == "mask_postal":
        return _mask(value)
    return "[REDACTED]" if action == "redact" else value


def _sweep(text: str, found: list[Detector]) -> tuple[str, list[str]]:
    """Text with the union of all matches replaced (an exact postal match masked), and the types; no confidence floor."""
    hits = sorted((m.start(), m.end(), d.type) for d in found for m in re.finditer(d.pattern, text, re.I | re.A))
    merged: list[list] = []
    for a, b, t in hits:
        if merged and a <= merged[-1][1]:
            last = merged[-1]
            wide = b - a > last[3] - last[2]
            merged[-1] = [last[0], max(last[1], b), *((a, b, t) if wide else last[2:5])]
        else:
            merged.append([a, b, a, b, t])
    for a, b, x, y, t in reversed(merged):
        new = _mask(text[a:b]) if t == "postal" and (a, b) == (x, y) else "[REDACTED]"
        text = text[:a] + new + text[b:]
    return text, sorted({m[4] for m in merged})


def scrub_xml(source: str, key: bytes | str | None = None, profile: str | None = None, sweep: bool = True, actions: dict[str, str] | None = None, postal6: bool = False) -> dict:
    """Scrub one document: targets, then a sweep over all other texts, those beside child elements too. Tokens that the targets were
    given are not swept: digits in them are no phone numbers. Protected payloads must come out unchanged."""
    root = ET.fromstring(source.encode() if isinstance(source, str) else source)
    profile, changes, tokens = profile or xml_profile(root, source), [], set()
    guarded = [e for e in root.iter() if local(e.tag) in PROTECTED.get(profile, ())]
    before_text = ["".join(e.itertext()) for e in guarded]
    inside = {id(x) for e in guarded for x in e.iter()}
    for path, identifier, action, attribute in TARGETS[profile]:
        action = (actions or {}).get(identifier, action)
        if action == "keep":
            continue
        for e in _select(root, path):
            if attribute is None and len(e):
                continue
            old = (e.text or "") if attribute is None else e.get(attribute, "")
            if not old.strip():
                continue
            new = _transform(old, action, identifier, key)
            if attribute is None:
                e.text = new
                if action == "pseudonymize":
                    tokens.add(id(e))
            else:
                e.set(attribute, new)
            if new != old:
                changes.append((path if attribute is None else f"{path}/@{attribute}", identifier, action, "xml:profile", old, new))
    if sweep:
        found = [d for d in registry(postal6) if d.name in SWEEP]
        for e in root.iter():
            if id(e) in inside or not isinstance(e.tag, str):
                continue
            # what stands in an element: before its first child, and after each child
            for holder, part in [(e, "text"), *((child, "tail") for child in e)]:
                old = getattr(holder, part) or ""
                if not old.strip() or (part == "text" and id(e) in tokens):
                    continue
                new, types = _sweep(old, found)
                if new != old:
                    changes.append((local(e.tag), "other_id", "redact_freetext", f"xml:sweep({','.join(types)})", old, new))
                    setattr(holder, part, new)
    ok = before_text == ["".join(e.itertext()) for e in guarded]
    with _prefixes(source):
        xml = ET.tostring(root, encoding="unicode")
    return {"xml": xml, "profile": profile, "n_changes": len(changes), "protected_nodes": len(guarded), "waveform_ok": ok, "changes": changes}


def scrub_table(docs: DataFrame, key: bytes | str | None = None, sweep: bool = True, actions: dict[str, str] | None = None, postal6: bool = False) -> DataFrame:
    """Scrub every row of ``docs`` (path, xml). A document that cannot be parsed has no output and says why; one whose
    protected payload changed has no output either."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, xml in zip(pdf["path"], pdf["xml"], strict=True):
                try:
                    r = scrub_xml(xml, key, None, sweep, actions, postal6)
                    rows.append((path, r["xml"] if r["waveform_ok"] else None, r["profile"], r["n_changes"], r["protected_nodes"], r["waveform_ok"], None, [dict(zip(("xpath", "identifier", "action", "detector", "before", "after"), c, strict=True)) for c in r["changes"]]))
                except (ET.ParseError, AttributeError, TypeError) as e:
                    rows.append((path, None, None, 0, 0, False, f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=["path", "xml", "profile", "n_changes", "protected_nodes", "waveform_ok", "error", "changes"])

    return docs.select("path", "xml").mapInPandas(run, SCRUBBED)


# pages of words


def join_words(words: DataFrame) -> DataFrame:
    """``words`` (doc, page, word_idx, text, ...) with start and end of each word in its page's text."""
    w = Window.partitionBy("doc", "page").orderBy("word_idx")
    start = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return words.withColumn("start", start.cast("int")).withColumn("end", (F.col("start") + F.length("text") - 1).cast("int"))


def page_texts(placed: DataFrame) -> DataFrame:
    words = F.transform(F.sort_array(F.collect_list(F.struct("word_idx", "text"))), lambda x: x["text"])
    return placed.groupBy("doc", "page").agg(F.array_join(words, " ").alias("page_text"))


def pii_boxes(words: DataFrame, detectors: list[Detector] | None = None, scan_text: Callable | None = None) -> DataFrame:
    """doc, page, box columns, text, type, identifier: a row for each word that a span overlaps, whatever its confidence."""
    placed = join_words(words)
    spans = page_texts(placed).select("doc", "page", F.explode((scan_text or (lambda c: scan(c, detectors or registry())))(F.col("page_text"))).alias("s"))
    spans = spans.select("doc", "page", F.col("s.start").alias("s_start"), F.col("s.end").alias("s_end"), F.col("s.type").alias("type"), F.col("s.identifier").alias("identifier"))
    near = placed.join(spans, ["doc", "page"]).where("start <= s_end and end >= s_start")
    return near.select("doc", "page", "word_idx", "left", "top", "width", "height", "text", "type", "identifier")


def uncovered_words(words: DataFrame, boxes: DataFrame, detectors: list[Detector] | None = None) -> DataFrame:
    """What redaction missed: words of ``words`` (read again from the output) that a span overlaps and whose centre lies under no box of
    ``boxes`` (doc, page, left, top, width, height). No rows: verified."""
    shown = pii_boxes(words, detectors).select("doc", "page", "word_idx", "text", "type", "identifier", (F.col("left") + F.col("width") / 2).alias("x"), (F.col("top") + F.col("height") / 2).alias("y")).alias("w")
    under = boxes.select("doc", "page", "left", "top", "width", "height").distinct().alias("b")
    inside = F.col("w.x").between(F.col("b.left"), F.col("b.left") + F.col("b.width")) & F.col("w.y").between(F.col("b.top"), F.col("b.top") + F.col("b.height"))
    return shown.join(under, (F.col("w.doc") == F.col("b.doc")) & (F.col("w.page") == F.col("b.page")) & inside, "left_anti").drop("x", "y")


def digital_boxes(boxes: DataFrame, dpi: int = 150) -> DataFrame:
    """Boxes in points as pixels."""
    return boxes.withColumns({c: F.col(c) * dpi / 72.0 for c in ("left", "top", "width", "height")})


def ocr_boxes(words: DataFrame) -> DataFrame:
    """``bbox`` "x1,y1,x2,y2" as left, top, width, height."""
    b = F.transform(F.split("bbox", ","), lambda x: x.cast("double"))
    return words.withColumns({"left": b[0], "top": b[1], "width": b[2] - b[0], "height": b[3] - b[1]}).drop("bbox")
