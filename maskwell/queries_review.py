"""Registered queries of detectors one by one, sources, feedback, review and files, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import documents, spans, transform, tuning
from .plans import detectors as registry
from .plans.policy import Policy
from .queries import _EMAIL_SQL, KEY, QUERIES, SQL, query, table  # noqa: F401
from .sources import plugins, staging, tables

# detectors one by one, over texts made from every order

_PAD = "lpad(CAST(o_orderkey % {m} AS VARCHAR), {n}, '0')"
_P7, _P10, _P6 = _PAD.format(m=10_000_000, n=7), _PAD.format(m=10_000_000_000, n=10), _PAD.format(m=1_000_000, n=6)
_DAY = "CAST(1940 + o_orderkey % 60 AS VARCHAR) || lpad(CAST(1 + o_orderkey % 14 AS VARCHAR), 2, '0') || '28'"
_MADE = {
    "temp_ic": f"'card X' || {_P7} || 'K end'",
    "postal": f"'at Singapore  ' || {_P6} || ', or S(' || {_P6} || ') near'",
    "date_compact": f"'on ' || {_DAY} || ' 101500 seen'",
    "url": "'see HTTPS://example.org/a?b=' || CAST(o_orderkey AS VARCHAR) || ' there'",
    "ip": "'from 10.0.' || CAST(o_orderkey % 300 AS VARCHAR) || '.7 to'",
    "passport": f"'pass ab' || {_P7} || ' given'",
    "case": f"'visit ' || {_P10} || 'z, done'",
    "postal6": f"'code ' || {_P6} || '.'",
}
_FOUND = {
    "temp_ic": (r"\b[XYxy][0-9]{7}(?:[0-9]{3})?[A-Za-z]\b", "0.8"),
    "postal": (r"\bSingapore\s+[0-9]{6}\b|\bS\(?[0-9]{6}\)?\b", "0.6"),
    "date_compact": (r"\b[0-9]{8}(?:[ T][0-9]{6})?\b", "CASE WHEN o_orderkey % 14 < 12 THEN 0.99 ELSE 0.15 END"),
    "url": (r"\bhttps?://[^\s]+\b", "0.95"),
    "ip": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "CASE WHEN o_orderkey % 300 < 256 THEN 0.99 ELSE 0.3 END"),
    "passport": (r"\b[A-Za-z]{1,2}[0-9]{6,8}\b", "0.35"),
    "case": (r"\b[0-9]{10}[A-Za-z]\b", "0.7"),
    "postal6": (r"\b[0-9]{6}\b", "0.5"),
}


def _detected(name: str):
    pattern, confidence = _FOUND[name]

    def run(spark, sf) -> DataFrame:
        d = [x for x in registry.registry(postal6=True) if x.name == name]
        return spans.findings(table(spark, sf, "orders").select("o_orderkey", F.expr(_MADE[name].replace("AS VARCHAR", "AS STRING")).alias("text")), "o_orderkey", ["text"], d).select("row", "start", "end", "match", "type", "identifier", F.round("confidence", 6).alias("confidence"))

    shown = next(x for x in registry.registry(postal6=True) if x.name == name)
    QUERIES[f"detect_{name}"] = run
    SQL[f"detect_{name}"] = f"""
        WITH t AS (SELECT o_orderkey, {_MADE[name]} AS text FROM orders),
        m AS (SELECT o_orderkey, text, unnest(regexp_extract_all(text, '(?i){pattern}')) AS match FROM t)
        SELECT o_orderkey AS "row", CAST(instr(text, match) AS INTEGER) AS "start", CAST(instr(text, match) + length(match) - 1 AS INTEGER) AS "end", match, '{shown.type}' AS type, '{shown.identifier}' AS identifier, CAST({confidence} AS DOUBLE) AS confidence FROM m
    """


for _name in _FOUND:
    _detected(_name)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '[NAME] of [DEVICE]' WHEN c_custkey % 3 = 1 THEN '[NAME] of SN-12' ELSE 'other of [DEVICE]' END AS t FROM customer")
def watchlist_and_learned(spark, sf):
    """Known values, also such as hold pattern characters, and an approved pattern."""
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, "ANN (q)+ of SN-123").when(k == 1, "ann of SN-12").otherwise("other of SN-999")
    extra = [*registry.watchlist([("name", "Ann"), ("name", "Ann (Q)+")]), *registry.learned([("device", r"\bSN-[0-9]{3}\b")])]
    return table(spark, sf, "customer").select("c_custkey", text.alias("t")).select("c_custkey", spans.redact_freetext(F.col("t"), registry.registry(extra=extra)).alias("t"))


@query("""
    WITH s AS (SELECT o_orderkey AS k, 10 AS a1, CAST(10 + o_orderkey % 7 AS INTEGER) AS z1, o_orderkey % 10 / 10 AS c1, CAST(14 + o_orderkey % 5 AS INTEGER) AS a2, CAST(14 + o_orderkey % 5 + o_orderkey % 6 AS INTEGER) AS z2, o_orderkey % 9 / 10 AS c2 FROM orders),
    d AS (SELECT *, a2 <= z1 AS meet, (z1 - a1 > z2 - a2) OR (z1 - a1 = z2 - a2 AND c1 >= c2) AS first FROM s)
    SELECT k, a1 AS "start", z1 AS "end" FROM d WHERE NOT meet OR first UNION ALL SELECT k, a2, z2 FROM d WHERE NOT meet OR NOT first
""")
def dedup_overlaps(spark, sf):
    """Two spans a text: of overlapping ones the wider, then the more confident stays."""
    k = F.col("o_orderkey")
    one = lambda a, z, c: F.struct(a.cast("int").alias("start"), z.cast("int").alias("end"), F.lit("m").alias("match"), F.lit("t").alias("type"), F.lit("i").alias("identifier"), F.lit("d").alias("detector"), c.cast("double").alias("confidence"))
    two = F.array(one(F.lit(10), 10 + k % 7, k % 10 / 10), one(14 + k % 5, 14 + k % 5 + k % 6, k % 9 / 10))
    kept = table(spark, sf, "orders").select(k.alias("k"), F.explode(spans.dedup(two)).alias("s"))
    return kept.select("k", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


# sources and judges


@query(rf"""
    WITH e AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b'))) AS low FROM documents),
    f AS (SELECT DISTINCT doc_id, low, 'email' AS type, 0.97 AS confidence FROM e
        UNION ALL SELECT doc_id, 'the', 'other', CASE WHEN doc_id % 2 = 0 THEN 0.9 ELSE 0.6 END FROM documents WHERE contains(text, 'the'))
    SELECT CAST(doc_id AS BIGINT) AS "row", low, type, CAST(confidence AS DOUBLE) AS confidence, type = 'other' AND doc_id % 2 = 0 AS needs_review FROM f
""")
def detect_freetext(spark, sf):
    """Rules, a plug-in source and a judge together: one finding a value, the most confident, with the mark of any."""
    docs = table(spark, sf, "documents")

    def the(rows, texts):
        return [{"row": r, "start": t.index("the") + 1, "end": t.index("the") + 3, "match": "the", "type": "other", "identifier": "other_id", "detector": "word", "confidence": 0.6} for r, t in zip(rows, texts, strict=True) if "the" in t]

    raw = docs.where("doc_id % 2 = 0 and contains(text, 'the')").select(F.col("doc_id").cast("long").alias("row"), F.instr("text", "the").alias("start"), (F.instr("text", "the") + 2).alias("end"), F.lit("the").alias("match"), F.lit("unknown kind").alias("type"), F.lit("no such").alias("identifier"), F.lit(0.9).alias("confidence"), F.lit(None).cast("boolean").alias("needs_review"), F.array(F.lit("a")).alias("reasons"))
    judged = plugins.judge_frame(raw).withColumn("column", F.lit("text"))
    email = [d for d in registry.registry() if d.name == "email"]
    found = plugins.detect_freetext(docs, "doc_id", ["text"], email, [the], strict=True, judged=judged)
    return found.select("row", F.lower("match").alias("low"), "type", "confidence", "needs_review")


@query("""
    SELECT o_orderkey AS "row", CASE o_orderkey % 4 WHEN 0 THEN 'phone' WHEN 1 THEN 'sensitive' WHEN 2 THEN 'other' ELSE 'email' END AS type,
        CASE o_orderkey % 4 WHEN 0 THEN 'fax' WHEN 1 THEN 'genetic' WHEN 2 THEN 'other_id' ELSE 'name' END AS identifier,
        CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 0.75 END::DOUBLE AS confidence, o_orderkey % 5 <> 1 AS needs_review, CASE WHEN o_orderkey % 2 = 0 THEN 'a;b' ELSE '' END AS reasons FROM orders
""")
def judge_frame(spark, sf):
    k = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        k.alias("row"),
        F.lit(1).alias("start"),
        F.lit(2).alias("end"),
        F.lit("x").alias("match"),
        F.when(k % 4 == 0, "telefax").when(k % 4 == 3, "email").alias("type"),
        F.when(k % 4 == 0, "fax").when(k % 4 == 1, "genetic").when(k % 4 == 3, "name").alias("identifier"),
        F.when(k % 3 != 0, 0.75).alias("confidence"),
        F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("needs_review"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).alias("reasons"),
    )
    return plugins.judge_frame(raw).select("row", "type", "identifier", "confidence", "needs_review", "reasons")


@query("""
    WITH c AS (SELECT o_custkey AS "row", CAST(o_orderkey % 50 AS INTEGER) AS a, 'phone' AS type FROM orders
        UNION ALL SELECT o_custkey, CAST(o_orderkey % 40 AS INTEGER), 'person' FROM orders WHERE o_orderkey % 2 = 0)
    SELECT "row", count(*) AS n, string_agg(a || type, ',' ORDER BY a, type) AS candidates FROM c GROUP BY "row"
""")
def judge_candidates(spark, sf):
    """Every span of a token classifier, and of an entity recogniser's only the persons."""
    o = table(spark, sf, "orders")
    made = lambda m, kind: o.select(F.col("o_custkey").alias("row"), (F.col("o_orderkey") % m).cast("int").alias("start"), F.lit(99).alias("end"), F.lit("m").alias("match"), kind.alias("type"))
    found = plugins.judge_candidates(made(50, F.lit("phone")), made(40, F.when(F.col("o_orderkey") % 2 == 0, "person").otherwise("place")))
    text = F.array_join(F.transform("candidates", lambda c: F.concat(c["start"].cast("string"), c["type"])), ",")
    return found.select("row", F.size("candidates").cast("long").alias("n"), text.alias("candidates"))


# feedback


def _missed(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(F.lit("t.csv").alias("file"), F.lit("notes").alias("column"), F.col("c_custkey").alias("row"), F.col("c_name").alias("value"), F.lit("name").alias("identifier"))


@query("SELECT c_custkey AS \"row\", c_name AS value, 'name' AS identifier, 'reviewer' AS source, 'ann' AS actor FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'other_id', 'audit', 'bob' FROM customer")
def record_misses(spark, sf):
    """Two rounds into one sealed store, read back."""
    store = staging.fresh_path(spark, "feedback")
    tuning.record_misses(_missed(spark, sf), store, KEY, "ann")
    more = table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("value"), F.lit("other_id").alias("identifier"))
    tuning.record_misses(more, store, KEY, "bob", "audit")
    return tuning.read_misses(spark, store, KEY).select("row", "value", "identifier", "source", "actor")


@query(f"SELECT column0 AS value, column1 AS identifier, 'gold' AS source FROM (SELECT 'nobody-' || CAST(doc_id AS VARCHAR) AS column0, 'name' AS column1 FROM documents) UNION ALL SELECT v, 'email', 'gold' FROM {_EMAIL_SQL} WHERE false")
def ingest_gold(spark, sf):
    """What no detector catches is recorded as missed."""
    docs, store = table(spark, sf, "documents"), staging.fresh_path(spark, "gold")
    email = [d for d in registry.registry() if d.name == "email"]
    real = docs.select(F.explode(spans.scan(F.col("text"), email)).alias("s")).select(F.upper("s.match").alias("value"), F.lit("email").alias("identifier"))
    fake = docs.select(F.concat(F.lit("nobody-"), F.col("doc_id").cast("string")).alias("value"), F.lit("name").alias("identifier"))
    tuning.ingest_gold(real.unionByName(fake), tuning.caught_values(docs, ["text"], email), store, KEY)
    return tuning.read_misses(spark, store, KEY).select("value", "identifier", "source")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '[BUILDING] [IP]' ELSE c_mktsegment || ' 10.0.0.999' END AS tuned, c_mktsegment || ' 10.0.0.999' AS reverted FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, replace(c_mktsegment, 'BUILDING', '[BUILDING]') || ' [IP]', c_mktsegment || ' 10.0.0.999' FROM customer WHERE c_custkey % 2 = 1")
def tunings_apply_and_revert(spark, sf):
    """A watchlist value and a lower floor are applied, then both are taken back."""
    policy = Policy().set("tuned", "other_id", "redact_freetext")
    watch = {"id": "sg_1", "delta": json.dumps({"lever": "watchlist", "pairs": [{"identifier": "building", "value": "BUILDING"}]})}
    floor = {"id": "sg_2", "delta": json.dumps({"lever": "threshold", "identifier": "other_id", "floor": 0.25})}
    tuned = tuning.apply(tuning.apply(policy, watch), floor)
    back = tuning.revert(tuning.revert(tuned))
    word = F.when(F.col("c_custkey") % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment"))
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(word, F.lit(" 10.0.0.999")).alias("tuned"))
    rows = rows.withColumn("reverted", F.col("tuned"))
    rows = transform.deidentify(rows, tuned).data().withColumnRenamed("tuned", "t").withColumnRenamed("reverted", "tuned")
    return transform.deidentify(rows, back).data().select("c_custkey", F.col("t").alias("tuned"), F.col("tuned").alias("reverted"))


# review


@query("SELECT c_custkey AS \"row\", 'c_acctbal' AS \"column\", CAST(c_nationkey AS VARCHAR) AS before, CAST(c_nationkey + 1 AS VARCHAR) AS after FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'c_name', c_name, NULL FROM customer WHERE c_custkey % 5 = 0")
def review_side_by_side(spark, sf):
    before = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("c_acctbal"), "c_mktsegment")
    after = before.withColumns({"c_name": F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")), "c_acctbal": F.col("c_acctbal") + F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)})
    return transform.side_by_side(before, after, "c_custkey")


@query("SELECT o_custkey AS doc, CAST(k AS INTEGER) AS word_idx, 'email' AS type FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE o_orderkey % 5 = 0 AND k % 2 = 1")
def redaction_verify(spark, sf):
    """Words with an e-mail address; boxes were painted over every second word only."""
    from pyspark.sql.window import Window

    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("@example.com"))).otherwise(F.col("o_orderstatus"))
    idx = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    words = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.lit(1).alias("page"), idx.alias("word_idx"), text.alias("text")).select("*", (F.col("word_idx") * 10.0).alias("left"), *[F.lit(v).alias(c) for c, v in (("top", 0.0), ("width", 8.0), ("height", 5.0))])
    boxes = words.where("word_idx % 2 = 0").select("doc", "page", (F.col("left") - 1).alias("left"), "top", (F.col("width") + 2).alias("width"), "height")
    return documents.uncovered_words(words, boxes, [d for d in registry.registry() if d.name == "email"]).select("doc", "word_idx", "type")


# files

_ODD_CELL = "CASE o_orderkey % 6 WHEN 0 THEN 'a \"b\", c' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN {empty} WHEN 3 THEN {na} WHEN 4 THEN {null} ELSE ' é<&> ' END"


def _odd_rows(spark, sf) -> DataFrame:
    cell = _ODD_CELL.format(empty="''", na="'NA'", null="NULL")
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.expr(cell).alias("cell"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS k, {_ODD_CELL.format(empty=chr(39) * 2, na='NULL', null=chr(39) * 2)} AS cell FROM orders")
def csv_round_trip(spark, sf):
    """Quotes, line breaks, empty and NA cells; a null is written empty and read as empty text."""
    where = staging.fresh_path(spark, "csv")
    tables.write_csv(_odd_rows(spark, sf), where)
    return tables.read_csv(spark, where)


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS k, {_ODD_CELL.format(empty=chr(39) * 2, na=chr(39) + 'NA' + chr(39), null='NULL')} AS cell FROM orders")
def xlsx_round_trip(spark, sf):
    """As many workbooks as the rows need, written and read by the executors."""
    where = staging.fresh_path(spark, "xlsx")
    tables.write_workbooks(_odd_rows(spark, sf), where)
    return tables.read_workbooks(spark, where)


@query("SELECT c_custkey, row_id FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS row_id FROM customer) WHERE row_id <= 50")
def head_preview(spark, sf):
    return tables.preview(tables.with_row_id(table(spark, sf, "customer").select("c_custkey"), order=["c_custkey"]))
