"""Registered queries of the engine's operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, fpe, keyed, values
from .operators import disclosure, documents, profile, ranks, spans, transform, treatments, tuning
from .plans import detectors as registry
from .plans.policy import Policy
from .sources import plugins, staging, tables

#: A key for queries only.
KEY = bytes(range(32))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# HMAC in the oracle's SQL


def _sql_hmac(message: str, key: bytes) -> str:
    inner, outer = keyed.pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _sql_token(value: str, prefix: str, salt: str, key: bytes = KEY) -> str:
    return f"CASE WHEN {value} IS NOT NULL AND trim({value}) <> '' THEN '{prefix}-' || substr({_sql_hmac(f'{chr(39)}{salt}{chr(39)} || chr(1) || {value}', keyed.derive_key(key, f'pseudonym:{salt}'))}, 1, 16) END"


def _sql_days(subject: str, salt: str, window: int) -> str:
    span = 2 * window + 1
    digest = _sql_hmac(f"'{salt}|' || {subject}", KEY)
    word = lambda at: f"CAST('0x' || substr({digest}, {at}, 8) AS BIGINT)"
    return f"CAST(((({word(1)} % {span}) * {2**32 % span} + {word(9)} % {span}) % {span}) - {window} AS INTEGER)"


_NAME = _sql_token("c_name", "NAM", "name")


# keyed functions


@query(f"SELECT c_custkey, {_NAME} AS c_name, c_mktsegment FROM customer")
def pseudonymize_customer(spark, sf):
    return transform.deidentify(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), Policy().set("c_name", "name"), KEY).data()


@query(f"SELECT c_custkey, {_sql_token('c_name', 'NAM', 'name')} AS a, {_sql_token('c_name', 'NAM', 'name', b'k' * 32)} AS b, {_sql_token('c_name', 'OTH', 'other')} AS c FROM customer")
def pseudonym_key_isolation(spark, sf):
    n = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", keyed.pseudonym(n, KEY, "NAM", "name").alias("a"), keyed.pseudonym(n, b"k" * 32, "NAM", "name").alias("b"), keyed.pseudonym(n, KEY, "OTH", "other").alias("c"))


@query(f"SELECT o_orderkey, {_sql_hmac('o_orderpriority', KEY)} AS mac FROM orders")
def hmac_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", keyed.hmac_sha256(F.col("o_orderpriority"), KEY).alias("mac"))


@query(f"SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + {_sql_days('CAST(o_custkey AS VARCHAR)', 'dob', 365)}, '%Y-%m-%d') AS shifted FROM orders")
def date_shift_by_customer(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select("o_orderkey", dates.shift_date(day, KEY, "dob", F.col("o_custkey").cast("string")).alias("shifted"))


@query("SELECT o_custkey, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS BIGINT) AS days_before, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS BIGINT) AS days_after FROM orders GROUP BY o_custkey")
def date_shift_keeps_intervals(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), F.to_date(dates.shift_date(day, KEY, "dob", F.col("o_custkey").cast("string"))).alias("s"))
    return row.groupBy("o_custkey").agg(F.date_diff(F.max("d"), F.min("d")).cast("long").alias("days_before"), F.date_diff(F.max("s"), F.min("s")).cast("long").alias("days_after"))


@query("SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS original, true AS back, true AS shape FROM customer")
def fpe_round_trip(spark, sf):
    plain = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    row = table(spark, sf, "customer").select("c_custkey", plain.alias("original")).withColumn("token", fpe.fpe(F.col("original"), KEY, "digits", "mrn"))
    return row.select("c_custkey", "original", (fpe.fpe(F.col("token"), KEY, "digits", "mrn", decrypt=True) == F.col("original")).alias("back"), F.col("token").rlike("^[0-9]{9}$").alias("shape"))


@query("SELECT DISTINCT 'c_mktsegment' AS \"column\", c_mktsegment AS original, c_mktsegment AS token FROM customer WHERE c_mktsegment IS NOT NULL")
def crosswalk_seal_and_open(spark, sf):
    row = table(spark, sf, "customer").select(F.lit("c_mktsegment").alias("column"), F.col("c_mktsegment").alias("original"), F.col("c_mktsegment").alias("token")).where("original is not null").distinct()
    return transform.open_crosswalk(transform.seal_crosswalk(row, KEY), KEY)


# validators


@query("""
    WITH v AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS d FROM customer),
    w AS (SELECT *, (2 * CAST(d[1] AS INT) + 7 * CAST(d[2] AS INT) + 6 * CAST(d[3] AS INT) + 5 * CAST(d[4] AS INT) + 4 * CAST(d[5] AS INT) + 3 * CAST(d[6] AS INT) + 2 * CAST(d[7] AS INT)) AS s FROM v)
    SELECT c_custkey, substr('JZIHGFEDCBA', s % 11 + 1, 1) = 'A' AS s_a, substr('JZIHGFEDCBA', (s + 4) % 11 + 1, 1) = 'F' AS t_f,
      substr('XWUTRQPNMLK', s % 11 + 1, 1) = 'K' AS f_k, substr('KLJNPQRTUWX', 11 - (s + 3) % 11, 1) = 'L' AS m_l, false AS bad FROM w
""")
def nric_validate_derived(spark, sf):
    d = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    made = {n: F.concat(F.lit(n[0].upper()), d, F.lit(n[2].upper())) for n in ("s_a", "t_f", "f_k", "m_l")}
    return table(spark, sf, "customer").select("c_custkey", *[values.nric_valid(v).alias(n) for n, v in made.items()], values.nric_valid(F.concat(F.lit("A"), d, F.lit("A"))).alias("bad"))


@query("""
    WITH v AS (SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS d FROM customer)
    SELECT c_custkey, CAST(1 AS BIGINT) AS n_valid, substr('JZIHGFEDCBA', (2 * CAST(d[1] AS INT) + 7 * CAST(d[2] AS INT) + 6 * CAST(d[3] AS INT) + 5 * CAST(d[4] AS INT) + 4 * CAST(d[5] AS INT) + 3 * CAST(d[6] AS INT) + 2 * CAST(d[7] AS INT)) % 11 + 1, 1) AS letter FROM v
""")
def nric_checkletter(spark, sf):
    d = F.lpad(F.col("c_custkey").cast("string"), 7, "0")
    letters = F.explode(F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"])).alias("letter")
    row = table(spark, sf, "customer").select("c_custkey", d.alias("d"), letters).where(values.nric_valid(F.concat(F.lit("S"), "d", "letter")))
    return row.groupBy("c_custkey").agg(F.count("*").alias("n_valid"), F.min("letter").alias("letter"))


_CARD = r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"
_SQL_LUHN = "list_sum([CASE WHEN i % 2 = 1 THEN (CASE WHEN 2 * CAST(d[i] AS INT) > 9 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END) ELSE CAST(d[i] AS INT) END for i in range(1, 17)]) % 10 = 0"


@query(rf"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{{4}}[ -]?){{3}}[0-9]{{4}}\b')) AS card FROM documents),
    d AS (SELECT doc_id, card, regexp_replace(card, '[^0-9]', '', 'g') AS d FROM m)
    SELECT doc_id, card, {_SQL_LUHN} AS valid, CASE WHEN {_SQL_LUHN} THEN 0.99::DOUBLE ELSE 0.2::DOUBLE END AS confidence FROM d
""")
def luhn_cards(spark, sf):
    d = [x for x in registry.registry() if x.name == "creditcard"]
    row = table(spark, sf, "documents").select("doc_id", F.explode(spans.scan(F.col("text"), d)).alias("s"))
    return row.select("doc_id", F.col("s.match").alias("card"), values.luhn_valid(F.col("s.match")).alias("valid"), F.col("s.confidence").alias("confidence"))


@query(r"""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS ip FROM documents)
    SELECT doc_id, ip, list_bool_and([CAST(x AS INT) <= 255 for x in string_split(ip, '.')]) AS valid FROM m
""")
def ip_valid(spark, sf):
    d = [x for x in registry.registry() if x.name == "ip"]
    row = table(spark, sf, "documents").select("doc_id", F.explode(spans.scan(F.col("text"), d)).alias("s"))
    return row.select("doc_id", F.col("s.match").alias("ip"), values.ipv4_valid(F.col("s.match")).alias("valid"))


# spans


@query(r"""
    WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS ms FROM documents),
    p AS (SELECT doc_id, text, ms, unnest(range(1, len(ms) + 1)) AS k FROM m WHERE len(ms) > 0)
    SELECT doc_id, ms[k] AS match, CAST(length(ms[k]) AS INTEGER) AS width, true AS at_place FROM p
""")
def email_spans(spark, sf):
    d = [x for x in registry.registry() if x.name == "email"]
    row = table(spark, sf, "documents").select("doc_id", "text", F.explode(spans.scan(F.col("text"), d)).alias("s"))
    here = F.substr("text", F.col("s.start"), F.col("s.end") - F.col("s.start") + 1) == F.col("s.match")
    return row.select("doc_id", F.col("s.match").alias("match"), (F.col("s.end") - F.col("s.start") + 1).alias("width"), here.alias("at_place"))


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^0-9])(?:\+?65[ -]?)?[3689][0-9]{3}[ -]?[0-9]{4}($|[^0-9])') AS has_phone FROM documents")
def phone_docs(spark, sf):
    d = [x for x in registry.registry() if x.name == "phone"]
    return table(spark, sf, "documents").select("doc_id", (F.size(spans.scan(F.col("text"), d)) > 0).alias("has_phone"))


_COUNTED = {
    "rule:email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "rule:ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "rule:creditcard": r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b",
    "rule:mrn": r"\b[A-Za-z]{0,3}[0-9]{6,10}\b",
    "rule:date": r"\b(?:[0-3]?[0-9][/-][0-1]?[0-9][/-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[/-][0-1]?[0-9][/-][0-3]?[0-9])\b",
}


def _counts_sql(source: str, column: str) -> str:
    parts = [f"SELECT '{n}' AS detector, CAST(sum(len(regexp_extract_all({column}, '(?i){p}'))) AS BIGINT) AS n FROM {source}" for n, p in _COUNTED.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query(_counts_sql("documents", "text"))
def scan_counts_documents(spark, sf):
    d = [x for x in registry.registry() if f"rule:{x.name}" in _COUNTED]
    return spans.findings(table(spark, sf, "documents"), "doc_id", ["text"], d).groupBy("detector").agg(F.count("*").alias("n"))


@query(_counts_sql("pages", "html"))
def scan_counts_pages(spark, sf):
    d = [x for x in registry.registry() if f"rule:{x.name}" in _COUNTED]
    return spans.findings(table(spark, sf, "pages"), "page_id", ["html"], d).groupBy("detector").agg(F.count("*").alias("n"))


@query()
def findings_documents(spark, sf):
    return spans.findings(table(spark, sf, "documents"), "doc_id", ["text"], registry.registry())


@query()
def redact_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", spans.redact_freetext(F.col("text"), registry.registry()).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL]', 'g') AS text FROM documents")
def redact_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", spans.redact_freetext(F.col("text"), registry.registry(), types=["email"]).alias("text"))


@query(
    """
    SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 20 THEN text
        WHEN doc_id % 3 = 2 THEN text ELSE '[NAME]' || substr(text, 6, 5) || '[ADDRESS]' || substr(text, 18) END AS text
    FROM (SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13) || ' ', '____') AS text FROM documents)
    """
)
def redact_with_spans(spark, sf):
    """Unsure spans of another source: kept where they are marked for review (doc_id % 3 = 0) or over the floor (1), else not."""
    docs = table(spark, sf, "documents").select("doc_id", F.translate("text", "\t\n\r ", "____").alias("text"))
    span = lambda a, z, kind: F.struct(F.lit(a).alias("start"), F.lit(z).alias("end"), F.substring("text", a, z - a + 1).alias("match"), F.lit(kind).alias("type"), F.lit(kind).alias("identifier"))
    each = docs.where("length(text) >= 20").select(F.col("doc_id").alias("row"), F.lit("text").alias("column"), F.explode(F.array(span(1, 5, "name"), span(11, 14, "address"), span(14, 17, "address"))).alias("s"), (F.col("doc_id") % 3).alias("r"))
    found = each.select("row", "column", "s.*", F.lit("other").alias("detector"), F.when(F.col("r") == 1, 0.9).otherwise(0.2).alias("confidence"), (F.col("r") == 0).alias("needs_review"))
    return spans.redact_with_spans(docs, "doc_id", "text", found)


_SPANS_SQL = """
    WITH s AS (SELECT o_custkey AS k, CAST(o_orderkey % 97 + 1 AS INTEGER) AS "start", CAST(o_orderkey % 97 + 1 + o_orderkey % 13 AS INTEGER) AS "end" FROM orders),
    m AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    c AS (SELECT *, sum(CASE WHEN "start" <= reach + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS c FROM m)
    SELECT k, min("start") AS "start", max("end") AS "end" FROM c GROUP BY k, c
"""


def _order_spans(spark, sf) -> DataFrame:
    a = (F.col("o_orderkey") % 97 + 1).cast("int")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), a.alias("start"), (a + F.col("o_orderkey") % 13).cast("int").alias("end"), F.lit("t").alias("type"), F.lit("i").alias("identifier"), F.lit("d").alias("detector"), F.lit("m").alias("match"), F.lit(0.5).alias("confidence"))


@query(_SPANS_SQL)
def merge_overlaps_rows(spark, sf):
    return spans.merge_rows(_order_spans(spark, sf), ["k"]).select("k", "start", "end")


@query(_SPANS_SQL)
def merge_overlaps_arrays(spark, sf):
    one = F.struct("start", "end", "match", "type", "identifier", "detector", "confidence")
    grouped = _order_spans(spark, sf).groupBy("k").agg(F.collect_list(one).alias("s"))
    return grouped.select("k", F.explode(spans.merge(F.col("s"))).alias("m")).select("k", F.col("m.start").alias("start"), F.col("m.end").alias("end"))


@query("""
    WITH f AS (SELECT o_custkey AS "row", 'c' AS "column", lower(o_orderpriority) AS low, o_orderstatus AS type, CAST(o_orderkey % 10 AS DOUBLE) / 10 AS confidence, o_orderkey % 7 = 0 AS needs_review FROM orders)
    SELECT "row", low, type, max(confidence) AS confidence, bool_or(needs_review) AS needs_review FROM f GROUP BY ALL
""")
def findings_dedup(spark, sf):
    raw = table(spark, sf, "orders").select(F.col("o_custkey").alias("row"), F.lit("c").alias("column"), F.col("o_orderpriority").alias("match"), F.col("o_orderstatus").alias("type"), ((F.col("o_orderkey") % 10).cast("double") / 10).alias("confidence"), (F.col("o_orderkey") % 7 == 0).alias("needs_review"), F.col("o_orderkey").alias("start"), F.lit("d").alias("detector"))
    return spans.dedup_findings(raw).select("row", F.lower("match").alias("low"), "type", "confidence", "needs_review")


@query("""
    WITH v AS (SELECT c_custkey, 'S' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || 'A' AS v, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS d FROM customer)
    SELECT c_custkey, v, CASE WHEN substr('JZIHGFEDCBA', (2 * CAST(d[1] AS INT) + 7 * CAST(d[2] AS INT) + 6 * CAST(d[3] AS INT) + 5 * CAST(d[4] AS INT) + 4 * CAST(d[5] AS INT) + 3 * CAST(d[6] AS INT) + 2 * CAST(d[7] AS INT)) % 11 + 1, 1) = 'A' THEN 0.99::DOUBLE ELSE 0.2::DOUBLE END AS nric FROM v
""")
def classify_values(spark, sf):
    v = F.concat(F.lit("S"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"), F.lit("A"))
    row = table(spark, sf, "customer").select("c_custkey", v.alias("v")).withColumn("c", spans.classify(F.col("v"), registry.registry()))
    return row.select("c_custkey", "v", F.filter("c", lambda c: c["detector"] == "nric")[0]["confidence"].alias("nric"))


# dates and generalisers


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y1, strftime(o_orderdate, '%Y') AS y2, strftime(o_orderdate, '%Y-%m') AS m, '[DATE]' AS bad, '[DATE]' AS blank FROM orders")
def generalize_dates(spark, sf):
    d = F.col("o_orderdate")
    g = dates.generalize_date
    return table(spark, sf, "orders").select("o_orderkey", g(F.date_format(d, "yyyy-MM-dd")).alias("y1"), g(F.date_format(d, "dd MMM yyyy")).alias("y2"), g(F.date_format(d, "yyyyMMdd"), "year_month").alias("m"), g(F.lit("soon")).alias("bad"), g(F.lit("")).alias("blank"))


@query("""
    WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT o_orderkey, d AS iso, d AS slashed, CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END AS month_first, d AS compact, d AS named, d AS full_name, d AS tail FROM d
""")
def parse_mixed_dates(spark, sf):
    d, p = F.col("o_orderdate"), dates.parse_date
    made = {"iso": "yyyy-MM-dd", "slashed": "d/M/yyyy", "month_first": "M/d/yyyy", "compact": "yyyyMMdd", "named": "d-MMM-yyyy", "full_name": "MMMM d, yyyy"}
    return table(spark, sf, "orders").select("o_orderkey", *[p(F.date_format(d, f)).alias(n) for n, f in made.items()], p(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" and more"))).alias("tail"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year FROM orders")
def year_of(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dates.year_of(F.date_format("o_orderdate", "'on' dd.MM.yyyy")).alias("year"))


@query("SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN '90+' ELSE CAST(p_size * 2 // 5 * 5 AS VARCHAR) || '-' || CAST(p_size * 2 // 5 * 5 + 4 AS VARCHAR) END AS band FROM part")
def age_band(spark, sf):
    return table(spark, sf, "part").select("p_partkey", values.generalize_age((F.col("p_size") * 2).cast("string")).alias("band"))


@query(r"""
    WITH v AS (SELECT p_partkey, 'Singapore ' || CAST(100000 + p_partkey % 900000 AS VARCHAR) AS v FROM part)
    SELECT p_partkey, 'SECTOR-' || substr(regexp_extract(v, '[0-9]{6}'), 1, 2) AS sector, '[GEO]' AS none, substr(v, 1, length(v) - 3) || 'XXX' AS masked FROM v
""")
def geo_and_postal(spark, sf):
    v = F.concat(F.lit("Singapore "), (F.col("p_partkey") % 900000 + 100000).cast("string"))
    return table(spark, sf, "part").select("p_partkey", values.generalize_geo(v).alias("sector"), values.generalize_geo(F.lit("here")).alias("none"), values.mask_postal(v).alias("masked"))


def _shape_sql(column: str) -> str:
    classes = f"regexp_replace(regexp_replace(regexp_replace({column}, '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g')"
    return f"""list_aggregate(list_transform(list_filter(list_transform(range(1, length({classes}) + 1), lambda i: CASE WHEN i = 1 OR {classes}[i] <> {classes}[i - 1] THEN i END), lambda i: i IS NOT NULL),
        lambda i: CASE WHEN len(regexp_extract(substr({classes}, CAST(i AS BIGINT)), '^(9+|A+|a+| +|#+|[^9Aa #])')) > 1 THEN {classes}[i] || '{{' || len(regexp_extract(substr({classes}, CAST(i AS BIGINT)), '^(9+|A+|a+| +|#+|[^9Aa #])')) || '}}' ELSE {classes}[i] END), 'string_agg', '')"""


@query(f"SELECT c_custkey, {_shape_sql('c_name')} AS shape FROM customer")
def value_shape(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", values.value_shape(F.col("c_name")).alias("shape"))


@query("SELECT event_id, TRY_CAST(trim(CASE WHEN event_id % 3 = 0 THEN 'x' ELSE ' ' || CAST(value AS VARCHAR) END) AS DOUBLE) AS v FROM events")
def lenient_numbers(spark, sf):
    return table(spark, sf, "events").select("event_id", values.number(F.when(F.col("event_id") % 3 == 0, "x").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))).alias("v"))


@query(r"SELECT p_partkey, CASE WHEN regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'table' ELSE regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') END AS slug FROM part")
def slugs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", values.slug(F.col("p_name")).alias("slug"))


# tables under a policy

_POLICY = Policy().set("c_name", "name").set("c_mktsegment", "email").set("c_acctbal", None, "keep")


def _customers(spark, sf) -> transform.Deidentified:
    return transform.deidentify(table(spark, sf, "customer"), _POLICY, KEY)


@query(f"SELECT c_custkey, {_NAME} AS c_name, c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, '[REDACTED]' AS c_mktsegment FROM customer")
def policy_projection(spark, sf):
    # kept as it is; only its text is SQL's, not Java's
    return _customers(spark, sf).data().withColumn("c_acctbal", values.number_text(F.col("c_acctbal").cast("double")))


@query("SELECT 'c_name' AS \"column\", 'name' AS identifier, 'pseudonymize' AS action, count(*) AS n_changed FROM customer UNION ALL SELECT 'c_mktsegment', 'email', 'redact', count(*) FROM customer UNION ALL SELECT 'c_acctbal', NULL, 'keep', 0 FROM (SELECT 1)")
def change_summary(spark, sf):
    return _customers(spark, sf).summary()


@query(f"SELECT DISTINCT 'c_name' AS \"column\", c_name AS original, {_NAME} AS token FROM customer")
def crosswalk_build(spark, sf):
    return _customers(spark, sf).crosswalk()


@query(f"SELECT c_custkey, {_NAME} AS c_name, c_name AS c_name_original FROM customer")
def reidentify_join(spark, sf):
    made = _customers(spark, sf)
    return transform.reidentify(made.data(), made.crosswalk(), "c_name").select("c_custkey", "c_name", "c_name_original")


@query("SELECT DISTINCT 'c' AS \"column\", o_orderstatus AS original, o_orderpriority AS token FROM orders")
def crosswalk_merge(spark, sf):
    row = table(spark, sf, "orders").select(F.lit("c").alias("column"), F.col("o_orderstatus").alias("original"), F.col("o_orderpriority").alias("token"), "o_orderkey")
    return transform.merge_crosswalks(row.where("o_orderkey % 2 = 0").drop("o_orderkey"), row.where("o_orderkey % 3 < 3").drop("o_orderkey"))


# profiles


def _profile_cells(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("user"), F.col("p_partkey").cast("string"), F.lit("@example.com"))).otherwise("lot").alias("lot"))
    return profile.cells(part, "p_partkey")


_LOT = "CASE WHEN p_partkey % 50 = 0 THEN 'user' || CAST(p_partkey AS VARCHAR) || '@example.com' ELSE 'lot' END"


@query(f"SELECT p_partkey AS \"row\", 'lot' AS \"column\", {_LOT} AS value, 'Looks like email but column is mostly non-PII/other' AS reason, 'high' AS severity, 'email' AS identifier FROM part WHERE p_partkey % 50 = 0")
def profile_outliers(spark, sf):
    return profile.outliers(_profile_cells(spark, sf)).where("column = 'lot'")


@query("SELECT 'lot' AS \"column\", count(*) AS total, 'a{3}' AS dominant_shape, sum(CASE WHEN p_partkey % 50 = 0 THEN 0 ELSE 1 END) / count(*) AS shape_share FROM part")
def profile_columns(spark, sf):
    return profile.profile(_profile_cells(spark, sf)).where("column = 'lot'").select("column", "total", "dominant_shape", "shape_share")


@query("SELECT 'p_brand' AS \"column\", p_brand AS value, count(*) AS n FROM part GROUP BY p_brand")
def value_frequencies(spark, sf):
    return _profile_cells(spark, sf).where("column = 'p_brand'").groupBy("column", "value").agg(F.count("*").alias("n"))


@query("SELECT column_name AS \"column\", CASE WHEN contains(column_name, 'name') THEN 'name' END AS identifier FROM (DESCRIBE customer) WHERE column_name <> 'c_custkey'")
def suggest_mapping(spark, sf):
    found = profile.suggest_mapping(table(spark, sf, "customer"), "c_custkey")
    return spark.createDataFrame(sorted(found.items()), "column string, identifier string")


# disclosure

_Q = ["p_brand", "p_type", "p_size"]


@query("WITH g AS (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size) SELECT min(n) AS k_achieved, count(*) AS n_groups, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_unique, CAST(sum(CASE WHEN n < 5 THEN n ELSE 0 END) AS BIGINT) AS n_below_k, sum(CASE WHEN n < 5 THEN n ELSE 0 END) / sum(n) AS frac_below_k FROM g")
def kanon(spark, sf):
    return disclosure.kanon(table(spark, sf, "part"), _Q)


@query("SELECT p_brand, p_type, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) < 5")
def kanon_below(spark, sf):
    return disclosure.group_sizes(table(spark, sf, "part"), _Q).where("n < 5")


@query("WITH g AS (SELECT p_brand, count(DISTINCT p_size) AS l FROM part GROUP BY p_brand) SELECT min(l) AS l_min, avg(l) AS l_mean FROM g")
def ldiversity(spark, sf):
    return disclosure.ldiversity(table(spark, sf, "part"), ["p_brand"], "p_size")


def _share_sql(columns: str) -> str:
    return f"(SELECT sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / sum(n) FROM (SELECT count(*) AS n FROM part GROUP BY {columns}))"


@query(f"SELECT {_share_sql('p_brand, p_type, p_size')} AS \"full\", greatest({_share_sql('p_type, p_size')}, {_share_sql('p_brand, p_size')}, {_share_sql('p_brand, p_type')}) AS leave_one_out")
def sample_uniques(spark, sf):
    return disclosure.sample_uniques(table(spark, sf, "part"), _Q)


@query("WITH g AS (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type, p_size) SELECT count(*) / sum(n) AS mean_risk, 1.0::DOUBLE / min(n) AS max_risk, CAST(count(*) AS DOUBLE) AS sum_risk FROM g")
def individual_risk(spark, sf):
    return disclosure.individual_risk(table(spark, sf, "part"), _Q)


@query("""
    WITH s AS (SELECT p_brand, p_type, CAST(p_size + p_partkey % 2 AS VARCHAR) AS p_size, p_partkey FROM part ORDER BY sha256('1' || chr(1) || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 500),
    r AS (SELECT DISTINCT p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part),
    d AS (SELECT p_partkey, min((CASE WHEN s.p_brand = r.p_brand THEN 0 ELSE 1 END + CASE WHEN s.p_type = r.p_type THEN 0 ELSE 1 END + CASE WHEN s.p_size = r.p_size THEN 0 ELSE 1 END) / 3) AS d FROM s, r GROUP BY p_partkey)
    SELECT min(d) AS min_distance, avg(d) AS mean_distance, avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) AS frac_exact FROM d
""")
def dcr(spark, sf):
    part = table(spark, sf, "part")
    changed = part.withColumn("p_size", (F.col("p_size") + F.col("p_partkey") % 2).cast("string"))
    return disclosure.dcr(changed, part, _Q, ["p_partkey"]).select(*[F.round(c, 9).alias(c) for c in ("min_distance", "mean_distance", "frac_exact")])


SQL["dcr"] = SQL["dcr"].replace("SELECT min(d) AS min_distance, avg(d) AS mean_distance, avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END) AS frac_exact", "SELECT round(min(d), 9) AS min_distance, round(avg(d), 9) AS mean_distance, round(avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 9) AS frac_exact")


@query("WITH g AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT min(n) >= 5 AS passed, min(n) AS k_achieved, 1.0::DOUBLE / min(n) AS max_risk FROM g")
def gate(spark, sf):
    g = disclosure.gate(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 5)
    return spark.createDataFrame([(g["pass"], g["k_achieved"], g["max_risk"])], "passed boolean, k_achieved long, max_risk double")


# treatments


@query("WITH n AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS n FROM part) SELECT p_partkey, CASE WHEN n < 2 THEN NULL ELSE p_brand END AS p_brand, p_type, CASE WHEN n < 2 THEN NULL ELSE p_size END AS p_size FROM n")
def suppress(spark, sf):
    return treatments.suppress(table(spark, sf, "part").select("p_partkey", *_Q), _Q, 2, ["p_brand", "p_size"])


@query("SELECT p_partkey, CASE WHEN p_size >= 1 AND p_size < 10 THEN '[1,10)' WHEN p_size >= 10 AND p_size < 25 THEN '[10,25)' WHEN p_size >= 25 AND p_size <= 50 THEN '[25,50]' END AS p_size, CASE WHEN p_brand = 'Brand#11' THEN 'A' ELSE p_brand END AS p_brand FROM part")
def recode(spark, sf):
    df = treatments.recode(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), "p_size", breaks=[1, 10, 25, 50])
    return treatments.recode(df, "p_brand", mapping={"Brand#11": "A"})


@query("WITH q AS (SELECT quantile_cont(p_retailprice, 0.95) AS hi, quantile_cont(p_retailprice, 0.05) AS lo FROM part) SELECT p_partkey, round(greatest(least(p_retailprice, hi), lo), 6) AS p_retailprice FROM part, q")
def topbottom(spark, sf):
    df = treatments.topbottom(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", top_pct=0.05, bottom_pct=0.05)
    return df.withColumn("p_retailprice", F.round("p_retailprice", 6))


@query("""
    WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS k, count(*) OVER () AS n FROM customer),
    g AS (SELECT *, least((k - 1) // 3, greatest(n // 3 - 1, 0)) AS g FROM r)
    SELECT c_custkey, round(avg(c_acctbal) OVER (PARTITION BY g), 6) AS c_acctbal FROM g
""")
def microaggregate(spark, sf):
    df = treatments.microaggregate(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"], 3)
    return df.withColumn("c_acctbal", F.round("c_acctbal", 6))


def _sql_uniform(seed: int, *parts: str) -> str:
    text = " || chr(1) || ".join([f"'{seed}'", *parts])
    return f"(CAST('0x' || substr(sha256({text}), 1, 13) AS BIGINT) / {float(16**13)!r})"


@query(f"""
    WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY p_brand),
    s AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS hi, (sum(n) OVER (ORDER BY v) - n) / sum(n) OVER () AS lo FROM c),
    d AS (SELECT p_partkey, p_brand, {_sql_uniform(5, 'CAST(p_partkey AS VARCHAR)', "'p_brand:keep'")} AS a, {_sql_uniform(5, 'CAST(p_partkey AS VARCHAR)', "'p_brand:draw'")} AS b FROM part)
    SELECT p_partkey, CASE WHEN a >= 0.8 THEN v ELSE p_brand END AS p_brand FROM d JOIN s ON b >= lo AND b < hi
""")
def pram(spark, sf):
    return treatments.pram(table(spark, sf, "part").select("p_partkey", "p_brand"), "p_partkey", "p_brand", 0.8, 5)


@query(f"WITH s AS (SELECT stddev_samp(p_retailprice) * 0.1 AS scale FROM part), d AS (SELECT p_partkey, p_retailprice, {_sql_uniform(3, 'CAST(p_partkey AS VARCHAR)', chr(39) + 'p_retailprice:noise' + chr(39))} - 0.5 AS u FROM part) SELECT p_partkey, round(p_retailprice - scale * sign(u) * ln(greatest(1 - 2 * abs(u), 1e-300)), 5) AS p_retailprice FROM d, s")
def noise_laplace(spark, sf):
    df = treatments.noise(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey", ["p_retailprice"], "laplace", seed=3)
    return df.withColumn("p_retailprice", F.round("p_retailprice", 5))


@query(f"WITH s AS (SELECT stddev_samp(p_retailprice) * 0.1 AS scale FROM part), d AS (SELECT p_partkey, p_retailprice, {_sql_uniform(3, 'CAST(p_partkey AS VARCHAR)', chr(39) + 'p_retailprice:noise' + chr(39))} AS u, {_sql_uniform(3, 'CAST(p_partkey AS VARCHAR)', chr(39) + 'p_retailprice:angle' + chr(39))} AS w FROM part) SELECT p_partkey, round(p_retailprice + sqrt(-2 * ln(1 - u)) * cos(2 * pi() * w) * scale, 5) AS p_retailprice FROM d, s")
def noise_gaussian(spark, sf):
    df = treatments.noise(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_partkey", ["p_retailprice"], seed=3)
    return df.withColumn("p_retailprice", F.round("p_retailprice", 5))


@query(f"WITH r AS (SELECT p_type AS v, row_number() OVER (ORDER BY p_type, p_partkey) AS k, count(*) OVER () AS n FROM part), d AS (SELECT p_partkey, CAST(floor({_sql_uniform(2, 'CAST(p_partkey AS VARCHAR)', chr(39) + 'p_type:synth' + chr(39))} * (SELECT count(*) FROM part)) AS BIGINT) + 1 AS k FROM part) SELECT p_partkey, v AS p_type FROM d JOIN r USING (k)")
def synth_marginal(spark, sf):
    return treatments.synth_marginal(table(spark, sf, "part").select("p_partkey", "p_type"), "p_partkey", ["p_type"], 2)


@query("WITH n AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part), s AS (SELECT p_partkey, CASE WHEN n < 3 THEN NULL ELSE p_brand END AS p_brand, CASE WHEN n < 3 THEN NULL ELSE p_size END AS p_size FROM n) SELECT p_partkey, p_brand, CASE WHEN p_size < 25 THEN 'small' WHEN p_size <= 50 THEN 'large' END AS p_size FROM s")
def treatment_steps(spark, sf):
    steps = [("suppress", {"quasi": ["p_brand", "p_size"], "k": 3}), ("unknown", {}), ("recode", {"col": "p_size", "breaks": [0, 25, 50], "labels": ["small", "large"]})]
    return treatments.apply_steps(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey", steps)[0]


# rows


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_id FROM orders")
def row_ids(spark, sf):
    return ranks.dense_position(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], "row_id").select("o_orderkey", "row_id")


@query("SELECT o_orderkey, row_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders) WHERE row_id BETWEEN 101 AND 350")
def window_read(spark, sf):
    return tables.read_window(tables.with_row_id(table(spark, sf, "orders").select("o_orderkey"), order=["o_orderkey"]), 101, 250)


@query("SELECT o_orderkey, row_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_id FROM orders) WHERE row_id BETWEEN 11 AND 20 OR row_id BETWEEN 501 AND 530")
def block_read(spark, sf):
    return tables.read_blocks(tables.with_row_id(table(spark, sf, "orders").select("o_orderkey"), order=["o_orderkey"]), [(11, 10), (501, 30)])


@query("SELECT 1000::INTEGER AS n, true AS whole_blocks")
def block_sample(spark, sf):
    orders = tables.with_row_id(table(spark, sf, "orders").select("o_orderkey"), order=["o_orderkey"])
    got = tables.sample_table(orders, orders.count(), 1000, 100, 7).withColumn("b", F.expr("(row_id - 1) div 100")).groupBy("b").agg(F.count("*").alias("n"))
    return got.agg(F.sum("n").cast("int").alias("n"), F.min(F.col("n") == 100).alias("whole_blocks"))


# tuning


def _gold(spark, sf) -> DataFrame:
    """Known values of a text table: its own e-mail addresses, and some that it lacks."""
    docs = table(spark, sf, "documents")
    real = docs.select("doc_id", F.explode(spans.scan(F.col("text"), [d for d in registry.registry() if d.name == "email"])).alias("s")).select(F.lit("text").alias("column"), F.upper("s.match").alias("value"), F.lit("email").alias("identifier"))
    fake = docs.select(F.lit("text").alias("column"), F.concat(F.lit("nobody-"), F.col("doc_id").cast("string")).alias("value"), F.lit("name").alias("identifier"))
    return real.unionByName(fake)


_EMAIL_SQL = r"(SELECT unnest(regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS v FROM documents)"


@query(f"SELECT 'email' AS identifier, count(*) AS n, count(*) AS hit, 1.0::DOUBLE AS recall FROM {_EMAIL_SQL} UNION ALL SELECT 'name', count(*), 0, 0.0::DOUBLE FROM documents")
def gold_recall(spark, sf):
    return tuning.gold_recall(tuning.gold_coverage(_gold(spark, sf), tuning.caught_values(table(spark, sf, "documents"), ["text"], registry.registry())))


def _misses(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    kind = k % 5
    value = F.when(kind == 0, "a@example.com").when(kind == 1, F.concat(F.lit("A"), F.lpad(k.cast("string"), 6, "0"))).when(kind == 2, "Widget").when(kind == 3, F.concat(F.lit("once-"), k.cast("string"))).otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@example.com")))
    ident = F.when(kind.isin(0), "email").when(kind == 1, "national_id").otherwise("name")
    return table(spark, sf, "customer").select(value.alias("value"), ident.alias("identifier"), F.lit("notes").alias("column"), k.alias("row"))


@query("SELECT CASE c_custkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'national_id' ELSE 'name' END AS identifier, CASE c_custkey % 5 WHEN 0 THEN 'wrong_column' WHEN 1 THEN 'below_threshold' WHEN 2 THEN 'known_value' WHEN 3 THEN 'no_pattern' ELSE 'detector_off' END AS why_missed, count(*) AS n FROM customer GROUP BY ALL")
def diagnose_misses(spark, sf):
    return tuning.diagnose(_misses(spark, sf)).groupBy("identifier", "why_missed").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'national_id' ELSE 'name' END AS identifier, CASE c_custkey % 5 WHEN 0 THEN 'column_enable' WHEN 1 THEN 'threshold' WHEN 2 THEN 'watchlist' WHEN 3 THEN 'watchlist' ELSE 'column_enable' END AS lever, CASE c_custkey % 5 WHEN 0 THEN 'wrong_column' WHEN 1 THEN 'below_threshold' WHEN 2 THEN 'known_value' WHEN 3 THEN 'no_pattern' ELSE 'detector_off' END AS cause, count(*) AS support FROM customer GROUP BY ALL)")
def suggest_tunings(spark, sf):
    found = tuning.suggest(_misses(spark, sf))
    return spark.createDataFrame([(s["identifier"], s["lever"], s["cause"], s["support"]) for s in found], "identifier string, lever string, cause string, support long")


@query(f"SELECT (SELECT count(*) FROM {_EMAIL_SQL}) AS new_detections, (SELECT count(*) FROM {_EMAIL_SQL}) AS false_positives")
def tuning_safety(spark, sf):
    delta = {"lever": "learned_regex", "identifier": "device", "pattern": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9]"}
    return tuning.safety(table(spark, sf, "documents"), ["text"], delta)


# documents


_XML_NAME, _XML_ID = _sql_token("c_name", "NAME", "name"), _sql_token("CAST(c_custkey AS VARCHAR)", "MRN", "mrn")


@query(f"""
    SELECT CAST(c_custkey AS VARCHAR) AS path, 'muse' AS profile, 4::INTEGER AS n_changes, true AS waveform_ok,
        '<restingecg><PatientID>' || {_XML_ID} || '</PatientID><PatientLastName>' || {_XML_NAME} || '</PatientLastName><DateofBirth>1960</DateofBirth><note>call [REDACTED]</note><Waveform>91234567</Waveform></restingecg>' AS xml
    FROM customer
""")
def xml_scrub(spark, sf):
    c = table(spark, sf, "customer")
    xml = F.concat(F.lit("<restingecg><PatientID>"), F.col("c_custkey").cast("string"), F.lit("</PatientID><PatientLastName>"), "c_name", F.lit("</PatientLastName><DateofBirth>12-31-1960</DateofBirth><note>call 91234567</note><Waveform>91234567</Waveform></restingecg>"))
    return documents.scrub_table(c.select(F.col("c_custkey").cast("string").alias("path"), xml.alias("xml")), KEY).select("path", "xml", "profile", "n_changes", "waveform_ok")


_WORDS_SQL = "SELECT o_custkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS word_idx, CASE WHEN o_orderkey % 5 = 0 THEN 'a' || CAST(o_orderkey AS VARCHAR) || '@example.com' ELSE o_orderstatus END AS text FROM orders"


@query(f"SELECT doc, CAST(word_idx AS INTEGER) AS word_idx, text, 'email' AS type FROM ({_WORDS_SQL}) WHERE text LIKE '%@%'")
def word_boxes(spark, sf):
    from pyspark.sql.window import Window

    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("a"), F.col("o_orderkey").cast("string"), F.lit("@example.com"))).otherwise(F.col("o_orderstatus"))
    w = o.select(F.col("o_custkey").alias("doc"), F.lit(1).alias("page"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("word_idx"), text.alias("text"), *[F.lit(1.0).alias(c) for c in ("left", "top", "width", "height")])
    return documents.pii_boxes(w, [d for d in registry.registry() if d.name == "email"]).select("doc", "word_idx", "text", "type")


@query("SELECT p_partkey, p_size * 150 / 72.0 AS \"left\", 150 / 72.0 AS top, 150 / 72.0 AS width, 150 / 72.0 AS height FROM part")
def digital_boxes(spark, sf):
    return documents.digital_boxes(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("left"), *[F.lit(1.0).alias(c) for c in ("top", "width", "height")]), 150)


# sources outside the rules


@query(r"SELECT CAST(doc_id AS BIGINT) AS row, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'the')) FROM documents) GROUP BY doc_id")
def plugin_source(spark, sf):
    def the(rows, texts):
        import re

        return [{"row": r, "start": m.start() + 1, "end": m.end(), "match": m[0], "type": "other", "identifier": "other_id", "detector": "word", "confidence": 0.6} for r, t in zip(rows, texts, strict=True) for m in re.finditer("the", t)]

    return plugins.run_source(table(spark, sf, "documents"), "doc_id", ["text"], the).groupBy("row").agg(F.count("*").alias("n"))


# audit


def _audit_logs(spark, sf) -> DataFrame:
    """Every customer as an entry of a log; a log has the entries of 50 consecutive keys."""
    from .control.audit import GENESIS

    log = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 50).alias("log"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("payload"))
    # a chain is built one entry after the other
    chain = F.aggregate(F.sort_array(F.collect_list(F.struct("seq", "payload"))), F.array().cast("array<struct<seq:bigint,payload:string,prev_hash:string,hash:string>>"), lambda acc, x: F.concat(acc, F.transform(F.array(F.coalesce(F.try_element_at(acc, F.lit(-1))["hash"], F.lit(GENESIS))), lambda p: F.struct(x["seq"].alias("seq"), x["payload"].alias("payload"), p.alias("prev_hash"), F.sha2(F.concat_ws("|", p, x["payload"]), 256).alias("hash")))))
    return log.groupBy("log").agg(chain.alias("c")).select("log", F.explode("c").alias("e")).select("log", "e.*")


@query("SELECT count(*) AS broken FROM (SELECT 1) WHERE false")
def audit_chain_verify(spark, sf):
    from .control.audit import verify_chain

    return verify_chain(_audit_logs(spark, sf), ["log"]).agg(F.count("*").alias("broken"))


@query("SELECT event_type AS action, count(*) AS n FROM events GROUP BY event_type")
def action_counts(spark, sf):
    from .control.audit import action_counts as counts

    return counts(table(spark, sf, "events").select(F.col("event_type").alias("action")))


# streams


@query(f"SELECT c_custkey, {_NAME} AS c_name FROM customer")
def streamed_policy(spark, sf):
    from .streaming.deid import transform_stream

    source = table(spark, sf, "customer").select("c_custkey", "c_name")
    stream = spark.readStream.schema(table(spark, sf, "customer").schema).option("pathGlobFilter", "customer.parquet").parquet(sf).select("c_custkey", "c_name")
    where = staging.fresh_path(spark, "streamed")
    made = transform_stream(stream, Policy().set("c_name", "name"), KEY)
    made.writeStream.format("parquet").option("path", f"{where}/data").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{where}/data").select(*source.columns)
