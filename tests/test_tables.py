import io
import json
import os

import pytest
from pyspark.sql import functions as F

from maskwell.control import audit, runs
from maskwell.control.project import Project, file_manifest, keypair, sign, verify
from maskwell.operators import disclosure, documents, ranks, transform, treatments, tuning
from maskwell.plans.policy import Policy
from maskwell.sources import tables
from maskwell.streaming import deid

KEY = b"k" * 32


@pytest.fixture
def patients(spark):
    rows = [(k, f"Name {k % 7}", f"S{k:07d}A", f"{k % 28 + 1:02d}/03/1950", f"{520000 + k}", f"call 9123 45{k:02d} or u{k}@example.com", None if k == 3 else str(20 + k)) for k in range(1, 31)]
    return spark.createDataFrame(rows, "row_id long, patient_name string, nric string, dob string, postal string, notes string, age string").repartition(3)


def policy():
    return Policy().set("patient_name", "name").set("nric", "national_id", "fpe").set("dob", "dob").set("postal", "postal_code").set("notes", "other_id", "redact_freetext").set("age", None, "generalize", method="age")


def test_deidentify(patients):
    made = transform.deidentify(patients, policy(), KEY)
    rows = {r["row_id"]: r for r in made.data().collect()}
    assert made.data().columns == patients.columns and len(rows) == 30
    r = rows[4]
    assert r["patient_name"].startswith("NAM-") and r["dob"] == "1950" and r["postal"] == "520XXX" and r["notes"] == "call [PHONE] or [EMAIL]" and r["age"] == "20-24" and len(r["nric"]) == 9
    counts = {s["column"]: s["n_changed"] for s in made.summary().collect()}
    assert counts == {"patient_name": 30, "nric": 30, "dob": 30, "postal": 30, "notes": 30, "age": 29}
    walk = made.crosswalk()
    assert walk.where("column = 'patient_name'").count() == 7 and {r["column"] for r in walk.collect()} == {"patient_name", "nric"}
    back = transform.reidentify(made.data(), walk, "nric").join(patients.select("row_id", F.col("nric").alias("was")), "row_id")
    assert back.where("nric_original = was").count() == 30
    sealed = transform.seal_crosswalk(walk, KEY)
    assert transform.open_crosswalk(sealed, KEY).exceptAll(walk).count() == 0
    with pytest.raises(Exception):
        transform.open_crosswalk(sealed, b"x" * 32).collect()
    assert transform.deidentify(patients.limit(0), policy(), KEY).data().count() == 0
    with pytest.raises(ValueError):
        transform.deidentify(patients, policy(), None)
    assert Policy.from_json(policy().to_json()).to_json() == policy().to_json()


def test_fpe_falls_back(spark):
    df = spark.createDataFrame([("1" * 30,), ("12",), (None,)], "v string")
    got = [r[0] for r in transform.deidentify(df, Policy().set("v", "mrn", "fpe", mode="digits"), KEY).data().collect()]
    assert got[0].startswith("ID-") and len(got[1]) == 2 and got[2] is None


def test_merged_crosswalks_keep_all_pairs(spark):
    a = spark.createDataFrame([("d", "x", "1"), ("d", "x", "2")], "column string, original string, token string")
    assert transform.merge_crosswalks(a, a).count() == 2


def test_disclosure(spark):
    rows = [("a", 1, "p"), ("a", 1, "q"), ("a", 1, None), ("b", 1, "p"), (None, 1, "p"), (None, 1, "p")]
    df = spark.createDataFrame(rows, "x string, y int, s string")
    k = disclosure.kanon(df, ["x", "y", "zzz"], 2).first()
    assert (k["k_achieved"], k["n_groups"], k["n_unique"], k["n_below_k"]) == (1, 3, 1, 1) and disclosure.kanon(df, ["zzz"]) is None
    assert tuple(disclosure.ldiversity(df, ["x"], "s").first()) == (1, pytest.approx(5 / 3))
    u = disclosure.sample_uniques(df, ["x", "y"]).first()
    assert u["full"] == pytest.approx(1 / 6) and u["leave_one_out"] == pytest.approx(1 / 6)
    assert disclosure.sample_uniques(df, ["x"]).first()["leave_one_out"] is None
    r = disclosure.individual_risk(df, ["x"]).first()
    assert r["max_risk"] == 1.0 and r["mean_risk"] == pytest.approx(0.5) and r["sum_risk"] == 3
    same = disclosure.dcr(df, df, ["x", "s"], ["x", "s"]).first()
    assert (same["min_distance"], same["frac_exact"]) == (0.0, 1.0)
    assert not disclosure.gate(df, ["x"], 100)["pass"] and disclosure.gate(df, ["x"], 1)["pass"] and not disclosure.gate(df, ["x"], 1, 0.5)["pass"]
    assert disclosure.kanon(df.limit(0), ["x"]).first()["k_achieved"] is None


def test_treatments(spark):
    df = spark.createDataFrame([(k, ["a", "b", None][k % 3], str(k), float(k)) for k in range(1, 12)], "id long, g string, n string, v double")
    s = treatments.suppress(df, ["g", "n"], 2)
    assert s.where("g is null and n is null").count() == 11 and s.count() == 11
    assert treatments.suppress(df, ["g"], 4, ["g"]).where("g is not null").count() == 4 and treatments.suppress(df, ["zz"], 4).count() == 11
    bands = [r["n"] for r in treatments.recode(df, "n", breaks=[1, 5, 10]).orderBy("id").collect()]
    assert bands == ["[1,5)"] * 4 + ["[5,10]"] * 6 + [None]
    assert [r["g"] for r in treatments.recode(df, "g", mapping={"a": "z"}).orderBy("id").limit(3).collect()] == ["b", None, "z"]
    t = [r["v"] for r in treatments.topbottom(df, "v", top=9, bottom_pct=0.1).orderBy("id").collect()]
    assert max(t) == 9 and min(t) == 2.0
    m = [r["n"] for r in treatments.microaggregate(df, "id", ["n"], 3).orderBy("id").collect()]
    assert m == [2.0] * 3 + [5.0] * 3 + [9.0] * 5 or m == [2.0] * 3 + [5.0] * 3 + [9.0] * 5
    med = [r["v"] for r in treatments.microaggregate(df, "id", ["v"], 4, "median").orderBy("id").collect()]
    assert med == [2.0] * 4 + [8.0] * 7 or len(set(med)) == 2
    for f in (lambda d: treatments.pram(d, "id", "g", 0.2, 9), lambda d: treatments.noise(d, "id", ["v"], "laplace", epsilon=1.0), lambda d: treatments.noise(d, "id", ["v"]), lambda d: treatments.synth_marginal(d, "id", ["g"])):
        a, b = (sorted(map(tuple, f(d).collect()), key=repr) for d in (df, df.repartition(5)))
        assert a == b and len(a) == 11
    assert treatments.synth_marginal(df, "id", ["g"]).where("g is null").count() == 0
    assert treatments.pram(df, "id", "g", 0.0).where("g is null").count() == df.where("g is null").count()
    few, treatments.FEW = treatments.FEW, 1
    try:
        far = treatments.pram(df, "id", "g", 0.3, 4).collect()
    finally:
        treatments.FEW = few
    assert sorted(map(tuple, far), key=repr) == sorted(map(tuple, treatments.pram(df, "id", "g", 0.3, 4).collect()), key=repr)
    out, log = treatments.apply_steps(df, "id", [("noise", {"cols": ["v"]}), ("nope", {})])
    assert out.count() == 11 and log[1].startswith("(skipped")
    assert {r["column"]: r["n_changed"] for r in treatments.count_changes(df, treatments.recode(df, "g", mapping={"a": "z"}), "id", ["g", "n"]).collect()} == {"g": 3, "n": 0}
    empty = df.limit(0)
    for f in (lambda d: treatments.suppress(d, ["g"]), lambda d: treatments.topbottom(d, "v", top_pct=0.1), lambda d: treatments.microaggregate(d, "id", ["v"]), lambda d: treatments.pram(d, "id", "g"), lambda d: treatments.noise(d, "id", ["v"]), lambda d: treatments.synth_marginal(d, "id", ["g"])):
        assert f(empty).count() == 0


def test_positions(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(9)
    got = ranks.dense_position(df, ["v"], "k", 6).collect()
    assert all(r["k"] == r["v"] + 1 for r in got)


def test_table_sources(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,note,x\n1,"two\nlines, ""q""",NA\n2,,5\n')
    df = tables.read_csv(spark, str(p))
    assert [tuple(r) for r in df.collect()] == [("1", 'two\nlines, "q"', None), ("2", "", "5")]
    assert [r["x"] for r in tables.read_csv(spark, str(p), null_value=None).collect()] == ["NA", "5"]
    assert not tables.newline_safe(str(p))
    n = tables.with_row_id(spark.range(100).repartition(7).select("id"))
    assert sorted(r["row_id"] for r in n.collect()) == list(range(1, 101))
    ordered = tables.with_row_id(spark.range(100), order=["id"])
    assert [r["id"] for r in tables.read_window(ordered, 5, 3).orderBy("id").collect()] == [4, 5, 6]
    assert tables.read_window(ordered, 500, 3).count() == 0 and tables.read_window(ordered, -5, 2).count() == 2
    assert tables.read_blocks(ordered, [(1, 2), (99, 5)]).count() == 4 and tables.read_blocks(ordered, []).count() == 0
    assert tables.sample_blocks(100, 1000) == [(1, 100)] and tables.sample_blocks(0) == []
    b = tables.sample_blocks(1050, 300, 100, 4)
    assert len(b) == 3 and b == tables.sample_blocks(1050, 300, 100, 4) and all(s + n - 1 <= 1000 for s, n in b)
    assert tables.plan_chunks(0) == [tables.Chunk(1, 1, 0)] and [c.n for c in tables.plan_chunks(101, 50)] == [50, 50, 1]
    assert tables.plan_files([str(tmp_path), str(p)]) == [(str(p), "table")] and tables.file_type("x.PDF") == "pdf"
    tables.write_csv(ordered.withColumn("e", F.lit(None).cast("string")), str(tmp_path / "out"), "row_id")
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 100


XML = {
    "philips": '<restingecgdata xmlns="http://www3.medical.philips.com"><patient><name><firstname>Ann</firstname></name><patientid>S1234567D</patientid><dateofbirth>1960-01-02</dateofbirth></patient><dataacquisition date="2020-02-03" time="10:00"/><waveforms><w>91234567</w></waveforms><note>91234567</note></restingecgdata>',
    "cda": '<ClinicalDocument xmlns="urn:hl7-org:v3"><recordTarget><patientRole><id extension="S7654321A"/><addr><postalCode>169609</postalCode></addr><telecom value="tel:1"/><patient><name><given>Bo</given></name><birthTime value="19700101"/></patient></patientRole></recordTarget></ClinicalDocument>',
    "fhir": '<Patient xmlns="http://hl7.org/fhir"><identifier><value value="S5551234Z"/></identifier><name><family value="Lee"/></name><birthDate value="1980-05-06"/></Patient>',
    "generic": "<note><b>mail a@b.co S2345678B at Singapore 521123</b></note>",
}


def test_xml(spark):
    df = spark.createDataFrame([*XML.items(), ("broken", "<a>"), ("none", None)], "path string, xml string")
    got = {r["path"]: r for r in documents.scrub_table(df, KEY).collect()}
    for p in XML:
        assert got[p]["profile"] == p and got[p]["waveform_ok"] and got[p]["n_changes"] == len(got[p]["changes"])
    x = got["philips"]["xml"]
    assert "Ann" not in x and "NAME-" in x and ">1960<" in x and 'date="2020"' in x and x.count("91234567") == 1
    assert "S7654321A" not in got["cda"]["xml"] and "169XXX" in got["cda"]["xml"] and "Lee" not in got["fhir"]["xml"]
    assert "a@b.co" not in got["generic"]["xml"] and "521XXX" in got["generic"]["xml"]
    assert got["broken"]["xml"] is None and got["broken"]["error"] and got["none"]["error"]
    assert documents.scrub_xml(XML["generic"], KEY, sweep=False)["n_changes"] == 0
    assert "Lee" in documents.scrub_xml(XML["fhir"], KEY, actions={"name": "keep"})["xml"]


def test_word_boxes(spark):
    words = "Patient S1234567D wrote to a@b.co from home".split()
    df = spark.createDataFrame([("d", 1, k, w, 1.0 * k, 0.0, 9.0, 9.0) for k, w in enumerate(words)], "doc string, page int, word_idx int, text string, left double, top double, width double, height double")
    got = {(r["word_idx"], r["type"]) for r in documents.pii_boxes(df).collect()}
    assert {(1, "nric"), (4, "email")} <= got and not any(k in (0, 2, 3, 5, 6) for k, _ in got)
    b = documents.ocr_boxes(spark.createDataFrame([("1,2,5,9",)], "bbox string")).first()
    assert tuple(b) == (1.0, 2.0, 4.0, 7.0)


def test_tuning(spark):
    rows = [("S1234567D", "national_id"), ("Bob", "name"), ("bob", "name"), ("Zoe", "name"), ("a@b.co", "name"), ("A123456", "national_id")]
    misses = spark.createDataFrame([(v, i, "notes", k) for k, (v, i) in enumerate(rows)], "value string, identifier string, column string, row long")
    got = {r["value"]: r["why_missed"] for r in tuning.diagnose(misses).collect()}
    assert got == {"S1234567D": "wrong_column", "Bob": "known_value", "bob": "known_value", "Zoe": "no_pattern", "a@b.co": "detector_off", "A123456": "below_threshold"}
    found = tuning.suggest(misses, Policy(), spark.createDataFrame([("Bob met bob",), ("A123456",)], "t string"))
    levers = {(s["cause"], s["lever"]): s for s in found}
    assert levers["known_value", "watchlist"]["new_detections"] == 2 and ("below_threshold", "threshold") in levers and found[0]["support"] == 2
    p = tuning.apply(tuning.apply(Policy(), levers["known_value", "watchlist"]), levers["below_threshold", "threshold"])
    assert p.version == 3 and p.conf_overrides == {"national_id": 0.35 if False else p.conf_overrides["national_id"]} and ("name", "Bob") in p.watchlist
    assert tuning.revert(p).conf_overrides == {} and tuning.revert(tuning.revert(p)).watchlist == []
    shared = tuning.promote(p, found)
    assert all(x["lever"] != "watchlist" for x in shared) and tuning.from_register(shared, ["zzz"]) == []
    g = tuning.generalize(["AB12", "CD34"])
    assert g["pattern"] == r"\b[A-Za-z]{2}[0-9]{2}\b" and tuning.generalize(["A1", "12"]) is None and tuning.generalize([]) is None
    assert tuning.generalize(["AB12"], ["XY99", "AB12", "zz", "yy", "q"]) is None and tuning.generalize(["AB12"], ["AB12", "zz", "yy"])["false_positives"] == 0
    gold = spark.createDataFrame([("A@B.co", "email", "t"), ("nobody", "name", "t")], "value string, identifier string, column string")
    from maskwell.plans.detectors import registry

    text = spark.createDataFrame([(1, "write a@b.co")], "id long, t string")
    rec = {r["identifier"]: r["recall"] for r in tuning.gold_recall(tuning.gold_coverage(gold, tuning.caught_values(text, ["t"], registry()))).collect()}
    assert rec == {"email": 1.0, "name": 0.0}
    from maskwell.operators.spans import findings

    assert {r["identifier"]: r["hit"] for r in tuning.gold_recall_strict(gold, findings(text, "id", ["t"], registry())).collect()} == {"email": 1, "name": 0}
    fb = spark.createDataFrame([tuple([None] * 5 + [1, None, None, "v", "name", None, None, None])], tuning.FEEDBACK)
    assert tuning.open_store(tuning.seal_store(fb, KEY, "feedback"), KEY, "feedback").first()["value"] == "v"


def test_audit(tmp_path, spark):
    path = str(tmp_path / "a.jsonl")
    for k in range(3):
        audit.append(path, f"step{k}", "me", {"k": k, "é": "ü"})
    assert audit.verify(path) == {"ok": True, "n": 3, "first_bad": None} and audit.tip(path) == audit.read(path)[-1]["hash"]
    lines = open(path).read().splitlines()
    lines[1] = lines[1].replace("step1", "stepX")
    open(path, "w").write("\n".join(lines) + "\n")
    assert audit.verify(path)["first_bad"] == 2
    assert audit.verify(str(tmp_path / "none"))["ok"] and audit.tip(str(tmp_path / "none")) == audit.GENESIS


def test_project_and_batch(tmp_path, spark):
    p = Project.create(str(tmp_path / "p"), "demo", "me")
    p.policy.set("patient_name", "name")
    p.save()
    src = tmp_path / "in"
    src.mkdir()
    (src / "t.csv").write_text("patient_name,notes,dob\nAnn,call 91234567,01/02/1950\nBob,,02/02/1950\n")
    (src / "g.xml").write_text(XML["generic"])
    (src / "bad.xml").write_text("<a>")
    (src / "x.bin").write_text("?")
    got = {i["file"].rsplit("/", 1)[1]: i for i in runs.run_batch(spark, p, str(src), "me", force_detectors=True)}
    assert {k: v["status"] for k, v in got.items()} == {"t.csv": "ok", "g.xml": "ok", "bad.xml": "error", "x.bin": "skipped"}
    out = tables.read_csv(spark, got["t.csv"]["output"]).collect()
    assert out[0]["patient_name"].startswith("NAM-") and out[0]["notes"] == "call [PHONE]" and out[0]["dob"] == "01/02/1950"
    assert transform.open_crosswalk(spark.read.parquet(got["t.csv"]["output"] + ".crosswalk"), p.key()).count() == 2
    again = {i["file"].rsplit("/", 1)[1]: i["status"] for i in runs.run_batch(spark, p, str(src), "me")}
    assert again["t.csv"] == "skipped" and p.key() == p.key() and len(p.key()) == 32
    private, public = keypair(spark)
    with pytest.raises(PermissionError):
        p.advance("detected", "me", "viewer")
    for stage in ("detected", "deidentified", "reviewed"):
        p.advance(stage, "me", "admin")
    p.sign(spark, "me", private, public)
    cert = p.certificate(spark)
    assert cert["signatures_valid"] == [True] and cert["audit"]["ok"] and cert["stage"] == "reviewed"
    assert not verify(spark, public, b"other", sign(spark, private, b"this")) and not verify(spark, public, b"x", b"short")
    names = p.export(str(tmp_path / "b.zip"))
    assert not any("keys" in n for n in names)
    assert Project.unpack(str(tmp_path / "b.zip"), str(tmp_path / "q")).policy.columns["patient_name"].action == "pseudonymize"
    assert file_manifest(spark, str(src)).count() == 4
    shift = runs.batch_policy(Policy().set("dob", "dob").set("patient_name", "name"), ["dob"], date_shift={"window": 10})
    assert shift.columns["dob"].options["method"] == "date_shift" and shift.columns["patient_name"].action == "pseudonymize"


def test_chunked_runs_resume(tmp_path, spark, patients):
    folder, seen = str(tmp_path / "run"), []
    first = runs.run_chunked(patients, policy(), KEY, folder, "s", 7, progress=lambda a, b: seen.append((a, b))).orderBy("row_id").collect()
    assert seen[-1] == (5, 5) and runs.status(folder) == {"done": 5, "chunks": 5, "complete": True}
    assert first == transform.deidentify(patients, policy(), KEY).data().orderBy("row_id").collect()
    import shutil

    shutil.rmtree(os.path.join(folder, "chunk=000003"))
    stamp = os.path.getmtime(os.path.join(folder, "chunk=000002", "data", "_SUCCESS"))
    assert runs.run_chunked(patients, policy(), KEY, folder, "s", 7).orderBy("row_id").collect() == first
    assert os.path.getmtime(os.path.join(folder, "chunk=000002", "data", "_SUCCESS")) == stamp
    assert {r["column"]: r["n_changed"] for r in runs.summary(spark, folder).collect()}["patient_name"] == 30 and runs.crosswalk(spark, folder).count() == 37
    other = runs.run_chunked(patients, policy(), b"n" * 32, folder, "s", 7).orderBy("row_id").collect()
    assert other != first and runs.status(str(tmp_path / "none"))["complete"] is False


def test_streams_equal_batches(tmp_path, spark, patients):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    patients.write.parquet(src)
    stream = spark.readStream.schema(patients.schema).parquet(src)
    deid.write_stream(stream, policy(), KEY, out, str(tmp_path / "ck")).awaitTermination()
    want = transform.deidentify(patients, policy(), KEY).data()
    assert sorted(map(tuple, spark.read.parquet(out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    released, held = [], []
    deid.gated_stream(stream, policy(), KEY, ["dob"], 5, lambda d, n: released.append(d.count()), lambda d, n, v: held.append(v), str(tmp_path / "ck2")).awaitTermination()
    assert released == [30] and held == []


def test_entry_contract(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and e.entry(spark).count() > 0
    json.dumps(sorted(names))


def test_audit_logs_hold_every_customer(spark):
    from maskwell import queries
    from maskwell.control.audit import verify_chain

    sf = "/root/testdata/sf0.001"
    entries = queries._audit_logs(spark, sf).cache()
    keys = sorted(r["c_custkey"] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect())
    assert len(keys) > 50 and sorted(r["seq"] for r in entries.collect()) == keys
    assert verify_chain(entries, ["log"]).count() == 0
    last = keys[-1]
    bad = entries.withColumn("payload", F.when(F.col("seq") == last, "x").otherwise(F.col("payload")))
    assert [r["seq"] for r in verify_chain(bad, ["log"]).collect()] == [last]
    gone = entries.where(F.col("seq") != 60)
    assert [r["seq"] for r in verify_chain(gone, ["log"]).collect()] == [61]
    entries.unpersist()


def test_kept_balances_are_whole(tmp_path, spark):
    """Balances of any size and of more than two decimals, against the query's SQL."""
    duckdb = pytest.importorskip("duckdb")
    from maskwell import queries

    held = [None, 0.0, -0.0, 4516.95, 4516.954, -999.125, 0.1 + 0.2, 1.005, 1 / 3, 1e-3, 1e-4, 1.25e-5, 1e7, -12345678.9, 1e15, 9999999999999998.0, 1e16, 1.5e300, 5.0 * 10**20, float("nan"), float("inf"), float("-inf")]
    rows = [(k, f"Customer#{k:09d}", k % 25, v, "X") for k, v in enumerate(held)]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    told = con.execute(queries.SQL["policy_projection"]).fetchall()
    assert sorted(map(tuple, queries.policy_projection(spark, str(tmp_path)).collect())) == sorted(told)


def test_columns_named_as_intermediate_ones(spark):
    """Tables may have columns of the names that the treatments use themselves; they pass through unchanged."""
    from maskwell.operators import transform, treatments
    from maskwell.plans.policy import Policy

    names = ["_n", "_small", "_q0", "_id", "_m", "_k", "_v", "__pos", "__part", "__new_a"]
    df = spark.createDataFrame([(k, f"a{k % 4}", float(k), *[f"{c}{k}" for c in names]) for k in range(20)], "id long, a string, v double, " + ", ".join(f"`{c}` string" for c in names))
    rest = {r["id"]: tuple(r[c] for c in names) for r in df.collect()}
    for out in (
        treatments.suppress(df, ["a"], 5),
        treatments.microaggregate(df, "id", ["v"]),
        treatments.pram(df, "id", "a"),
        treatments.synth_marginal(df, "id", ["a", "v"]),
        treatments.topbottom(df, "v", top_pct=0.1, bottom_pct=0.1),
        transform.deidentify(df, Policy().set("a", "other_id", "redact")).data(),
    ):
        assert out.columns == df.columns
        assert {r["id"]: tuple(r[c] for c in names) for r in out.collect()} == rest
    assert treatments.percentiles(df, df["v"], [0.0, 0.5, 0.9, 1.0]) == [0.0, 9.5, 17.1, 19.0]


def test_workbooks(tmp_path, spark):
    import zipfile

    from maskwell.sources import workbook

    path = str(tmp_path / "t.xlsx")
    rows = [(2, "_x0041_ a\r\nb", None), (1, "", " <é&👍> \x01")]
    df = spark.createDataFrame(rows, "row_id long, a string, `b \"c` string")
    tables.write_xlsx(df, path, "row_id")
    back = tables.read_table(spark, path)
    assert back.columns == ["a", 'b "c'] and [tuple(r) for r in back.collect()] == [r[1:] for r in reversed(rows)] and tables.sheets(path) == ["Sheet1"]
    tables.write_xlsx(df.limit(0), path)
    assert tables.read_xlsx(spark, path, "Sheet1").count() == 0
    assert [workbook.column_name(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(workbook.column_number(workbook.column_name(k) + "7") == k for k in range(800))
    with pytest.raises(ValueError, match="32767"):
        workbook.write_sheet(path, ["a"], [("x" * 40_000,)])
    # a workbook of another program: shared strings with runs, numbers, truth values, a gap and an unnamed column
    workbook.write_sheet(path, ["a"], [])
    sheet = f'<worksheet xmlns="{workbook.MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="C2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    strings = f'<sst xmlns="{workbook.MAIN}"><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si></sst>'
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()} | {"xl/worksheets/sheet1.xml": sheet.encode(), "xl/sharedStrings.xml": strings.encode()}
    with zipfile.ZipFile(path, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    assert workbook.read_sheet(path) == (["name", "B", "C"], [("1.5", None, "TRUE")])


def test_tables_of_many_workbooks(tmp_path, spark, monkeypatch):
    """A table of more rows than a sheet holds, as a folder of workbooks; sheets are made small here."""
    from maskwell.sources import workbook

    monkeypatch.setattr(workbook, "MAX_ROWS", 20)
    monkeypatch.setattr(workbook, "PART_ROWS", 7)
    parts = list(workbook.write_parts(["a", "b"], [(str(k), None if k % 3 else "") for k in range(50)]))
    assert len(parts) == 8 and all(x.endswith(b"\n") for x in parts)
    got = [workbook.read_sheet(io.BytesIO(x)) for x in parts]
    assert all(n == ["a", "b"] for n, _ in got) and [r for _, rows in got for r in rows] == [(str(k), None if k % 3 else "") for k in range(50)]
    assert workbook.read_sheet(io.BytesIO(next(workbook.write_parts(["a"], [])))) == (["a"], [])
    monkeypatch.setattr(workbook, "PART_XML", 1)
    assert len(list(workbook.write_parts(["a"], [("x",)] * 5))) == 5

    path = str(tmp_path / "many")
    df = spark.range(250_000).select(F.col("id"), F.col("id").cast("string").alias("k"), F.when(F.col("id") % 2 == 0, " é<&\r\n> _x0041_ ").alias("b \"c"))
    tables.write_workbooks(df.coalesce(1), path, "id")
    names = sorted(x for x in os.listdir(path) if x.endswith(".xlsx"))
    assert len(names) >= 3 and not any(x.endswith(".txt") for x in os.listdir(path))
    assert tables.read_xlsx(spark, os.path.join(path, names[0])).first() == ("0", " é<&\r\n> _x0041_ ")
    back = tables.read_workbooks(spark, path)
    assert back.columns == ["k", "b \"c"] and back.count() == 250_000 and back.exceptAll(df.drop("id")).count() == 0
    tables.write_workbooks(df.limit(0), path)
    assert tables.read_workbooks(spark, path).columns == ["id", "k", "b \"c"] and tables.read_workbooks(spark, path).count() == 0
    workbook.write_sheet(os.path.join(path, "other.xlsx"), ["id"], [("1",)])
    with pytest.raises(Exception, match="its columns are"):
        tables.read_workbooks(spark, path).count()


def test_more_rows_than_a_sheet_holds(tmp_path, spark, monkeypatch):
    """The registered query does not end at a sheet's limit."""
    from maskwell import queries_review
    from maskwell.sources import workbook

    monkeypatch.setattr(workbook, "MAX_ROWS", 20)
    spark.range(50).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    assert queries_review.xlsx_round_trip(spark, str(tmp_path)).count() == 50


def test_feedback_register_and_probe(tmp_path, spark):
    from maskwell.sources import plugins

    log, store = [], "file://" + str(tmp_path / "store")
    assert tuning.read_misses(spark, store, KEY).count() == 0
    made = spark.createDataFrame([("Ann", "name", 3), (None, None, None)], "value string, identifier string, row long")
    assert tuning.record_misses(made, store, KEY, "me", log=lambda *x: log.append(x)) == 2 and log == [("feedback_misses_recorded", "me", {"items": 2, "source": "reviewer"})]
    assert tuning.record_misses(made.limit(0), store, KEY) == 0
    got = {(r["value"], r["row"], r["actor"], r["file"]) for r in tuning.read_misses(spark, store, KEY).collect()}
    assert got == {("Ann", 3, "me", None), (None, None, "me", None)}
    assert b"Ann" not in b"".join(p.read_bytes() for p in (tmp_path / "store").iterdir())
    path, on = str(tmp_path / "r" / "register.json"), Policy(autotune={"global_register": True})
    lesson = {"identifier": "mrn", "lever": "threshold", "cause": "below_threshold", "support": 2, "floor": 0.3, "pattern": None}
    assert tuning.write_register(path, [lesson], Policy()) == 0 and tuning.write_register(path, [lesson, lesson], on) == 1 and tuning.from_register(tuning.read_register(path), ["mrn"]) == [lesson]
    assert plugins.probe({"good": lambda rows, texts: [], "bad": lambda rows, texts: 1 / 0}) == {"good": "ready", "bad": "ZeroDivisionError: division by zero"}


def test_batch_keeps_earlier_pairs_and_reads_documents(tmp_path, spark):
    p = Project.create(str(tmp_path / "p"), "demo")
    p.policy.set("name", "name")
    src = tmp_path / "t.csv"
    for text in ("name\nAnn\n Bob\n", "name\nZoe\n Bob\n"):
        src.write_text(text)
        item = runs.run_batch(spark, p, [str(src)], redo=True)[0]
        assert item["status"] == "ok", item
    walk = transform.open_crosswalk(spark.read.parquet(item["output"] + ".crosswalk"), p.key())
    assert sorted(r["original"] for r in walk.collect()) == [" Bob", "Ann", "Zoe"]
    assert open(p.path("output", "batch_summary.csv")).read().splitlines()[0] == "file,type,status,output,rows,seconds,detail"
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.xml").write_text(XML["generic"])
    (tmp_path / "docs" / "b.xml").write_text("<a>")
    got = documents.scrub_table(tables.read_documents(spark, str(tmp_path / "docs")), KEY).orderBy("path").collect()
    assert got[0]["xml"] and got[1]["xml"] is None and got[1]["error"]


def test_review_edges(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q")], "id long, s string, t string")
    b = spark.createDataFrame([(1, None, None), (3, "y", None)], "id long, s string, t string")
    got = sorted(tuple(r) for r in transform.side_by_side(a, b, "id").collect())
    assert got == [(1, "s", "x", None), (2, "s", "y", None), (2, "t", "q", None), (3, "s", None, "y")]
    assert transform.side_by_side(a, b, "id", ["none"]).count() == 0 and transform.side_by_side(a, a, "id").count() == 0


def test_xml_mixed_content_tokens_and_prefixes():
    from xml.etree import ElementTree as ET

    got = documents.scrub_xml("<a>call 91234567 <b>or</b> a@b.co <c/>, none</a>", KEY)
    assert got["xml"] == "<a>call [REDACTED] <b>or</b> [REDACTED] <c />, none</a>" and got["n_changes"] == 2
    ids = [documents.scrub_xml(f"<restingecg><PatientID>{k}</PatientID></restingecg>", KEY) for k in range(300)]
    assert all("REDACTED" not in x["xml"] and x["n_changes"] == 1 for x in ids)
    # a document that declares a prefix does not give it to the next one
    documents.scrub_xml('<q:a xmlns:q="urn:q"><q:b>x</q:b></q:a>', KEY)
    assert "q:a" in documents.scrub_xml('<q:a xmlns:q="urn:q"/>', KEY)["xml"] and "q:" not in documents.scrub_xml("<a xmlns='urn:q'/>", KEY)["xml"]
    tree = ET.fromstring("<r><a><b><c>1</c></b></a><a><x><b><c>2</c></b></x></a></r>")
    texts = lambda path: [e.text for e in documents._select(tree, path)]
    assert texts("a/b/c") == ["1"] and texts("a//b/c") == ["1", "2"] and texts("r//c") == ["1", "2"] and texts("c") == ["1", "2"]
