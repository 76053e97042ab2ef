import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from maskwell.functions import dates, fpe, keyed, values

KEY = b"k" * 32


def one(spark, value, *cols, kind="string"):
    return spark.createDataFrame([(v,) for v in value], f"v {kind}").select(*cols).collect()


def test_hmac_and_pseudonyms(spark):
    texts = ["a", "", " ", None, "é😀", "x" * 300]
    for key in (KEY, b"z" * 100):
        got = [r[0] for r in one(spark, texts, keyed.hmac_sha256(F.col("v"), key))]
        assert got == [None if t is None else hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in texts]
    got = [r[0] for r in one(spark, texts, keyed.pseudonym(F.col("v"), KEY, "NAM", "name"))]
    sub = keyed.derive_key(KEY, "pseudonym:name")
    assert got == [None if t is None or not t.strip() else "NAM-" + hmac.new(sub, ("name\x01" + t).encode(), hashlib.sha256).hexdigest()[:16] for t in texts]
    assert len(keyed.derive_key(KEY, "x", 80)) == 80 and keyed.derive_key(KEY, "x") != keyed.derive_key(KEY, "y")


def test_shift_days(spark):
    got = one(spark, ["P1", "P2", None], keyed.shift_days(F.col("v"), KEY, "dob", 30).alias("d"), keyed.shift_days(None, KEY, "dob", 30).alias("all"))
    for who, r in zip(["P1", "P2", "NA"], got, strict=True):
        n = int.from_bytes(hmac.new(KEY, f"dob|{who}".encode(), hashlib.sha256).digest()[:8], "big")
        assert r["d"] == n % 61 - 30 and -30 <= r["all"] <= 30


def test_shift_keeps_intervals(spark):
    df = spark.createDataFrame([("01/01/2020", "P1"), ("15/01/2020", "P1"), ("01/01/2020", "P2"), ("x", "P1"), ("", "P1"), (None, "P1")], "v string, s string")
    a, b, c, bad, blank, null = [r[0] for r in df.select(dates.shift_date(F.col("v"), KEY, "dob", F.col("s"))).collect()]
    from datetime import date

    assert (date.fromisoformat(b) - date.fromisoformat(a)).days == 14 and a != c
    assert (bad, blank, null) == ("[DATE]", None, None)


def test_seal(spark):
    df = spark.createDataFrame([("secret",), (None,)], "v string").select(keyed.seal(F.col("v"), KEY, "a").alias("b"))
    assert [r[0] for r in df.select(keyed.unseal(F.col("b"), KEY, "a")).collect()] == ["secret", None]
    for key, label in ((b"q" * 32, "a"), (KEY, "b")):
        with pytest.raises(Exception):
            df.select(keyed.unseal(F.col("b"), key, label)).collect()


def test_dates(spark):
    cases = {"2020-01-02": "2020-01-02", "2020/1/2": "2020-01-02", "2/1/2020": "2020-01-02", "1/31/2020": "2020-01-31", "02-01-2020": "2020-01-02", "2 Jan 2020": "2020-01-02", "2 January 2020": "2020-01-02", "02-jan-2020": "2020-01-02", "Jan 2, 2020": "2020-01-02", "January 2, 2020": "2020-01-02", "20200102": "2020-01-02", "20200102 120000": "2020-01-02", "31122020": "2020-12-31", "12312020": "2020-12-31", "2020-01-02 10:11:12": "2020-01-02", "1850-01-01": None, "2020-02-30": None, "soon": None, "": None, None: None, "99999999": None}
    got = [r[0] for r in one(spark, list(cases), dates.parse_date(F.col("v")).cast("string"))]
    assert dict(zip(cases, got, strict=True)) == cases
    g = [tuple(r) for r in one(spark, ["2020-05-06", "", None, "x"], dates.generalize_date(F.col("v")), dates.generalize_date(F.col("v"), "year_month"), dates.year_of(F.col("v")))]
    assert g == [("2020", "2020-05", "2020"), ("[DATE]", "[DATE]", "[DATE]"), (None, None, None), ("[DATE]", "[DATE]", "[DATE]")]


def test_validators(spark):
    nrics = {"S1234567D": True, "s1234567d ": True, "S1234567A": False, "T8247451F": True, "S7014767Z": True, "S4444472J": True, "A1234567D": False, "": False, "S12": False, None: None}
    assert [r[0] for r in one(spark, list(nrics), values.nric_valid(F.col("v")))] == list(nrics.values())
    for first in "STFGM":
        letters = [f"{first}1234567{c}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        assert sum(r[0] for r in one(spark, letters, values.nric_valid(F.col("v")))) == 1
    cards = {"4539148803436467": True, "4539148803436460": False, "4539 1488-0343 6467": True, "18": False, "": False, None: None}
    assert [r[0] for r in one(spark, list(cards), values.luhn_valid(F.col("v")))] == list(cards.values())
    assert [r[0] for r in one(spark, ["1.2.3.4", "256.1.1.1", "1.2.3.999"], values.ipv4_valid(F.col("v")))] == [True, False, False]


def test_generalisers(spark):
    got = [tuple(r) for r in one(spark, ["42", "90", "0", "x", None, " 7 ", "120"], values.generalize_age(F.col("v")))]
    assert got == [("40-44",), ("90+",), ("0-4",), (None,), (None,), ("5-9",), ("90+",)]
    assert [r[0] for r in one(spark, ["Blk 1 Singapore 521123", "no", None, ""], values.generalize_geo(F.col("v")))] == ["SECTOR-52", "[GEO]", None, "[GEO]"]
    assert [r[0] for r in one(spark, ["Singapore 521123", "12", "a", None, "5-2-1-1"], values.mask_postal(F.col("v")))] == ["Singapore 521XXX", "XX", "a", None, "5-X-X-X"]
    shapes = [r[0] for r in one(spark, ["AB12-cd3 Z", "AB12", "CD34", "", None, "--1"], values.value_shape(F.col("v")))]
    assert shapes == ["A{2}9{2}-a{2}9 A", "A{2}9{2}", "A{2}9{2}", "", None, "-{2}9"]
    assert [r[0] for r in one(spark, [" 1.5 ", "x", None], values.number(F.col("v")))] == [1.5, None, None]
    assert [r[0] for r in one(spark, ["a b/c", "///"], values.slug(F.col("v")))] == ["a_b_c", "table"]


def test_fpe(spark):
    rnd = random.Random(1)
    plain = ["91234567", "S1234567D", "a-12-b", "7", "", None, "1" * 40] + ["".join(rnd.choice("0123456789") for _ in range(rnd.randint(2, 15))) for _ in range(50)]
    for mode in ("digits", "alnum_upper"):
        df = spark.createDataFrame([(v,) for v in plain], "v string").withColumn("t", fpe.fpe(F.col("v"), KEY, mode, "x")).withColumn("b", fpe.fpe(F.col("t"), KEY, mode, "x", True))
        for r in df.collect():
            v = r["v"]
            if v is None:
                assert r["t"] is None
                continue
            n = sum(c in fpe.ALPHABETS[mode] for c in (v.upper() if mode == "alnum_upper" else v))
            if n < 2:
                assert r["t"] == v
            elif not fpe.supported(n, len(fpe.ALPHABETS[mode])):
                assert r["t"] is None
            else:
                assert r["b"] == (v.upper() if mode == "alnum_upper" else v) and len(r["t"]) == len(v)
                assert [c in "0123456789" for c in r["t"]] == [c in "0123456789" for c in v] or mode != "digits"


def test_uniform_is_plan_independent(spark):
    df = spark.range(2000).select("id", keyed.uniform(3, F.col("id")).alias("u"))
    a, b = ({r["id"]: r["u"] for r in df.repartition(n).collect()} for n in (1, 7))
    assert a == b and all(0 <= u < 1 for u in a.values()) and abs(sum(a.values()) / 2000 - 0.5) < 0.03
