"""Generalisers, validators and shapes of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights and check letters of the national number, by prefix.
NRIC_WEIGHTS = (2, 7, 6, 5, 4, 3, 2)
NRIC_ST, NRIC_FG, NRIC_M = "JZIHGFEDCBA", "XWUTRQPNMLK", "KLJNPQRTUWX"


def nric_valid(value: Column) -> Column:
    """True if the check letter fits; false for other shapes; null for null."""
    v = F.upper(F.trim(value))
    first = F.substring(v, 1, 1)
    total = sum((F.substring(v, k + 2, 1).try_cast("int") * w for k, w in enumerate(NRIC_WEIGHTS)), F.lit(0))
    rest = (total + F.when(first.isin("T", "G"), 4).when(first == "M", 3).otherwise(0)) % 11
    letter = (
        F.when(first.isin("S", "T"), F.substr(F.lit(NRIC_ST), rest + 1, F.lit(1)))
        .when(first.isin("F", "G"), F.substr(F.lit(NRIC_FG), rest + 1, F.lit(1)))
        .otherwise(F.substr(F.lit(NRIC_M), 11 - rest, F.lit(1)))
    )
    return F.when(v.isNotNull(), F.when(v.rlike("^[STFGM][0-9]{7}[A-Z]$"), letter == F.substring(v, 9, 1)).otherwise(False))


def luhn_valid(value: Column) -> Column:
    """Luhn check of the digits, at least 12 of them."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(digits.isNotNull(), F.when(F.length(digits) >= 12, F.call_function("luhn_check", digits)).otherwise(False))


def ipv4_valid(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("int").between(0, 255), F.lit(False)))


def generalize_age(value: Column, width: int = 5, cap: int = 90) -> Column:
    """``lo-hi`` bands of whole years, ``cap+`` from the cap on; null for what is no whole number."""
    age = F.when(F.trim(value).rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), F.trim(value).try_cast("double")).cast("int")
    low = (F.floor(age / width) * width).cast("int")
    return F.when(age >= cap, F.lit(f"{cap}+")).when(age.isNotNull(), F.concat_ws("-", low.cast("string"), (low + (width - 1)).cast("string")))


def generalize_geo(value: Column) -> Column:
    """``SECTOR-`` and the first two of the first six digits in a row, else ``[GEO]``; null for null."""
    found = F.regexp_extract(value, "([0-9]{6})", 1)
    return F.when(value.isNotNull(), F.when(found != "", F.concat(F.lit("SECTOR-"), F.substring(found, 1, 2))).otherwise("[GEO]"))


def mask_postal(value: Column, mask_last: int = 3, mask: str = "X") -> Column:
    """The last digits masked, all else kept."""
    if mask_last < 1:
        return value
    return F.regexp_replace(value, rf"[0-9](?=(?:[^0-9]*[0-9]){{0,{mask_last - 1}}}[^0-9]*$)", mask)


def redact(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit("[REDACTED]"))


def value_shape(value: Column) -> Column:
    """Digits as 9, letters as A or a, all else as it is; runs as ``c{n}``."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    runs = F.regexp_extract_all(classes, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.concat(F.substring(r, 1, 1), F.lit("{"), F.length(r).cast("string"), F.lit("}"))).otherwise(r)), "")


def number(value: Column) -> Column:
    """Lenient number: null for what is none."""
    return F.trim(value.cast("string")).try_cast("double")


def number_text(value: Column) -> Column:
    """A double as SQL writes it: the fewest of its digits that give it again, plain from 0.0001 to below 10^16, else with an exponent.
    Of several that do, at 10^17 and more, it may be another than SQL's."""
    bare = lambda n: F.regexp_replace(F.format_string(f"%.{n - 1}e", value), r"\.?0*e", "e")
    # 15 digits are always the number's own where they give it again; Java's own text can have one digit too many
    made = F.when(bare(15).cast("double") == value, bare(15)).when(bare(16).cast("double") == value, bare(16)).otherwise(bare(17))

    def write(made: Column) -> Column:
        sign, digits = F.regexp_extract(made, "^-?", 0), F.regexp_replace(F.substring_index(made, "e", 1), "[-.]", "")
        power = F.substring_index(made, "e", -1).cast("int")
        whole = F.when(power < 0, "0").otherwise(F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, F.lit("0")))
        rest = F.when(power < 0, F.concat(F.repeat(F.lit("0"), -power - 1), digits)).otherwise(F.substr(digits, power + 2))
        return F.when(power.between(-4, 15), F.concat(sign, whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))).otherwise(made)

    odd = F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf")
    text = value.cast("string")
    plain = ~text.contains("E") & (F.length(text) <= 16)  # at most 15 digits: the number's own
    return F.when(value.isNotNull(), F.coalesce(odd, F.when(plain, text).otherwise(F.element_at(F.transform(F.array(made), write), 1))))


def slug(value: Column) -> Column:
    """A name fit for files."""
    s = F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "table").otherwise(s)
