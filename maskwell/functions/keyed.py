"""Keyed functions: HMAC-SHA256 as a column expression, pseudonyms, date shifts, authenticated encryption.

HMAC needs no UDF: the padded key is two constants of the plan. Plans therefore hold key material;
set ``spark.redaction.string.regex`` where plans are logged.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between salt and value of a pseudonym.
SEPARATOR = "\x01"


def as_key(key: bytes | str) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


def derive_key(master: bytes | str, label: str, size: int = 32) -> bytes:
    """HMAC-SHA256 stream of ``label:counter`` under the master key."""
    out, n = b"", 1
    while len(out) < size:
        out += hmac.new(as_key(master), f"{label}:{n}".encode(), hashlib.sha256).digest()
        n += 1
    return out[:size]


def pads(key: bytes | str) -> tuple[str, str]:
    """Inner and outer padded key as hexadecimal."""
    k = as_key(key)
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in k).hex(), bytes(b ^ 0x5C for b in k).hex()


def hmac_sha256(message: Column, key: bytes | str) -> Column:
    """Hexadecimal HMAC of a string column; null for null."""
    inner, outer = (F.unhex(F.lit(x)) for x in pads(key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pseudonym(value: Column, key: bytes | str, prefix: str = "ID", salt: str = "", digits: int = 16) -> Column:
    """``PREFIX-`` and the first hexadecimal digits of the HMAC of salt, separator and value; null for null or blank."""
    sub = derive_key(key, f"pseudonym:{salt}")
    token = F.concat(F.lit(f"{prefix}-"), F.substring(hmac_sha256(F.concat(F.lit(salt + SEPARATOR), value), sub), 1, digits))
    return F.when(value.isNotNull() & (F.trim(value) != ""), token)


def _word(hexdigits: Column, at: int) -> Column:
    return F.conv(F.substring(hexdigits, at, 8), 16, 10).cast("long")


def shift_days(subject: Column | None, key: bytes | str, salt: str = "", window: int = 365) -> Column:
    """Days in -window .. window, the same for a subject everywhere: the first 8 bytes of HMAC(salt|subject) modulo the span."""
    who = F.lit("_all_") if subject is None else F.coalesce(subject, F.lit("NA"))
    digest, span = hmac_sha256(F.concat(F.lit(f"{salt}|"), who), key), 2 * window + 1
    rest = (_word(digest, 1) % span * (2**32 % span) + _word(digest, 9) % span) % span
    return (rest - window).cast("int")


def seal(text: Column, key: bytes | str, label: str = "crosswalk") -> Column:
    """Authenticated encryption (AES-256-GCM) under a key of its own for each label."""
    return F.aes_encrypt(F.encode(text, "UTF-8"), F.lit(derive_key(key, f"aead:{label}")), F.lit("GCM"))


def unseal(blob: Column, key: bytes | str, label: str = "crosswalk") -> Column:
    """Inverse of ``seal``; a wrong key or label is an error."""
    return F.decode(F.aes_decrypt(blob, F.lit(derive_key(key, f"aead:{label}")), F.lit("GCM")), "UTF-8")


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from a seed and key columns: the same whatever the plan and partitions are."""
    text = F.concat_ws(SEPARATOR, F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(16**13)
