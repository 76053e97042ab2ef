"""Format-preserving encryption: a balanced Feistel network over the digits or capital letters of a value.

Symbols outside the alphabet stay in place. Numbers are written as plain integers, so tokens are
this library's own; the contract is shape, determinism and the round trip. Values of fewer than
two symbols stay as they are; domains of 2^53 or more give null.
"""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .keyed import derive_key

ALPHABETS = {"digits": "0123456789", "alnum_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ROUNDS, LIMIT = 8, 2**53


def supported(n: int, radix: int) -> bool:
    return n >= 2 and radix**n < LIMIT


def _mix(other: int, turn: int, key: bytes, tweak: str, size: int) -> int:
    digest = hmac.new(key, f"{tweak}:{other}|{turn}".encode(), hashlib.sha256).digest()
    return int.from_bytes(digest[:6], "big") % size


def _feistel(number: int, n: int, radix: int, key: bytes, tweak: str, decrypt: bool) -> int:
    low_size = radix ** (n - n // 2)
    high_size = radix ** (n // 2)
    high, low = divmod(number, low_size)
    sign = -1 if decrypt else 1
    for turn in range(ROUNDS)[::sign]:
        if turn % 2:
            low = (low + sign * _mix(high, turn, key, tweak, low_size)) % low_size
        else:
            high = (high + sign * _mix(low, turn, key, tweak, high_size)) % high_size
    return high * low_size + low


def transform_value(value: str | None, key: bytes, mode: str = "digits", tweak: str = "", decrypt: bool = False) -> str | None:
    if value is None:
        return None
    alphabet = ALPHABETS[mode]
    text = value.upper() if mode == "alnum_upper" else value
    places = [k for k, c in enumerate(text) if c in alphabet]
    n, radix = len(places), len(alphabet)
    if n < 2:
        return value
    if not supported(n, radix):
        return None
    number = 0
    for k in places:
        number = number * radix + alphabet.index(text[k])
    number = _feistel(number, n, radix, key, tweak, decrypt)
    out = list(text)
    for k in reversed(places):
        number, digit = divmod(number, radix)
        out[k] = alphabet[digit]
    return "".join(out)


def fpe(value: Column, key: bytes | str, mode: str = "digits", tweak: str = "", decrypt: bool = False) -> Column:
    """Encrypted or decrypted column; distinct values of a batch are computed once."""
    sub = derive_key(key, f"fpe:{mode}")

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        known = {v: transform_value(v, sub, mode, tweak, decrypt) for v in values.dropna().unique()}
        return values.map(known).astype(object).where(values.notna(), None)

    return run(value)
