"""Language identification by rank-order n-gram profiles (out-of-place distance).

A document's most frequent n-grams (1 to 3 letters, word ends marked) are ranked by count
and compared with each language's ranked profile; an n-gram that a profile lacks costs the
profile's full length. Null texts and texts without a letter are ``und`` with score 0; an
empty training set makes every document ``und``. Ties go to the smallest language name.
Rows pass through one by one, so repeated rows get equal results, and very long texts count whole. Of
other columns only ``lang`` is read, in training, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import tokens
from .common import small_batches

UND = "und"
#: Beyond all letters, within 21 bits.
END = 0x110000
PROFILE_SIZE = 300
#: Training documents per language, at most: those with the smallest hash of doc_id.
MAX_TRAIN_DOCS = 2000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of a text: 21 bits a letter, ``END`` for a word end, so that no two n-grams share a code."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64)
    before = np.concatenate(([False], letter[:-1]))
    kept = letter | before
    codes = np.concatenate(([END], np.where(letter, points, END)[kept], [END])).astype(np.uint64)
    if codes[-2] == END:
        codes = codes[:-1]
    shift = np.uint64(21)
    two = (codes[:-1] << shift) | codes[1:]
    three = (two[:-1] << shift) | codes[2:]
    return np.concatenate((codes[codes != END], two, three[codes[1:-1] != END]))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    if len(found) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.argsort(-counts, kind="stable")][:size]


class Profiles:
    """Ranks of every profile's n-grams as one sorted table."""

    def __init__(self, by_lang: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.langs, self.size = sorted(by_lang), size
        self.grams = np.unique(np.array([g for x in by_lang.values() for g in x], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            at = np.searchsorted(self.grams, np.array(by_lang[lang], np.uint64))
            self.ranks[at, k] = np.arange(len(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = grams(text) if text and self.langs else ()
        if not len(codes):
            return UND, 0.0
        own = ranked(codes, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == own, at, len(self.grams))]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (self.size * len(own)))


def fit(labelled: DataFrame, size: int = PROFILE_SIZE, max_docs: int = MAX_TRAIN_DOCS) -> Profiles:
    """Learn from ``text`` and non-null ``lang`` of ``labelled``: a bounded sample of ``max_docs`` documents per
    language, those with the smallest hashes of ``doc_id``. Collected: ``size`` n-grams per language."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("lang is not null").select("doc_id", "lang", "text")
    # a share of the hash space that surely holds max_docs of each language, then exactly max_docs
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language, as its profile
    if not totals:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, (1.5 * max_docs + 100) / n))])
    drawn = rows.withColumn("u", (F.shiftrightunsigned(F.xxhash64("doc_id"), 11)).cast("double") / float(1 << 53))
    near = drawn.where(F.col("u") < F.element_at(share, F.col("lang")))
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))).where(F.col("k") <= max_docs)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.forget()
        found: dict[str, list[np.ndarray]] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                if isinstance(text, str) and len(codes := grams(text)):
                    found.setdefault(lang, []).append(codes)
            for lang, parts in found.items():
                seen, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": seen.astype(np.int64), "n": counts})
            found.clear()

    sums = first.select("lang", "text").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = sums.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= size)
    by_lang: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "k").collect():
        by_lang.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(by_lang, size)


def predict(text: Column, profiles: Profiles) -> Column:
    """struct<lang_pred: string, score: double> of a text column."""
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(schema)
    def label(texts: pd.Series) -> pd.DataFrame:
        tokens.forget()
        return pd.DataFrame([profiles.predict(x) if isinstance(x, str) else (UND, 0.0) for x in texts], columns=["lang_pred", "score"])

    return label(text)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no rest by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from those that are not held out."""
    profiles = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), profiles).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
