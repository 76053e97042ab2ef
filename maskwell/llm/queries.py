"""Thin registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, langid, licenses, mixing, packing, sharding, simhash, tokenbin, tokens, topk
from .common import run_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every document whose id is divisible by 50, by its whole text."""
    found = topk.search(_docs(spark, sf_dir), F.col("doc_id") % 50 == 0)
    return found.withColumn("score", F.round("score", 6))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(_docs(spark, sf_dir)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_docs(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(_docs(spark, sf_dir)))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_docs(spark, sf_dir), tokens.tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")), F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")))).alias("t")).select("conv_id", "t.*")
    return chat.read_back(chat.windows(rows.unionByName(planted)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four arrivals through the store, read back from the last version."""
    store = sharding.ShardStore(spark, run_path(spark, "shards"))
    store.append_arrivals(_docs(spark, sf_dir), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4, 4)
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tokenbin.write(_docs(spark, sf_dir), tokens.tokenizer_path("byte_bpe_50k.json"))
    return tokenbin.read_back(index, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk_search, op2_mix_sources, op3_simhash, op4_exact_dedup, op5_language_id, op6_license_scan, op7_best_fit_packing, op8_chat_formatting, op9_sharding, op10_token_binary)}


_SQL = {
    "op1_topk_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
        tf AS (SELECT r, t, count(*) AS n FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
        s AS (SELECT count(*) AS docs, sum(len(w)) / count(*)::DOUBLE AS mean FROM d),
        idf AS (SELECT t, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, s GROUP BY t, docs),
        p AS (SELECT q.r AS q, x.r AS x, sum(idf * q.n * (x.n * 2.2 / (x.n + 1.2 * (0.25 + 0.75 * len(d.w) / mean)))) AS score
              FROM tf q JOIN tf x USING (t) JOIN idf USING (t) JOIN d ON d.r = x.r, s
              WHERE q.r IN (SELECT r FROM d WHERE doc_id % 50 = 0) GROUP BY q.r, x.r),
        k AS (SELECT a.doc_id AS query_id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, b.doc_id NULLS FIRST) AS rank, b.doc_id, round(score, 6) AS score
              FROM p JOIN d a ON a.r = q JOIN d b ON b.r = x)
        SELECT query_id, rank, doc_id, score FROM k WHERE rank <= 10
    """,
    "op9_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS k,
                first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY norm) AS group_size FROM d)
        SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
