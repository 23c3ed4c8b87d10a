"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import divergence, hard_negatives, imatch, language_id, language_model, mixing, packing, quality, simhash, suffix_dedup, token_store, toxicity, url_filter
from plumbline.llm.common import read, remainder


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", F.col("_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_spans").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(read(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return marked.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = url_filter.captures_of(read(spark, sf_dir, "pages"))
    return url_filter.as_of(captures, url_filter.list_of(captures))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.report(read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives.mine(rows)


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store.written_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_mixing, op4_toxicity, op5_quality, op6_language_model, op7_simhash, op8_packing, op9_url_filter, op10_imatch, op11_hard_negatives, op12_token_store, op13_divergence)}
