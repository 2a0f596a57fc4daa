"""The queries of this subpackage and their SQL, for the driver."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ann, bpe, lexical, mixing, pii, quality, rules, simhash, substring, token_store, vector_codes, vector_dedup, warc
from tidemark.llm.common import scratch

#: The key of the registered queries, whose tables are synthetic; a job on real text takes a secret one.
SURROGATE_KEY = "synthetic tables only"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = scratch(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), TOKENIZER, store)
    return token_store.stored_digests(spark, store)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.kept_digests(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch(spark, "warc"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY).select("doc_id", "text", "n_entities")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), scratch(spark, "lexical"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_simhash": op2_simhash,
    "op3_ann": op3_ann,
    "op4_vector_dedup": op4_vector_dedup,
    "op5_bpe": op5_bpe,
    "op6_token_store": op6_token_store,
    "op7_substring": op7_substring,
    "op8_mixing": op8_mixing,
    "op9_warc": op9_warc,
    "op10_pii": op10_pii,
    "op11_lexical": op11_lexical,
    "op12_vector_codes": op12_vector_codes,
    "op13_rules": op13_rules,
}
SQL: dict[str, str] = {
    "op7_substring": substring.SQL,
    "op8_mixing": mixing.SQL,
    "op9_warc": warc.SQL,
    "op11_lexical": lexical.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_rules": rules.SQL,
}
