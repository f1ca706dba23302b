"""The corpus operators as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavewise.llm import bpe, licenses, media, mixing, part_enum, pseudo_lm, secret_scan, simhash, spotsigs, token_store, toxicity, variants, whitening
from pavewise.llm.common import prepare, scratch, table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write(table(spark, sf_dir, "documents"), path)
    return token_store.digests(spark, path)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return media.payload_features(media.store_texts(table(spark, sf_dir, "documents")))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.repeating((5.0, 2.0, 1.0)))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan_documents(table(spark, sf_dir, "documents")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), F.col("component_id"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_lm.score(table(spark, sf_dir, "documents"))


def op11_part_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_enum.classes(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_media_columns": op2_media_columns,
    "op3_spotsigs": op3_spotsigs,
    "op4_license_scan": op4_license_scan,
    "op5_bpe": op5_bpe,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_secret_scan": op8_secret_scan,
    "op9_simhash": op9_simhash,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_part_enum": op11_part_enum,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {}
