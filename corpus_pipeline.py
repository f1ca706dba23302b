"""From raw documents to token ids in five stages, each an operator of pavewise.llm whose decisions take effect.

Every stage gets what the one before it kept, written as Parquet and read again, so a lost executor repeats part of one
stage at most. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pavewise.llm import bpe, mixing, near_copies, secret_scan, toxicity
from pavewise.llm.common import prepare, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated chance to be toxic is under one half; the classifier is fitted on labelled ones of docs.

    Null and empty texts are scored like any other, repeated rows stay as often as they came, rows without an id and without
    a label are scored too; without labels, or without rows, nothing is rejected. Very long texts are scored whole, in time
    linear in their length. Columns, clashing names too, come out as they went in.
    """
    prepare(spark)
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets at Jaccard similarity 0.8 or more: the smallest doc_id.

    Null, empty and wordless texts have one and the same (empty) set; a text of fewer words than a shingle is one shingle.
    Rows that repeat id and text leave one, a null id stands after all others. Very long texts are compared whole. An empty
    table gives none. Columns come out as they went in. Candidates come from SimHash of the five-word sets, searched as in op9, and what
    its links leave apart meets by min-wise fingerprints, since SimHash within 4 bits misses most pairs at 0.8 (figures in the README).
    """
    return near_copies.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials in their texts replaced by a mark and n_chars made to fit.

    Null and empty texts, and texts without credentials, stay as they are, n_chars too; repeated rows are changed alike and
    an empty table gives none. A text of any length, with any number of credentials, is scanned whole. Columns come out
    as they went in.
    """
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0 to 2 times) as the mix of sources takes them; a repeated one is a repeated row.

    A null source is a source of its own, the last; null and empty texts have no words and are taken as their source's draw
    has it; a very long text is taken whole or not at all; an empty table gives none. Columns come out as they went in.
    """
    return mixing.mixed_rows(docs, mixing.repeating((5.0, 2.0, 1.0)))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; null and empty texts have no ids, very long ones are encoded whole,
    repeated rows stay, an empty table gives none, and other columns are not looked at."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: Trees, fingerprint components and byte-pair merges have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through(spark, table(spark, sf_dir, "documents"), sf_dir)


def through(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs through all stages. Tables in between are written by column number, so names may differ by case alone."""
    for name, stage in STAGES:
        path, out = scratch(spark, f"pipeline-{name}"), stage(spark, docs, sf_dir)
        names = out.columns
        out.toDF(*[f"c{i}" for i in range(len(names))]).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path).toDF(*names)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
