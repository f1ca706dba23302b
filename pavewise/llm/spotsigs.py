"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

An anchor is a frequent function word; its signature is the anchor with the next CHAIN words that are not function words.
Text without anchors, such as lists, tables and single words, has the chains of its own words instead, and text without words one
signature of itself, so that every text has a fingerprint and only equal ones are told equal by default. Sets of
signatures are compared by Jaccard, pruned by their lengths: sets of lengths a <= b are never more alike than a / b.
"""

from __future__ import annotations

import hashlib
import math
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pavewise.llm.common import documents, prepare, stored
from pavewise.llm.ordered import with_next

CHAIN = 2
#: Function words that start a chain, by language (fixed values).
ANCHORS = frozenset(
    "the a an is are was were be to of in on at by for with and or that this it as from "
    "le la les un une des du de et est que qui dans pour par sur au aux en "
    "der die das ein eine und ist zu von mit den dem auf für im sich nicht "
    "el los las una unos y es por con para del al lo se".split()
)
#: Words that no chain holds: the anchors and further function words (fixed values).
COMMON = ANCHORS | frozenset("he she they we you i his her their our your its not but if so than then there had has have will would can could il elle ils nous vous ce ces se ne pas plus mais ou où son sa ses er sie wir ihr es als auch aber oder wie noch sein hat haben yo tú él ella su sus más pero como o no".split())
EDGE = string.punctuation + "«»„“”‘’…–—¡¿"


def signatures(text: str) -> frozenset[int]:
    """The text's set of 32-bit signatures; never empty."""
    words = [w for t in text.lower().split() if (w := t.strip(EDGE))]
    content: list[str] = []
    spots: list[tuple[str, int]] = []
    for w in words:
        if w in COMMON:
            if w in ANCHORS:
                spots.append((w, len(content)))
        else:
            content.append(w)
    crc = zlib.crc32
    out = {crc(" ".join((w, *content[k : k + CHAIN])).encode("utf-8", "surrogatepass")) for w, k in spots if k + CHAIN <= len(content)}
    if not out and words:
        out = {crc(" ".join(words[k : k + CHAIN]).encode("utf-8", "surrogatepass")) for k in range(max(1, len(words) - CHAIN + 1))}
    return frozenset(out or {crc(text.encode("utf-8", "surrogatepass"))})


def jaccard(a: frozenset[int], b: frozenset[int], floor: float = 0.0) -> float:
    """|a & b| / |a | b|, or 0 without counting where the lengths alone keep it under the floor."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not long:
        return 1.0
    if len(short) < floor * len(long):
        return 0.0
    both = len(short & long)
    value = both / (len(a) + len(b) - both)
    return value if value >= floor else 0.0


def text_form(sigs: frozenset[int]) -> str:
    """A fingerprint as a string: its signatures in ascending order, eight hex digits each."""
    return np.sort(np.fromiter(sigs, np.uint32, len(sigs))).astype(">u4").tobytes().hex()


def edited(text: str, other: str) -> str:
    """The text with its last floor(n/2) code points replaced by the other's first as many, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and likenesses to it and to the next.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row. The
    next document is the next in ascending doc_id (equal ids by text hash), the first after the last; a lone document is
    its own next. Null text is the empty text, whose fingerprint is one fixed signature. An empty table gives none.
    The corpus is shuffled once, into ranges of doc_id; each range ends with the next one's first row.
    """
    prepare(df.sparkSession)
    rows = with_next(documents(df, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held = None
        for batch in batches:
            out = []
            for part, guest, doc, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 3)], strict=True):
                if held and held[0] == part:
                    if held[1]:  # further rows equal to the guest
                        continue
                    sigs = signatures(text)
                    new = edited(held[3], text)
                    changed = signatures(new)
                    out.append((held[2], len(held[3]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), text_form(held[4]), text_form(changed), jaccard(held[4], changed), jaccard(held[4], sigs)))
                    held = (part, guest, doc, text, sigs)
                else:
                    held = (part, guest, doc, text, signatures(text))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.select("part", "guest", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sigs array<long> ascending) of every whole text, without a shuffle."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([sorted(signatures(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["doc_id", "sigs"])

    docs = documents(df, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, sigs array<long>")


def near_pairs(df: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (doc_id, class) of every row, and (a, b, likeness) of classes with likeness >= threshold.

    Documents with equal signature sets are one class, so copies make no pairs. Sets are partitioned by length into bands
    as wide as the threshold allows (a set meets its own band and the next), and meet only where they share one of their
    rarest signatures, as many as the threshold leaves unmatched at most; every pair that reaches it shares one.

    Texts without signatures (null, empty, without anchors) are one class that meets no other. Repeated rows and rows
    without doc_id are members like any other; very long texts are read whole; an empty table gives two empty ones.
    Extra columns, whatever their names, are not looked at.
    """
    rows = stored(fingerprints(df, id_col, text_col), "spot-signatures")
    members = rows.select("doc_id", F.xxhash64("sigs").alias("class"))
    sets = stored(rows.select(F.xxhash64("sigs").alias("class"), "sigs").groupBy("class").agg(F.first("sigs").alias("sigs")), "spot-sets")
    each = sets.select("class", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    rare = each.join(each.groupBy("sig").agg(F.count("*").alias("f")), "sig")
    listed = rare.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("f", "sig"))).alias("s"))  # one text's signatures
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    prefix = listed.select("class", "n", F.explode(F.slice("s", F.lit(1), keep)).alias("p")).select("class", "n", F.col("p.sig").alias("sig"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    short = prefix.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(band, band + 1)).alias("band"))
    long = prefix.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", band.alias("band"))
    ahead = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = short.join(long, ["sig", "band"]).filter(ahead & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    full = met.join(sets.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("sigs").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    scored = full.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness"))
    return members, scored.filter(F.col("likeness") >= threshold - 1e-12)
