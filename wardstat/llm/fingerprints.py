"""Document fingerprints by MinHash.

A text's shingles (five words) are hashed to 64 bits, and each of ``HASHES``
universal permutations a*x + b modulo 2**64 (a odd) keeps the smallest value.
The fingerprint is 16 bits of each minimum, mixed anew: the minimum of n values
is about 2**64 / n, so its own high bits are zeros in long texts.  The share of
equal positions of two fingerprints estimates the Jaccard similarity of their
shingle sets at every length (unrelated minima agree in 1 of 65,536 cases).

``similar_links`` joins bands of the signatures in Spark and verifies the
Jaccard similarity on the shingles themselves.

Null texts are empty; a text without a word has a fingerprint of its own kind
that no other text has.  Texts of fewer than five words are one shingle.
Rows with equal ids are ordered by a hash of their text; a null id comes
first.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import cut, id_text, partitions
from wardstat.llm.shingles import mix, shingle_hashes, word_hashes

HASHES = 128
BANDS = 32              # of HASHES / BANDS rows each
BLOCK = 2048            # shingles permuted at once
MAX_BUCKETS = 4096      # of the ordering by id; bounds what the driver gets
_random = np.random.default_rng(20240301)
A = _random.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
B = _random.integers(0, 1 << 64, HASHES, dtype=np.uint64)
EMPTY = np.full(HASHES, 0xFFFFFFFFFFFFFFFF, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of each permutation over the shingles' hashes."""
    low = EMPTY
    for k in range(0, len(shingles), BLOCK):
        x = shingles[k:k + BLOCK]
        low = np.minimum(low, (A[:, None] * x[None, :] + B[:, None]).min(axis=1))
    return low


def fingerprint(text: str) -> np.ndarray:
    """16 well-mixed bits of each minimum."""
    low = signature(shingle_hashes(word_hashes(text)))
    return (mix(low) & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _bucketed(texts: DataFrame, buckets: int) -> DataFrame:
    """The texts in ``bucket`` by ranges of ids, with ``ghost`` false, and, with
    ``ghost`` true, each bucket's first text once more in the bucket before it
    (of the first bucket: in the last).  The driver gets a row per bucket."""
    marks = texts.agg(F.percentile_approx(
        "doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("m")).first()["m"]
    marks = sorted(set(marks or []))
    bucket = F.lit(0)
    if marks:
        bucket = F.coalesce(F.size(F.filter(F.array(*map(F.lit, marks)),
                                            lambda m: m < F.col("doc_id"))), F.lit(0))
    placed = texts.withColumn("bucket", bucket).withColumn("h", F.xxhash64("text"))
    heads = (placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("head"))
             .orderBy("bucket").collect())
    if not heads:
        return placed.withColumn("ghost", F.lit(False))
    rows = [(r["bucket"], r["head"]["doc_id"], r["head"]["h"], heads[k - 1]["bucket"])
            for k, r in enumerate(heads)]
    table = texts.sparkSession.createDataFrame(
        rows, "bucket int, head_id long, head_h long, before int")
    with_head = placed.join(F.broadcast(table), "bucket")   # at most ``buckets`` rows
    is_head = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"))
    return (with_head.withColumn("at", F.explode(F.when(is_head, F.array(own, ghost))
                                                 .otherwise(F.array(own))))
            .select("doc_id", "text", "h", "at.bucket", "at.ghost"))


def in_order(docs: DataFrame, each, schema: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Rows ``each(doc_id, text, next_text)`` of every document and the text of
    the next one in ascending id (after the last: the first).  The texts are
    shuffled once, to ranges of ids, and streamed in order."""
    buckets = min(partitions(docs), MAX_BUCKETS)
    placed = _bucketed(id_text(docs, id_col, text_col), buckets)
    ordered = (placed.repartitionById(buckets, F.col("bucket"))
               .sortWithinPartitions("bucket", "ghost", F.asc_nulls_first("doc_id"), "h"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, columns = None, [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            out = []
            for row in zip(pdf["bucket"], pdf["ghost"], pdf["doc_id"], pdf["text"]):
                if held is not None and held[0] == row[0]:
                    out.append(each(held[2], held[3], row[3]))
                held = None if row[1] else row
            yield pd.DataFrame(out, columns=columns)

    return ordered.select("bucket", "ghost", "doc_id", "text").mapInPandas(stream, schema)


EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last quarter is
    replaced by the beginning of the next document."""
    def each(doc_id, text, after):
        n = len(text)
        edited = text[:n - n // 4] + after[:n // 4]
        own, changed, following = fingerprint(text), fingerprint(edited), fingerprint(after)
        return (doc_id, n, hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed),
                likeness(own, following))

    return in_order(docs, each, EDITED, id_col, text_col)


def similar_links(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, to_id, jaccard): each document linked to the smallest document of
    every band group it is in, if their shingle sets' Jaccard similarity is at
    least the threshold.  A group of n documents gives n - 1 candidates, not
    all pairs.  Texts without a word are not linked."""
    rows = HASHES // BANDS

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                shingles = np.unique(shingle_hashes(word_hashes(text)))
                if len(shingles):
                    low = signature(shingles)
                    bands = [k.to_bytes(2, "big") + low[k * rows:(k + 1) * rows].tobytes()
                             for k in range(BANDS)]
                    out.append((doc_id, shingles.view(np.int64).tolist(),
                                [hashlib.blake2b(b, digest_size=16).digest() for b in bands]))
            yield pd.DataFrame(out, columns=["doc_id", "shingles", "bands"])

    signed = cut(id_text(docs, id_col, text_col).mapInPandas(
        signatures, "doc_id long, shingles array<long>, bands array<binary>"))
    banded = signed.select("doc_id", F.explode("bands").alias("band"))
    first = (banded.groupBy("band").agg(F.min("doc_id").alias("to_id"),
                                        F.count(F.lit(1)).alias("n")).where("n > 1"))
    pairs = (banded.join(first.select("band", "to_id"), "band").where("doc_id > to_id")
             .select("doc_id", "to_id").distinct())
    a = signed.select("doc_id", F.col("shingles").alias("a"))
    b = signed.select(F.col("doc_id").alias("to_id"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (pairs.join(a, "doc_id").join(b, "to_id")
            .select("doc_id", "to_id",
                    (common / (F.size("a") + F.size("b") - common)).alias("jaccard"))
            .where(F.col("jaccard") >= threshold))
