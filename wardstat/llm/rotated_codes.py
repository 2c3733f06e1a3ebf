"""Nearest neighbours by inner product on randomly rotated one-bit codes.

A vector is padded with zeros to ``BITS`` times its dimensions or more, rotated at random
(rounds of random signs and a Hadamard transform), and coded by the signs of what comes
out, one bit each; with the code stay the vector's norm and the inner product f of the
rotated unit vector with its own code, the correction scalars.  A query is rotated
in the same way and rounded to 4 bits a component.  Its inner product with a code is
counted on packed bits, plane by plane, and divided by f it estimates the inner product with
the vector.  The error of the estimate is within EPSILON of its standard deviations,
norm * sqrt((1 - f*f) / (f*f * (bits - 1))) a unit of the query, with few exceptions
(0.6 % on the side that loses a neighbour, and only of those at the edge of the list).
A candidate is reranked by the exact inner product of the original vectors, in double
precision, if its estimate and this bound reach the last of the query's list so far.
EPSILON thus sets the recall; every vector's code is compared, in no cell or bucket.

Equal vectors are coded once, with the least ``top + 1`` of their ids, since no list can
hold more of them; equal queries are answered once.  So copies cost nothing, however
many there are.  Queries are taken in rounds of at most about ``QUERY_BYTES`` of
vectors, which are broadcast; the codes are scanned where they lie and never shuffled, and
a task sends at most ``top + 1`` results a query and only such as reach the threshold that
a bounded sample of the vectors gives (a true lower bound, so nothing is lost).  The work
is queries times rows, at BITS bits a dimension instead of 32 or 64.

Vectors that are null, zero or hold a null or non-finite component take no part, as rows
without an id.  Shorter vectors count as padded with zeros.  Of equal scores the smaller
id is nearer.  Repeated rows are rows of their own: a query leaves out one of its own
row.  Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstat.llm.common import cut, partitions

BITS = 4                # code bits a dimension, at least
EPSILON = 2.5           # standard deviations that the error bound allows
TOP = 20
PLANES = 4              # bits of a rotated query's component
ROUNDS = 3              # of signs and Hadamard transforms
SEED = 20
QUERY_BYTES = 1 << 22   # vectors of a round of queries
SAMPLE_BYTES = 1 << 20  # vectors of the sample that gives the first thresholds
CELLS = 1 << 20         # pairs of a query and a code held at a time
KEY = ["k1", "k2"]


def code_length(dims: int) -> int:
    return max(64, 1 << (BITS * dims - 1).bit_length())


def rotated(x: np.ndarray, length: int, seed: int = SEED) -> np.ndarray:
    """Rows of x, padded to ``length`` (a power of two) and rotated; lengths and inner
    products stay as they are."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(x), length))
    out[:, :x.shape[1]] = x
    for _ in range(ROUNDS):
        out *= rng.integers(0, 2, length) * 2 - 1
        h = 1
        while h < length:
            pairs = out.reshape(len(x), length // (2 * h), 2, h)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]],
                           axis=2).reshape(len(x), length)
            h *= 2
        out /= np.sqrt(length)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as words of 64 bits."""
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.uint64)


def encode(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, norms, f) of the rows of x, none of them zero."""
    turned = rotated(x, length)
    norm = np.sqrt((turned * turned).sum(axis=1))
    return packed(turned > 0), norm, np.abs(turned).sum(axis=1) / (norm * np.sqrt(length))


class Queries:
    """Rotated and rounded queries, for estimates against codes."""

    def __init__(self, vectors: np.ndarray, length: int, epsilon: float = EPSILON):
        self.vectors, self.length = vectors, length
        turned = rotated(vectors, length)
        low, top = turned.min(axis=1), turned.max(axis=1)
        step = (top - low) / (2 ** PLANES - 1)
        level = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(int)
        self.planes = np.stack([packed((level >> k) & 1) for k in range(PLANES)], axis=1)
        root = np.sqrt(length)
        # the inner product with a code's unit vector: a * planes + b * ones - c
        self.a, self.b = 2 * step / root, 2 * low / root
        self.c = step / root * level.sum(axis=1) + root * low
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.code_error = epsilon * norm / np.sqrt(length - 1)
        self.step_error = epsilon * step / np.sqrt(12)

    def estimates(self, rows: slice, codes: np.ndarray, ones: np.ndarray, norm: np.ndarray,
                  f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, bounds of their errors) of the queries ``rows`` with
        the coded vectors."""
        planes = self.planes[rows]
        total = np.zeros((len(planes), len(codes)), np.int32)
        for w in range(codes.shape[1]):
            for k in range(PLANES):
                both = np.bitwise_count(planes[:, k, w][:, None] & codes[:, w][None, :])
                total += both.astype(np.int32) << k
        scale = norm / f
        found = (total * self.a[rows][:, None] + ones[None, :] * self.b[rows][:, None]
                 - self.c[rows][:, None]) * scale[None, :]
        spread = scale * np.sqrt(np.maximum(0, 1 - f * f))
        bound = (spread[None, :] * self.code_error[rows][:, None]
                 + scale[None, :] * self.step_error[rows][:, None])
        return found, bound


class Lists:
    """For each query the ``keep`` nearest so far: score, id, whether the candidate's vector is
    the query's; nearest first, ties to smaller ids."""

    def __init__(self, queries: int, keep: int):
        self.keep = keep
        self.score = np.full((queries, keep), -np.inf)
        self.id = np.zeros((queries, keep), np.int64)
        self.same = np.zeros((queries, keep), bool)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, same: np.ndarray) -> None:
        for which in np.array_split(np.unique(query), max(1, len(query) >> 18)):
            m = np.isin(query, which)
            q = np.concatenate([np.repeat(which, self.keep), query[m]])
            s = np.concatenate([self.score[which].ravel(), score[m]])
            i = np.concatenate([self.id[which].ravel(), ids[m]])
            e = np.concatenate([self.same[which].ravel(), same[m]])
            order = np.lexsort((i, -s, q))
            begin = np.searchsorted(q[order], which)
            first = order[(begin[:, None] + np.arange(self.keep)).ravel()]
            shape = (len(which), self.keep)
            self.score[which], self.id[which] = s[first].reshape(shape), i[first].reshape(shape)
            self.same[which] = e[first].reshape(shape)


def exact(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a and j of b in double precision."""
    step = max(1, CELLS // a.shape[1])
    parts = [np.einsum("ij,ij->i", a[i[k:k + step]], b[j[k:k + step]].astype(np.float64))
             for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def scan(queries: Queries, keys: np.ndarray, lists: Lists, floor: np.ndarray,
         batch: "Batch") -> None:
    """Lists after a batch of coded vectors.  ``floor``: what a score must reach."""
    block = max(1, CELLS // max(1, len(batch.norm)))
    for lo in range(0, len(queries.vectors), block):
        rows = slice(lo, min(lo + block, len(queries.vectors)))
        found, bound = queries.estimates(rows, batch.codes, batch.ones, batch.norm, batch.f)
        most = found + bound
        begun = np.maximum(lists.score[rows, -1], floor[rows])
        if np.isneginf(begun).any() and found.shape[1] > lists.keep:
            # nothing to compare with yet: the best by the estimates come first
            best = np.argpartition(-found, lists.keep, axis=1)[:, :lists.keep]
            _rerank(queries, keys, lists, floor, batch,
                    np.repeat(np.arange(rows.start, rows.stop), lists.keep), best.ravel())
            np.put_along_axis(most, best, -np.inf, axis=1)
            begun = np.maximum(lists.score[rows, -1], floor[rows])
        q, c = np.nonzero((most >= begun[:, None]) & (most > -np.inf))
        _rerank(queries, keys, lists, floor, batch, q + lo, c)


def _rerank(queries, keys, lists, floor, batch, q, c) -> None:
    score = exact(queries.vectors, q, batch.vectors, c)
    near = score >= np.maximum(lists.score[q, -1], floor[q])
    q, c, score = q[near], c[near], score[near]
    if not len(q):
        return
    count = batch.count[c]
    at = np.repeat(batch.begin[c], count) + np.arange(int(count.sum())) - np.repeat(
        np.cumsum(count) - count, count)
    same = (keys[q] == batch.keys[c]).all(axis=1)
    lists.add(np.repeat(q, count), np.repeat(score, count), batch.ids[at], np.repeat(same, count))


class Batch:
    """A batch of coded vectors as arrays."""

    def __init__(self, pdf: pd.DataFrame, dims: int, kind: str):
        self.vectors = np.frombuffer(b"".join(pdf["vec"]), kind).reshape(len(pdf), dims)
        self.codes = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(len(pdf), -1)
        self.ones = np.bitwise_count(self.codes).sum(axis=1).astype(np.int32)
        self.norm, self.f = pdf["norm"].to_numpy(), pdf["f"].to_numpy()
        self.keys = pdf[KEY].to_numpy()
        self.ids = np.concatenate([np.asarray(x, np.int64) for x in pdf["ids"]])
        self.count = np.array([len(x) for x in pdf["ids"]])
        self.begin = np.cumsum(self.count) - self.count


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v, k1, k2) of the rows that take part; k1 and k2 are hashes of the vector."""
    kind = rows.schema[vec_col].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast(kind) + F.lit(0).cast(kind))  # no -0.0
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("v", lambda x: x != 0)
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))
    return out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good & some).select(
        "vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))


def coded(rows: DataFrame, dims: int, top: int = TOP) -> DataFrame:
    """Distinct vectors of ``rows`` (as of ``usable``) with their codes: k1, k2, ids (the least
    top + 1), vec, code (bytes), norm, f."""
    kind = "<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    length = code_length(dims)
    # the limit reaches the tasks that read, so a copied vector is a few rows of each
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("vec_id"))
    nodes = (rows.withColumn("n", place).where(F.col("n") <= top + 1).groupBy(*KEY)
             .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.zeros((len(pdf), dims), kind)
            for k, v in enumerate(pdf["v"]):
                x[k, :len(v)] = v
            codes, norm, f = encode(x, length)
            yield pd.DataFrame({**{c: pdf[c] for c in (*KEY, "ids")}, "vec": [r.tobytes() for r in x],
                                "code": [r.tobytes() for r in codes], "norm": norm, "f": f})

    return nodes.mapInPandas(work, "k1 long, k2 long, ids array<long>, vec binary, code binary, "
                                   "norm double, f double")


def _collected(rows: DataFrame, dims: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a bounded number of rows."""
    found = sorted((r["k1"], r["k2"], bytes(r["vec"])) for r in rows.select(*KEY, "vec").collect())
    keys = np.array([r[:2] for r in found], np.int64).reshape(-1, 2)
    return keys, np.frombuffer(b"".join(r[2] for r in found), kind).reshape(-1, dims)


def _round(codes: DataFrame, keys: np.ndarray, vectors: np.ndarray, sample: np.ndarray, dims: int,
           kind: str, keep: int, epsilon: float) -> DataFrame:
    """The ``keep`` nearest of each query of a round: k1, k2, vec_id, score, same."""
    spark = codes.sparkSession
    exactly = vectors.astype(np.float64)
    floor = np.full(len(keys), -np.inf)
    if len(sample) >= keep:
        for lo in range(0, len(keys), 1024):
            near = exactly[lo:lo + 1024] @ sample.T.astype(np.float64)
            # as computed in another order of additions, so a little less
            floor[lo:lo + 1024] = np.partition(near, -keep, axis=1)[:, -keep]
        floor -= 1e-9 * (1 + np.abs(floor))
    sent = spark.sparkContext.broadcast((keys, exactly, floor))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, vectors, floor = sent.value
        queries, lists = None, Lists(len(keys), keep)
        for pdf in batches:
            if len(pdf):
                queries = queries or Queries(vectors, code_length(dims), epsilon)
                scan(queries, keys, lists, floor, Batch(pdf, dims, kind))
        q, k = np.nonzero(lists.score > -np.inf)
        for lo in range(0, len(q), 1 << 16):
            i, j = q[lo:lo + (1 << 16)], k[lo:lo + (1 << 16)]
            yield pd.DataFrame({"k1": keys[i, 0], "k2": keys[i, 1], "vec_id": lists.id[i, j],
                                "score": lists.score[i, j], "same": lists.same[i, j]})

    found = codes.mapInPandas(work, "k1 long, k2 long, vec_id long, score double, same boolean")
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "vec_id"))
    out = cut(found.withColumn("n", place).where(F.col("n") <= keep).drop("n"))
    sent.destroy()
    return out


def nearest(rows: DataFrame, is_query: Column, top: int = TOP, id_col: str = "vec_id",
            vec_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """The ``top`` rows with the largest inner product with each row in which ``is_query`` (a
    condition on ``id_col``) holds, but itself: query_id, rank (from 1), vec_id, score."""
    keyed = cut(usable(rows, id_col, vec_col))
    kind = "<f4" if isinstance(keyed.schema["v"].dataType.elementType, T.FloatType) else "<f8"
    dims = keyed.agg(F.max(F.size("v"))).first()[0] or 1
    parts = max(partitions(rows), rows.sparkSession.sparkContext.defaultParallelism)
    codes = cut(coded(keyed, dims, top).repartition(parts, *KEY))
    asked = keyed.withColumnRenamed("vec_id", id_col).where(is_query).select(
        F.col(f"`{id_col}`").alias("query_id"), *KEY)
    queries = cut(codes.join(asked.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "vec"))
    size = dims * np.dtype(kind).itemsize
    rounds = -(-queries.count() * size // QUERY_BYTES)
    every = max(1, codes.count() * size // SAMPLE_BYTES)
    _, sample = _collected(codes.where(F.pmod("k2", F.lit(every)) == 0), dims, kind)
    found = [_round(codes, *_collected(queries.where(F.pmod("k1", F.lit(rounds)) == k), dims, kind),
                    sample, dims, kind, top + 1, epsilon) for k in range(rounds)]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, "
                                                     "score double")
    entry = F.struct((-F.col("score")).alias("less"), "vec_id", "same")
    lists = reduce(DataFrame.unionByName, found).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(entry)).alias("list"))
    own = F.array_position(F.transform("list", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))),
                           True)
    others = F.filter("list", lambda x, i: i + 1 != F.col("own"))
    return (asked.join(lists, KEY).withColumn("own", own)
            .select("query_id", F.posexplode(F.slice(others, 1, top)).alias("at", "x"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id",
                    (-F.col("x.less")).alias("score")))
