"""Near-duplicate detection by order MinHash.

A text is its sequence of five-word shingles, each labelled with its
occurrence number.  A sketch keeps, for each of ``TABLES`` permutations, the
``SAMPLED`` labelled shingles with the smallest values, in the order in which
they stand in the text, so texts agree on a key if they share those shingles
in the same order: the sketch is sensitive to edits, not only to the set.

Texts that share a key are candidates.  Candidates are verified by a banded
alignment of the two sequences: as labelled shingles are unique in a text, the
best alignment is the longest increasing run of matched positions, among
matches no farther from the diagonal than the lengths and the threshold
allow.  Similarity is aligned / (n + m - aligned), and a link needs 0.8.

Large groups.  Texts with the same words are one node.  First the smallest node of a
key is compared with all others, so a group of n near copies takes n - 1 comparisons
and becomes one class.  Of the keys under which there are several classes yet (a
passage in common, or texts just below the threshold) the nodes meet in blocks: a
task compares bitmaps of their shingles, with at least eight times as many bits,
whose distance bounds the similarity from above, and passes on only pairs of two classes
that can reach the threshold: first as few as connect the same classes, and once
these are verified all that are between two classes still, each under the first key
that they share.  No pair that shares a key is left out, and none becomes a row that
the bound excludes.

Null texts and texts without a word are left alone: each is a class by itself.
Rows may repeat and ids may be null; the smallest id of a class stays (a null
id only if there is no other, the first row of several with that id).  Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.functions.sieve import MAX_BITS, Sieve
from wardstat.llm.common import cut, give_back, text_of
from wardstat.llm.components import components
from wardstat.llm.shingles import labelled, shingle_hashes, word_hashes

TABLES = 16
SAMPLED = 3
THRESHOLD = 0.8
BLOCK = 1024            # nodes of a key that meet in one group
_random = np.random.default_rng(20240402)
A = _random.integers(0, 1 << 64, TABLES, dtype=np.uint64) | np.uint64(1)
B = _random.integers(0, 1 << 64, TABLES, dtype=np.uint64)


def sequence(text: str) -> np.ndarray:
    """64-bit hashes of the labelled shingles, in text order."""
    return labelled(shingle_hashes(word_hashes(text)))


def sketch(seq: np.ndarray) -> list[int]:
    """A 64-bit key per table: its smallest labelled shingles in text order."""
    if len(seq) > SAMPLED:
        low = np.empty((TABLES, SAMPLED), np.int64)
        for k in range(TABLES):
            low[k] = np.argpartition(A[k] * seq + B[k], SAMPLED)[:SAMPLED]
        low.sort(axis=1)
        sampled = seq[low]
    else:
        sampled = np.tile(seq, (TABLES, 1))
    return [int.from_bytes(hashlib.blake2b(bytes([k]) + s.tobytes(), digest_size=8).digest(),
                           "big", signed=True) for k, s in enumerate(sampled)]


def alignment(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Similarity by the banded alignment of two sequences of unique labels; where
    it is below the threshold, an upper bound of it."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    most = len(i) / (n + m - len(i))
    if most < threshold - 1e-9:
        return most
    # rows left unaligned on either side: at most this many at the threshold
    band = int((1 - threshold) / (1 + threshold) * (n + m)) + 1
    near = np.abs(i - j) <= band
    path = j[near][np.argsort(i[near])]
    if (np.diff(path) > 0).all():
        aligned = len(path)
    else:
        ends: list[int] = []
        for x in path.tolist():
            k = bisect.bisect_left(ends, x)
            ends[k:k + 1] = [x]
        aligned = len(ends)
    found = aligned / (n + m - aligned)
    # the band is wide enough for the threshold, not for less
    return found if found >= threshold - 1e-9 else min(most, threshold - 1e-6)


def bitmap(seq: np.ndarray) -> np.ndarray:
    """Bytes with a bit for each place modulo their number; a bit is set where an odd
    number of the sequence's labels fall.  The number of bits, a power of two, is eight
    to sixteen times that of the labels, 64 at least."""
    bits = max(64, 1 << (8 * len(seq) - 1).bit_length())
    odd = np.bincount((seq >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def _sequences(texts: DataFrame) -> DataFrame:
    def sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, doc_id, text in zip(pdf["row"], pdf["doc_id"], pdf["text"]):
                seq = sequence(text)
                same = hashlib.blake2b(seq.tobytes() if len(seq) else b"row %d" % row,
                                       digest_size=16).digest()
                out.append((row, doc_id, same, len(seq), sketch(seq) if len(seq) else [],
                            bitmap(seq).tobytes() if len(seq) else b"",
                            (seq >> np.uint64(32)).astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["row", "doc_id", "same", "n", "keys", "bits", "seq"])
            give_back()

    return texts.mapInPandas(sketches, "row long, doc_id long, same binary, n int, "
                                       "keys array<long>, bits binary, seq binary")


def _of(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``nodes`` and perhaps a few more: a filter in the scan, so the others
    are not shuffled, whatever the number of nodes."""
    return rows.where(Sieve(nodes.toDF("node"), MAX_BITS).may_hold(rows, ["node"]))


def _compared(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """(node, leader, far): one minus the similarity of each pair; for pairs below
    the threshold a lower bound of it."""
    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            far = [1 - alignment(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4"), threshold)
                   for a, b in zip(pdf["a"], pdf["b"])]
            yield pd.DataFrame({"node": pdf["node"], "leader": pdf["leader"], "far": far})
            give_back()

    some = cut(_of(pairs.select("node").union(pairs.select("leader")), seqs))
    a = some.select("node", F.col("seq").alias("a"))
    b = some.select(F.col("node").alias("leader"), F.col("seq").alias("b"))
    return (pairs.join(a.hint("merge"), "node").join(b.hint("merge"), "leader").select("node", "leader", "a", "b")
            .mapInPandas(align, "node long, leader long, far double"))


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, node, class, c) of the ``c`` nodes of each key under which there are
    nodes of several classes."""
    classes = cut(components(links).withColumnRenamed("root", "class"))
    classed = cut(members.join(classes, "node", "left").select(
        "key", "node", F.coalesce("class", "node").alias("class")))
    keys = cut(classed.groupBy("key").agg(F.count(F.lit(1)).alias("c"),
                                          F.min("class").alias("a"), F.max("class").alias("b"))
               .where("a < b").select("key", "c"))
    return classed.join(keys, "key")


class _Group:
    """Nodes of one key, by the lengths of their bitmaps."""

    def __init__(self, pdf: pd.DataFrame):
        self.node, self.n = pdf["node"].to_numpy(), pdf["n"].to_numpy().astype(np.int64)
        self.cls, self.side = pdf["class"].to_numpy(), pdf["side"].to_numpy()
        self.keys, size = pdf["keys"].tolist(), pdf["bits"].str.len().to_numpy()
        self.bits = {}
        for b in np.unique(size):
            at = np.flatnonzero(size == b)
            rows = np.frombuffer(b"".join(pdf["bits"].iloc[at]), np.uint64).reshape(len(at), -1)
            self.bits[int(b)] = (at, rows)

    def _near(self, at_a, a, at_b, b, threshold: float) -> Iterator[np.ndarray]:
        """(i, j) of the pairs of two classes whose bitmaps allow the threshold."""
        step = max(1, (1 << 20) // max(1, len(b) * a.shape[1]))
        for lo in range(0, len(a), step):
            i, n = at_a[lo:lo + step], self.n[at_a[lo:lo + step]][:, None]
            m = self.n[at_b][None, :]
            apart = np.bitwise_count(a[lo:lo + step, None, :] ^ b[None, :, :]).sum(
                axis=2, dtype=np.int64)
            shared = (n + m - apart) / 2
            can = shared >= (threshold - 1e-9) * (n + m - shared)
            can &= np.minimum(n, m) >= (threshold - 1e-9) * np.maximum(n, m)
            can &= self.cls[i][:, None] != self.cls[at_b][None, :]
            p, q = np.nonzero(can)
            yield np.stack([i[p], at_b[q]], axis=1)

    def near(self, both_sides: bool, threshold: float) -> Iterator[tuple[int, int]]:
        """Places of the pairs that can reach the threshold, each pair once; with
        ``both_sides`` of nodes of two blocks."""
        for size, (at, rows) in self.bits.items():
            folded = [(at, rows)]
            if size * 2 in self.bits:   # the longer ones with half the bits
                other, wide = self.bits[size * 2]
                folded.append((other, wide[:, :rows.shape[1]] ^ wide[:, rows.shape[1]:]))
            for k, (other, bits) in enumerate(folded):
                for found in self._near(at, rows, other, bits, threshold):
                    i, j = found.T
                    if both_sides:
                        once = self.side[i] != self.side[j]
                        if k == 0:
                            once &= ~self.side[i]
                    else:
                        once = (i < j) if k == 0 else np.ones(len(i), bool)
                    yield from found[once].tolist()

    def pairs(self, key: int, both_sides: bool, threshold: float) -> Iterator[tuple[int, int]]:
        """(node, leader) of those pairs that share no key before ``key``."""
        for i, j in self.near(both_sides, threshold):
            if min(set(self.keys[i]) & set(self.keys[j])) == key:
                yield int(self.node[i]), int(self.node[j])

    def forest(self, both_sides: bool, threshold: float) -> Iterator[tuple[int, int]]:
        """(node, leader) of as many of those pairs as connect the same classes."""
        root: dict[int, int] = {}

        def find(k: int) -> int:
            while root.setdefault(k, k) != k:
                root[k] = k = root[root[k]]
            return k

        classes = self.cls.tolist()
        for i, j in self.near(both_sides, threshold):
            a, b = find(classes[i]), find(classes[j])
            if a != b:
                root[a] = b
                yield int(self.node[i]), int(self.node[j])


def _candidates(mixed: DataFrame, table: DataFrame, threshold: float,
                forest: bool = False) -> DataFrame:
    """(node, leader): the pairs of two classes that share a key of ``mixed`` and whose
    bitmaps do not exclude them, once each; with ``forest`` only so many of each group that
    they connect the same classes.  A key's nodes are dealt to blocks of about BLOCK, and
    every two blocks are a group."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (mixed.withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    rows = _of(mixed.select("node"),
               table.select(F.col("row").alias("node"), "n", "keys", "bits"))
    met = (dealt.select("key", "node", "class", F.least("own", "other").alias("i"),
                        F.greatest("own", "other").alias("j"),
                        (F.col("own") > F.col("other")).alias("side"))
           .join(rows, "node"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            by = rest[["key", "i", "j"]].to_numpy()
            ends = np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1
            if len(ends):       # the last group may go on in the next batch
                yield found(rest.iloc[:ends[-1]], by, np.concatenate([[0], ends]))
                rest = rest.iloc[ends[-1]:].reset_index(drop=True)
        if rest is not None and len(rest):
            by = rest[["key", "i", "j"]].to_numpy()
            yield found(rest, by, np.array([0, len(rest)]))
        give_back()

    def found(pdf, by, cuts) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                key, i, j = by[a].tolist()
                group = _Group(pdf.iloc[a:b])
                out += (group.forest(i != j, threshold) if forest
                        else group.pairs(key, i != j, threshold))
        return pd.DataFrame(out, columns=["node", "leader"])

    group = ["key", "i", "j"]
    out = (met.repartition(*group).sortWithinPartitions(*group)
           .mapInPandas(meet, "node long, leader long"))
    return out.distinct() if forest else out


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 row_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: row (``row_col``, or a number given here), doc_id,
    class_id (the smallest id of its class), class_size, kept (one per class)."""
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    table = cut(_sequences(docs.select(row.cast("long").alias("row"),
                                       F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                                       text_of(f"`{text_col}`").alias("text"))))
    nodes = cut(table.groupBy("same").agg(F.min("row").alias("node")))
    alone = table.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    members = alone.where("n > 0").select(F.col("row").alias("node"), "n",
                                          F.explode("keys").alias("key"))
    seqs = table.select(F.col("row").alias("node"), "seq")
    members = cut(members)
    # keys of a single text lead to no pair
    leaders = cut(members.groupBy("key").agg(F.count(F.lit(1)).alias("c"),
                                             F.min(F.struct("node", "n")).alias("l"))
                  .where("c > 1").select("key", F.col("l.node").alias("leader"),
                                         F.col("l.n").alias("m")))
    members = cut(members.join(leaders, "key"))
    alike = F.least("n", "m") >= F.greatest("n", "m") * threshold
    first = cut(members.where((F.col("node") != F.col("leader")) & alike)
                .select("node", "leader").distinct())
    near = F.col("far") <= 1 - threshold + 1e-9
    members = members.select("key", "node")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut(_compared(pairs, seqs, threshold).where(near).select("node", "leader"))

    links = linked(first)
    # most pairs that the bitmaps allow are links: first as few as connect the same
    # classes, then all that are between two classes still
    for forest in (True, False):
        mixed = cut(_mixed(members, links))
        rest = cut(_candidates(mixed, table, threshold, forest))
        links = links.unionByName(linked(rest))
        members = mixed.select("key", "node")   # keys of one class stay so
    classed = nodes.join(components(links), "node", "left").select(
        "same", "node", F.coalesce("root", "node").alias("class"))
    rows = cut(table.select("row", "doc_id", "same").join(cut(classed.select("same", "class")),
                                                          "same")
               .select("row", "doc_id", "class"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    summary = cut(rows.groupBy("class").agg(first.alias("first"),
                                            F.count(F.lit(1)).alias("class_size")))
    return rows.join(summary, "class").select(
        "row", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size",
        (F.col("first.row") == F.col("row")).alias("kept"))
