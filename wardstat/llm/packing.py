"""Packing of documents into training sequences: first-fit decreasing over a
tournament tree of bin capacities, in randomised groups of documents.

A document's ids are its text's ids and an end id.  They are cut into whole
sequences of ``capacity`` ids and a remainder.  Every document belongs to a
random group (a hash of its row), groups are packed independently of each
other, and a group is a bounded number of pieces, so groups spread over any
number of executors and no key of the data can make one large.

Null texts are empty documents (one end id).  Null ids, repeated ids and
repeated rows are packed as rows of their own.  Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.bpe import encoder
from wardstat.llm.common import cut, give_back, id_text

END_ID = 1
CAPACITY = 2048
GROUP_PIECES = 8192     # pieces expected in a group

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


class TournamentTree:
    """Bins in the order they were opened; each inner node holds the largest
    free capacity below it, so the first bin that fits is found from the
    root in log2(bins) steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(bins, 1) - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` in the first bin with room; (bin, room it had)."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        room = free[at]
        free[at] = room - size
        bin_, at = at - self.leaves, at // 2
        while at:
            best = max(free[2 * at], free[2 * at + 1])
            if free[at] == best:
                break
            free[at] = best
            at //= 2
        return bin_, room


def first_fit_decreasing(sizes, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size (1..capacity); larger sizes go first, equal
    ones in their given order."""
    sizes = np.asarray(sizes, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    tree = TournamentTree(len(sizes), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for k in order.tolist():
        b, room = tree.place(int(sizes[k]))
        bins[k], offsets[k] = b, capacity - room
    return bins, offsets


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                  end_id: int = END_ID, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids as little-endian unsigned
    32-bit integers) of every document; each id lies in exactly one piece."""
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                ids = enc.ids(text) + end
                n = len(ids) // 4
                rows += [(doc_id, s, min(capacity, n - s), n, ids[4 * s:4 * (s + capacity)])
                         for s in range(0, n, capacity)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
            give_back()

    return id_text(docs, id_col, text_col).mapInPandas(pieces, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES,
                seed: int = 0) -> DataFrame:
    """``pieces`` (with a column ``length`` of 1..capacity) and, for each row,
    its ``sequence_id`` and ``offset`` there.  The pieces are written down
    once, so that the random group of a row is the same in every attempt."""
    fixed = cut(pieces)
    # one row to the driver: how many pieces there are
    total = fixed.count()
    groups = max(1, -(-total // group_pieces))
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    grouped = fixed.withColumn("_group", F.pmod(row, F.lit(groups)))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(pdf["length"], capacity)
        return pdf.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + bins,
                                                 offset=offsets)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fixed.schema.fields]
                       + ["sequence_id long", "offset long"])
    return grouped.groupBy("_group").applyInPandas(pack, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences: sequence_id, length and ids (the pieces' ids one
    after the other; a sequence is at most the capacity)."""
    parts = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"),
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.select("sequence_id", "length", joined.alias("ids"))


def packed_digests(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Every piece with its place; of its ids, their CRC-32.  The digest is
    taken where the ids are, so that the ids are not shuffled."""
    pieces = cut_documents(docs, tokenizer_path, capacity).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack_pieces(pieces, capacity, group_pieces)
