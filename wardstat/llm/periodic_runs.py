"""Runs of periodic repetition in the words of documents.

A run is a stretch of consecutive words with smallest period q (words q apart are
the same) of at least ``MIN_LENGTH`` words and ``MIN_POWER`` periods that no
neighbouring word extends.  Words are runs of characters that are not ASCII blanks
(space, tab, line feed, vertical tab, form feed, carriage return).

How far the texts from two places agree (LCE) is answered on a difference cover: of
every ``PERIOD`` places those whose number modulo PERIOD is in ``COVER`` are samples,
and any two places reach samples after the same few words.  Those words are
compared; only the sampled suffixes are sorted, by blocks of PERIOD words and
doubling; the agreement of two of them is the least entry of the array of common
prefixes between their places in the order, from a sparse table.  Only documents
with a pair that agrees in all compared words are sorted at all.

Runs are enumerated on harmonic grids: for each period p up to a quarter of the
document the places 0, 3p, 6p, ... are compared with those p further on, forwards
and backwards (on the reversed words).  A run of 4p words holds such a pair, so
about n ln(n) / 3 pairs find all runs.  A stretch found with several periods has
the least of them.

Documents are handled in batches of about ``BATCH_WORDS`` words in the tasks that read
them, with another separator after each, so no shuffle is needed; a longer
document is a batch of its own.

Null texts have no words.  Rows with one id or text are handled one by one; other
columns are kept as they are; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_POWER = 4
# A perfect difference set, every difference modulo 13 occurs.
PERIOD, COVER = 13, (0, 1, 3, 9)
GRID = MIN_POWER - 1    # of a run's 4p places, 3p may be the first of a pair p apart
BATCH_WORDS = 300_000
PAIRS = 1 << 21         # pairs compared at a time
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _meeting() -> np.ndarray:
    """Words until two places are both samples, by the places modulo PERIOD."""
    sampled = np.zeros(PERIOD, bool)
    sampled[list(COVER)] = True
    at = np.arange(PERIOD)
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            out[a, b] = np.flatnonzero(sampled[(a + at) % PERIOD] & sampled[(b + at) % PERIOD])[0]
    return out


MEETING = _meeting()


class CommonExtensions:
    """How many words agree from two places on, in an array of word numbers in which
    another number ends every document."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        # beyond the end every place differs from every other, down to the last compared
        self.words = np.concatenate([words.astype(np.int64), -1 - np.arange(2 * PERIOD)])
        self._sort()

    def _sort(self) -> None:
        size = -(-(self.n + 1) // PERIOD)
        # samples by class, so that PERIOD words on is one place on
        place = (np.asarray(COVER)[:, None] + PERIOD * np.arange(size)).ravel()
        place = np.where(place < self.n, place, self.n)
        blocks = self.words[place[:, None] + np.arange(PERIOD)]
        order = np.lexsort(blocks.T[::-1])
        new = np.ones(len(order), bool)
        new[1:] = (blocks[order[1:]] != blocks[order[:-1]]).any(axis=1)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        last = np.arange(len(place)) % size     # place in its class
        levels, h = [rank], 1
        while not new.all() and h < size:
            ahead = np.where(last + h < size, rank[np.minimum(np.arange(len(rank)) + h,
                                                              len(rank) - 1)], -1)
            key = rank * (len(rank) + 1) + ahead + 1
            order = np.argsort(key, kind="stable")
            new = np.ones(len(order), bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new) - 1
            levels.append(rank)
            h *= 2
        # common prefixes of neighbours in the order: by whole levels, then word by word
        a, b = order[:-1].copy(), order[1:].copy()
        whole = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = 1 << k
            fits = (last[a] + step < size) & (last[b] + step < size)
            same = fits & (levels[k][a] == levels[k][b])
            whole += same * step
            a, b = a + same * step, b + same * step
        prefix = whole * PERIOD + self._agree(place[a], place[b], PERIOD)
        self.table = [prefix]
        while 2 ** len(self.table) <= len(prefix):
            half = 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))
        self.rank, self.size = np.empty(len(order), np.int64), size
        self.rank[order] = np.arange(len(order))    # places beyond the end are all alike
        self.index = np.full(PERIOD, -1, np.int64)
        self.index[list(COVER)] = np.arange(len(COVER))

    def _agree(self, a: np.ndarray, b: np.ndarray, limit) -> np.ndarray:
        """Words that agree from a and b on, at most ``limit`` (a number or an array)."""
        return agreeing(self.words, a, b, limit)

    def _sample(self, place: np.ndarray) -> np.ndarray:
        return self.index[place % PERIOD] * self.size + place // PERIOD

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For places a and b (arrays, a != b, up to the array's length)."""
        first = MEETING[a % PERIOD, b % PERIOD]
        out = self._agree(a, b, first)
        go = np.flatnonzero((out == first) & (np.maximum(a, b) + first < self.n))
        if not len(go):
            return out
        x = self.rank[self._sample(a[go] + first[go])]
        y = self.rank[self._sample(b[go] + first[go])]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        k = np.frexp((hi - lo).astype(float))[1] - 1
        least = np.empty(len(go), np.int64)
        for level in np.unique(k):
            m = k == level
            t = self.table[level]
            least[m] = np.minimum(t[lo[m]], t[hi[m] - (1 << level)])
        out[go] += least
        return out


def agreeing(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit) -> np.ndarray:
    """Words that agree from a and b on, at most ``limit``."""
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    limit = np.broadcast_to(limit, out.shape)
    step = 0
    while len(left):
        left = left[limit[left] > step]
        left = left[words[a[left] + step] == words[b[left] + step]]
        step += 1
        out[left] = step
    return out


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the first of each pair of the grids of documents that begin at
    ``starts`` and have ``sizes`` words, some PAIRS at a time."""
    most = sizes // MIN_POWER
    by_size = np.argsort(-most, kind="stable")
    starts, sizes, most = starts[by_size], sizes[by_size], most[by_size]
    top = int(most[0]) if len(most) else 0
    held, waiting = [], 0
    for p in range(1, top + 1):
        docs = np.searchsorted(-most, -p, side="right")     # those with p <= most
        count = -(-(sizes[:docs] - p) // (GRID * p))
        before = np.cumsum(count) - count
        step = np.arange(int(count.sum())) - np.repeat(before, count)
        place = np.repeat(starts[:docs], count) + step * (GRID * p)
        held.append((place, np.full(len(place), p, np.int64)))
        waiting += len(place)
        if waiting >= PAIRS:
            yield tuple(map(np.concatenate, zip(*held)))
            held, waiting = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs, sorted, in an array of word numbers in
    which documents begin at ``starts``, have ``sizes`` words and are each followed by
    a number that occurs once."""
    n = len(words)
    ahead = np.concatenate([words, -1 - np.arange(2 * PERIOD)])
    back = np.concatenate([words[::-1], -1 - np.arange(2 * PERIOD)])
    pairs, deep = [], []
    for place, period in _grid(starts, sizes):
        alike = words[place] == words[place + period]
        place, period = place[alike], period[alike]
        if not len(place):
            continue
        # words are compared up to where samples meet; most pairs end there
        forward = agreeing(ahead, place, place + period, PERIOD)
        backward = agreeing(back, n - place, n - place - period, PERIOD)
        open_ends = (forward == PERIOD) | (backward == PERIOD)
        short = forward + backward + period < np.maximum(MIN_LENGTH, MIN_POWER * period)
        keep = open_ends | ~short
        pairs.append(np.stack([place, period, forward, backward], axis=1)[keep])
        deep.append(open_ends[keep])
    if not pairs:
        return np.empty((0, 3), np.int64)
    place, period, forward, backward = np.concatenate(pairs).T
    far = np.concatenate(deep)
    if far.any():
        forward, backward = forward.copy(), backward.copy()
        forward[far], backward[far] = _deep(words, starts, sizes, place[far], period[far])
    enough = forward + backward + period >= np.maximum(MIN_LENGTH, MIN_POWER * period)
    found = np.stack([place - backward, place + period + forward, period], axis=1)[enough]
    if not len(found):
        return found
    found = found[np.lexsort(found.T[::-1])]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def _deep(words, starts, sizes, place, period) -> tuple[np.ndarray, np.ndarray]:
    """Common extensions forwards and backwards of the pairs (place, place + period),
    sorting only the suffixes of the documents that hold them."""
    doc = np.searchsorted(starts, place, side="right") - 1
    used = np.unique(doc)
    length = sizes[used] + 1        # with the separator
    begin = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(begin, length)
    part = words[np.repeat(starts[used], length) + inside]
    at = place - starts[doc] + begin[np.searchsorted(used, doc)]
    forward, backward = CommonExtensions(part), CommonExtensions(part[::-1])
    out = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for lo in range(0, len(at), PAIRS):
        a, p = at[lo:lo + PAIRS], period[lo:lo + PAIRS]
        out[0][lo:lo + PAIRS] = forward(a, a + p)
        out[1][lo:lo + PAIRS] = backward(len(part) - a, len(part) - a - p)
    return out


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__     # a new word has the next number
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for t, at in zip(texts, starts):
        words[at:at + len(t)] = list(map(number.__getitem__, t))
    words[starts + sizes] = len(number) + np.arange(len(texts))
    found = find_runs(words, starts, sizes)
    doc = np.searchsorted(starts, found[:, 0], side="right") - 1
    found = np.stack([found[:, 0] - starts[doc], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(cuts, cuts[1:])]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that a run holds after its first period."""
    if len(runs):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2], 1)
        np.add.at(change, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(change[:-1]) == 0
        words = [w for w, k in zip(words, kept) if k]
    return b" ".join(words)


def _finder(digest: bool):
    def work(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in column:
            yield pd.DataFrame(_found(texts, digest), columns=["runs", "collapsed"])

    return F.pandas_udf(work, f"runs {RUNS}, collapsed string", F.PandasUDFType.SCALAR_ITER)


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row``: a struct of the columns of ``docs``; ``runs``: array of struct(start, length,
    period) by start, then period, in numbers of words; ``collapsed``: the words that
    stay, joined by blanks."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    found = docs.select(row.alias("row"),
                        _finder(False)(F.col(f"`{text_col}`").cast("string")).alias("f"))
    return found.select("row", "f.runs", "f.collapsed")


def _found(texts: pd.Series, digest: bool) -> list[tuple]:
    """(runs, collapsed) of each text, in batches of about BATCH_WORDS words."""
    out: list[tuple] = []
    batch: list[list[bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal batch, size
        for words, runs in zip(batch, runs_of_texts(batch) if batch else []):
            text = _collapsed(words, runs)
            out.append(([{"start": int(s), "length": int(k), "period": int(p)}
                         for s, k, p in runs],
                        hashlib.sha256(text).hexdigest() if digest else text.decode()))
        batch, size = [], 0

    for text in texts:
        words = text.encode().split() if text else []   # bytes split at ASCII blanks
        if size and size + len(words) > BATCH_WORDS:
            flush()
        batch.append(words)
        size += len(words) + 1
    flush()
    return out


def words_of(text: Column) -> Column:
    """The words of a text, an array."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) for tests at scale: in texts of n > 0 words whose id's crc32 h ends in
    0, each word from a = g % n on (g = h / 10) is word a + (i - a) % p, with
    p = 1 + (n - a) / (3 + g % 8); other texts are as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    hit = F.pmod(h, F.lit(10)) == 0
    # a column of its own: an expression would be split again for every word
    split = docs.select("doc_id", F.col("text").cast("string").alias("text"),
                        F.floor(h / 10).alias("g"),
                        F.when(hit, words_of(F.col("text"))).alias("words"))
    g, words = F.col("g"), F.col("words")
    n = F.size(words).cast("long")
    a = F.pmod(g, n)
    p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1
    periodic = F.array_join(F.transform(
        words, lambda w, i: F.when(i < a, w).otherwise(F.element_at(
            words, (a + F.pmod(i - a, p) + 1).cast("int")))), " ")
    return split.select("doc_id", F.when(F.size(words) > 0, periodic).otherwise(F.col("text"))
                        .alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_runs, the run of the greatest
    exact length / period (start, length, period, exponent_milli; null without a run),
    runs_sha256 of all runs as lines, collapsed_sha256.  The collapsed texts are hashed
    where they are made."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        _finder(True)(F.col("text").cast("string")).alias("f")
                        ).select("doc_id", "f.runs", "f.collapsed")
    runs = F.col("runs")
    line = F.transform(runs, lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))
    # products of whole numbers compare the quotients exactly; the first of equals stays
    best = F.aggregate(runs, F.element_at(runs, 1), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    out = found.withColumn("best", F.when(F.size(runs) > 0, best))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))
