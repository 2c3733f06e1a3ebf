"""Language identification by rank-order profiles.

A profile is a language's most frequent n-grams (1 to 3 letters, word edges
included) in order of frequency.  A document's own most frequent n-grams are
compared with each profile by out-of-place distance: the sum of the
differences in rank, with a fixed penalty for an n-gram the profile lacks.

Profiles are learned from a bounded sample of the labelled texts, at most about
``sample_docs`` different ones per language in expectation (chosen by a hash, all
of languages with fewer); every text is predicted whole.

Null texts and texts without a letter get ``und`` with score 0.  Null labels
are not learned.  Ties of frequency go to the smaller n-gram code, ties of
distance to the first language by name.  Without a labelled row every text
gets ``und``.  Repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardstat.llm.common import cut, give_back

PROFILE_GRAMS = 300
SAMPLE_DOCS = 3000
UNKNOWN = "und"
SPACE = 32


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> code point of the lower-case letter, a blank for others."""
    table = np.full(0x110000, SPACE, np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            table[k] = ord(c.lower()[0])
    return table


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of a text (three code points of 21 bits in a 64-bit code) and how
    often each occurs, in order of the code; empty without a letter."""
    a = _letters()[np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)]
    blank = a == SPACE
    keep = np.ones(len(a), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    a = a[keep].astype(np.uint64)
    if len(a) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.uint64(21)
    two = (a[:-1] << bits) | a[1:]
    three = (two[:-1] << bits) | a[2:]
    inner = a != SPACE
    return np.unique(np.concatenate([a[inner], two, three[inner[1:-1]]]), return_counts=True)


def top_grams(text: str, size: int = PROFILE_GRAMS) -> np.ndarray:
    codes, counts = gram_counts(text)
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The learned profiles, as one table of ranks over all their n-grams."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE_GRAMS):
        self.size = size
        self.langs = sorted(ranked)
        self.codes = np.unique(np.array([c for g in ranked.values() for c in g], np.uint64))
        self.ranks = np.full((len(self.codes), len(self.langs)), -1, np.int32)
        for k, lang in enumerate(self.langs):
            own = np.array(ranked[lang], np.uint64)
            self.ranks[np.searchsorted(self.codes, own), k] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Nearest language, and one minus the share of the largest possible
        distance to it."""
        top = top_grams(text, self.size) if text else ()
        if not len(top) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == top)[:, None], self.ranks[at], -1)
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None]))
        distance = away.sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (len(top) * self.size))


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang",
                   size: int = PROFILE_GRAMS, sample_docs: int = SAMPLE_DOCS) -> Profiles:
    """Profiles of the languages in ``labelled``.  The driver gets ``size`` rows
    per language."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"),
                           F.col(f"`{lang_col}`").cast("string").alias("lang"),
                           F.xxhash64(F.col(f"`{text_col}`")).alias("place")).where(
        "lang is not null and text is not null")
    per_lang = {r["lang"]: r["n"] for r in
                rows.groupBy("lang").agg(F.count_distinct("place").alias("n")).collect()}
    if not per_lang:
        return Profiles({}, size)
    share = F.create_map(*[F.lit(x) for lang, n in per_lang.items()
                           for x in (lang, min(1.0, sample_docs / n))])
    # Texts are drawn by their hash; copies of a text are one sample, not many.
    drawn = F.pmod("place", F.lit(1 << 20)) / F.lit(1 << 20) < share[F.col("lang")]
    sample = rows.where(drawn).dropDuplicates(["lang", "place"]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                # text by text: what is held are the counts, not the texts side by side
                codes, counts = zip(*map(gram_counts, texts))
                every, at = np.unique(np.concatenate(codes), return_inverse=True)
                n = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": every.astype(np.int64), "n": n})
            give_back()

    # written down: the corpus is scanned once, however many languages there are
    grams = cut(sample.mapInPandas(count, "lang string, gram long, n long")
                .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    # the limit reaches the tasks that read, so no task sorts a language's n-grams
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = grams.withColumn("place", place).where(F.col("place") <= size)
    ranked: dict[str, list[int]] = {}
    for r in sorted(best.select("lang", "place", "gram").collect()):
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def predicted(text: Column, profiles: Profiles) -> Column:
    """Column struct(lang_pred, score) of a text column."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])
        give_back()
        return out

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      predicted(F.col(f"`{text_col}`"), profiles).alias("p"))
    return own.select("doc_id", "p.lang_pred", "p.score")
