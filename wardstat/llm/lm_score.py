"""Scores of texts by a causal self-attention model over subword ids, and by a
smoothed word model.

Words are runs of non-blank characters of the text with A-Z in lower case, and
an end.  The corpus is counted in Spark: how often each word occurs in the
training rows.  From that:

* The word model (base): log10((c + 1) / (N + V + 1)) summed over the tokens.
  The most frequent words go to every task as a table of fixed size; of the
  others, each document's words are joined with the counts, none is left out.
* The attention model.  A word's subwords are the ids of the public tokenizer
  for a blank and the word.  The ids that occur most are symbols of their own,
  the others share symbols by frequency and by whether they begin a word; an
  id has its share of its symbol's count in all training rows.  The model
  gives the probability of each symbol after the ones before it.  Its logits
  begin at the probabilities by the symbol before, counted over the whole of
  all training rows; its weights are learned from all windows of all training rows,
  where they lie: in rounds of growing size (``ROUNDS``), each partition goes on from
  the same weights over its windows of the round, and the weights of the partitions
  are averaged by their windows.  A small table is gone through several times.
  Every document is scored whole.  A word's
  probability is that of its first symbol among those that begin a word or end the
  text, of its other symbols, of a new beginning after them, and of its ids among
  their symbols'; so over all words and the end these add up to 1 at most (less what
  the model gives to ids that spell no word).  It counts with weight ``MIXED_IN``, for
  the rest the word model's.  For words that are not in the table the tasks
  keep the model's part of each occurrence, and the two are mixed after the
  join with the counts.

Null texts are empty (only the end).  Ids may repeat or be null: rows are told
apart by a number of their own; a null id's CRC-32 is null, and such a row is
neither held out nor learned from.  Without training rows all counts are zero.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.attention import BATCH, STEPS, WINDOW, Adam, Attention
from wardstat.llm.bpe import Encoder, encoder
from wardstat.llm.common import cut, keep_freed, text_of

OWN_SYMBOLS = 192       # ids with a symbol of their own
SHARED_SYMBOLS = 63     # symbols that the others share; one more is the end
END = 0
FREQUENT_WORDS = 1 << 18    # bound of the table of counts that each task gets
KEY_BYTES = 64          # longer words are known by a digest
# blanks to a regex engine that part no words here, and what goes to the tokenizers library
APART = re.compile("[\x1c-\x1f\x85\xa0]|[^\x00-ɏ‐-‧]")
ROUNDS = ((1, 1.0), (2, 1.0), (5, 0.8), (8, 0.5), (16, 0.25))  # part of the windows, rate
PACKS = 16              # groups of partitions whose weights are averaged first
CACHE_WORDS = 300_000
MIXED_IN = 0.5          # weight of the attention model in a word's probability
SCORED_WORDS = 1 << 16  # words of the documents that are scored together


def words_of(text: str) -> list[bytes]:
    """Words of a text: UTF-8, A-Z in lower case, split at ASCII blanks."""
    return text.encode("utf-8", "replace").lower().split()


def key_of(word: bytes) -> bytes:
    if len(word) <= KEY_BYTES:
        return word
    return b"\x00" + hashlib.blake2b(word, digest_size=32).digest()


def _numbered(docs: DataFrame, learn: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"),
                       F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       text_of(f"`{text_col}`").alias("text"), learn.alias("learn"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c, raw): words are counted in each batch before any row is shuffled;
    ``raw`` has the bytes of a word that is known by a digest."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for text in pdf["text"]:
                c.update(words_of(text))
            yield pd.DataFrame({"word": [key_of(w) for w in c], "n": list(c.values()),
                                "raw": [w if len(w) > KEY_BYTES else None for w in c]})

    return (texts.mapInPandas(count, "word binary, n long, raw binary")
            .groupBy("word", "raw").agg(F.sum("n").alias("c")))


class Symbols:
    """Ids of the tokenizer -> symbols of the model, and each id's share."""

    def __init__(self, path: str, counts: dict[int, int], ends: int):
        size = len(encoder(path).bytes_of)
        begins = np.array([b[:1] == b" " for b in encoder(path).bytes_of])
        n = np.zeros(size, np.float64)
        for k, v in counts.items():
            n[k] = v
        order = np.argsort(-n, kind="stable")
        self.symbol = np.zeros(size, np.uint16)
        own = order[:OWN_SYMBOLS]
        self.symbol[own] = 1 + np.arange(len(own))
        rest, at = order[OWN_SYMBOLS:], OWN_SYMBOLS + 1
        for group, many in ((rest[begins[rest]], SHARED_SYMBOLS // 2),
                            (rest[~begins[rest]], SHARED_SYMBOLS - SHARED_SYMBOLS // 2)):
            mass = np.cumsum(n[group] + 0.5)
            if len(group):
                self.symbol[group] = at + np.minimum(many - 1, mass * many // (mass[-1] + 1))
            at += many
        self.many = at
        # a symbol's ids all begin a word, or none does; the end begins none but ends one
        self.begins = np.zeros(at, bool)
        self.begins[self.symbol[begins]] = True
        self.begins[END] = True
        smooth = np.bincount(self.symbol, n + 0.5, minlength=at)
        self.share = np.log((n + 0.5) / smooth[self.symbol])
        self.frequency = np.bincount(self.symbol, n, minlength=at)
        self.frequency[END] = ends


def ids_of(enc: Encoder, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a blank and each word, one word after the other, and how many each word has.
    Words are encoded as one text: each one's first id is the only one that begins with a
    blank.  Words whose characters might not end a pre-token there are encoded alone."""
    texts = [" " + w.decode("utf-8", "replace") for w in words]
    together, whole = np.ones(len(texts), bool), "".join(texts)
    if not enc.fast or any(" " in t for t in enc.special):
        together[:] = False
    elif APART.search(whole):
        together[:] = [not APART.search(t) for t in texts]
    if not together.all():
        whole = "".join([t for t, own in zip(texts, together.tolist()) if own])
    ids = np.frombuffer(enc.ids(whole), np.uint32)
    sizes = np.zeros(len(texts), np.int64)
    sizes[together] = np.diff(np.flatnonzero(begins_of(enc).take(ids)), append=len(ids))
    if together.all():
        return ids, sizes
    alone = np.flatnonzero(~together).tolist()
    parts = [np.frombuffer(enc.ids(texts[k]), np.uint32) for k in alone]
    sizes[alone] = [len(part) for part in parts]
    out, joined = np.empty(sizes.sum(), np.uint32), np.repeat(together, sizes)
    out[joined], out[~joined] = ids, np.concatenate(parts)
    return out, sizes


@functools.lru_cache(maxsize=4)
def begins_of(enc: Encoder) -> np.ndarray:
    """Whether an id begins with a blank."""
    return np.array([b[:1] == b" " for b in enc.bytes_of])


class _WordSymbols(dict):
    """Word -> (its symbols as bytes, log of its ids' shares); with the counts of the
    frequent words and the denominator of the word model.  Words are kept in two
    generations, so those in use stay when it is full."""

    def __init__(self, path: str, symbols: Symbols, frequent: dict[bytes, int] | None = None,
                 size: int = 1):
        super().__init__()
        self.enc, self.frequent, self.size = encoder(path), frequent or {}, size
        self.symbol, self.share = symbols.symbol, symbols.share
        self.older: dict[bytes, tuple[bytes, float]] = {}

    def __missing__(self, word: bytes):
        out = self.older.get(word)
        if out is None:
            ids = np.frombuffer(self.enc.ids(" " + word.decode("utf-8", "replace")), np.uint32)
            out = self.symbol.take(ids).tobytes(), float(self.share.take(ids).sum())
        self._keep(word, out)
        return out

    def _keep(self, word: bytes, out: tuple[bytes, float]) -> None:
        if len(word) <= KEY_BYTES:
            if len(self) >= CACHE_WORDS // 2:
                self.older = dict(self)
                self.clear()
            self[word] = out

    def add(self, documents: list[list[bytes]]) -> None:
        """Encodes the documents' words that are not kept yet, all at once."""
        new = list({w for d in documents for w in d if w not in self and w not in self.older})
        if not new:
            return
        ids, sizes = ids_of(self.enc, new)
        starts = np.cumsum(sizes) - sizes
        raw = self.symbol.take(ids).tobytes()
        shares = np.add.reduceat(self.share.take(ids), starts).tolist()
        for word, at, size, share in zip(new, starts.tolist(), sizes.tolist(), shares):
            self._keep(word, (raw[2 * at:2 * (at + size)], share))


def _symbols(pairs) -> np.ndarray:
    """Symbols of a document's words, and its end."""
    return np.append(np.frombuffer(b"".join([p[0] for p in pairs]), np.uint16), np.uint16(END))


def _scored(net: Attention, cache: _WordSymbols, documents: list[list[bytes]], ends: int) -> tuple:
    """Of documents given by their words: n_tokens, n_known and the sum of
    log10(c + 1) among the frequent words and the end, the other words with the
    model's log probability of each occurrence, and the score without these."""
    index: dict[bytes, int] = {b"": 0}      # no word is empty: this is the end
    put = index.setdefault
    flat = np.array([put(w, len(index)) for d in documents for w in (*d, b"")], np.int64)
    many = np.array([len(d) + 1 for d in documents])
    first = np.cumsum(many) - many
    unique = list(index)
    of = [cache[w] for w in unique[1:]]
    c = np.array([ends, *[cache.frequent.get(key_of(w), 0) for w in unique[1:]]])
    raw = [np.array([END], np.uint16).tobytes(), *[p[0] for p in of]]
    size = np.array([len(b) // 2 for b in raw])
    share = np.array([0.0, *[p[1] for p in of]])
    # symbols of all words in order
    length = size[flat]
    where = np.repeat((np.cumsum(size) - size)[flat] - (np.cumsum(length) - length), length)
    symbols = np.frombuffer(b"".join(raw), np.uint16)[where + np.arange(len(where))]
    by_symbol, border = net.score(symbols, np.add.reduceat(length, first), END)
    start = np.cumsum(length) - length
    # a word's first symbol among those that begin one, and that the next begins one
    opened = border[start]
    closed = np.append(opened[1:], 0.0)
    closed[flat == 0] = 0       # nothing follows the end
    by_word = np.add.reduceat(by_symbol, start) + share[flat] - opened + closed
    rare = (c == 0)[flat] & (flat > 0)
    mixed = np.logaddexp(by_word + math.log(MIXED_IN),
                         (np.log((c + 1) / cache.size) + math.log(1 - MIXED_IN))[flat])
    mixed[rare] = 0
    score = np.add.reduceat(mixed, first) / math.log(10)
    known = np.add.reduceat((c > 0)[flat].astype(np.int64), first)
    log_sum = np.add.reduceat(np.log10(c + 1)[flat], first)
    # words that are not frequent, by document
    owner = np.repeat(np.arange(len(documents)), many)
    keys, parts = (owner * len(unique) + flat)[rare], by_word[rare]
    order = np.argsort(keys, kind="stable")
    parts = parts[order]
    pairs, starts = np.unique(keys[order], return_index=True)
    words: list[list[bytes]] = [[] for _ in documents]
    logs: list[list[list[float]]] = [[] for _ in documents]
    for k, a, b in zip(pairs.tolist(), starts.tolist(), [*starts[1:].tolist(), len(parts)]):
        words[k // len(unique)].append(key_of(unique[k % len(unique)]))
        logs[k // len(unique)].append(parts[a:b].tolist())
    return many, known, log_sum, words, logs, score


def learn_symbols(counts: DataFrame, path: str, ends: int) -> Symbols:
    """Subword counts from the counts of words: each word is encoded once.  The
    driver gets a row per id of the vocabulary at most."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        total = np.zeros(len(enc.bytes_of), np.int64)
        for pdf in batches:
            words = [bytes(w if raw is None else raw) for w, raw in zip(pdf["word"], pdf["raw"])]
            ids, sizes = ids_of(enc, words)
            np.add.at(total, ids, np.repeat(pdf["c"].to_numpy(), sizes))
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen.astype(np.int32), "n": total[seen]})

    rows = (counts.mapInPandas(encode, "id int, n long").groupBy("id")
            .agg(F.sum("n").alias("n")).collect())
    return Symbols(path, {r["id"]: r["n"] for r in rows}, ends)


def windows_of(doc: np.ndarray) -> list[bytes]:
    """A document's symbols after the start, in windows; a short one is repeated
    to the length of a window."""
    x = np.concatenate([[END], doc]).astype(np.uint16)
    if len(x) <= WINDOW:
        x = np.resize(x, WINDOW + 1)
    return [x[k:k + WINDOW + 1].tobytes() for k in range(0, len(x) - WINDOW, WINDOW)]


def learned_from(training: DataFrame, path: str, symbols: Symbols, n_docs: int,
                 sample_windows: int | None = None) -> DataFrame:
    """(w, round, pair, n): every window of every training row with the round that it is
    learned in, or how often ``pair`` (symbol before * number of symbols + symbol)
    occurs, once for each partition, over the whole of every training row.  A caller
    that wants no more than about ``sample_windows`` of the windows gets them drawn each
    by itself, so copies of a text in proportion; the model learns from all."""
    many, share = symbols.many, 1.0
    if sample_windows is not None:
        share = min(1.0, sample_windows / max(1.0, symbols.frequency.sum() / WINDOW + n_docs))
    turns = np.cumsum([part for part, _ in ROUNDS]) / sum(part for part, _ in ROUNDS)

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, pairs = encoder(path), np.zeros(many * many, np.int64)
        for pdf in batches:
            drawn, rounds, codes, size = [], [], [], 0
            split = [words_of(text) for text in pdf["text"]]
            ids, sizes = ids_of(enc, [w for own in split for w in own])
            of_batch = symbols.symbol.take(ids)
            ends = np.append(0, np.cumsum(sizes))[np.cumsum([len(own) for own in split])].tolist()
            for row, start, end in zip(pdf["row"], [0, *ends], ends):
                doc = np.append(of_batch[start:end], np.uint16(END))
                codes.append(np.concatenate([[END], doc[:-1]]) * np.int64(many) + doc)
                size += len(doc)
                if size > SCORED_WORDS:
                    pairs += np.bincount(np.concatenate(codes), minlength=many * many)
                    codes, size = [], 0
                windows = windows_of(doc)
                at = np.random.default_rng(row).random(len(windows)) / share
                taken = np.flatnonzero(at < 1)
                drawn += [windows[k] for k in taken]
                rounds.append(np.searchsorted(turns, at[taken], side="right"))
            if codes:
                pairs += np.bincount(np.concatenate(codes), minlength=many * many)
            yield pd.DataFrame({"w": drawn, "round": np.concatenate(rounds or [[]]).astype(np.int32),
                                "pair": None, "n": None})
        seen = np.flatnonzero(pairs)
        yield pd.DataFrame({"w": None, "round": None, "pair": seen, "n": pairs[seen]})

    return cut(training.select("row", "text").mapInPandas(
        gather, "w binary, round int, pair long, n long"))


def _averaged(rows: pd.DataFrame) -> tuple[int, bytes]:
    """Windows, and the mean of the weights by windows, of (part, n, weights)."""
    rows = rows.sort_values("part")
    total = int(rows["n"].sum())
    mean = sum(np.frombuffer(w, "<f4") * (n / total) for n, w in zip(rows["n"], rows["weights"]))
    return total, mean.astype("<f4").tobytes()


def learn_weights(windows: DataFrame, model: Attention, steps: int = STEPS) -> int:
    """Learns ``model`` from all ``windows`` (w, round): in each round every partition goes
    over its windows from the weights of the last, and the weights are averaged.  Gives how
    many windows it went over, repeats aside.  The driver gets ``PACKS`` sets of weights a
    round at most."""
    total = windows.count()
    # a partition of a small table goes over its windows until it has made the steps
    batches = max(1, total // BATCH // windows.rdd.getNumPartitions())
    passes = -(-steps // batches)
    learned = 0
    for turn, (_, rate) in enumerate(ROUNDS):
        send = windows.sparkSession.sparkContext.broadcast(model)

        def go_over(batches: Iterator[pd.DataFrame], turn=turn, rate=rate,
                    send=send) -> Iterator[pd.DataFrame]:
            keep_freed()
            part, done = TaskContext.get().partitionId(), 0
            net = copy.deepcopy(send.value)     # others of this worker begin there as well
            adam, rng = Adam(net), np.random.default_rng([turn, part])
            for pdf in batches:
                own = np.frombuffer(b"".join(pdf["w"]), np.uint16).reshape(-1, WINDOW + 1)
                for _ in range(passes):
                    order = rng.permutation(len(own))
                    for batch in np.array_split(order, -(-len(own) // BATCH) or 1):
                        if len(batch):
                            adam.step(own[batch].astype(np.int64), rate)
                done += len(own)
            if done:
                yield pd.DataFrame({"part": [part], "n": [done], "weights": [net.packed()]})

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            n, weights = _averaged(rows)
            return pd.DataFrame({"part": [rows["part"].min() % PACKS], "n": [n],
                                 "weights": [weights]})

        kind = "part long, n long, weights binary"
        rows = (windows.where(F.col("round") == turn).select("w").mapInPandas(go_over, kind)
                .groupBy(F.col("part") % PACKS).applyInPandas(pack, kind)).collect()
        if rows:
            n, weights = _averaged(pd.DataFrame([r.asDict() for r in rows]))
            model.unpack(weights)
            learned += n
        send.unpersist()
    return learned


def learn_model(training: DataFrame, path: str, symbols: Symbols, n_docs: int,
                steps: int = STEPS) -> Attention:
    """The model.  The driver gets a row per pair of symbols, and weights."""
    learned = learned_from(training, path, symbols, n_docs)
    after = np.zeros(symbols.many ** 2)
    for r in (learned.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n"))
              .collect()):
        after[r["pair"]] = r["n"]
    model = Attention(symbols.many, symbols.frequency,
                      after=after.reshape(symbols.many, symbols.many), begins=symbols.begins)
    learn_weights(learned.where("w is not null").select("w", "round"), model, steps)
    return model


def frequent_words(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words with their counts, FREQUENT_WORDS at most: those from a
    count on, which the sizes of classes of like counts give, so nothing is sorted and
    the driver gets no more than it keeps."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    sizes = {r["step"]: r["n"] for r in counts.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    total, least = 0, None
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > FREQUENT_WORDS:
            break
        least = k
    if least is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in counts.where(step >= least).collect()}


def score_documents(docs: DataFrame, tokenizer_path: str, learn: Column, id_col: str = "doc_id",
                    text_col: str = "text", steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, learn, n_tokens, n_known, train_tokens,
    base_score, score.  ``learn`` marks the training rows."""
    texts = _numbered(docs, F.coalesce(learn, F.lit(False)), id_col, text_col)
    training = texts.where("learn")
    counted = cut(word_counts(training))
    counts = counted.select("word", "c")
    ends = training.count()
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_words = size["n"] or 0
    train_tokens = n_words + ends
    tokens_and_words = train_tokens + size["v"] + bool(ends) + 1
    floor = math.log10(tokens_and_words)
    symbols = learn_symbols(counted, tokenizer_path, ends)
    model = learn_model(training, tokenizer_path, symbols, ends, steps)
    frequent = frequent_words(counts)
    send = docs.sparkSession.sparkContext.broadcast((frequent, symbols, model))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, own, net = send.value
        keep_freed()
        cache = _WordSymbols(tokenizer_path, own, common, tokens_and_words)
        names = ["n_tokens", "known", "log_sum", "rare", "logs", "score"]
        for pdf in batches:
            waiting, size, at = [], 0, 0
            for k, text in enumerate(pdf["text"], 1):
                waiting.append(words_of(text))
                size += len(waiting[-1]) + 1
                if size > SCORED_WORDS or k == len(pdf):
                    cache.add(waiting)
                    got = _scored(net, cache, waiting, ends)
                    yield pd.concat([
                        pdf[["row", "doc_id", "learn"]].iloc[at:k].reset_index(drop=True),
                        pd.DataFrame(dict(zip(names, got)))], axis=1)
                    waiting, size, at = [], 0, k

    scored = cut(texts.mapInPandas(
        score, "row long, doc_id long, learn boolean, n_tokens long, known long, log_sum double, "
               "rare array<binary>, logs array<array<double>>, score double"))
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "logs")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.logs").alias("logs"))
    rare = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    by_word = F.log((F.col("c") + 1) / tokens_and_words) + math.log(1 - MIXED_IN)

    def add(total: Column, own: Column) -> Column:
        x = own + math.log(MIXED_IN)
        return total + F.greatest(x, by_word) + F.log1p(F.exp(-F.abs(x - by_word)))

    rare = rare.groupBy("row").agg(
        F.sum(F.size("logs") * F.log10(F.col("c") + 1)).alias("rare_sum"),
        F.sum(F.when(F.col("c") > 0, F.size("logs")).otherwise(0)).alias("rare_known"),
        (F.sum(F.aggregate("logs", F.lit(0.0), add)) / math.log(10)).alias("rare_score"))
    n_known = F.col("known") + F.coalesce("rare_known", F.lit(0))
    base = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * floor
    return scored.drop("rare", "logs").join(rare, "row", "left").select(
        "doc_id", "learn", "n_tokens", n_known.alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"))
