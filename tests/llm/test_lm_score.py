import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers

from pyspark.sql import functions as F
from tests.llm.util import docs, words
from wardstat.llm import attention, lm_score
from wardstat.llm.attention import STRIDE, WINDOW, Attention
from wardstat.llm.lm_score import score_documents, words_of

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_gradients_equal_differences():
    net = Attention(12, np.arange(12.0))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(1)
    x, y = r.integers(0, 12, (2, WINDOW)), r.integers(0, 12, (2, WINDOW))
    _, g = net.gradients(x, y)
    for name, value in net.p.items():
        at = tuple(r.integers(0, s) for s in value.shape)
        keep, step = value[at], 1e-5
        value[at] = keep + step
        up, _ = net.gradients(x, y)
        value[at] = keep - step
        down, _ = net.gradients(x, y)
        value[at] = keep
        assert abs((up - down) / (2 * step) - g[name][at]) < 1e-5, name


def test_every_symbol_is_scored_once():
    net = Attention(20, np.ones(20))
    r = np.random.default_rng(2)
    for n in (0, 1, 5, WINDOW - 1, WINDOW, WINDOW + 1, 200):
        doc = r.integers(0, 20, n)
        x = np.concatenate([[0], doc])
        want = []
        for t in range(n):      # the window in which t stands after the context
            start = 0 if t < WINDOW else ((t - WINDOW) // STRIDE + 1) * STRIDE
            own = np.resize(x[start:t + 1], WINDOW)
            own[t - start + 1:] = 0
            full, _ = net._windows(own[None], np.resize(doc[t:t + 1], (1, WINDOW)), 0)
            want.append(full[0, t - start])
        assert np.allclose(net.score(doc, np.array([n]), 0)[0], want, atol=1e-4)
    both = net.score(np.concatenate([doc, doc[:7]]), np.array([n, 0, 7]), 0)
    parts = [net.score(doc, np.array([n]), 0), net.score(doc[:7], np.array([7]), 0)]
    for k in (0, 1):
        assert np.allclose(both[k], np.concatenate([p[k] for p in parts]), atol=1e-4)


def test_probabilities_sum_to_one():
    net = Attention(9, np.arange(9.0))
    total = sum(math.exp(net.score(np.array([3, 5, k]), np.array([3]), 0)[0][2])
                for k in range(9))
    assert abs(total - 1) < 1e-4


class Spelled(dict):
    """Words of the letters a-d as symbols 1-4; 1 and 2 begin a word."""
    size, frequent = 7, {b"a": 2}

    def __missing__(self, word):
        return (np.frombuffer(word, np.uint8) - 96).astype(np.uint16).tobytes(), 0.0


def test_words_sum_to_one_after_any_context():
    """The probabilities of all words, and of the end, after some words."""
    r = np.random.default_rng(6)
    begins = np.array([1, 1, 1, 0, 0], bool)
    net = Attention(5, np.arange(1, 6.0), after=r.integers(0, 9, (5, 5)).astype(float), begins=begins)
    for v in net.p.values():
        v += r.normal(0, 0.3, v.shape).astype(np.float32)
    for before in ([], [b"ac", b"b"], [b"bdd"] * 20):
        spelled, open_ended = [[b for b in (b"a", b"b")]], 0.0
        for _ in range(5):
            spelled.append([w + x for w in spelled[-1] for x in (b"c", b"d")])
        words = [w for level in spelled for w in level]

        def model(word):
            """log P(word | before), by the difference of two documents' scores."""
            docs = [[*before, *([word] if word else [])]]
            symbols = np.concatenate([*[np.frombuffer(Spelled()[w][0], np.uint16) for w in docs[0]],
                                      [0]]).astype(np.uint16)
            own, border = net.score(symbols, np.array([len(symbols)]), 0)
            at = sum(len(w) for w in before)
            end = at + (len(word) if word else 1)
            return own[at:end].sum() - border[at] + (border[end] if word else 0.0), \
                own[at:end].sum() - border[at]

        total = math.exp(model(None)[0]) + sum(math.exp(model(w)[0]) for w in words)
        # what longer words share: the longest ones, not yet ended
        open_ended = sum(math.exp(x[1]) * (1 - math.exp(x[0] - x[1])) for x in map(model, spelled[-1]))
        assert abs(total + open_ended - 1) < 1e-4
        # and the scorer's words are these, mixed half and half
        got = lm_score._scored(net, Spelled(), [[*before, b"bc"]], 3)
        logs = dict(zip(got[3][0], got[4][0]))
        assert abs(logs[b"bc"][-1] - model(b"bc")[0]) < 1e-4


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "FREQUENT_WORDS", 20)     # most words take the join
    rng = random.Random(3)
    rows = [(k, words(rng, rng.randrange(0, 80), 90).replace("w1", "The\x0bÉ")) for k in range(160)]
    rows += [(200, None), (None, "w1 w2"), (7, rows[7][1]), (201, "x" * 70_000 + " w3"),
             (202, "new " * 50), (203, "x" * 70_000)]
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    got = score_documents(docs(spark, rows, extra=True), PATH, learn, steps=5).collect()
    assert len(got) == len(rows)
    import zlib
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), t or ""))
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in split(t))
    c["<end>"] = len(train)
    n, v = sum(c.values()), len(c)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        tokens = [*split(t), "<end>"]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)
        for r in by[i]:
            assert r["n_tokens"] == len(tokens) and r["train_tokens"] == n
            assert r["n_known"] == sum(c[w] > 0 for w in tokens)
            assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
            assert math.isfinite(r["score"]) and r["score"] < 0
    assert words_of("A\x1cB\x0bÉ") == [b"a\x1cb", "É".encode()]


def test_rare_words_have_their_counts_in_the_score(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(k, words(rng, 60, 90) + " once%d" % k) for k in range(60)]
    learn, found = F.col("doc_id") % 5 != 0, []
    for size in (1 << 18, 20, 1):
        monkeypatch.setattr(lm_score, "FREQUENT_WORDS", size)
        got = score_documents(docs(spark, rows), PATH, learn, steps=5).collect()
        found.append([r["score"] for r in sorted(got, key=lambda r: r["doc_id"])])
    assert np.allclose(found[0], found[1], rtol=1e-9) and np.allclose(found[0], found[2], rtol=1e-9)


def test_model_learns_from_the_context():
    """Sequences in which each symbol follows from the one two places before."""
    r = np.random.default_rng(5)
    rows = np.empty((2000, WINDOW + 1), np.int64)
    rows[:, :2] = r.integers(0, 8, (2000, 2))
    for k in range(2, WINDOW + 1):
        rows[:, k] = (rows[:, k - 2] * 3 + 1) % 8
    net = Attention(8, np.ones(8))
    loss = net.train(rows[:1500], steps=150)
    assert loss < 0.6 * math.log(8)
    held, _ = net.score(rows[1500:, 1:].reshape(-1), np.full(500, WINDOW), 0)
    assert -held.mean() < 0.75 * math.log(8)    # far better than by frequency


def test_model_learns(spark):
    """Held-out documents score better than with the word model alone."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    got = score_documents(d, PATH, learn, steps=150)
    r = got.where(~F.col("learn")).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"),
                                       F.sum("n_tokens").alias("n")).first()
    print("a token:", r["s"] / r["n"], r["b"] / r["n"])
    assert r["s"] > r["b"]


def test_learns_from_every_training_row(spark):
    long = "z" * 200 + "x"
    rows = ([(k, "copied text of one kind " * 40) for k in range(60)]
            + [(100 + k, "w%d " % k * 30 + long) for k in range(60)])
    texts = lm_score._numbered(docs(spark, rows), F.lit(True), "doc_id", "text")
    counted = lm_score.word_counts(texts)
    symbols = lm_score.learn_symbols(counted, PATH, len(rows))
    cache = lm_score._WordSymbols(PATH, symbols)
    per_doc = [lm_score._symbols([cache[w] for w in words_of(t)]) for _, t in rows]
    assert symbols.frequency.sum() == sum(map(len, per_doc))    # long words as well
    got = lm_score.learned_from(texts, PATH, symbols, len(rows), sample_windows=100).collect()
    want = Counter(c for d in per_doc for c in zip([0, *d.tolist()], d.tolist()))
    found = Counter()
    for r in got:
        if r["pair"] is not None:
            found[divmod(r["pair"], symbols.many)] += r["n"]
    assert found == want
    drawn = [bytes(r["w"]) for r in got if r["w"] is not None]
    copies = set(lm_score.windows_of(per_doc[0]))
    total = sum(len(lm_score.windows_of(d)) for d in per_doc)
    share = 60 * len(lm_score.windows_of(per_doc[0])) / total
    assert 50 < len(drawn) < 140
    assert abs(sum(w in copies for w in drawn) / len(drawn) - share) < 0.2


def test_weights_are_learned_from_every_window(spark):
    """Each window of each training row is in one round, and the averaged model has the
    symbols' order of every partition: the second half of the rows as well as the first."""
    rows = [(k, " ".join("%s%d" % ("ab"[k % 2], j) for j in range(k % 7 * 9))) for k in range(400)]
    texts = lm_score._numbered(docs(spark, rows).repartition(5), F.lit(True), "doc_id", "text")
    texts = lm_score.cut(texts)
    counted = lm_score.word_counts(texts)
    symbols = lm_score.learn_symbols(counted, PATH, len(rows))
    learned = lm_score.learned_from(texts, PATH, symbols, len(rows)).where("w is not null")
    cache = lm_score._WordSymbols(PATH, symbols)
    want = Counter(w for _, t in rows for w in lm_score.windows_of(
        lm_score._symbols([cache[x] for x in words_of(t)])))
    assert Counter(bytes(r["w"]) for r in learned.collect()) == want
    assert {r["round"] for r in learned.collect()} == set(range(len(lm_score.ROUNDS)))
    net = Attention(symbols.many, symbols.frequency, begins=symbols.begins)
    windows = np.array([np.frombuffer(w, np.uint16) for w in want.elements()]).astype(np.int64)
    before, _ = net.gradients(windows[:, :-1], windows[:, 1:])
    assert lm_score.learn_weights(learned, net, steps=100) == sum(want.values())
    after, _ = net.gradients(windows[:, :-1], windows[:, 1:])
    assert after < 0.7 * before


def test_weights_are_averaged_by_windows():
    import pandas as pd
    rows = pd.DataFrame({"part": [1, 0], "n": [30, 10], "weights": [
        np.array([1, 2], "<f4").tobytes(), np.array([5, 2], "<f4").tobytes()]})
    n, mean = lm_score._averaged(rows)
    assert n == 40 and np.allclose(np.frombuffer(mean, "<f4"), [2, 2])
    net, other = Attention(40, np.ones(40)), Attention(40, np.ones(40), seed=8)
    other.unpack(net.packed())
    assert all((net.p[k] == other.p[k]).all() for k in net.p)


def test_words_encoded_together_have_their_own_ids():
    r = random.Random(11)
    letters = [*"abcdefgh'sdt.,!?;:-_<|>/0123", "'s", "'ll", "<|endoftext|>", "\x00", "é", "È"]
    enc = lm_score.encoder(PATH)
    for k in range(300):
        odd = ["\x1c", "\x1f", "\x85", "\xa0", "中", "\u2003", "’"] if k % 3 == 0 else []
        text = " ".join("".join(r.choices(letters + odd, k=r.randrange(1, 12)))
                        for _ in range(r.randrange(0, 30)))
        own = words_of(text)
        ids, sizes = lm_score.ids_of(enc, own)
        want = [enc.library.encode(" " + w.decode(), add_special_tokens=False).ids for w in own]
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [x for part in want for x in part]
    symbols = lm_score.Symbols(PATH, {int(k): 1 for k in ids}, 1)
    added, asked = (lm_score._WordSymbols(PATH, symbols) for _ in range(2))
    added.add([own, own, []])
    assert set(added) == set(own)
    for w in own:
        assert added[w][0] == asked[w][0] and abs(added[w][1] - asked[w][1]) < 1e-9


def test_no_array_of_a_step_or_of_scoring_grows_with_the_batch(monkeypatch):
    """Windows are computed in parts that stay in the cache, with the same sums."""
    r, seen = np.random.default_rng(8), []
    net = Attention(40, np.ones(40), after=r.integers(0, 9, (40, 40)).astype(float),
                    begins=r.random(40) < 0.4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.integers(0, 40, (70, WINDOW + 1))
    real = Attention._in_class
    monkeypatch.setattr(Attention, "_in_class", lambda self, h, *a: seen.append(len(h)) or real(self, h, *a))
    found = []
    for size in (70, 64, 16, 1):
        monkeypatch.setattr(attention, "CHUNK", size)
        found.append(net.gradients(x[:, :-1], x[:, 1:]))
        assert max(seen) == size * WINDOW
        seen.clear()
    monkeypatch.undo()
    for loss, g in found[1:]:
        assert abs(loss - found[0][0]) < 1e-9
        assert all(np.allclose(g[k], found[0][1][k], atol=1e-9) for k in g)
    monkeypatch.setattr(Attention, "_in_class", lambda self, h, *a: seen.append(len(h)) or real(self, h, *a))
    net.gradients(*np.split(np.resize(x, (512, WINDOW)), 2))
    assert max(seen) <= 64 * WINDOW         # a whole batch of 256 windows before


def test_classes_hold_every_symbol_once():
    """The two levels give each symbol its share, whatever the sizes of the classes."""
    r = np.random.default_rng(3)
    share = r.random(77)
    share /= share.sum()
    net = Attention(77, share, begins=r.random(77) < 0.3)
    start, own = net._levels(share)
    assert len(set(net.place.tolist())) == 77
    assert np.allclose(np.exp(start[net.place // 16] + own[net.place]), share, rtol=1e-4)
    total = sum(math.exp(net.score(np.array([3, 5, k]), np.array([3]), 0)[0][2]) for k in range(77))
    assert abs(total - 1) < 1e-4


def test_score_is_no_worse_than_its_part_of_the_word_model(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2
    got = score_documents(d, PATH, learn, steps=20).collect()
    assert all(r["score"] > r["base_score"] + math.log10(1 - lm_score.MIXED_IN) * r["n_tokens"] - 1e-6 for r in got)


def test_empty_tables(spark):
    none = score_documents(docs(spark, [(1, "a")]).where("false"), PATH, F.lit(True), steps=1)
    assert none.count() == 0
    unlearned = score_documents(docs(spark, [(1, "a")]), PATH, F.lit(False), steps=1).collect()
    assert unlearned[0]["base_score"] == 0 and unlearned[0]["n_known"] == 0
