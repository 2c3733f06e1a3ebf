import hashlib
import random

import numpy as np

from tests.llm.util import docs, rows_of, words
from wardstat.llm.fingerprints import (edited_fingerprints, fingerprint, likeness, similar_links)
from wardstat.llm.shingles import labelled, shingle_hashes, word_hashes


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[k:k + min(size, len(w))]) for k in range(max(1, len(w) - size + 1))} if w else set()


def test_words_and_shingles():
    a, b = word_hashes("The  cat\tSAT é"), word_hashes("the cat sat é")
    assert len(a) == 4 and (a == b).all() and len(set(a.tolist())) == 4
    assert len(word_hashes("")) == len(word_hashes(" \n ")) == 0
    assert len(shingle_hashes(word_hashes("a b"))) == 1
    assert len(shingle_hashes(word_hashes("a b c d e f"))) == 2
    rng = random.Random(1)
    text = words(rng, 3000, 12)
    h = shingle_hashes(word_hashes(text))
    assert len(set(h.tolist())) == len(shingles(text))
    assert len(set(labelled(h).tolist())) == len(h)


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    for keep in (0, 100, 300, 390, 400):
        w = words(rng, 400, 10**6).split()
        a, b = " ".join(w), " ".join(w[:keep] + words(rng, 400 - keep, 10**6).split())
        j = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
        assert abs(likeness(fingerprint(a), fingerprint(b)) - j) < 0.15


def test_likeness_of_long_texts():
    rng = random.Random(8)
    for n in (20_000, 100_000, 300_000):
        w, other = (words(rng, n, 10**6).split() for _ in range(2))
        for keep in (0, n // 2, n - n // 4):
            a, b = " ".join(w), " ".join(w[:keep] + other[keep:])
            x, y = (set(shingle_hashes(word_hashes(t)).tolist()) for t in (a, b))
            got = likeness(fingerprint(a), fingerprint(b))
            assert abs(got - len(x & y) / len(x | y)) < (0.15 if keep else 0.01)


def test_edited_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k * 3 % 101, rng.choice(["é", ""]) + words(rng, rng.randrange(0, 60)))
            for k in range(101)] + [(500, None), (None, "no id here"), (501, "x " * 20_000),
                                    (502, "a b c"), (503, "")]
    got = {r["doc_id"]: r for r in edited_fingerprints(docs(spark, rows, extra=True)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        edited = t[:len(t) - len(t) // 4] + after[:len(t) // 4]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(t).tobytes().hex()
        assert r["edited_fingerprint"] == fingerprint(edited).tobytes().hex()
        assert r["near_next"] == likeness(fingerprint(t), fingerprint(after))


def test_small_tables(spark):
    one = edited_fingerprints(docs(spark, [(1, "a b c d e f g h")])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    same = edited_fingerprints(docs(spark, [(1, "a b"), (1, "a b"), (1, "c d")])).collect()
    assert len(same) == 3
    assert edited_fingerprints(docs(spark, [(1, "a")]).where("false")).count() == 0


def test_links_equal_brute_force(spark):
    rng = random.Random(6)
    base = [words(rng, 120, 10**6) for _ in range(6)]
    texts = []
    for t in base:
        texts.append(t)
        for cut_off in (1, 4, 60):
            texts.append(" ".join(t.split()[cut_off:]))
    texts += [base[0], None, ""]
    got = rows_of(similar_links(docs(spark, list(enumerate(texts)), extra=True)))
    for i, j, s in got:
        a, b = shingles(texts[i]), shingles(texts[j])
        assert i > j and abs(s - len(a & b) / len(a | b)) < 1e-12 and s >= 0.8
    linked = {i for i, _, _ in got}
    assert linked == {k for k in range(24) if k % 4 in (1, 2)} | {24}
    assert np.isfinite([s for _, _, s in got]).all()
