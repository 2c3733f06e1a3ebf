import random

import numpy as np

from tests.llm.util import docs, words
from wardstat.llm import common, order_minhash
from wardstat.llm.components import components
from wardstat.llm.order_minhash import alignment, near_classes, sequence, sketch


def label(text, size=5):
    w = (text or "").lower().split()
    out, seen = [], {}
    for k in range(max(1, len(w) - size + 1) if w else 0):
        s = tuple(w[k:k + min(size, len(w))])
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def similarity(a, b):
    """Longest common subsequence of the labelled shingles, by the plain table."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for k, y in enumerate(b):
            left, row[k + 1] = row[k + 1], (left + 1 if x == y else max(row[k + 1], row[k]))
    return row[-1] / (len(a) + len(b) - row[-1])


def brute(texts):
    labels = [label(t) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            if similarity(labels[i], labels[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(k) for k in range(len(texts))]


def edits(rng, text, n):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k:k + rng.choice([0, 1, 2])] = [f"new{rng.randrange(10**6)}"]
    return " ".join(w)


def test_alignment_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        a = words(rng, rng.randrange(5, 120), rng.choice([5, 10**6]))
        b = edits(rng, a, rng.randrange(0, 6))
        if rng.random() < 0.3:
            w = b.split()
            b = " ".join(w[len(w) // 8:] + w[:len(w) // 8])
        want, got = similarity(label(a), label(b)), alignment(sequence(a), sequence(b))
        assert got == want if want >= 0.8 else got < 0.8


def test_sketch_depends_on_the_order():
    rng = random.Random(4)
    seq = sequence(words(rng, 300, 10**6))
    assert sketch(seq) == sketch(seq.copy())
    shuffled = seq[np.random.default_rng(1).permutation(len(seq))]
    assert len(set(sketch(seq)) & set(sketch(shuffled))) < 10
    assert len(sketch(seq[:2])) == 16


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 4), (7, 7), (20, 21), (21, 22), (22, 20), (30, 31)]
    links += [(100, k) for k in range(101, 200)] + [(k, k + 1) for k in range(300, 340)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 10, 20, 21, 22, 30, 31)} == {
        1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30}
    assert all(got[k] == 100 for k in range(100, 200))
    assert all(got[k] == 300 for k in range(300, 341))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_equal_brute_force(spark):
    rng = random.Random(8)
    passage = words(rng, 70, 10**6)
    texts = []
    for _ in range(12):
        base = words(rng, rng.randrange(60, 150), 10**6)
        texts += [edits(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(1, 5))]
    hot = words(rng, 100, 10**6)
    texts += [edits(rng, hot, 1) for _ in range(40)] + [hot] * 10
    # a passage that most of many different texts share, and near copies among them
    for _ in range(25):
        own = passage + " " + words(rng, 25, 10**6)
        texts += [own, edits(rng, own, 1)]
    texts += ["a b", "A  b", "a c", "one", "", None, " ", ""]
    rng.shuffle(texts)
    want = brute(texts)
    got = {r["doc_id"]: r for r in
           near_classes(docs(spark, list(enumerate(texts)), extra=True)).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        assert got[k]["class_id"] == want[k], (k, texts[k])
        assert got[k]["class_size"] == want.count(want[k])
        assert got[k]["kept"] == (want[k] == k)


def test_nulls_repeats_and_empty_tables(spark):
    rng = random.Random(5)
    t = words(rng, 50)
    rows = near_classes(docs(spark, [(7, t), (7, t), (None, t), (None, "x y z"), (None, "x y z"),
                                     (9, t * 200)])).collect()
    big = [r for r in rows if r["class_size"] == 3]
    assert len(big) == 3 and {r["class_id"] for r in big} == {7} and sum(r["kept"] for r in big) == 1
    assert all(r["doc_id"] == 7 for r in big if r["kept"])
    none = [r for r in rows if r["class_id"] is None]
    assert len(none) == 2 and sum(r["kept"] for r in none) == 1
    assert near_classes(docs(spark, [(1, "a")]).where("false")).count() == 0


def test_sequences_are_filtered_in_the_scan(spark, monkeypatch):
    """No sequence is shuffled to find those of the pairs, however many pairs there are."""
    frames = []

    def cut(df, *sort):
        frames.append(df)
        return common.cut(df, *sort)

    monkeypatch.setattr(order_minhash, "cut", cut)
    rng = random.Random(8)
    texts = [words(rng, 60, 10**6) for _ in range(30)]
    texts += [edits(rng, t, 1) for t in texts[:10]]
    table = docs(spark, list(enumerate(texts)))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near_classes(table)
        assert got.where("class_size = 2").count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    some = [df for df in frames if df.columns == ["node", "seq"]]
    assert some
    for df in some:
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    sought = spark.range(0, 40, 3).toDF("node")
    rows = spark.range(40).toDF("node")
    found = {r["node"] for r in order_minhash._of(sought, rows).collect()}
    assert found >= set(range(0, 40, 3)) and len(found) < 40


def test_a_round_of_components_groups_three_times(spark, monkeypatch):
    written = []

    def cut(df, *sort):
        written.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hash"))
        return common.cut(df, *sort)

    monkeypatch.setitem(components.__globals__, "cut", cut)
    links = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(9, 9), (7, 8), (8, 7)],
                                  "a long, b long")
    got = {(r["node"], r["root"]) for r in components(links).collect()}
    assert got == {(k, 0) for k in range(6)} | {(7, 7), (8, 7)}
    rounds = len(written) // 4      # one table of links, and four a round
    assert rounds and sum(written) == 1 + 3 * rounds
