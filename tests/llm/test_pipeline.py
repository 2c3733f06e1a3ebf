import random

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_line_dedup, test_order_minhash, test_packing, test_secrets
from tests.llm.util import docs, words
from wardstat.llm.common import cut


def brute_redact(text):
    spans = [tuple(map(int, s.split(":")[1:])) for s in test_secrets.brute(text)[-1].split(",") if s]
    out, at = "", None
    for a, b in sorted(spans):
        if at is None or a >= at:
            out += text[at or 0:a] + "[REDACTED]"
        at = max(at or 0, b)
    return out + text[at or 0:]


def english(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "house", "river", "stone", "walk", "green",
                                "light", f"{rng.choice('bcdfg')}a{rng.choice('klmnp')}e",
                                f"{rng.choice('str')}o{rng.choice('wxyz')}i"]) for _ in range(n))


def test_stages_equal_brute_force(spark):
    rng = random.Random(3)
    shared = english(rng, 70)
    texts = [None, "", "1234 !!", "password = abcdefgh12 the house"]
    for k in range(30):
        t = english(rng, rng.randrange(20, 120))
        texts += [t + ("\n" + shared if k % 3 == 0 else ""), t if k % 5 == 0 else english(rng, 40)]
        if k % 4 == 0:
            w = t.split()
            w[len(w) // 2] = "changed"
            texts.append(" ".join(w))
        if k % 7 == 0:
            texts.append("the key is AKIA" + "".join(rng.choices("ABC234", k=16)) + "\n" + t + " x")
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    now = docs(spark, rows)
    columns = now.columns
    want = dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, None))
        if name == "language_id":
            want = {k: t for k, t in want.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            left = test_line_dedup.brute(list(want.items()))
            keys = list(want)
            want = {keys[n]: t for n, t in left.items() if t.strip()}
        elif name == "near_dedup":
            keys = sorted(want)
            roots = test_order_minhash.brute([want[k] for k in keys])
            want = {k: want[k] for n, k in enumerate(keys) if roots[n] == n}
        elif name == "secrets":
            want = {k: brute_redact(t) for k, t in want.items()}
        if name != "packing":
            assert now.columns == columns
            got = {r["doc_id"]: r["text"] for r in now.collect()}
            assert got == want, name
            assert all(r["n_chars"] == len(r["text"]) for r in now.collect())
        else:
            keys = sorted(want)
            got = [r.asDict() | {"doc_id": keys.index(r["doc_id"])} for r in now.collect()]
            test_packing.check_packing(got, [want[k] for k in keys], 2048)


def test_empty_and_odd_tables(spark):
    for rows in ([], [(None, None), (1, ""), (1, "")], [(None, words(random.Random(1), 30), "en")] * 3):
        now = docs(spark, rows, extra=True) if rows else docs(spark, [(1, "a")]).where("false")
        for _, stage in corpus_pipeline.STAGES:
            now = cut(stage(spark, now, None))
        now.collect()


def test_batches_for_python_are_bounded_in_bytes(spark):
    """Long texts do not wait in a task by the ten thousand."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    table = spark.range(6000, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.expr("repeat('abcde ', 1000)").alias("text"),
        F.lit("en").alias("lang"))

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)]})

    for own in (None, "1m"):
        spark.conf.unset(name)
        if own:
            spark.conf.set(name, own)
        try:
            stage = corpus_pipeline.language_id(spark, table, "")
            most = stage.mapInPandas(sizes, "n int").agg(F.max("n")).first()[0]
        finally:
            spark.conf.unset(name)
        assert most * 6000 <= (1 << 20 if own else 1 << 22) + 6000
