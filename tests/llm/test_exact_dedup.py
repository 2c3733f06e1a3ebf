import hashlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.util import docs, rows_of
from wardstat.llm import exact_dedup as E


def test_groups_equal_brute_force(spark):
    texts = ["a", "b", "a", None, "", "x" * 5000, "x" * 5000, "x" * 4999 + "y", "A", "a ", "é",
             "p" * 300 + "1", "p" * 300 + "2", "p" * 300 + "1"] + ["hot"] * 50
    rows = list(enumerate(texts))
    got = rows_of(E.exact_dedup(docs(spark, rows, extra=True),
                                digests=[F.sha2("text", 256).alias("text_sha256")]),
                  "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    plain = [t or "" for t in texts]
    n, last = Counter(plain), {t: k for k, t in enumerate(plain)}
    assert got == [(k, last[t], n[t], last[t] == k, hashlib.sha256(t.encode()).hexdigest())
                   for k, t in enumerate(plain)]


def test_ties_nulls_and_small_sieve(spark, monkeypatch):
    monkeypatch.setattr(E, "SIEVE_SLOTS", 2)    # rows that share a slot change no result
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "n"), (None, "n"), (3, "b")]
    got = E.exact_dedup(docs(spark, rows)).collect()
    a = [r for r in got if r["group_size"] == 3]
    assert len(a) == 3 and all(r["keep_id"] == 1 for r in a) and sum(r["kept"] for r in a) == 1
    n = [r for r in got if r["group_size"] == 2]
    assert [r["keep_id"] for r in n] == [None, None] and sum(r["kept"] for r in n) == 1
    assert E.exact_dedup(docs(spark, rows).where("false")).count() == 0
