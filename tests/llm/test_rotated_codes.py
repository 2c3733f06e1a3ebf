import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF, rows_of
from wardstat.llm import rotated_codes as R
from wardstat.llm.rotated_codes import Queries, code_length, encode, nearest, rotated

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def dot(a, b):
    return math.fsum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, b))


def brute(rows, asked, top):
    """(query_id, rank, vec_id, score) of all queries; repeated rows are rows of their own."""
    rows = [r for r in rows if r[0] is not None and usable(r[1])]
    out = []
    for k, (q, v, *_) in enumerate(rows):
        if asked(q):
            near = sorted((-round(dot(v, w), 9), i) for j, (i, w, *_) in enumerate(rows) if j != k)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near[:top])]
    return sorted(out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def test_rotation_keeps_inner_products():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 24))
    y = rotated(x, 128)
    assert np.allclose(y @ y.T, x @ x.T)
    assert code_length(64) == 256 and code_length(1) == 64


def test_estimates_stay_in_their_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(2000, 48)) * 3, rng.normal(size=(60, 48))
    codes, norm, f = encode(x, code_length(48))
    assert codes.shape == (2000, 4) and codes.dtype == np.uint64
    assert np.allclose(norm, np.linalg.norm(x, axis=1)) and (f > 0.7).all() and (f <= 1).all()
    ones = np.bitwise_count(codes).sum(axis=1)
    est, bound = Queries(q, code_length(48)).estimates(slice(0, 60), codes, ones, norm, f)
    error = est - q @ x.T
    assert (np.abs(error) > bound).mean() < 0.02
    # unbiased, and as wide as the bound says
    assert abs((error / bound).mean()) < 0.02 and 0.2 < (error / bound).std() < 0.45


@pytest.mark.parametrize("seed", [1, 2])
def test_small_tables_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 5)], 1) for i in range(60)]
    rows += [(3, rows[3][1], 0), (100, rows[20][1], 0), (100, rows[20][1], 0), (7, rows[8][1], 0),
             (40, None, 1), (60, [0.0] * 5, 1), (80, [1.0, None, 0.0, 0.0, 0.0], 1),
             (120, [float("nan")] * 5, 1), (140, [float("inf")] + [0.0] * 4, 1), (None, [1.0] * 5, 1),
             (160, [2.0, 1.0], 1), (180, [], 1), (-20, [-0.0, 1.0, 0.0, 0.0, 0.0], 1),
             (200, [0.0, 1.0, 0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 as rank", "2 as score", "'x' as v", "3 as k1", "4 as query_id", "5 as n")
    for top in (3, 20, 500):
        got = nearest(table, F.col("vec_id") % 20 == 0, top)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        # with so few vectors and dimensions every candidate is within its bound or exact
        assert found(got) == brute(rows, lambda i: i % 20 == 0, top)


def test_rounds_and_doubles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=16).tolist(), 1) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    one = rows_of(nearest(table, F.col("vec_id") % 3 == 0, 5))
    monkeypatch.setattr(R, "QUERY_BYTES", 16 * 8 * 30)
    monkeypatch.setattr(R, "SAMPLE_BYTES", 16 * 8 * 50)
    many = rows_of(nearest(table, F.col("vec_id") % 3 == 0, 5))
    assert len(one) == len(many) == 500
    assert len({r[:3] for r in one} & {r[:3] for r in many}) >= 495
    x = np.array([r[1] for r in rows])
    for q, rank, i, score in many:
        assert abs(score - x[q] @ x[i]) < 1e-12


def test_hot_vector_and_no_queries(spark):
    hot = [0.5] * 8
    rows = [(k, hot if k % 3 == 0 else [k / 100, 1.0] + [0.0] * 6, 0) for k in range(3000)]
    got = nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 60 == 0, 20)
    lists = {}
    for r in got.collect():
        lists.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert len(lists) == 50
    for q, near in lists.items():
        x = np.array([r[1] for r in rows], np.float32).astype(float)
        s = x @ x[q]
        s[q] = -np.inf
        want = sorted(range(3000), key=lambda i: (-s[i], i))[:20]
        assert [i for _, i in sorted(near)] == want
    table = spark.createDataFrame(rows, SCHEMA)
    assert nearest(table, F.col("vec_id") < 0).count() == 0
    assert nearest(table.where("false"), F.col("vec_id") >= 0).count() == 0
    alone = nearest(table.where("vec_id = 0"), F.col("vec_id") >= 0)
    assert alone.count() == 0


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_recall_of_the_query(spark, sf):
    from wardstat.llm.queries import op13_nearest
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r["vec_id"] for r in table])
    x = np.array([r["embedding"] for r in table], np.float32).astype(float)
    got = {}
    for r in op13_nearest(spark, sf).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = np.flatnonzero(ids % 20 == 0)
    assert sorted(got) == ids[asked].tolist()
    hits = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        near = np.lexsort((ids, -s))[:20]
        mine = got[ids[q]]
        assert sorted(mine) == list(range(1, 21))
        for i, score in mine.values():
            assert abs(s[np.searchsorted(ids, i)] - score) < 1e-12
        assert [mine[k][1] for k in range(1, 21)] == sorted((v[1] for v in mine.values()), reverse=True)
        hits += len({i for i, _ in mine.values()} & set(ids[near].tolist()))
    assert hits / (20 * len(asked)) >= 0.98
