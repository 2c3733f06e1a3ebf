import hashlib
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.util import SF, docs, rows_of
from wardstat.llm.merkle_manifest import (MANIFEST_SQL, folded, leaf_digest, manifest, placed,
                                          verified_documents)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(top node, the siblings on each leaf's way as (left, right))."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            beside = nodes[i ^ 1] if i ^ 1 < len(nodes) else ""
            ways[k].append((beside, "") if i % 2 else ("", beside))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return nodes[0], ways


def framed(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars)."""
    first = lambda x: (x is not None, x if isinstance(x, int) else (x or "").encode())
    groups = {}
    for r in rows:
        i, text, lang, source, n = r
        leaf = lambda n: h(*map(framed, (i, source, lang, n, text)))
        hit = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups.setdefault(lang, []).append((i, leaf(n), leaf(n + 1) if hit else leaf(n)))
    order = sorted(groups, key=first)
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: ((r[0] is not None, r[0] or 0), r[1]))
        trees[g] = tree([r[1] for r in groups[g]])
    root, above = tree([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (i, leaf, changed), way in zip(groups[g], trees[g][1]):
            way = way + above[k]
            node = changed
            for a, b in way:
                node = h(a, node, b)
            proof = h(*[a + b for a, b in way])
            out.append((i, leaf, trees[g][0], root, proof, node, node == root))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def table(spark, rows):
    return docs(spark, []).sparkSession.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2}, {"a": 3, "b": 1}, {"a": 700, None: 5},
                                   {"z": 257, "é": 256, "": 9, "a": 513, None: 1}])
def test_documents_equal_brute_force(spark, sizes):
    rows = [(k * 3 + j, f"text é {k}", lang, None if k % 5 else "src", k)
            for j, (lang, n) in enumerate(sizes.items()) for k in range(n)]
    got = verified_documents(table(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                           "verified"]
    assert rows_of(got) == brute(rows)


def test_nulls_ties_repeats_clashing_columns_and_empty(spark):
    rows = [(None, None, None, None, None), (7, "x", None, "s", 1), (7, "x", None, "s", 1),
            (7, "y", None, "s", None), (None, "", "en", "", 0), (-3, "\u0000 z" * 90_000, "en", "-", 5),
            (12, "1:2", "en", "3:", -1)]
    wide = table(spark, rows).selectExpr("*", "1 as pos", "2 as size", "'x' as grp", "3 as leaf",
                                         "4 as id", "array(1) as way", "5 as _part")
    assert rows_of(verified_documents(wide)) == brute(rows)
    assert verified_documents(wide.where("false")).count() == 0


@pytest.mark.parametrize("block", [2, 4, 64])
def test_any_block_gives_the_same_tree(spark, block):
    rows = [(k, f"t{k}", "en" if k % 3 else "fr", None, k) for k in range(150)]
    made = table(spark, rows).select(
        F.col("lang").alias("grp"), F.col("doc_id").alias("id"),
        leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
        .alias("leaf"), F.lit("kept").alias("other"))
    got = manifest(made, block)
    want = {r[0]: r for r in brute(rows)}
    for r in got.withColumn("top", folded(F.col("leaf"), F.col("way"))).collect():
        assert (r["leaf"], r["subroot"], r["root"]) == want[r["id"]][1:4]
        assert r["top"] == r["root"] and r["other"] == "kept"
    with pytest.raises(ValueError):
        manifest(made, 3)


def test_places(spark):
    made = spark.createDataFrame([("a" if k % 2 else None, k, str(-k)) for k in range(40)],
                                 "grp string, id long, leaf string")
    got = placed(made, ["id", "leaf"]).collect()
    for r in got:
        assert (r["pos"], r["size"]) == (r["id"] // 2, 20)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_query_equals_sql(spark):
    from wardstat.llm.queries import op11_merkle_manifest
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows_of(op11_merkle_manifest(spark, SF)) == sorted(con.execute(MANIFEST_SQL).fetchall())
