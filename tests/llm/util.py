"""Small tables for the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark: SparkSession, rows, extra: bool = False) -> DataFrame:
    """(doc_id, text[, lang]) rows as a documents table."""
    full = [(i, t, (r[0] if r else None), None if k % 3 else "src0", None if t is None else len(t))
            for k, (i, t, *r) in enumerate(rows)]
    out = spark.createDataFrame(full, SCHEMA)
    if extra:  # columns whose names operators use themselves
        out = out.selectExpr("*", "1 as n", "'x' as kept", "2 as length", "array(1) as spans",
                             "3 as start", "'k' as key", "4 as _row", "5 as part")
    return out


def words(rng: random.Random, n: int, vocabulary: int = 500) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def rows_of(df: DataFrame, *cols: str):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()),
                  key=lambda r: tuple((x is None, x) for x in r))
