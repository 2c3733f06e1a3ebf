"""A Bloom filter as a Spark expression.

``Sieve`` holds the bits of a set of keys as one row, an array of 64-bit words of
fixed size, and tests rows against it inside the scan: a scalar subquery, no join
and no UDF.  It never misses a key; of other rows it lets some through, the more the
fuller it is, so whatever follows must be right for those as well.  The words are or-ed
together by partial aggregation, so building it moves no more than its own size
from each task, and its size is bounded whatever the number of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BITS = 1 << 23      # 1 MB
HASHES = 2


def bits_for(keys: int, per_key: int = 8) -> int:
    """A power of two with ``per_key`` bits a key, 4096 at least and MAX_BITS at most."""
    return min(MAX_BITS, max(1 << 12, 1 << (max(1, keys) * per_key - 1).bit_length()))


def _alike(name: str, kind: T.DataType) -> str:
    """Equal values of joinable types have equal hashes."""
    name = "`" + name.replace("`", "``") + "`"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return f"CAST({name} AS BIGINT)"
    return f"CAST({name} AS DOUBLE)" if isinstance(kind, T.FloatType) else name


def _places(frame: DataFrame, names: Sequence[str], bits: int, hashes: int) -> list[str]:
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    cols = ", ".join(_alike(n, kinds[n]) for n in names)
    return [f"pmod(xxhash64({k}, {cols}), {bits})" for k in range(hashes)]


class Sieve:
    """The distinct rows of ``keys`` (all its columns) in ``bits`` bits.  With ``part``, a
    column of whole numbers below ``parts`` that is no part of the key, each number's rows
    have bits of their own, so a set with many keys does not fill those of another."""

    def __init__(self, keys: DataFrame, bits: int, hashes: int = HASHES,
                 part: str | None = None, parts: int = 1):
        if bits < 64 or bits & (bits - 1) or bits > MAX_BITS:
            raise ValueError(f"bits must be a power of two from 64 to {MAX_BITS}")
        self.bits, self.hashes = bits, hashes
        names = [c for c in keys.columns if c != part]
        own = f" + {part} * {bits}L" if part else ""
        places = ", ".join(p + own for p in _places(keys, names, bits, hashes))
        ones = keys.selectExpr(f"explode(array({places})) AS place").selectExpr(
            "shiftright(place, 6) AS word", "shiftleft(1L, CAST(place & 63 AS INT)) AS ones")
        zeros = keys.sparkSession.range(parts * bits // 64).selectExpr("id AS word", "0L AS ones")
        self.words = ones.union(zeros).groupBy("word").agg(F.expr("bit_or(ones) AS ones")).agg(
            F.expr("transform(array_sort(collect_list(struct(word, ones))), x -> x.ones) AS words"))

    def may_hold(self, rows: DataFrame, names: Sequence[str], part: int = 0) -> Column:
        """Whether the columns ``names`` of ``rows`` may be a key (of a part)."""
        words = self.words.scalar()
        known = None
        for place in _places(rows, names, self.bits, self.hashes):
            word = F.element_at(words, F.expr(
                f"CAST(shiftright({place}, 6) + {part * self.bits // 64 + 1} AS INT)"))
            hit = F.getbit(word, F.expr(f"CAST({place} & 63 AS INT)")) == 1
            known = hit if known is None else known & hit
        return known
