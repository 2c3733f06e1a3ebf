"""Range joins on dates, keyed by an equality key plus a day bucket.

Spark has no native interval join: an equi-join on the entity key with the
date range as a residual condition would compare every pair of rows of one
entity, which is quadratic for an entity holding a large share of the data.
Both joins here add a *day bucket* to the equality key instead:

* ``containment_join`` — point ``p`` inside interval ``[s, e]``.  Days are
  grouped into buckets, and buckets are the leaves of a tree in which a node has
  ``2 ** STEP`` children.  An interval of up to ``SHORT`` buckets is copied to each of
  them; a longer one to the largest nodes that lie inside it, fewer than
  ``2 ** (STEP + 1)`` a level, so O(log length) copies.
  A point is in its bucket and in the nodes above it; it is copied to those of a level
  only if its key may have an interval that reaches this level (a ``Sieve`` of the keys
  of each level), and else stays in its bucket, one row.  As there are more points than
  intervals as a rule, few levels are better than few nodes a level.  Every matching
  pair meets exactly once.
* ``band_join`` — ``left + lo <= right <= left + hi``.  The right side falls
  in one bucket of width ``hi - lo + 1`` (by default), the left side is
  exploded over the (at most two) buckets its band touches.

Both are plain Spark plans: ``explode``, an equi-join on ``keys + bucket`` with the
range as residual, no UDF.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.functions.sieve import Sieve

BUCKET, LO, HI = "_day_bucket", "_first_bucket", "_last_bucket"
# Days outside these share the first and the last bucket, so an interval with a
# placeholder end (9999-12-31) covers a bounded number of buckets.  The range
# itself is compared on the dates, so the result does not depend on them.
FIRST_DAY, LAST_DAY = "1900-01-01", "2050-01-01"
SHORT = 4               # buckets that an interval is copied to one by one
SIEVE_BITS = 1 << 20    # of the keys with longer ones, for each level
STEP = 3                # levels of the binary tree from one that is used to the next


def _bucket(day: Column, width: int) -> Column:
    """Number of the span of ``width`` days that a day is in (whole numbers only)."""
    number = F.unix_date(day).cast("bigint")
    return F.call_function("div", number - F.pmod(number, F.lit(width)), F.lit(width))


def _bucket_range(lo_day: Column, hi_day: Column, width: int) -> Column:
    lo, hi = _bucket(lo_day, width), _bucket(hi_day, width)
    # sequence(a, b) counts down when a > b: an empty band gets no bucket.
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def _tree(width: int) -> tuple[int, int]:
    """(number of the first bucket, height of the tree over all buckets)."""
    epoch = dt.date(1970, 1, 1)
    first, last = ((dt.date.fromisoformat(d) - epoch).days // width for d in (FIRST_DAY, LAST_DAY))
    return first, (last - first).bit_length()


def _leaf(day: Column, width: int) -> Column:
    return _bucket(_clamped(day), width) - _tree(width)[0]


def _node(leaf: str, level: int, height: int) -> str:
    """The node above (or at) a leaf: nodes of a level are numbered from its power of two."""
    return f"shiftright({leaf}, {level}) + {1 << (height - level)}L"


def _inside(lo: str, hi: str, level: int) -> tuple[str, str]:
    """The nodes of a level that lie inside the leaves lo .. hi: left .. right - 1."""
    return (f"shiftright({lo} + {(1 << level) - 1}L, {level})", f"shiftright({hi} + 1L, {level})")


def upper_levels(height: int, step: int = STEP) -> list[int]:
    return list(range(step, height + 1, step))


def reached_levels(lo: str, hi: str, height: int, step: int = STEP) -> Column:
    """Numbers, among ``upper_levels``, of those with a node inside lo .. hi."""
    out = []
    for k, level in enumerate(upper_levels(height, step)):
        left, right = _inside(lo, hi, level)
        out.append(f"CASE WHEN {left} < {right} THEN {k}L END")
    return F.expr(f"array_compact(array({', '.join(out)}))")


def wide_nodes(lo: str, hi: str, height: int, step: int = STEP) -> Column:
    """The nodes of every ``step``-th level that together hold the leaves lo .. hi, no
    leaf twice; the leaves themselves if they are at most ``SHORT``."""
    levels, parts = [0, *upper_levels(height, step)], []
    for level in levels:
        first = f"{1 << (height - level)}L"
        left, right = _inside(lo, hi, level)

        def run(a: str, b: str, also: str = "true") -> str:
            return (f"CASE WHEN {also} AND {a} < {b} THEN sequence({first} + {a}, "
                    f"{first} + {b} - 1L) ELSE none END").replace("none", "CAST(array() AS ARRAY<BIGINT>)")

        if level == levels[-1]:
            parts.append(run(left, right))
            continue
        # those below nodes of the next level that lie inside are held by these
        up_left, up_right = _inside(lo, hi, level + step)
        whole = f"{up_left} < {up_right}"
        parts += [run(left, f"CASE WHEN {whole} THEN shiftleft({up_left}, {step}) ELSE {right} END"),
                  run(f"shiftleft({up_right}, {step})", right, whole)]
    leaves = f"sequence({_node(lo, 0, height)}, {_node(hi, 0, height)})"
    return F.expr(f"CASE WHEN {hi} - {lo} < {SHORT} THEN {leaves} ELSE concat({', '.join(parts)}) END")


def wide_point_nodes(leaf: str, flags: Sequence[str], height: int, step: int = STEP) -> Column:
    """The node of a leaf, and those above it of the levels whose flag (column) holds."""
    above = [f"CASE WHEN {flag} THEN {_node(leaf, level, height)} END"
             for flag, level in zip(flags, upper_levels(height, step))]
    return F.expr(f"array_compact(array({', '.join([_node(leaf, 0, height), *above])}))")


def interval_nodes(lo: str, hi: str, height: int) -> Column:
    """The nodes of all levels that together hold the leaves ``lo`` .. ``hi`` (columns),
    no leaf twice."""
    dyadic = []
    for level in range(height + 1):
        # the nodes of the level that lie inside are left .. right - 1; one with an odd
        # number at the left end, or before an odd right end, has its parent sticking out
        left = f"shiftright({lo} + {(1 << level) - 1}L, {level})"
        right = f"shiftright({hi} + 1L, {level})"
        first = f"{1 << (height - level)}L"
        dyadic += [f"CASE WHEN {left} < {right} AND {left} % 2 = 1 THEN {first} + {left} END",
                   f"CASE WHEN {left} < {right} AND {right} % 2 = 1 THEN {first} + {right} - 1L END"]
    leaves = [f"CASE WHEN {lo} + {k}L <= {hi} THEN {_node(f'{lo} + {k}L', 0, height)} END"
              for k in range(SHORT)]
    return F.expr(f"array_compact(CASE WHEN {hi} - {lo} < {SHORT} THEN array({', '.join(leaves)}) "
                  f"ELSE array({', '.join(dyadic)}) END)")


def point_nodes(leaf: str, every_level: str, height: int) -> Column:
    """The node of a leaf, and where ``every_level`` holds all nodes above it."""
    nodes = [_node(leaf, k, height) for k in range(height + 1)]
    return F.expr(f"CASE WHEN {every_level} THEN array({', '.join(nodes)}) "
                  f"ELSE array({nodes[0]}) END")


def _clamped(day: Column) -> Column:
    return F.greatest(F.least(day, F.lit(LAST_DAY).cast("date")), F.lit(FIRST_DAY).cast("date"))


def containment_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str],
                     point_col: str, start_col: str, end_col: str,
                     bucket_days: int = 28, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """Inner join of points and intervals sharing ``keys`` with
    ``start <= point <= end`` (both ends inclusive).

    Columns other than ``keys`` must not collide between the two sides.
    Null dates and intervals with ``start > end`` match nothing.

    An interval has at most ``SHORT`` copies, or fewer than ``2 ** (STEP + 1)`` for each
    level that its length reaches, of four with the default width, however far away its
    end is.  A point has one row, and one more for each level that an interval of its key
    reaches.  ``sieve_bits`` bounds what is known of the keys of a level: with many more
    of them than bits, points of other keys are copied in vain, the result is the same.
    """
    keys = list(keys)
    start, end, point = F.col(start_col), F.col(end_col), F.col(point_col)
    valid = intervals.where(start.isNotNull() & end.isNotNull() & (start <= end))
    height = _tree(bucket_days)[1]
    levels = upper_levels(height)
    # columns of their own: the nodes refer to them many times
    placed = valid.withColumns({LO: _leaf(start, bucket_days), HI: _leaf(end, bucket_days)})
    iv = placed.withColumn(BUCKET, F.explode(wide_nodes(LO, HI, height))).drop(LO, HI)
    known = placed.where(f"{HI} - {LO} >= {SHORT}").select(
        *[F.col(f"`{k}`") for k in keys], F.explode(reached_levels(LO, HI, height)).alias(BUCKET))
    sieve = Sieve(known, sieve_bits, hashes=1, part=BUCKET, parts=max(1, len(levels)))
    flags = [f"{HI}_{level}" for level in levels]
    pt = (points.where(point.isNotNull()).withColumns(
              {LO: _leaf(point, bucket_days),
               **{flag: sieve.may_hold(points, keys, k) for k, flag in enumerate(flags)}})
          .withColumn(BUCKET, F.explode(wide_point_nodes(LO, flags, height))).drop(LO, *flags))
    return pt.join(iv, keys + [BUCKET]).where((point >= start) & (point <= end)).drop(BUCKET)


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
              left_col: str, right_col: str, lo: int, hi: int,
              bucket_days: int | None = None) -> DataFrame:
    """Inner join of rows with ``left + lo <= right <= left + hi`` (days,
    inclusive).  Each matching pair meets in exactly one bucket (the right
    row's), so no duplicate pairs are produced.
    """
    keys = list(keys)
    width = bucket_days or max(1, hi - lo + 1)
    lcol, rcol = F.col(left_col), F.col(right_col)
    lf = left.where(lcol.isNotNull()).withColumn(
        BUCKET, F.explode(_bucket_range(F.date_add(lcol, lo), F.date_add(lcol, hi), width)))
    rt = right.where(rcol.isNotNull()).withColumn(BUCKET, _bucket(rcol, width))
    cond = (rcol >= F.date_add(lcol, lo)) & (rcol <= F.date_add(lcol, hi))
    return lf.join(rt, keys + [BUCKET]).where(cond).drop(BUCKET)
