"""Range joins against brute force, including the window ends."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from wardstat.functions.sieve import Sieve, bits_for
from wardstat.operators.intervals import _leaf, _tree, band_join, containment_join
from wardstat.operators.intervals import interval_nodes, point_nodes, reached_levels
from wardstat.operators.intervals import upper_levels, wide_nodes, wide_point_nodes

BASE = dt.date(2010, 1, 1)


def day(n):
    return BASE + dt.timedelta(days=n)


def test_containment_matches_brute_force(spark):
    rnd = random.Random(7)
    # one hot key holding most rows, as skewed data would
    points = [(rnd.choice([1, 1, 1, 2, 3]), day(rnd.randint(0, 60)), i) for i in range(300)]
    intervals = []
    for j in range(120):
        s = rnd.randint(-5, 60)
        intervals.append((rnd.choice([1, 1, 2, 3, 4]), day(s), day(s + rnd.randint(-2, 20)), j))
    intervals.append((1, None, day(3), 999))
    p = spark.createDataFrame(points, "k long, d date, pid int")
    iv = spark.createDataFrame(intervals, "k long, s date, e date, iid int")
    for b in (1, 3, 7, 30):
        got = sorted((r.pid, r.iid) for r in
                     containment_join(p, iv, ["k"], "d", "s", "e", b)
                     .select("pid", "iid").collect())
        want = sorted((pid, iid) for k, d, pid in points for k2, s, e, iid in intervals
                      if k == k2 and s is not None and e is not None and s <= d <= e)
        assert got == want, b


def test_containment_inclusive_ends(spark):
    p = spark.createDataFrame([(1, day(0), "start"), (1, day(5), "end"), (1, day(6), "after"),
                               (1, day(-1), "before")], "k long, d date, tag string")
    iv = spark.createDataFrame([(1, day(0), day(5))], "k long, s date, e date")
    got = sorted(r.tag for r in containment_join(p, iv, ["k"], "d", "s", "e").collect())
    assert got == ["end", "start"]


def test_band_matches_brute_force(spark):
    rnd = random.Random(3)
    left = [(rnd.choice([1, 1, 2]), day(rnd.randint(0, 90)), i) for i in range(150)]
    right = [(rnd.choice([1, 1, 2, 5]), day(rnd.randint(0, 120)), j) for j in range(150)]
    lf = spark.createDataFrame(left, "k long, a date, lid int")
    rt = spark.createDataFrame(right, "k long, b date, rid int")
    for lo, hi, width in ((1, 29, None), (0, 29, None), (1, 29, 7), (-3, 3, 2), (1, 0, None)):
        got = sorted((r.lid, r.rid) for r in
                     band_join(lf, rt, ["k"], "a", "b", lo, hi, width).select("lid", "rid").collect())
        want = sorted((lid, rid) for k, a, lid in left for k2, b, rid in right
                      if k == k2 and lo <= (b - a).days <= hi)
        assert got == want, (lo, hi, width)


def test_band_window_ends(spark):
    """Readmission window: strictly after discharge, strictly before +30."""
    lf = spark.createDataFrame([(1, day(0))], "k long, a date")
    rt = spark.createDataFrame([(1, day(n), n) for n in (-1, 0, 1, 29, 30, 31)], "k long, b date, n int")
    got = sorted(r.n for r in band_join(lf, rt, ["k"], "a", "b", 1, 29).collect())
    assert got == [1, 29]


def test_plan_is_equi_join_on_bucket(spark):
    p = spark.range(10).select(F.lit(1).cast("long").alias("k"), F.current_date().alias("d"))
    iv = spark.range(10).select(F.lit(1).cast("long").alias("k"), F.current_date().alias("s"),
                                F.current_date().alias("e"))
    plan = containment_join(p, iv, ["k"], "d", "s", "e")._jdf.queryExecution().optimizedPlan().toString()
    assert "_day_bucket" in plan and "Join Inner" in plan


def test_long_intervals_are_exact_without_explosion(spark):
    p = spark.createDataFrame([(1, day(0), "a"), (1, day(4000), "b"), (2, day(5), "c")],
                              "k long, d date, tag string")
    iv = spark.createDataFrame([(1, day(-10), dt.date(9999, 12, 31), "open"),
                                (1, day(0), day(3), "short"), (2, day(0), day(9), "short2")],
                               "k long, s date, e date, name string")
    got = sorted((r.tag, r.name) for r in containment_join(p, iv, ["k"], "d", "s", "e").collect())
    assert got == [("a", "open"), ("a", "short"), ("b", "open"), ("c", "short2")]


def test_hot_key_with_long_intervals_and_far_dates(spark):
    rnd = random.Random(5)
    far = [dt.date(1800, 1, 1), dt.date(2200, 1, 1), dt.date(9999, 12, 31)]
    points = [(1, rnd.choice([day(rnd.randint(0, 9000)), *far]), i) for i in range(300)]
    intervals = []
    for j in range(200):
        s = rnd.choice([day(rnd.randint(0, 9000)), dt.date(1700, 1, 1), dt.date(2100, 5, 5)])
        e = rnd.choice([s + dt.timedelta(days=rnd.randint(0, 4000)), dt.date(9999, 12, 31)])
        intervals.append((1, s, e, j))
    p = spark.createDataFrame(points, "k long, d date, pid int")
    iv = spark.createDataFrame(intervals, "k long, s date, e date, iid int")
    joined = containment_join(p, iv, ["k"], "d", "s", "e")
    got = sorted((r.pid, r.iid) for r in joined.select("pid", "iid").collect())
    assert got == sorted((i, j) for _, d, i in points for _, s, e, j in intervals if s <= d <= e)


def brute(points, intervals):
    return sorted((i, j) for k, d, i in points for k2, s, e, j in intervals
                  if k == k2 and s <= d <= e)


def test_random_intervals_of_all_lengths(spark):
    rnd = random.Random(23)
    points, intervals = [], []
    for case in range(12):
        lengths = [0, 1, 27, 28, 112, 113, 140, 500, 3000, 40_000]
        for j in range(25):
            s = day(rnd.randint(-45_000, 20_000))
            try:
                e = s + dt.timedelta(days=rnd.choice(lengths) + rnd.randint(0, 3))
            except OverflowError:
                e = dt.date(9999, 12, 31)
            intervals.append((case, s, e, len(intervals)))
        points += [(case, day(rnd.randint(-46_000, 25_000)), len(points) + i) for i in range(40)]
        ends = rnd.sample(intervals[-25:], 10)
        points += [(case, x[1 + i % 2] + dt.timedelta(days=i % 3 - 1), len(points) + i)
                   for i, x in enumerate(ends)]
    points = [(k, d, i) for i, (k, d, _) in enumerate(points)]
    p = spark.createDataFrame(points, "k int, d date, pid int")
    iv = spark.createDataFrame(intervals, "k long, s date, e date, iid int")
    for width in (1, 28, 365):
        for bits in (64, 1 << 12):      # a sieve that lets all through, and one that does not
            got = containment_join(p, iv, ["k"], "d", "s", "e", width, bits).select("pid", "iid")
            assert sorted(map(tuple, got.collect())) == brute(points, intervals), (width, bits)


def test_interval_copies_grow_with_the_logarithm(spark):
    lengths = [1, 20, 100, 120, 400, 4000, 20_000, 54_000]
    rows = [(n, day(-40_000 + 13 * k), day(-40_000 + 13 * k + n)) for n in lengths for k in range(50)]
    iv = spark.createDataFrame(rows, "n int, s date, e date")
    height = _tree(28)[1]
    iv = iv.withColumns({"lo": _leaf(F.col("s"), 28), "hi": _leaf(F.col("e"), 28)})
    nodes = interval_nodes("lo", "hi", height)
    got = {r["n"]: r["most"] for r in iv.groupBy("n").agg(
        F.max(F.size(nodes)).alias("most")).collect()}
    for n in lengths:
        assert got[n] <= max(5, 2 * math.log2(max(2, n / 28))), (n, got[n])
    assert got[54_000] <= 22 < 54_000 // 28 == 1928
    # no bucket twice: nodes of one interval are disjoint and hold as many buckets
    for r in iv.select("n", "s", "e", nodes.alias("x")).collect():
        held = []
        for node in r["x"]:
            level = height - (node.bit_length() - 1)
            at = (node - (1 << (height - level))) << level
            held += range(at, at + (1 << level))
        assert len(held) == len(set(held)) and held
        assert max(held) - min(held) + 1 == len(held)


def test_few_levels_hold_each_leaf_once(spark):
    rnd = random.Random(31)
    for width in (1, 28, 365):
        height = _tree(width)[1]
        rows = []
        for n in [*range(40), 63, 64, 65, 86, 500, 511, 512, 513, 1900]:
            for _ in range(6):
                lo = rnd.choice([0, 8, 64, 511, 512, rnd.randint(0, 1 << (height - 1))])
                rows.append((min(lo, (1 << height) - 1), min(lo + n, (1 << height) - 1)))
        iv = spark.createDataFrame(rows, "lo long, hi long")
        levels = upper_levels(height)
        for r in iv.select("lo", "hi", wide_nodes("lo", "hi", height).alias("x"),
                           reached_levels("lo", "hi", height).alias("r")).collect():
            held, used = [], set()
            for node in r["x"]:
                level = height - (node.bit_length() - 1)
                used.add(level)
                at = (node - (1 << (height - level))) << level
                held += range(at, at + (1 << level))
            assert sorted(held) == list(range(r["lo"], r["hi"] + 1))
            assert used <= {0, *(levels[k] for k in r["r"])}
            assert len(r["x"]) <= 14 * (1 + len(r["r"]))


def test_points_are_copied_only_to_levels_that_intervals_reach(spark):
    """Years-long periods of every key: 3 rows a point, where all 12 levels were used."""
    iv = spark.createDataFrame([(k, day(40 * k), day(40 * k + 1500 + 20 * k)) for k in range(60)],
                               "k long, s date, e date")
    p = spark.createDataFrame([(k, day(40 * k + 9 * j)) for k in range(60) for j in range(20)],
                              "k long, d date")
    joined = containment_join(p, iv, ["k"], "d", "s", "e")
    assert joined.count() == 1200
    height = _tree(28)[1]
    assert upper_levels(height) == [3, 6, 9]
    placed = iv.withColumns({"lo": _leaf(F.col("s"), 28), "hi": _leaf(F.col("e"), 28)})
    known = placed.select("k", F.explode(reached_levels("lo", "hi", height)).alias("part"))
    sieve = Sieve(known, 1 << 12, part="part", parts=3)
    at = p.withColumns({"at": _leaf(F.col("d"), 28),
                        **{f"f{i}": sieve.may_hold(p, ["k"], i) for i in range(3)}})
    most = at.select(F.size(wide_point_nodes("at", ["f0", "f1", "f2"], height)).alias("n"))
    n = sorted(r["n"] for r in most.collect())
    assert n[0] == 2 and n[-1] == 3     # none reaches the level of 512 buckets


def test_points_are_copied_only_for_keys_with_long_intervals(spark):
    iv = spark.createDataFrame([(1, day(0), day(9)), (2, day(0), day(9000))],
                               "k long, s date, e date")
    p = spark.createDataFrame([(1, day(3)), (3, day(3)), (2, day(3))], "k long, d date")
    known = Sieve(iv.where("datediff(e, s) > 200").select("k"), 1 << 12)
    placed = p.select("k", _leaf(F.col("d"), 28).alias("at"), known.may_hold(p, ["k"]).alias("all"))
    copies = placed.select("k", F.size(point_nodes("at", "all", _tree(28)[1])).alias("n"))
    assert {r["k"]: r["n"] for r in copies.collect()} == {1: 1, 3: 1, 2: 12}


def test_sieve_holds_every_key(spark):
    keys = spark.range(0, 3000).selectExpr("id * 17 as a", "cast(id % 5 as string) as b")
    rows = spark.range(0, 100_000).selectExpr("cast(id as int) as a", "cast(id % 17 % 5 as string) as b")
    sieve = Sieve(keys, bits_for(3000))
    hit = rows.withColumn("hit", sieve.may_hold(rows, ["a", "b"]))
    truth = rows.join(keys, ["a", "b"], "left_semi").withColumn("key", F.lit(True))
    both = hit.join(truth, ["a", "b"], "left").groupBy("hit", "key").count().collect()
    n = {(r["hit"], r["key"]): r["count"] for r in both}
    assert (False, True) not in n and n[True, True] > 500
    assert n.get((True, None), 0) < 0.1 * n[False, None]
    none = Sieve(keys.where("false"), 64)
    assert rows.where(none.may_hold(rows, ["a", "b"])).count() == 0
    with_null = Sieve(spark.createDataFrame([(None, "1")], "a long, b string"), 64)
    null = spark.createDataFrame([(None, "1")], "a int, b string")
    assert null.where(with_null.may_hold(null, ["a", "b"])).count() == 1


def test_band_join_random_parameters(spark):
    """Random bands and bucket widths against brute force, in one job."""
    rnd = random.Random(11)
    left = [(rnd.choice([1, 2]), day(rnd.randint(0, 60)), i) for i in range(60)]
    right = [(rnd.choice([1, 2]), day(rnd.randint(-20, 80)), j) for j in range(60)]
    lf = spark.createDataFrame(left, "k long, a date, lid int")
    rt = spark.createDataFrame(right, "k long, b date, rid int")
    cases = []
    for _ in range(6):
        lo = rnd.randint(-10, 10)
        hi = lo + rnd.randint(-2, 25)
        cases.append((lo, hi, rnd.choice([None, 1, 4, 13])))
    frames = [band_join(lf, rt, ["k"], "a", "b", lo, hi, w)
              .select(F.lit(n).alias("case"), "lid", "rid") for n, (lo, hi, w) in enumerate(cases)]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f)
    got = sorted(tuple(r) for r in u.collect())
    want = sorted((n, lid, rid) for n, (lo, hi, _) in enumerate(cases)
                  for k, a, lid in left for k2, b, rid in right
                  if k == k2 and lo <= (b - a).days <= hi)
    assert got == want
