"""Randomised check of the whole readmission analysis against a direct,
row-by-row model of its semantics (small inputs, hot keys, nulls,
duplicates, window edges)."""

import datetime as dt
import random
from collections import Counter

import pytest

from wardstat.plans.scorecard import readmission_analysis
from wardstat.sources.codes import dictionary_from_mapping
from wardstat.specs import ReadmissionSpec
from tests.test_readmission import make_ds

B = dt.date(2009, 1, 1)
CT, PT = (38000199, 38000200), (38000250, 38000251)
DIAG = {"A": ["d1", "d2"], "B": ["d2", "d3"], "C": ["d4"]}
COMPL = {"A": ["c1", "c2", "c1"], "B": ["c2", "c3"], "D": ["c4"]}


def day(n):
    return B + dt.timedelta(days=n)


def model(conds, procs, visits, deaths, days):
    both = [p for p in DIAG if p in COMPL]

    def place(events, codes_of, types):
        out = set()
        for pid, d, t, code in events:
            if t not in types:
                continue
            for proc in both:
                if code in codes_of[proc]:
                    for vp, s, e, prov in visits:
                        if vp == pid and s <= d <= e:
                            out.add((proc, pid, s, e, prov, code))
        return out

    idx_c = {(p, pid, e, prov, code) for p, pid, s, e, prov, code in place(conds, DIAG, CT)}
    idx_p = {(p, pid, e, prov, code) for p, pid, s, e, prov, code in place(procs, DIAG, PT)}
    index = [r for r in idx_c] + [r for r in idx_p]
    compl = {(p, pid, s, code) for p, pid, s, e, prov, code in place(conds, COMPL, CT)}
    readm = {(p, pid, e, prov, code2) for (p, pid, e, prov, _) in index
             for (p2, pid2, s2, code2) in compl
             if p2 == p and pid2 == pid and e < s2 < e + dt.timedelta(days=days)}
    dead = {(p, pid, e, prov) for (p, pid, e, prov, _) in index
            for (dp, dd) in deaths if dp == pid and dd < e + dt.timedelta(days=days)}
    pc = Counter((p, prov) for p, _, _, prov, _ in index)
    rc = Counter((p, prov) for p, _, _, prov, _ in readm)
    dc = Counter((p, prov) for p, _, _, prov in dead)
    card = []
    for (p, prov), n in pc.items():
        r = rc[(p, prov)] if prov is not None else 0
        d = dc[(p, prov)] if prov is not None else 0
        card.append((p, prov if prov is not None else 0, n, r, d, r + d, (r + d) / n))
    return sorted(readm, key=repr), sorted(card, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_analysis_matches_model(spark, seed):
    rnd = random.Random(seed)
    people = [1, 1, 1, 1, 2, 3, 4, 5]          # person 1 is hot
    codes = ["d1", "d2", "d3", "d4", "c1", "c2", "c3", "c4", "zz"]
    types_c = [38000199, 38000200, 45756836]
    types_p = [38000250, 38000251, 45756900]
    conds = [(rnd.choice(people), day(rnd.randint(0, 80)), rnd.choice(types_c), rnd.choice(codes))
             for _ in range(120)]
    conds += conds[:20]                         # exact duplicates
    procs = [(rnd.choice(people), day(rnd.randint(0, 80)), rnd.choice(types_p), rnd.choice(codes))
             for _ in range(60)]
    visits = []
    for _ in range(50):
        s = rnd.randint(-3, 80)
        visits.append((rnd.choice(people), day(s), day(s + rnd.randint(0, 9)),
                       rnd.choice([10, 11, 0, None])))
    visits += visits[:10]
    deaths = [(p, day(rnd.randint(-10, 120))) for p in rnd.sample([1, 2, 3, 4, 5], 3)]
    days = rnd.choice([7, 30])

    ds = make_ds(spark, conds, procs, visits, deaths)
    res = readmission_analysis(ds, dictionary_from_mapping(spark, DIAG),
                               dictionary_from_mapping(spark, COMPL),
                               ReadmissionSpec(readmission_days=days))
    want_readm, want_card = model(conds, procs, visits, deaths, days)
    got_readm = sorted(((r.procedure, r.PERSON_ID, r.VISIT_END_DATE, r.PROVIDER_ID, r.SOURCE_VALUE)
                        for r in res.readmissions.collect()), key=repr)
    got_card = sorted((tuple(r) for r in res.scorecard.collect()), key=repr)
    assert got_readm == want_readm
    assert [c[:6] for c in got_card] == [c[:6] for c in want_card]
    assert all(abs(a[6] - b[6]) < 1e-12 for a, b in zip(got_card, want_card))
