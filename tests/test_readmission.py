"""Boundary cases of stays, readmissions, deaths and the scorecard."""

import datetime as dt

from wardstat.dataset import OmopDataset
from wardstat.operators import codes as C
from wardstat.plans.scorecard import readmission_analysis
from wardstat.sources.codes import dictionary_from_mapping
from wardstat.specs import ReadmissionSpec

B = dt.date(2009, 1, 1)
PC, PP = 38000200, 38000251  # primary condition / procedure types


def d(n):
    return B + dt.timedelta(days=n)


def make_ds(spark, conditions, procedures, visits, deaths=()):
    return OmopDataset({
        "condition_occurrence": spark.createDataFrame(
            list(conditions), "PERSON_ID long, CONDITION_START_DATE date, "
            "CONDITION_TYPE_CONCEPT_ID long, CONDITION_SOURCE_VALUE string"),
        "procedure_occurrence": spark.createDataFrame(
            list(procedures), "PERSON_ID long, PROCEDURE_DATE date, "
            "PROCEDURE_TYPE_CONCEPT_ID long, PROCEDURE_SOURCE_VALUE string"),
        "visit_occurrence": spark.createDataFrame(
            list(visits), "PERSON_ID long, VISIT_START_DATE date, VISIT_END_DATE date, "
            "PROVIDER_ID long"),
        "death": spark.createDataFrame(list(deaths), "PERSON_ID long, DEATH_DATE date"),
    })


def card(res):
    return sorted((r.procedure, r.PROVIDER_ID, r.PROCEDURE_COUNT, r.READMISSION_COUNT,
                   r.DEATH_COUNT, r.COMPLICATION_COUNT, r.PERCENTAGE)
                  for r in res.scorecard.collect())


def dicts(spark, diag=None, compl=None):
    return (dictionary_from_mapping(spark, diag or {"P": ["0100"]}),
            dictionary_from_mapping(spark, compl or {"P": ["0389", "0390"]}))


def test_readmission_window_days(spark):
    # person n: index stay ending day 0, complication stay starting day n
    conds, visits = [], []
    for pid, gap in enumerate([0, 1, 29, 30], start=1):
        base = pid * 1000
        conds += [(pid, d(base - 2), PC, "0100"), (pid, d(base + gap), PC, "0389")]
        visits += [(pid, d(base - 3), d(base), 7), (pid, d(base + gap), d(base + gap + 1), 8)]
    res = readmission_analysis(make_ds(spark, conds, [], visits), *dicts(spark))
    got = sorted(r.PERSON_ID for r in res.readmissions.collect())
    assert got == [2, 3]  # gaps 1 and 29 only


def test_event_on_visit_start_and_end_day(spark):
    conds = [(1, d(0), PC, "0100"), (2, d(4), PC, "0100"), (3, d(5), PC, "0100")]
    visits = [(1, d(0), d(4), 1), (2, d(0), d(4), 2), (3, d(0), d(4), 3)]
    res = readmission_analysis(make_ds(spark, conds, [], visits), *dicts(spark))
    assert sorted(r.PERSON_ID for r in res.index_stays.collect()) == [1, 2]


def test_null_provider_and_provider_zero(spark):
    conds = [(1, d(0), PC, "0100"), (1, d(10), PC, "0389"),
             (2, d(0), PC, "0100"), (2, d(10), PC, "0389")]
    visits = [(1, d(0), d(1), None), (1, d(10), d(11), 5),
              (2, d(0), d(1), 0), (2, d(10), d(11), 5)]
    deaths = [(1, d(3)), (2, d(3))]
    res = readmission_analysis(make_ds(spark, conds, [], visits, deaths), *dicts(spark))
    # the null-provider group shows id 0 but no readmission or death;
    # the real provider 0 keeps its own row and counts.
    assert card(res) == [("P", 0, 1, 0, 0, 0, 0.0), ("P", 0, 1, 1, 1, 2, 2.0)]


def test_union_all_and_multiple_complication_codes(spark):
    conds = [(1, d(0), PC, "0100"), (1, d(5), PC, "0389"), (1, d(5), PC, "0390")]
    procs = [(1, d(0), PP, "0100")]
    visits = [(1, d(0), d(1), 9), (1, d(5), d(6), 9)]
    res = readmission_analysis(make_ds(spark, conds, procs, visits), *dicts(spark))
    # found through both tables -> counted twice; two complication codes -> two readmissions
    assert card(res) == [("P", 9, 2, 2, 0, 2, 1.0)]
    assert sorted(r.branch for r in res.index_stays.collect()) == ["C", "P"]


def test_death_window(spark):
    conds = [(p, d(0), PC, "0100") for p in (1, 2, 3, 4)]
    visits = [(p, d(0), d(10), p) for p in (1, 2, 3, 4)]
    deaths = [(1, d(-5)), (2, d(10)), (3, d(39)), (4, d(40))]
    ds = make_ds(spark, conds, [], visits, deaths)
    res = readmission_analysis(ds, *dicts(spark))
    assert sorted(r.PERSON_ID for r in res.deaths.collect()) == [1, 2, 3]
    after = readmission_analysis(ds, *dicts(spark),
                                 ReadmissionSpec(death_after_discharge_only=True))
    assert sorted(r.PERSON_ID for r in after.deaths.collect()) == [2, 3]


def test_non_primary_types_ignored(spark):
    conds = [(1, d(0), 45756836, "0100")]
    procs = [(1, d(0), 45756900, "0100")]
    visits = [(1, d(0), d(1), 1)]
    res = readmission_analysis(make_ds(spark, conds, procs, visits), *dicts(spark))
    assert res.scorecard.count() == 0


def test_procedure_lists_only_in_one_dictionary(spark):
    conds = [(1, d(0), PC, "0100"), (1, d(0), PC, "0200"), (1, d(5), PC, "0389")]
    visits = [(1, d(0), d(1), 1), (1, d(5), d(6), 1)]
    diag, compl = dicts(spark, {"P": ["0100"], "Q": ["0200"]},
                        {"P": ["0389", "0389"], "R": ["0389"]})
    res = readmission_analysis(make_ds(spark, conds, [], visits), diag, compl)
    # Q has no complication list: skipped; R has no diagnosis list: no stays
    assert {r.procedure for r in res.scorecard.collect()} == {"P"}
    rep = C.readmission_code_report(compl, res.readmissions)
    got = sorted((r.procedure, r.ord, r.code, r.COUNT) for r in rep.collect())
    assert got == [("P", 0, "0389", 1), ("P", 1, "0389", 1), ("R", 0, "0389", 0)]
    totals = {r.procedure: r.TOTAL for r in C.report_totals(rep).collect()}
    assert totals == {"P": 2, "R": 0, None: 2}


def test_render_report_layout(spark):
    conds = [(1, d(0), PC, "0100"), (1, d(1), PC, "0100")]
    ds = make_ds(spark, conds, [], [])
    diag = dictionary_from_mapping(spark, {"P": ["0100", "0999"], "Q": ["0100"]})
    descr = spark.createDataFrame([("0100", " Short code"), ("0999", "Other")],
                                  "code string, description string")
    rep = C.code_report(diag, ds["condition_occurrence"], ds["procedure_occurrence"], descr)
    lines = [r.line for r in C.render_report(rep)
             .orderBy("proc_ord", "seq", "ord").collect() if r.proc_ord is not None]
    grand = [r.line for r in C.render_report(rep).collect() if r.proc_ord is None]
    assert lines == [
        "Procedure: P", "code, count, description", "0100,2, Short code", "0999,0,Other",
        "Total Count For This procedure: 2", "",
        "Procedure: Q", "code, count, description", "0100,2, Short code",
        "Total Count For This procedure: 2", "",
    ]
    assert grand == ["Total Count For All Procedures: 4"]


def test_hot_person_with_repeated_rows(spark):
    """One person holds most rows, with many repeated visits and events:
    results equal the small case (duplicates never inflate counts)."""
    conds = [(1, d(0), PC, "0100")] * 200 + [(1, d(10), PC, "0389")] * 200 + [(2, d(0), PC, "0100")]
    visits = [(1, d(0), d(2), 5)] * 300 + [(1, d(10), d(12), 5)] * 300 + [(2, d(0), d(1), 6)]
    res = readmission_analysis(make_ds(spark, conds, [], visits), *dicts(spark))
    assert card(res) == [("P", 5, 1, 1, 0, 1, 1.0), ("P", 6, 1, 0, 0, 0, 0.0)]
    no_dedupe = readmission_analysis(make_ds(spark, conds, [], visits), *dicts(spark),
                                     ReadmissionSpec(dedupe_visits=False))
    assert card(no_dedupe) == card(res)


def test_code_counts_serve_all_reports(spark):
    conds = [(1, d(0), PC, "0100"), (1, d(1), 45756836, "0100"), (2, d(0), PC, "0389")]
    procs = [(1, d(0), PP, "0389"), (3, d(0), 45756900, "0100")]
    ds = make_ds(spark, conds, procs, [])
    diag, compl = dicts(spark, {"P": ["0100", "0999"]}, {"P": ["0389", "0389"]})
    co, po = ds["condition_occurrence"], ds["procedure_occurrence"]
    counts = C.code_counts(co, po, [diag, compl], (PC,), (PP,))
    for dic in (diag, compl):
        for primary in (False, True):
            types = dict(condition_types=(PC,), procedure_types=(PP,)) if primary else {}
            want = sorted(tuple(r) for r in C.code_report(dic, co, po, **types).collect())
            got = sorted(tuple(r) for r in C.code_report_from_counts(dic, counts, primary=primary).collect())
            assert got == want


def test_inpatient_stays_of_a_raw_table(spark):
    from wardstat.operators.events import inpatient_stays
    conds = [(1, d(0), PC, "0100"), (1, d(0), 45756836, "0100"), (1, d(9), PC, "0200")]
    visits = [(1, d(0), d(2), 4), (1, d(0), d(2), 4)]
    ds = make_ds(spark, conds, [], visits)
    got = sorted(tuple(r) for r in inpatient_stays(
        ds["condition_occurrence"], "condition", ds["visit_occurrence"], "VISIT_START_DATE").collect())
    assert got == [(1, d(0), 4, "0100")]


def test_large_dictionary_path_gives_same_results(spark, tmp_path, monkeypatch):
    """Dictionaries above the broadcast limit stay distributed and are
    joined by shuffle; results must not change."""
    import wardstat.sources.codes as codes_mod
    conds = [(1, d(0), PC, "0100"), (1, d(5), PC, "0389"), (2, d(0), PC, "0200"),
             (2, d(3), PC, "0390")]
    procs = [(1, d(0), PP, "0100")]
    visits = [(1, d(0), d(1), 9), (1, d(5), d(6), 9), (2, d(0), d(1), 8), (2, d(3), d(4), 8)]
    ds = make_ds(spark, conds, procs, visits, [(2, d(20))])
    diag_txt = tmp_path / "diag.properties"
    diag_txt.write_text("P = 0100,0200\nQ = 0200\n")
    compl_txt = tmp_path / "compl.properties"
    compl_txt.write_text("P = 0389,0390,0389\nQ = 0390\nR = 0389\n")

    def outputs():
        diag = codes_mod.read_code_dictionary(spark, str(diag_txt))
        compl = codes_mod.read_code_dictionary(spark, str(compl_txt))
        res = readmission_analysis(ds, diag, compl)
        rep = C.code_report(compl, ds["condition_occurrence"], ds["procedure_occurrence"])
        out = (card(res), sorted(tuple(r) for r in res.readmissions.collect()),
               sorted((r.procedure, r.ord, r.code, r.COUNT) for r in rep.collect()),
               sorted(tuple(r) for r in C.readmission_code_report(compl, res.readmissions)
                      .drop("proc_ord").collect()), diag.rows is None)
        return out

    small = outputs()
    monkeypatch.setattr(codes_mod, "MAX_BROADCAST_ENTRIES", 0)
    large = outputs()
    assert small[4] is False and large[4] is True
    assert small[:4] == large[:4]
    assert small[0] == [("P", 8, 1, 1, 1, 2, 2.0), ("P", 9, 2, 1, 0, 1, 0.5),
                        ("Q", 8, 1, 1, 1, 2, 2.0)]


def test_code_frequency_null_codes_stay_apart(spark):
    """A null code never matches across the two tables (full outer join
    semantics): one null row per table."""
    conds = [(1, d(0), PC, None), (1, d(1), PC, None), (1, d(2), PC, "0100")]
    procs = [(1, d(0), PP, None), (1, d(0), PP, "0100")]
    ds = make_ds(spark, conds, procs, [])
    got = sorted(((r.SOURCE_VALUE or ""), r.COUNT_CO, r.COUNT_PO, r.COUNT)
                 for r in C.code_frequency(ds["condition_occurrence"],
                                           ds["procedure_occurrence"]).collect())
    assert got == [("", 0, 1, 1), ("", 2, 0, 2), ("0100", 1, 1, 2)]


def test_large_dictionaries_sieve_the_events(spark):
    """Few events reach the shuffle join, and the rows are those of the broadcast join."""
    from wardstat.operators.events import coded_events
    from wardstat.sources.codes import CodeDictionary, dictionary_from_mapping, narrowed
    small = dictionary_from_mapping(spark, {"A": ["c7", "c70", "c700"], "B": ["c7"]})
    large = CodeDictionary(small.df, small.n_entries, max_broadcast=0)
    events = spark.range(20_000).selectExpr(
        "id as PERSON_ID", "date'2009-01-01' as CONDITION_START_DATE",
        "1L as CONDITION_TYPE_CONCEPT_ID", "concat('c', id % 4000) as CONDITION_SOURCE_VALUE")
    some = narrowed(events, "CONDITION_SOURCE_VALUE", [large])
    assert 15 <= some.count() < 400
    assert narrowed(events, "CONDITION_SOURCE_VALUE", [small]) is events
    a, b = (sorted(map(tuple, coded_events(events, "condition", d).collect())) for d in (small, large))
    assert a == b and len(a) == 20
    plan = coded_events(events, "condition", large)._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and "scalar-subquery" in plan
