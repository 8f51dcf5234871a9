"""Cases, margins, grades, evidence and profiles by hand-worked rows."""

from math import comb

import pytest
from pyspark.sql import functions as F

from granary.operators import cases as K

CASES = "case_id long, expected array<string>, allowed array<string>, forbidden array<string>, least_hints int"
ANSWERS = "case_id long, status int, route_id string, tier string, chosen string, latency_ms int, skill_find_ms int, injected_tokens int, response_tokens int"


def test_route_failures(spark):
    cases = [(k, ["hint", "full"], ["lamp"], ["*"] if k == 5 else ["bad"], 2) for k in range(1, 8)]
    good = (200, "r", "Full", "The LAMP", 750, 500, 1000, 3500)
    answers = [
        (1, *good), (2, 500, "", "", "lamp", 751, None, 1001, 0), (3, 200, "r", "hint", "oil", 0, 0, 0, 0), (4, 200, "r", "hint", "bad", 0, 501, 0, 3501), (5, *good), (6, *good),
    ]
    shown = [(3, "a lamp", "h"), (4, "x", "h"), (4, "y", "h"), (4, "z", None), (4, "z", ""), (6, "is BAD", "h"), (6, None, "g")]
    out = K.route_failures(spark.createDataFrame(cases, CASES), spark.createDataFrame(answers, ANSWERS), spark.createDataFrame(shown, "case_id long, text string, content_hash string"))
    got = {r["case_id"]: r["failures"] for r in out.collect()}
    assert got[1] == []
    assert got[2] == ["status", "missing route_id", "tier", "latency_ms over budget", "injected_tokens over budget"]
    assert got[3] == ["too few candidates"]
    assert got[4] == ["no allowed one surfaced", "forbidden: bad", "skill_find_ms over budget", "response_tokens over budget", "a content twice"]
    assert got[5] == ["an answer where none is allowed"] and got[6] == ["forbidden: bad"]
    assert got[7] == ["status", "missing route_id", "tier", "no allowed one surfaced"]


def test_margins_and_grades(spark):
    rows = spark.createDataFrame([(1, 1, 2.5), (1, 2, 1.0), (1, 3, 0.5), (2, 1, 3.0), (3, 1, None), (3, 2, 1.0)], "query_id long, position int, score double")
    assert sorted(map(tuple, K.score_margins(rows).collect())) == [(1, 2.5, 1.0, 1.5), (2, 3.0, 0.0, 3.0), (3, 0.0, 1.0, -1.0)]
    grade = lambda t, a, b: spark.range(1).select(K.keyword_grade(F.lit(t).cast("string"), F.lit(a).cast("array<string>"), F.lit(b).cast("array<string>"))).first()[0]
    assert grade("Some TEXT", ["text", "SOME"], ["x", "e t"]) and not grade("Some", ["some", "x"], ["s"]) and not grade("Some", ["some"], ["x"])
    assert grade(None, None, None) and not grade(None, ["a"], None)


def exact(wins, losses, greater):
    n = wins + losses
    if greater:
        return sum(comb(n, k) for k in range(wins, n + 1)) / 2**n
    return min(1.0, 2 * sum(comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n)


@pytest.mark.parametrize("wins, losses", [(0, 0), (1, 0), (8, 0), (12, 3), (3, 12), (300, 250)])
def test_upper_tail(spark, wins, losses):
    got = spark.range(1).select(K._upper_tail(F.lit(wins), F.lit(wins + losses))).first()[0]
    assert got == pytest.approx(exact(wins, losses, True), rel=1e-9)


def test_evidence(spark):
    outcomes = [(False, True)] * 12 + [(True, False)] * 1 + [(True, True)] * 5 + [(False, False)] * 4  # 22 pairs
    p = exact(12, 1, False)
    base = dict(
        design="paired", planned=20, observed=22, baseline_total=22, baseline_pass=6, baseline_rate=6 / 22, treated_total=22, treated_pass=17, treated_rate=17 / 22, lift=0.5, alpha=0.05,
        interval=("paired_bootstrap", 0.95, 0.2, 0.8), test=("mcnemar_exact", "two-sided", p),
    )
    changes = [
        ({}, None), ({"interval": None}, None), ({"test": ("exact_mcnemar", "greater", exact(12, 1, True))}, None), ({"design": "crossed"}, "design"), ({"planned": 19}, "planned pairs"),
        ({"planned": 23}, "observed pairs"), ({"observed": 23, "planned": 23}, "number of cases"), ({"baseline_total": 21}, "baseline total"), ({"treated_pass": 16}, "treated passes"),
        ({"treated_rate": 0.7}, "treated rate"), ({"lift": 0.4}, "lift"), ({"alpha": 0.06}, "alpha"), ({"alpha": None}, "alpha"), ({"interval": ("wald", 0.95, 0.2, 0.8)}, "interval"),
        ({"interval": ("paired_bootstrap", 0.9, 0.2, 0.8)}, "interval"), ({"interval": ("paired_bootstrap", 0.95, 0.0, 0.8)}, "interval"), ({"test": ("mcnemar_exact", "two-sided", 0.01)}, "exact test"),
        ({"test": None}, "exact test"), ({"test": ("chi2", "two-sided", p)}, "exact test"),
    ]
    kind = "report_id long, design string, planned int, observed int, baseline_total int, baseline_pass int, baseline_rate double, treated_total int, treated_pass int, treated_rate double, lift double, alpha double, "
    kind += "interval struct<method: string, confidence: double, lower: double, upper: double>, test struct<method: string, alternative: string, p_value: double>"
    reports = [(k, *(base | change).values()) for k, (change, _) in enumerate(changes)] + [(100, *base.values()), (101, *base.values())]
    pairs = [(k, *o) for k in range(len(changes)) for o in outcomes] + [(101, *o) for o in outcomes[:-1]] + [(101, None, True)]
    got = {r["report_id"]: r["fault"] for r in K.evidence_faults(spark.createDataFrame(reports, kind), spark.createDataFrame(pairs, "report_id long, baseline boolean, treated boolean")).collect()}
    assert got == {k: fault for k, (_, fault) in enumerate(changes)} | {100: "number of cases", 101: "cases without outcome"}


def test_profiles(spark):
    before = [("a", "p50", 100.9), ("b", "p50", 100.0), ("c", "p95", 10.0), ("d", "max", 0.0), ("e", "p99", None), ("f", "p50", 5.0)]
    after = [("a", "p50", 125.9), ("b", "p50", 126.0), ("c", "p95", 29.0), ("d", "max", 900.0), ("e", "p99", 1.0), ("g", "p50", 5.0)]
    schema = "metric string, statistic string, value double"
    got = K.profile_regressions(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()
    assert sorted(map(tuple, got)) == [("a", "p50", 100, 125, False), ("b", "p50", 100, 126, True), ("c", "p95", 10, 29, False), ("d", "max", 0, 900, False)]


def test_snapshots(spark):
    before = [("up", 0.5, True), ("down", 0.5, True), ("same", 0.5, True), ("slow", 100.0, False), ("ok", 100.0, False), ("gone", 0.5, True), ("lift", 0.2, True), ("zero", 0.0, False)]
    after = [("up", 0.6, True), ("down", 0.49, True), ("same", 0.5, True), ("slow", 126.0, False), ("ok", 125.0, False), ("new", 0.1, True), ("lift", 0.0, True), ("zero", 9.0, False)]
    kind = "metric string, value double, higher_is_better boolean"
    got = {r["metric"]: r["failure"] for r in K.snapshot_regressions(spark.createDataFrame(before, kind), spark.createDataFrame(after, kind), ["lift"]).collect()}
    assert got == {"up": None, "down": "regressed", "same": None, "slow": "increased", "ok": None, "gone": "regressed", "new": None, "lift": "not positive", "zero": None}
