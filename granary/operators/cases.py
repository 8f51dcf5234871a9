"""Judging answers against cases: route cases, margins, keyword grades, evidence for a lift, and slower profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import mcnemar_exact

# Budgets of an answer in milliseconds and tokens.
BUDGETS = {"latency_ms": 750, "skill_find_ms": 500, "injected_tokens": 1000, "response_tokens": 3500}
#: Pairs that evidence needs at least, the largest alpha, methods of intervals and tests that count.
LEAST_PAIRS, MOST_ALPHA = 20, 0.05
INTERVALS, TESTS = ["paired_bootstrap", "paired_bootstrap_percentile"], ["mcnemar_exact", "exact_mcnemar"]
SLOWDOWN, LEAST_SLOWDOWN_MS = 0.25, 20


def route_failures(cases: DataFrame, answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case_id, tier, n_candidates, failures, ok): what each answer gets wrong.

    cases: case_id, expected (tiers), allowed and forbidden (lower-case needles, ``*`` forbids any answer), least_hints.
    answers: case_id, status, route_id, tier, chosen (text of the chosen row) and the columns of BUDGETS, null as 0.
    candidates: case_id, text, content_hash, a bounded list for each case. A case without answer fails on its status.
    """
    shown = candidates.groupBy("case_id").agg(
        F.count("*").alias("n_candidates"),
        F.array_join(F.array_sort(F.collect_list(F.lower(F.coalesce("text", F.lit(""))))), " ").alias("texts"),
        F.count(F.when(F.col("content_hash") != "", 1)).alias("hashed"),
        F.countDistinct(F.when(F.col("content_hash") != "", F.col("content_hash"))).alias("hashes"),
    )
    rows = cases.join(answers, "case_id", "left").join(shown, "case_id", "left")
    rows = rows.withColumn("tier", F.lower(F.coalesce(F.when(F.col("tier") != "", F.col("tier")), F.lit("none"))))
    rows = rows.withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
    rows = rows.withColumn("surfaced", F.concat(F.lower(F.coalesce("chosen", F.lit(""))), F.lit(" "), F.coalesce("texts", F.lit(""))))
    surfaced = F.col("surfaced")

    def when(condition: Column, reason: str) -> Column:
        return F.when(condition, F.array(F.lit(reason))).otherwise(F.array().cast("array<string>"))

    def forbidden(needle: Column) -> Column:
        star = F.when(F.col("tier") != "none", "an answer where none is allowed")
        return F.when(needle == "*", star).otherwise(F.when(surfaced.contains(needle), F.concat(F.lit("forbidden: "), needle)))

    failures = [
        when(~F.coalesce(F.col("status") == 200, F.lit(False)), "status"),
        when(F.coalesce("route_id", F.lit("")) == "", "missing route_id"),
        when(~F.array_contains("expected", F.col("tier")), "tier"),
        when((F.col("tier") == "hint") & (F.col("n_candidates") < F.col("least_hints")), "too few candidates"),
        when((F.size("allowed") > 0) & ~F.exists("allowed", lambda a: surfaced.contains(a)), "no allowed one surfaced"),
        F.array_compact(F.transform("forbidden", forbidden)),
        *[when(F.coalesce(F.col(c), F.lit(0)) > most, f"{c} over budget") for c, most in BUDGETS.items()],
        when(F.col("hashed") > F.col("hashes"), "a content twice"),
    ]
    rows = rows.withColumn("failures", F.concat(*failures))
    return rows.select("case_id", "tier", "n_candidates", "failures", (F.size("failures") == 0).alias("ok"))


def score_margins(ranked: DataFrame) -> DataFrame:
    """(query_id, top_score, runner_score, margin) of the first two results of each query; a missing score is 0."""
    top, runner = (F.max(F.when(F.col("position") == k, F.coalesce("score", F.lit(0.0)))) for k in (1, 2))
    out = ranked.where("position <= 2").groupBy("query_id").agg(top.alias("top_score"), F.coalesce(runner, F.lit(0.0)).alias("runner_score"))
    return out.withColumn("margin", F.round(F.col("top_score") - F.col("runner_score"), 6))


def keyword_grade(text: Column, every: Column, some: Column) -> Column:
    """Whether a text holds all of ``every`` and one of ``some``, in any case; an empty or null list asks for nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    none = F.array().cast("array<string>")
    every, some = F.coalesce(every, none), F.coalesce(some, none)
    return F.forall(every, lambda n: low.contains(F.lower(n))) & ((F.size(some) == 0) | F.exists(some, lambda n: low.contains(F.lower(n))))


def evidence_faults(reports: DataFrame, pairs: DataFrame) -> DataFrame:
    """(report_id, fault): the first reason why a reported lift lacks evidence, null where it stands.

    reports: report_id, design, planned, observed, baseline_total, baseline_pass, baseline_rate, treated_total, treated_pass,
    treated_rate, lift, alpha, interval struct(method, confidence, lower, upper) or null, and test struct(method,
    alternative, p_value). pairs: report_id, baseline, treated (booleans). Everything that follows from the pairs is counted
    anew, the exact test included; pairs are counted, never gathered.
    """
    b, t = F.col("baseline"), F.col("treated")
    counted = pairs.groupBy("report_id").agg(
        F.count("*").alias("n"),
        F.count_if(b.isNull() | t.isNull()).alias("unjudged"),
        F.count_if(b).alias("b"),
        F.count_if(t).alias("t"),
        F.count_if(~b & t).alias("wins"),
        F.count_if(b & ~t).alias("losses"),
    )
    rows = reports.join(counted, "report_id", "left").na.fill(0, ["n", "unjudged", "b", "t", "wins", "losses"])
    both = mcnemar_exact(F.col("wins"), F.col("losses"))
    rows = rows.withColumn("two_sided", both).withColumn("one_sided", _upper_tail(F.col("wins"), F.col("wins") + F.col("losses")))
    c, missing = F.col, F.lit(False)

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, missing)

    def near(a: Column, b: Column, by: float = 1e-4) -> Column:
        return holds(F.abs(a - b) <= by)

    rules = [(holds(c("design") == "paired"), "design"), (holds(c("planned") >= LEAST_PAIRS), "planned pairs"), (holds(c("observed") >= c("planned")), "observed pairs")]
    rules += [(holds(c("n") == c("observed")), "number of cases"), (c("unjudged") == 0, "cases without outcome")]
    for arm, passed in (("baseline", "b"), ("treated", "t")):
        rules += [(holds(c(f"{arm}_total") == c("observed")), f"{arm} total"), (holds(c(f"{arm}_pass") == c(passed)), f"{arm} passes"), (near(c(f"{arm}_rate"), c(passed) / c("observed")), f"{arm} rate")]
    rules += [(near(c("lift"), (c("t") - c("b")) / c("observed")), "lift"), (holds((c("alpha") > 0) & (c("alpha") <= MOST_ALPHA)), "alpha")]
    i, test = c("interval"), c("test")
    sound = holds(i["method"].isin(INTERVALS) & (i["confidence"] >= 1 - c("alpha")) & (i["lower"] > 0) & (i["lower"] <= i["upper"]))
    p = F.when(test["alternative"] == "greater", c("one_sided")).otherwise(c("two_sided"))
    tested = test["method"].isin(TESTS) & test["alternative"].isin("greater", "two-sided") & (test["p_value"] >= 0) & (test["p_value"] <= c("alpha")) & (F.abs(test["p_value"] - p) <= 1e-9)
    rules += [(i.isNull() | sound, "interval"), (holds(tested), "exact test")]
    return rows.select("report_id", F.coalesce(*[F.when(~ok, F.lit(fault)) for ok, fault in rules]).alias("fault"))


def _upper_tail(wins: Column, n: Column) -> Column:
    """P(X >= wins) for n fair coins, summed from the end in logarithms."""
    wins, n = wins.cast("int"), n.cast("int")
    last = F.exp(-n * F.log(F.lit(2.0)))
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), last.alias("tail"))

    def add(state: Column, k: Column) -> Column:
        term = state["term"] + F.log((n - k + 1).cast("double")) - F.log(k.cast("double"))
        return F.struct(term.alias("term"), (state["tail"] + F.exp(term)).alias("tail"))

    # the tail above wins is the tail below n - wins
    steps = F.when(n > wins, F.sequence(F.lit(1), F.greatest(n - wins, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.least(F.lit(1.0), F.aggregate(steps, start, add)["tail"])


def profile_regressions(before: DataFrame, after: DataFrame, slowdown: float = SLOWDOWN, least_ms: int = LEAST_SLOWDOWN_MS) -> DataFrame:
    """(metric, statistic, before, after, regressed) of the statistics (metric, statistic, value) that both profiles have.

    Values are cut to whole numbers. A statistic is slower only if it grew by ``least_ms`` and by more than ``slowdown`` of
    what it was; one that was 0 is not judged.
    """
    a = before.where("value is not null").select("metric", "statistic", F.col("value").cast("long").alias("before"))
    b = after.where("value is not null").select("metric", "statistic", F.col("value").cast("long").alias("after"))
    slower = (F.col("before") > 0) & (F.col("after") - F.col("before") >= least_ms) & (F.col("after") > F.col("before") * (1 + slowdown))
    return a.join(b, ["metric", "statistic"]).withColumn("regressed", slower)


def snapshot_regressions(before: DataFrame, after: DataFrame, positive: list[str] = (), slowdown: float = SLOWDOWN) -> DataFrame:
    """(metric, before, after, failure) of the metrics (metric, value, higher_is_better) of two snapshots.

    A metric that a snapshot lacks is 0 in it. Where higher is better any decrease is a failure; otherwise an increase by more
    than ``slowdown`` of what it was, unless that was 0. Metrics named in ``positive`` fail whenever they are not above 0.
    """
    a = before.select("metric", F.col("value").cast("double").alias("before"), F.col("higher_is_better").alias("high"))
    b = after.select("metric", F.col("value").cast("double").alias("after"), F.col("higher_is_better").alias("high2"))
    both = a.join(b, "metric", "full").na.fill(0.0, ["before", "after"]).withColumn("high", F.coalesce("high", "high2"))
    failure = (
        F.when(F.col("metric").isin(list(positive)) & (F.col("after") <= 0), "not positive")
        .when(F.col("high") & (F.col("after") < F.col("before")), "regressed")
        .when(~F.col("high") & (F.col("before") > 0) & (F.col("after") > F.col("before") * (1 + slowdown)), "increased")
    )
    return both.select("metric", "before", "after", failure.alias("failure"))
