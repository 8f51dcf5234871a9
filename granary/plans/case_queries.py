"""Queries that judge answers: name -> (query, SQL). Benchmark items are the cases, their lexical results the answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases as K
from ..operators.common import cut
from ..operators.events import nearest_rank, percentiles
from ..operators.retrieval import lexical_topk
from .retrieval_queries import _lexical_sql
from .tables import ROUTES, prompts, routes, table

# Cases and answers by item_id, in words of both engines but for lists.
_CASES = {
    "case_id": "item_id",
    "expected": "case item_id % 3 when 0 then array('full') when 1 then array('hint', 'full') else array('none') end",
    "allowed": "case when item_id % 4 = 0 then array('src1', 'absent') else array() end",
    "forbidden": "case item_id % 5 when 0 then array('*') when 1 then array('src2', 'fr') else array() end",
    "least_hints": "item_id % 7",
}
_ANSWERS = {
    "case_id": "item_id",
    "status": "case when item_id % 13 = 12 then 500 else 200 end",
    "route_id": "case when item_id % 17 = 16 then null else concat('r', item_id) end",
    "tier": "case item_id % 5 when 0 then 'full' when 1 then 'hint' when 2 then 'none' when 3 then 'HINT' else '' end",
    "chosen": "case when item_id % 2 = 0 then 'Top of SRC1' end",
    "latency_ms": "item_id * 37 % 1000",
    "skill_find_ms": "case when item_id % 3 > 0 then item_id * 53 % 700 end",
    "injected_tokens": "item_id * 71 % 1100",
    "response_tokens": "item_id * 97 % 3700",
}


def route_cases(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    cases = items.selectExpr(*[f"{x} as {n}" for n, x in _CASES.items()])
    for name in ("allowed", "forbidden"):
        cases = cases.withColumn(name, F.col(name).cast("array<string>"))
    answers = items.where("item_id % 11 < 10").selectExpr(*[f"{x} as {n}" for n, x in _ANSWERS.items()])
    found = cut(lexical_topk(prompts(spark, d), table(spark, d, "documents"), 5)).select(F.col("query_id").alias("case_id"), "doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("text"), F.concat(F.lit("h"), F.col("doc_id") % 40).alias("content_hash"))
    out = K.route_failures(cases, answers, found.join(docs, "doc_id"))
    return out.withColumn("failures", F.array_join("failures", "|"))


_BUDGETS = ", ".join(f"case when coalesce({c}, 0) > {most} then '{c} over budget' end" for c, most in K.BUDGETS.items())
ROUTE_CASES = f"""
with {_lexical_sql(5)},
cases as (select {", ".join(f"{x} as {n}" for n, x in _CASES.items()).replace("array()", "[]::varchar[]").replace("array(", "list_value(")} from benchmark),
answers as (select {", ".join(f"{x} as {n}" for n, x in _ANSWERS.items())} from benchmark where item_id % 11 < 10),
shown as (
  select query_id as case_id, count(*) as n_candidates, string_agg(lower(source || ' ' || lang), ' ') as texts, count(*) > count(distinct doc_id % 40) as twice
  from lexical join documents using (doc_id) group by query_id
), rows as (
  select c.*, a.* exclude (case_id, tier), lower(coalesce(nullif(tier, ''), 'none')) as tier, coalesce(n_candidates, 0) as n_candidates, coalesce(twice, false) as twice,
         lower(coalesce(chosen, '')) || ' ' || coalesce(texts, '') as surfaced
  from cases c left join answers a using (case_id) left join shown using (case_id)
), judged as (
  select *, list_filter(list_concat([case when coalesce(status, 0) <> 200 then 'status' end, case when coalesce(route_id, '') = '' then 'missing route_id' end,
      case when not list_contains(expected, tier) then 'tier' end, case when tier = 'hint' and n_candidates < least_hints then 'too few candidates' end,
      case when len(allowed) > 0 and len(list_filter(allowed, lambda a: contains(surfaced, a))) = 0 then 'no allowed one surfaced' end],
    list_transform(forbidden, lambda n: case when n = '*' then case when tier <> 'none' then 'an answer where none is allowed' end when contains(surfaced, n) then 'forbidden: ' || n end),
    [{_BUDGETS}, case when twice then 'a content twice' end]), lambda x: x is not null) as failures
  from rows
)
select case_id, tier, n_candidates, array_to_string(failures, '|') as failures, len(failures) = 0 as ok from judged
"""


def score_margins(spark: SparkSession, d: str) -> DataFrame:
    found = lexical_topk(prompts(spark, d), table(spark, d, "documents"), 2, most=None)
    return K.score_margins(found.withColumn("score", F.col("score").cast("double")))


SCORE_MARGINS = f"""
with {_lexical_sql(2, None)}
select query_id, max(score) filter (position = 1)::double as top_score, coalesce(max(score) filter (position = 2), 0)::double as runner_score,
       round(max(score) filter (position = 1)::double - coalesce(max(score) filter (position = 2), 0)::double, 6) as margin
from lexical group by query_id
"""


def keyword_grades(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their own source's last digit and language as needles, where the text must hold them."""
    every = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("E"), F.col("lang"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(". "), F.lit("A")))
    some = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("Password"), F.lit("license"), F.lit("QU")))
    return table(spark, d, "documents").select("doc_id", K.keyword_grade(F.col("text"), every, some).alias("passed"))


KEYWORD_GRADES = """
with asked as (
  select doc_id, lower(coalesce(text, '')) as t, case doc_id % 3 when 0 then ['e', lower(lang)] when 1 then ['. ', 'a'] else [] end as every_one,
         case when doc_id % 2 = 0 then ['password', 'license', 'qu'] else [] end as one_of
  from documents
)
select doc_id, len(list_filter(every_one, lambda n: not contains(t, n))) = 0 and (len(one_of) = 0 or len(list_filter(one_of, lambda n: contains(t, n))) > 0) as passed from asked
"""

# A report for each user from two of their outcomes a pair; some are reported wrongly, by user_id.
_PAIRS = "select user_id as report_id, event_id % 7 in (0, 1) as baseline, event_id % 7 in (0, 2, 3, 4) as treated from {events} where event_id % 50 > 0 or user_id % 9 > 0"
_REPORTS = """
select report_id, case when report_id % 10 = 1 then 'unpaired' else 'paired' end as design, case when report_id % 10 = 2 then 19 else 20 end as planned, n as observed,
       case when report_id % 10 = 3 then n + 1 else n end as baseline_total, case when report_id % 10 = 4 then b + 1 else b end as baseline_pass, round(b * 1.0 / n, 5) as baseline_rate,
       n as treated_total, t as treated_pass, round(case when report_id % 10 = 5 then 0.5 else t * 1.0 / n end, 5) as treated_rate, round((t - b) * 1.0 / n, 6) as lift,
       case when report_id % 10 = 6 then 0.1 else 0.05 end as alpha, report_id % 10 = 7 as bad_interval, report_id % 3 = 0 as no_interval,
       case when report_id % 10 = 8 then 'guess' else 'mcnemar_exact' end as method, case when report_id % 2 = 0 then 'greater' else 'two-sided' end as alternative, wins, losses
from (select report_id, count(*) as n, sum(cast(baseline as int)) as b, sum(cast(treated as int)) as t, sum(cast(not baseline and treated as int)) as wins, sum(cast(baseline and not treated as int)) as losses from pairs group by report_id) x
"""


def evidence_faults(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("user_id", F.col("user_id") % 40)
    pairs = spark.sql(_PAIRS.format(events="{events}"), events=events)
    rows = spark.sql(_REPORTS.replace("from pairs", "from {pairs}"), pairs=pairs)
    p = F.when(F.col("alternative") == "greater", K._upper_tail(F.col("wins"), F.col("wins") + F.col("losses"))).otherwise(K.mcnemar_exact(F.col("wins"), F.col("losses")))
    interval = F.struct(F.lit("paired_bootstrap").alias("method"), F.lit(0.95).alias("confidence"), F.when(F.col("bad_interval"), -0.1).otherwise(0.1).alias("lower"), F.lit(0.4).alias("upper"))
    reports = rows.withColumn("interval", F.when(~F.col("no_interval"), interval))
    reports = reports.withColumn("test", F.struct("method", "alternative", F.when(F.col("report_id") % 10 == 9, p + 0.001).otherwise(p).alias("p_value")))
    return K.evidence_faults(reports.drop("wins", "losses", "method", "alternative"), pairs)


_TERM = "exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2.0::double))"
EVIDENCE_FAULTS = f"""
with pairs as ({_PAIRS.format(events="(select * replace (user_id % 40 as user_id) from events)")}), reports as ({_REPORTS}),
tails as (
  select *, case when alternative = 'greater' then (select sum({_TERM}) from range(0, 100000) r(k) where k between wins and wins + losses)
      else least(1.0::double, 2 * (select sum({_TERM}) from range(0, 100000) r(k) where k <= least(wins, losses))) end as p
  from reports
)
select report_id, case when design <> 'paired' then 'design' when planned < 20 then 'planned pairs' when observed < planned then 'observed pairs' when baseline_total <> observed then 'baseline total'
    when report_id % 10 = 4 then 'baseline passes' when abs(baseline_rate - baseline_pass * 1.0 / observed) > 1e-4 then 'baseline rate' when abs(treated_rate - treated_pass * 1.0 / observed) > 1e-4 then 'treated rate'
    when alpha > 0.05 then 'alpha' when bad_interval and not no_interval then 'interval' when method <> 'mcnemar_exact' or report_id % 10 = 9 or p > alpha then 'exact test' end as fault
from tails
"""


def profile_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Latencies by family in the first and in the second half of the users, scaled to milliseconds."""
    rows = routes(spark, d).select("family", "user_id", (F.col("latency") * F.when(F.col("user_id") % 2 == 0, 10).otherwise(F.when(F.col("family") == "click", 14).otherwise(11))).alias("ms"))

    def profile(part: DataFrame) -> DataFrame:
        points = percentiles(part, ["family"], "ms", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95), "p99": nearest_rank(0.99), "max": F.col("rows") - 1})
        return points.selectExpr("family as metric", "stack(4, 'p50', p50, 'p95', p95, 'p99', p99, 'max', max) as (statistic, value)")

    return K.profile_regressions(profile(rows.where("user_id % 2 = 0")), profile(rows.where("user_id % 2 = 1")))


PROFILE_REGRESSIONS = f"""
with {ROUTES}, rows as (select family, user_id % 2 as half, latency * case when user_id % 2 = 0 then 10 when family = 'click' then 14 else 11 end as ms from routes where latency is not null),
sorted as (select family, half, list(ms order by ms) as v from rows group by all),
points as (
  select family, half, unnest(['p50', 'p95', 'p99', 'max']) as statistic,
         trunc(unnest([v[1 + round_even((len(v) - 1) * 0.5, 0)::int], v[1 + round_even((len(v) - 1) * 0.95, 0)::int], v[1 + round_even((len(v) - 1) * 0.99, 0)::int], v[len(v)]]))::bigint as value
  from sorted
)
select a.family as metric, statistic, a.value as before, b.value as after, a.value > 0 and b.value - a.value >= 20 and b.value > a.value * 1.25::double as regressed
from (select * from points where half = 0) a join (select * from points where half = 1) b using (family, statistic)
"""

def snapshot_gate(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes and latencies by family of users with even and with odd numbers, and what the odd ones gain in positive outcomes."""
    rows = routes(spark, d).withColumn("positive", F.coalesce(F.col("outcome").isin("used", "installed"), F.lit(False)).cast("double"))

    def snapshot(half: int, scale: float) -> DataFrame:
        own = rows.where(F.col("user_id") % 2 == half)
        rates = own.groupBy("family").agg(F.round(F.avg("positive") * F.lit(scale), 6).alias("value")).where(f"family <> 'signup' or {half} = 0")
        times = own.groupBy("family").agg(F.round(F.avg("latency") * F.when(F.col("family") == "click", scale), 6).alias("value"))
        lift = own.agg(F.round(F.avg("positive") - 0.5, 6).alias("value"))
        out = rates.select(F.concat("family", F.lit(".rate")).alias("metric"), "value", F.lit(True).alias("higher_is_better"))
        out = out.unionByName(times.select(F.concat("family", F.lit(".ms")).alias("metric"), "value", F.lit(False).alias("higher_is_better")))
        return out.unionByName(lift.select(F.lit("lift").alias("metric"), "value", F.lit(True).alias("higher_is_better")))

    return K.snapshot_regressions(snapshot(0, 1.0), snapshot(1, 1.5), ["lift"])


def _snapshot_sql(half: int, scale: float) -> str:
    return f"""
  select family || '.rate' as metric, round(avg(p) * {scale}::double, 6) as value, true as high from rows where user_id % 2 = {half} and (family <> 'signup' or {half} = 0) group by family
  union all select family || '.ms', case when family = 'click' then round(avg(latency) * {scale}::double, 6) end, false from rows where user_id % 2 = {half} group by family
  union all select 'lift', round(avg(p) - 0.5, 6), true from rows where user_id % 2 = {half}"""


SNAPSHOT_GATE = f"""
with {ROUTES}, rows as (select *, coalesce(outcome in ('used', 'installed'), false)::int::double as p from routes),
a as ({_snapshot_sql(0, 1.0)}), b as ({_snapshot_sql(1, 1.5)}),
both_of as (select metric, coalesce(a.value, 0) as before, coalesce(b.value, 0) as after, coalesce(a.high, b.high) as high from a full join b using (metric))
select metric, before, after, case when metric = 'lift' and after <= 0 then 'not positive' when high and after < before then 'regressed' when not high and before > 0 and after > before * 1.25::double then 'increased' end as failure
from both_of
"""

QUERIES = {
    "snapshot_gate": (snapshot_gate, SNAPSHOT_GATE),
    "route_cases": (route_cases, ROUTE_CASES),
    "score_margins": (score_margins, SCORE_MARGINS),
    "keyword_grades": (keyword_grades, KEYWORD_GRADES),
    "evidence_faults": (evidence_faults, EVIDENCE_FAULTS),
    "profile_regressions": (profile_regressions, PROFILE_REGRESSIONS),
}
