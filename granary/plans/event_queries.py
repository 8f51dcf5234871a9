"""Event, account and statistics queries: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap as B
from ..operators import events as E
from ..operators import stats as S
from ..operators.asof import latest_before
from .tables import ROUTES, corpus, routes, table
from .retrieval_queries import CORPUS

HOURS = 240


def event_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.event_summary(E.windowed(routes(spark, d), HOURS), 50.0)


EVENT_SUMMARY = f"""
with {ROUTES}
select count(*) as total, count(distinct user_id) as users, count(*) filter (outcome is null) as pending,
       count(*) filter (outcome in ('used', 'installed')) as positive,
       count(distinct case when outcome in ('failed', 'dismissed') then item_id end) as items_with_negatives,
       floor(avg(latency))::bigint as avg_latency, floor(max(latency))::bigint as max_latency, count(*) filter (latency > 50) as breaches
from routes where ts >= (select max(ts) from routes) - interval {HOURS} hours
"""


def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.outcome_counts(routes(spark, d))


def slowest_events(spark: SparkSession, d: str) -> DataFrame:
    return E.slowest(routes(spark, d))


def top_items(spark: SparkSession, d: str) -> DataFrame:
    return E.top_items(routes(spark, d))


TOP_ITEMS = f"""
with {ROUTES}
select item_id, count(*) as n, count(outcome) as feedback, count(*) filter (outcome in ('used', 'installed')) as positive, floor(avg(latency))::bigint as avg_latency
from routes group by item_id order by n desc, positive desc, item_id limit 10
"""


def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    return E.percentiles(routes(spark, d), ["family"], "latency", {"p50": E.nearest_rank(0.5), "p95": E.nearest_rank(0.95)})


def percentile_ceiling(spark: SparkSession, d: str) -> DataFrame:
    return E.percentiles(routes(spark, d), ["family"], "latency", {"p50": E.ceiling_rank(0.5), "p95": E.ceiling_rank(0.95)})


def percentile_linear(spark: SparkSession, d: str) -> DataFrame:
    out = E.linear_percentile(routes(spark, d), ["family"], "latency", 0.95, "p95")
    return out.withColumn("p95", F.round("p95", 6))


_SORTED = f"with {ROUTES}, sorted as (select family, list_sort(list(latency)) as v, count(*) as n from routes group by family)"
NEAREST = f"{_SORTED} select family, v[round_even((n - 1) * 0.5, 0)::bigint + 1] as p50, v[round_even((n - 1) * 0.95, 0)::bigint + 1] as p95 from sorted"
CEILING = f"{_SORTED} select family, v[ceil(n * 0.5::double)::bigint] as p50, v[ceil(n * 0.95::double)::bigint] as p95 from sorted"
LINEAR = f"with {ROUTES} select family, round(quantile_cont(latency, 0.95), 6) as p95 from routes group by family"


def impact_report(spark: SparkSession, d: str) -> DataFrame:
    return E.impact_report(routes(spark, d))


IMPACT = f"""
with {ROUTES}, open_items as (
  select user_id, count(*) as undiscovered from (
    select distinct user_id, item_id from routes where outcome is null or outcome <> 'installed'
    except select distinct user_id, item_id from routes where outcome = 'installed'
  ) group by user_id
)
select user_id, n, families, within_budget, avg_latency, coalesce(undiscovered, 0) as undiscovered from (
  select user_id, count(*) as n, count(distinct family) as families, round(count(*) filter (latency <= 50) / count(*), 6) as within_budget, round(avg(latency), 9) as avg_latency
  from routes group by user_id
) left join open_items using (user_id)
"""


def reused_items(spark: SparkSession, d: str) -> DataFrame:
    return E.reused_items(routes(spark, d))


def returning_families(spark: SparkSession, d: str) -> DataFrame:
    return E.returning_families(routes(spark, d))


def engagement_sequence(spark: SparkSession, d: str) -> DataFrame:
    return E.engagement(routes(spark, d), 6 * 3600)


ENGAGEMENT = f"""
with {ROUTES}, seen as (
  select *, lag(ts) over w as prev_ts, lag(family) over w as prev_family from routes window w as (partition by user_id order by ts, event_id)
)
select user_id, count(*) filter (epoch_us(ts) - epoch_us(prev_ts) <= 21600000000 and family = prev_family) as reroutes,
       count(*) filter (ts::date = prev_ts::date) as continuations, count(*) filter (outcome in ('failed', 'dismissed')) as rejections
from seen group by user_id
"""


def feedback_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    items = corpus(spark, d).select(F.col("doc_id").alias("item_id"), "content_hash")
    return E.feedback_scores(routes(spark, d), items)


FEEDBACK = f"""
with {ROUTES}, {CORPUS}, pooled as (
  select content_hash, count(*) filter (outcome in ('used', 'installed')) as pos, count(*) filter (outcome in ('failed', 'dismissed')) as neg
  from routes join corpus on item_id = doc_id where content_hash <> '' group by content_hash
)
select doc_id as item_id, round(case when pos + neg is null then null when pos + neg < 8 then 0.5 else (pos + 4.0::double) / (pos + neg + 8.0::double) end, 9) as feedback
from corpus left join pooled using (content_hash)
"""


def concentration(spark: SparkSession, d: str) -> DataFrame:
    return E.concentration(routes(spark, d))


CONCENTRATION = f"""
with {ROUTES}, shares as (select count(*)::double / sum(count(*)) over () as s from routes group by item_id)
select count(*) as items, round(max(s), 9) as largest, round(sum(s * s), 9) as hhi, round(-sum(s * log2(s)), 9) as entropy_bits from shares
"""


def bandit_weights(spark: SparkSession, d: str) -> DataFrame:
    return E.bandit_weights(routes(spark, d).withColumn("family", F.pmod("item_id", F.lit(7)).cast("string")))


_BANDIT = f"""
with {ROUTES}, own as (
  select item_id, (item_id % 7)::varchar as family, count(*) filter (outcome in ('used', 'installed')) as s, count(*) filter (outcome in ('failed', 'dismissed')) as f
  from routes group by item_id
), fam as (select family, (sum(s) + 1)::double / (sum(s) + sum(f) + 2) as family_mean from own group by family),
weights as (
  select item_id, family, s + f as observations, round((s + 1)::double / (s + f + 2), 9) as posterior,
         round(case when s + f >= 5 then (s + 1)::double / (s + f + 2) else family_mean end, 9) as weight
  from own join fam using (family)
)"""


def personalised_order(spark: SparkSession, d: str) -> DataFrame:
    scored = routes(spark, d).groupBy("item_id").agg(F.round(F.avg("latency"), 6).alias("score"))
    return E.personalised_order(scored, bandit_weights(spark, d))


PERSONALISED = f"""{_BANDIT}
select * from (
  select family, item_id, personal, row_number() over (partition by family order by personal desc, item_id) as position from (
    select family, item_id, round(score * (1 + 0.3::double * (weight - 0.5)), 9) as personal
    from weights join (select item_id, round(avg(latency), 6) as score from routes group by item_id) using (item_id)
  )
) where position <= 10
"""


def monthly_usage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return rows.agg(F.count("*").alias("n"))


def org_pool(spark: SparkSession, d: str) -> DataFrame:
    """Usage of each organisation's members in the newest month, with seats and the share of members that used it."""
    orders = table(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    newest = orders.agg(F.max("month").alias("month"))
    usage = orders.join(F.broadcast(newest), "month").groupBy("o_custkey").agg(F.count("*").alias("n"))
    members = table(spark, d, "customer").join(usage, F.col("c_custkey") == F.col("o_custkey"), "left")
    pools = members.groupBy("c_nationkey").agg(
        F.count("*").alias("seats"), F.coalesce(F.sum("n"), F.lit(0)).alias("used"), F.count("n").alias("active_members")
    )
    return table(spark, d, "nation").join(pools, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "seats", "used", "active_members")


ORG_POOL = """
select n_name, count(*) as seats, coalesce(sum(n), 0)::bigint as used, count(n) as active_members
from nation join customer on n_nationkey = c_nationkey
left join (select o_custkey, count(*) as n from orders where strftime(o_orderdate, '%Y-%m') = (select max(strftime(o_orderdate, '%Y-%m')) from orders) group by o_custkey) on c_custkey = o_custkey
group by n_name
"""


def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    paid = F.col("c_acctbal") > 0
    return rows.groupBy(F.col("c_mktsegment").alias("plan")).agg(
        F.count("*").alias("users"), F.count_if(paid).alias("paying"), F.count_if(F.col("c_acctbal") > 9000).alias("over_quota")
    )


def user_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with orders and events counted apart, then joined: no fan-out, no query per user."""
    orders = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last_order"))
    seen = routes(spark, d).groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("outcome").isin(E.POSITIVE)).alias("positive"))
    out = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(seen, F.col("c_custkey") == F.col("user_id"), "left")
    zero = F.lit(0)
    return out.select(
        "c_custkey",
        F.coalesce("orders", zero).alias("orders"),
        F.date_format("last_order", "yyyy-MM-dd").alias("last_order"),
        F.coalesce("events", zero).alias("events"),
        F.coalesce("positive", zero).alias("positive"),
    )


USER_ROLLUP = f"""
with {ROUTES}
select c_custkey, coalesce(orders, 0) as orders, strftime(last_order, '%Y-%m-%d') as last_order, coalesce(n, 0) as events, coalesce(positive, 0) as positive
from customer left join (select o_custkey, count(*) as orders, max(o_orderdate) as last_order from orders group by o_custkey) on c_custkey = o_custkey
left join (select user_id, count(*) as n, count(*) filter (outcome in ('used', 'installed')) as positive from routes group by user_id) on c_custkey = user_id
"""


def latest_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return E.latest_per_key(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


LATEST = """
select o_custkey, o_orderkey, o_orderstatus from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders
) where place = 1
"""


def stale_runs(spark: SparkSession, d: str) -> DataFrame:
    running = table(spark, d, "orders").where("o_orderstatus = 'O'")
    return E.stale_rows(running, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey")


STALE = """
select o_custkey, o_orderkey from (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders where o_orderstatus = 'O'
) where place > 1
"""


def last_n_retention(spark: SparkSession, d: str) -> DataFrame:
    rows = E.windowed(routes(spark, d), HOURS)
    return E.last_n(rows, "user_id", [F.desc("ts"), F.desc("event_id")], 12).select("user_id", "event_id", "position")


LAST_N = f"""
with {ROUTES} select * from (
  select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as position
  from routes where ts >= (select max(ts) from routes) - interval {HOURS} hours
) where position <= 12
"""


def demand_priority(spark: SparkSession, d: str) -> DataFrame:
    seen = routes(spark, d).groupBy(F.col("item_id").alias("doc_id")).agg(
        F.count("*").alias("routes"), F.count_if(F.col("outcome").isin(E.POSITIVE)).alias("positive")
    )
    rows = corpus(spark, d).join(seen, "doc_id", "left").na.fill(0, ["routes", "positive"])
    score = 1000 * F.col("positive") + 10 * F.col("routes") + 2 * F.log1p(F.length("text").cast("double")) + 0.01 * F.col("quality")
    return rows.select("doc_id", "routes", "positive", F.round(score, 6).alias("priority"))


DEMAND = f"""
with {ROUTES}, {CORPUS}
select doc_id, coalesce(n, 0) as routes, coalesce(positive, 0) as positive,
       round(1000 * coalesce(positive, 0) + 10 * coalesce(n, 0) + 2 * ln(1 + length(text)::double) + 0.01::double * quality, 6) as priority
from corpus left join (select item_id, count(*) as n, count(*) filter (outcome in ('used', 'installed')) as positive from routes group by item_id) on item_id = doc_id
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Two arms on each labelled document: long enough (control) against not toxic (treatment)."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "source"), "doc_id")
    return rows.select(
        "doc_id", "source", "quality", "toxic", (F.col("n_chars") > 800).cast("int").alias("control"), (1 - F.col("toxic")).alias("treatment")
    )


def paired_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = S.paired_outcomes(_judged(spark, d))
    return rows.withColumn("p_value", F.round(S.mcnemar_exact(F.col("wins"), F.col("losses")), 9))


_JUDGED = "judged as (select l.doc_id, source, quality, toxic, (n_chars > 800)::int as control, 1 - toxic as treatment from labels l join documents using (doc_id))"
PAIRED = f"""
with {_JUDGED}, counts as (
  select count(*) filter (treatment > control) as wins, count(*) filter (treatment < control) as losses, count(*) filter (treatment = control) as ties from judged
), logs as (select unnest(range(0, wins + losses + 1)) as k, wins, losses from counts),
terms as (select *, -(wins + losses) * ln(2.0::double) + lgamma(wins + losses + 1.0::double) - lgamma(k + 1.0::double) - lgamma(wins + losses - k + 1.0::double) as t from logs)
select c.wins, c.losses, c.ties, round(case when c.wins + c.losses = 0 then 1.0 else least(1.0::double, 2 * (select sum(exp(t)) from terms where k <= least(wins, losses))) end, 9) as p_value
from counts c
"""


def wilson_by_source(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d).groupBy("source").agg(F.sum("treatment").alias("good"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("good"), F.col("n"))
    return rows.select("source", "good", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


WILSON = f"""
with {_JUDGED}, g as (select source, sum(treatment)::bigint as good, count(*) as n, sum(treatment)::double / count(*) as p, 1.96::double as z from judged group by source)
select source, good, n,
       round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) as low,
       round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) as high
from g
"""


def gate_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d).select((F.col("control") == 1).alias("decision"), (F.col("quality") == 1).alias("truth"))
    return S.gate_metrics(rows, "decision", "truth")


GATE = f"""
with {_JUDGED}, c as (
  select count(*) as n, count(*) filter (control = 1 and quality = 1) as tp, count(*) filter (control = 1 and quality <> 1) as fp,
         count(*) filter (control <> 1 and quality = 1) as fn, count(*) filter (control <> 1 and quality <> 1) as tn from judged
)
select n, round(tp / nullif(tp + fp, 0), 9) as precision, round(tp / nullif(tp + fn, 0), 9) as recall, round(fp / nullif(fp + tn, 0), 9) as false_positive_rate from c
"""


def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = routes(spark, d)
    middle = rows.agg(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 as bigint))").alias("middle"))
    rows = rows.crossJoin(F.broadcast(middle))
    before, after = (rows.where(c).groupBy("family").agg(F.round(F.avg("latency"), 6).alias("value")) for c in ("ts < middle", "ts >= middle"))
    return S.regression_gate(before, after, "family", 0.01)


REGRESSION = f"""
with {ROUTES}, m as (select make_timestamp(((epoch_us(min(ts)) + epoch_us(max(ts))) / 2)::bigint) as middle from routes),
v as (select family, round(avg(latency) filter (ts < middle), 6) as before, round(avg(latency) filter (ts >= middle), 6) as after from routes, m group by family)
select family, before, after, round((after - before) / before, 9) as change, coalesce(round((after - before) / before, 9) > 0.01, false) as regressed from v
"""


def bootstrap_lift(spark: SparkSession, d: str) -> DataFrame:
    rows = routes(spark, d).select(F.col("event_id").alias("id"), (F.col("user_id") % 2 == 0).alias("treated"), F.col("latency").alias("value"))
    return B.mean_lift(rows)


BOOTSTRAP_LIFT = f"""
with {ROUTES}, own as (select event_id as id, user_id % 2 = 0 as treated, latency as value from routes where latency is not null),
drawn as (select draw, treated, sum(w * value) as s, sum(w) as n from {B.drawn_sql("own", "id")} group by all),
lifts as (
  select draw, (t.s / t.n) / (c.s / c.n) - 1 as lift from (select * from drawn where treated) t join (select * from drawn where not treated) c using (draw)
  where t.n > 0 and c.n > 0 and c.s <> 0
)
select count(*) as draws, round(quantile_cont(lift, 0.025), 6) as low, round(quantile_cont(lift, 0.975), 6) as high,
       (select round(avg(value) filter (treated) / avg(value) filter (not treated) - 1, 6) from own) as lift
from lifts
"""


def cluster_difference(spark: SparkSession, d: str) -> DataFrame:
    """Users are clusters; their even events are one arm, the others the other, and positive outcomes are hits."""
    odd, hit = (F.col("event_id") % 2 == 1).cast("int"), F.coalesce(F.col("outcome").isin(E.POSITIVE), F.lit(False)).cast("int")
    rows = routes(spark, d).select(
        F.col("user_id").alias("cluster"),
        ((1 - odd) * hit).alias("control_hits"),
        (1 - odd).alias("control_n"),
        (odd * hit).alias("treatment_hits"),
        odd.alias("treatment_n"),
    )
    return B.cluster_difference(rows)


CLUSTER_DIFFERENCE = f"""
with {ROUTES}, own as (
  select user_id as id, sum((event_id % 2 = 0 and hit)::int) as ch, sum((event_id % 2 = 0)::int) as cn, sum((event_id % 2 = 1 and hit)::int) as th, sum((event_id % 2 = 1)::int) as tn
  from (select *, coalesce(outcome in ('used', 'installed'), false) as hit from routes where user_id is not null) group by user_id
), drawn as (
  select draw, sum(w * th)::double / nullif(sum(w * tn), 0) - sum(w * ch)::double / nullif(sum(w * cn), 0) as difference from {B.drawn_sql("own", "id")} group by draw
)
select count(*) as clusters, count(*) filter (cn > 0 and tn > 0 and th * cn > ch * tn) as wins, count(*) filter (cn > 0 and tn > 0 and th * cn < ch * tn) as losses,
       count(*) filter (cn > 0 and tn > 0 and th * cn = ch * tn) as ties, round(sum(ch)::double / sum(cn), 6) as control, round(sum(th)::double / sum(tn), 6) as treatment,
       round(sum(th)::double / sum(tn) - sum(ch)::double / sum(cn), 6) as difference,
       (select count(difference) from drawn) as draws, (select round(quantile_cont(difference, 0.025), 6) from drawn) as low, (select round(quantile_cont(difference, 0.975), 6) from drawn) as high
from own
"""


def median_reduction(spark: SparkSession, d: str) -> DataFrame:
    arm = F.when(F.col("user_id") % 3 == 0, "holdout").when(F.col("user_id") % 3 == 1, "routed")
    rows = routes(spark, d).select(F.col("event_id").alias("id"), "family", arm.alias("arm"), F.col("latency").alias("value"))
    return B.median_reduction(rows, "family")


MEDIAN_REDUCTION = f"""
with {ROUTES}, own as (
  select event_id as id, family, case user_id % 3 when 0 then 'holdout' when 1 then 'routed' end as arm, latency as value from routes where user_id % 3 < 2 and latency is not null
), placed as (
  select family, arm, draw, value, w, sum(w) over (partition by family, arm, draw order by value, id rows unbounded preceding) as upto, sum(w) over (partition by family, arm, draw) as n
  from {B.drawn_sql("own", "id")}
), medians as (
  select family, arm, draw, (max(value) filter (upto - w <= (n - 1) // 2 and (n - 1) // 2 < upto) + max(value) filter (upto - w <= n // 2 and n // 2 < upto)) / 2 as m
  from placed where n > 0 group by all
), drawn as (
  select h.family, (h.m - r.m) / h.m * 100 as reduction from (select * from medians where arm = 'holdout' and m <> 0) h join (select * from medians where arm = 'routed') r using (family, draw)
), bounds as (
  select family, round(quantile_cont(reduction, 0.025), 1) as low_pct, round(quantile_cont(reduction, 0.975), 1) as high_pct, count(*) as draws from drawn group by family having count(*) * 2 >= {B.DRAWS}
), points as (
  select family, round((quantile_cont(value, 0.5) filter (arm = 'holdout') - quantile_cont(value, 0.5) filter (arm = 'routed')) / quantile_cont(value, 0.5) filter (arm = 'holdout') * 100, 1) as reduction_pct
  from own group by family
)
select family, reduction_pct, low_pct, high_pct, draws from (select distinct family from routes) left join points using (family) left join bounds using (family)
"""


def session_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per conversation: turns, turns by role, estimated tokens, the longest turn."""
    n = F.length(F.coalesce("text", F.lit("")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("turns"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.sum(F.ceil(n / 4)).cast("long").alias("tokens"),
        F.max(n).alias("longest"),
        (F.max("turn") - F.min("turn")).alias("span"),
    )


SESSION = """
select conv_id, count(*) as turns, count(*) filter (role = 'user') as user_turns, count(*) filter (role = 'assistant') as assistant_turns,
       sum(ceil(length(coalesce(text, '')) / 4.0))::bigint as tokens, max(length(coalesce(text, ''))) as longest, max(turn) - min(turn) as span
from conversations group by conv_id
"""

def outcome_routes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes with the latest view or click of their user before them."""
    own = routes(spark, d).select("event_id", "user_id", "ts", "family", "item_id")
    outcomes = own.where("family in ('purchase', 'error')").select("event_id", "user_id", "ts")
    shown = own.where("family in ('view', 'click')")
    out = latest_before(outcomes, shown, ["user_id"], "ts", "event_id", ["event_id", "item_id", "ts"], lambda t: F.date_trunc("day", t))
    wait = F.unix_micros("ts") - F.unix_micros("found_ts")
    return out.select("event_id", "user_id", F.col("found_event_id").alias("route_id"), F.col("found_item_id").alias("item_id"), wait.alias("waited_us"))


OUTCOME_ROUTES = f"""
with {ROUTES}
select o.event_id, o.user_id, r.event_id as route_id, r.item_id, epoch_us(o.ts) - epoch_us(r.ts) as waited_us
from (select * from routes where family in ('purchase', 'error')) o
left join (select * from routes where family in ('view', 'click')) r on r.user_id = o.user_id and r.ts <= o.ts
qualify row_number() over (partition by o.event_id order by r.ts desc, r.event_id desc) = 1
"""

QUERIES = {
    "outcome_routes": (outcome_routes, OUTCOME_ROUTES),
    "event_summary": (event_summary, EVENT_SUMMARY),
    "outcome_counts": (outcome_counts, f"with {ROUTES} select coalesce(outcome, 'pending') as outcome, count(*) as n from routes group by all"),
    "slowest_events": (slowest_events, f"with {ROUTES} select event_id, family, item_id, latency from routes order by latency desc, event_id limit 5"),
    "top_items": (top_items, TOP_ITEMS),
    "percentile_nearest": (percentile_nearest, NEAREST),
    "percentile_ceiling": (percentile_ceiling, CEILING),
    "percentile_linear": (percentile_linear, LINEAR),
    "impact_report": (impact_report, IMPACT),
    "reused_items": (reused_items, f"with {ROUTES} select user_id, count(*) as reused_items from (select user_id, item_id from routes group by all having count(*) > 1) group by user_id"),
    "returning_families": (
        returning_families,
        f"with {ROUTES} select user_id, count(*) as returning_families from (select user_id, family from routes group by all having count(distinct ts::date) > 1) group by user_id",
    ),
    "engagement_sequence": (engagement_sequence, ENGAGEMENT),
    "feedback_shrinkage": (feedback_shrinkage, FEEDBACK),
    "concentration": (concentration, CONCENTRATION),
    "bandit_weights": (bandit_weights, f"{_BANDIT} select * from weights"),
    "personalised_order": (personalised_order, PERSONALISED),
    "monthly_usage": (monthly_usage, "select o_custkey as user_id, strftime(o_orderdate, '%Y-%m') as month, count(*) as n from orders group by all"),
    "org_pool": (org_pool, ORG_POOL),
    "plan_summary": (
        plan_summary,
        "select c_mktsegment as plan, count(*) as users, count(*) filter (c_acctbal > 0) as paying, count(*) filter (c_acctbal > 9000) as over_quota from customer group by all",
    ),
    "user_rollup": (user_rollup, USER_ROLLUP),
    "latest_order": (latest_order, LATEST),
    "stale_runs": (stale_runs, STALE),
    "last_n_retention": (last_n_retention, LAST_N),
    "demand_priority": (demand_priority, DEMAND),
    "paired_outcomes": (paired_outcomes, PAIRED),
    "wilson_by_source": (wilson_by_source, WILSON),
    "gate_metrics": (gate_metrics, GATE),
    "regression_gate": (regression_gate, REGRESSION),
    "bootstrap_lift": (bootstrap_lift, BOOTSTRAP_LIFT),
    "cluster_difference": (cluster_difference, CLUSTER_DIFFERENCE),
    "median_reduction": (median_reduction, MEDIAN_REDUCTION),
    "session_metrics": (session_metrics, SESSION),
}
