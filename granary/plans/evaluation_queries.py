"""Queries that judge results, compare snapshots and watch tables: name -> (query, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import safety
from ..operators import evaluation as V
from ..operators import events as E
from ..operators import retrieval as R
from ..operators import stats as S
from ..operators.common import cut, top_per_group
from ..operators.dedupe import canonical_pick
from ..sources import store
from ..streaming.streams import run_available, sessions
from .event_queries import _JUDGED, _judged
from .retrieval_queries import BM25, CORPUS, _candidates, _lexical_sql, _rerank_sql
from .tables import ROUTES, corpus, prompts, routes, table
from .text_queries import RISK_SCAN

_BM25_30 = BM25.replace("position <= 10", "position <= 30")


def intent_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of each prompt fused by reciprocal ranks; ties go to documents of both, then to the smaller id."""
    docs, asked = table(spark, d, "documents"), prompts(spark, d)
    lanes = [(R.lexical_topk(asked, docs, 30, most=None), 1.0), (R.bm25_topk(asked, docs, 30), 1.0)]
    both = lanes[0][0].select("query_id", "doc_id").unionByName(lanes[1][0].select("query_id", "doc_id"))
    both = both.groupBy("query_id", "doc_id").agg(F.count("*").alias("lanes"))
    fused = R.rrf(lanes).drop("first").join(both, ["query_id", "doc_id"])
    return top_per_group(fused, ["query_id"], [F.desc("fused"), F.desc("lanes"), F.asc("doc_id")], 10)


INTENT_FUSION = f"""
with {_lexical_sql(30, None)}, bm as ({_BM25_30}),
lanes as (select query_id, doc_id, position from lexical union all select query_id, doc_id, position from bm),
fused as (select query_id, doc_id, round(sum(1.0::double / (60 + position)), 9) as fused, count(*) as lanes from lanes group by query_id, doc_id)
select * from (select *, row_number() over (partition by query_id order by fused desc, lanes desc, doc_id) as position from fused) where position <= 10
"""


def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often BM25 has the first document of the lexical lane among its first k."""
    docs, asked = table(spark, d, "documents"), prompts(spark, d)
    return V.hit_rates(R.bm25_topk(asked, docs, 10), R.lexical_topk(asked, docs, 1), [1, 3, 5, 10])


HIT_RATES = f"""
with {_lexical_sql(1)}, bm as ({BM25}),
best as (select query_id, min(bm.position) as best from lexical left join bm using (query_id, doc_id) group by query_id)
select k, count(*) filter (best <= k) as hits, count(*) as queries, round(count(*) filter (best <= k) / count(*), 9) as rate
from best, (select unnest([1, 3, 5, 10])::int as k) group by k
"""


def clear_winners(spark: SparkSession, d: str) -> DataFrame:
    return V.clear_winners(R.bm25_topk(prompts(spark, d), table(spark, d, "documents"), 2))


CLEAR_WINNERS = f"""
with bm as ({BM25})
select t.query_id, t.doc_id, round(t.score - r.score, 6) as margin, coalesce(t.score >= 1.6::double * r.score, true) as clear
from (select * from bm where position = 1) t left join (select * from bm where position = 2) r using (query_id)
"""


def first_deliverable(spark: SparkSession, d: str) -> DataFrame:
    """The first of the five best candidates of each prompt that is good enough and fits."""
    ranked = R.rerank(_candidates(spark, d, None), 5).where("not platform_mismatch and quality >= 65 and risk = 0")
    best = ranked.groupBy("query_id").agg(F.min(F.struct("position", "doc_id")).alias("best"))
    return best.select("query_id", F.col("best.doc_id").alias("doc_id"), F.col("best.position").alias("position"))


FIRST_DELIVERABLE = f"""{_rerank_sql(None)}
select query_id, arg_min(doc_id, position) as doc_id, min(position) as position from ranked
where position <= 5 and not platform_mismatch and quality >= 65 and risk = 0 group by query_id
"""


def hint_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first three different contents of each prompt."""
    found = R.lexical_topk(prompts(spark, d), table(spark, d, "documents"), 60)
    rows = found.join(corpus(spark, d).select("doc_id", "content_hash"), "doc_id").withColumn("earlier", -F.col("position"))
    picked = canonical_pick(rows, ["query_id", "content_hash"], "position", ["earlier"], "doc_id").withColumnRenamed("position", "found_at")
    return top_per_group(picked.select("query_id", "doc_id", "found_at"), ["query_id"], [F.asc("found_at")], 3)


HINT_CANDIDATES = f"""
with {_lexical_sql(60)}, {CORPUS}, picked as (
  select query_id, arg_min(doc_id, position) as doc_id, min(position) as found_at from lexical join corpus using (doc_id) group by query_id, content_hash
)
select * from (select *, row_number() over (partition by query_id order by found_at) as position from picked) where position <= 3
"""


def label_precision(spark: SparkSession, d: str) -> DataFrame:
    """Judged candidates by rank: exact (good, not toxic), adjacent (good but toxic) or irrelevant, and exact precision."""
    found = R.lexical_topk(prompts(spark, d), table(spark, d, "documents"), 5, most=None).join(table(spark, d, "labels"), "doc_id")
    exact, good = (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("quality") == 1
    rows = found.groupBy("position").agg(
        F.count_if(exact).alias("exact"), F.count_if(good & ~exact).alias("adjacent"), F.count_if(~good).alias("irrelevant"), F.count("*").alias("judged")
    )
    low, high = S.wilson(F.col("exact"), F.col("judged"))
    return rows.select(
        "*", V.share_of(F.col("exact"), F.col("judged")).alias("precision"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high")
    )


LABEL_PRECISION = f"""
with {_lexical_sql(5, None)}, g as (
  select position, count(*) filter (quality = 1 and toxic = 0) as exact, count(*) filter (quality = 1 and toxic <> 0) as adjacent,
         count(*) filter (quality <> 1) as irrelevant, count(*) as judged from lexical join labels using (doc_id) group by position
), p as (select *, exact::double / judged as p, 1.96::double as z from g)
select position, exact, adjacent, irrelevant, judged, round(p, 9) as precision,
       round((p + z * z / (2 * judged)) / (1 + z * z / judged) - z * sqrt(p * (1 - p) / judged + z * z / (4 * judged * judged)) / (1 + z * z / judged), 9) as low,
       round((p + z * z / (2 * judged)) / (1 + z * z / judged) + z * sqrt(p * (1 - p) / judged + z * z / (4 * judged * judged)) / (1 + z * z / judged), 9) as high
from p
"""


def _replicates(spark: SparkSession, d: str) -> DataFrame:
    """Items as tasks, even users as the treated arm, positive outcomes as passes."""
    rows = routes(spark, d).where("item_id is not null")
    return V.replicated_tasks(
        rows.select(
            F.col("item_id").alias("task"),
            (F.col("user_id") % 2 == 0).alias("treated"),
            F.coalesce(F.col("outcome").isin(E.POSITIVE), F.lit(False)).alias("passed"),
        )
    )


_REPLICATES = f"""{ROUTES}, replicates as (
  select item_id as task, avg(p) filter (user_id % 2 <> 0) as control, avg(p) filter (user_id % 2 = 0) as treatment,
         count(*) filter (user_id % 2 <> 0) as control_n, count(*) filter (user_id % 2 = 0) as treatment_n
  from (select *, coalesce(outcome in ('used', 'installed'), false)::int as p from routes where item_id is not null) group by item_id
  having control_n >= 2 and treatment_n >= 2 and control < 1
)"""


def replicated_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = _replicates(spark, d)
    return rows.select("task", F.round("control", 9).alias("control"), F.round("treatment", 9).alias("treatment"), "control_n", "treatment_n")


def clustered_sign_test(spark: SparkSession, d: str) -> DataFrame:
    """Tasks that the treated arm passes more or less often, and the exact sign test of the two counts."""
    rows = S.paired_outcomes(_replicates(spark, d))
    return rows.withColumn("p_value", F.round(S.mcnemar_exact(F.col("wins"), F.col("losses")), 9))


CLUSTERED = f"""
with {_REPLICATES}, c as (
  select count(*) filter (treatment > control) as wins, count(*) filter (treatment < control) as losses, count(*) filter (treatment = control) as ties from replicates
), terms as (
  select k, -(wins + losses) * ln(2.0::double) + lgamma(wins + losses + 1.0::double) - lgamma(k + 1.0::double) - lgamma(wins + losses - k + 1.0::double) as t
  from (select unnest(range(0, least(wins, losses) + 1)) as k, wins, losses from c)
)
select wins, losses, ties, round(case when wins + losses = 0 then 1.0::double else least(1.0::double, 2 * (select sum(exp(t)) from terms)) end, 9) as p_value from c
"""


def lift_by_category(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum("control").alias("c"), F.sum("treatment").alias("t"))
    return rows.select(
        "source",
        "n",
        F.round(F.col("c") / F.col("n"), 9).alias("control"),
        F.round(F.col("t") / F.col("n"), 9).alias("treatment"),
        F.round((F.col("t") - F.col("c")) / F.col("n"), 9).alias("lift"),
    )


LIFT = f"""
with {_JUDGED}
select source, count(*) as n, round(sum(control)::bigint / count(*), 9) as control, round(sum(treatment)::bigint / count(*), 9) as treatment,
       round((sum(treatment)::bigint - sum(control)::bigint) / count(*), 9) as lift
from judged group by source
"""


def profile_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Count, percentiles and maximum of several measures, one row each."""
    n = F.length("text").cast("double")
    rows = table(spark, d, "documents").select(n.alias("chars"), F.ceil(n / 4).cast("double").alias("tokens"), F.col("n_chars").cast("double").alias("stated"))
    long = rows.unpivot([], ["chars", "tokens", "stated"], "metric", "value").where("value is not null")
    points = {f"p{p}": E.nearest_rank(p / 100) for p in (50, 95, 99)}
    totals = long.groupBy("metric").agg(F.count("*").alias("n"), F.max("value").alias("largest"))
    return E.percentiles(long, ["metric"], "value", points).join(totals, "metric")


PROFILE = """
with long as (
  select 'chars' as metric, length(text)::double as v from documents union all select 'tokens', ceil(length(text) / 4.0)::double from documents
  union all select 'stated', n_chars::double from documents
), s as (select metric, list_sort(list(v)) as v, count(*) as n, max(v) as largest from long where v is not null group by metric)
select metric, n, largest, v[round_even((n - 1) * 0.5::double, 0)::bigint + 1] as p50, v[round_even((n - 1) * 0.95::double, 0)::bigint + 1] as p95,
       v[round_even((n - 1) * 0.99::double, 0)::bigint + 1] as p99 from s
"""


def behaviour_changes(spark: SparkSession, d: str) -> DataFrame:
    """What each user did last in either half of the time."""
    rows = routes(spark, d)
    middle = rows.agg(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 as bigint))").alias("middle"))
    rows = rows.crossJoin(F.broadcast(middle))
    last = [rows.where(c).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "family"))["family"].alias("family")) for c in ("ts < middle", "ts >= middle")]
    return V.behaviour_changes(*last, "user_id", "family")


CHANGES = f"""
with {ROUTES}, m as (select make_timestamp(((epoch_us(min(ts)) + epoch_us(max(ts))) / 2)::bigint) as middle from routes),
v as (select user_id, arg_max(family, (ts, event_id)) filter (ts < middle) as before, arg_max(family, (ts, event_id)) filter (ts >= middle) as after from routes, m group by user_id)
select *, before is distinct from after as changed from v
"""


def reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "documents").select(safety.risk_flags(F.col("text")).alias("f"))
    reason = F.explode(F.when(F.size("f") == 0, F.array(F.lit("clean"))).otherwise(F.col("f")))
    return flags.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def readiness_counts(spark: SparkSession, d: str) -> DataFrame:
    embedded = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded")).dropDuplicates(["doc_id"])
    rows = corpus(spark, d).select("doc_id", "source", "eligible").join(embedded, "doc_id", "left")
    has = F.col("embedded").isNotNull()
    return rows.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if("eligible").alias("active"), F.count_if(has).alias("embedded"), F.count_if(has & F.col("eligible")).alias("ready")
    )


READINESS = f"""
with {CORPUS}
select source, count(*) as total, count(*) filter (eligible) as active, count(*) filter (vec_id is not null) as embedded, count(*) filter (eligible and vec_id is not null) as ready
from corpus left join (select distinct vec_id from embeddings) on vec_id = doc_id group by source
"""


def embedding_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose vector is missing, or was made from another text (here that of every fifth)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    made = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")).dropDuplicates().join(docs, "doc_id")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    made = made.select("doc_id", F.sha1(F.encode(old, "UTF-8")).alias("made_from"))
    rows = docs.select("doc_id", F.sha1(F.encode("text", "UTF-8")).alias("now")).join(made, "doc_id", "left")
    reason = F.when(F.col("made_from").isNull(), "missing").when(F.col("made_from") != F.col("now"), "stale")
    return rows.select("doc_id", reason.alias("reason")).where("reason is not null")


BACKLOG = """
select doc_id, case when vec_id is null then 'missing' else 'stale' end as reason
from documents left join (select distinct vec_id from embeddings) on vec_id = doc_id where vec_id is null or doc_id % 5 = 0
"""


def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of run: fresh and stale running ones, and the last that ended; fresh means in the last 30 days of the table."""
    rows = table(spark, d, "orders")
    newest = rows.agg(F.max("o_orderdate").alias("now"))
    rows = rows.crossJoin(F.broadcast(newest))
    running, fresh = F.col("o_orderstatus") == "O", F.col("o_orderdate") >= F.col("now") - F.expr("interval 30 days")
    return rows.groupBy("o_orderpriority").agg(
        F.count_if(running & fresh).alias("fresh"),
        F.count_if(running & ~fresh).alias("stale"),
        F.date_format(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))), "yyyy-MM-dd").alias("last_success"),
    )


RUNS = """
select o_orderpriority, count(*) filter (o_orderstatus = 'O' and o_orderdate >= now_at - interval 30 days) as fresh,
       count(*) filter (o_orderstatus = 'O' and o_orderdate < now_at - interval 30 days) as stale,
       strftime(max(o_orderdate) filter (o_orderstatus = 'F'), '%Y-%m-%d') as last_success
from orders, (select max(o_orderdate) as now_at from orders) group by o_orderpriority
"""


def privacy_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the event log fill each column that has to be empty in the end, and hold an outcome off the list."""
    rows = routes(spark, d)
    names = ["user_id", "item_id", "outcome"]
    off = F.col("outcome").isNotNull() & ~F.col("outcome").isin(["used", "installed", "failed"])
    one = rows.agg(*[F.count(c).alias(c) for c in names], F.count_if(off).alias("off_list"))
    return one.unpivot([], [*names, "off_list"], "what", "n")


PRIVACY = f"""
with {ROUTES}
select 'user_id' as what, count(user_id) as n from routes union all select 'item_id', count(item_id) from routes union all select 'outcome', count(outcome) from routes
union all select 'off_list', count(*) filter (outcome not in ('used', 'installed', 'failed')) from routes
"""


def append_events(spark: SparkSession, d: str) -> DataFrame:
    """Allowed columns only; outcomes off the list, and users of events older than ten days before the newest, become null."""
    rows = routes(spark, d)
    newest = rows.agg(F.max("ts").alias("newest"))
    rows = rows.crossJoin(F.broadcast(newest))
    allowed = {"event_id": None, "outcome": ["used", "installed", "failed"], "user_id": None, "family": None}
    return store.append_events(rows, allowed, F.col("newest") - F.expr("interval 10 days"), ["user_id"])


APPEND = f"""
with {ROUTES}
select event_id, case when outcome in ('used', 'installed', 'failed') then outcome end as outcome,
       case when ts >= (select max(ts) from routes) - interval 10 days then user_id end as user_id, family
from routes
"""


#: Copies of lineitem by name: in another order, with a value changed, a row lost, and a row lost where another stands twice.
_COPIES = {
    "order": "select * from {t}",
    "value": "select l_orderkey, l_partkey, l_suppkey, l_linenumber, case when l_orderkey = {k} and l_linenumber = 1 then l_quantity + 1 else l_quantity end as l_quantity from {t}",
    "lost": "select * from {t} where not (l_orderkey = {k} and l_linenumber = 1)",
    "twice": "select * from {t} where not (l_orderkey = {k} and l_linenumber = 1) union all select * from {t} where l_orderkey = {k2} and l_linenumber = 1",
}
_PARITY_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"


def table_parity(spark: SparkSession, d: str) -> DataFrame:
    """Whether copies of a table have the rows of the table, whatever their order."""
    rows = table(spark, d, "lineitem").selectExpr(*_PARITY_COLUMNS.split(", "))
    ends = rows.agg(F.min("l_orderkey").alias("k"), F.max("l_orderkey").alias("k2")).first()
    own, out = cut(store.table_digest(rows)), None
    for name, copy in _COPIES.items():
        copied = spark.sql(copy.replace("{t}", "{rows}").replace("{k}", str(ends["k"])).replace("{k2}", str(ends["k2"])), rows=rows)
        copied = copied.repartition(F.col("l_partkey")).sortWithinPartitions("l_suppkey")
        other = store.table_digest(copied).select(F.col("rows").alias("n"), F.col("digest").alias("other"))
        same = (F.col("rows") == F.col("n")) & F.col("digest").eqNullSafe(F.col("other"))
        one = own.crossJoin(F.broadcast(other)).select(F.lit(name).alias("copy"), F.col("n").alias("rows"), same.alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


def _parity_sql() -> str:
    parts = []
    for name, copy in _COPIES.items():
        c = copy.replace("{k}", "(select min(l_orderkey) from lineitem)").replace("{k2}", "(select max(l_orderkey) from lineitem)").replace("{t}", "own")
        parts.append(f"select '{name}' as copy, (select count(*) from ({c})) as rows, not exists (({c}) except all (select * from own)) and not exists ((select * from own) except all ({c})) as same")
    return f"with own as (select {_PARITY_COLUMNS} from lineitem) " + " union all ".join(parts)


def forked_packages(spark: SparkSession, d: str) -> DataFrame:
    """Contents kept once, with the number of rows and sources that carry them."""
    return corpus(spark, d).groupBy("content_hash").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), F.countDistinct("source").alias("sources"), F.min("source").alias("first_source")
    )


FORKS = f"with {CORPUS} select content_hash, min(doc_id) as doc_id, count(*) as n_rows, count(distinct source) as sources, min(source) as first_source from corpus group by content_hash"


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user in the day up to each event, and whether that is over the limit."""
    rows = V.within_window(routes(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 86400)
    return rows.select("event_id", "user_id", "recent", (F.col("recent") > 3).alias("limited"))


RATE_LIMIT = f"""
with {ROUTES}, seen as (
  select event_id, user_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as recent from routes
)
select *, recent > 3 as limited from seen
"""


def best_entitlement(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's strongest grant: by its rank, then the newest, then the larger key."""
    rows = table(spark, d, "orders").withColumn("rank", 6 - F.substring("o_orderpriority", 1, 1).cast("int"))
    return E.latest_per_key(rows, "o_custkey", ["rank", "o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"])


ENTITLEMENT = """
select o_custkey, o_orderkey, o_orderpriority from (
  select *, row_number() over (partition by o_custkey order by left(o_orderpriority, 1)::int, o_orderdate desc, o_orderkey desc) as place from orders
) where place = 1
"""


def effective_plan(spark: SparkSession, d: str) -> DataFrame:
    """The better of a customer's own plan and that inherited from the best member of the organisation; own wins ties."""
    rank = F.when(F.col("c_acctbal") > 9000, 2).when(F.col("c_acctbal") > 0, 1).otherwise(0)
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", rank.alias("own"), "c_acctbal")
    orgs = rows.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("best"))
    orgs = orgs.select("c_nationkey", F.when(F.col("best") > 9950, 2).otherwise(0).alias("team"))
    joined = rows.join(orgs, "c_nationkey")
    origin = F.when(F.col("own") >= F.col("team"), F.when(F.col("own") > 0, "paid").otherwise("free")).otherwise("inherited")
    return joined.select("c_custkey", F.greatest("own", "team").alias("plan"), origin.alias("origin"))


PLAN = """
with o as (select *, case when c_acctbal > 9000 then 2 when c_acctbal > 0 then 1 else 0 end as own from customer),
t as (select c_nationkey, case when max(c_acctbal) > 9950 then 2 else 0 end as team from customer group by c_nationkey)
select c_custkey, greatest(own, team) as plan, case when own < team then 'inherited' when own > 0 then 'paid' else 'free' end as origin from o join t using (c_nationkey)
"""


def stale_rotation(spark: SparkSession, d: str) -> DataFrame:
    """The next five items to refresh: those not seen in the last day of the log, going round from a cursor."""
    seen = routes(spark, d).groupBy(F.col("item_id").alias("query_id")).agg(F.max("ts").alias("last"))
    newest = routes(spark, d).agg(F.max("ts").alias("newest"))
    rows = prompts(spark, d).select("query_id").join(seen, "query_id", "left").crossJoin(F.broadcast(newest))
    rows = rows.where(F.coalesce(F.col("last") < F.col("newest") - F.expr("interval 1 day"), F.lit(True)))
    return rows.orderBy(F.col("query_id") <= 20, "query_id").limit(5).select("query_id")


ROTATION = f"""
with {ROUTES}, seen as (select item_id as query_id, max(ts) as last from routes group by item_id)
select query_id from (select item_id as query_id from benchmark) left join seen using (query_id)
where coalesce(last < (select max(ts) from routes) - interval 1 day, true) order by query_id <= 20, query_id limit 5
"""


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = run_available(spark, d, "events", lambda s: sessions(s, "12 hours", "1 hour"), complete=True)
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


SESSIONS = """
with marked as (
  select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over w) < 43200000000 then 0 else 1 end as first from events window w as (partition by user_id order by ts)
), numbered as (select *, sum(first) over (partition by user_id order by ts rows unbounded preceding) as s from marked)
select user_id, min(ts) as start, max(ts) + interval 12 hours as "end", count(*) as n from numbered group by user_id, s
"""

_MEASURED = """
select event_type as family, case when user_id % 2 = 0 then 'routed' when user_id % 10 = 1 then null else 'holdout' end as arm,
       case when event_type = 'view' then null when event_id % 3 = 0 then event_id % 11 end as turns,
       case when event_type = 'signup' then 0 when event_id % 400 = 0 then null else value * (1 + event_id % 2) end as total_tokens,
       case when event_type = 'error' then event_id % 7 end as tool_calls, event_id % 97 as elapsed_seconds
from {events} where event_type <> 'signup' or event_id % 5 > 0
"""


def lift_gate(spark: SparkSession, d: str) -> DataFrame:
    return S.lift_gate(spark.sql(_MEASURED, events=table(spark, d, "events")), "family")


LIFT_GATE = f"""
with measured as ({_MEASURED.format(events="events")}), long as (
  select family, arm, unnest([0, 1, 2, 3]) as rank, unnest([turns::double, total_tokens::double, tool_calls::double, elapsed_seconds::double]) as v from measured
  where arm is not null
), arms as (
  select family, rank, quantile_cont(v, 0.5) filter (arm = 'routed') as r, quantile_cont(v, 0.5) filter (arm = 'holdout') as h,
         count(v) filter (arm = 'routed') as rn, count(v) filter (arm = 'holdout') as hn
  from long where v is not null group by all
), firsts as (select * from arms where rn >= 15 and hn >= 15 and h <> 0 qualify row_number() over (partition by family order by rank) = 1)
select family, ['turns', 'total_tokens', 'tool_calls', 'elapsed_seconds'][rank + 1] as metric, rn as routed_samples, hn as holdout_samples, round((h - r) / h * 100, 1) as reduction_pct
from (select distinct family from measured) left join firsts using (family)
"""

QUERIES = {
    "lift_gate": (lift_gate, LIFT_GATE),
    "intent_fusion": (intent_fusion, INTENT_FUSION),
    "hit_rates": (hit_rates, HIT_RATES),
    "clear_winners": (clear_winners, CLEAR_WINNERS),
    "first_deliverable": (first_deliverable, FIRST_DELIVERABLE),
    "hint_candidates": (hint_candidates, HINT_CANDIDATES),
    "label_precision": (label_precision, LABEL_PRECISION),
    "replicated_outcomes": (
        replicated_outcomes,
        f"with {_REPLICATES} select task, round(control, 9) as control, round(treatment, 9) as treatment, control_n, treatment_n from replicates",
    ),
    "clustered_sign_test": (clustered_sign_test, CLUSTERED),
    "lift_by_category": (lift_by_category, LIFT),
    "profile_metrics": (profile_metrics, PROFILE),
    "behaviour_changes": (behaviour_changes, CHANGES),
    "reason_histogram": (
        reason_histogram,
        f"select reason, count(*) as n from (select unnest(case when flags = '' then ['clean'] else string_split(flags, ',') end) as reason from ({RISK_SCAN})) group by reason",
    ),
    "readiness_counts": (readiness_counts, READINESS),
    "embedding_backlog": (embedding_backlog, BACKLOG),
    "run_summary": (run_summary, RUNS),
    "privacy_counts": (privacy_counts, PRIVACY),
    "append_events": (append_events, APPEND),
    "table_parity": (table_parity, _parity_sql()),
    "forked_packages": (forked_packages, FORKS),
    "rate_limit": (rate_limit, RATE_LIMIT),
    "best_entitlement": (best_entitlement, ENTITLEMENT),
    "effective_plan": (effective_plan, PLAN),
    "stale_rotation": (stale_rotation, ROTATION),
    "stream_sessions": (stream_sessions, SESSIONS),
}
