"""Queries of feeds and totals: name -> (query, SQL). Customers are users, nations organisations, orders items and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_digest
from ..operators import feeds
from .tables import ROUTES, routes, table

#: Expressions that both engines read alike.
_WARNINGS = "case when event_type = 'error' then concat('[\"', 'slow', '\",\"', event_type, '\"]') when event_id % 11 = 0 then 'broken [' when event_id % 7 = 0 then '' end"
_SHOWN = "case when event_type = 'error' then 'slow,error' else '' end"
_STATUS = "case o_orderstatus when 'F' then 'approved' when 'P' then 'pending' end"
_MEMBERS = "select c_custkey as user_id, c_nationkey as org_id from customer union all select c_custkey, (c_nationkey + 1) % 25 from customer where c_custkey % 3 = 0"


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    second = rows.where("c_custkey % 3 = 0").selectExpr("c_custkey as user_id", "(c_nationkey + 1) % 25 as org_id")
    return rows.selectExpr("c_custkey as user_id", "c_nationkey as org_id").unionByName(second)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", "ts", "user_id", "event_type as tier", "value as latency", "props", f"{_WARNINGS} as warnings")


def _joined(column: str) -> Column:
    return F.array_join(column, ",").alias(column)


def user_feed(spark: SparkSession, d: str) -> DataFrame:
    rows = feeds.user_feed(_events(spark, d), ["tier", "latency"])
    return rows.select("user_id", "event_id", "tier", "latency", _joined("warnings"), "position")


USER_FEED = f"""
select * from (
  select user_id, event_id, event_type as tier, value as latency, {_SHOWN} as warnings, row_number() over (partition by user_id order by ts desc, event_id desc) as position from events
) where position <= {feeds.USER_FEED} and user_id is not null
"""


def recent_feed(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    rows = feeds.recent_feed(_events(spark, d), users.where("user_id % 5 > 0"), ["tier", "latency"])
    return rows.select("event_id", "user_id", "email", "tier", "latency", _joined("warnings"))


RECENT_FEED = f"""
select event_id, user_id, c_name as email, event_type as tier, value as latency, {_SHOWN} as warnings
from (select * from events order by ts desc, event_id desc limit {feeds.ALL_FEED}) left join (select * from customer where c_custkey % 5 > 0) on c_custkey = user_id
"""


def visible_items(spark: SparkSession, d: str) -> DataFrame:
    """What each user whose id is divisible by 100 sees of all items."""
    items = table(spark, d, "orders").selectExpr(
        "o_orderkey as item_id", "o_custkey as owner", "case when o_orderkey % 4 = 0 then o_orderkey % 25 end as org_id", f"{_STATUS} as status", "date_format(o_orderdate, 'yyyy-MM-dd') as created"
    )  # dates as text, written once an item and not once a row of the result
    asked = table(spark, d, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("user_id"))
    rows = feeds.visible_items(items, _members(spark, d), asked)
    return rows.select("user_id", "item_id", "from_org", F.coalesce("org_id", F.lit(-1)).cast("long").alias("org_id"), "created")


VISIBLE = f"""
with m as ({_MEMBERS}), i as (
  select o_orderkey as item_id, o_custkey as owner, case when o_orderkey % 4 = 0 then o_orderkey % 25 end as org_id, {_STATUS} as status, o_orderdate::date as created from orders
)
select user_id, item_id, true as from_org, org_id::bigint as org_id, strftime(created, '%Y-%m-%d') as created from i join m using (org_id) where coalesce(status, 'approved') = 'approved' and user_id % 100 = 0
union all select owner, item_id, false, -1, strftime(created, '%Y-%m-%d') from i where org_id is null and owner % 100 = 0
"""


def install_audit(spark: SparkSession, d: str) -> DataFrame:
    actions = table(spark, d, "events").where("event_type in ('signup', 'purchase')")
    actions = actions.selectExpr("event_id as action_id", "user_id", "'item_installed' as action", "case when event_id % 5 = 0 then '' else repeat(props, 40) end as subject")
    return feeds.audit_rows(actions, _members(spark, d))


AUDIT_ROWS = f"""
with m as ({_MEMBERS})
select org_id, event_id as action_id, user_id, 'item_installed' as action, case when event_id % 5 > 0 then substr(repeat(props, 40), 1, {feeds.SUBJECT}) end as subject
from events join m using (user_id) where event_type in ('signup', 'purchase')
"""


def version_exists(spark: SparkSession, d: str) -> DataFrame:
    """Per document a digest that somebody asks for: the current one, that of an older or of another text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", (F.col("doc_id") % 4).alias("case"))
    old = F.concat(F.lit("old "), "text")
    history = docs.where("item_id % 3 = 0").select("item_id", content_digest(old).alias("content_hash"))
    current = docs.select("item_id", content_digest(F.col("text")).alias("content_hash"))
    text = F.when(F.col("case") == 0, F.col("text")).when(F.col("case") == 3, F.lit("never seen")).otherwise(old)
    return feeds.version_exists(docs.select("item_id", content_digest(text).alias("content_hash")), history, current)


VERSION_EXISTS = """
with a as (select doc_id, sha256(case doc_id % 4 when 0 then text when 3 then 'never seen' else 'old ' || text end) as h from documents),
known as (select doc_id, sha256('old ' || text) as h from documents where doc_id % 3 = 0 union select doc_id, sha256(text) from documents)
select doc_id as item_id, h as content_hash, (doc_id, h) in (select (doc_id, h) from known) as known from a
"""


def session_plans(spark: SparkSession, d: str) -> DataFrame:
    rows = routes(spark, d).select(
        F.col("user_id").cast("string").alias("session_id"),
        "ts",
        F.col("event_id").alias("activation_id"),
        F.concat(F.lit(" "), "family").alias("source"),
        F.when(F.col("event_id") % 10 > 0, F.concat(F.lit("item "), F.col("item_id") % 20)).alias("skill"),
        F.sha2(F.col("item_id").cast("string"), 512).alias("snapshot_hash"),
    )
    return feeds.session_plans(rows).select("session_id", "source", "skill", "activation_id", F.length("snapshot_hash").alias("hash_chars"), "position")


SESSION_PLANS = f"""
with {ROUTES}, last as (
  select user_id::varchar as session_id, family as source, 'item ' || (item_id % 20) as skill, max(struct_pack(ts := ts, id := event_id)) as newest from routes where event_id % 10 > 0 and item_id is not null group by all
)
select session_id, source, skill, newest.id as activation_id, 128 as hash_chars, position from (select *, row_number() over (partition by session_id order by newest desc) as position from last)
where position <= {feeds.ACTIVATIONS}
"""


def _counts(column: str) -> Column:
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",").alias(column)


def user_stats(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderstatus")
    seen = routes(spark, d).withColumn("tier", F.when(F.col("family") != "view", F.col("family")))
    out = feeds.user_stats(users, seen, {"installs": orders.where("o_orderstatus = 'F'"), "watches": orders.where("o_orderstatus = 'O'")})
    return out.select("user_id", "email", "runs", "installs", "watches", F.col("last_run").cast("timestamp_ntz").alias("last_run"), F.coalesce("avg_latency", F.lit(-1)).alias("avg_latency"), _counts("tiers"), _counts("outcomes"))


USER_STATS = f"""
with {ROUTES}, r as (select *, case when family = 'view' then 'unknown' else family end as tier from routes),
totals as (select user_id, count(*) as runs, max(ts) as last_run, round_even(avg(latency), 0)::bigint as avg_latency from r group by user_id),
tiers as (select user_id, string_agg(tier || ':' || n, ',' order by tier) as tiers from (select user_id, tier, count(*) as n from r group by all) group by user_id),
outcomes as (select user_id, string_agg(outcome || ':' || n, ',' order by outcome) as outcomes from (select user_id, outcome, count(*) as n from r where outcome is not null group by all) group by user_id),
own as (select o_custkey as user_id, count(*) filter (o_orderstatus = 'F') as installs, count(*) filter (o_orderstatus = 'O') as watches from orders group by all)
select c_custkey as user_id, c_name as email, coalesce(runs, 0) as runs, coalesce(installs, 0) as installs, coalesce(watches, 0) as watches, last_run, coalesce(avg_latency, -1)::bigint as avg_latency,
       coalesce(tiers, '') as tiers, coalesce(outcomes, '') as outcomes
from customer c left join totals t on t.user_id = c_custkey left join tiers x on x.user_id = c_custkey left join outcomes y on y.user_id = c_custkey left join own o on o.user_id = c_custkey
"""

_PLAN = "case when c_acctbal > 9000 then 'team' when c_acctbal > 0 then 'pro' when c_custkey % 2 = 0 then 'free' end"
_EFFECTIVE = f"case when c_custkey % 10 = 1 then 'team' else {_PLAN} end"
_QUOTA, _INCLUDED = 2, 5


def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").selectExpr("c_custkey as user_id", f"{_PLAN} as plan", f"{_EFFECTIVE} as effective", "case when c_acctbal > 5000 then c_name end as billing_id")
    orders = table(spark, d, "orders")
    orgs = table(spark, d, "nation").selectExpr("case when n_nationkey % 3 > 0 then n_nationkey end as seat_limit")
    grants = orders.selectExpr("case when o_orderstatus = 'P' then o_orderdate end as revoked_at", "o_orderdate as expires_at")
    usage = orders.groupBy(F.col("o_custkey").alias("user_id"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    args = (["free", "pro", "team"], F.lit("1998-01"), F.lit("1998-01-01").cast("timestamp"), _QUOTA, _INCLUDED)
    return feeds.plan_totals(users, orgs, _members(spark, d), grants, usage, *args)


PLAN_TOTALS = f"""
with u as (select c_custkey as user_id, coalesce({_PLAN}, 'free') as plan, coalesce({_EFFECTIVE}, 'free') as effective, case when c_acctbal > 5000 then c_name end as billing_id from customer),
used as (select o_custkey as user_id, count(*) as n from orders where strftime(o_orderdate, '%Y-%m') = '1998-01' group by all)
select {", ".join(f"count(*) filter ({c} = '{p}') as {n}_{p}" for n, c in (("paid", "plan"), ("effective", "effective")) for p in ("free", "pro", "team"))},
       count(*) filter (plan in ('pro', 'team')) as paying, count(billing_id) as billed,
       (select count(*) from orders where o_orderstatus <> 'P' and o_orderdate > timestamp '1998-01-01') as active_grants,
       (select count(*) from nation) as orgs, (select sum(case when n_nationkey % 3 > 0 then n_nationkey else {_INCLUDED} end)::bigint from nation) as seats,
       (select count(*) from ({_MEMBERS})) as org_members, (select coalesce(sum(n), 0)::bigint from used) as routes, (select count(*) from used) as users_routing,
       (select count(*) from used where n >= {_QUOTA} and user_id in (select user_id from u where effective = 'free')) as free_at_quota
from u
"""

_PUBLIC = {
    "id": "doc_id",
    "name": "concat('doc ', doc_id)",
    "slug": "case when doc_id % 2 = 0 then concat('doc-', doc_id) when doc_id % 3 = 0 then '' end",
    "capability_summary": "case when doc_id % 5 = 0 then lang end",
    "description": "source",
    "url": "concat('https://', source, '/', doc_id)",
    "install_url": "case when doc_id % 6 = 0 then concat('https://get/', doc_id) end",
    "is_duplicate": "case when doc_id % 7 > 1 then doc_id % 7 = 2 end",
    "stars": "case when doc_id % 4 > 0 then n_chars end",
    "retrieval_backend": "case when doc_id % 9 = 0 then 'session' else 'stored' end",
}


def public_records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").selectExpr("text", *[f"{x} as {n}" for n, x in _PUBLIC.items()])
    rows = feeds.public_record(rows, ["id", "name", "url", "license"], "session", "agent")
    flat = [F.size(n).cast("long").alias(n) for n in ("platforms", "role_reasons")]
    return rows.select("id", "name", "url", "license", "slug", "summary", "source_url", "is_duplicate", "stars", *flat, F.col("session_activation.source").alias("activated"))


PUBLIC_RECORDS = f"""
with r as (select {", ".join(f"{x} as {n}" for n, x in _PUBLIC.items())} from documents)
select id, name, url, null::varchar as license, coalesce(nullif(slug, ''), name) as slug, coalesce(capability_summary, description) as summary, url as source_url,
       coalesce(is_duplicate, false) as is_duplicate, coalesce(stars, 0)::bigint as stars, 0::bigint as platforms, 0::bigint as role_reasons,
       case when retrieval_backend = 'session' then coalesce(install_url, url) end as activated
from r
"""

QUERIES = {
    "user_feed": (user_feed, USER_FEED),
    "recent_feed": (recent_feed, RECENT_FEED),
    "visible_items": (visible_items, VISIBLE),
    "install_audit": (install_audit, AUDIT_ROWS),
    "version_exists": (version_exists, VERSION_EXISTS),
    "session_plans": (session_plans, SESSION_PLANS),
    "user_stats": (user_stats, USER_STATS),
    "plan_totals": (plan_totals, PLAN_TOTALS),
    "public_records": (public_records, PUBLIC_RECORDS),
}
