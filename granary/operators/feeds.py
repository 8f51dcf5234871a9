"""What users and administrators are shown: event feeds, visible items, audit rows, session plans, public records, totals.

Tables may hold one user, organisation or session with a third of all rows: rows are counted or cut down per key before
the shuffle, lists are returned as rows with their sort columns, and no window spans more than a bounded number of rows of
a key. Null keys belong to nobody: such rows are in no user's list, and an outer join keeps them without a match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, semi_joined, sized, top_per_group

#: Rows of a user's own feed, of the feed of all users, and activations of a session.
USER_FEED, ALL_FEED, ACTIVATIONS = 200, 500, 12
#: Lengths that a stored plan of a session is cut to, and of the subject of an audit row.
PLAN_LENGTHS = {"source": 500, "skill": 200, "snapshot_hash": 128}
SUBJECT = 200
#: The type that latencies are summed in.
LATENCY = "decimal(28,14)"


def parsed_warnings(raw: Column) -> Column:
    """The JSON list of warnings; null, empty and broken texts are no warnings."""
    return F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))


def user_feed(events: DataFrame, columns: list[str], n: int = USER_FEED) -> DataFrame:
    """Each user's newest n events (1 to 200), these columns of them alone, with their ``position``. Ties: larger event_id first."""
    rows = events.where("user_id is not null").select("user_id", "event_id", "ts", *columns, parsed_warnings(F.col("warnings")).alias("warnings"))
    return top_per_group(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], max(1, min(n, USER_FEED)))


def recent_feed(events: DataFrame, users: DataFrame, columns: list[str], n: int = ALL_FEED) -> DataFrame:
    """The newest n events (1 to 500) of all users with the user's email, null for events of nobody. Ties as in user_feed.

    The events are cut to n before the join, so the users are read once and never shuffled.
    """
    rows = events.select("event_id", "ts", "user_id", *columns, parsed_warnings(F.col("warnings")).alias("warnings"))
    rows = sized(rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(max(1, min(n, ALL_FEED))))
    found = users.select("user_id", "email").join(rows.select("user_id").distinct(), "user_id", "left_semi")
    return rows.join(found, "user_id", "left")


def visible_items(items: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """(user_id, item_id, from_org, org_id, created): what the asked users (user_id, distinct) see.

    items: (item_id, owner, org_id, status, created). Items of a user's organisations are seen once approved (null: approved);
    items outside organisations by their owner alone. A list is read by from_org, then created, newest first.

    The result grows with users times items of their organisations. Members are broadcast if their counted size allows it, so
    these rows are made where they are returned. Items of an organisation follow each other in a task, so that its users come
    in the same order again and again, which files hold in less space; the sorted items are cut, as Spark drops a sort below a join.
    """
    asked = sized(asked)
    shared = items.where("org_id is not null and coalesce(status, 'approved') = 'approved'")
    mine = sized(members.select("user_id", "org_id").join(asked, "user_id", "left_semi").distinct())
    shared = cut(shared.select("org_id", "item_id", "created").sortWithinPartitions("org_id", "created"))
    shared = shared.join(mine, "org_id").select("user_id", "item_id", F.lit(True).alias("from_org"), "org_id", "created")
    own = items.where("org_id is null").join(asked, items["owner"] == asked["user_id"], "left_semi")
    own = own.select(F.col("owner").alias("user_id"), "item_id", F.lit(False).alias("from_org"), "org_id", "created")
    return shared.unionByName(own)


def audit_rows(actions: DataFrame, members: DataFrame) -> DataFrame:
    """(org_id, action_id, user_id, action, subject): an action once for every organisation of its actor.

    Subjects are cut to 200 characters; an empty one is null. Actors without an organisation leave no row.
    """
    subject = F.substring(F.col("subject"), 1, SUBJECT)
    members = sized(members.select("user_id", "org_id").distinct())
    rows = actions.select("action_id", "user_id", "action", F.when(subject != "", subject).alias("subject"))
    return rows.join(members, "user_id").select("org_id", "action_id", "user_id", "action", "subject")


def version_exists(asked: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """asked with ``known``: whether (item_id, content_hash) is in the history or is the current version. Nulls are unknown."""
    keys = ["item_id", "content_hash"]
    both = history.select(*keys).unionByName(current.select(*keys))
    both = semi_joined(both, asked.select(*keys).distinct(), keys).distinct().withColumn("found", F.lit(True))
    return asked.join(both, keys, "left").withColumn("known", F.coalesce("found", F.lit(False))).drop("found")


def session_plans(activations: DataFrame, n: int = ACTIVATIONS) -> DataFrame:
    """Each session's newest n activations, of which the last one of a (source, skill) replaces earlier ones.

    Texts are trimmed and cut to bounded lengths; activations without session, source or skill are left out. ``position``
    counts from the newest. Ties of time: the larger activation_id.
    """
    source, skill = (F.trim(F.coalesce(c, F.lit(""))) for c in ("source", "skill"))
    rows = activations.where((F.coalesce("session_id", F.lit("")) != "") & (source != "") & (skill != ""))
    texts = {"source": source, "skill": skill, "snapshot_hash": F.coalesce("snapshot_hash", F.lit(""))}
    cut_texts = [F.substring(c, 1, PLAN_LENGTHS[name]).alias(name) for name, c in texts.items()]
    rows = rows.select(F.substring("session_id", 1, 160).alias("session_id"), "ts", "activation_id", *cut_texts)
    last = rows.groupBy("session_id", "source", "skill").agg(F.max(F.struct("ts", "activation_id", "snapshot_hash")).alias("last"))
    last = last.select("session_id", "source", "skill", "last.*")
    return top_per_group(last, ["session_id"], [F.desc("ts"), F.desc("activation_id")], n)


def user_stats(users: DataFrame, routes: DataFrame, owned: dict[str, DataFrame]) -> DataFrame:
    """Each user with runs, last_run, avg_latency (rounded half to even), maps of runs by tier and by outcome, and the number of
    rows of each ``owned`` table.

    Routes are counted by (user, tier, outcome) first, so the second step sees a bounded number of rows per user. A missing
    or empty tier is "unknown"; routes without an outcome are in no outcome. Latencies are summed as decimals of 14 places, so
    that an average of exactly one half is rounded alike in any order of rows; those beyond 1e13 are summed as they are.
    """
    exact = F.when(F.abs("latency") < 1e13, F.col("latency")).cast(LATENCY)
    beyond = F.when(exact.isNull(), F.col("latency")).cast("double")
    tier = F.when(F.coalesce("tier", F.lit("")) != "", F.col("tier")).otherwise("unknown")
    cells = routes.groupBy("user_id", tier.alias("tier"), "outcome").agg(
        F.count("*").alias("n"), F.max("ts").alias("last"), F.sum(exact).alias("total"), F.sum(beyond).alias("beyond"), F.count("latency").alias("timed")
    )
    total = F.coalesce(F.sum("total").cast("double"), F.lit(0.0)) + F.coalesce(F.sum("beyond"), F.lit(0.0))
    found = cells.groupBy("user_id").agg(
        F.sum("n").alias("runs"),
        F.max("last").alias("last_run"),
        F.bround(total / F.nullif(F.sum("timed"), F.lit(0)), 0).cast("long").alias("avg_latency"),
        F.collect_list(F.struct("tier", "outcome", "n")).alias("cells"),
    )

    def by(field: str) -> Column:
        keys = F.array_sort(F.array_distinct(F.array_compact(F.transform("cells", lambda c: c[field]))))
        zero = F.lit(0).cast("long")
        counted = F.transform(keys, lambda k: F.aggregate(F.filter("cells", lambda c: c[field] == k), zero, lambda x, c: x + c["n"]))
        return F.coalesce(F.map_from_arrays(keys, counted), F.create_map().cast("map<string,bigint>"))

    out = users.join(found, "user_id", "left")
    for name, rows in owned.items():
        out = out.join(rows.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(name, zero).alias(name) for name in ("runs", *owned)]
    return out.select(*users.columns, *counts, "last_run", "avg_latency", by("tier").alias("tiers"), by("outcome").alias("outcomes"))


def plan_totals(users: DataFrame, orgs: DataFrame, members: DataFrame, grants: DataFrame, usage: DataFrame, plans: list[str], month: Column, now: Column, quota: int, included: int) -> DataFrame:
    """One row: users by paid and by effective plan (null: the first plan), paying and billed users, active grants, organisations
    with seats (null: ``included``) and members, and this month's usage with the users of the first plan at their quota.

    users: (user_id, plan, effective, billing_id). grants: (revoked_at, expires_at). usage: (user_id, month, n).
    """
    free = plans[0]
    paid, effective = (F.coalesce(F.col(c), F.lit(free)) for c in ("plan", "effective"))
    mix = [F.count_if(c == p).alias(f"{name}_{p}") for name, c in (("paid", paid), ("effective", effective)) for p in plans]
    people = users.agg(*mix, F.count_if(paid.isin(plans[1:])).alias("paying"), F.count("billing_id").alias("billed"))
    active = grants.agg(F.count_if(F.col("revoked_at").isNull() & (F.col("expires_at") > now)).alias("active_grants"))
    seats = orgs.agg(F.count("*").alias("orgs"), F.coalesce(F.sum(F.coalesce("seat_limit", F.lit(included))), F.lit(0)).cast("long").alias("seats"))
    joined = members.agg(F.count("*").alias("org_members"))
    used = usage.where(F.col("month") == month)
    routes = used.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("routes"), F.count("*").alias("users_routing"))
    full = used.where(F.lit(quota > 0) & (F.col("n") >= quota)).join(users.where(effective == free), "user_id", "left_semi")
    rows = [people, active, seats, joined, routes, full.agg(F.count("*").alias("free_at_quota"))]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)  # tables of one row


def public_record(df: DataFrame, plain: list[str], session_backend: str, agent: str) -> DataFrame:
    """The record that clients see: ``plain`` columns as they are (null where df has none) and these derived ones.

    slug (or the name), summary (or the description), source_url, is_duplicate (null: false), stars (null: 0), platforms and
    role_reasons (null: empty), and session_activation, which only records of one backend with an address have.
    """

    def own(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    def filled(*names: str) -> Column:  # an empty text counts as missing
        return F.coalesce(*[F.when(own(n) != "", own(n)) for n in names])

    address = filled("install_url", "url")
    activation = F.struct(
        F.lit("session").alias("scope"), address.alias("source"), own("name").alias("skill"), F.lit(agent).alias("agent"), own("source_snapshot_hash").alias("snapshot_hash")
    )
    lists = [F.coalesce(own(n, "array<string>"), F.array().cast("array<string>")).alias(n) for n in ("platforms", "role_reasons")]
    return df.select(
        *[own(n).alias(n) for n in plain],
        filled("slug", "name").alias("slug"),
        filled("capability_summary", "description").alias("summary"),
        own("url").alias("source_url"),
        F.coalesce(own("is_duplicate", "boolean").cast("boolean"), F.lit(False)).alias("is_duplicate"),
        F.coalesce(own("stars", "long").cast("long"), F.lit(0).cast("long")).alias("stars"),
        *lists,
        F.when((own("retrieval_backend") == session_backend) & address.isNotNull(), activation).alias("session_activation"),
    )
