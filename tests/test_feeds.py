"""Feeds, visible items, audit rows, session plans and totals by hand-worked rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from granary.operators import feeds

T0 = datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, ts timestamp, tier string, outcome string, latency double, warnings string, secret string"


def events(spark, rows):
    return spark.createDataFrame([(k, u, T0 + timedelta(seconds=s), *rest, "hidden") for k, u, s, *rest in rows], EVENTS)


ROWS = [
    (1, 1, 10, "full", "used", 10.0, '["slow"]'),
    (2, 1, 20, "hint", None, 15.0, "broken ["),
    (3, 1, 20, "", "used", None, None),
    (4, 2, 5, None, "failed", 2.5, ""),
    (5, None, 30, "full", None, 1.0, "[]"),
]


def test_user_feed(spark):
    got = feeds.user_feed(events(spark, ROWS), ["tier"], 2)
    assert "secret" not in got.columns
    rows = sorted((r["user_id"], r["position"], r["event_id"], r["warnings"]) for r in got.collect())
    assert rows == [(1, 1, 3, []), (1, 2, 2, []), (2, 1, 4, [])]
    many = events(spark, [(k, 1, k, "t", None, 1.0, '["a","b"]') for k in range(250)])
    assert feeds.user_feed(many, [], 1000).count() == 200  # never more
    assert feeds.user_feed(many, [], 0).collect()[0]["warnings"] == ["a", "b"]  # and at least one
    assert feeds.user_feed(events(spark, []), ["tier"]).count() == 0


def test_recent_feed(spark):
    users = spark.createDataFrame([(1, "a@x", "key"), (3, "c@x", "key")], "user_id long, email string, password string")
    got = feeds.recent_feed(events(spark, ROWS), users, ["tier"], 4)
    assert set(got.columns) == {"event_id", "ts", "user_id", "tier", "warnings", "email"}
    assert sorted((r["event_id"], r["email"]) for r in got.collect()) == [(1, "a@x"), (2, "a@x"), (3, "a@x"), (5, None)]


def test_visible_items(spark):
    items = [
        (1, 7, None, None, 5), (2, 7, 100, None, 5), (3, 8, 100, "approved", 6), (4, 8, 100, "pending", 7),
        (5, 8, None, "approved", 8), (6, 9, 200, "approved", 9), (7, None, None, None, 9),
    ]
    items = spark.createDataFrame(items, "item_id long, owner long, org_id long, status string, created int")
    members = spark.createDataFrame([(7, 100), (7, 100), (7, 200), (8, 100), (None, 200)], "user_id long, org_id long")
    asked = spark.createDataFrame([(7,), (8,), (10,)], "user_id long")
    got = sorted((r["user_id"], r["item_id"], r["from_org"]) for r in feeds.visible_items(items, members, asked).collect())
    assert got == [(7, 1, False), (7, 2, True), (7, 3, True), (7, 6, True), (8, 2, True), (8, 3, True), (8, 5, False)]


def test_audit_rows(spark):
    actions = [(1, 7, "install", "s" * 300), (2, 8, "install", ""), (3, 9, "install", "x"), (4, None, "install", "x"), (5, 7, "install", None)]
    members = spark.createDataFrame([(7, 100), (7, 200), (8, 100), (None, 300)], "user_id long, org_id long")
    out = feeds.audit_rows(spark.createDataFrame(actions, "action_id long, user_id long, action string, subject string"), members)
    got = sorted((r["org_id"], r["action_id"], len(r["subject"] or "")) for r in out.collect())
    assert got == [(100, 1, 200), (100, 2, 0), (100, 5, 0), (200, 1, 200), (200, 5, 0)]
    assert [r["subject"] for r in out.where("action_id = 2").collect()] == [None]


def test_version_exists(spark):
    schema = "item_id long, content_hash string"
    asked = spark.createDataFrame([(1, "new"), (1, "old"), (1, "old"), (2, "old"), (None, "new"), (1, None)], schema)
    history, current = spark.createDataFrame([(1, "old"), (1, "new"), (None, "new")], schema), spark.createDataFrame([(1, "new"), (2, "x")], schema)
    got = sorted((r["item_id"] or 0, r["content_hash"] or "", r["known"]) for r in feeds.version_exists(asked, history, current).collect())
    assert got == [(0, "new", False), (1, "", False), (1, "new", True), (1, "old", True), (1, "old", True), (2, "old", False)]


def test_session_plans(spark):
    rows = [("s", k, k, " src ", f"skill {k % 20}", "d" * 200) for k in range(60)]
    rows += [("t", 1, 1, "a", "b", None), ("t", 1, 2, "a", "b", "later"), ("t", 9, 3, " ", "b", "x"), ("t", 9, 4, "a", None, "x"), ("", 9, 5, "a", "b", "x"), (None, 9, 6, "a", "b", "x")]
    df = spark.createDataFrame([(s, T0 + timedelta(seconds=t), *x) for s, t, *x in rows], "session_id string, ts timestamp, activation_id long, source string, skill string, snapshot_hash string")
    got = feeds.session_plans(df).collect()
    mine = sorted((r["position"], r["activation_id"], r["source"], len(r["snapshot_hash"])) for r in got if r["session_id"] == "s")
    assert mine == [(p, 60 - p, "src", 128) for p in range(1, 13)]
    assert [(r["activation_id"], r["snapshot_hash"]) for r in got if r["session_id"] != "s"] == [(2, "later")]


def test_user_stats(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "user_id long, email string")
    owned = {"installs": users.where("user_id < 3").unionByName(users.where("user_id = 1"))}
    got = {r["user_id"]: r for r in feeds.user_stats(users, events(spark, ROWS), owned).collect()}
    assert (got[1]["runs"], got[1]["installs"], got[1]["avg_latency"]) == (3, 2, 12)  # 12.5, half to even
    assert got[1]["tiers"] == {"full": 1, "hint": 1, "unknown": 1} and got[1]["outcomes"] == {"used": 2}
    assert got[2]["tiers"] == {"unknown": 1} and got[2]["avg_latency"] == 2 and got[2]["outcomes"] == {"failed": 1}
    assert (got[3]["runs"], got[3]["installs"], got[3]["last_run"], got[3]["tiers"], got[3]["outcomes"]) == (0, 0, None, {}, {})


def test_averages_of_a_half_do_not_depend_on_the_order_of_rows(spark):
    """Sums of these doubles differ in their last digits from order to order; their averages are exact halves."""
    users = spark.createDataFrame([(n, "u") for n in range(6)], "user_id long, email string")
    for seed in range(4):
        rows, rng = [], random.Random(seed)
        for user, half in enumerate((0.5, 1.5, 2.5, 93.5, 105.5)):
            values = [half + x / 100 for n in range(1, 30) for x in (n, -n)]
            rng.shuffle(values)
            rows += [(n, user, n, "t", rng.choice("abcd"), round(v, 2), "") for n, v in enumerate(values)]
        rows.append((9, 5, 9, "t", None, 1e15, ""))
        got = {r["user_id"]: r["avg_latency"] for r in feeds.user_stats(users, events(spark, rows), {}).collect()}
        assert got == {0: 0, 1: 2, 2: 2, 3: 94, 4: 106, 5: 10**15}


def test_plan_totals(spark):
    users = [(1, None, None, None), (2, "free", "pro", None), (3, "pro", "pro", "b"), (4, "team", "free", "c")]
    users = spark.createDataFrame(users, "user_id long, plan string, effective string, billing_id string")
    orgs, members = spark.createDataFrame([(3,), (None,)], "seat_limit int"), spark.createDataFrame([(1, 1)], "user_id long, org_id long")
    grants = spark.createDataFrame([(None, T0), (None, T0 + timedelta(days=2)), (T0, T0 + timedelta(days=2))], "revoked_at timestamp, expires_at timestamp")
    usage = spark.createDataFrame([(1, "m", 5), (2, "m", 9), (4, "m", 4), (4, "l", 9)], "user_id long, month string, n long")
    args = (["free", "pro", "team"], F.lit("m"), F.lit(T0 + timedelta(days=1)))
    row = feeds.plan_totals(users, orgs, members, grants, usage, *args, 5, 5).first().asDict()
    assert row == {
        "paid_free": 2, "paid_pro": 1, "paid_team": 1, "effective_free": 2, "effective_pro": 2, "effective_team": 0, "paying": 2, "billed": 2,
        "active_grants": 1, "orgs": 2, "seats": 8, "org_members": 1, "routes": 18, "users_routing": 3, "free_at_quota": 1,
    }
    none = feeds.plan_totals(users.limit(0), orgs.limit(0), members.limit(0), grants.limit(0), usage.limit(0), *args, 0, 5).first()
    assert set(none) == {0}


def test_public_record(spark):
    rows = [(1, "n", "", "d", "u", None, "session", None), (2, "n", "s", "d", None, "", "session", 4), (3, None, None, None, "u", "i", "session", 1), (4, "n", "s", "d", "u", "i", None, 1)]
    df = spark.createDataFrame(rows, "id long, name string, slug string, description string, url string, install_url string, retrieval_backend string, stars int")
    got = {r["id"]: r for r in feeds.public_record(df, ["id", "license"], "session", "me").collect()}
    assert (got[1]["slug"], got[1]["summary"], got[1]["stars"], got[1]["license"], got[1]["is_duplicate"]) == ("n", "d", 0, None, False)
    assert got[1]["session_activation"]["source"] == "u" and got[3]["session_activation"]["source"] == "i"
    assert got[2]["session_activation"] is None and got[4]["session_activation"] is None and got[3]["slug"] is None
    assert got[1]["platforms"] == [] == got[1]["role_reasons"]


def test_dates_of_items_are_written_before_the_join(spark):
    """The result of visible_items has many rows of an item; its date is formatted once."""
    from granary.plans.feed_queries import visible_items

    plan = visible_items(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan.split("Join")[0]


def test_items_of_an_organisation_follow_each_other(spark):
    """Interleaved items give runs of one organisation in each task of the result."""
    items = spark.range(600).selectExpr("id as item_id", "id as owner", "id % 5 as org_id", "'approved' as status", "'2024' as created").coalesce(2)
    members, asked = spark.createDataFrame([(u, u % 5) for u in range(20)], "user_id long, org_id long"), spark.range(20).withColumnRenamed("id", "user_id")
    parts = feeds.visible_items(items, members, asked).select("org_id").rdd.glom().collect()
    assert sum(map(len, parts)) == 600 * 4 and sum(a != b for part in parts for a, b in zip(part, part[1:])) <= 8
