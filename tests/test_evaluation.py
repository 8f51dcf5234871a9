"""Judging operators on small made-up tables."""

from datetime import datetime, timedelta

from granary.operators import evaluation as V


def test_hit_rates_count_queries_without_results(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 3)], "query_id long, doc_id long, position int")
    expected = spark.createDataFrame([(1, 11), (1, 99), (2, 20), (3, 30)], "query_id long, doc_id long")
    rows = {r["k"]: (r["hits"], r["queries"]) for r in V.hit_rates(ranked, expected, [1, 2, 3]).collect()}
    assert rows == {1: (0, 3), 2: (1, 3), 3: (2, 3)}


def test_clear_winner_needs_a_lead_or_no_runner(spark):
    ranked = spark.createDataFrame(
        [(1, 10, 1, 8.0), (1, 11, 2, 5.0), (2, 20, 1, 7.0), (2, 21, 2, 5.0), (3, 30, 1, 1.0)], "query_id long, doc_id long, position int, score double"
    )
    rows = {r["query_id"]: (r["doc_id"], r["margin"], r["clear"]) for r in V.clear_winners(ranked).collect()}
    assert rows == {1: (10, 3.0, True), 2: (20, 2.0, False), 3: (30, None, True)}


def test_replicated_tasks_leave_out_perfect_controls_and_single_runs(spark):
    rows = [("a", False, False), ("a", False, True), ("a", True, True), ("a", True, True)]
    rows += [("b", False, True)] * 2 + [("b", True, False)] * 2 + [("c", False, False), ("c", True, True), ("c", True, True)]
    out = V.replicated_tasks(spark.createDataFrame(rows, "task string, treated boolean, passed boolean")).collect()
    assert [(r["task"], r["control"], r["treatment"], r["control_n"], r["treatment_n"]) for r in out] == [("a", 0.5, 1.0, 2, 2)]


def test_changes_compare_nulls_and_missing_keys(spark):
    before = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, v string")
    after = spark.createDataFrame([(1, "x"), (2, None), (4, "z")], "id long, v string")
    assert {r["id"]: r["changed"] for r in V.behaviour_changes(before, after, "id", "v").collect()} == {1: False, 2: False, 3: True, 4: True}


def test_window_counts_match_brute_force_for_a_busy_key(spark):
    start = datetime(2024, 1, 1)
    rows = [(i, i % 7 // 6, start + timedelta(seconds=(i * i * 37) % 5000)) for i in range(300)]
    out = V.within_window(spark.createDataFrame(rows, "id long, key long, ts timestamp"), "key", "ts", 100)
    found = {r["id"]: r["recent"] for r in out.collect()}
    for i, key, ts in rows:
        assert found[i] == sum(k == key and timedelta(0) <= ts - t <= timedelta(seconds=100) for _, k, t in rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, key long, ts timestamp")
    assert V.within_window(empty, "key", "ts", 100).count() == 0
