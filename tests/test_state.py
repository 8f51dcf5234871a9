"""Keyed state by event time: the same result for any order of files, and bounded state."""

import datetime as dt
import random

import pytest

from granary.streaming import state
from granary.streaming.streams import run_available

START = dt.datetime(2024, 1, 1)
KIND = "event_id long, ts timestamp, user_id long, event_type string, props string"


def events(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(400):
        at = START + dt.timedelta(seconds=rng.randrange(5 * 86400), microseconds=rng.randrange(3) * 1000)
        rows.append((k, at, rng.choice([1, 1, 1, 2, 3]), rng.choice(["a", "a", "a", "b", "c", "end"]), str(rng.randrange(6))))
    # the last event only moves the watermark past all others
    return rows, (9999, START + dt.timedelta(days=60), 99, "a", "0")


def streamed(spark, folder, rows, last, operator, files):
    """The rows in any order as several files, the last event alone in the newest one."""
    random.Random(len(folder)).shuffle(rows)
    path = f"{folder}/events.parquet"
    spark.createDataFrame(rows, KIND).repartition(4).write.parquet(path)
    spark.createDataFrame([last], KIND).coalesce(1).write.mode("append").parquet(path)
    return run_available(spark, folder, "events", operator, files=files).collect()


def survey_brute(rows, every, hours):
    out, held = set(), {}
    for _, at, user, kind, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        count, asked = held.get(user, (0, None))
        if kind == "end":
            held[user] = (0, None)
            continue
        due = count + 1 >= every and (asked is None or at - asked >= dt.timedelta(hours=hours))
        held[user] = (count + 1, at if due else asked)
        if due:
            out.add((user, at))
    return out


def sessions_brute(rows, seconds, names, sessions):
    out, held = {}, {}
    for k, at, user, kind, name in sorted(rows, key=lambda r: (r[1], r[0])):
        live = {s: v for s, v in held.get(user, {}).items() if at - v[0] <= dt.timedelta(seconds=seconds)}
        own = [n for n in live.pop(kind, (None, []))[1] if n != name] + [name]
        live[kind] = (at, own[-names:])
        for s in sorted(live, key=lambda s: live[s][0])[: max(0, len(live) - sessions)]:
            del live[s]
        held[user] = live
        out[k] = (user, kind, own[-names:], len(live))
    return out


def stale_brute(rows, seconds):
    out, span = set(), dt.timedelta(seconds=seconds)
    for user in {r[2] for r in rows}:
        started = None
        for _, at, _, kind, _ in sorted((r for r in rows if r[2] == user), key=lambda r: (r[1], r[0])):
            if started is not None and at - started > span:
                out.add((user, started, started + span))
                started = None
            started = None if kind == "end" else started or at
        if started is not None:
            out.add((user, started, started + span))
    return out


@pytest.mark.parametrize("files", [None, 1])
def test_any_order_of_files(spark, tmp_path, files):
    rows, last = events(1)
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    def all_of(s):
        return state.survey_prompts(s.selectExpr("*", "event_type = 'end' as answered"), 5, 6, late="30 days")

    got = streamed(spark, str(tmp_path / "survey"), rows, last, all_of, files)
    assert {(r["user_id"], r["ts"]) for r in got} == survey_brute(rows, 5, 6) and len(got) == len({tuple(r) for r in got})

    def runs(s):
        return state.stale_runs(s.selectExpr("*", "event_type = 'end' as finished"), "user_id", late="30 days")

    got = streamed(spark, str(tmp_path / "stale runs"), rows, last, runs, files)
    assert {tuple(r) for r in got} == stale_brute(rows, 7200)


def test_sessions_are_bounded(spark, tmp_path):
    rows, last = events(2)

    def held(s):
        return state.bounded_sessions(s.selectExpr("*", "event_type as session", "props as name"), 6 * 3600, 3, 2, late="30 days")

    got = streamed(spark, str(tmp_path), rows, last, held, 2)
    assert {r["event_id"]: (r["user_id"], r["session"], r["names"], r["live"]) for r in got} == sessions_brute(rows, 6 * 3600, 3, 2)
    assert max(r["live"] for r in got) == 2 and max(len(r["names"]) for r in got) == 3


def test_nothing_before_the_watermark_and_no_change_of_settings(spark, tmp_path):
    rows, _ = events(3)
    newest = max(rows, key=lambda r: r[1])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    got = streamed(spark, str(tmp_path), rows, newest, lambda s: state.survey_prompts(s.selectExpr("*", "false as answered"), 1, 0, late="2 days"), None)
    assert {r["ts"] for r in got} == {r[1] for r in rows if r[1] < newest[1] - dt.timedelta(days=2)}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_many_keys_cost_as_many_calls_as_buckets(spark, tmp_path, monkeypatch):
    """Python is called for a bucket of keys, whose states are one value, and the result does not depend on the buckets."""
    rng, calls = random.Random(4), spark.sparkContext.accumulator(0)
    rows = [(k, START + dt.timedelta(seconds=rng.randrange(5 * 86400)), rng.randrange(300), rng.choice(["a", "end"]), "0") for k in range(2000)]
    last, call = (9999, START + dt.timedelta(days=60), 999, "end", "0"), state._Stale.__call__

    class Counted(state._Stale):
        def __call__(self, batches, group):
            calls.add(1)
            yield from call(self, batches, group)

    monkeypatch.setattr(state, "_Stale", Counted)
    monkeypatch.setattr(state, "BUCKETS", 5)
    got = streamed(spark, str(tmp_path), rows, last, lambda s: state.stale_runs(s.selectExpr("*", "event_type = 'end' as finished"), "user_id"), None)
    assert {tuple(r) for r in got} == stale_brute(rows, 7200) and len(got) > 300
    assert 5 <= calls.value <= 15
