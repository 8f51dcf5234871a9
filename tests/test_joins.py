"""As-of joins and similarity joins against plain loops."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.operators.asof import latest_before
from granary.operators import set_join
from granary.operators.set_join import near_matches


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_latest_before(spark, width):
    rng = random.Random(width)
    keys = [1] * 6 + [2, 3, None]  # one hot key
    right = [(rng.choice(keys), rng.choice([*range(60), None]), k, f"r{k}") for k in range(200)]
    left = [(rng.choice(keys), rng.choice([*range(-5, 70), None]), k) for k in range(300)]
    a = spark.createDataFrame(left, "user long, at long, id long").repartition(3)
    b = spark.createDataFrame(right, "user long, at long, id long, name string").repartition(5)
    out = latest_before(a, b, ["user"], "at", "id", ["id", "name"], lambda t: F.floor(t / width))
    assert out.columns == ["user", "at", "id", "found_id", "found_name"]
    got = {r["id"]: (r["user"], r["at"], r["found_id"], r["found_name"]) for r in out.collect()}
    assert len(got) == 300 == out.count()
    for user, at, k in left:
        fits = [(t, i, n) for u, t, i, n in right if u == user and user is not None and t is not None and at is not None and t <= at]
        want = max(fits)[1:] if fits else (None, None)
        assert got[k] == (user, at, *want)


def test_latest_before_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, 5, 1)], "user long, at long, id long")
    part = lambda t: F.floor(t / 10)
    assert tuple(latest_before(rows, rows.where("false"), ["user"], "at", "id", ["id"], part).first()) == (1, 5, 1, None)
    assert latest_before(rows.where("false"), rows, ["user"], "at", "id", ["id"], part).count() == 0


def test_near_matches(spark):
    rng = random.Random(2)
    base = [rng.sample([f"t{k}" for k in range(80)], rng.randrange(1, 30)) for _ in range(40)] + [["a"], ["a", "b", "c", "d"]]

    def changed(s):
        s = [t for t in s if rng.random() > 0.06]
        return list(dict.fromkeys(s + [f"t{rng.randrange(80)}" for _ in range(rng.randrange(3))]))

    catalogue = [(k, s) for k, s in enumerate([*base, *(changed(s) for s in base * 4), *[base[0]] * 50, [], None])]
    drafts = [(k, rng.sample(s, len(s))) for k, s in enumerate([changed(s) for s in base * 2] + base[:3] * 4)] + [(900, []), (901, None), (902, ["alone"])]
    got = near_matches(spark.createDataFrame(drafts, "draft_id long, tokens array<string>").repartition(3), spark.createDataFrame(catalogue, "entry_id long, tokens array<string>").repartition(4))
    got = {r["draft_id"]: tuple(r)[1:] for r in got.collect()}
    assert len(got) == len(drafts)
    for k, s in drafts:
        own, fits = set(s or ()), []
        for j, t in catalogue:
            both = own & set(t or ())
            if both and 100 * len(both) >= 80 * len(own | set(t)):
                fits.append((-len(both) / len(own | set(t)), j))
        want = (len(fits), min(fits)[1], round(-min(fits)[0], 6)) if fits else (0, None, None)
        assert got[k] == pytest.approx(want), k


def test_near_matches_store_entries_once(spark, monkeypatch):
    """Whole sets of the catalogue are written once, and tokens travel as checksums of the first ones alone."""
    stored, keep = [], set_join.written
    monkeypatch.setattr(set_join, "written", lambda df: stored.append(df.columns) or keep(df))
    sets = [(k, [f"t{k + j}" for j in range(9)]) for k in range(30)]
    drafts, catalogue = (spark.createDataFrame(rows, f"{key} long, tokens array<string>") for rows, key in ((sets[:5], "draft_id"), (sets, "entry_id")))
    got = {tuple(r)[:3] for r in near_matches(drafts, catalogue).collect()}
    assert got == {(k, 3 if k else 2, k) for k in range(5)} and sum("tokens" in c for c in stored) == 3


@pytest.mark.parametrize("options", [{}, {"block": 250}])
def test_near_matches_keep_pairs_in_tasks(spark, options):
    """Few words make pairs of nearly all sets by their first tokens; none of them is stored, in one block or in many."""
    rng = random.Random(5)
    sets = [(k, rng.sample([f"w{j}" for j in range(20)], rng.randrange(9, 12))) for k in range(2000)]
    drafts, catalogue = (spark.createDataFrame(rows, f"{key} long, tokens array<string>").repartition(2) for rows, key in ((sets[:100], "draft_id"), (sets, "entry_id")))
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    seen = set(folder.rglob("part-*"))
    got = {tuple(r) for r in near_matches(drafts, catalogue, **options).collect()}
    stored = sum(f.stat().st_size for f in set(folder.rglob("part-*")) - seen)
    want = set()
    for k, own in sets[:100]:
        near = [(-len(both) / len(own | set(t)), j) for j, t in sets if 100 * len(both := (own := set(own)) & set(t)) >= 80 * len(own | set(t))]
        want.add((k, len(near), min(near)[1], round(-min(near)[0], 6)))
    assert got == want and stored < 300_000
