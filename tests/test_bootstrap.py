"""Bootstraps against numpy's resampling, and their repeatability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import bootstrap
from granary.operators.bootstrap import cluster_difference, mean_lift, median_reduction, weights

ROWS = "id long, treated boolean, value double"


def test_weights_are_poisson():
    w = weights(np.arange(-50, 5000), np.arange(100))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, :20].T) - np.eye(20)).max() < 0.06
    assert (weights(np.array([7, -1]), np.arange(100)) == w[[57, 49]]).all()


def test_mean_lift(spark):
    rng = np.random.default_rng(1)
    values = rng.gamma(2, 5, 600)
    treated = np.arange(600) % 2 == 0
    values[treated] += 1.5
    rows = spark.createDataFrame([(i, bool(t), float(v)) for i, (t, v) in enumerate(zip(treated, values, strict=True))] + [(None, True, 1e9), (5000, None, 1e9), (5001, True, None)], ROWS)
    a, b = mean_lift(rows.repartition(2)).first(), mean_lift(rows.repartition(7)).first()
    assert tuple(a) == pytest.approx(tuple(b), abs=2e-6) and a["draws"] == 200
    own, other = values[treated], values[~treated]
    draws = [rng.choice(own, len(own)).mean() / rng.choice(other, len(other)).mean() - 1 for _ in range(4000)]
    assert a["lift"] == pytest.approx(own.mean() / other.mean() - 1, abs=1e-6)
    width = np.subtract(*np.percentile(draws, [97.5, 2.5]))
    assert a["low"] == pytest.approx(np.percentile(draws, 2.5), abs=0.2 * width) and a["high"] == pytest.approx(np.percentile(draws, 97.5), abs=0.2 * width)
    assert mean_lift(rows.where("false")).first()["draws"] is None or mean_lift(rows.where("false")).first()["draws"] == 0


def test_clusters_are_drawn_whole(spark):
    """Rows that agree within their cluster: the interval must be that of 40 clusters, not of 4000 rows."""
    rng = np.random.default_rng(2)
    hit = rng.random(40) < 0.5
    rows = [(c, int(hit[c] and k % 2 == 0), 1 - k % 2, int(hit[c] and k % 2 == 1 and c % 4 > 0), k % 2) for c in range(40) for k in range(100)]
    kind = "cluster long, control_hits int, control_n int, treatment_hits int, treatment_n int"
    r = cluster_difference(spark.createDataFrame(rows + [(None, 1, 1, 0, 1), (99, 0, 1, 0, 0)], kind).repartition(3)).first()
    lost = int((hit & (np.arange(40) % 4 == 0)).sum())
    assert (r["clusters"], r["wins"], r["losses"], r["ties"]) == (41, 0, lost, 40 - lost)
    per = hit * (np.arange(40) % 4 > 0) - hit.astype(int)
    draws = [rng.choice(per, 40).mean() for _ in range(4000)]
    assert r["low"] == pytest.approx(np.percentile(draws, 2.5), abs=0.05) and r["high"] == pytest.approx(np.percentile(draws, 97.5), abs=0.05)
    assert r["high"] - r["low"] > 0.1


def test_medians(spark):
    rng = np.random.default_rng(3)
    routed, holdout = np.round(rng.gamma(3, 4, 400)), np.round(rng.gamma(3, 5, 301))
    rows = [(k, "g", "routed", float(v)) for k, v in enumerate(routed)] + [(1000 + k, "g", "holdout", float(v)) for k, v in enumerate(holdout)]
    rows += [(5000 + k, "hot", arm, 7.0) for k, arm in enumerate(["routed", "holdout"] * 100)] + [(9000, "one arm", "routed", 1.0), (9001, "zero", "holdout", 0.0), (9002, "zero", "routed", 2.0), (9003, "other", "pilot", 2.0)]
    df = spark.createDataFrame(rows, "id long, family string, arm string, value double")
    got = {r["family"]: tuple(r)[1:] for r in median_reduction(df.repartition(3), "family").collect()}
    point = (np.median(holdout) - np.median(routed)) / np.median(holdout) * 100
    samples = []
    for _ in range(2000):
        h = np.median(rng.choice(holdout, len(holdout)))
        samples.append((h - np.median(rng.choice(routed, len(routed)))) / h * 100)
    low, high = np.percentile(samples, [2.5, 97.5])
    assert got["g"][0] == pytest.approx(round(point, 1)) and got["g"][1] == pytest.approx(low, abs=4) and got["g"][2] == pytest.approx(high, abs=4)
    assert got["hot"] == (0.0, 0.0, 0.0, 200)
    assert got["one arm"] == got["zero"] == got["other"] == (None, None, None, None)


def test_medians_are_those_of_the_weights(spark, monkeypatch):
    """Each draw against numpy's median of the rows repeated as their weights say."""
    rng = np.random.default_rng(4)
    values = {arm: rng.integers(1, 30, 157).astype(float) for arm in ("routed", "holdout")}
    ids = {"routed": np.arange(157), "holdout": np.arange(1000, 1157)}
    rows = [(int(i), "g", arm, float(v)) for arm in values for i, v in zip(ids[arm], values[arm], strict=True)]
    monkeypatch.setattr(bootstrap, "SLICE", 7)
    r = median_reduction(spark.createDataFrame(rows, "id long, family string, arm string, value double"), "family", draws=40).first()
    w = {arm: weights(ids[arm], np.arange(40)) for arm in values}
    median = {arm: np.array([np.median(np.repeat(values[arm], w[arm][:, d])) for d in range(40)]) for arm in values}
    samples = (median["holdout"] - median["routed"]) / median["holdout"] * 100
    assert (r["low_pct"], r["high_pct"]) == pytest.approx(tuple(np.round(np.percentile(samples, [2.5, 97.5]), 1)), abs=0.051)


def test_medians_of_more_rows_than_an_arrow_batch(spark):
    """Groups of several Arrow batches, in blocks that a draw's median may lie across."""
    n, draws = 30_000, 20
    ids = np.arange(n)
    values, routed = ids * 7919 % 30_011 / 100, ids % 2 == 0
    arm = F.when(F.col("id") % 2 == 0, "routed").otherwise("holdout")
    rows = spark.range(n).select("id", F.lit("a").alias("family"), arm.alias("arm"), (F.col("id") * 7919 % 30_011 / 100).alias("value"))
    w = weights(ids, np.arange(draws))
    median = {a: np.array([np.median(np.repeat(values[own], w[own, d])) for d in range(draws)]) for a, own in (("routed", routed), ("holdout", ~routed))}
    low, high = np.percentile((median["holdout"] - median["routed"]) / median["holdout"] * 100, [2.5, 97.5])
    for more in ({}, {"block": 999}):
        r = median_reduction(rows, "family", draws=draws, **more).first()
        assert (r["low_pct"], r["high_pct"], r["draws"]) == (pytest.approx(low, abs=0.06), pytest.approx(high, abs=0.06), draws)
