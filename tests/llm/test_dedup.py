"""Exact dedup, near-duplicate join and line dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import common, jaccard_join
from granary.llm import line_dedup as line_dedup_module
from granary.llm.common import connected_components, merged_components
from granary.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from granary.llm.jaccard_join import _most_common, _signature, drop_near_duplicates, near_duplicate_groups
from granary.llm.line_dedup import CuckooFilter, LineStore, line_dedup

from .fixtures import awkward, documents, empty, prose, rows


def flat(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact_brute(docs):
    groups = defaultdict(list)
    for doc_id, text, *_ in docs:
        groups[flat(text)].append((-len(text or ""), doc_id))
    out = {}
    for doc_id, text, *_ in docs:
        own = groups[flat(text)]
        keep = min(own)[1]
        out[doc_id] = (keep, len(own), keep == doc_id, hashlib.sha256(flat(text).encode()).hexdigest())
    return out


def found(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_exact_duplicates(spark, block):
    assert found(exact_duplicates(documents(spark), block=block)) == exact_brute(rows())


def test_exact_duplicates_survive_bucket_collisions(spark):
    got = found(exact_duplicates(documents(spark), block=16, bucket=lambda b: F.length(b) % 3))
    assert got == exact_brute(rows())


def test_exact_duplicates_of_awkward_rows(spark):
    got = exact_duplicates(awkward(spark)).collect()
    assert len(got) == 5
    same = [r for r in got if r["group_size"] == 3]
    assert len(same) == 3 and sum(r["kept"] for r in same) == 1 and {r["keep_id"] for r in same} == {1}
    assert exact_duplicates(empty(spark)).count() == 0
    kept = drop_exact_duplicates(documents(spark))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, v in exact_brute(rows()).items() if v[2]}
    assert kept.columns == documents(spark).columns


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def near_brute(docs, percent=75):
    sets = {d: shingles(t) for d, t, *_ in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("seed", [2])
def test_near_duplicate_groups(spark, seed):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_groups(documents(spark, seed)).collect()}
    assert got == near_brute(rows(seed))


@pytest.mark.parametrize("region, block, broadcast", [(3, 500, 2_000_000), (3, 500, 0)])
def test_near_duplicate_groups_of_a_dense_neighbourhood(spark, monkeypatch, region, block, broadcast):
    """One text with up to 14 of 60 words changed: links at all distances around the threshold, late shingles, blocks."""
    monkeypatch.setattr(jaccard_join, "REGION", region)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", broadcast)
    rng = random.Random(5)
    base = [f"v{i}" for i in range(60)]
    docs = []
    for k in range(160):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_groups(df).collect()}
    assert got == near_brute(docs)


def test_near_duplicate_groups_of_texts_made_of_shared_passages(spark, monkeypatch):
    """Texts of popular passages in any order with some words of their own: no shingle is rare, few texts are linked."""
    monkeypatch.setattr(jaccard_join, "REGION", 4)
    rng = random.Random(9)
    passages = [prose(rng, 30, 5000) for _ in range(6)]
    docs = []
    for k in range(150):
        own = [prose(rng, rng.choice((0, 2, 6, 20)), 5000)]
        docs.append((k, " ".join(rng.sample(passages, rng.randrange(1, 4)) + own)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicate_groups(df).collect()}
    assert got == near_brute(docs)


def test_signatures_bound_intersections():
    rng = np.random.default_rng(2)
    pool = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    for n, m in ((1, 1), (3, 700), (900, 1000), (1023, 1025), (40, 60)):
        for _ in range(20):
            x, y = (np.sort(rng.choice(pool, k, replace=False)) for k in (n, m))
            bound = _most_common(_signature(x), _signature(y), n, m)
            assert len(np.intersect1d(x, y)) <= bound <= min(n, m)
        assert _most_common(_signature(x), _signature(x), n, m) >= len(x) or n != m
    crowded = np.arange(700, dtype=np.uint64)
    assert _most_common(_signature(crowded), _signature(crowded), 700, 700) == 700


def test_near_duplicates_of_awkward_rows(spark):
    got = near_duplicate_groups(awkward(spark)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in got)[:4] == [
        (False, 1, 1),
        (False, 1, 1),
        (False, 2, 2),
        (False, 3, 3),
    ]
    assert near_duplicate_groups(empty(spark)).count() == 0
    kept = {r["doc_id"] for r in drop_near_duplicates(documents(spark)).collect()}
    assert kept == {c for _, c in near_brute(rows()).values()}
    kept = drop_near_duplicates(awkward(spark).withColumn("_row", F.lit(1)).withColumn("_rank", F.lit(2)))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]


@pytest.mark.parametrize("edges_per_task", [200_000, 20])
def test_connected_components(spark, monkeypatch, edges_per_task):
    monkeypatch.setattr(common, "EDGES_PER_TASK", edges_per_task)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200, 240)] + [(0, k) for k in range(1, 90)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}
    some = connected_components(spark.createDataFrame(edges[::2], "a long, b long"))
    both = merged_components(some, spark.createDataFrame(edges[1::2], "a long, b long"))
    assert {r["node"]: r["label"] for r in both.collect() if r["node"] != r["label"]} == got


def lines_brute(docs):
    def key(line):
        k = re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
        return k if len(k) >= 10 else None

    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if key(line):
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        parts = (t or "").split("\n")
        kept = [p for p in parts if not key(p) or len(holders[key(p)]) < 2 or min(holders[key(p)]) == d]
        out[d] = (len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


LINES = [
    (5, "A line that repeats.\nshort\nonly here, once"),
    (2, "  a LINE that repeats.\t\nshort\n\nanother one that repeats"),
    (9, "another one that repeats\nanother one that repeats\nA line that repeats."),
    (11, None),
    (12, ""),
    (13, "ééééé\néééééééééé"),
    (14, "éééééééééé"),
]


def line_results(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()}


def test_line_dedup(spark):
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    assert line_results(line_dedup(df)) == lines_brute(LINES)
    docs = [(d, t) for d, t, *_ in rows()]
    assert line_results(line_dedup(documents(spark))) == lines_brute(docs)
    assert line_dedup(empty(spark)).count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    same = hashlib.sha256(b"same words in every row").hexdigest()
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup(awkward(spark)).collect())
    assert got == [(0, 1, 0, same), (1, 1, 0, same), (1, 1, 0, same), (2, 1, 0, nothing), (3, 1, 0, nothing)]


def test_line_store_is_incremental_and_reversible(spark):
    first = spark.createDataFrame(LINES[:3], "doc_id long, text string")
    second = spark.createDataFrame(LINES[3:], "doc_id long, text string")
    store = LineStore.build(first)
    before = sorted(map(tuple, store.counts.collect()))
    more = store.insert(second)
    both = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in more.dedup(first.unionByName(second)).collect()}
    assert both == {d: v[:2] for d, v in lines_brute(LINES).items()}
    back = more.delete(second.select("doc_id"))
    assert sorted(map(tuple, back.counts.collect())) == before
    fewer = back.delete(spark.createDataFrame([(2,)], "doc_id long"))
    left = [x for x in LINES[:3] if x[0] != 2]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in fewer.dedup(first.where("doc_id <> 2")).collect()}
    assert got == {d: v[:2] for d, v in lines_brute(left).items()}


def test_cuckoo_filter_never_forgets():
    """A filter filled to the brim over several calls: an insertion that doesn't fit changes nothing."""
    for seed in range(5):
        rng = np.random.default_rng(seed)
        keys = rng.integers(-(2**62), 2**62, 6_000)
        f = CuckooFilter(np.zeros((1024, 4), np.uint16))
        held = []
        for part in (keys[:1_500], keys[1_500:3_300], keys[3_300:], keys[3_300:3_450], keys[3_300:]):
            before = f.table.copy()
            if f.insert(part):
                held.append(part)
            else:
                assert (f.table == before).all()
            assert f.holds(np.concatenate(held)).all()
        assert len(held) == 3
        f.delete(held[0])
        assert f.holds(np.concatenate(held[1:])).all()
        assert np.count_nonzero(f.table) == sum(map(len, held[1:]))
        assert f.holds(rng.integers(-(2**62), 2**62, 20_000)).mean() < 0.01
    same = np.full(12, 77)  # more equal keys than two buckets hold
    assert CuckooFilter.of(same).holds(np.arange(5)).all()


def test_line_store_grows(spark, monkeypatch):
    """Shards of few keys: filters are made again from the counts, resharded, and give the same results."""
    monkeypatch.setattr(line_dedup_module, "SHARD_KEYS", 8)
    rng = random.Random(4)
    docs = [(k, "\n".join(f"line number {rng.randrange(900)}" for _ in range(12))) for k in range(120)]
    frames = [spark.createDataFrame(docs[a:b], "doc_id long, text string") for a, b in ((0, 3), (3, 10), (10, 60), (60, 120))]
    store = LineStore.empty(spark)
    for frame in frames:
        store = store.insert(frame)
    everything = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in store.dedup(everything).collect()}
    assert got == {d: v[:2] for d, v in lines_brute(docs).items()}
    assert store.shards > 8
    known = store.maybe_known(store.counts).count()
    assert known == store.counts.count()
    back = store.delete(frames[3].select("doc_id"))
    want = {d: v[:2] for d, v in lines_brute(docs[:60]).items()}
    got = back.dedup(everything.where("doc_id < 60")).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in got} == want
    assert back.maybe_known(back.counts).count() == back.counts.count()
