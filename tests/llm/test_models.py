"""Classifiers by held-out accuracy, and the mix by its own promises."""

import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from granary.llm import language
from granary.llm.exact_dedup import drop_exact_duplicates
from granary.llm.language import ByteNetwork, identify, language_id
from granary.llm.mixing import edf, exact, mix, mixed_order, phases, shares
from granary.llm.quality import LABELLERS, drop_low_quality, estimate, quality
from granary.llm.toxicity import fit, risk, toxicity

from .fixtures import awkward, documents, empty, prose, rows


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_id(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "er", "ung", "ei"], "cc": ["ção", "nh", "ou", "é"]}
    docs = []
    for k in range(450):
        lang = "aa bb cc".split()[k % 3]
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randrange(5, 120)))
        docs.append((k, text, lang))
    docs += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, "kalomi " * 9, None)]
    got = language_id(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(docs)
    lang = {d: x for d, _, x in docs}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 450]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_without_labels(spark):
    assert {r["lang_pred"] for r in identify(documents(spark), None).collect()} == {"und"}
    assert language_id(empty(spark)).count() == 0
    assert language_id(awkward(spark)).count() == 5


def test_toxicity(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(1500):
        toxic = k % 7 == 0
        words = prose(rng, 60).split() + (["nasty", "vile", "rotten"] if toxic else [])
        rng.shuffle(words)
        docs.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    labels += [(1, None), (None, 1)]
    docs += [(5000, None), (5001, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 5000]
    assert np.mean([r["predicted"] == (r["doc_id"] % 7 == 0) for r in held]) > 0.97
    assert toxicity(awkward(spark), spark.createDataFrame([], "doc_id long, toxic int")).count() == 5


def test_toxicity_risk_stays_non_negative():
    known, weights, bias = fit([np.array([1, 2], np.int32)] * 20, [np.array([1, 2], np.int32)] * 2 + [np.array([3], np.int32)] * 400, 0.05)
    assert set(known.tolist()) == {1, 2} and (weights > 0).all()
    assert fit([], [], 0.0)[0].size == 0


def test_toxicity_risk_against_loops():
    rng = np.random.default_rng(3)
    for prior in (0.05, 0.9):
        x_p, x_u = (rng.integers(0, 2, (n, 4)).astype(float) for n in (7, 11))
        w, b = rng.normal(size=4), 0.3
        for scale in (0.1, 4.0):

            def parts(w, b, scale=scale, prior=prior, x_p=x_p, x_u=x_u):
                s = [[1 / (1 + math.exp(-(sum(x * y for x, y in zip(row, w, strict=True)) + b))) for row in x] for x in (x_p, x_u)]
                plus = prior * sum(-math.log(v) for v in s[0]) / len(s[0])
                minus = sum(-math.log(1 - v) for v in s[1]) / len(s[1]) - prior * sum(-math.log(1 - v) for v in s[0]) / len(s[0])
                return plus, minus

            plus, minus = parts(w * scale, b)
            value, d_w, d_b = risk(x_p, x_u, w * scale, b, prior)
            assert abs(value - (plus + max(0, minus))) < 1e-6
            objective = (lambda w, b: sum(parts(w, b))) if minus >= 0 else (lambda w, b: -parts(w, b)[1])
            for k in range(4):
                step = np.eye(4)[k] * 1e-5
                slope = (objective(w * scale + step, b) - objective(w * scale - step, b)) / 2e-5
                assert abs(slope - d_w[k]) < 1e-5
            assert abs((objective(w * scale, b + 1e-5) - objective(w * scale, b - 1e-5)) / 2e-5 - d_b) < 1e-5


def test_toxicity_scores_against_loops(spark):
    from granary.llm.text import word_hashes
    from granary.llm.toxicity import BITS, score_toxicity

    def bucket(word):
        data = np.frombuffer(word.encode(), np.uint8)
        return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0] >> np.uint64(64 - BITS))

    words = ["vile", "wabc", "wbcd", "bad", "wa"]
    known = sorted((bucket(w), 0.7 * k - 1) for k, w in enumerate(words))
    model = (np.array([h for h, _ in known], np.int32), np.array([v for _, v in known]), -0.4)
    weight = dict(known)
    docs = [(k, t) for k, (_, t, *_) in enumerate(rows())] + [(800, "Vile vile BAD"), (801, None)]
    got = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for d, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        own = {bucket(w) for w in re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)}
        assert abs(got[d] - 1 / (1 + math.exp(0.4 - sum(weight.get(h, 0) for h in own)))) < 1e-9


def test_language_network_against_loops(spark):
    """A plain forward pass: windows, filters, the largest response of each, softmax, the weighted mean of logarithms."""
    model = ByteNetwork(["aa", "bb", "cc"], seed=5)
    model.bias += np.array([0.1, -0.2, 0.3], np.float32)
    docs = [(k, t) for k, (_, t, *_) in enumerate(rows()) if t and len(t) < 2500] + [(900, "x" * 700), (901, "É")]
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()}
    for d, text in docs:
        raw = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        total = [0.0] * 3
        for at in range(0, len(raw), 256):
            part = raw[at : at + 256]
            window = part + [32] * (256 - len(part))
            pooled = []
            for table in model.tables:
                responses = [sum(table[k][window[i + k]] for k in range(len(table))) for i in range(256 - len(table) + 1)]
                pooled += list(np.max(responses, axis=0))
            z = [sum(p * model.out[f][c] for f, p in enumerate(pooled)) + model.bias[c] for c in range(3)]
            norm = math.log(sum(math.exp(v) for v in z))
            total = [t + len(part) * (v - norm) for t, v in zip(total, z, strict=True)]
        p = [math.exp(t / max(1, len(raw))) for t in total]
        if any(c.isalpha() for c in text):
            assert got[d]["lang_pred"] == ["aa", "bb", "cc"][int(np.argmax(p))]
            assert abs(got[d]["score"] - max(p) / sum(p)) < 1e-4
        else:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)


def test_rare_languages_are_in_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 60)
    docs = [(k, "aa" if k < 3000 else "bb" if k < 3020 else "cc") for k in range(3400)]
    sample = language._by_language(spark.createDataFrame(docs, "doc_id long, lang string"))
    found = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert found["bb"] == 20 and 5 <= found["aa"] <= 40 and 5 <= found["cc"] <= 40
    assert language._by_language(spark.createDataFrame([], "doc_id long, lang string")).count() == 0


def test_em_against_documents():
    """EM document by document, with loops, gives the posterior that counted patterns give."""
    rng = np.random.default_rng(6)
    votes = rng.integers(0, 3, (200, len(LABELLERS)))
    votes[:120] = np.where(votes[:120] == 2, 1, votes[:120])
    patterns = (votes * 3 ** np.arange(len(LABELLERS))).sum(1)
    values, counts = np.unique(patterns, return_counts=True)
    got = estimate(values, counts.astype(float), rounds=7)[0]
    good = [0.1 if 2 in v else 0.95 for v in votes.tolist()]
    for _ in range(7):
        share = (sum(good) + 1) / (len(good) + 2)
        rates = []
        for k in range(len(LABELLERS)):
            row = []
            for c, (seen, fired) in enumerate(((1.0, 0.02), (1.0, 0.5))):
                own = good if c == 0 else [1 - g for g in good]
                fired += sum(g for g, v in zip(own, votes, strict=True) if v[k] == 2)
                seen += sum(g for g, v in zip(own, votes, strict=True) if v[k])
                row.append(fired / seen)
            rates.append(row)
        for i, v in enumerate(votes.tolist()):
            like = [share, 1 - share]
            for k, vote in enumerate(v):
                for c in (0, 1):
                    like[c] *= rates[k][c] if vote == 2 else 1 - rates[k][c] if vote == 1 else 1
            good[i] = like[0] / sum(like)
    assert np.allclose(got[np.searchsorted(values, patterns)], good, atol=1e-6)


def test_stages_keep_one_of_repeated_rows(spark):
    kept = sorted((r["doc_id"] or 0) for r in drop_exact_duplicates(awkward(spark)).collect())
    assert kept == [1, 2]
    odd = awkward(spark).withColumn("_rejected", F.lit(1))
    assert drop_low_quality(odd).columns == odd.columns and drop_low_quality(odd).count() == 5


def test_weak_labels_are_recovered():
    rng = np.random.default_rng(1)
    junk = rng.random(5000) < 0.2
    fires = np.where(junk[:, None], rng.random((5000, 3)) < 0.8, rng.random((5000, 3)) < 0.02)
    patterns = ((1 + fires) * 3 ** np.arange(3)).sum(1)
    values, counts = np.unique(patterns, return_counts=True)
    good, rates, share = estimate(values, counts.astype(float))
    assert abs(share - 0.8) < 0.03
    assert (abs(rates[:3, 1] - 0.8) < 0.05).all() and (rates[:3, 0] < 0.05).all()
    decided = good[np.searchsorted(values, patterns)] < 0.5
    assert (decided == junk).mean() > 0.97


def test_quality(spark):
    rng = random.Random(3)
    docs = []
    for k in range(600):
        text = prose(rng, rng.randrange(3, 150))
        if k % 6 == 0:
            text = " ".join(w + rng.choice(["$$$", "%%%", "***"]) for w in text.split())
        elif k % 6 == 1:
            text = " ".join([text.split()[0]] * (20 + len(text.split())))
        docs.append((k, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality(df).collect()}
    wrong = [k for k, text in docs if got[k]["keep"] == (k % 6 < 2) and len(text.split()) > 5]
    assert len(wrong) < 6
    kept = {r["doc_id"] for r in drop_low_quality(df).collect()}
    assert kept == {k for k, r in got.items() if r["keep"]}


def test_quality_of_awkward_rows(spark):
    assert quality(empty(spark)).count() == 0
    assert all(r["keep"] for r in quality(awkward(spark)).collect())
    assert drop_low_quality(awkward(spark)).count() == 5


def test_schedule_is_within_one_block():
    rng = random.Random(4)
    for _ in range(60):
        q = shares({f"s{i}": rng.random() ** 3 + 1e-3 for i in range(rng.randint(1, 9))}, rng.randint(1, 120))
        period, taken = sum(q.values()), dict.fromkeys(q, 0)
        for slot, source, block in edf(q):
            assert block == taken[source]
            taken[source] += 1
            assert all(abs(taken[s] - (slot + 1) * q[s] / period) < 1 for s in q)
        blocks = {s: rng.randint(0, 300) for s in q}
        plan = phases(blocks, q)
        assert all(sum(p["n_blocks"] for p in plan if p["source"] == s) == n for s, n in blocks.items())


def mix_brute(docs, weights, block, period):
    """The same stream by simulating one slot at a time from the documented order of documents."""
    size = {}
    for source, _, chars in docs:
        size[source] = size.get(source, 0) + chars
    blocks = {s: -(-n // block) for s, n in size.items()}
    share = shares(weights or {s: n**0.5 for s, n in size.items()}, period)
    slots, slot, done, left = {}, 0, dict.fromkeys(blocks, 0), dict(blocks)
    while left := {s: n for s, n in left.items() if n}:
        enough = all(n >= share[s] for s, n in left.items())
        own = {s: share[s] if enough else min(share[s], n) for s, n in left.items()}
        for at, s, _ in edf(own):
            slots[s, done[s]] = slot + at
            done[s] += 1
        slot += sum(own.values())
        left = {s: blocks[s] - done[s] for s in left}
    return slots, blocks


def test_mix_places_every_document_once(spark):
    rng = random.Random(6)
    docs = [(k, "x" * rng.randrange(0, 60), rng.choice(["hot"] * 5 + ["b", "c"])) for k in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    for weights in (None, {"hot": 1.0, "b": 2.0, "c": 1.0}):
        got = mix(df, weights, block=100, period=10).collect()
        assert sorted(r["doc_id"] for r in got) == list(range(700))
        slots, blocks = mix_brute([(s, k, max(1, len(t))) for k, t, s in docs], weights, 100, 10)
        assert all(slots[r["source"], r["block"]] == r["slot"] for r in got)
        starts = {}
        for r in got:
            starts.setdefault(r["source"], []).append((r["block"] * 100 + r["place"], max(1, len(r["text"]))))
        for own in starts.values():  # documents follow each other without gaps
            own.sort()
            assert [a for a, _ in own] == np.concatenate(([0], np.cumsum([n for _, n in own])[:-1])).tolist()
    left_out = mix(df, {"b": 1.0}, block=100, period=10)
    assert {r["source"] for r in left_out.select("source").distinct().collect()} == {"b"}


def test_mix_of_awkward_rows(spark):
    assert mixed_order(empty(spark)).count() == 0
    got = mix(awkward(spark)).collect()
    assert len(got) == 5 and all(isinstance(r["slot"], int) for r in got)
    assert mix(documents(spark)).select(F.countDistinct("doc_id")).first()[0] == documents(spark).count()


def exact_mix(n_blocks, weight, slots):
    """Blocks of each source in the exact mix by each slot, source after source running out."""
    left, done, out, at = n_blocks.astype(float), np.zeros(len(weight)), [], 0.0
    for t in range(1, slots + 1):
        while t - at > 1e-9:
            rate = np.where(left > 1e-9, weight, 0)
            rate = rate / rate.sum()
            step = min(t - at, (left[rate > 0] / rate[rate > 0]).min())
            done, left, at = done + step * rate, left - step * rate, at + step
        out.append(done)
    return np.array(out)


def test_exact_mix_follows_the_weights():
    rng = np.random.default_rng(7)
    cases = [(np.array([3000, 3000, 40]), np.array([0.3337, 0.6662, 0.0001]))]
    cases.append((rng.integers(1, 4, 1500), rng.random(1500) ** 3 + 1e-4))
    cases += [(rng.integers(1, 200, 7), rng.random(7) ** 4 + 1e-5) for _ in range(5)]
    for blocks, weight in cases:
        for slab in (64, 1 << 16):
            source, block, slot = (np.concatenate(c) for c in zip(*exact(blocks, weight, slab), strict=True))
            assert slot.tolist() == list(range(blocks.sum()))
            taken = np.zeros((len(slot), len(blocks)))
            taken[slot, source] = 1
            taken = taken.cumsum(0)
            assert (taken[slot, source] == block + 1).all() and (taken[-1] == blocks).all()
            assert abs(taken - exact_mix(blocks, weight, len(slot))).max() < 1 + 1e-6


def test_mix_of_many_sources_and_tiny_weights(spark):
    rows = [(k, "x" * 10, f"s{k % 2500}") for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, block=10).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(5000)) and sorted(r["slot"] for r in got) == list(range(5000))
    rows = [(k, "x" * 10, "rare" if k < 50 else "often") for k in range(4050)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["slot"]: r["source"] for r in mix(df, {"rare": 0.0005, "often": 0.9995}, block=10).collect()}
    rare = np.cumsum([got[s] == "rare" for s in range(4000)])
    assert abs(rare - 0.0005 * np.arange(1, 4001)).max() < 1
