"""Runs against a search of all periods and starts."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import pytest

from granary.llm.periodic_runs import run_digest, runs, with_planted_runs, word_runs, z_function

from .fixtures import awkward, documents, empty, rows


def runs_brute(words, least=24, times=3):
    n, out = len(words), {}
    for p in range(1, n // times + 1):
        start = 0
        while start + p < n:
            end = start
            while end + p < n and words[end] == words[end + p]:
                end += 1
            length = end + p - start
            if length >= max(least, times * p):
                out.setdefault((start, length), p)
            start = max(end, start) + 1
    return sorted((a, n, p) for (a, n), p in out.items())


def digest_brute(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs_brute(words)
    gone = {k for a, length, p in found for k in range(a + p, a + length)}
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{a},{length},{p}\n" for a, length, p in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_z_function():
    for s in ([], [1], [1, 1, 1, 1], [1, 2, 1, 2, 1, 3], [2, 2, 1, 2, 2, 1, 2]):
        assert z_function(s) == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]


@pytest.mark.parametrize("seed", range(8))
def test_runs(seed):
    rng = random.Random(seed)
    for _ in range(60):
        words = []
        while len(words) < rng.randrange(1, 400):
            period = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(1, 30))]
            words += period * rng.randrange(1, 9) + period[: rng.randrange(len(period) + 1)]
            words += [rng.randrange(1000)] * rng.randrange(2)
        assert runs(words) == runs_brute(words)
        assert runs(words, 6, 2) == runs_brute(words, 6, 2)


def test_nested_and_touching_runs():
    inner = ["a", "b"] * 13
    words = (inner + ["c"]) * 4
    found = runs(words)
    assert found == runs_brute(words) and {p for *_, p in found} == {2, 27}
    assert runs(["x"] * 23) == [] and runs(["x"] * 24) == [(0, 24, 1)]
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs(list(fibonacci[-1])) == runs_brute(list(fibonacci[-1]))


def test_long_texts():
    began = time.perf_counter()
    assert runs(["x"] * 200_000) == [(0, 200_000, 1)]
    rng = random.Random(1)
    words = [rng.randrange(5000) for _ in range(200_000)]
    assert runs(words + words[:60_000] * 3)[-1][2] == 60_000
    assert time.perf_counter() - began < 60


def test_digests(spark):
    docs = rows() + [(k, "p q r " * k, "en", "s", 0) for k in range(1000, 1060)]
    df = documents(spark).unionByName(spark.createDataFrame(docs[len(rows()) :], documents(spark).schema))
    got = {r["doc_id"]: tuple(r)[1:] for r in run_digest(word_runs(with_planted_runs(df))).collect()}
    assert got == {d[0]: digest_brute(d[0], d[1]) for d in docs}
    assert sum(v[0] > 0 for v in got.values()) > 5


def test_whole_outputs(spark):
    text = "start " + "one two\n" * 20 + "end"
    r = word_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 40, 2)] and r["collapsed"] == "start one two end" and r["n"] == 42


def test_awkward_rows(spark):
    assert run_digest(word_runs(with_planted_runs(empty(spark)))).count() == 0
    got = run_digest(word_runs(with_planted_runs(awkward(spark)))).collect()
    assert len(got) == 5 and all(tuple(r)[1:6] == (0, None, None, None, None) for r in got)
    by_id = {r["doc_id"]: r["collapsed_sha256"] for r in got}
    nothing = hashlib.sha256(b"").hexdigest()
    assert by_id[2] == by_id[3] == nothing and by_id[None] == hashlib.sha256(b"same words in every row").hexdigest()
