"""Packing: an exact round trip, full windows, the tokenizer's own ids, balanced groups."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from granary.llm import packing
from granary.llm.common import Scratch
from granary.llm.packing import Ids, Pool, pack

from .fixtures import awkward, documents, empty, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def doc_ids(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(5)
    known = Ids(PATH)
    parts = ["don't", "I'LL", "''s", "a'sb", "x1y22", "#$%", "é", "é", " ́a", "ΣΑΣ Σ", "İI", "ß", "éÉté ÀŽ", "ŸÿÆœ", "ſ", "éa\u0301", "É\u0300", "×÷", " ", "\x1c", "\x85", "\x00", "\x7f"]
    parts += ["<|endoftext|>", "<|startoftext|", "ﬁ", "한글", "가", "😀", "_", "\t", "\n", " ", "tail", "0" * 70, "ab" * 50, "١٢", " "]
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(12)))
        assert known.of(text) == doc_ids(tokenizer, text)[:-1].tobytes(), repr(text)
    text = "word " * 300_000
    assert len(known.of(text)) == 4 * 300_000


@pytest.mark.parametrize("seed", range(6))
def test_pool_fills_windows(seed):
    rng = random.Random(seed)
    pool, lengths = Pool(), {}
    got = defaultdict(list)
    sizes = Counter()

    def take(windows):
        for size, window in windows:
            assert sum(n for _, _, n in window) == size and size & (size - 1) == 0
            sizes[size] += 1
            for key, start, n in window:
                assert n > 0
                got[key].append((start, n))

    for key in range(rng.randrange(1, 600)):
        lengths[key] = rng.choice([1, 2, 255, 256, 257, 2047, rng.randrange(1, 2048), rng.randrange(1, 300)])
        pool.add(key, 0, lengths[key])
        if key % 97 == 0:
            take(pool.windows())
    take(pool.windows(last=True))
    for key, n in lengths.items():
        at = 0
        for start, length in sorted(got[key]):
            assert start == at
            at += length
        assert at == n
    assert not pool.tokens and not pool.lengths
    assert all(n <= 1 for size, n in sizes.items() if size < 256)


def checked(found, docs, tokenizer, step_tokens):
    """Every id in one piece, pieces with the right ids, windows full and gapless, groups of one size and alike."""
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_window[r["sequence_id"]].append(r)
    assert set(by_doc) == {d[0] for d in docs}
    for doc_id, text, *_ in docs:
        ids, at = doc_ids(tokenizer, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            own = ids[at : at + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(own.tobytes()) and r["ids"] == own.astype(np.int32).tolist()
            at += r["length"]
        assert at == len(ids)
    windows, cost = defaultdict(Counter), Counter()
    for own in by_window.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert {(r["tier"], r["step_group"]) for r in own} == {(at, own[0]["step_group"])} and at & (at - 1) == 0 and at <= 2048
        windows[at][own[0]["step_group"]] += 1
        cost[own[0]["step_group"]] += sum(r["length"] ** 2 for r in own)
    groups = sorted(g for own in windows.values() for g in own)
    assert groups == list(range(len(groups)))  # no group has windows of two sizes
    for size, own in windows.items():
        assert len(own) == -(-sum(own.values()) * size // step_tokens) and max(own.values()) - min(own.values()) <= 1
    return windows, cost


def test_round_trip(spark, tokenizer):
    docs = rows()
    found = pack(documents(spark), with_ids=True, step_tokens=4096).collect()
    checked(found, docs, tokenizer, 4096)
    plain = pack(documents(spark)).collect()
    assert "ids" not in plain[0].asDict() and len({r["doc_id"] for r in plain}) == len(docs)


def test_groups_cost_alike(spark, tokenizer):
    rng = random.Random(3)
    docs = [(k, "a " * rng.choice([3, 40, 300, 700, 1500, 5000]), "en", "s", 1) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    windows, cost = checked(pack(df, with_ids=True, step_tokens=16384).collect(), docs, tokenizer, 16384)
    full = [cost[g] / n for g, n in windows[2048].items()]
    assert len(full) > 10 and max(full) < 1.3 * min(full)


def test_small_pools_and_other_sizes(spark, tokenizer, monkeypatch):
    docs = spark.createDataFrame(rows(2), "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    found = packing.pieces(docs, PATH, tiers=(64, 128), pool_tokens=500, with_ids=True).collect()
    ids = Counter()
    for r in found:
        ids[r["sequence_id"]] += r["length"]
    assert all(n <= 128 and n & (n - 1) == 0 for n in ids.values())
    assert sum(ids.values()) == sum(len(doc_ids(tokenizer, d[1])) for d in rows(2))
    with pytest.raises(ValueError, match="powers of two"):
        Pool((100,))


def test_awkward_rows(spark, tokenizer):
    assert pack(empty(spark)).count() == 0
    found = pack(awkward(spark), with_ids=True).collect()
    own = doc_ids(tokenizer, "same words in every row")
    whole = [r for r in found if r["doc_tokens"] == len(own)]
    assert sum(r["length"] for r in whole) == 3 * len(own) and {r["doc_id"] for r in whole} == {1, None}
    assert sorted((r["doc_id"], r["ids"]) for r in found if r["doc_tokens"] == 1) == [(2, [1]), (3, [1])]


def test_scratch_is_cleared(spark, tmp_path):
    scratch = Scratch(spark)
    pack(documents(spark), scratch=scratch).count()
    assert len(scratch.paths) == 2
    scratch.clear()
    assert not scratch.paths
