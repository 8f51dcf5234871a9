"""Stemmer, stored postings, and fielded BM25 against a plain count."""

import math
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.functions.stemmer import stem
from granary.operators import lexical_index
from granary.operators.lexical_index import LexicalIndex, terms

STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "failing": "fail", "filing": "file",
    "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam",
    "operator": "oper", "decisiveness": "decis", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
    "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "probate": "probat",
    "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "yes": "ye", "is": "is", "x1s": "x1s", "yyy": "yyi",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS
    assert stem("a" * 64 + "s") == "a" * 64 + "s"
    assert terms("Élan-vitals, naïve_x ÉTÉS") == ["elan", "vital", "naiv", "x", "et"] and terms(None) == []


def brute(queries, docs, k):
    """docs: (doc_id, name, body), name counting twice."""
    tf, size, df = defaultdict(Counter), Counter(), Counter()
    for doc_id, name, body in docs:
        for weight, field in ((2.0, name), (1.0, body)):
            for t in terms(field):
                tf[doc_id][t] += weight
                size[doc_id] += 1
        df.update(tf[doc_id].keys())
    mean = sum(size.values()) / len(docs)
    out = {}
    for query_id, text in queries:
        own = Counter(stem(w) for w in (text or "").lower().split()[:12])
        scores = {}
        for doc_id, counts in tf.items():
            part = [
                n * max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * counts[t] * 2.2 / (counts[t] + 1.2 * (0.25 + 0.75 * size[doc_id] / mean))
                for t, n in own.items()
                if t in counts
            ]
            if part:
                scores[doc_id] = round(sum(part), 6)
        out[query_id] = sorted(scores.items(), key=lambda x: (-x[1], -x[0]))[:k]
    return out


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("gard", "stream", "copper", "lantern", "violet", "harbour") for b in ("", "s", "ing", "ed", "ers")]
    docs = [(k, " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, [2.0**-i for i in range(len(words))], k=rng.randrange(60)))) for k in range(300)]
    docs += [(1000, None, None), (1001, "", "unrelated"), (1002, docs[5][1], docs[5][2])]
    queries = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 16)))) for q in range(30)] + [(90, None), (91, ""), (92, "nowhere")]
    return queries, docs


def close(found, want):
    got = defaultdict(list)
    for r in found.orderBy("query_id", "position").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for query_id, rows in want.items():
        assert [d for d, _ in got[query_id]] == [d for d, _ in rows], query_id
        assert [s for _, s in got[query_id]] == pytest.approx([s for _, s in rows], abs=2e-6)


@pytest.mark.parametrize("block, probes", [(4096, 2), (16, 1)])
def test_topk(spark, tables, tmp_path, monkeypatch, block, probes):
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", block)
    queries, docs = tables
    index = LexicalIndex(spark, str(tmp_path / "index"), {"name": 2.0, "body": 1.0}, shards=8)
    schema = "doc_id long, name string, body string"
    index.add(spark.createDataFrame(docs[:100], schema))
    asked = spark.createDataFrame(queries, "query_id long, text string")
    close(index.topk(asked, 5), brute(queries, docs[:100], 5))
    before = {p: p.stat().st_mtime for p in (tmp_path / "index").rglob("*.parquet")}
    index.add(spark.createDataFrame(docs[100:], schema).repartition(3))
    after = {p: p.stat().st_mtime for p in (tmp_path / "index").rglob("*.parquet")}
    assert before.items() <= after.items() and len(after) > len(before)  # another segment, no file of the first touched
    close(index.topk(asked, 5, probes), brute(queries, docs, 5))


def test_only_shards_of_asked_terms_are_read(spark, tables, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "index"), {"name": 2.0, "body": 1.0}, shards=16)
    index.add(spark.createDataFrame(tables[1], "doc_id long, name string, body string"))
    asked = index._asked(spark.createDataFrame([(1, "lanterns")], "query_id long, text string"))
    read = index.postings_of(asked).select(F.input_file_name().alias("f")).distinct().collect()
    shard = spark.range(1).select(F.pmod(F.xxhash64(F.lit("lantern")), F.lit(16))).first()[0]
    assert read and all(f"shard={shard}/" in r["f"] for r in read)
    scanned = sum(p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet") if f"shard={shard}" in str(p))
    assert scanned < 0.3 * sum(p.stat().st_size for p in (tmp_path / "index").rglob("*.parquet"))


def test_empty_index_and_null_ids(spark, tmp_path):
    index = LexicalIndex(spark, str(tmp_path / "index"), {"name": 2.0, "body": 1.0})
    nothing = spark.createDataFrame([], "doc_id long, name string, body string")
    index.add(nothing)
    assert index.topk(spark.createDataFrame([(1, "lantern")], "query_id long, text string")).count() == 0
    with pytest.raises(Exception, match="without doc_id"):
        index.add(spark.createDataFrame([(None, "a", "b")], nothing.schema))


def test_words_of_a_text_are_counted_before_they_are_stemmed(monkeypatch):
    stemmed, stem = [], lexical_index.stem
    monkeypatch.setattr(lexical_index, "stem", lambda w: stemmed.append(w) or stem(w))
    monkeypatch.setattr(lexical_index.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    monkeypatch.setattr(lexical_index, "BLOCK_DOCS", 2)
    texts = ["Running run " * 500 + "caf\u00e9 cafe\u0301", "cafe", None, "run"]
    batch = pa.RecordBatch.from_pydict({"doc_id": [4, 2, 7, 9], "name": ["runs", None, "", "x"], "body": texts})
    rows = [r for b in lexical_index._block_rows(iter([batch]), [2.0, 0.5], "s") for r in b.to_pylist()]
    assert len(stemmed) == 7
    got = {(r["block"], r["term"]): (r["docs"], r["freqs"], r["sizes"], r["n"], r["most"], r["least"]) for r in rows}
    assert got == {
        ("s-3-0", "run"): ([4], [502.0], [1003], 1, 502.0, 1003), ("s-3-0", "cafe"): ([4, 2], [1.0, 0.5], [1003, 1], 2, 1.0, 1),
        ("s-3-0", None): (None, None, None, 2, 1004.0, 0), ("s-3-1", "x"): ([9], [2.0], [2], 1, 2.0, 2),
        ("s-3-1", "run"): ([9], [0.5], [2], 1, 0.5, 2), ("s-3-1", None): (None, None, None, 2, 2.0, 0),
    }
