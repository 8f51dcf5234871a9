"""The pipeline against a plain composition of what each stage must do."""

import random

import pytest

import corpus_pipeline
from granary.llm.quality import quality

from .fixtures import awkward, prose
from .test_dedup import exact_brute, near_brute
from .test_scans import leak_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = str(tmp_path_factory.mktemp("tables"))
    base = [prose(rng, rng.randrange(30, 120), 3000) for _ in range(60)]
    items = [(k, " ".join(base[k].split()[5:20])) for k in range(4)]
    texts = base + base[10:16] + [t + " more" for t in base[20:30]] + [None, ""]
    texts += [" ".join(w + "###" for w in t.split()) for t in base[40:50]]
    docs = [(k, t, "en", "hot" if k % 3 else f"s{k % 5}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_pipeline(spark, folder):
    path, docs, items = folder
    keep = {r["doc_id"] for r in quality(spark.read.parquet(f"{path}/documents.parquet")).where("keep").collect()}
    assert not any("###" in (t or "") for d, t, *_ in docs if d in keep)
    left = [d for d in docs if d[0] in keep]
    kept = exact_brute(left)
    left = [d for d in left if kept[d[0]][2]]
    groups = near_brute(left)
    left = [d for d in left if groups[d[0]][1] == d[0]]
    left = [d for d in left if not leak_brute(d[1], items)[4]]
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in left)
    by_slot = {}
    for r in got:
        assert by_slot.setdefault(r["slot"], (r["source"], r["block"])) == (r["source"], r["block"])


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.where("false"), folder[0]).count() == 0


def test_pipeline_on_awkward_tables(spark, tmp_path):
    """Null and repeated doc_ids, repeated rows, null and empty texts, clashing column names, empty tables."""
    items = spark.createDataFrame([(1, "words that no document has at all")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    docs = awkward(spark)
    for name in ("_row", "_rank", "_gone", "_hit", "h", "g", "kept", "keys", "item"):
        if name not in docs.columns:
            docs = docs.selectExpr("*", f"1 as {name}")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got if r["text"]) == [(1, "same words in every row")]
    assert [r["doc_id"] for r in got if not r["text"]] == [2] and len(got) == 2
    items.write.parquet(f"{tmp_path}/b/benchmark.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
