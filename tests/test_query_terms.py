"""Queries that ask for all terms of a prompt, on a prompt whose last terms in the alphabet name the best document."""

import pytest

from granary.operators import retrieval
from granary.plans import catalogue

FIRST = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima"
FILLER = "\n" + "0 1 2 3 4 5 6 7 8 9 " * 12


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two documents: 101 has two of the last terms, 202 one of the first twelve; no line is mostly terms of the prompt."""
    path = tmp_path_factory.mktemp("prompts")
    docs = [(101, "zulu yankee xray whiskey victor" + FILLER, "en", "s5", 252), (202, "alpha xray whiskey" + FILLER, "en", "s5", 246)]
    tables = {
        "benchmark": ([(0, f"zulu yankee {FIRST}")], "item_id long, text string"),
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(101, 1, 0), (202, 0, 0)], "doc_id long, quality int, toxic int"),
        "embeddings": ([(0, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


#: What a query says of the documents, by name: (columns, rows).
WANTED = {
    "candidate_roles": ("doc_id", {(101,), (202,)}),
    "task_contract": ("doc_id", {(101,), (202,)}),
    "score_margins": ("top_score runner_score", {(2.0, 1.0)}),
    "label_precision": ("position exact irrelevant", {(1, 1, 0), (2, 0, 1)}),
    "intent_fusion": ("doc_id lanes", {(101, 2), (202, 2)}),
    "first_deliverable": ("doc_id", {(101,)}),
    "canonical_picks": ("doc_id position", {(101, 1), (202, 2)}),
}


@pytest.mark.parametrize("name", WANTED)
def test_all_terms_of_a_prompt_count(spark, folder, name):
    columns, want = WANTED[name]
    assert {tuple(r) for r in catalogue.queries()[name](spark, folder).select(*columns.split()).collect()} == want


def test_queries_of_many_terms_are_several_of_a_block(spark):
    words = " ".join(f"w{k}" for k in range(100, 130))
    asked = spark.createDataFrame([(k, words) for k in range(4)] + [(9, None)], "query_id long, text string")
    docs = spark.createDataFrame([(1, "w129 w128"), (2, "w100")], "doc_id long, text string")
    for block in (100, 4):
        got = {tuple(r)[:3] for r in retrieval.lexical_topk(asked, docs, 2, block, None).collect()}
        assert got == {(q, d, n) for q in range(4) for d, n in ((1, 2), (2, 1))}
    assert {r["doc_id"] for r in retrieval.lexical_topk(asked, docs, 2).collect()} == {2}
