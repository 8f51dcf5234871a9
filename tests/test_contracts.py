"""Task contracts, retrieval records and parity by hand-worked cases."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.functions import contract as C
from granary.functions import retrieval_record as RR


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "query, requested, want",
    [
        ("fix the parser", "", ("general", "debug", None)),
        ("fix the python parser", None, ("coding", "debug", "coding-language-or-artifact")),
        ("build a dashboard", "", ("data", "implement", "data-artifact")),
        ("build a sql dashboard", "", ("coding", "implement", "coding-language-or-artifact")),
        ("see Main.PY", "", ("coding", "work", "coding-language-or-artifact")),
        ("Python", "", ("general", "work", None)),  # only lower-case runs are words
        ("browse and review sources", "", ("research", "review", "research-intent")),
        ("write slides", "", ("documents", "implement", "document-artifact")),
        ("write slides", " Data ", ("data", "implement", "client-task-family")),
        ("write slides", "cooking", ("documents", "implement", "document-artifact")),
        (None, "", ("general", "work", None)),
    ],
)
def test_tasks(spark, query, requested, want):
    q = F.lit(query).cast("string")
    assert tuple(one(spark, C.task_analysis(q, C.task_tokens(q), F.lit(requested).cast("string")))) == want


@pytest.mark.parametrize(
    "name, description, category, platforms, kind",
    [
        ("Rules ", "", None, None, "policy"), ("x", "an Always-On guide", None, None, "policy"), ("x", "", "policy", ["slack"], "policy"),
        ("auto-integration", "", None, None, "integration"), ("x", "", "integration", None, "integration"), ("x", "", None, ["acme"], "integration"),
        ("x", "database migration", None, [], "workflow"), (None, None, None, None, "specialist"),
    ],
)
def test_kinds(spark, name, description, category, platforms, kind):
    c = [F.lit(v).cast("string") for v in (name, description, category)]
    p = F.lit(platforms).cast("array<string>") if platforms is not None else F.lit(None).cast("array<string>")
    assert one(spark, C.candidate_kind(*c, p, ["rules"])) == kind


@pytest.mark.parametrize(
    "query, kind, name, platforms, want",
    [
        ("send to Slack", "integration", "x", ["slack"], True), ("send a message", "integration", "x", ["slack"], False), ("use ACME now", "integration", "x", ["acme"], True),
        ("acmes", "integration", "x", ["acme"], False), ("sync my mail", "integration", "auto-integration", None, True), ("my mail", "integration", "auto-integration", None, False),
        ("posts in notion", "integration", "Notion integration", [], True), ("anything", "policy", "x", None, False), ("anything", "workflow", "x", None, True),
    ],
)
def test_serving(spark, query, kind, name, platforms, want):
    q = F.lit(query)
    assert one(spark, C.serves(q, C.task_tokens(q), F.lit(kind), F.lit(name), F.lit(platforms).cast("array<string>") if platforms else F.lit(None).cast("array<string>"))) is want


def test_records(spark):
    content = "---\r\nname: x\r\n---\r\n# T\n![i](u)[link](v) <b>x</b>\n```py\n" + "a" * 400 + "\n```\nafter ``` b"
    args = [F.lit(v) for v in (" n ", "", ["t"] * 14, None, content, "", "SKILL.md")]
    r = one(spark, RR.retrieval_record(args[0], args[1], args[2], args[3].cast("string"), *args[4:]))
    text = "n. " + " ".join(["t"] * 12) + ". # T link x " + "a" * 300 + " after ``` b"
    assert r["text"] == text and r["text_hash"] == hashlib.sha256(text.encode()).hexdigest()
    identity = json.dumps({"version": RR.VERSION, "text_hash": r["text_hash"], "package_hash": None, "entrypoint": "SKILL.md"}, sort_keys=True, separators=(",", ":"))
    assert r["record_hash"] == hashlib.sha256(identity.encode()).hexdigest()
    assert one(spark, RR.retrieval_text(F.lit("n"), F.lit(""), F.lit("---\na: b\n---\n> *x* `y`\n#z"))) == "n x y z"
    long = one(spark, RR.prose(F.lit("```\n" + "x" * 200_000 + "\n``` end")))
    assert long == "x" * 300 + " end" and len(one(spark, RR.retrieval_text(F.lit(None).cast("string"), F.lit("d"), F.lit("y" * 5000)))) == 1500


def test_parity(spark):
    sha = hashlib.sha1(b"a").hexdigest()
    rows = [("g", 1, "a", sha), ("g", 2, "b", sha), ("g", 3, None, sha), ("h", 4, "a", sha), ("i", 5, "a", "")]
    got = {r["g"]: r.asDict() for r in RR.embedding_parity(spark.createDataFrame(rows, "g string, id long, text string, stored string"), "g").collect()}
    assert [got["g"][k] for k in ("total", "matched", "mismatched", "missing", "parity", "first_mismatch")] == [3, 1, 1, 1, False, 2]
    assert got["h"]["parity"] and not got["i"]["parity"] and got["i"]["missing"] == 1
