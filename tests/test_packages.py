"""Links and closures of packages, and front matter."""

import pytest
from pyspark.sql import functions as F

from granary.functions.front_matter import folded_tags, front_matter, read_fields
from granary.operators.packages import package_closure, references, resolved

FILES = "package string, path string, text string"


def test_references(spark):
    text = """see [a](./x/../y.md#part "title") ![b](img/p.png?raw=1) [c](https://h.io/x) [d](mailto:a@b) [e](www.x.y/z) [f](claude.ai)
    [g](#top) [h](${root}/x) [i](*.md) [j](...) `scripts/run.sh` `lib/x.py` `../Assets/a.svg` [k](guide.md) [k](guide.md) [l](io/x)"""
    got = spark.createDataFrame([(text,), (None,)], "t string").select(references(F.col("t")).alias("r")).collect()
    assert got[0]["r"] == ["./x/../y.md", "img/p.png", "guide.md", "io/x", "scripts/run.sh", "../Assets/a.svg"] and got[1]["r"] == []


@pytest.mark.parametrize(
    "path, reference, want",
    [("a/b.md", "../c.md", "c.md"), ("a/b.md", "../../c.md", None), ("b.md", "./x//y/./z", "x/y/z"), ("a/b/c.md", "../../", ""), ("b.md", "/etc/x", "/etc/x"), ("b.md", "../b.md", None)],
)
def test_resolved(spark, path, reference, want):
    assert spark.range(1).select(resolved(F.lit(path), F.lit(reference))).first()[0] == want


def test_closure(spark):
    files = [
        ("p", "SKILL.md", "[a](docs/a.md) [gone](gone.md)"),
        ("p", "docs/a.md", "[back](../SKILL.md) [b](b.md) [b](./b.md) [out](../../x)"),
        ("p", "docs/b.md", "[a](a.md) [self](b.md)"),
        ("p", "docs/c.md", "[never](nowhere.md)"),
        ("p", "data.bin", None),
        ("q", "SKILL.md", None),
        ("q", "docs/a.md", "[x](y.md)"),
    ]
    entries = [("p", "SKILL.md"), ("q", "SKILL.md"), ("r", "SKILL.md")]
    out = package_closure(spark.createDataFrame(files, FILES), spark.createDataFrame(entries, "package string, path string"))
    assert sorted(map(tuple, out.collect())) == sorted(
        [("p", "SKILL.md", "reached"), ("p", "docs/a.md", "reached"), ("p", "docs/b.md", "reached"), ("p", "docs/c.md", "unreached"), ("p", "data.bin", "unreached")]
        + [("p", "gone.md", "missing"), ("p", "../../x", "outside"), ("q", "SKILL.md", "reached"), ("q", "docs/a.md", "unreached"), ("r", "SKILL.md", "reached")]
    )


def test_closure_of_a_chain_and_of_nothing(spark):
    chain = [("p", f"f{k}.md", f"[n](f{k + 1}.md) [first](f0.md)") for k in range(12)]
    out = package_closure(spark.createDataFrame(chain, FILES), spark.createDataFrame([("p", "f0.md")], "package string, path string"))
    assert {(r["path"], r["state"]) for r in out.collect()} == {(f"f{k}.md", "reached") for k in range(12)} | {("f12.md", "missing")}
    nothing = spark.createDataFrame([], FILES)
    assert package_closure(nothing, nothing.select("package", "path")).count() == 0


@pytest.mark.parametrize(
    "lines, want",
    [
        ("name: a\ntags: [x, 'y', ]\nlicense: \"MIT\"", {"name": "a", "tags": ["x", "y"], "license": "MIT"}),
        ("tags:\n- g\n  - d\nname: x", {"tags": ["g", "d"], "name": "x"}),
        ("metadata:\n  author: s\n  tags: [e]\n  triggers:\n    - one\n    - two\nafter: z", {"metadata": {"author": "s", "tags": ["e"], "triggers": ["one", "two"]}, "after": "z"}),
        ("d: >\n  first\n\n  second\nx: |-\n  kept", {"d": "first second", "x": "kept"}),
        ("a:\n\n  b: 1", {}),
        ("a: 1\n    orphan: 2\n# note\nb c: 3\na: 4", {"a": "4"}),
        ("a:\n  b:\n      c: 1\n    d: 2\n  e: 3", {"a": {"b": {"c": "1"}, "e": "3"}}),
        ("a:\n  b: 1\na:\n- x", {"a": ["x"]}),
        ("a: [\nb: []\nc: ''\nd: '", {"a": "[", "b": [], "c": "", "d": "'"}),
    ],
)
def test_fields(lines, want):
    assert read_fields(lines.split("\n")) == want


def test_front_matter_rows(spark):
    texts = ["\ufeff---\r\nname: a\r\n---\r\nbody", "# no front matter\n---\nx: 1\n---\n", "---\nname: x\n---", None, "---\nunclosed: 1\n"]
    rows = front_matter(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", F.to_json("fields").alias("f"), "body")
    got = {r["doc_id"]: (r["f"], r["body"]) for r in rows.collect()}
    assert got == {0: ('{"name":"a"}', "body"), 1: ("{}", texts[1]), 2: ('{"name":"x"}', ""), 3: ("{}", ""), 4: ("{}", texts[4])}


def test_tags_fold_whatever_their_case(spark):
    text = "---\ntags: [Excel, b]\nmetadata:\n  tags: [excel, xlsx]\n  triggers: no list\n  platforms:\n  - B\n  - c\n---\n"
    df = front_matter(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert df.select(folded_tags(F.col("fields"))).first()[0] == ["Excel", "b", "xlsx", "c"]
