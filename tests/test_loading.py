"""The package store, retrieval records, the validated load and source integrity."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.sources.package_store import PackageStore, Refused, activate_records
from granary.sources.validated import FIELDS, load_with_quarantine, public_url, source_integrity, validated

PACKAGES = "package_hash string, entrypoint string, source_url string, commit string"
FILES = "package_hash string, path string, sha256 string, content binary"


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def package(spark, name, contents, source="https://a.example/x", commit=None):
    h = digest(name.encode())
    files = [(h, path, digest(c), c) for path, c in contents.items()]
    return spark.createDataFrame([(h, next(iter(contents)), source, commit)], PACKAGES), spark.createDataFrame(files, FILES)


def state(store):
    return {t: sorted(map(repr, store.table(t).drop("prefix").collect())) for t in ("objects", "packages", "files", "sources")}


def test_put_twice_is_one_state(spark, tmp_path):
    store = PackageStore(spark, str(tmp_path / "store"))
    assert store.table("packages").count() == 0
    one, two = package(spark, "one", {"SKILL.md": b"hello", "b": b"same"}), package(spark, "two", {"SKILL.md": b"other", "c": b"same", "d": b""})
    store.put(*one)
    store.put(one[0].unionByName(two[0]), one[1].unionByName(two[1]))
    before = state(store)
    assert [len(before[t]) for t in ("objects", "packages", "files", "sources")] == [4, 2, 5, 2]
    store.put(*one)
    assert state(store) == before
    store.put(*package(spark, "one", {"SKILL.md": b"hello", "b": b"same"}, "https://fork.example/x", "abc"))
    after = state(store)
    assert len(after["sources"]) == 3 and {t: after[t] for t in ("objects", "packages", "files")} == {t: before[t] for t in ("objects", "packages", "files")}
    assert store.damaged().count() == 0
    assert {p.name for p in (tmp_path / "store").glob("objects/stage=*/prefix=*")} == {f"prefix={digest(c)[:2]}" for c in (b"hello", b"same", b"other", b"")}


def test_refused_puts_leave_the_store(spark, tmp_path):
    store = PackageStore(spark, str(tmp_path / "store"))
    good = package(spark, "one", {"SKILL.md": b"hello"})
    store.put(*good)
    before = state(store)
    tampered = good[1].withColumn("content", F.lit(b"HELLO"))
    twice = good[1].unionByName(good[1].withColumn("content", F.lit(b"x")).withColumn("sha256", F.lit(digest(b"x"))))
    cases = [
        (good[0], tampered, "without its digest"),
        (good[0], good[1].withColumn("content", F.lit(None).cast("binary")), "without its digest"),
        (good[0].withColumn("package_hash", F.lit("xyz")), good[1], "no valid package"),
        (good[0], twice, "two contents"),
        (good[0].where("false"), good[1], "files without package"),
        (good[0].withColumn("entrypoint", F.lit("gone.md")), good[1], "entry point"),
        (*package(spark, "one", {"SKILL.md": b"hello", "more": b"1"}), "another package"),
        (*package(spark, "one", {"SKILL.md": b"changed"}), "another package"),
    ]
    for packages, files, fault in cases:
        with pytest.raises(Refused, match=fault):
            store.put(packages, files)
    assert state(store) == before
    # what a put that broke off has written is not seen, since no commit names it
    spark.createDataFrame([("f" * 64, "e")], "package_hash string, entrypoint string").write.parquet(str(tmp_path / "store" / "packages" / "stage=lost"))
    assert state(store) == before


def test_records(spark):
    kind = "doc_id long, record_hash string, text string, active boolean"
    old = spark.createDataFrame([(1, "a", "t", True), (1, "b", "t", False), (2, "c", "t", True), (None, "z", "t", True)], kind)
    new = spark.createDataFrame([(1, "d", "n"), (1, "d", "n"), (2, "c", "again"), (3, "e", "n"), (None, "y", "n")], "doc_id long, record_hash string, text string")
    got = {r["record_hash"]: (r["doc_id"], r["text"], r["active"]) for r in activate_records(old, new).collect()}
    assert got == {"a": (1, "t", False), "b": (1, "t", False), "d": (1, "n", True), "c": (2, "again", True), "e": (3, "n", True), "z": (None, "t", True), "y": (None, "n", True)}


@pytest.mark.parametrize(
    "url, want",
    [("https://a.example/x?y", True), ("http://8.8.8.8:80/", True), ("http://172.32.0.1/", True), ("ftp://a.example", False), ("https:///x", False), ("https://u:p@a.example/", False)]
    + [(f"http://{h}/", False) for h in ("localhost", "x.localhost", "printer.local.", "127.0.0.1", "10.1.2.3", "192.168.0.9:8080", "172.16.0.1", "169.254.1.1", "0.0.0.0", "[::1]", "[fe80::1]")]
    + [(None, False)],
)
def test_public_urls(spark, url, want):
    assert spark.range(1).select(public_url(F.lit(url).cast("string"))).first()[0] is want


def record(**changes):
    own = {"name": "n", "source": "s", "url": "https://h.example/1", "quality_status": "active", "content": "body", "content_hash": digest(b"body")} | changes
    return json.dumps({k: v for k, v in own.items() if v is not ...})


CASES = [
    (record(), []),
    (record(url="https://h.example/2", tags=[], risk_score=10_000, prominence_score=1e3, description=None), []),
    (record(name="  "), ["name is no text"]),
    (record(name=...), ["name is no text"]),
    (record(source=5), ["source is no text"]),
    (record(name="n" * 501, category="c" * 201), ["name is too long", "category is too long"]),
    (record(description="a\0b"), ["description has a NUL"]),
    (record(extra=1, embedding=[1]), ["forbidden fields"]),
    (record(url="http://localhost/x"), ["url is not public"]),
    (record(quality_status=None), ["status may not be shipped"]),
    (record(risk_score=-10_001, quality_score=1.5), ["risk_score is out of range", "quality_score is out of range"]),
    (record(risk_score=True), ["risk_score is out of range"]),
    (record(provenance_score="1"), ["provenance_score is no number"]),
    (record(tags="x", triggers=["t"] * 101), ["tags is no list", "triggers has too many entries"]),
    (record(embedding_text_hash="ABC"), ["embedding_text_hash is no digest"]),
    (record(content="other"), ["content has another digest"]),
    (record(content="", content_hash=...), ["content is missing"]),
    (record(), ["duplicate url"]),
    ("[1, 2]", ["not a JSON object"]),
    ('{"name": ', ["not a JSON object"]),
    ("null", ["not a JSON object"]),
]


def test_rules(spark, tmp_path):
    lines = [(k, line) for k, (line, _) in enumerate(CASES)] + [(1000, ""), (1001, "  ")]
    df = spark.createDataFrame(lines, "line_id long, value string").repartition(3)
    assert {r["line_id"]: r["reasons"] for r in validated(df).collect()} == {k: reasons for k, (_, reasons) in enumerate(CASES)}
    good, rejected = load_with_quarantine(df, str(tmp_path / "out"))
    assert {r["line_id"] for r in good.collect()} == {k for k, (_, reasons) in enumerate(CASES) if not reasons}
    assert {r["line_id"]: r["reasons"] for r in rejected.collect()} == {k: reasons for k, (_, reasons) in enumerate(CASES) if reasons}
    assert json.loads(good.where("line_id = 0").first()["record"]) == json.loads(CASES[0][0])
    assert validated(df.where("false")).count() == 0 and len(FIELDS) == len(set(FIELDS))


def test_integrity(spark):
    names = "record_id long, path string, sha256 string, bytes long"
    h = digest(b"abc")
    expected = spark.createDataFrame([(k, "a", h, 3) for k in range(1, 8)] + [(1, "b", h, 3)], names)
    kept = [(1, "a", h, 3, b"abc"), (1, "b", h, 3, None), (2, "a", h, 3, b"abd"), (3, "a", h, 4, b"abc"), (4, "b", h, 3, b"abc"), (6, "a", h, 3, b"abc"), (6, "z", h, 3, b"abc"), (7, "a", None, 3, None), (9, "a", h, 3, b"abc")]
    files = spark.createDataFrame(kept, names + ", content binary")
    records = spark.createDataFrame([(k, "active", ["z", "a"]) for k in [*range(1, 10)]], "record_id long, status string, reasons array<string>")
    got = {r["record_id"]: tuple(r)[1:] for r in source_integrity(records, expected, files).collect()}
    assert {k for k, v in got.items() if v[2]} == {1}
    assert got[1] == ("active", ["z", "a"], True) and got[2] == ("metadata_only", ["a", "source-files-incomplete", "z"], False)
