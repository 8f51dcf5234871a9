"""Retrieval records: the compact text that a document is found by, and its identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

# Characters of a record and of a code fence in it, tags that count, and the version that is part of its identity.
MOST_CHARS, FENCE_CHARS, MOST_TAGS = 1500, 300, 12
VERSION = "entrypoint-flat-1500-v1"
_FRONT = r"\A\ufeff?---[ \t]*\r?\n(?s:.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def _one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def prose(content: Column) -> Column:
    """A markdown text on one line: no front matter, images or tags, links as their text, code fences by their beginning."""
    out = F.regexp_replace(F.coalesce(content, F.lit("")), _FRONT, " ")
    out = F.regexp_replace(F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"<[^>]{1,300}>", " ")
    # possessive, so that a long fence takes no stack
    inside = r"(?:[^`]|`(?!``))"
    return _one_line(F.regexp_replace(out, rf"```[^\n]*\n({inside}{{0,{FENCE_CHARS}}}+){inside}*+```", " $1 "))


def retrieval_record(name: Column, description: Column, tags: Column, summary: Column, content: Column, package_hash: Column, entrypoint: Column) -> Column:
    """struct(text, text_hash, record_hash): what a document is found by, in MOST_CHARS characters, and what identifies it: the
    text, its package and its entry point. Empty names of these two count as null."""

    def own(c: Column) -> Column:
        return strip(F.coalesce(c, F.lit("")))

    labels = F.array_join(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, MOST_TAGS), " ")
    parts = F.filter(F.array(own(name), own(description), labels, own(summary), prose(content)), lambda p: p != "")
    text = F.rtrim(F.substring(_one_line(F.array_join(parts, ". ")), 1, MOST_CHARS))
    text_hash = F.sha2(F.encode(text, "UTF-8"), 256)
    identity = F.struct(
        F.when(entrypoint != "", entrypoint).alias("entrypoint"),
        F.when(package_hash != "", package_hash).alias("package_hash"),
        text_hash.alias("text_hash"),
        F.lit(VERSION).alias("version"),
    )
    record_hash = F.sha2(F.to_json(identity, {"ignoreNullFields": "false"}), 256)
    return F.struct(text.alias("text"), text_hash.alias("text_hash"), record_hash.alias("record_hash"))


def retrieval_text(name: Column, description: Column, content: Column) -> Column:
    """Name, description and the content without markdown's marks, in MOST_CHARS characters."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), _FRONT, " ")
    body = _one_line(F.regexp_replace(body, "[`*_>#]", " "))
    parts = F.filter(F.array(*[F.coalesce(c, F.lit("")) for c in (name, description)], body), lambda p: p != "")
    return F.substring(strip(F.array_join(parts, " ")), 1, MOST_CHARS)


def embedding_parity(rows: DataFrame, group: str) -> DataFrame:
    """(group, total, matched, mismatched, missing, parity, first_mismatch) of rows (id, text, stored): whether the stored hash
    is that of the text. A row without either is missing; only a group whose rows all match is at parity."""
    have = (F.coalesce("text", F.lit("")) != "") & (F.coalesce("stored", F.lit("")) != "")
    same = F.sha1(F.encode("text", "UTF-8")) == F.col("stored")
    out = rows.groupBy(group).agg(
        F.count("*").alias("total"),
        F.count_if(have & same).alias("matched"),
        F.count_if(have & ~same).alias("mismatched"),
        F.count_if(~have).alias("missing"),
        F.min(F.when(have & ~same, F.col("id"))).alias("first_mismatch"),
    )
    return out.withColumn("parity", F.col("matched") == F.col("total"))
