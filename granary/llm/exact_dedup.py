"""Exact dedup by deterministic block naming, with DataFrame functions only.

Texts are equal when equal after deleting the six ASCII white-space characters. A normalised text is cut into blocks of
a fixed number of code points. Blocks are sorted into integer names, adjacent pairs of names are named again, and so on
until one name is left; with the number of blocks it is the document's identity. Equal names mean equal content:

* Blocks are sorted in two steps. A 64-bit bucket groups them, and within a bucket their contents are compared; a
  block's name is its place in that order. Only buckets and places travel with the documents. Should a bucket hold
  different contents, the documents concerned are read again and told apart by content, so a collision changes nothing.
* A pair is named by its place in the order of its two integers, which needs no hashing.

Sorting is split into shards whose number follows the data. All groupings are pre-aggregated, so a block or a text that
fills a third of the corpus is one row per task; joins back to documents are plain equi-joins that AQE may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, identified, rows_that_stay, written

#: Code points in a block.
BLOCK = 2048
#: Distinct keys that one shard of a sort should hold.
SHARD_ROWS = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _blocks(text: Column, size: int) -> Column:
    """Blocks of ``size`` code points, in order; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """keys with ``name``: distinct integers in the order of the columns within each shard."""
    shards = keys.count() // SHARD_ROWS + 1
    keys = keys.withColumn("shard", F.pmod(F.xxhash64(*columns), F.lit(shards)))
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*columns)).cast("long")
    return keys.withColumn("name", place * shards + F.col("shard")).drop("shard")


def block_names(docs: DataFrame, block: int = BLOCK, bucket: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per row of docs, without its text: row, doc_id, h and g (as of identified), n_chars (of the original),
    n_blocks, name, text_sha256.

    Rows have equal (n_blocks, name) exactly when their normalised texts are equal. ``bucket`` is the first key of the
    sort of blocks; it may collide at any rate.
    """
    text = identified(docs).withColumn("row", F.monotonically_increasing_id())
    text = text.withColumn("flat", normalised(F.col("text")))
    content = text.select(F.explode(_blocks(F.col("flat"), block)).alias("block"))
    content = content.select(bucket(F.col("block")).cast("long").alias("bucket"), "block").distinct()
    buckets = cut(content.groupBy("bucket").agg(F.count("*").alias("contents")))
    shared = buckets.where("contents > 1").select("bucket")
    keys = buckets.where("contents = 1").select("bucket", F.lit(0).alias("order"))
    collided = not shared.isEmpty()
    if collided:  # contents that share a bucket are numbered in sorted order
        text = written(text)
        told = content.join(shared, "bucket")
        told = cut(told.withColumn("order", F.row_number().over(Window.partitionBy("bucket").orderBy("block"))))
        keys = keys.unionByName(told.select("bucket", "order"))
    blocks = F.transform(_blocks(F.col("flat"), block), lambda b: bucket(b).cast("long"))
    rows = cut(
        text.select(
            "row",
            "doc_id",
            "h",
            "g",
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
            F.sha2(F.encode("flat", "UTF-8"), 256).alias("text_sha256"),
            blocks.alias("buckets"),
        )
    )
    parts = rows.select("row", F.posexplode("buckets").alias("place", "bucket"), F.size("buckets").alias("n_blocks"))
    parts = parts.withColumn("order", F.lit(0))
    if collided:
        again = text.select("row", F.posexplode(_blocks(F.col("flat"), block)).alias("place", "block"))
        again = again.withColumn("bucket", bucket(F.col("block")).cast("long"))
        again = again.join(told, ["bucket", "block"]).select("row", "place", "order")
        parts = parts.drop("order").join(again, ["row", "place"], "left").withColumn("order", F.coalesce("order", F.lit(0)))
    names = cut(_named(keys, ["bucket", "order"]))
    level = cut(parts.join(names, ["bucket", "order"]).select("row", "place", "n_blocks", "name"))
    done = level.where("n_blocks <= 1").select("row", "n_blocks", "name")
    level, left = level.where("n_blocks > 1").withColumn("left", F.col("n_blocks")), True
    while left:
        even = F.col("place") % 2 == 0
        pairs = level.groupBy("row", "n_blocks", F.floor(F.col("place") / 2).alias("place")).agg(
            F.ceil(F.max("left") / 2).alias("left"),
            F.max(F.when(even, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = cut(pairs)
        names = cut(_named(cut(pairs.select("a", "b").distinct()), ["a", "b"]))
        level = cut(pairs.join(names, ["a", "b"]).select("row", "n_blocks", "place", "left", "name"))
        done = done.unionByName(level.where("left = 1").select("row", "n_blocks", "name"))
        level = level.where("left > 1")
        left = not level.isEmpty()
    out = rows.drop("buckets").join(cut(done), "row", "left")
    return out.select(
        "row",
        "doc_id",
        "h",
        "g",
        "n_chars",
        F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce("name", F.lit(0)).alias("name"),
        "text_sha256",
    )


def exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs, dropped ones too.

    Of equal texts the row with the most code points in its original text stays, then the smallest doc_id, then (for
    repeated rows) one of them. Null texts are empty texts, and those are equal to each other. A null doc_id orders
    last. Empty tables give empty results; other columns are ignored.
    """
    return _groups(docs, **options).drop("h", "g")


def _groups(docs: DataFrame, **options) -> DataFrame:
    """exact_duplicates with h and g (as of identified)."""
    rows = cut(block_names(docs, **options))
    # the smallest of (fewer code points last, doc_id, row)
    rank = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("void"), "doc_id", "row")
    groups = cut(rows.groupBy("n_blocks", "name").agg(F.min(rank).alias("first"), F.count("*").alias("group_size")))
    out = rows.join(groups, ["n_blocks", "name"])
    return out.select(
        "doc_id",
        "h",
        "g",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, without the rows that exact_duplicates drops.

    Of repeated rows one stays, whatever their doc_id; of equal texts with a null doc_id others come first. Null and empty
    texts are equal, very long ones are compared whole, columns may have any names, and an empty table stays empty.
    """
    return rows_that_stay(docs, _groups(docs).select("doc_id", "h", "g", "kept"))
