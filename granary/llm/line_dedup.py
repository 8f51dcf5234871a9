"""Reversible incremental line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of the six ASCII white-space characters at both ends, with A-Z lower-cased; keys of
fewer than 10 code points never count. A store holds

* references: (key, doc_id), exact, once per document that holds the key;
* counts: (key, number of references, smallest and largest doc_id), exact;
* filters: one cuckoo filter per shard of keys. Keys of an insertion meet the filter of their shard first, and only what
  it may know is looked up in the counts; the rest is new for certain and only appended. Filters support deletion, so
  taking documents out undoes their insertion.

Keys are 128-bit hashes. Everything is pre-aggregated per key before it meets a shard, so a line that a third of all
documents hold is one row there. Filters stay with their shards and are never sent to all tasks. A filter that gets too
full is made again, larger, from the exact counts; when shards have grown to four times their size, there are more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, written

#: Shortest key that counts, in code points, and keys that one shard is made for.
LEAST = 10
SHARD_KEYS = 1 << 16
#: Share of a filter's slots beyond which it is made again.
LOAD = 0.85
_SLOTS = 4
_FILTERS = "shard int, table binary, full boolean"
_SPACE = b" \t\n\v\f\r"


def line_keys(text: str | None) -> Iterator[bytes | None]:
    """For each line of the text the 16-byte hash of its key, or None for a key too short to count."""
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_SPACE)
        if len(key) < LEAST or (len(key) < 4 * LEAST and len(key.decode()) < LEAST):
            yield None
        else:
            yield xxhash.xxh3_128_digest(key.lower())


class CuckooFilter:
    """A set of 64-bit keys that may say yes to a key it doesn't hold, never no to one it does.

    ``table`` holds 16-bit fingerprints, four to a bucket; 0 is free. A key lives in one of two buckets, each the other's
    exclusive-or with a hash of the fingerprint, so keys of one fingerprint that share a bucket share both. An insertion
    happens as a whole or, if the filter has no room, not at all. A filter without a table says yes to every key.
    """

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (_SLOTS * LOAD)))))
        return cls(np.zeros((buckets, _SLOTS), np.uint16))

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of these keys with room for as many again."""
        for doubled in range(6):
            f = cls.sized(2 * max(len(keys), 1024) << doubled)
            if f.insert(keys):
                return f
        return cls(np.zeros((0, _SLOTS), np.uint16))

    def _home(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys.astype(np.int64).view(np.uint64)
        mark = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint16)
        return mark, (keys & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        step = (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)
        return bucket ^ step.astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.table):
            return np.ones(len(keys), bool)
        mark, bucket = self._home(keys)
        found = (self.table[bucket] == mark[:, None]).any(1)
        return found | (self.table[self._other(mark, bucket)] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds keys that aren't in the filter yet, all at once: each round places what fits and evicts for the rest.

        False, and the filter as it was, if they don't fit.
        """
        if not len(self.table):
            return True
        keys = np.asarray(keys, np.int64)
        if np.count_nonzero(self.table) + len(keys) > LOAD * self.table.size:
            return False
        before = self.table.copy()
        mark, bucket = self._home(keys)
        rng = np.random.default_rng(len(keys))
        for turn in range(200):
            if not len(mark):
                return True
            _, one = np.unique(bucket, return_index=True)  # one newcomer per bucket and round
            free = self.table[bucket[one]] == 0
            fits = free.any(1)
            put = one[fits]
            self.table[bucket[put], free[fits].argmax(1)] = mark[put]
            full = one[~fits]
            wait = np.ones(len(mark), bool)
            wait[one] = False
            out, home = mark[full], bucket[full]
            if turn:
                slot = rng.integers(0, _SLOTS, len(full))
                out = self.table[home, slot].copy()
                self.table[home, slot] = mark[full]
            mark = np.concatenate((mark[wait], out))
            bucket = np.concatenate((bucket[wait], self._other(out, home)))
        self.table = before
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Removes keys that the filter holds, one fingerprint each."""
        if not len(self.table):
            return
        keys = np.asarray(keys, np.int64)
        mark, home = self._home(keys)
        for m, *buckets in zip(mark, home, self._other(mark, home), strict=True):
            for b in buckets:
                at = np.flatnonzero(self.table[b] == m)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def references(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id), once per key and row of docs."""

    def keys(batches):
        for batch in batches:
            ids, found = [], []
            column = batch.column(1)
            for row, doc in enumerate(batch.column(0).to_pylist()):
                if doc is not None:
                    own = {k for k in line_keys(column[row].as_py()) if k}
                    found.extend(own)
                    ids.extend([doc] * len(own))
            both = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict(
                {"k1": pa.array(both[:, 0]), "k2": pa.array(both[:, 1]), "doc_id": pa.array(ids, pa.int64())}
            )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(keys, "k1 long, k2 long, doc_id long")


def _unpacked(table: bytes) -> CuckooFilter:
    return CuckooFilter(np.frombuffer(table, np.uint16).reshape(-1, _SLOTS).copy())


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select("k1", "k2", F.pmod("k2", F.lit(shards)).cast("int").alias("shard"))


def _made(keys: DataFrame) -> DataFrame:
    """The filters of distinct keys (k1, shard)."""

    def make(key, keys: pd.DataFrame) -> pd.DataFrame:
        f = CuckooFilter.of(keys["k1"].to_numpy())
        return pd.DataFrame([{"shard": key[0], "table": f.table.tobytes(), "full": False}])

    return keys.groupBy("shard").applyInPandas(make, _FILTERS)


def _revised(filters: DataFrame, keys: DataFrame, counts: DataFrame, shards: int, delete: bool = False) -> DataFrame:
    """The filters after an insertion or deletion of the distinct keys. counts: those of the store afterwards."""

    def revise(key, held: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
        f, new = (_unpacked(held["table"][0]) if len(held) else None), keys["k1"].to_numpy()
        fits = True
        if f is None:
            f = CuckooFilter.of(new)
        elif delete:
            f.delete(new)
        else:
            fits = f.insert(new)
        return pd.DataFrame([{"shard": key[0], "table": f.table.tobytes(), "full": not fits}])

    both = filters.groupBy("shard").cogroup(_sharded(keys, shards).groupBy("shard"))
    filters = cut(both.applyInPandas(revise, _FILTERS))
    full = filters.where("full").select("shard")
    if full.isEmpty():
        return filters
    again = _sharded(counts, shards).join(full, "shard")
    return cut(filters.where("not full").unionByName(_made(again)))


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
    )


@dataclass
class LineStore:
    """The state of incremental line dedup; each table may be written and read back by the caller."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int = 1

    @classmethod
    def empty(cls, spark: SparkSession) -> LineStore:
        key = "k1 long, k2 long"
        counts = spark.createDataFrame([], f"{key}, n long, first long, last long")
        return cls(spark.createDataFrame([], f"{key}, doc_id long"), counts, spark.createDataFrame([], _FILTERS))

    @classmethod
    def build(cls, docs: DataFrame, parts: int = 2) -> LineStore:
        """A store of the documents, inserted in so many parts (by doc_id), so that later parts ask the filters of earlier ones."""
        refs, store = written(references(docs)), cls.empty(docs.sparkSession)
        part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
        for k in range(parts):
            store = store._with(refs.where(part == k))
        return store

    def maybe_known(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct keys that the filters don't rule out."""

        def probe(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(keys):
                return keys.iloc[:0][["k1", "k2"]]
            return keys.loc[_unpacked(held["table"][0]).holds(keys["k1"].to_numpy()), ["k1", "k2"]]

        both = _sharded(keys, self.shards).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return both.applyInPandas(probe, "k1 long, k2 long")

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with more documents, none of which it holds yet."""
        return self._with(written(references(docs)))

    def _with(self, refs: DataFrame) -> LineStore:
        """Only keys that the filters may know are looked up in the counts; the others are appended."""
        key, store = ["k1", "k2"], self
        new = written(_counted(refs))
        total = store.counts.count() + new.count()
        if total > 4 * store.shards * SHARD_KEYS:
            shards = total // SHARD_KEYS + 1
            store = replace(store, shards=shards, filters=cut(_made(_sharded(store.counts, shards))))
        maybe = written(store.maybe_known(new.select(key)))
        held = written(store.counts.join(maybe, key, "left_semi"))
        both = held.unionByName(new.join(held, key, "left_semi")).groupBy(key)
        both = both.agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        fresh = new.join(held, key, "left_anti")
        counts = written(store.counts.join(held, key, "left_anti").unionByName(both).unionByName(fresh))
        filters = _revised(store.filters, fresh, counts, store.shards)
        return LineStore(store.references.unionByName(refs), counts, filters, store.shards)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """The store without the documents (a column doc_id): as if they had never been inserted."""
        gone = doc_ids.select(F.col("doc_id").cast("long")).distinct()
        touched = cut(self.references.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct())
        refs = written(self.references.join(gone, "doc_id", "left_anti"))
        left = cut(_counted(refs.join(touched, ["k1", "k2"], "left_semi")))
        counts = written(self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(left))
        empty = touched.join(left, ["k1", "k2"], "left_anti")
        return LineStore(refs, counts, _revised(self.filters, empty, counts, self.shards, delete=True), self.shards)

    def dropped(self) -> DataFrame:
        """(doc_id, k1, k2) of the references to keys that a smaller doc_id holds, as the exact counts say."""
        twice = cut(self.counts.where("first < last").select("k1", "k2", "first"))
        side = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS // 2 else twice
        return self.references.join(side, ["k1", "k2"]).where("doc_id <> first").select("doc_id", "k1", "k2")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Every row of docs (documents of the store): doc_id, text, n_lines, n_dropped; text has lost its repeated lines.

        A key held by two or more documents keeps its lines in the smallest doc_id that holds it alone, all of them.
        Null text is one empty line. A null doc_id keeps all its lines.
        """

        packed = self.dropped().select("doc_id", F.concat(_bytes("k1"), _bytes("k2")).alias("key"))
        packed = packed.groupBy("doc_id").agg(F.collect_list("key").alias("drop"))
        docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

        def rebuild(batches):
            for batch in batches:
                ids, texts, drops = (batch.column(i) for i in range(3))
                out, lines, dropped = [], [], []
                for row in range(len(ids)):
                    text = texts[row].as_py() or ""
                    drop = drops[row].as_py()
                    parts = text.split("\n")
                    lines.append(len(parts))
                    if drop:
                        drop = set(drop)
                        parts = [p for p, k in zip(parts, line_keys(text), strict=True) if k is None or k not in drop]
                    out.append("\n".join(parts))
                    dropped.append(lines[-1] - len(parts))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids,
                        "text": pa.array(out, pa.string()),
                        "n_lines": pa.array(lines, pa.int64()),
                        "n_dropped": pa.array(dropped, pa.int64()),
                    }
                )

        joined = docs.join(packed, "doc_id", "left").select("doc_id", "text", "drop")
        return joined.mapInArrow(rebuild, "doc_id long, text string, n_lines long, n_dropped long")


def _bytes(column: str):
    """The eight bytes of a long, least significant first, as line_keys has them."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(column, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(8)]))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (lowercase hex of the kept text) for every row of docs.

    Null and empty texts are one empty line. Repeated doc_ids count as one document and keep their rows; rows without a
    doc_id keep all their lines. Very long texts and lines are whole. Empty tables give empty results; other columns are
    ignored.
    """

    def digest(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column(0),
                    "n_lines": batch.column(2),
                    "n_dropped": batch.column(3),
                    "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                }
            )

    rows = LineStore.build(docs).dedup(docs)
    return rows.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
