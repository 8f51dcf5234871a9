"""Benchmark decontamination with a distributed positional inverted index.

The index is stored in shards of about SHARD_WORDS words of training documents. A shard holds, for every test term that
some window picked, the sorted list of the places where its documents have it. Windows are looked up from their rarest
terms: occurrences of all test terms are counted over all documents, each window picks its three rarest places, and in
every shard the list of the rarest is shifted by the distance to the second and to the third and intersected with
theirs. A window can only occur where all three agree; with a slop, places may be off by some words (proximity).
All words of a document are in one shard, so nothing but the texts found and their items leave a task. Texts are read again
for these alone, and their windows are compared with the items' word by word, so phrase results are exact whatever the
hashes do. Windows of an item that differ by a shift alone are one lookup, and a text's windows are hashed once for all
its items, so texts and items of one repeated word take time in proportion to their length.

The benchmark is worked off in blocks of a bounded number of words, each of which reads the documents; only a block's
terms, windows and words go to the tasks. Texts are known by two hashes of their content, so rows without a doc_id,
repeated doc_ids and repeated rows are no special cases.

Words are runs of a-z, 0-9 and non-ASCII characters of the text with A-Z lower-cased. A window is 10 consecutive words of
an item; an item of fewer words is one window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, identified, semi_join_sized, written
from .text import LOWER, WORD, text_chunks, word_hashes, words

WINDOW = 10
#: Places of a window whose postings must agree.
RAREST = 3
#: Words of benchmark items in a block (about 100 bytes each go to every task), and of documents in a shard of the index.
BLOCK_WORDS = 1_000_000
SHARD_WORDS = 1_000_000
#: Alignments that a task tests at once.
SLAB = 2_000_000

_UPPER = {c: c + 32 for c in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_INDEX = "doc_ids array<long>, h array<long>, g array<int>, first array<long>, terms binary, starts binary, places binary"
_FOUND = "h long, g int, item long, at long"


def word_list(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def _terms(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, index of each row's first word, word hashes) by chunk."""
    for row, _, raw, offsets in text_chunks(batch, column):
        data = LOWER[raw]
        starts, ends, first = words(data, offsets, WORD)
        yield row, first, word_hashes(data, starts, ends).view(np.int64)


class _Terms:
    """A set of terms, tested by a small table first."""

    def __init__(self, terms: np.ndarray):
        self.terms, self.table = np.sort(terms), np.zeros(1 << 22, bool)
        self.table[self.terms & ((1 << 22) - 1)] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """Indexes of the hashes that are in the set."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[h & ((1 << 22) - 1)])
        near = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        return at[self.terms[near] == h[at]]


def benchmark_terms(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, terms, block): the words of each item and their hashes; items without words are left out.

    Rows that share an item_id are separate items of the same name; an item without item_id is searched for, nameless.
    """

    def split(batches):
        for batch in batches:
            hashes = []
            for _, first, h in _terms(batch, "text"):
                hashes += [h[first[i] : first[i + 1]] for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_pydict(
                {
                    "item_id": batch.column(0),
                    "words": pa.array([word_list(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string())),
                    "terms": pa.array(hashes, pa.list_(pa.int64())),
                }
            )

    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    rows = rows.mapInArrow(split, "item_id string, words array<string>, terms array<long>")
    items = cut(rows.where("size(words) > 0").withColumn("item", F.monotonically_increasing_id()))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    return items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(total // BLOCK_WORDS + 1)))


def term_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The terms that occur, sorted, with their occurrences over all documents. terms: those of a block."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches):
        wanted = _Terms(sent.value)
        for batch in batches:
            found = [h[wanted.among(h)] for _, _, h in _terms(batch, "text")]
            values, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"term": pa.array(values), "n": pa.array(n.astype(np.int64))})

    rows = docs.select("text").mapInArrow(count, "term long, n long")
    counts = rows.groupBy("term").agg(F.sum("n").alias("n")).toPandas().sort_values("term")
    return counts["term"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)


def _picks(items: DataFrame, counts: tuple[np.ndarray, np.ndarray], window: int, phrase: bool) -> np.ndarray:
    """Rows of item and three times (place in the item, term), rarest first: what the windows of a block pick.

    A window with a word that no document has cannot occur; for proximity it goes by the words that occur.
    """
    terms, n = counts

    def pick(batches):
        for batch in batches:
            rows = {}
            for item, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.array(own, np.int64)
                at = np.minimum(np.searchsorted(terms, own), max(0, len(terms) - 1))
                often = np.where(terms[at] == own, n[at], 0) if len(terms) else np.zeros(len(own), np.int64)
                size = min(window, len(own))
                for start in range(len(own) - size + 1):
                    part = often[start : start + size]
                    order = np.argsort(part, kind="stable")
                    if not phrase:
                        order = order[part[order] > 0]
                    if len(order) >= min(RAREST, size) and part[order[0]]:
                        chosen = [start + int(order[min(k, len(order) - 1)]) for k in range(RAREST)]
                        # windows of the same terms at the same distances agree at the same places: the last one stands for all
                        rows[item, *(x for p in chosen for x in (p - chosen[0], int(own[p])))] = chosen[0]
            flat = np.array([(k[0], *(x + place if i % 2 == 0 else x for i, x in enumerate(k[1:]))) for k, place in rows.items()], np.int64)
            flat = flat.reshape(-1, 1 + 2 * RAREST)
            yield pa.RecordBatch.from_pydict({"pick": pa.array([r.tobytes() for r in flat], pa.binary())})

    found = items.select("item", "terms").mapInArrow(pick, "pick binary").toPandas()["pick"]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 1 + 2 * RAREST)


def positional_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The stored index, a row per shard: its documents with their first word's place, and the places of each term.

    docs: as of identified(). terms: those that windows of a block picked. Every row of docs is in one shard.
    """
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def shard(docs: list, lengths: list, found: list) -> pa.RecordBatch:
        first = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        term, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, term))
        term, place = term[order], place[order]
        new = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        columns = [pa.concat_arrays([d.column(i) for d in docs]) for i in range(3)]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays(
            [
                *whole,
                pa.array([first], pa.list_(pa.int64())),
                *(pa.array([x.tobytes()], pa.binary()) for x in (term[new], np.append(new, len(term)), place)),
            ],
            names=["doc_ids", "h", "g", "first", "terms", "starts", "places"],
        )

    def store(batches):
        wanted = _Terms(sent.value)
        docs, lengths, found, held = [], [], [], 0
        for batch in batches:
            for row, first, h in _terms(batch, "text"):
                at = wanted.among(h)
                docs.append(batch.select([0, 1, 2]).slice(row, len(first) - 1))
                lengths.append(np.diff(first))
                found.append((h[at], at + held))
                held += len(h)
                if held >= SHARD_WORDS:
                    yield shard(docs, lengths, found)
                    docs, lengths, found, held = [], [], [], 0
        if docs:
            yield shard(docs, lengths, found)

    return written(docs.mapInArrow(store, _INDEX))


def _firsts(doc: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Columns of (doc, item, at): each pair of a document and an item once, with its first place."""
    order = np.lexsort((at, item, doc))
    doc, item, at = doc[order], item[order], at[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))[: len(doc)]
    return np.stack((doc[new], item[new], at[new]))


def _intersected(index: DataFrame, picks: np.ndarray, slop: int = 0) -> DataFrame:
    """(h, g, item, at): texts, items of which some picked terms agree in them within ``slop`` words, and the first place
    where the item would then begin."""
    sent = index.sparkSession.sparkContext.broadcast(picks)

    def listed(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
        return at, terms[at] == wanted

    def meet(batches):
        picks = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                first, (terms, starts, places) = (
                    batch.column(0)[row].values.to_numpy(),
                    (np.frombuffer(batch.column(i)[row].as_py(), np.int64) for i in (1, 2, 3)),
                )
                if not len(terms) or not len(picks):
                    continue
                width = int(first[-1]) + 1
                lists = np.repeat(np.arange(len(terms)), np.diff(starts)) * width + places
                (one, has), (two, has2), (three, has3) = (listed(terms, picks[:, k]) for k in (2, 4, 6))
                usable = np.flatnonzero(has & has2 & has3)
                counts = starts[one[usable] + 1] - starts[one[usable]]
                ends = np.cumsum(counts)
                out = []
                begin = 0
                while begin < len(usable):
                    end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SLAB, "right")))
                    use, n = usable[begin:end], counts[begin:end]
                    own = np.repeat(use, n)
                    slots = np.repeat(starts[one[use]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    place = places[slots]
                    for at, other in ((3, two), (5, three)):
                        want = place + picks[own, at] - picks[own, 1]
                        low, high = np.clip(want - slop, 0, width - 1), np.clip(want + slop, 0, width - 1)
                        key = other[own] * width
                        near = np.minimum(np.searchsorted(lists, key + low), len(lists) - 1)
                        fits = (lists[near] >= key + low) & (lists[near] <= key + high)
                        own, place = own[fits], place[fits]
                    if len(own):
                        doc = np.searchsorted(first, place, "right") - 1
                        out.append(_firsts(doc, picks[own, 0], place - first[doc] - picks[own, 1]))
                    begin = end
                if out:
                    doc, item, at = _firsts(*np.concatenate(out, axis=1))
                    h, g = (batch.column(i)[row].values.take(pa.array(doc)) for i in (4, 5))
                    yield pa.RecordBatch.from_pydict({"h": h, "g": g, "item": pa.array(item), "at": pa.array(at)})

    rows = index.select("first", "terms", "starts", "places", "h", "g")
    return rows.mapInArrow(meet, _FOUND)


def _alignments(docs: DataFrame, items: DataFrame, window: int, slop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index of the documents for a block of items, and the distinct (h, g, item, at) found in it."""
    terms = items.select(F.explode("terms").alias("term")).distinct().toPandas()["term"].to_numpy(np.int64)
    picks = _picks(items, term_counts(docs, terms), window, slop is None)
    index = positional_index(docs, np.unique(picks[:, 2::2]))
    return index, cut(_intersected(index, picks, slop or 0).distinct())


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5) -> DataFrame:
    """(doc_id, item_id, at): where a window's three rarest words of those that occur lie within ``slop`` words of their places.

    ``at`` is where the item would begin. Windows of which fewer words occur match nothing. Repeated texts match each.
    """
    docs, items, out = identified(docs), benchmark_terms(benchmark), []
    for block in _blocks(items):
        index, found = _alignments(docs, block, WINDOW, slop)
        rows = index.select(F.explode(F.arrays_zip("doc_ids", "h", "g")).alias("d")).select("d.doc_ids", "d.h", "d.g")
        found = found.join(block.select("item", "item_id"), "item").groupBy("h", "g", "item_id").agg(F.min("at").alias("at"))
        out.append(rows.join(found, ["h", "g"]).select(F.col("doc_ids").alias("doc_id"), "item_id", "at"))
    return reduce(DataFrame.unionByName, out)


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items by block; one empty block if there are none."""
    numbers = [r["block"] for r in items.select("block").distinct().collect()] or [0]
    return [items.where(F.col("block") == n) for n in sorted(numbers)]


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for i in range(size if len(out) else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)].view(np.uint64)
    return out


class _Windows:
    """The windows of an item: their hashes, and the windows themselves."""

    def __init__(self, name: str | None, own: list[str], terms: list[int], window: int):
        self.name, self.size = name, min(window, len(own))
        self.hashes = np.unique(_rolled(np.array(terms, np.int64), self.size))
        self.whole = {tuple(own[i : i + self.size]) for i in range(len(own) - self.size + 1)}

    def starts(self, own: list[str], rolled: np.ndarray) -> np.ndarray:
        """Where the windows occur among words whose ``size`` consecutive hashes are these, in order."""
        near = np.minimum(np.searchsorted(self.hashes, rolled), len(self.hashes) - 1)
        maybe = np.flatnonzero(self.hashes[near] == rolled).tolist()
        return np.array([i for i in maybe if tuple(own[i : i + self.size]) in self.whole], np.int64)


def _united(starts: list[np.ndarray], sizes: list[int]) -> list[dict]:
    """The spans of words that windows at these starts cover, apart and in order."""
    size = np.repeat(np.array(sizes, np.int64), [len(x) for x in starts])
    start = np.concatenate(starts)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate((start + size)[order])
    new = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(start[new], end[np.append(new[1:], len(end)) - 1], strict=True)]


def _spans(docs: DataFrame, found: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(h, g, spans, items): the texts with windows of these items, the words that they cover and the items' names."""
    rows = items.select("item", "item_id", "words", "terms").collect()
    sent = docs.sparkSession.sparkContext.broadcast({r["item"]: (r["item_id"], r["words"], r["terms"]) for r in rows})
    texts = semi_join_sized(docs.select("h", "g", "text"), cut(found.select("h", "g").distinct()), ["h", "g"])
    texts = texts.groupBy("h", "g").agg(F.first("text").alias("text"))
    asked = found.groupBy("h", "g").agg(F.collect_list("item").alias("asked"))  # at most the items of a block

    def compare(batches):
        known: dict[int, _Windows] = {}
        for batch in batches:
            out = {name: [] for name in ("h", "g", "spans", "items")}
            for row, first, hashes in _terms(batch, "text"):
                for i in range(len(first) - 1):
                    own, h, rolled = word_list(batch.column(2)[row + i].as_py()), hashes[first[i] : first[i + 1]], {}
                    hit, starts = [], []
                    for number in batch.column(3)[row + i].as_py():
                        if number not in known:
                            known[number] = _Windows(*sent.value[number], window)
                        item = known[number]
                        if item.size not in rolled:
                            rolled[item.size] = _rolled(h, item.size)
                        at = item.starts(own, rolled[item.size])
                        if len(at):
                            hit.append(item)
                            starts.append(at)
                    if hit:
                        out["h"].append(batch.column(0)[row + i].as_py())
                        out["g"].append(batch.column(1)[row + i].as_py())
                        out["spans"].append(_united(starts, [x.size for x in hit]))
                        out["items"].append([x.name for x in hit if x.name is not None])
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))

    both = texts.join(asked, ["h", "g"]).select("h", "g", "text", "asked")
    return both.mapInArrow(compare, "h long, g int, spans array<struct<start:long,end:long>>, items array<string>")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The index of the documents (of the first block), and (h, g, n_hit, n_items, items_sha256) of the texts with occurring
    windows: words inside them, and the number and digest of the names of their items."""
    items, spans, indexes = benchmark_terms(benchmark), [], []
    for block in _blocks(items):
        index, found = _alignments(docs, block, window)
        indexes.append(index)
        spans.append(_spans(docs, found, block, window))
    # a text has a row per block of items
    texts = reduce(DataFrame.unionByName, spans).groupBy("h", "g").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # overlapping spans count once: in order, what lies beyond the furthest end so far
    none = F.lit(0).cast("long")
    merged = F.aggregate(
        "spans",
        F.struct(none.alias("n"), none.alias("end")),
        lambda x, s: F.struct(
            (x["n"] + F.greatest(none, s["end"] - F.greatest(s["start"], x["end"]))).alias("n"),
            F.greatest(x["end"], s["end"]).alias("end"),
        ),
    )
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return indexes[0], cut(texts.select("h", "g", merged["n"].alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every row of docs: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0).

    A document word is hit inside any occurrence of a window of the benchmark. items_sha256 is the lowercase hex digest
    of the item_ids with occurring windows, sorted as strings and comma-joined; an item without item_id hits words and is
    not named. Null, empty and blank texts have no words. Rows with a null or repeated doc_id have the figures of their
    own text. Very long texts are whole documents of a shard. An empty benchmark hits nothing, empty docs give an empty
    result, and other columns are ignored.
    """
    index, hits = contaminated_texts(identified(docs), benchmark, window)
    sizes = F.transform(F.sequence(F.lit(1), F.size("first") - 1), lambda i: F.element_at("first", i + 1) - F.element_at("first", i))
    rows = index.select(F.explode(F.arrays_zip("doc_ids", "h", "g", sizes.alias("n"))).alias("d"))
    rows = rows.select(F.col("d.doc_ids").alias("doc_id"), "d.h", "d.g", F.col("d.n").alias("n_words"))
    side = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS // 20 else hits
    rows = rows.join(side, ["h", "g"], "left")
    none = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", none)
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, with all its columns, without the rows whose text holds a window of the benchmark.

    Decided by text alone: null and repeated doc_ids and columns of any name change nothing, a null, empty or blank text
    stays, and an empty table stays empty.
    """
    _, hits = contaminated_texts(identified(docs), benchmark, window)
    hits = hits.select("h", "g")
    side = F.broadcast(hits) if hits.count() <= BROADCAST_ROWS else hits
    text = docs["text"].cast("string")
    return docs.join(side, (F.xxhash64(text) == side["h"]) & (F.hash(text) == side["g"]), "left_anti")
