"""A stored inverted index: postings in shards of terms and blocks of documents, and fielded BM25 over it.

A task turns each run of documents it reads into one block and writes a row per term of the block: the documents that hold
it, their weighted frequencies and sizes, and the two extremes from which the block's best weight follows. Blocks make a hot
term many rows. Rows are dealt to shards by term, so a search reads only the shards of its terms; adding documents
writes one more segment and touches no other.

A search first reads what bounds the blocks, without the postings themselves: a few blocks with the best bounds give each
query a k-th score, and blocks that cannot reach it are never read. The result is exact.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.stemmer import stem
from ..functions.text import NAME_STOPWORDS
from .common import cut, sized, spread, top_per_group

K1, B = 1.2, 0.75
#: The least weight that a term has, however frequent it is.
LEAST_IDF = 1e-6
#: Terms that a query keeps, in the order of its text, and the shortest that it asks for.
QUERY_TERMS, SHORTEST = 12, 3
#: Shards of terms; documents and postings of a block; blocks of a query that give its k-th score.
SHARDS, BLOCK_DOCS, BLOCK_WORDS, PROBES = 64, 4096, 1 << 20, 2

# Words that a query asks for only if it has no others, besides those of names.
QUERY_STOPWORDS = [
    "about", "after", "also", "and", "are", "can", "could", "create", "does", "for", "from", "have", "help", "into", "make", "need", "please",
    "should", "that", "the", "this", "using", "want", "with", "would", "you", "your",
]
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def _words(text: str | None) -> list[str]:
    """All words of a text: letters and digits of any script, lower-cased, without accents."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFD", text)
        text = text.translate({ord(c): None for c in set(text) if unicodedata.category(c)[0] == "M"})
    return _WORD.findall(text.lower())


def terms(text: str | None) -> list[str]:
    """Stems of all words of a text."""
    return [stem(w) for w in _words(text)]


class _Block:
    """Postings of documents in the order of reading, as flat lists; ``codes`` numbers the terms."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.posted, self.freqs, self.docs, self.sizes, self.spans = [], [], [], [], []

    def add(self, doc_id: int, counts: dict[str, float], size: int) -> None:
        codes = self.codes
        self.posted += [codes.setdefault(term, len(codes)) for term in counts]
        self.freqs += counts.values()
        self.docs.append(doc_id)
        self.sizes.append(size)
        self.spans.append(len(counts))

    def full(self) -> bool:
        return len(self.docs) >= BLOCK_DOCS or len(self.posted) >= BLOCK_WORDS

    def rows(self, number: str) -> Iterator[pa.RecordBatch]:
        code = np.array(self.posted, np.int64)
        order = np.argsort(code, kind="stable")
        n = np.bincount(code, minlength=len(self.codes))
        starts = np.append(0, np.cumsum(n))
        docs, sizes = (np.repeat(np.array(x, np.int64), self.spans)[order] for x in (self.docs, self.sizes))
        freqs = np.array(self.freqs, np.float64)[order]
        if len(n):
            lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x)) for x in (docs, freqs, sizes)]
            most, least = np.maximum.reduceat(freqs, starts[:-1]), np.minimum.reduceat(sizes, starts[:-1])
            blocks = pa.array([number] * len(n), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(self.codes, pa.string()), blocks, *lists, pa.array(n), pa.array(most), pa.array(least)], _COLUMNS)
        none = [pa.nulls(1, pa.list_(t)) for t in (pa.int64(), pa.float64(), pa.int64())]
        whole = [pa.array([len(self.docs)], pa.int64()), pa.array([float(sum(self.sizes))]), pa.array([0], pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), *none, *whole], _COLUMNS)


def _block_rows(batches: Iterator[pa.RecordBatch], weights: list[float], segment: str) -> Iterator[pa.RecordBatch]:
    """(term, block, docs, freqs, sizes, n, most, least) of blocks, and for each block a row without term with n documents and
    the sum of their sizes in ``most``. A document's words are counted before they are stemmed."""
    task, blocks, block = TaskContext.get().partitionId(), 0, _Block()
    for batch in batches:
        ids = batch.column(0).to_pylist()
        columns = [c.to_pylist() for c in batch.columns[1:]]
        for k, doc_id in enumerate(ids):
            counts: dict[str, float] = {}
            size = 0
            for weight, column in zip(weights, columns, strict=True):
                own: dict[str, int] = {}
                for word, n in Counter(_words(column[k])).items():
                    term = stem(word)
                    own[term] = own.get(term, 0) + n
                    size += n
                for term, n in own.items():
                    counts[term] = counts.get(term, 0.0) + weight * n
            block.add(doc_id, counts, size)
            if block.full():
                yield from block.rows(f"{segment}-{task}-{blocks}")
                block, blocks = _Block(), blocks + 1
    if block.docs:
        yield from block.rows(f"{segment}-{task}-{blocks}")


_COLUMNS = ["term", "block", "docs", "freqs", "sizes", "n", "most", "least"]
_BLOCK = "term string, block string, docs array<long>, freqs array<double>, sizes array<long>, n long, most double, least long"


class LexicalIndex:
    """The index in a folder that all executors share. ``fields`` are text columns and their weights, the same in all segments."""

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, float], shards: int = SHARDS):
        self.spark, self.folder, self.fields, self.shards = spark, folder.rstrip("/"), fields, shards

    def add(self, docs: DataFrame) -> None:
        """A new segment with documents (doc_id and the fields). A document must not be added twice; null fields are empty,
        and a null doc_id is refused."""
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.raise_error(F.lit("a document without doc_id"))).alias("doc_id"), *[F.col(f).cast("string") for f in self.fields])
        weights, segment = list(self.fields.values()), uuid.uuid4().hex
        found = spread(rows).mapInArrow(lambda batches: _block_rows(batches, weights, segment), _BLOCK)
        shard = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.shards)))
        found = found.withColumn("shard", shard.cast("int")).repartition("shard", F.pmod(F.xxhash64("block"), F.lit(8)))
        found.sortWithinPartitions("shard", "term").write.partitionBy("shard").mode("append").parquet(self.folder)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(_BLOCK + ", shard int").parquet(self.folder)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, times) of queries (query_id, text): their first meaningful words, or words if none is meaningful."""

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stop = {*QUERY_STOPWORDS, *NAME_STOPWORDS}
            for batch in batches:
                rows = []
                for query_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = [w for w in regex.findall("[a-z0-9]+", (text or "").lower()) if len(w) >= SHORTEST]
                    own = [w for w in own if w not in stop] or own
                    rows += [(query_id, t, n) for t, n in Counter(map(stem, own[:QUERY_TERMS])).items()]
                ids, own, times = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids, pa.int64()), "term": pa.array(own, pa.string()), "times": pa.array(times, pa.int64())})

        rows = queries.select(F.col("query_id").cast("long"), F.col("text").cast("string"))
        return rows.mapInArrow(ask, "query_id long, term string, times long")

    def postings_of(self, asked: DataFrame) -> DataFrame:
        """Rows of the index for asked terms; only the shards of these terms are read."""
        wanted = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(self.shards)).cast("int")).distinct().collect()]
        return self._read().where(F.col("shard").isin(wanted) if wanted else F.lit(False))

    def topk(self, queries: DataFrame, k: int = 10, probes: int = PROBES, k1: float = K1, b: float = B) -> DataFrame:
        """(query_id, doc_id, score, position): the k best documents of each query (query_id, text) by fielded BM25.

        A field's words count as often as its weight says; ties go to the larger doc_id. Null and empty queries find nothing.
        """
        asked = sized(self._asked(queries))
        total = self._read().where("shard = -1").agg(F.sum("n").alias("n"), F.sum("most").alias("size")).first()
        documents, mean = total["n"] or 0, (total["size"] or 0.0) / max(1, total["n"] or 0) or 1.0

        def part(f: Column, size: Column) -> Column:
            return f * (k1 + 1) / (f + k1 * (1 - b + b * size / mean))

        postings = self.postings_of(asked)
        frequency = postings.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.greatest(F.log((documents - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        weighted = sized(asked.join(frequency, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")))
        # without the postings themselves
        bound = F.sum(F.col("weight") * part(F.col("most"), F.col("least").cast("double")))
        bounds = cut(postings.join(weighted, "term").groupBy("query_id", "block").agg(bound.alias("bound")))

        def scored(blocks: DataFrame) -> DataFrame:
            held = F.explode(F.arrays_zip("docs", "freqs", "sizes"))
            rows = postings.join(weighted, "term").join(blocks, ["query_id", "block"]).select("query_id", "weight", held.alias("p"))
            score = F.sum(F.col("weight") * part(F.col("p.freqs"), F.col("p.sizes")))
            return rows.groupBy("query_id", F.col("p.docs").alias("doc_id")).agg(score.alias("score"))

        by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        probed = bounds.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= probes)
        best = top_per_group(scored(sized(probed.select("query_id", "block"))), ["query_id"], [F.desc("score")], k)
        least = best.where(F.col("position") == k).select("query_id", F.col("score").alias("least"))
        # sums of floats in another order may differ in their last digits
        open_ = bounds.join(least, "query_id", "left").where("least is null or bound >= least - 1e-6 * (1 + abs(least))")
        found = scored(sized(open_.select("query_id", "block"))).withColumn("score", F.round("score", 6))
        return top_per_group(found, ["query_id"], [F.desc("score"), F.desc("doc_id")], k)

