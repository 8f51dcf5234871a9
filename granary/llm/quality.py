"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation and a hashed linear scorer.

Labellers look at a whole text and vote junk or not, or abstain from texts with too few words. They overlap: most kinds
of junk are seen by two or more of them. How often each pattern of votes occurs is counted over all documents; that is
all EM needs to estimate, per labeller, how often it cries junk at good and at junk documents, and how many are junk,
with no true label. The posterior of a document's pattern is a soft label. A bounded sample of documents with soft
labels trains a logistic scorer on hashed features (shapes of three characters and binned statistics), which then scores
every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .learning import Adam, bounded_sample, sigmoid
from .text import LOWER, NOT_SPACE, text_chunks, word_hashes, words

#: Bound of the training sample in documents, size of the hashed feature space, and the score from which a row stays.
SAMPLE = 4_000
BUCKETS = 4096
THRESHOLD = 0.5

#: name, statistic, votes junk from, words below which it abstains.
LABELLERS = [
    ("symbols", 0, 0.04, 3),
    ("symbol tails", 8, 0.25, 3),
    ("capitals", 1, 0.40, 8),
    ("exclamations", 2, 0.20, 3),
    ("exclamation tails", 9, 0.15, 3),
    ("bars", 3, 0.10, 3),
    ("bar words", 10, 0.10, 3),
    ("repeats", 4, 0.20, 8),
    ("few different words", 5, 0.85, 20),
    ("longest repeated run", 6, 0.05, 40),
    ("digits", 7, 0.40, 8),
]

_KIND = np.zeros(256, np.uint8)  # 0 other
_KIND[[32, 9, 10, 11, 12, 13]] = 1
_KIND[97:123] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[128:] = 2
for _i, _c in enumerate(b"#$%&*@^~<>{}=_\\+[]"):
    _KIND[_c] = 5
_KIND[ord("!")], _KIND[ord("|")] = 6, 7
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 8


def _statistics(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(statistics of the rows, their numbers of words, kinds of the bytes, offsets) by chunk."""
    for _, _, raw, offsets in text_chunks(batch):
        kinds = _KIND[raw]

        def share(kind: int, kinds=kinds, offsets=offsets) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(kinds == kind, dtype=np.int64)))
            return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)

        starts, ends, first = words(raw, offsets, NOT_SPACE)
        h = word_hashes(LOWER[raw], starts, ends)
        n = np.diff(first).astype(np.float64)
        same = np.zeros(len(h) + 1, np.int64)
        same[1:-1] = h[1:] == h[:-1]
        same[first[:-1]] = 0
        total = np.concatenate(([0], np.cumsum(same)))
        repeats = total[first[1:]] - total[first[:-1]]
        different, longest = np.zeros(len(n)), np.zeros(len(n))
        for i in range(len(n)):
            own = h[first[i] : first[i + 1]]
            if len(own):
                different[i] = len(np.unique(own))
                gaps = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
                longest[i] = np.diff(gaps).max() - 1
        size, some = np.maximum(1, np.diff(offsets)), np.maximum(1, n)

        def words_with(kind: int, at: np.ndarray, kinds=kinds, first=first, some=some) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(kinds[at] == kind)))
            return (total[first[1:]] - total[first[:-1]]) / some

        letters = np.maximum(1, share(2) + share(3))
        stats = np.stack(
            [
                share(5) / size,
                share(3) / letters,
                share(6) / some,
                share(7) / some,
                repeats / some,
                1 - different / some,
                longest / some,
                share(4) / size,
                words_with(5, ends - 1),
                words_with(6, ends - 1),
                words_with(7, starts),
            ],
            1,
        )
        yield stats, n, kinds, offsets


def _votes(stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Vote patterns as base-3 numbers: 0 abstained, 1 not junk, 2 junk, the first labeller lowest."""
    pattern = np.zeros(len(n), np.int64)
    for i, (_, at, junk, least) in enumerate(LABELLERS):
        pattern += np.where(n >= least, np.where(stats[:, at] >= junk, 2, 1), 0) * 3**i
    return pattern


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, n): how often each pattern of votes occurs in all documents; at most 3 to the number of labellers."""

    def count(batches):
        for batch in batches:
            found = [_votes(stats, n) for stats, n, _, _ in _statistics(batch)]
            values, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(values), "n": pa.array(n.astype(np.int64))})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "pattern long, n long")
    return rows.groupBy("pattern").agg(F.sum("n").alias("n"))


def estimate(patterns: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: (posterior of good by pattern, P(junk vote | class) as (labeller, class), share of good).

    Starts from the guess that any junk vote means junk. Labellers count as independent within a class, and abstaining
    says nothing.
    """
    votes = (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    good = np.where((votes == 2).any(1), 0.1, 0.95)
    rates, share = np.full((len(LABELLERS), 2), 0.5), 0.5
    for _ in range(rounds):
        weight = np.stack([n * good, n * (1 - good)])
        share = float((weight[0].sum() + 1) / (n.sum() + 2))
        junk, not_junk = ((votes == v).T.astype(np.float64) @ weight.T for v in (2, 1))
        rates = (junk + [0.02, 0.5]) / (junk + not_junk + 1)
        logs = (votes == 2) @ np.log(rates) + (votes == 1) @ np.log1p(-rates) + np.log([share, 1 - share])
        good = sigmoid(logs[:, 0] - logs[:, 1])
    return good, rates, share


def _features(kinds: np.ndarray, stats: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hashed feature vector of one text."""
    x = np.zeros(BUCKETS, np.float32)
    if len(kinds) >= 3:
        shape = kinds[:-2].astype(np.int64) * 81 + kinds[1:-1].astype(np.int64) * 9 + kinds[2:]
        counts = np.bincount(shape, minlength=729)
        x[(np.arange(729) * 2654435761 >> 7) % (BUCKETS // 2)] += np.sqrt(counts / counts.sum())
    bins = np.minimum(15, (stats * 20).astype(np.int64))
    at = ((np.arange(len(stats)) * 16 + bins + 1) * 2654435761 >> 5) % (BUCKETS // 2)
    x[BUCKETS // 2 + at] += 0.5 if n >= 8 else 0.0
    return x


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(vote pattern, features) for each row."""
    for stats, n, kinds, offsets in _statistics(batch):
        patterns = _votes(stats, n)
        for i in range(len(n)):
            yield int(patterns[i]), _features(kinds[offsets[i] : offsets[i + 1]], stats[i], n[i])


def train(docs: DataFrame) -> tuple[np.ndarray, float]:
    """(weights, bias) of the scorer; with no documents, one that keeps everything."""
    counts = vote_patterns(docs).collect()
    patterns, n = np.array([r["pattern"] for r in counts], np.int64), np.array([r["n"] for r in counts], np.float64)
    if not len(n):
        return np.zeros(BUCKETS, np.float32), 1.0
    order = np.argsort(patterns)
    patterns, n = patterns[order], n[order]
    good = estimate(patterns, n)[0]

    def read(batches):
        for batch in batches:
            found = list(_rows(batch))
            yield pa.RecordBatch.from_pydict(
                {
                    "pattern": pa.array([p for p, _ in found], pa.int64()),
                    "at": pa.array([np.flatnonzero(x).astype(np.int16).tobytes() for _, x in found], pa.binary()),
                    "x": pa.array([x[x != 0].tobytes() for _, x in found], pa.binary()),
                }
            )

    sample = bounded_sample(docs.select("doc_id", "text"), SAMPLE).select(F.col("text").cast("string"))
    rows = sorted(sample.mapInArrow(read, "pattern long, at binary, x binary").collect(), key=lambda r: (r["pattern"], r["x"]))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(bytes(r["at"]), np.int16)] = np.frombuffer(bytes(r["x"]), np.float32)
    y = good[np.searchsorted(patterns, [r["pattern"] for r in rows])].astype(np.float32)
    used = np.flatnonzero((x != 0).any(0))
    x = x[:, used]
    w, b = np.zeros(len(used), np.float32), np.array([1.0], np.float32)
    adam = Adam([w, b], 0.1)
    for _ in range(300):
        d = (sigmoid(x @ w + b) - y) / max(1, len(y))
        adam.step([x.T @ d + 1e-5 * w, d.sum(keepdims=True)])
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = w
    return weights, float(b[0])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1, higher is better) and keep (score of THRESHOLD or more) for every row of docs."""
    weights, bias = model

    def score(batches):
        for batch in batches:
            z = np.array([float(x @ weights) + bias for _, x in _rows(batch)], np.float64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(sigmoid(z))})

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.withColumn("keep", F.col("score") >= THRESHOLD)


def quality(docs: DataFrame) -> DataFrame:
    """score_quality with a model made from the same documents.

    Labellers abstain on empty, null and very short texts, which are kept. Repeated rows and rows without doc_id are
    scored each, equal texts alike; very long texts are read whole; empty tables give empty results; other columns are
    ignored.
    """
    return score_quality(docs, train(docs))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """docs, with all its columns, without the rows whose text the classifier rejects.

    Decided row by row from the text: null and repeated doc_ids, repeated rows and columns of any name change nothing;
    null, empty and very short texts stay, very long ones are judged whole, an empty table stays empty.
    """
    ready(docs.sparkSession)
    weights, bias = train(docs)
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["text"])
            z = np.array([float(x @ weights) + bias for _, x in _rows(texts)], np.float64)
            yield batch.filter(pa.array(sigmoid(z) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)
