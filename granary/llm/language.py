"""Language ID by a byte convolutional network trained in numpy.

A text is cut into windows of a fixed number of bytes, the last padded with spaces. Filters of several widths slide over
the bytes of a window, each filter's largest response over the window is kept, and a softmax layer names the language. A
document's probabilities are those of its windows, averaged in logarithms by the bytes they hold. Whole texts are read.

Since inputs are bytes, a filter of width w is w tables of 256 weights, and a response is a sum of w lookups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import Adam, fold
from .text import LOWER, text_chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Bound of the training sample, in documents; each gives up to three windows.
SAMPLE = 4_000
#: Languages that can be learned, the most frequent ones.
LANGUAGES = 400
EPOCHS = 6
FOLDS, HELD_OUT = 3, 1
#: Windows of the network's input handled at once.
_BLOCK = 512


def _windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows of bytes), the row of text that each belongs to, and the bytes it holds."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    first = np.concatenate(([0], np.cumsum(counts)))
    flat = np.full(first[-1] * WINDOW, 32, np.uint8)
    for i in np.flatnonzero(sizes):
        flat[first[i] * WINDOW : first[i] * WINDOW + sizes[i]] = raw[offsets[i] : offsets[i + 1]]
    owner = np.repeat(np.arange(len(sizes)), counts)
    held = np.minimum(WINDOW, sizes[owner] - (np.arange(first[-1]) - first[owner]) * WINDOW)
    return LOWER[flat].reshape(-1, WINDOW), owner, held


class ByteNetwork:
    """tables: for each width an array (width, 256, FILTERS); out, bias: the softmax layer."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3 / w, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _pool(self, x: np.ndarray, where: bool = False):
        """Largest responses (window, filter), and their places if asked."""
        best, places = [], []
        for table in self.tables:
            span = x.shape[1] - len(table) + 1
            r = table[0][x[:, :span]]
            for k in range(1, len(table)):
                r += table[k][x[:, k : k + span]]
            if where:
                at = r.argmax(1)
                places.append(at)
                best.append(np.take_along_axis(r, at[:, None], 1)[:, 0])
            else:
                best.append(r.max(1))
        return np.concatenate(best, 1), places

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for i in range(0, len(x), _BLOCK):
            z = self._pool(x[i : i + _BLOCK])[0] @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 11) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.out, self.bias]
        adam = Adam(params, 0.02)
        for epoch in range(EPOCHS):
            adam.rate = 0.02 / (1 + epoch)
            order = rng.permutation(len(x))
            for i in range(0, len(order), 64):
                at = order[i : i + 64]
                pooled, places = self._pool(x[at], True)
                z = pooled @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                back = p @ self.out.T
                grads = []
                for n, (table, place) in enumerate(zip(self.tables, places, strict=True)):
                    g = np.zeros_like(table)
                    own = back[:, n * FILTERS : (n + 1) * FILTERS]
                    for k in range(len(table)):
                        byte = np.take_along_axis(x[at], place + k, 1)
                        np.add.at(g[k], (byte, np.arange(FILTERS)), own)
                    grads.append(g)
                adam.step([*grads, pooled.T @ p + 1e-4 * self.out, p.sum(0)])
        return self


def _by_language(rows: DataFrame) -> DataFrame:
    """About SAMPLE rows, chosen by a hash of the doc_id: as many of each language, all of those that have fewer."""
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    share, left = {}, SAMPLE
    for k, r in enumerate(sorted(counts, key=lambda r: r["n"])):
        share[r["lang"]] = min(1.0, left / (len(counts) - k) / r["n"])
        left -= int(share[r["lang"]] * r["n"])
    if not share:
        return rows.limit(0)
    bound = F.create_map(*[x for lang, s in share.items() for x in (F.lit(lang), F.lit(int(s * 1_000_000) + 1))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    return rows.where(place < F.try_element_at(bound, F.col("lang"))).limit(2 * SAMPLE)


def train(docs: DataFrame) -> ByteNetwork | None:
    """A network from the documents with a language outside the held-out fold, or None if there are none."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("lang is not null and length(text) > 0").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)

    def read(batches):
        for batch in batches:
            found, names = [], []
            langs = batch.column(1).to_pylist()
            for row, _, raw, offsets in text_chunks(batch):
                x, owner, held = _windows(raw, offsets)
                for i in np.unique(owner):
                    own = np.flatnonzero(owner == i)
                    for j in {own[0], own[len(own) // 2], own[-1]}:
                        found.append(x[j].tobytes())
                        names.append(langs[row + i])
                    if held[own[0]] >= 64:  # a short piece, so that short texts are known too
                        short = np.full(WINDOW, 32, np.uint8)
                        size = 16 + int(x[own[0], :8].sum()) % 48
                        short[:size] = x[own[0], :size]
                        found.append(short.tobytes())
                        names.append(langs[row + i])
            yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.binary()), "lang": pa.array(names, pa.string())})

    sample = _by_language(rows).select("text", "lang").mapInArrow(read, "x binary, lang string").collect()
    if not sample:
        return None
    languages = sorted({r["lang"] for r in sample})
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in sample), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(r["lang"]) for r in sample])
    order = np.lexsort((*x[:, :16].T[::-1], y))  # not in the order in which tasks happened to end
    return ByteNetwork(languages).fit(x[order], y[order])


def identify(docs: DataFrame, model: ByteNetwork | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs; ``und`` with score 0 for texts without a letter."""

    def predict(batches):
        for batch in batches:
            names, scores = [], []
            texts = batch.column(1)
            for row, end, raw, offsets in text_chunks(batch):
                x, owner, held = _windows(raw, offsets)
                total = np.zeros((end - row, len(model.languages) if model else 1))
                if model:
                    logs = model.log_probabilities(x).astype(np.float64) * held[:, None]
                    np.add.at(total, owner, logs)
                    total /= np.maximum(1, np.diff(offsets))[:, None]
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                ascii_letters = np.concatenate(([0], np.cumsum((LOWER[raw] >= 97) & (LOWER[raw] <= 122))))
                some = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for i in range(end - row):
                    if model and (some[i] or any(c.isalpha() for c in texts[row + i].as_py() or "")):
                        best = int(p[i].argmax())
                        names.append(model.languages[best])
                        scores.append(float(p[i, best]))
                    else:
                        names.append("und")
                        scores.append(0.0)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}
            )

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.mapInArrow(predict, "doc_id long, lang_pred string, score double")
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def language_id(docs: DataFrame) -> DataFrame:
    """identify with a network trained on the same table (doc_id, text, lang).

    Without labelled rows every text is ``und``. Null and repeated rows are predicted each, equal texts alike; very long
    texts are read whole; of equally likely languages the first by name is given; empty tables give empty results; other
    columns are ignored.
    """
    return identify(docs, train(docs))
