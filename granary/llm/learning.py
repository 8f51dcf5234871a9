"""Small numpy models shared by the classifiers: bounded samples, hashed features and Adam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, WORD, text_chunks, word_hashes, words


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.encode(doc_id.cast("long").cast("string"), "UTF-8")) % folds


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About ``rows`` rows, never over twice as many, chosen by a hash of the key over the whole table."""
    total = df.count()
    if total > rows:
        df = df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * rows / total) + 1)
    return df.limit(2 * rows)


def hashed_words(batch: pa.RecordBatch, bits: int, column: str = "text") -> Iterator[np.ndarray]:
    """For each row of the batch the sorted distinct hashed words of its whole text."""
    for _, _, raw, offsets in text_chunks(batch, column):
        data = LOWER[raw]
        starts, ends, first = words(data, offsets, WORD)
        h = (word_hashes(data, starts, ends) >> np.uint64(64 - bits)).astype(np.int32)
        for i in range(len(first) - 1):
            s = np.sort(h[first[i] : first[i + 1]])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) else s


class Adam:
    """Adam steps for a list of arrays, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))
