"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017) on hashed words.

The classifier sees confirmed toxic examples and unlabelled text only; confirmed clean labels serve for nothing but the
class prior p, the share of toxic rows among all labelled rows of the training folds. With a loss l, the risk is

    p * E_P[l(+)] + max(0, E_U[l(-)] - p * E_P[l(-)])

where the maximum keeps the part for negatives from being fitted below zero. Training rows are a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import Adam, bounded_sample, fold, hashed_words, sigmoid

BITS = 20
#: Bounds of the training samples, in documents, and of the words that get a weight.
POSITIVES = 3_000
UNLABELLED = 6_000
FEATURES = 512
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3


def _bags(docs: DataFrame) -> list[np.ndarray]:
    """The hashed words of each document of a bounded sample."""

    def read(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"words": pa.array([w.tobytes() for w in hashed_words(batch, BITS)], pa.binary())})

    rows = docs.select(F.col("text").cast("string")).mapInArrow(read, "words binary").collect()
    return [np.frombuffer(bytes(r["words"]), np.int32) for r in rows]


def _counts(bags: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate([*bags, np.zeros(0, np.int32)]), minlength=1 << BITS)


def risk(x_p: np.ndarray, x_u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative risk with logistic loss, and the direction of descent for weights and bias."""
    s_p, s_u = sigmoid(x_p @ w + b), sigmoid(x_u @ w + b)
    # l(+) = -log s, l(-) = -log(1 - s); derivatives by the score are s - 1 and s
    positive = -prior * np.log(s_p + 1e-12).mean()
    negative = -np.log1p(-s_u + 1e-12).mean() + prior * np.log1p(-s_p + 1e-12).mean()
    g_plus, g_minus_p, g_minus_u = (s_p - 1) / len(s_p), s_p / len(s_p), s_u / len(s_u)
    if negative >= 0:
        d_p, d_u = prior * g_plus - prior * g_minus_p, g_minus_u
    else:  # the non-negative correction: step back out of the overfitted part
        d_p, d_u = prior * g_minus_p, -g_minus_u
    return positive + max(0.0, negative), x_p.T @ d_p + x_u.T @ d_u, d_p.sum() + d_u.sum()


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(words, weights, bias) of a linear scorer on the presence of words."""
    p_docs, u_docs = max(1, len(positive)), max(1, len(unlabelled))
    p, u = _counts(positive), _counts(unlabelled)
    rate, base = p / p_docs, u / u_docs
    # words far commoner among positives than their share of the unlabelled explains
    lift = (rate - base) / np.sqrt((base + 1 / u_docs) / p_docs + 1e-12)
    known = np.flatnonzero((p >= max(3, 0.01 * p_docs)) & (lift > 4) & (rate > 2 * base))
    known = np.sort(known[np.argsort(-lift[known], kind="stable")[:FEATURES]]).astype(np.int32)
    if not len(known):
        return known, np.zeros(0), float(np.log(max(prior, 1e-6)) - np.log1p(-min(prior, 1 - 1e-6)))
    x_p, x_u = (np.array([np.isin(known, b, assume_unique=True) for b in bags], np.float64).reshape(-1, len(known)) for bags in (positive, unlabelled))
    w, b = np.zeros(len(known)), np.array([-2.0])
    adam = Adam([w, b], 0.05)
    for _ in range(600):
        _, d_w, d_b = risk(x_p, x_u, w, float(b[0]), prior)
        adam.step([d_w + 1e-4 * w, np.array([d_b])])
    return known, w, float(b[0])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """A model from the labelled rows outside the held-out fold and unlabelled text of the same folds."""
    docs = docs.select("doc_id", "text").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = labels.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).where("toxic is not null")
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double")).alias("p")).first()["p"]
    toxic = known.where("toxic = 1").select("doc_id").distinct()
    chosen = bounded_sample(toxic, POSITIVES)
    positive = _bags(docs.join(chosen, "doc_id", "left_semi").limit(2 * POSITIVES))
    unlabelled = _bags(bounded_sample(docs, UNLABELLED))
    return fit(positive, unlabelled, float(share or 0.0))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs. Empty and null texts get the model's bias."""
    known, weights, bias = model

    def score(batches):
        for batch in batches:
            z = []
            for w in hashed_words(batch, BITS):
                at = np.minimum(np.searchsorted(known, w), max(0, len(known) - 1))
                z.append(bias + (weights[at[known[at] == w]].sum() if len(known) and len(w) else 0.0))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(sigmoid(np.array(z, np.float64)))})

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = docs.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_toxicity with a model trained on the same tables.

    Without labelled toxic rows every score is the class prior. Null labels and null doc_ids teach nothing; repeated rows
    are scored each, equal texts alike; very long texts are scored by all their words; other columns are ignored; empty
    tables give empty results. Only words in at least 3 and 1 % of the sampled toxic documents can get a weight, the best
    FEATURES of them, so toxic texts of rarer words alone score as low as any text.
    """
    return score_toxicity(docs, train(docs, labels))
