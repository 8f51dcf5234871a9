"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a maximal stretch of words with smallest period q (words q apart are identical). A text is cut at its midpoint
and each half again. Z-functions of both sides of a midpoint tell, for every period at once, how far words p apart agree to
the left and to the right of it, which is every repetition that crosses the midpoint. The agreement is extended over the
borders of the part by a look at the next word: where it goes on, an outer part has found the run already. Equal
intervals are one run, with the smallest of their periods.

Parts that cannot hold a run are left alone. In a run of at least LEAST words and TIMES periods each window of GRAM words
but those of the first period occurs earlier in the run, so at least PLACES places in a row have such an earlier window.
Windows are compared by a hash, which can only let too much through.

Texts are worked off one by one where they are read: no shuffle, and memory for one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: Words of the windows that are looked up.
GRAM = 8
_BETWEEN = r"[\x20\x09-\x0D]+"
_GRAM_BASE = 0x9E3779B97F4A7C15


def z_function(s: list[int]) -> list[int]:
    """For each place of s how many elements from there on agree with its beginning."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        j = i + k
        while j < n and s[j] == s[k]:
            j += 1
            k += 1
        z[i], left, right = k, i, j
    return z


def _crossing(s: list[int], low: int, mid: int, high: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the stretches of s[low:high] that a period repeats around mid, long enough to be runs."""
    left, right = s[low:mid], s[mid:high]
    back, ahead = left[::-1], right[::-1]
    n, m = len(left), len(right)
    most = (high - low) // times
    forward = np.array(z_function(right + [-1] + left + right))
    backward = np.array(z_function(back + [-1] + ahead + back))
    # the period's first copy ends at mid, then begins at mid
    p = np.arange(1, min(n, most) + 1)
    starts = mid - p - np.where(p < n, backward[np.minimum(p, n - 1)], 0)
    ends = mid + forward[m + 1 + n - p]
    q = np.arange(1, min(m, most) + 1)
    starts = np.concatenate((starts, mid - backward[n + 1 + m - q]))
    ends = np.concatenate((ends, mid + q + np.where(q < m, forward[np.minimum(q, m - 1)], 0)))
    p = np.concatenate((p, q))
    for k in np.flatnonzero(ends - starts >= np.maximum(least, times * p)):
        yield int(starts[k]), int(ends[k]), int(p[k])


def _earlier(ids: np.ndarray) -> np.ndarray:
    """For each window of GRAM words the place of the one before that hashes alike, or -1."""
    n = len(ids) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h + ids[k : k + n].astype(np.uint64) + np.uint64(1)) * np.uint64(_GRAM_BASE)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    out = np.full(n, -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` words and ``times`` periods, by start and period."""
    names: dict = {}
    s = [names.setdefault(w, len(names)) for w in words]
    n = len(s)
    places = least - least // times - GRAM + 1
    if n < least or len(names) == n:
        return []
    found: dict[tuple[int, int], int] = {}
    earlier = _earlier(np.array(s, np.int64)) if places > 0 else None
    parts = [(0, n)]
    while parts:
        low, high = parts.pop()
        if high - low < least:
            continue
        if earlier is not None:
            seen = np.concatenate(([0], np.cumsum(earlier[low : high - GRAM + 1] >= low)))
            if len(seen) <= places or not (seen[places:] - seen[:-places] == places).any():
                continue
        mid = (low + high) // 2
        for start, end, p in _crossing(s, low, mid, high, least, times):
            if (start == 0 or s[start - 1] != s[start - 1 + p]) and (end == n or s[end] != s[end - p]):
                found[start, end] = min(p, found.get((start, end), p))
        parts += [(low, mid), (mid, high)]
    return sorted((a, b - a, p) for (a, b), p in found.items())


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run repeats, joined by a space: of each run the first period stays."""
    if not found:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join(words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0))


def word_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n (words), runs (array of start, length, period; by start, then period) and collapsed (the text without
    what runs repeat, words joined by a space) of every document.

    Words are what stands between the characters [\\x20\\x09-\\x0D]. Null and empty texts have no words, no runs and an
    empty collapsed text. Rows count each on its own, so repeated rows and null doc_ids are no special case; further
    columns are not read. An empty table gives an empty result. A text of a million equal words takes some ten seconds.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for batch in batches:
            sizes, all_runs, texts = [], [], []
            for raw in batch.column(1).cast(pa.binary()):
                words = (raw.as_py() or b"").split()
                own = runs(words, least, times)
                sizes.append(len(words))
                all_runs.append([{"start": a, "length": b, "period": p} for a, b, p in own])
                texts.append(collapsed(words, own))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "runs", "collapsed"])

    kind = "doc_id long, n long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, kind)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; where h = crc32(doc_id) is divisible by 10, the words from a on repeat p words.

    Of n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)) with g = floor(h / 10). A null doc_id, and a text without
    words, stay as they are.
    """
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.filter(F.split("text", _BETWEEN), lambda w: w != "")
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", h)
    out = out.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    n = F.size("words")
    out = out.withColumn("a", F.when(n > 0, (F.col("g") % n).cast("int")))
    out = out.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))

    def repeated(i: Column) -> Column:
        return F.get("words", F.col("a") + i % F.col("p"))

    again = F.transform(F.sequence(F.lit(0), n - F.col("a") - 1), repeated)
    text = F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " "))
    return out.select("doc_id", F.coalesce(text, "text").alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The rows of ``word_runs`` with the run of the greatest length in periods and the digests of runs and collapsed text."""

    def better(best: Column, r: Column) -> Column:
        longer = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best.isNull() | longer, r).otherwise(best)

    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = found.withColumn("best", F.reduce("runs", nothing, better))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
