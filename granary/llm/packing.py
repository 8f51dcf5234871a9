"""Packing documents into token windows of several sizes.

Documents are tokenised where they are read and packed in the same task. Whole windows of the largest size are cut off a
long document; what is left of it is routed to the smallest tier whose windows hold it and waits in the task's pool. A full
pool is packed tier by tier, the largest first: a window is opened by the longest document of its tier, its gap is filled
by the longest fitting ones of shorter tiers, and where none fits the shortest too long one is cut to close the gap.
So every window is full. Only a task's very last window is not; its tokens are cut into windows of smaller powers of two.

Windows are then dealt to the step groups of their tier, which hold the same number of tokens: windows are ranked by what
attention costs on them (the sum of squared lengths of their pieces) and dealt out forth and back, so groups of a tier have
as many windows, give or take one, and about the same cost. The ranks come from a sort by range; only counts per task meet.

A task holds the pool (POOL_TOKENS, and the document at hand). Its pieces are written before they are used, so a lost
executor never mixes two packings of the same rows. No text or token is shuffled.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, Scratch

#: Window sizes, powers of two.
TIERS = (256, 512, 1024, 2048)
#: Tokens that wait in a task until they are packed; tokens of a step group.
POOL_TOKENS, STEP_TOKENS = 1 << 21, 1 << 17
#: The id after the last token of a document.
END_ID = 1
#: Pieces whose ids a task remembers.
KNOWN = 1 << 19

#: Texts of ASCII and the letters of Western languages, which neither normalisation nor a lower-case form of two characters
#: changes, and how the tokenizer cuts them in lower case, fixed by its file.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-įı-ž]*")
_PIECE_OF_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-zß-öø-ž0-9 \t-\r]+")
_SPACE = re.compile(r"[ \t-\r]+")
_SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")


class Ids(dict):
    """The ids (little-endian, 32 bits each) of pieces of text, remembered.

    The tokenizer forgets white space and never joins what stands on two sides of it, so words can be looked up one by one,
    and words of Western letters in the pieces that it cuts them into. Words with other characters, and texts that name a
    special token, are left to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if _PIECE_OF_PLAIN.fullmatch(piece) and _PLAIN.fullmatch(piece):
            (own, _), *_ = self.bytes.pre_tokenize_str(piece)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(own)])
        else:
            found = self.encoded(piece)
        if len(piece) < 64:
            self[piece] = found
        return found

    def of(self, text: str) -> bytes:
        if len(self) > KNOWN:
            self.clear()
        if _SPECIAL.search(text):
            return self.encoded(text)
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, _PIECE_OF_PLAIN.findall(text.lower())))
        out = []
        for word in _SPACE.split(text):
            if _PLAIN.fullmatch(word):
                out += map(self.__getitem__, _PIECE_OF_PLAIN.findall(word.lower()))
            else:
                out.append(self[word])
        return b"".join(out)


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


class Pool:
    """Documents' rests, (key, start, length) each, packed into full windows."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("window sizes must be powers of two")
        self.tiers, self.tokens = sorted(tiers), 0
        self.waiting: dict[int, deque] = {}
        self.lengths: list[int] = []

    def add(self, key, start: int, length: int) -> None:
        self.tokens += length
        if length not in self.waiting:
            self.waiting[length] = deque()
            insort(self.lengths, length)
        self.waiting[length].append((key, start))

    def _take(self, at: int) -> tuple:
        length = self.lengths[at]
        key, start = self.waiting[length].popleft()
        if not self.waiting[length]:
            del self.waiting[length], self.lengths[at]
        self.tokens -= length
        return key, start, length

    def _filled(self, window: list[tuple], gap: int) -> int:
        """Fills the window's gap as long as anything waits; what stays open."""
        while gap and self.lengths:
            at = bisect_right(self.lengths, gap)
            if at:
                piece = self._take(at - 1)
            else:  # all that wait are too long: the shortest is cut
                key, start, length = self._take(0)
                self.add(key, start + gap, length - gap)
                piece = key, start, gap
            window.append(piece)
            gap -= piece[2]
        return gap

    def windows(self, last: bool = False) -> Iterator[tuple[int, list[tuple]]]:
        """(size, pieces) of full windows until the pool is used up; what the last one holds goes back, or with ``last``
        into smaller powers of two."""
        for k in range(len(self.tiers) - 1, -1, -1):
            size, shorter = self.tiers[k], self.tiers[k - 1] if k else 0
            while self.lengths and self.lengths[-1] > shorter:
                window = [self._take(len(self.lengths) - 1)]
                gap = self._filled(window, size - window[0][2])
                if not gap:
                    yield size, window
                elif last:
                    yield from _halved(window, size - gap)
                else:
                    for piece in window:
                        self.add(*piece)
                    return


def _halved(pieces: list[tuple], tokens: int) -> Iterator[tuple[int, list[tuple]]]:
    """The pieces in windows of the powers of two that add up to their tokens."""
    rest = deque(pieces)
    while tokens:
        size = 1 << (tokens.bit_length() - 1)
        window, gap = [], size
        while gap:
            key, start, length = rest.popleft()
            if length > gap:
                rest.appendleft((key, start + gap, length - gap))
                length = gap
            window.append((key, start, length))
            gap -= length
        yield size, window
        tokens -= size


_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int"


def pieces(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with their place in a window (sequence_id, offset) of ``tier`` tokens, and with_ids also
    the ids themselves. Every window is full; sizes under the smallest tier occur once in a task at most."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pool, longest = ids_of(tokenizer), Pool(tiers), max(tiers)
        held: dict[int, list] = {}  # waiting documents: doc_id, ids from the rest on, tokens before the rest, tokens still there
        number, done, out = TaskContext.get().partitionId() << 40, 0, []

        def placed(size: int, window: list[tuple]) -> None:
            nonlocal number
            offset = 0
            for key, start, length in window:
                doc = held[key]
                ids = doc[1][4 * (start - doc[2]) : 4 * (start - doc[2] + length)]
                out.append((doc[0], start, length, zlib.crc32(ids), doc[4], number, offset, size, *([ids] if with_ids else [])))
                offset += length
                doc[3] -= length
                if not doc[3]:
                    del held[key]
            number += 1

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64()] * 7 + [pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier"]
            if with_ids:
                joined = np.frombuffer(b"".join(columns[8]), "<u4").astype(np.int32)
                ends = np.concatenate(([0], np.cumsum(columns[2]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(joined)))
                names.append("ids")
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = known.of(text.as_py() or "") + END_ID.to_bytes(4, "little")
                n = len(ids) // 4
                rest = n % longest
                whole = n - rest
                key, done = done, done + 1
                held[key] = [doc_id, ids, 0, n, n]
                for start in range(0, whole, longest):
                    placed(longest, [(key, start, longest)])
                if rest:
                    held[key][1], held[key][2] = ids[4 * whole :], whole
                    pool.add(key, whole, rest)
                if pool.tokens >= pool_tokens:
                    for window in pool.windows():
                        placed(*window)
                if len(out) >= 10_000:
                    yield batch_of()
        for window in pool.windows(last=True):
            placed(*window)
        if out:
            yield batch_of()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(pack, _PIECE + (", ids array<int>" if with_ids else ""))


def step_groups(packed: DataFrame, scratch: Scratch, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """(sequence_id, step_group) of all windows: the windows of a group have one size and about ``step_tokens`` tokens, and
    groups of a size have as many windows, give or take one, and about the same cost."""
    cost = packed.groupBy("sequence_id", "tier").agg(F.sum(F.col("length") * F.col("length")).alias("cost"))
    ranged = cost.repartitionByRange("tier", "cost", "sequence_id").withColumn("task", F.spark_partition_id())
    ranged = scratch.written(ranged)
    counts = ranged.groupBy("tier", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    tiers = counts.groupBy("tier").agg(F.sum("n").alias("windows"))
    groups = F.ceil(F.col("windows") * F.col("tier") / step_tokens).cast("long")
    first = Window.orderBy(F.desc("tier")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each power of two
    tiers = tiers.withColumn("groups", groups).withColumn("first_group", F.coalesce(F.sum("groups").over(first), F.lit(0)))
    counts = counts.join(F.broadcast(tiers), "tier").drop("n")
    own = Window.partitionBy("tier", "task").orderBy("cost", "sequence_id")
    small = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS // 4 else counts
    rank = F.col("before") + F.row_number().over(own) - 1
    ranked = ranged.join(small, ["tier", "task"]).withColumn("rank", rank)
    turn, at = F.floor(F.col("rank") / F.col("groups")), F.col("rank") % F.col("groups")
    place = F.when(turn % 2 == 0, at).otherwise(F.col("groups") - 1 - at)
    return ranked.select("sequence_id", (F.col("first_group") + place).cast("long").alias("step_group"))


def pack(
    docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False, scratch: Scratch | None = None
) -> DataFrame:
    """A row for each piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens, sequence_id, offset
    (in the sequence), tier (its size) and step_group; with_ids also ids (as signed 32-bit numbers).

    A document is its ids by ``tokenizer`` (a path) and END_ID, so null and empty texts have that one id. Each id lies in
    one piece. Rows count each on its own, so repeated rows and null doc_ids are no special case; further columns are not
    read. A text of any length is tokenised as a whole. An empty table gives an empty result.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    scratch = scratch or Scratch(docs.sparkSession)
    packed = scratch.written(pieces(docs, tokenizer, tiers, with_ids=with_ids))
    return packed.join(step_groups(packed, scratch, step_tokens), "sequence_id")
