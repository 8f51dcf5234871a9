"""N-gram Jaccard join: an exact metric-space join of 5-word shingle sets at a similarity of 0.75 or more.

Jaccard distance d = 1 - J is a metric. With r = 0.25 a set x with d(x, p) <= r is linked to the pivot p, and pivots decide
which other sets can still be within r of each other.

1. Equal shingle sets become one set named by a hash of its content; all that follows works on distinct sets.
2. First level, pivots {s} of one shingle. d(x, {s}) = 1 - 1/|x| for s in x and 1 otherwise, so all shingles of x tie as
   its nearest pivot and one global order breaks the tie. A set is replicated to the Voronoi region of every shingle that
   a set within r of it could prefer: its first |x| - ceil(0.75 |x|) + 1 shingles in that order. Two sets within r meet
   in the region of their first common shingle, and there the order bounds what they can still have in common (_window).
3. Regions grow with the corpus where many texts share a passage, so the order puts such shingles last ("late"). A
   pre-aggregated count over the first shingles of all sets finds those with more than REGION sets. Sets concerned look
   ahead, to the shingles that would take the places, and those with more than REGION of them are late as well. Sets
   with a late shingle among their first are ordered again; for all others nothing changes, so the order is the same for
   all, and what is late decides the amount of work alone, never the result.
4. Second level, documents as pivots inside each region. Of two linked sets at least one has the common shingle in the
   first seventh of its order (at r = 0.25); such sets are the core of a region, a region without core is done, and a
   core set is its pivot. Late regions, which may be large, have two. Each set is measured against the pivots of its
   regions and joins them if it lies within r: one row per set and pivot, no pairs.
5. Third level, recursion into what the pivots left unconnected. Small regions (those of shingles that aren't late)
   compare members of different components inside the task. Large ones with the same largest component become one region,
   whose unconnected sets are measured against its members in blocks; a block is a task that emits the links it
   found, at most one per set and component, never candidates.

Before any set travels, a candidate pair must pass signatures: the number of shingles in each of about as many
buckets as the set has shingles. The sum of the smaller counts bounds the intersection from above, so no link is lost.
What passes is decided by the exact size of intersection and union. Components are found by large-star and small-star
steps. Late shingles go to tasks up to a counted bound and are joined beyond it; nothing else visits the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BROADCAST_ROWS,
    Scratch,
    connected_components,
    cut,
    identified,
    merged_components,
    ready,
    rows_that_stay,
    semi_join_sized,
    written,
)
from .text import set_name, shingle_sets

#: Sets in a region beyond which its shingle is ordered last.
REGION = 32
#: Shingles and sets of each side of a block in large regions.
BLOCK_SHINGLES, BLOCK_SETS = 250_000, 400

_PLACES = "s long, set_id long, place long"
_LOW = 0xFFFFFFFF


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


def _signature(s: np.ndarray) -> bytes:
    """Numbers of shingles (255 means that or more) by their leading bits, in a power of two of buckets."""
    bits = len(s).bit_length() - 1
    at = (s >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(s), np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _most_common(x: bytes, y: bytes, n: int, m: int) -> int:
    """An upper bound of the intersection of two sets of n and m shingles with these signatures."""
    x, y = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if (x == 255).any() or (y == 255).any():
        return min(n, m)
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum())


def _first(n: int, percent: int) -> int:
    """Shingles of a set of n by which every set that links with it is found."""
    return n - (percent * n + 99) // 100 + 1


def _profiles(docs: DataFrame, percent: int) -> DataFrame:
    """For every row of docs: doc_id, h, g, set_id, n, and its first shingles in the order of hashes."""

    def profile(batches):
        for batch in batches:
            rows = batch.num_rows
            names, sizes = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            firsts: list[bytes | None] = [None] * rows
            for row, s in shingle_sets(batch):
                sizes[row] = n = len(s)
                if n:
                    names[row] = set_name(s)
                    firsts[row] = s[: _first(n, percent)].tobytes()
            ids = dict(zip(("doc_id", "h", "g"), batch.columns, strict=False))
            yield _batch(**ids, set_id=names, n=sizes, firsts=pa.array(firsts, pa.binary()))

    return docs.mapInArrow(profile, "doc_id long, h long, g int, set_id long, n long, firsts binary")


def _spread(sets: DataFrame, column: str, *more: str) -> DataFrame:
    """(s, set_id, place, more): a row per shingle of the column; place holds the size of the set and the shingle's position."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
                counts = np.array([len(x) for x in found], np.int64)
                base = np.repeat(np.cumsum(counts) - counts, counts)
                yield _batch(
                    s=np.concatenate(found),
                    set_id=np.repeat(part.column(0).to_numpy(), counts),
                    place=np.repeat(part.column(1).to_numpy() << 32, counts) + np.arange(counts.sum()) - base,
                    **{name: np.repeat(part.column(3 + k).to_numpy(), counts) for k, name in enumerate(more)},
                )

    schema = ", ".join((_PLACES, *(f"{name} long" for name in more)))
    return sets.select("set_id", "n", column, *more).mapInArrow(spread, schema)


def _texts(docs: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """text and the columns of ``names`` (set_id and others) of the documents whose sets are named; copies come with them."""
    keys = cut(names.join(sets.select("set_id", "h"), "set_id").drop("set_id").distinct())
    side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge")
    return docs.select("h", "text").join(side, "h").drop("h")


def _sets(docs: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """(set_id, n, shingles) of the named sets."""

    def read(batches):
        for batch in batches:
            found = {set_name(s): s for _, s in shingle_sets(batch) if len(s)}
            yield _batch(
                set_id=pa.array(list(found), pa.int64()),
                n=pa.array([len(s) for s in found.values()], pa.int64()),
                shingles=pa.array([s.tobytes() for s in found.values()], pa.binary()),
            )

    rows = _texts(docs, sets, names).mapInArrow(read, "set_id long, n long, shingles binary")
    return rows.dropDuplicates(["set_id"])


def _signatures(docs: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """(set_id, n, signature) of the named sets."""

    def read(batches):
        for batch in batches:
            found = {set_name(s): (len(s), _signature(s)) for _, s in shingle_sets(batch) if len(s)}
            yield _batch(
                set_id=pa.array(list(found), pa.int64()),
                n=pa.array([n for n, _ in found.values()], pa.int64()),
                signature=pa.array([x for _, x in found.values()], pa.binary()),
            )

    rows = _texts(docs, sets, names).mapInArrow(read, "set_id long, n long, signature binary")
    return rows.dropDuplicates(["set_id"])


def _ahead(docs: DataFrame, sets: DataFrame, touched: DataFrame, percent: int) -> DataFrame:
    """The shingles (s) that could take the places of a set's crowded ones: three for each, all if half are crowded."""

    def ahead(batches):
        seen: set[int] = set()
        for batch in batches:
            crowded = batch.column(1).to_pylist()
            found = [np.zeros(0, np.uint64)]
            for row, s in shingle_sets(batch):
                if len(s) and (name := set_name(s)) not in seen:
                    seen.add(name)
                    p = _first(len(s), percent)
                    found.append(s[p:] if 2 * crowded[row] >= p else s[p : p + 3 * crowded[row]])
            yield _batch(s=np.concatenate(found).view(np.int64))

    return _texts(docs, sets, touched).select("text", "crowded").mapInArrow(ahead, "s long")


def _ranked(full: DataFrame, late: DataFrame) -> DataFrame:
    """full (set_id, n, shingles) with ``marks``: the late shingles (s, sets that hold it) of each set."""
    hits = _spread(full, "shingles").select("s", "set_id")
    hits = hits.join(late.hint("merge"), "s").groupBy("set_id").agg(F.collect_list(F.struct("s", "df")).alias("marks"))
    return full.join(hits, "set_id", "left")


def _reordered(docs: DataFrame, sets: DataFrame, names: DataFrame, late: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """(set_id, n, firsts, early): the first shingles of the sets in an order in which late ones come last, the rarer first.

    early: how many of them aren't late.
    """
    schema = "set_id long, n long, firsts binary, early long"

    def ordered(s: np.ndarray, values: np.ndarray, df: np.ndarray) -> tuple[bytes, int]:
        rank = np.zeros(len(s), np.int64)
        if len(values):
            at = np.minimum(np.searchsorted(values, s), len(values) - 1)
            rank = np.where(values[at] == s, df[at], 0)
        first = np.lexsort((s.view(np.uint64), rank))[: _first(len(s), percent)]
        return s[first].tobytes(), int(np.count_nonzero(rank[first] == 0))

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["set_id", "n", "firsts", "early"])

    if late.count() <= BROADCAST_ROWS:
        pairs = late.toPandas().sort_values("s")
        # of a counted size: 16 bytes for each of at most BROADCAST_ROWS
        sent = docs.sparkSession.sparkContext.broadcast((pairs["s"].to_numpy(np.int64), pairs["df"].to_numpy(np.int64)))

        def order(batches):
            for batch in batches:
                found = {set_name(s): s for _, s in shingle_sets(batch) if len(s)}
                yield made([(name, len(s), *ordered(s.view(np.int64), *sent.value)) for name, s in found.items()])

        return _texts(docs, sets, names).mapInArrow(order, schema).dropDuplicates(["set_id"])

    def order_marked(batches):
        for batch in batches:
            rows = []
            for name, n, shingles, marks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                values = np.array(sorted((m["s"], m["df"]) for m in marks or []), np.int64).reshape(-1, 2)
                rows.append((name, n, *ordered(np.frombuffer(shingles, np.int64), values[:, 0], values[:, 1])))
            yield made(rows)

    return _ranked(tables.written(_sets(docs, sets, names)), late).mapInArrow(order_marked, schema)


def _size(place):
    return F.shiftright(place, 32)


def _room(place):
    """How many shingles of the order are left from this one on."""
    return F.shiftright(place, 32) - F.col(place).bitwiseAND(F.lit(_LOW))


def _is_core(place: str, percent: int):
    return (100 + percent) * _room(place) >= 2 * percent * _size(place)


def _window(a: str, b: str, percent: int):
    """Whether sizes and positions of a shingle common to two sets leave room for a link, if it is their first."""
    n, m = _size(a), _size(b)
    room = F.least(_room(a), _room(b))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m))


def _whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of rows sorted by the first one, so that no region is cut in two."""
    kept: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = tuple(batch.column(i).to_numpy() for i in range(batch.num_columns))
        if kept is not None:
            columns = tuple(np.concatenate(c) for c in zip(kept, columns, strict=True))
        s = columns[0]
        last = int(np.searchsorted(s, s[-1]))
        kept = tuple(c[last:] for c in columns)
        if last:
            yield tuple(c[:last] for c in columns)
    if kept is not None:
        yield kept


def _regions(rows: DataFrame, percent: int) -> DataFrame:
    """(s, set_id, place, size, pivot, at): regions of two or more sets and a core, with the smallest core set and its place."""

    def shared(batches):
        for s, name, place in _whole_regions(batches):
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            size = np.diff(np.append(first, len(s)))
            if not (size > 1).any():
                continue
            n = place >> 32
            core = (100 + percent) * (n - (place & _LOW)) >= 2 * percent * n
            least = np.minimum.reduceat(np.where(core, name, np.iinfo(np.int64).max), first)
            keep = np.repeat((size > 1) & np.logical_or.reduceat(core, first), size)
            pivot = np.repeat(least, size)
            own = core & (name == pivot)
            at = np.repeat(np.add.reduceat(np.where(own, place, 0), first), size)
            sizes = np.repeat(size, size)[keep]
            yield _batch(s=s[keep], set_id=name[keep], place=place[keep], size=sizes, pivot=pivot[keep], at=at[keep])

    rows = rows.repartition("s").sortWithinPartitions("s")
    return rows.mapInArrow(shared, _PLACES + ", size long, pivot long, at long")


def _inner_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of members of a small region that are not connected and whose window leaves room for a link."""

    def pairs(batches):
        for s, name, place, label in _whole_regions(batches):
            n, room = place >> 32, (place >> 32) - (place & _LOW)
            x, step = np.arange(len(s) - 1), 1
            while len(x):
                x = x[x + step < len(s)]
                y = x + step
                x = x[s[x] == s[y]]
                y = x + step
                fits = (label[x] != label[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                fits &= (100 + percent) * np.minimum(room[x], room[y]) >= percent * (n[x] + n[y])
                a, b = name[x[fits]], name[y[fits]]
                if len(a):
                    yield _batch(a=np.minimum(a, b), b=np.maximum(a, b))
                step += 1

    rows = regions.repartition("s").sortWithinPartitions("s")
    return rows.mapInArrow(pairs, "a long, b long").distinct()


def _plausible(pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """Those of the pairs (a, b) whose signatures leave room for a link."""

    def decide(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            keep = []
            for x, n, y, m in zip(*columns[2:], strict=True):
                both = _most_common(x, y, n, m)
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    names = cut(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    held = tables.written(_signatures(docs, sets, names))
    left = held.select(F.col("set_id").alias("a"), F.col("signature").alias("x"), F.col("n").alias("nx"))
    right = held.select(F.col("set_id").alias("b"), F.col("signature").alias("y"), F.col("n").alias("ny"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "nx", "y", "ny")
    return both.mapInArrow(decide, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """Those of the distinct pairs (a, b) that are linked; sets are read for plausible pairs only."""
    pairs = cut(_plausible(pairs, docs, sets, percent, tables))
    names = cut(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
    return cut(_linked(pairs, tables.written(_sets(docs, sets, names)), percent))


def _linked(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity, from whole intersections."""

    def decide(batches):
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            keep = []
            for row, (x, y) in enumerate(zip(*columns[2:], strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(row)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    left = full.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = full.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(decide, "a long, b long")


class _Pivots:
    """Shingle sets ready to measure other sets against all of them."""

    def __init__(self, names: list[int], sets: list[np.ndarray], percent: int):
        order = np.argsort(flat := np.concatenate([*sets, np.zeros(0, np.uint64)]), kind="stable")
        self.names, self.percent = np.array(names, np.int64), percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.owners = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[order]
        self.values, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat)).astype(np.int64)

    def near(self, s: np.ndarray) -> np.ndarray:
        """Indexes of the sets within r of this one."""
        if not len(self.names) or not len(s):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.values, s), len(self.values) - 1)
        at = at[self.values[at] == s]
        counts = self.first[at + 1] - self.first[at]
        total = np.cumsum(counts)
        if not len(at):
            return np.zeros(0, np.int64)
        slots = np.repeat(self.first[at] - total + counts, counts) + np.arange(total[-1])
        both = np.bincount(self.owners[slots], minlength=len(self.names))
        return np.flatnonzero(100 * both >= self.percent * (len(s) + self.sizes - both))


def shingle_links(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' sets (doc_id, h, g, set_id, n_shingles), exact links (a, b) that connect the sets of each group, and the
    groups (node, label).

    Two sets within the threshold are always connected by links; not every link of a dense group is listed.
    docs: doc_id long and text string. A null or blank text has an empty set, which links with nothing.
    """
    docs = identified(docs)
    scratch = Scratch(ready(docs.sparkSession))
    profile = scratch.written(_profiles(docs, percent))
    members = written(profile.select("doc_id", "h", "g", "set_id", F.col("n").alias("n_shingles")))
    sets = profile.where("n > 0").groupBy("set_id")
    tables = Scratch(scratch.spark)
    sets = tables.written(sets.agg(F.min("h").alias("h"), F.min("n").alias("n"), F.first("firsts").alias("firsts")))
    scratch.clear()
    rows, late_rows = _in_order(docs, sets, percent, tables)

    regions = tables.written(_regions(rows, percent))
    large = F.col("size") > 4 * REGION
    late_rows = _late_regions(late_rows.unionByName(regions.where(large).select("s", "set_id", "place")), percent, tables)
    regions = regions.where(~large)
    star = regions.where("set_id <> pivot").where(_window("place", "at", percent))
    star = star.select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b"))
    star = star.unionByName(_late_star(late_rows, percent))
    star = cut(star.distinct())
    links = _verified(star, docs, sets, percent, tables)
    labels = connected_components(links)

    small = _labelled(regions.select("s", "set_id", "place"), labels)
    rest = _inner_pairs(small, percent).join(star, ["a", "b"], "left_anti")
    more = _verified(cut(rest), docs, sets, percent, tables)
    links, labels = links.unionByName(more), merged_components(labels, more)
    more = cut(_late_links(late_rows, docs, sets, labels, percent, tables))
    tables.clear()
    return members, links.unionByName(more), merged_components(labels, more)


def _in_order(docs: DataFrame, sets: DataFrame, percent: int, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """(s, set_id, place): the first shingles of every set in the common order, those that aren't late and those that are."""
    rows = _spread(sets, "firsts")
    crowded = rows.groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") > REGION)
    crowded = cut(crowded)
    if crowded.isEmpty():
        return rows, rows.where("false")
    side = F.broadcast(crowded.select("s")) if crowded.count() <= BROADCAST_ROWS else crowded.select("s")
    touched = cut(rows.join(side, "s").groupBy("set_id").agg(F.count("*").alias("crowded")))
    ahead = _ahead(docs, sets, touched, percent).groupBy("s").agg(F.count("*").alias("df")).where(F.col("df") > REGION)
    late = cut(crowded.unionByName(ahead).groupBy("s").agg(F.max("df").alias("df")))
    # sets of which only a shingle that is crowded elsewhere is among the first
    names = cut(semi_join_sized(rows, late.select("s"), "s").select("set_id").distinct())
    ordered = tables.written(_reordered(docs, sets, names, late, percent, tables))
    early = F.col("place").bitwiseAND(F.lit(_LOW)) < F.col("early")
    moved = _spread(ordered, "firsts", "early")
    same = _spread(semi_join_sized(sets, names, "set_id", how="left_anti"), "firsts")
    return same.unionByName(moved.where(early).drop("early")), moved.where(~early).drop("early")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the component of their set."""
    rows = rows.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    return rows.select("s", "set_id", "place", F.coalesce("label", "set_id").alias("label"))


def _late_regions(rows: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """(s, set_id, place, core, low, high) of the regions with a core: with their smallest and largest core set and its place."""
    rows = rows.withColumn("core", _is_core("place", percent))
    pivot = F.struct("set_id", "place")
    pivots = rows.where("core").groupBy("s").agg(F.min(pivot).alias("low"), F.max(pivot).alias("high"))
    pivots = cut(pivots)
    side = F.broadcast(pivots) if pivots.count() <= BROADCAST_ROWS // 4 else pivots
    return tables.written(rows.join(side, "s"))


def _late_star(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each set with the pivots of its late regions."""
    rows = rows.select("set_id", "place", F.explode(F.array("low", "high")).alias("pivot"))
    rows = rows.select("set_id", "place", F.col("pivot.set_id").alias("pivot"), F.col("pivot.place").alias("at"))
    rows = rows.where("set_id <> pivot").where(_window("place", "at", percent))
    return rows.select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b"))


def _late_links(
    rows: DataFrame, docs: DataFrame, sets: DataFrame, labels: DataFrame, percent: int, tables: Scratch
) -> DataFrame:
    """Links (a, b) between sets of late regions that are not connected: one for each set, component and block."""
    rows = _labelled(rows.select("s", "set_id", "place"), labels).withColumn("core", _is_core("place", percent))
    parts = rows.groupBy("s", "label").agg(F.count("*").alias("size"))
    open_ = parts.groupBy("s").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("parts"))
    open_ = cut(open_.where("parts > 1").select("s", F.col("top.label").alias("region")))
    side = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
    placed = rows.join(side, "s").groupBy("region", "set_id").agg(F.max("core").alias("core"), F.first("label").alias("label"))
    placed = tables.written(placed.join(sets.select("set_id", "n"), "set_id"))
    guest = F.col("label") != F.col("region")

    def sides(who):
        sets_, shingles = F.count_if(who), F.coalesce(F.sum(F.when(who, F.col("n"))), F.lit(0))
        return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(sets_ / BLOCK_SETS)).cast("int")

    blocks = placed.groupBy("region").agg(sides(F.lit(True)).alias("i"), sides(guest).alias("j"))
    placed = placed.join(cut(blocks.where("j > 0")), "region")
    full = tables.written(_sets(docs, sets, cut(placed.select("set_id").distinct())))
    # every set meets every set that is not connected with the largest component, in one block
    own, other = F.pmod(F.xxhash64("set_id"), F.col("i")), F.pmod(F.xxhash64("set_id"), F.col("j"))
    kept = ["region", "set_id", "core", "label"]
    asked = placed.select(*kept, F.lit(False).alias("asks"), own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("j"))
    asks = placed.where(guest)
    asks = asks.select(*kept, F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("i"), other.alias("j"))
    dealt = asked.unionByName(asks.withColumn("i", F.col("i").cast("long"))).join(full.select("set_id", "shingles"), "set_id")

    def measure(table: pa.Table) -> pa.Table:
        names, labels, cores, asks = (table[c].to_numpy() for c in ("set_id", "label", "core", "asks"))
        found = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        own = np.flatnonzero(~asks)
        index = _Pivots(names[own], [found[k] for k in own], percent)
        link: dict[tuple[int, int], int] = {}
        for k in np.flatnonzero(asks):
            near = own[index.near(found[k])]
            near = near[(labels[near] != labels[k]) & (cores[near] | cores[k])]
            link.update({(int(names[k]), int(labels[x])): int(names[x]) for x in near})
        return pa.table({"a": pa.array([a for a, _ in link], pa.int64()), "b": pa.array(list(link.values()), pa.int64())})

    return dealt.groupBy("region", "i", "j").applyInArrow(measure, "a long, b long")


def near_duplicate_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id of the group of connected documents, for every row.

    Texts without a word stand alone. Rows with equal texts share a group; repeated doc_ids keep their rows; a null
    doc_id is grouped like any other and never names a group (one of null doc_ids alone has a null component_id). Very
    long texts are whole sets. An empty table gives an empty result. Other columns are ignored.
    """
    members, _, labels = shingle_links(docs, percent)
    first = members.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("first_doc"))
    named = first.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    named = cut(named.select("set_id", "first_doc", F.coalesce("label", "set_id").alias("label")))
    groups = cut(named.groupBy("label").agg(F.min("first_doc").alias("component_id")))
    named = cut(named.join(groups, "label").select("set_id", "component_id"))
    out = members.join(named, "set_id", "left")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", alone.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs, with all its columns, with one row of each group of connected documents: that with the smallest doc_id.

    Of repeated rows one stays; a null doc_id orders last. Texts without a word are a group each and stay. An empty
    table stays empty, and columns may have any names.
    """
    members, _, labels = shingle_links(docs, percent)
    rows = members.where("n_shingles > 0").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    rank = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "h", "g")
    rows = rows.select("doc_id", "h", "g", F.coalesce("label", "set_id").alias("label"), rank.alias("rank"))
    best = cut(rows.groupBy("label").agg(F.min("rank").alias("best")))
    decided = rows.join(best, "label").select("doc_id", "h", "g", F.col("rank").eqNullSafe(F.col("best")).alias("kept"))
    return rows_that_stay(docs, decided)
