"""Batch retrieval: lexical and dense top-k, phrase matches, rank fusion, reranking and delivery tiers.

Queries are a table. Each lane gives (query_id, doc_id, score, position), position 1 being the best; ties go to the larger
doc_id, as everywhere in this module. Lanes keep their best k per query within each task before the shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_terms, words
from .common import cut, sized, spread, top_per_group

#: Terms that a lexical query keeps, in alphabetical order, unless it is asked for all of them.
QUERY_TERMS = 12
#: Fusion inside hybrid search and outside it.
HYBRID_K, PLAIN_K = 20, 60
LEXICAL_WEIGHT, DENSE_WEIGHT = 1.0, 0.6
LEXICAL_DEPTH, DENSE_DEPTH, TOOL_DEPTH = 60, 60, 30
FAST_PATH_SHARE, FAST_PATH_BOOST = 0.7, 0.15
LEAST_SIMILARITY, CLOSE_SIMILARITY, CLOSE_MEANINGFULNESS = 0.87, 0.025, 0.08
BM25_K1, BM25_B = 1.2, 0.75


#: Queries of a block: they visit the driver and every task together. Queries measured at once against an Arrow batch.
QUERY_BLOCK = 50_000
QUERY_SLICE = 200
#: Words of documents that a task matches with queries at once, and words whose terms it remembers.
PART_WORDS, KNOWN_WORDS = 60_000, 200_000


class _Best:
    """The k best documents of each query that a task has seen: by score, then the larger id."""

    def __init__(self, queries: int, k: int):
        self.k, self.held = k, [(np.zeros(0), np.zeros(0, np.int64)) for _ in range(queries)]

    def add(self, first: int, docs: np.ndarray, scores: np.ndarray, found: np.ndarray) -> None:
        """scores of documents (rows) for queries (columns) from the first on; only ``found`` ones count."""
        for j in range(scores.shape[1]):
            old, old_docs = self.held[first + j]
            fits = found[:, j] if len(old) < self.k else found[:, j] & (scores[:, j] >= old[-1])
            new = np.flatnonzero(fits)
            if len(new):
                s, d = np.concatenate((old, scores[new, j])), np.concatenate((old_docs, docs[new]))
                order = np.lexsort((-d, -s))[: self.k]
                self.held[first + j] = (s[order], d[order])

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.held]
        scores = np.concatenate([np.zeros(0), *(s for s, _ in self.held)])
        docs = np.concatenate([np.zeros(0, np.int64), *(d for _, d in self.held)])
        return pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, sizes)), "doc_id": pa.array(docs), "score": pa.array(scores)})


def _blocked(queries: DataFrame, top, block: int, size: Column | None = None) -> DataFrame:
    """top(queries) over blocks of about so many queries, one after the other; results wait in the shared folder.

    A query of any ``size``, its terms, counts as many times as QUERY_TERMS goes into it, once at least.
    """
    n = queries.count() if size is None else queries.agg(F.sum(F.greatest(F.lit(1), F.ceil(size / QUERY_TERMS)))).first()[0] or 0
    if n <= block:
        return top(queries)
    queries = cut(queries)
    number = F.pmod(F.xxhash64("query_id"), F.lit(-(-n // block)))
    parts = [cut(top(queries.where(number == b))) for b in range(-(-n // block))]
    return functools.reduce(DataFrame.unionByName, parts)


def query_terms(queries: DataFrame, most: int | None = QUERY_TERMS) -> DataFrame:
    """(query_id, term): the first terms of each query; all of them where ``most`` is None."""
    terms = index_terms(F.col("text"))
    terms = terms if most is None else F.slice(terms, 1, most)
    return queries.select("query_id", F.explode(terms).alias("term"))


def _singular(word: str) -> str:
    """As text.singular, for the distinct words of a batch."""
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    return word[:-1] if word.endswith("s") and not word.endswith("ss") and len(word) > 3 else word


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, terms) in parts of about so many words, so that a task's matches are bounded, however long texts are."""
    for batch in batches:
        step = max(1, batch.num_rows * PART_WORDS // max(1, len(batch.column(1).flatten())))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


class _Asked:
    """The terms of a block of queries, and for each term the queries that ask for it and its weight in them."""

    def __init__(self, rows: list):
        self.ids = np.array(sorted({r["query_id"] for r in rows}), np.int64)
        self.terms = {t: n for n, t in enumerate(sorted({r["term"] for r in rows}))}
        found = sorted((self.terms[r["term"]], int(np.searchsorted(self.ids, r["query_id"])), float(r["weight"])) for r in rows)
        term, self.query, self.weight = (np.array([f[i] for f in found], kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        self.starts = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def counts(self, column: pa.ListArray, form, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times) of the asked terms in lists of words; only distinct words are looked at one by one."""
        coded = column.flatten().dictionary_encode()
        if len(known) > KNOWN_WORDS:
            known.clear()
        codes = np.array([known[w] if w in known else known.setdefault(w, self.terms.get(form(w), -1)) for w in coded.dictionary.to_pylist()], np.int64)
        row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
        term = codes[coded.indices.to_numpy()] if len(codes) else np.zeros(0, np.int64)
        width = max(1, len(self.terms))
        pair, times = np.unique((row * width + term)[term >= 0], return_counts=True)
        return pair // width, pair % width, times


def _term_scores(asked: _Asked, rows: DataFrame, k: int, form, weigh) -> DataFrame:
    """(query_id, doc_id, score, position): the k best of rows (doc_id, terms) by the sum of weights of their terms.

    A document's terms are one row, so its scores are summed where it is read, and a task passes on k rows per query:
    pairs of queries and documents never travel. weigh(times, lengths) is the weight of a term in a document.
    """

    def score(batches):
        best, known = _Best(len(asked.ids), k), {}
        for batch in _parts(batches):
            column = batch.column(1)
            row, term, times = asked.counts(column, form, known)
            value = weigh(times, np.diff(column.offsets.to_numpy())[row])
            n = asked.starts[term + 1] - asked.starts[term]
            slot = np.repeat(asked.starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
            doc, part, to = np.repeat(row, n), np.repeat(value, n) * asked.weight[slot], asked.query[slot]
            docs = batch.column(0).to_numpy()
            for first in range(0, len(asked.ids), QUERY_SLICE):
                width = min(QUERY_SLICE, len(asked.ids) - first)
                here = (to >= first) & (to < first + width)
                at = doc[here] * width + to[here] - first
                shape = (len(docs), width)
                scores = np.bincount(at, part[here], len(docs) * width).reshape(shape)
                best.add(first, docs, np.round(scores, 6), np.bincount(at, minlength=len(docs) * width).reshape(shape) > 0)
        yield best.batch(asked.ids)

    scored = rows.mapInArrow(score, "query_id long, doc_id long, score double")
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.desc("doc_id")], k)


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int = 10, block: int = QUERY_BLOCK, most: int | None = QUERY_TERMS) -> DataFrame:
    """Documents by the number of query terms that they hold, of the first ``most`` terms or (None) of all."""
    long = F.filter(words(F.col("text")), lambda w: F.length(w) >= 3)
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), long.alias("terms")).where("size(terms) > 0")

    def top(own: DataFrame) -> DataFrame:
        asked = _Asked(query_terms(own, most).withColumn("weight", F.lit(1.0)).collect())
        found = _term_scores(asked, rows, k, _singular, lambda times, _: np.ones(len(times)))
        return found.withColumn("score", F.col("score").cast("long"))

    return _blocked(queries, top, block, F.size(index_terms(F.col("text"))) if most is None else None)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = BM25_K1, b: float = BM25_B, block: int = QUERY_BLOCK) -> DataFrame:
    """Okapi BM25 over words of two or more characters; a repeated query word counts each time."""
    long = F.filter(words(F.col("text")), lambda t: F.length(t) > 1)
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), long.alias("terms")).where("text is not null")

    def top(own: DataFrame) -> DataFrame:
        times = own.select("query_id", F.explode(long).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("weight")).collect()
        asked = _Asked(times)

        def count(batches):
            held, total, size, known = np.zeros(len(asked.terms), np.int64), 0, 0, {}
            for batch in _parts(batches):
                _, term, _ = asked.counts(batch.column(1), str, known)
                held += np.bincount(term, minlength=len(held))
                total, size = total + batch.num_rows, size + len(batch.column(1).flatten())
            yield pa.RecordBatch.from_pydict({"term": pa.array([*range(len(held)), -1, -2], pa.int64()), "n": pa.array([*held.tolist(), total, size], pa.int64())})

        n = {r["term"]: r["n"] for r in rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, size = n.get(-1, 0), n.get(-2, 0)
        df = np.array([n.get(t, 0) for t in range(len(asked.terms))], np.float64)
        asked.weight = asked.weight * np.log1p((documents - df + 0.5) / (df + 0.5))[np.repeat(np.arange(len(df)), np.diff(asked.starts))]
        mean = size / max(1, documents) or 1.0
        return _term_scores(asked, rows, k, str, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)))

    return _blocked(queries, top, block)


def _scores(queries: DataFrame, vectors: DataFrame, made, schema: str) -> DataFrame:
    """Arrow batches of (doc_id, embedding, label) against the matrix of queries; ``made(ids)`` holds what a task has found.

    The query matrix is sent to every task; _blocked keeps it bounded.
    """
    rows = queries.select("query_id", "embedding").orderBy("query_id").collect()
    ids = np.array([r["query_id"] for r in rows], np.int64)
    matrix = np.array([r["embedding"] for r in rows], np.float64)

    def score(batches):
        found = made(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
            for at in range(0, len(ids), QUERY_SLICE):
                sims = np.round(flat @ matrix[at : at + QUERY_SLICE].T, 6)
                yield from found.add(at, batch.column(0).to_numpy(), batch.column(2).to_numpy(), sims)
        yield from found.rest()

    return vectors.select("doc_id", "embedding", "label").where("embedding is not null").mapInArrow(score, schema)


class _BestVectors(_Best):
    def __init__(self, ids: np.ndarray, k: int):
        super().__init__(len(ids), k)
        self.ids = ids

    def add(self, first: int, docs: np.ndarray, labels: np.ndarray, sims: np.ndarray) -> Iterator[pa.RecordBatch]:
        super().add(first, docs, sims, np.ones(sims.shape, bool))
        yield from ()

    def rest(self) -> Iterator[pa.RecordBatch]:
        yield self.batch(self.ids)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """Rows of (doc_id, embedding, label) by inner product with each query (query_id, embedding)."""

    def top(own: DataFrame) -> DataFrame:
        scored = _scores(own, vectors, lambda ids: _BestVectors(ids, k), "query_id long, doc_id long, score double")
        return top_per_group(scored, ["query_id"], [F.desc("score"), F.desc("doc_id")], k)

    return _blocked(queries, top, block)


class _BestLabels:
    """The k best labels of each query that a task has seen, each by its best member there."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    def add(self, first: int, docs: np.ndarray, labels: np.ndarray, sims: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((-docs, labels))
        docs, sims = docs[order], sims[order]
        names, starts = np.unique(labels[order], return_index=True)
        scores = np.maximum.reduceat(sims, starts)
        ends = np.append(starts[1:], len(docs))
        for j in range(sims.shape[1]):
            top = np.lexsort((-names, -scores[:, j]))[: self.k]
            # members of a label are in descending order, so that ties go to the larger one
            member = np.array([docs[starts[t] + sims[starts[t] : ends[t], j].argmax()] for t in top], np.int64)
            label, score, member = (np.concatenate(x) for x in zip(self.held[first + j], (names[top], scores[top, j], member), strict=True))
            order = np.lexsort((-member, -score, label))
            order = order[np.append(True, label[order][1:] != label[order][:-1])]  # the best of each label
            order = order[np.lexsort((-label[order], -score[order]))[: self.k]]
            self.held[first + j] = (label[order], score[order], member[order])
        yield from ()

    def rest(self) -> Iterator[pa.RecordBatch]:
        sizes = [len(h[0]) for h in self.held]
        columns = [np.concatenate(x) for x in zip(*self.held, strict=True)] if self.held else [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        names = dict(zip(("label", "score", "member"), map(pa.array, columns), strict=True))
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(self.ids, sizes)), **names})


class _BestMembers:
    """The best member of each query's wanted labels that a task has seen: by score * scale + doc_id, then the higher score."""

    def __init__(self, ids: np.ndarray, wanted: dict[int, list], scale: float):
        self.ids, self.scale = ids, scale
        self.rows = [sorted(wanted.get(q, []), key=lambda r: r["label"]) for q in ids.tolist()]
        self.labels = [np.array([r["label"] for r in rows], np.int64) for rows in self.rows]
        self.held = [(np.full(len(rows), -np.inf), np.zeros(len(rows), np.int64)) for rows in self.rows]

    def add(self, first: int, docs: np.ndarray, labels: np.ndarray, sims: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs, labels))
        docs, weights = docs[order], sims[order] * self.scale + docs[order][:, None]
        names, starts = np.unique(labels[order], return_index=True)
        ends, most = np.append(starts[1:], len(docs)), np.maximum.reduceat(weights, starts)
        for j in range(sims.shape[1]):
            own, (weight, member) = self.labels[first + j], self.held[first + j]
            at = np.minimum(np.searchsorted(names, own), len(names) - 1)
            for i in np.flatnonzero((names[at] == own) & (most[at, j] >= weight)):
                t = at[i]
                # members of a label are in ascending order: of equal weights the smaller one has the higher score
                best = docs[starts[t] + weights[starts[t] : ends[t], j].argmax()]
                if most[t, j] > weight[i] or best < member[i]:
                    weight[i], member[i] = most[t, j], best
        yield from ()

    def rest(self) -> Iterator[pa.RecordBatch]:
        seen = [
            (q, r["label"], r["score"], r["position"], w, m)
            for q, rows, (weight, member) in zip(self.ids.tolist(), self.rows, self.held, strict=True)
            for r, w, m in zip(rows, weight.tolist(), member.tolist(), strict=True)
            if w > -np.inf
        ]
        columns = list(zip(*seen, strict=True)) if seen else [()] * 6
        kinds = {"query_id": pa.int64(), "label": pa.int64(), "score": pa.float64(), "position": pa.int32(), "weight": pa.float64(), "member": pa.int64()}
        yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(kinds.items(), columns, strict=True)})


def best_member_topk(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = QUERY_BLOCK, scale: float | None = None) -> DataFrame:
    """Labels by their best vector: (query_id, label, score, member, position).

    A task passes on its k best labels for each query. Labels that precede one in the task of its best vector precede it
    in the result as well, so the k best of all are among them, with their true scores; others can only seem worse.

    ``member`` is the vector of that score, the larger id if there are several. With a ``scale`` it is the one with the largest
    score * scale + doc_id, which need not have the best score: it is found in a second pass over the vectors, since
    another task than those that name a label may hold it. The k labels of a query go to every task, as its vector does.
    """

    def top(own: DataFrame) -> DataFrame:
        scored = _scores(own, vectors, lambda ids: _BestLabels(ids, k), "query_id long, label long, score double, member long")
        found = scored.groupBy("query_id", "label").agg(F.max(F.struct("score", "member")).alias("best"))
        found = found.select("query_id", "label", F.col("best.score").alias("score"), F.col("best.member").alias("member"))
        found = top_per_group(found, ["query_id"], [F.desc("score"), F.desc("label")], k)
        if scale is None:
            return found
        wanted: dict[int, list] = {}
        for row in found.select("query_id", "label", "score", "position").collect():
            wanted.setdefault(row["query_id"], []).append(row.asDict())
        kind = "query_id long, label long, score double, position int, weight double, member long"
        members = _scores(own, vectors, lambda ids: _BestMembers(ids, wanted, scale), kind)
        best = F.min(F.struct(-F.col("weight"), "member"))["member"].alias("member")
        members = members.groupBy("query_id", "label", "score", "position").agg(best)
        return members.select("query_id", "label", "score", "member", "position")

    return _blocked(queries, top, block)


def phrase_matches(queries: DataFrame, phrases: DataFrame, least: float = FAST_PATH_SHARE, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, doc_id, strength): the best share of a document's phrase (doc_id, phrase) that a query holds.

    A phrase is one row and meets all queries where it is read; only matches leave the task.
    """
    terms = index_terms(F.col("phrase"))
    rows = phrases.select(F.col("doc_id").cast("long").alias("doc_id"), terms.alias("terms")).where("size(terms) > 0")

    def top(own: DataFrame) -> DataFrame:
        words = own.select("query_id", F.explode(index_terms(F.col("text"))).alias("term"), F.lit(1.0).alias("weight"))
        asked = _Asked(words.collect())

        def match(batches):
            known: dict[str, int] = {}
            for batch in _parts(batches):
                column, docs = batch.column(1), batch.column(0).to_numpy()
                sizes = np.diff(column.offsets.to_numpy())
                row, term, _ = asked.counts(column, str, known)
                n = asked.starts[term + 1] - asked.starts[term]
                to = asked.query[np.repeat(asked.starts[term] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                row = np.repeat(row, n)
                for first in range(0, len(asked.ids), QUERY_SLICE):
                    width = min(QUERY_SLICE, len(asked.ids) - first)
                    here = (to >= first) & (to < first + width)
                    counts = np.bincount(row[here] * width + to[here] - first, minlength=len(docs) * width).reshape(len(docs), width)
                    line, query = np.nonzero((counts > 0) & (counts / sizes[:, None] >= least))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": pa.array(asked.ids[first + query]),
                            "doc_id": pa.array(docs[line]),
                            "share": pa.array(counts[line, query] / sizes[line]),
                        }
                    )

        found = rows.mapInArrow(match, "query_id long, doc_id long, share double")
        return found.groupBy("query_id", "doc_id").agg(F.round(F.max("share"), 6).alias("strength"))

    return _blocked(queries, top, block)


def rrf(lanes: list[tuple[DataFrame, float]], k: int = PLAIN_K) -> DataFrame:
    """(query_id, doc_id, fused, first): weighted reciprocal ranks summed over lanes, and the best position."""
    parts = [d.select("query_id", "doc_id", "position", (F.lit(float(w)) / (k + F.col("position"))).alias("part")) for d, w in lanes]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("fused"), F.min("position").alias("first"))


def hybrid_search(
    lexical: DataFrame,
    dense: DataFrame,
    tools: DataFrame,
    fast: DataFrame,
    docs: DataFrame,
    k: int = 10,
) -> DataFrame:
    """Weighted fusion of the lanes over documents (doc_id, content_hash, meaningfulness, risk, eligible).

    lexical, dense and tools are ranked lanes, fast holds phrase strengths. Copies of a content collapse to the most
    meaningful one, then the larger doc_id. All but one of the k places are for documents with a similarity; the last may
    go to one without. Result: query_id, doc_id, similarity, rank, position.
    """
    none = F.lit(None).cast("double")
    parts = [
        lexical.select("query_id", "doc_id", (LEXICAL_WEIGHT / (HYBRID_K + F.col("position"))).alias("part"), none.alias("similarity")),
        *[
            lane.select("query_id", "doc_id", (DENSE_WEIGHT / (HYBRID_K + F.col("position"))).alias("part"), F.col("score").alias("similarity"))
            for lane in (dense, tools)
        ],
        fast.select("query_id", "doc_id", (FAST_PATH_BOOST * F.col("strength")).alias("part"), none.alias("similarity")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    fused = cut(union.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("fused"), F.max("similarity").alias("similarity")))
    # only candidates are judged; hashes of other texts are not computed
    docs = docs.join(sized(fused.select("doc_id").distinct()), "doc_id", "left_semi")
    rows = fused.join(docs.where("eligible"), "doc_id")
    # copies: at most the depth of the lanes per query, so a window over a query is bounded
    best = F.struct("meaningfulness", "doc_id", "fused", "similarity", "risk")
    rows = rows.groupBy("query_id", "content_hash").agg(F.max(best).alias("best")).select("query_id", "best.*")
    known = F.col("similarity").isNotNull()
    rows = top_per_group(rows.withColumn("known", known), ["query_id", "known"], [F.desc("fused"), F.desc("doc_id")], k)
    counts = rows.groupBy("query_id").agg(F.count_if(~F.col("known")).alias("pending"))
    rows = rows.join(counts, "query_id")
    places = F.when((F.col("pending") > 0) & F.lit(k >= 2), F.lit(k - 1)).otherwise(F.lit(k))
    rows = rows.where((F.col("known") & (F.col("position") <= places)) | (~F.col("known") & (F.col("position") <= 1))).drop("position")
    rank = F.round(F.col("fused") + 0.006 * F.col("meaningfulness") - 0.01 * F.least("risk", F.lit(2)), 9)
    rows = rows.withColumn("rank", rank)
    order = [F.col("known").desc(), F.desc("rank"), F.desc("doc_id")]
    return top_per_group(rows, ["query_id"], order, k).select("query_id", "doc_id", "similarity", "rank", "position")


def route_score(rank: Column, lexical: Column, record: Column, quality: Column, feedback: Column, meaning: Column, penalty: Column) -> Column:
    """The additive score of reranking; a quality of 0 or null counts as 50, feedback defaults to neutral."""
    quality = F.when(F.coalesce(quality, F.lit(0)) == 0, F.lit(50)).otherwise(quality) / 100
    score = rank + 0.001 * lexical + 0.002 * F.least(record, F.lit(6)) + 0.01 * quality
    return F.round(score + 0.01 * (F.coalesce(feedback, F.lit(0.5)) - 0.5) + 0.003 * meaning - penalty, 6)


def rerank(candidates: DataFrame, k: int = 100) -> DataFrame:
    """Candidates with route_score and platform_mismatch in delivery order: mismatches last, then by score."""
    order = [F.col("platform_mismatch").asc(), F.desc("route_score"), F.desc("meaningfulness"), F.desc("doc_id")]
    return top_per_group(candidates, ["query_id"], order, k)


def delivery_tier(ranked: DataFrame, least_quality: int = 60, least_meaning: float = 0.35) -> DataFrame:
    """(query_id, doc_id, tier) of the first candidate of each query: none, hint or full.

    ranked: query_id, doc_id, position, similarity, meaningfulness, quality, risk, lexical_overlap, platform_mismatch,
    trusted, active. The runner-up is the next candidate that isn't mismatched.
    """
    top = ranked.where("position = 1")
    runner = ranked.where("position > 1 and not platform_mismatch").groupBy("query_id")
    runner = runner.agg(F.min(F.struct("position", "similarity", "meaningfulness")).alias("runner"))
    top = top.join(runner, "query_id", "left")
    close = (F.col("similarity") - F.col("runner.similarity") < CLOSE_SIMILARITY) & (
        F.col("meaningfulness") - F.col("runner.meaningfulness") < CLOSE_MEANINGFULNESS
    )
    tier = (
        F.when(F.col("platform_mismatch") | ~F.col("active"), "hint")
        .when((F.col("quality") < least_quality) | (F.col("risk") > 0), "hint")
        .when((F.col("meaningfulness") < least_meaning) | ~F.col("trusted"), "hint")
        .when(F.col("similarity").isNull(), "hint")
        .when(F.col("similarity") < LEAST_SIMILARITY, "none")
        .when(F.col("lexical_overlap") < 2, "hint")
        .when(F.coalesce(close, F.lit(False)), "hint")
        .otherwise("full")
    )
    return top.select("query_id", "doc_id", tier.alias("tier"))
