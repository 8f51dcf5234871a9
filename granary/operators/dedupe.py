"""Duplicates of records: by URL, by content, by metadata, and near copies among the candidates of a query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, strip
from .common import cut

ACTIVE = ["active", "metadata_only"]
#: What decides between copies, most important first and largest best; the id comes last.
CANONICAL = ["meaningfulness", "quality", "provenance", "prominence", "recency"]


def first_by_key(df: DataFrame, key: str, prefer: list[str]) -> DataFrame:
    """One row per key, that with the largest ``prefer``; rows with a null or empty key all stay."""
    rest = [c for c in df.columns if c not in (key, *prefer)]
    best = df.where(F.col(key) != "").groupBy(key).agg(F.max(F.struct(*prefer, *rest)).alias("best"))
    best = best.select(key, *[F.col(f"best.{c}").alias(c) for c in [*prefer, *rest]]).select(df.columns)
    return best.unionByName(df.where(F.col(key).isNull() | (F.col(key) == "")))


def mark_duplicates(df: DataFrame, key: str, order: list[str], id_col: str) -> DataFrame:
    """df with canonical_id (its own id for a row that stands) and status ``duplicate`` for the rows that lose within their key.

    Only rows of an active status take part. The winner has the largest ``order``, then the largest id.
    """
    part = F.col("status").isin(ACTIVE) & (F.col(key) != "")
    winner = df.where(part).groupBy(key).agg(F.max(F.struct(*order, id_col)).alias("best"))
    winner = winner.select(key, F.col(f"best.{id_col}").alias("winner"))
    rows = df.join(winner, key, "left")
    loses = part & (F.col(id_col) != F.col("winner"))
    return rows.select(
        *[c for c in df.columns if c != "status"],
        F.when(loses, "duplicate").otherwise(F.col("status")).alias("status"),
        F.when(loses, F.col("winner")).otherwise(F.col(id_col)).alias("canonical_id"),
    )


def canonical_pick(df: DataFrame, group: list[str], position: str, order: list[str], id_col: str) -> DataFrame:
    """(group, id, position, group_size): the best row of each group at the place of its first member."""
    return (
        df.groupBy(*group)
        .agg(
            F.max(F.struct(*order, id_col)).alias("best"),
            F.min(position).alias(position),
            F.count("*").alias("group_size"),
        )
        .select(*group, F.col(f"best.{id_col}").alias(id_col), position, "group_size")
    )


def metadata_key(name: Column, description: Column) -> Column:
    """Name and description without regard to case and spacing; empty if either is."""
    flat = [F.lower(collapse(strip(F.coalesce(c, F.lit(""))))) for c in (name, description)]
    return F.when((flat[0] == "") | (flat[1] == ""), F.lit("")).otherwise(F.concat_ws("\x1f", *flat))


def collapsed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ranked candidates (query_id, doc_id, position, ...) with the best of each key at the place of its first member.

    An empty key collapses with nothing. The best has the largest ``order``, then the largest doc_id.
    """
    rest = [c for c in rows.columns if c not in ("query_id", "doc_id", "position", *order)]
    own = F.when(F.col(key) == "", F.concat(F.lit("id"), F.col("doc_id"))).otherwise(F.concat(F.lit("key"), F.col(key)))
    best = rows.groupBy("query_id", own.alias("own")).agg(
        F.max_by(F.struct(*order, "doc_id", *rest), F.struct(*order, "doc_id")).alias("best"), F.min("position").alias("position")
    )
    return best.select("query_id", "best.*", "position").select(rows.columns)


def greedy_near_duplicates(candidates: DataFrame, least: float = 0.8, least_named: int = 2, least_described: float = 0.5) -> DataFrame:
    """Candidates grouped in rank order: (query_id, doc_id, leader, group_size).

    candidates: query_id, doc_id, position, tokens, name_tokens, description_tokens, platforms (arrays of distinct values).
    A candidate joins the first group whose first member is not of other platforms only and shares enough of all tokens,
    or two words of the name and half of the description. Groups depend on the order, so a query is one unit of work;
    its candidates are the bounded output of a top-k.
    """
    columns = ["tokens", "name_tokens", "description_tokens", "platforms"]

    def share(a: set, b: set) -> float:
        return len(a & b) / max(1, len(a | b))

    def alike(a: tuple, b: tuple) -> bool:
        if a[3] and b[3] and not a[3] & b[3]:
            return False
        return share(a[0], b[0]) >= least or (len(a[1] & b[1]) >= least_named and share(a[2], b[2]) >= least_described)

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        leaders: list[tuple[int, tuple]] = []
        chosen = []
        for doc, *parts in zip(rows["doc_id"], *(rows[c] for c in columns), strict=True):
            own = tuple(set(p) for p in parts)
            leader = next((name for name, other in leaders if alike(own, other)), None)
            if leader is None:
                leader = doc
                leaders.append((doc, own))
            chosen.append(leader)
        out = pd.DataFrame({"query_id": rows["query_id"], "doc_id": rows["doc_id"], "leader": chosen})
        out["group_size"] = out.groupby("leader")["doc_id"].transform("size")
        return out

    rows = candidates.select("query_id", "doc_id", "position", *columns)
    return rows.groupBy("query_id").applyInPandas(group, "query_id long, doc_id long, leader long, group_size long")


def three_stage_dedupe(rows: DataFrame, order: list[str]) -> DataFrame:
    """(query_id, doc_id, position, duplicate_group_size) of ranked candidates: copies, equal metadata, then near copies collapse.

    rows: as for greedy_near_duplicates, with content_hash, metadata_key and ``order``. Places are counted anew after the
    first two stages; a group stands at the place of its first member and shows its best one.
    """
    left = collapsed(collapsed(rows, "content_hash", order), "metadata_key", order)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("position")).cast("long")
    left = cut(left.withColumn("position", place))
    grouped = greedy_near_duplicates(left).select("query_id", "doc_id", "leader").join(left, ["query_id", "doc_id"])
    best = grouped.groupBy("query_id", "leader").agg(
        F.max(F.struct(*order, "doc_id")).alias("best"), F.min("position").alias("position"), F.count("*").alias("duplicate_group_size")
    )
    return best.select("query_id", F.col("best.doc_id").alias("doc_id"), "position", "duplicate_group_size")
