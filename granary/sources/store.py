"""Tables: filtered scans, upserts, updates, deletes, version history, deltas, JSON lines and content blobs.

Every sink returns a DataFrame of the new state; the caller writes it. Plain Parquet has no merge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin([x.strip() for x in v.strip("()").split(",")]),
}


def predicate(column: str, expression: str) -> Column:
    """A filter like ``gt.5``, ``not.in.(a,b)``, ``is.null`` or a bare value for equality.

    Unknown operators are refused; the system that this language comes from lets them match everything.
    """
    negated = expression.startswith("not.")
    expression = expression[4:] if negated else expression
    name, dot, value = expression.partition(".")
    c = F.col(column)
    if expression == "is.null":
        out = c.isNull()
    elif dot and name in OPERATORS:
        out = OPERATORS[name](c, value)
    elif dot and name.isalpha() and name.islower() and len(name) <= 5:
        raise ValueError(f"unknown operator {name!r}")
    else:
        out = c == expression
    return ~out if negated else out


def scan(
    df: DataFrame,
    columns: list[str] | None = None,
    filters: dict[str, str] | None = None,
    order: list[Column] | None = None,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Filter, order, page, project; ordering puts nulls first when ascending."""
    for column, expression in (filters or {}).items():
        df = df.where(predicate(column, expression))
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*columns) if columns else df


def upsert(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current with the rows of incoming merged by key. Columns that incoming lacks keep their values."""
    new = incoming.select(*[F.col(c).alias(f"new_{c}") for c in incoming.columns], F.lit(True).alias("given"))
    both = current.join(new, current[key] == new[f"new_{key}"], "full")
    out = []
    for c in current.columns:
        own = current[c]
        if c == key:
            own = F.coalesce(own, F.col(f"new_{c}"))
        elif c in incoming.columns:
            own = F.when(F.col("given"), F.col(f"new_{c}")).otherwise(own)
        out.append(own.alias(c))
    return both.select(*out)


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~F.coalesce(where, F.lit(False)))


def append_events(events: DataFrame, allowed: dict[str, list | None], cutoff: Column, expiring: list[str]) -> DataFrame:
    """The allowed columns only; values outside a column's enumeration and expired identifiers become null."""
    out = []
    for c, values in allowed.items():
        col = F.col(c) if c in events.columns else F.lit(None).cast("string")
        if values is not None:
            col = F.when(col.isin(values), col)
        if c in expiring:
            col = F.when(F.col("ts") >= cutoff, col)
        out.append(col.alias(c))
    return events.select(*out)


def versions(rows: DataFrame, key: str, digest: str, seen: str) -> DataFrame:
    """Each (key, digest) once, with the time when it was first seen."""
    return rows.groupBy(key, digest).agg(F.min(seen).alias("first_seen"))


def delta_plan(current: DataFrame, incoming: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """incoming's keys with insert, update or unchanged; nulls compare as values."""
    old = current.select(F.col(key), F.lit(True).alias("exists"), *[F.col(c).alias(f"old_{c}") for c in compare])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in compare])
    status = F.when(F.col("exists").isNull(), "insert").when(same, "unchanged").otherwise("update")
    return incoming.join(old, key, "left").select(key, status.alias("status"))


def change_alerts(watches: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Watched rows whose digest isn't the one last seen; never seen counts as empty."""
    return watches.join(current, key).where(F.coalesce("last_seen", F.lit("")) != F.col(digest))


def orphans(index: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return index.join(table.select(key), key, "left_anti")


def routing_filter(df: DataFrame, key: str, blocked: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Rows that aren't blocked and, if an allowlist has rows, are on it. Blocking wins."""
    out = df.join(blocked.select(key), key, "left_anti")
    if allowed is not None and not allowed.isEmpty():
        out = out.join(allowed.select(key), key, "left_semi")
    return out


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that doesn't depend on order; two tables with equal rows have equal digests."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("digest"))


def read_json_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank lines and ``#`` comments; a malformed line fails the read."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def export_delta(df: DataFrame, path: str) -> DataFrame:
    """Writes gzipped JSON lines and returns the manifest: (file, sha256, bytes)."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def pack_blobs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(digest, n_keys, first_key, bytes): contents stored once; keys are counted, not gathered."""
    digest = F.sha2(F.encode(text, "UTF-8"), 256).alias("digest")
    return df.groupBy(digest).agg(
        F.count("*").alias("n_keys"), F.min(key).alias("first_key"), F.max(F.octet_length(text)).cast("long").alias("bytes")
    )


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """df with the columns that an older table lacks."""
    return df.select("*", *[v.alias(c) for c, v in defaults.items() if c not in df.columns])
