"""As-of joins: for each row the last row of another table that came before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], ts: str, tie: str, columns: list[str], part: Callable[[Column], Column]) -> DataFrame:
    """left with ``found_<column>`` of the last row of right that has its keys and is not later than it, or nulls.

    Both tables have the keys and ``ts``; right also ``tie``, which orders its rows of one time, and ``columns``. ``part``
    gives the part of a time (a value that grows with it), so that a busy key is many tasks: within a part rows are
    windowed together, and the last row of right in each part is handed on to the parts after it, of which each key has few
    rows. Rows of left with a null key or time find nothing; each row of left stays once.
    """
    names = [F.col(c) for c in keys]
    own = left.select(*names, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*left.columns).alias("_row"))
    place = F.struct(F.col(ts).alias("at"), F.col(tie).alias("tie"), *columns)
    given = right.dropna(subset=[*keys, ts]).select(*names, F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), place.alias("_place"))
    both = own.unionByName(given, allowMissingColumns=True).withColumn("_part", part(F.col("_at")))
    last = both.groupBy(*keys, "_part").agg(F.max("_place").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.withColumn("_handed", F.last("_last", ignorenulls=True).over(earlier)).where("_handed is not null").drop("_last")
    within = Window.partitionBy(*keys, "_part").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_place", F.last("_place", ignorenulls=True).over(within)).where("_side = 1")
    out = both.join(handed, [*keys, "_part"], "left")
    known = F.when(F.col("_at").isNotNull(), F.coalesce("_place", "_handed"))
    return out.select("_row.*", *[known[c].alias(f"found_{c}") for c in columns])

