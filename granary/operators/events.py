"""Event analytics: summaries, order statistics, engagement, feedback, usage and experiments.

Events are (event_id, ts, user_id, item_id, family, outcome, latency). "Now" is always an argument or the newest event,
never the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import order_statistics, sized, top_per_group, value_at, with_previous

POSITIVE, NEGATIVE = ["used", "installed"], ["failed", "dismissed"]
REROUTE_SECONDS = 300
LEAST_FEEDBACK, PRIOR_STRENGTH, PRIOR_MEAN = 8, 8.0, 0.5


def nearest_rank(p: float) -> Column:
    """0-based place of the percentile, rounded half to even."""
    return F.rint((F.col("rows") - 1) * F.lit(p))


def ceiling_rank(p: float) -> Column:
    return F.ceil(F.col("rows") * F.lit(p)) - 1


def percentiles(df: DataFrame, group: list[str], value: str, points: dict[str, Column]) -> DataFrame:
    """(group, one column per name): order statistics at the given places, exact and without gathering a group."""
    ranked = order_statistics(df, group, value)
    wanted = ranked.groupBy(*group).agg(F.max("upto").alias("rows"))
    ranked = ranked.join(sized(wanted), group)
    found = [
        F.max(F.when((F.col("below") <= at.cast("long")) & (at.cast("long") < F.col("upto")), F.col(value))).alias(name)
        for name, at in points.items()
    ]
    return ranked.groupBy(*group).agg(*found)


def linear_percentile(df: DataFrame, group: list[str], value: str, p: float, name: str) -> DataFrame:
    """Between the two nearest ranks, weighted by distance."""
    at = (F.col("rows") - 1) * F.lit(p)
    both = percentiles(df, group, value, {"lo": F.floor(at), "hi": F.ceil(at)})
    sizes = df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("rows"))
    out = both.join(sizes, group)
    weight = at - F.floor(at)
    return out.select(*group, (F.col("lo") + (F.col("hi") - F.col("lo")) * weight).alias(name))


def event_summary(events: DataFrame, budget: float) -> DataFrame:
    """One row of totals; averages are cut to whole numbers and nulls count as 0 in breaches, not in averages."""
    value = F.coalesce("latency", F.lit(0.0))
    return events.agg(
        F.count("*").alias("total"),
        F.countDistinct("user_id").alias("users"),
        F.count_if(F.col("outcome").isNull()).alias("pending"),
        F.count_if(F.col("outcome").isin(POSITIVE)).alias("positive"),
        F.countDistinct(F.when(F.col("outcome").isin(NEGATIVE), F.col("item_id"))).alias("items_with_negatives"),
        F.coalesce(F.avg("latency"), F.lit(0.0)).cast("long").alias("avg_latency"),
        F.coalesce(F.max("latency"), F.lit(0.0)).cast("long").alias("max_latency"),
        F.count_if(value > budget).alias("breaches"),
    )


def outcome_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("outcome", F.lit("pending")).alias("outcome")).agg(F.count("*").alias("n"))


def top_items(events: DataFrame, k: int = 10) -> DataFrame:
    """The k items with most events, then most positive outcomes, then the smallest id."""
    rows = events.groupBy("item_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("outcome").isNotNull()).alias("feedback"),
        F.count_if(F.col("outcome").isin(POSITIVE)).alias("positive"),
        F.avg("latency").cast("long").alias("avg_latency"),
    )
    return rows.orderBy(F.desc("n"), F.desc("positive"), "item_id").limit(k)


def slowest(events: DataFrame, k: int = 5) -> DataFrame:
    return events.select("event_id", "family", "item_id", "latency").orderBy(F.desc("latency"), "event_id").limit(k)


def impact_report(events: DataFrame) -> DataFrame:
    """Per user: events, families, delivered items never installed, share of raw size saved, mean latency."""
    delivered = events.where("outcome is null or outcome <> 'installed'").select("user_id", "item_id").distinct()
    installed = events.where("outcome = 'installed'").select("user_id", "item_id").distinct()
    open_items = delivered.join(installed, ["user_id", "item_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("undiscovered"))
    totals = events.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.countDistinct("family").alias("families"),
        F.round(F.count_if(F.col("latency") <= 50) / F.count("*"), 6).alias("within_budget"),
        F.round(F.avg("latency"), 9).alias("avg_latency"),
    )
    return totals.join(open_items, "user_id", "left").withColumn("undiscovered", F.coalesce("undiscovered", F.lit(0)))


def reused_items(events: DataFrame) -> DataFrame:
    """Per user the number of items with more than one event."""
    per_item = events.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
    return per_item.where("n > 1").groupBy("user_id").agg(F.count("*").alias("reused_items"))


def returning_families(events: DataFrame) -> DataFrame:
    """Per user the number of families seen on more than one day."""
    days = events.groupBy("user_id", "family").agg(F.countDistinct(F.to_date("ts")).alias("days"))
    return days.where("days > 1").groupBy("user_id").agg(F.count("*").alias("returning_families"))


def engagement(events: DataFrame, seconds: int = REROUTE_SECONDS) -> DataFrame:
    """Per user: events soon after one of the same family, events on the day of the one before, rejections."""
    rows = with_previous(events, "user_id", "ts", "event_id", ["family"], F.date_trunc("day", "ts"))
    gap = F.unix_micros("ts") - F.unix_micros("prev_ts")
    soon = (gap <= seconds * 1_000_000) & (F.col("family") == F.col("prev_family"))
    return rows.groupBy("user_id").agg(
        F.count_if(soon).alias("reroutes"),
        F.count_if(F.to_date("ts") == F.to_date("prev_ts")).alias("continuations"),
        F.count_if(F.col("outcome").isin(NEGATIVE)).alias("rejections"),
    )


def feedback_scores(events: DataFrame, items: DataFrame) -> DataFrame:
    """Items (item_id, content_hash) with feedback: outcomes pooled per content, shrunk towards the neutral prior.

    Fewer than LEAST_FEEDBACK outcomes leave a content at the prior; contents without events have a null.
    """
    counts = events.groupBy("item_id").agg(
        F.count_if(F.col("outcome").isin(POSITIVE)).alias("pos"), F.count_if(F.col("outcome").isin(NEGATIVE)).alias("neg")
    )
    pooled = counts.join(items.where("content_hash <> ''"), "item_id").groupBy("content_hash")
    pooled = pooled.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = F.col("pos") + F.col("neg")
    shrunk = (F.col("pos") + PRIOR_STRENGTH * PRIOR_MEAN) / (n + PRIOR_STRENGTH)
    pooled = pooled.select("content_hash", F.round(F.when(n < LEAST_FEEDBACK, PRIOR_MEAN).otherwise(shrunk), 9).alias("feedback"))
    return items.join(pooled, "content_hash", "left").select("item_id", "feedback")


def concentration(events: DataFrame) -> DataFrame:
    """One row: items, largest share, Herfindahl index and entropy in bits of the shares of items."""
    counts = events.groupBy("item_id").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.crossJoin(F.broadcast(total)).agg(
        F.count("*").alias("items"),
        F.round(F.max(share), 9).alias("largest"),
        F.round(F.sum(share * share), 9).alias("hhi"),
        F.round(-F.sum(share * F.log2(share)), 9).alias("entropy_bits"),
    )


def bandit_weights(events: DataFrame, least: int = 5) -> DataFrame:
    """Per item: Beta(1, 1) posterior of success, observations, and the weight used (its family's mean if too few)."""
    success = F.count_if(F.col("outcome").isin(POSITIVE))
    failure = F.count_if(F.col("outcome").isin(NEGATIVE))
    own = events.groupBy("item_id", "family").agg(success.alias("s"), failure.alias("f"))
    family = own.groupBy("family").agg(((F.sum("s") + 1) / (F.sum("s") + F.sum("f") + 2)).alias("family_mean"))
    n = F.col("s") + F.col("f")
    mean = (F.col("s") + 1) / (n + 2)
    rows = own.join(sized(family), "family")
    return rows.select(
        "item_id",
        "family",
        n.alias("observations"),
        F.round(mean, 9).alias("posterior"),
        F.round(F.when(n >= least, mean).otherwise(F.col("family_mean")), 9).alias("weight"),
    )


def personalised_order(scored: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """The k best items (item_id, score) per family after the score is moved by up to 15 percent by its weight."""
    rows = scored.join(weights, "item_id").withColumn("personal", F.round(F.col("score") * (1 + 0.3 * (F.col("weight") - 0.5)), 9))
    top = top_per_group(rows, ["family"], [F.desc("personal"), "item_id"], k)
    return top.select("family", "item_id", "personal", "position")


def latest_per_key(df: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each key; an aggregate, so a hot key is reduced before the shuffle."""
    best = F.max(F.struct(*order, *[c for c in keep if c not in order])).alias("best")
    return df.groupBy(key).agg(best).select(key, *[F.col(f"best.{c}").alias(c) for c in keep])


def stale_rows(df: DataFrame, key: str, order: list[str], id_col: str) -> DataFrame:
    """Rows that aren't the newest of their key."""
    newest = latest_per_key(df, key, order, [id_col]).select(key, F.col(id_col).alias("newest"))
    return df.join(newest, key).where(F.col(id_col) != F.col("newest")).drop("newest")


def last_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return top_per_group(df, [key], order, n)


def windowed(events: DataFrame, hours: int) -> DataFrame:
    """Events of the last hours before the newest one."""
    newest = events.agg(F.max("ts").alias("newest"))
    return events.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.make_dt_interval(hours=F.lit(hours))).drop("newest")


__all__ = [name for name in dir() if not name.startswith("_")] + ["value_at"]
