"""Driver tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash
from ..operators.common import prepared


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def routes(spark: SparkSession, folder: str) -> DataFrame:
    """events as (event_id, ts, user_id, item_id, family, outcome, latency)."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "used").when(kind == "signup", "installed").when(kind == "error", "failed").when(kind == "view", "dismissed")
    return table(spark, folder, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        F.col("event_type").alias("family"),
        outcome.alias("outcome"),
        F.col("value").alias("latency"),
    )


ROUTES = """routes as (
  select event_id, ts, user_id, json_extract_string(props, '$.k')::bigint as item_id, event_type as family,
         case event_type when 'purchase' then 'used' when 'signup' then 'installed' when 'error' then 'failed' when 'view' then 'dismissed' end as outcome,
         value as latency
  from events
)"""


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """benchmark as (query_id, text)."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """documents with the judgements that routing needs."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    n = F.col("n_chars")
    quality = F.when(n > 800, 80).when(n > 200, 65).otherwise(40)
    provenance = F.when(F.col("source").endswith("0"), 0.9).when(F.col("source").endswith("5"), 0.6).otherwise(0.25)
    prominence = F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log(F.lit(100001.0)))
    return docs.select(
        "doc_id",
        "text",
        "source",
        "lang",
        content_hash(F.col("text")).alias("content_hash"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("eligible"),
        F.coalesce("toxic", F.lit(0)).alias("risk"),
        quality.alias("quality"),
        F.round(0.55 * quality / 100 + 0.2 * provenance + 0.15 * prominence + 0.1 * 0.5, 6).alias("meaningfulness"),
        provenance.alias("provenance"),
        F.round(prominence, 6).alias("prominence"),
        F.expr("date_add(date'2024-01-01', cast(doc_id % 365 as int))").alias("recency"),
    )


def corpus_sql(content_hash_sql: str) -> str:
    return f"""corpus as (
  select * replace (round(prominence, 6) as prominence), round(0.55 * quality / 100 + 0.2 * provenance + 0.15 * prominence + 0.1 * 0.5, 6) as meaningfulness from (
    select d.doc_id, text, source, lang, {content_hash_sql} as content_hash, coalesce(quality, 1) = 1 as eligible, coalesce(toxic, 0) as risk,
           case when n_chars > 800 then 80 when n_chars > 200 then 65 else 40 end as quality,
           least(1.0, ln(1 + n_chars::double) / ln(100001.0::double)) as prominence,
           case when source like '%0' then 0.9::double when source like '%5' then 0.6::double else 0.25::double end as provenance,
           date '2024-01-01' + (doc_id % 365)::int as recency
    from documents d left join labels l using (doc_id)
  )
)"""


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """embeddings as (doc_id, embedding, label)."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("long").alias("label"))
