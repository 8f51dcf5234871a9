"""All named queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import case_queries, contract_queries, evaluation_queries, event_queries, feed_queries, intent_queries, load_queries, package_queries, quality_queries, retrieval_queries, store_queries, text_queries

FLAGSHIP = "hybrid_search"
_ALL = {
    **retrieval_queries.QUERIES,
    **text_queries.QUERIES,
    **quality_queries.QUERIES,
    **intent_queries.QUERIES,
    **package_queries.QUERIES,
    **event_queries.QUERIES,
    **feed_queries.QUERIES,
    **store_queries.QUERIES,
    **load_queries.QUERIES,
    **contract_queries.QUERIES,
    **case_queries.QUERIES,
    **evaluation_queries.QUERIES,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
