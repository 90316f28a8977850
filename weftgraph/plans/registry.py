"""Registry of the library's queries and of the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans import construct_queries, function_queries, graph_queries, table_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["bgp_chain3"](spark, sf_dir)


def queries() -> dict:
    return table_queries.queries() | function_queries.queries() | graph_queries.queries() | construct_queries.queries()


def oracle_sql() -> dict:
    return table_queries.oracle_sql() | function_queries.oracle_sql() | graph_queries.oracle_sql() | construct_queries.oracle_sql()
