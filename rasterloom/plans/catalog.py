"""Queries over the reference tables and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.plans import config_queries, raster_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**raster_queries.QUERIES, **vector_queries.QUERIES, **config_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**raster_queries.ORACLE_SQL, **vector_queries.ORACLE_SQL, **config_queries.ORACLE_SQL}
