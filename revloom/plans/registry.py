"""Every query of the engine by name, and the oracle of each that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revloom.plans import client_queries, declarative, kernel_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = declarative.QUERIES | kernel_queries.QUERIES | client_queries.QUERIES
ORACLES: dict[str, str] = declarative.ORACLES | kernel_queries.ORACLES | client_queries.ORACLES
