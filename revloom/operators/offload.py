"""Large values beside their table: the stored row has a reference, the value stands once in a table of its own.

A value that stands in many rows isn't shared, since a reference belongs to the key and revision that wrote it; both
tables are dealt by the key, and only stored rows with a reference meet the side table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 65_536


def _large(column: str, threshold: int) -> Column:
    return F.coalesce(F.octet_length(column) > threshold, F.lit(False))


def stored(rows: DataFrame, keys: list[str], column: str, threshold: int = THRESHOLD) -> DataFrame:
    """rows with `ref` behind them: the keys joined by '/' where the value is larger than the threshold in bytes, whose column is then null. A null value stays null, without a reference."""
    large = _large(column, threshold)
    return rows.withColumn("ref", F.when(large, F.concat_ws("/", *keys))).withColumn(column, F.when(~large, F.col(column)))


def side(rows: DataFrame, keys: list[str], column: str, threshold: int = THRESHOLD) -> DataFrame:
    """(ref, value) of the values larger than the threshold."""
    return rows.where(_large(column, threshold)).select(F.concat_ws("/", *keys).alias("ref"), F.col(column).alias("value"))


def hydrate(stored_rows: DataFrame, side_rows: DataFrame, column: str) -> DataFrame:
    """The rows with their values back; only those with a reference are joined, a reference without a value gives null."""
    found = stored_rows.where("ref IS NOT NULL").join(side_rows, "ref", "left").withColumn(column, F.col("value")).select(stored_rows.columns)
    return stored_rows.where("ref IS NULL").union(found).drop("ref")
