"""Tables of a relational database, read in parallel by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, url: str, table: str, lower: int, upper: int, parts: int = 32, key: str = "id", rows: int = 100, **options: str) -> DataFrame:
    """table between the keys lower and upper, a part to a connection, so many rows a fetch. The driver's jar must be on the class path."""
    return spark.read.options(**options).option("fetchsize", rows).jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)
