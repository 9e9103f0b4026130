"""Gapless numbers in an order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4096


def in_order(rows: DataFrame, order: str, name: str, after: int = 0) -> DataFrame:
    """rows with column name: after + 1, after + 2, ... in the order of column order, nulls first.

    Bounds from a sample of the order's values cut it into as many ranges as a shuffle has partitions. Each range is numbered by
    itself and starts where those before it end; only bounds and counts, one for each range, come to the driver.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order)
    some = rows.select(key.alias("k")).where("k is not null").orderBy(F.xxhash64("k")).limit(SAMPLE)
    found = [r.k for r in some.orderBy("k").collect()]
    bounds = [found[i * len(found) // pieces] for i in range(1, pieces)] if len(found) >= pieces else []
    at = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)
    placed = rows.withColumn("_range", at)
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    starts = [after]
    for i in range(len(bounds)):
        starts.append(starts[-1] + counts.get(i, 0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_range") + 1)
    return placed.withColumn(name, (start + within).cast("long")).drop("_range")
