"""The work queue as a folder of JSON messages; offsets and checkpoints take the place of leases and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schemas import MESSAGE


MOST = 30


def parts(urls: DataFrame, group: str, url: str = "url", most: int = MOST) -> DataFrame:
    """group, part, message: the addresses of each group as JSON, in order, so many to a part, counted from 0; a group without any has none."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(url)) - 1
    numbered = urls.where(F.col(url).isNotNull()).select(group, url, F.floor(place / most).cast("int").alias("part"))
    listed = numbered.groupBy(group, "part").agg(F.sort_array(F.collect_list(url)).alias("urls"))
    return listed.select(group, "part", F.to_json(F.struct("urls")).alias("message"))


def messages(urls: DataFrame, group: str, url: str = "url", most: int = MOST) -> DataFrame:
    """group, message: as parts, each a message of its own."""
    return parts(urls, group, url, most).drop("part")


def send(found: DataFrame, path: str) -> None:
    found.select(F.col("message").alias("value")).write.mode("append").text(path)


def purge(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], "value string").write.mode("overwrite").text(path)


def decoded(found: DataFrame, column: str = "value") -> DataFrame:
    """urls of each message that can be read."""
    return found.select(F.from_json(column, MESSAGE).getField("urls").alias("urls")).where(F.size("urls") > 0)


def receive(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.text(path))


def depth(spark: SparkSession, path: str) -> int:
    return receive(spark, path).count()


def peek(spark: SparkSession, path: str) -> list[str] | None:
    first = receive(spark, path).first()
    return first and list(first.urls)


def stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """urls of the messages as they come in."""
    return decoded(spark.readStream.option("maxFilesPerTrigger", files).text(path))


def lease_seconds(urls: Column) -> Column:
    """Time a worker needs for a message."""
    return seconds_for(F.size(urls))


def seconds_for(n: Column) -> Column:
    """Time a worker needs for so many addresses under one lease."""
    return F.greatest(F.lit(300), 20 * n + 60).cast("int")
