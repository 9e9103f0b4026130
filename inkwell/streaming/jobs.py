"""Structured Streaming: messages against what is known, idempotent upserts, and the query log.

Each job runs over what there is and ends; the checkpoint stands in for receipts, so a batch that fails is done again,
and doing it again changes nothing. Batches are put beside the table, each by its number, and merged into it once, when the job ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls as U
from ..operators import ingest
from ..sources.store import Store


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """A Parquet table, of one file or a folder, as a stream."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if fs.getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands every batch to each until there are no more."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def collect_new(urls: DataFrame, store: Store, name: str, seen: DataFrame, checkpoint: str) -> DataFrame:
    """stripped_url, url: the first address of each stripped form that isn't in seen; those go to the table name."""
    schema = "stripped_url string, url string"

    def each(batch: DataFrame, n: int) -> None:
        keyed = batch.where(F.col("url").isNotNull()).select(U.stripped(F.col("url")).alias("stripped_url"), "url")
        fresh = keyed.join(seen, "stripped_url", "left_anti").groupBy("stripped_url").agg(F.min("url").alias("url"))
        store.put(name, n, fresh)

    run(urls, each, checkpoint)
    store.merge(name, schema, lambda rows: rows.groupBy("stripped_url").agg(F.min("url").alias("url")))
    return store.read(name, schema)


def upsert_stream(rows: DataFrame, store: Store, name: str, key: str, seq: str, checkpoint: str) -> DataFrame:
    """The table name with the row of the largest seq per key; later batches win only with a larger seq, so a repeated batch is harmless."""
    schema = rows.schema

    def each(batch: DataFrame, n: int) -> None:
        store.put(name, n, ingest.last_by(batch, key, seq))

    run(rows, each, checkpoint)
    store.merge(name, schema, lambda found: ingest.last_by(found, key, seq))
    return store.read(name, schema)


def append_log(requests: DataFrame, path: str, checkpoint: str) -> None:
    """Requests as they come, appended as Parquet."""
    requests.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
