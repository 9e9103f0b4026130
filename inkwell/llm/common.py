"""What several operators share: written tables, word counts, copies, components."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words; everything else is part of a word.
BLANKS = r"[ \t\n\x0B\f\r]+"
#: Copies of one row that a single task writes out.
COPIES_PER_TASK = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of our own, on a single machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or _own_dir()


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="inkwell-")


def cut(df: DataFrame, free: bool = False, small: bool = False) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors cost nothing.

    small: few rows are left of many, so they are moved together first and not written as a file for each task.
    The shuffle files it took are deleted once the driver collects its garbage; free has it do so now.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}"
    (df.hint("rebalance") if small else df).write.parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what cut wrote for df; nothing that is still to be computed may read it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(spark: SparkSession) -> int:
    """Partitions of a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    plain = F.coalesce(text, F.lit(""))
    edge = lambda rx: F.when(plain.rlike(rx), 1).otherwise(0)
    parts = F.size(F.split(plain, BLANKS))
    return F.when(F.length(plain) == 0, 0).otherwise(parts - edge(r"^[ \t\n\x0B\f\r]") - edge(r"[ \t\n\x0B\f\r]\z")).cast("long")


def copies(df: DataFrame, n: str, copy: str) -> DataFrame:
    """Each row n times, numbered from 0 in column copy. A row with very many copies is spread over tasks."""
    each = F.lit(COPIES_PER_TASK)
    few = df.where(F.col(n) <= each).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    many = (
        df.where(F.col(n) > each)
        .withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / each))))
        .repartition(spread(df.sparkSession), "_lot")
        .withColumn(copy, F.explode(F.sequence(F.col("_lot") * each, F.least(F.col("_lot") * each + each, F.col(n)) - 1)))
        .drop("_lot")
    )
    return few.unionByName(many)


def running_starts(df: DataFrame, group: list[str], bucket: str, order: list[str], amount: str, start: str) -> DataFrame:
    """Adds start: the sum of amount over all rows before, within group, by (bucket, order).

    A group of any size is cut into its buckets: each is summed by itself, and only one sum
    per bucket is carried over. No task holds more than a bucket, or one row per bucket.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_sum"))
    sums = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(outer), zero).alias("_base"))
    joined = df.withColumn("_in", F.coalesce(F.sum(amount).over(inner), zero)).alias("l")
    other = sums.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*group, bucket)]
    return joined.join(other, same).select("l.*", (F.col("l._in") + F.col("r._base")).alias(start)).drop("_in")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of a link, the smallest node that can be reached from it.

    Alternating large-star and small-star steps (Kiveris et al. 2014). A hub's links
    stay rows throughout; each step is a grouped minimum and a join, written to the shared
    folder, so nothing of the graph is collected. Ends when a round changes no link.
    """

    def symmetric(e: DataFrame) -> DataFrame:
        return e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def seen(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    links = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = seen(edges)
    while True:
        both = symmetric(edges)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = seen(edges)
        if now == state:
            break
        state = now
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
