"""From raw documents to shards: filter, de-duplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of documents. Nulls, empty texts, repeated rows and empty tables are treated as the operators' own
docstrings say. SQL can't express the stages; tests hold them against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, mixing, quality, sharding, simhash
from inkwell.llm.common import cut, table
from inkwell.llm.queries import SHARDS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash fingerprints of five-word shingles link: the one with the smallest id."""
    return simhash.keep_one(docs.select(*COLUMNS), words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that each output shard of the mix takes of each document, once for every time it takes them."""
    return mixing.mixed_texts(docs.select(*COLUMNS))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each mixed document goes."""
    return sharding.shard_documents(docs.select(*COLUMNS), sharding.balanced(SHARDS), sharding.balanced(SHARDS + 1))


STAGES = [
    ("quality classifier", filter_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", assign_shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
