import os

import pytest

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture
def docs_of(spark):
    """A table documents of (doc_id, text) or (doc_id, text, source), with columns that clash with the operators' own."""
    from pyspark.sql import functions as F

    clashing = ("size", "mark", "fp", "h", "copy", "slot", "n", "key", "id", "line", "shard", "first", "_d", "score")

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows]
        df = spark.createDataFrame(full, COLUMNS).repartition(3)
        return df.withColumns({c: F.lit("clash") for c in clashing})

    return make
