"""Registered operator queries against their SQL twins, and the driver contract."""

import pytest

from inkwell.llm import queries


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    c.execute("SET memory_limit = '2GB'")
    for t in ("documents", "embeddings", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = c.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(x) for x in columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=str) == want


def test_all_operators_are_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert [sum(x.startswith(f"op{n}_") for x in found) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in found and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_labels_of_an_id_with_many_texts(spark, docs_of):
    from inkwell.llm import quality

    rows = [(i, "good words here " * (i + 1)) for i in range(1, 40)] + [(3, f"junk {k} ###") for k in range(50)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 40)] * 2, "doc_id long, quality int, toxic int")
    a = quality.score_documents(docs_of(rows), labels)
    assert a.count() == len(rows)
    again = {(r.doc_id, r.score) for r in quality.score_documents(docs_of(rows[::-1]), labels).collect()}
    assert {(r.doc_id, r.score) for r in a.collect()} == again
