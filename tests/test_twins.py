"""Queries against their SQL twins over rows that the smallest tables don't hold."""

import os

from test_queries import TABLES, plain

from inkwell.plans import catalog

PAGE = "page_id long, url string, html string"


def twins(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the tables."""
    import duckdb

    c = duckdb.connect()
    for t, df in tables.items():
        assert t in TABLES
        if not os.path.isdir(f"{folder}/{t}.parquet"):
            df.coalesce(2).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = c.execute(catalog.ORACLES[name])
    order = [[d[0] for d in found.description].index(x) for x in columns]
    return sorted((tuple(plain(r[x]) for x in columns) for r in df.collect()), key=str), sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_titles(spark, tmp_path):
    titles = ("A &amp;&amp; B&amp", "&amp;lt; &lt;b&gt; &quot;x&#39;", "&eacute; &lt", "   a\n\t b  ", "", "a  b \x0b c")
    html = [f'<meta property="og:title" content="other"><title>{t}</title>' for t in titles] + ["<TITLE>x</TITLE>", "<title>a<b></title>", "no markup", "", None]
    ours, theirs = twins(spark, tmp_path, "html_title", pages=spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], PAGE))
    assert ours == theirs and ours[0] == (0, "A && B&amp")


def test_hosts_of_many_messages(spark, tmp_path):
    urls = [f"https://www.a.example/{i:03}" for i in range(70)] + ["https://a.example/000"] * 3 + [f"http://b.example/{i}" for i in range(30)] + ["https://c.example/"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGE)
    for name in ("lease_seconds", "message_json", "queue_depth"):
        ours, theirs = twins(spark, tmp_path, name, pages=pages)
        assert ours == theirs and ours
