"""Feeds, queue, store and page extraction."""

import datetime

from pyspark.sql import functions as F

from inkwell.functions import html as H
from inkwell.sources import feeds, queue, schemas
from inkwell.sources.store import Store

RSS = "<rss><channel><title>t</title><link>https://a.com</link><item><link>https://a.com/1</link></item><item><title>no link</title></item></channel></rss>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><link href="https://b.com"/><entry><link rel="edit" href="https://b.com/e"/><link href="https://b.com/1"/></entry></feed>'


def test_feed_list(spark, tmp_path):
    (tmp_path / "feeds.txt").write_text("https://a.com/feed/\n\n  https://a.com/feed \nhttps://b.com\n")
    assert sorted(r.feed_url for r in feeds.read_feed_list(spark, str(tmp_path)).collect()) == ["https://a.com/feed", "https://b.com"]


def test_feed_entries(spark):
    rows = spark.createDataFrame([("a", RSS), ("b", ATOM), ("c", "<broken"), ("d", None), ("e", "<rss><channel><item><link>x</link></item></channel></rss>")], "feed_url string, xml string")
    assert sorted(tuple(r) for r in feeds.feed_entries(rows).collect()) == [("a", "https://a.com/1"), ("b", "https://b.com/1")]


def test_queue(spark, tmp_path):
    path = str(tmp_path / "q")
    rows = spark.createDataFrame([("f", "u2"), ("f", "u1"), ("g", "u3"), ("h", None)], "feed string, url string")
    queue.purge(spark, path)
    assert queue.depth(spark, path) == 0 and queue.peek(spark, path) is None
    queue.send(queue.messages(rows, "feed"), path)
    assert queue.depth(spark, path) == 2
    assert sorted(list(r.urls) for r in queue.receive(spark, path).collect()) == [["u1", "u2"], ["u3"]]
    n = spark.createDataFrame([(["x"],), (["x"] * 30,)], "u array<string>").select(queue.lease_seconds(F.col("u")).alias("s")).collect()
    assert [r.s for r in n] == [300, 660]
    queue.purge(spark, path)
    assert queue.depth(spark, path) == 0


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t", "a int").count() == 0
    store.overwrite("t", spark.range(3).toDF("a"))
    store.overwrite("t", store.read("t").where("a > 0"))  # reads what it replaces
    store.overwrite("t", store.read("t").where("a > 1"))
    store.append("t", spark.range(10, 12).toDF("a"))
    assert sorted(r.a for r in store.read("t").collect()) == [2, 10, 11]
    assert len(store._versions("t")) == 2


def test_create_tables_twice(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS posts")
    schemas.create_tables(spark, "posts")
    schemas.create_tables(spark, "posts")
    assert spark.table("posts.pages").schema.fieldNames() == schemas.PAGES.fieldNames()
    spark.sql("DROP DATABASE posts CASCADE")


PAGE = """<html><head><title>T &amp; more</title><meta property="article:published_time" content="2024-03-05T10:00:00Z"><link rel="canonical" href="https://a.com/p"></head>
<body><nav>skip me</nav><script>var x = "<p>no</p>"</script><article><h1>Head</h1><p>%s</p><p>Second &lt;one&gt;</p></article><footer>foot</footer></body></html>"""


def test_extract(spark):
    long = "word " * 200
    rows = spark.createDataFrame([(1, "https://x.com/1", PAGE % long), (2, "https://x.com/2", PAGE % "short"), (3, "u3", None), (4, "u4", "plain"), (5, "u5", "<p></p>")], "page_id long, url string, html string")
    found = {r.id: r for r in H.extract(rows).collect()}
    one = found[1]
    assert (one.title, one.url, one.date, one.readable, one.failed) == ("T & more", "https://a.com/p", datetime.date(2024, 3, 5), True, False)
    assert one.text == "Head\n" + long.strip() + "\nSecond <one>"
    assert not found[2].readable and found[3].failed and found[4].failed
    assert found[5].text is None and not found[5].failed and found[5].url == "u5"
    assert H.fingerprint("A  b", "C") == H.fingerprint("a", "B c")
