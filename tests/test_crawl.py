"""The crawl jobs, robots files, messages, numbering, and batches beside a table."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import query as Q
from inkwell.functions import robots as R
from inkwell.operators import crawl, ingest, numbering
from inkwell.sources import queue
from inkwell.sources.schemas import PAGES
from inkwell.sources.store import Store, shared_root
from inkwell.streaming import jobs

LONG = "<html><head><title>{0}</title></head><body><article>" + "".join("<p>" + "word " * 80 + "end of it.</p>" for _ in range(6)) + "</article></body></html>"


def rss(*links):
    return "<rss><channel><link>https://a.example</link>" + "".join(f"<item><link>{x}</link></item>" for x in links) + "</channel></rss>"


def test_enqueue(spark):
    many = [f"https://a.example/post/{i:03}" for i in range(70)]
    feeds = spark.createDataFrame([("f1", rss(*many, many[0], "https://a.example/tag")), ("f2", rss("https://b.example/x/1", "https://b.example/x/2/?utm_source=q")), ("f3", "<broken"), ("f4", rss())], "feed_url string, xml string")
    pages = spark.createDataFrame([("http://www.a.example/post/003/",), (None,)], "url string")
    skipped = spark.createDataFrame([("b.example/x/1",)], "stripped_url string")
    got = {r.feed_url: r.message for r in crawl.enqueue(feeds, pages, skipped).collect()}
    assert set(got) == {"f1", "f2"}
    import json

    first = json.loads(got["f1"])["urls"]
    assert first == sorted(set(many) - {many[3]})[:30]
    assert len(json.loads(got["f2"])["urls"]) == 1


def test_scrape(spark):
    base = "https://a.example"
    urls = [f"{base}/p/{i}" for i in range(12)]
    html = {urls[0]: LONG.format("zero"), urls[1]: None, urls[2]: "", urls[3]: "<html><body><p>short</p></body></html>", urls[4]: "no markup at all", urls[5]: LONG.format("five"), urls[6]: None, urls[8]: LONG.format("late")}
    robots = spark.createDataFrame([(base, "User-agent: *\nDisallow: /\n\nUser-agent: inkwellbot\nDisallow: /p/5\n"), ("https://closed.example", "User-agent: *\nDisallow: /")], "base_url string, robots string")
    messages = spark.createDataFrame([(1, [*urls[:7], urls[7], urls[8]]), (2, ["https://closed.example/a", "https://closed.example/b"]), (3, ["https://free.example/x", "https://closed.example/c"])], "message_id long, urls array<string>")
    fetched = spark.createDataFrame([*html.items(), ("https://closed.example/c", LONG.format("c"))], "url string, html string")
    got = crawl.scrape(messages, fetched, robots)
    states = {(r.message_id, r.at): r.state for r in got.attempts.collect()}
    assert states == {(1, 0): "fetched", (1, 1): "error", (1, 2): "error", (1, 3): "fetched", (1, 4): "fetched", (1, 5): "blocked", (1, 6): "error", (1, 7): "error", (1, 8): "abandoned", (2, 0): "blocked", (2, 1): "blocked", (3, 0): "error", (3, 1): "fetched"}
    assert {r.title for r in got.pages.collect()} == {"zero", "c"}
    assert [(r.stripped_url, r.reason) for r in got.skipped.collect()] == [("a.example/p/3", "not_readerable")]
    stored = spark.createDataFrame([], PAGES)
    saved = ingest.save_pages(stored, got.pages).collect()
    assert sorted(r.id for r in saved) == [1, 2]
    assert ingest.record_skipped(spark.createDataFrame([], "stripped_url string, reason string, created_at timestamp"), got.skipped).count() == 1


@pytest.mark.parametrize(("text", "path", "ok"), [("", "/x", True), (None, "/x", True), ("User-agent: *\nDisallow:", "/x", True), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b", False), ("User-agent: *\nAllow: /a/b\nDisallow: /a", "/a/b", True), ("User-agent: other\nDisallow: /", "/x", True)])
def test_robots(spark, text, path, ok):
    rules = R.rules(spark.createDataFrame([("b", text)], "base_url string, robots string"))
    found = rules.agg(F.collect_list(F.struct("at", "prefix", "allow")).alias("r"))
    assert found.select(R.permits(F.col("r"), F.lit(path)).alias("ok")).first().ok is ok


def test_messages_hold_so_many(spark):
    rows = spark.createDataFrame([("h", f"u{i:03}") for i in range(65)] + [("g", None), ("k", "u")], "host string, url string")
    got = [(r.host, len(r.urls)) for r in queue.messages(rows, "host").select("host", F.from_json("message", "urls array<string>")["urls"].alias("urls")).collect()]
    assert sorted(got) == [("h", 5), ("h", 30), ("h", 30), ("k", 1)]


def test_site_ends_at_any_white_space(spark):
    text = "site:a.com foo ésite:b.com SITE:с.com"
    df = spark.createDataFrame([(text,)], "q string").select(Q.sites(F.col("q")).alias("s"), Q.clean(F.col("q")).alias("c")).first()
    parsed = Q.parse(text)
    assert (list(df.s), df.c) == (parsed.sites, parsed.clean) and parsed.sites[0] == "a.com"


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_in_order(spark, kind):
    values = random.Random(1).sample(range(10_000), 700)
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(F.col("v").cast(kind).alias("v")).repartition(5)
    got = {r.v: r.n for r in numbering.in_order(rows, "v", "n", 10).collect()}
    key = int if kind == "long" else str
    assert got == {v: 11 + i for i, v in enumerate(sorted(map(key, values)))}
    assert numbering.in_order(rows.limit(0), "v", "n").collect() == []
    assert "Window" in numbering.in_order(rows, "v", "n")._jdf.queryExecution().executedPlan().toString()


def test_batches_beside_a_table(spark):
    store = Store(spark, Store(spark, shared_root(spark)).scratch())
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n long")
    most = lambda df: df.groupBy("k").agg(F.max("n").alias("n"))
    store.put("t", 0, rows(("a", 1)))
    store.put("t", 0, rows(("a", 2)))  # done again
    store.put("t", 1, rows(("b", 5)))
    store.merge("t", "k string, n long", most)
    store.merge("t", "k string, n long", most)
    store.put("t", 2, rows(("a", 9)))
    store.merge("t", "k string, n long", most)
    assert {tuple(r) for r in store.read("t").collect()} == {("a", 9), ("b", 5)}


def test_scraping_a_stream_of_messages(spark, tmp_path):
    """The jobs over a queue: each batch of messages is scraped, and its pages are put beside the table."""
    path, store = str(tmp_path / "queue"), Store(spark, str(tmp_path / "store"))
    sent = queue.messages(spark.createDataFrame([("h", "https://a.example/p/1"), ("h", "https://a.example/p/2")], "host string, url string"), "host")
    queue.send(sent, path)
    fetched = spark.createDataFrame([("https://a.example/p/1", LONG.format("one"))], "url string, html string")
    robots = spark.createDataFrame([], "base_url string, robots string")
    schema = "title string, url string, fingerprint string, date date, text string"

    def each(batch, n):
        got = crawl.scrape(batch.withColumn("message_id", F.xxhash64("urls")), fetched, robots)
        store.put("found", n, got.pages.select("title", "url", "fingerprint", "date", "text"))

    jobs.run(queue.stream(spark, path), each, str(tmp_path / "checkpoint"))
    store.merge("found", schema, lambda df: df.dropDuplicates(["url"]))
    assert [r.title for r in store.read("found").collect()] == ["one"]


def test_all_from_the_shell(spark, tmp_path, capsys):
    from inkwell.__main__ import main

    where = lambda n: str(tmp_path / n)
    spark.createDataFrame([("f", rss("https://a.example/p/1", "https://a.example/p/2", "https://a.example/p/3"))], "feed_url string, xml string").write.parquet(where("feeds"))
    html = [("https://a.example/p/1", LONG.format("first")), ("https://a.example/p/2", "<p>short</p>")]
    spark.createDataFrame(html, "url string, html string").write.parquet(where("html"))
    spark.createDataFrame([], "base_url string, robots string").write.parquet(where("robots"))
    assert main([where("store"), "all", where("feeds"), where("queue"), where("html"), where("robots")]) == 0
    spark.createDataFrame([("https://a.example/p/3", LONG.format("third"))], "url string, html string").write.parquet(where("more"))
    assert main([where("store"), "enqueue", where("feeds"), where("queue")]) == 0  # what is known is not sent again
    assert main([where("store"), "num_messages", where("queue")]) == 0
    assert main([where("store"), "scrape", where("queue"), where("more"), where("robots")]) == 0
    assert main([where("store"), "search", "word", "full_text"]) == 0
    out = capsys.readouterr().out
    assert "first" in out and "third" in out and "2 results" in out
