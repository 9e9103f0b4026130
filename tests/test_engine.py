"""Ingest, index, rankers, search and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from inkwell.functions import query as Q
from inkwell.functions import text as T
from inkwell.operators import index, ingest, rank, search
from inkwell.sources import queue
from inkwell.sources.schemas import PAGES, SKIPPED_URLS
from inkwell.sources.store import Store
from inkwell.streaming import jobs


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_candidates_and_seen(spark):
    entries = spark.createDataFrame([("f", u) for u in ("https://a.com/1#x", "https://a.com/1", "https://a.com/tag/x", "bad", "https://a.com/2?utm_source=q", None)], "feed_url string, url string")
    found = ingest.candidates(entries)
    assert rows_of(found, "url") == [("https://a.com/1",), ("https://a.com/2",)]
    pages = spark.createDataFrame([("http://www.a.com/1/",), (None,), ("",), ("nonsense",)], "url string")
    skipped = spark.createDataFrame([("b.com/x",), (None,)], "stripped_url string")
    seen = ingest.seen_urls(pages, skipped)
    assert rows_of(seen, "stripped_url") == [("a.com/1",), ("b.com/x",)]
    assert rows_of(ingest.new(found, seen), "url") == [("https://a.com/2",)]
    assert rows_of(ingest.known(found, seen), "url") == [("https://a.com/1",)]


def test_cap(spark):
    found = spark.createDataFrame([("f", f"{i:03}") for i in range(50)] + [("g", "1")], "feed_url string, url string")
    kept = rows_of(ingest.capped(found), "feed_url", "url")
    assert kept == [("f", f"{i:03}") for i in range(30)] + [("g", "1")]


def test_robots(spark):
    found = spark.createDataFrame([(u,) for u in ("https://a.com/p/x", "https://a.com/p/ok/x", "https://a.com/q", "https://b.com/p/x")], "url string")
    rules = spark.createDataFrame([("https://a.com", "/p/", False), ("https://a.com", "/p/ok", True), ("https://a.com", "", False)], "base_url string, prefix string, allow boolean")
    assert rows_of(ingest.allowed(found, rules), "url") == [("https://a.com/p/ok/x",), ("https://a.com/q",), ("https://b.com/p/x",)]


@pytest.mark.parametrize(("runs", "kept", "waits"), [("eeee.", 4, [4, 12, 12, 12, 4]), ("ee.ee.", 5, [4, 12, 4, 4, 12, 4]), (".e.e.e", 6, [4] * 6)])
def test_budget_and_backoff(spark, runs, kept, waits):
    a = spark.createDataFrame([("m", i, c == "e") for i, c in enumerate(runs)], "m string, n int, bad boolean")
    assert ingest.within_budget(a, "m", "n", F.col("bad")).count() == kept
    assert [r.wait_seconds for r in ingest.backoff(a, "m", "n", F.col("bad")).orderBy("n").collect()] == waits


def test_gate(spark):
    extracted = spark.createDataFrame(
        [(1, "http://a.com/1", True, "t", "http://a.com/1", "f", None, "w " * 100, False), (2, "http://a.com/2", True, "t", "u", "f", None, "w " * 99, False), (3, "http://a.com/3", False, "t", "u", "f", None, "w " * 200, False), (4, "http://a.com/4", None, None, None, None, None, None, True), (5, "http://a.com/5", True, "t", "u", "f", None, None, False)],
        "id long, page_url string, readable boolean, title string, url string, fingerprint string, date date, text string, failed boolean",
    )
    pages, skipped = ingest.gate(extracted)
    assert rows_of(pages, "id") == [(1,)]
    assert rows_of(skipped, "stripped_url", "reason") == [("a.com/2", "too_short"), ("a.com/3", "not_readerable")]


def test_save_pages(spark):
    stored = spark.createDataFrame([(1, "old", "u1", "f1", None, "x", None), (2, "two", "u2", "f2", None, "x", None)], PAGES)
    batch = spark.createDataFrame([("u1", "new", "f9", 1), ("u3", "three", "f2", 2), ("u4", "four", "f4", 3), ("u5", "five", "f4", 4), ("u6", "first", "fa", 5), ("u6", "last", "f6", 6), (None, "x", "y", 7), ("u7", "seven", None, 8), ("u8", "eight", None, 9)], "url string, title string, fingerprint string, seq int")
    batch = batch.withColumns({"date": F.lit(None).cast("date"), "text": F.lit("t")})
    after = ingest.save_pages(stored, batch)
    assert rows_of(after, "id", "url", "title", "fingerprint")[:4] == [(1, "u1", "new", "f9"), (2, "u2", "two", "f2"), (3, "u4", "four", "f4"), (4, "u6", "last", "f6")]
    assert rows_of(after, "id", "url")[4:] == [(5, "u7"), (6, "u8")]
    again = ingest.save_pages(after, batch)
    assert rows_of(again, "id", "url", "title", "fingerprint") == rows_of(after, "id", "url", "title", "fingerprint")


def test_record_skipped(spark):
    day = datetime.datetime(2020, 1, 1)
    stored = spark.createDataFrame([("a", "too_short", day)], SKIPPED_URLS)
    batch = spark.createDataFrame([("a", "not_readerable", 1), ("b", "x", 2), ("b", "too_short", 3), ("", "x", 4)], "stripped_url string, reason string, seq int")
    after = {r.stripped_url: r for r in ingest.record_skipped(stored, batch).collect()}
    assert {k: r.reason for k, r in after.items()} == {"a": "not_readerable", "b": "too_short"}
    assert after["a"].created_at == day and after["b"].created_at is not None


TEXTS = {
    1: ("Running dogs", "the dog ran over the hill and the hill was green"),
    2: ("Cats", "a cat and a dog sat; the dogs were running"),
    3: (None, "dog dog dog"),
    4: ("Hill", "green hill " * 30),
    5: ("Empty", "  "),
    6: ("x", "quick brown fox jumps over the lazy dog again and again"),
}


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    day = datetime.date(2024, 1, 1)
    rows = [(i, t, f"https://s{i % 2}.example.com/{i}/", f"f{i}", day + datetime.timedelta(days=i) if i != 2 else None, x, None) for i, (t, x) in TEXTS.items()]
    store.overwrite("pages", spark.createDataFrame(rows, PAGES))
    engine = search.Engine(store, min_score=0.0)
    engine.reindex(2)
    return engine


def test_keyword_search(engine):
    page = engine.keyword("dog")
    assert page.total == 4 and page.total_pages == 1
    assert page.results.first().text == "dog dog dog" and page.results.first().title == ""
    assert engine.keyword("dog hill").total == 1
    assert engine.keyword("dog site:s1.example.com").total == 2
    assert engine.keyword("site:example.com").total == 5
    assert engine.keyword("site:s1 site:s0").total == 0
    assert engine.keyword("").total == 0 and engine.keyword("!!!").total == 0
    strict = search.Engine(engine.store, min_score=100.0)
    assert strict.keyword("dog").total == 0
    both = [r.url for p in (1, 2, 3) for r in engine.keyword("dog", p, 2).results.collect()]
    assert both == [r.url for r in engine.keyword("dog", 1, 10).results.collect()]
    assert engine.keyword("dog", 9).results.count() == 0 and engine.keyword("dog", 9).total == 4


def test_full_text_search(engine):
    def urls(q):
        return sorted(int(r.url.rsplit("/", 1)[1]) for r in engine.full_text(q).results.collect())

    assert urls("dogs") == [1, 2, 6]  # stems; without a title a page isn't found
    assert urls("run dog") == [1, 2]
    assert urls('"dog ran"') == [1]
    assert urls("cat or fox") == [2, 6]
    assert urls("dog -cat") == [1, 6]
    assert urls("the and") == [] and urls("") == []
    assert urls("-dog") == [4, 5]
    assert engine.full_text("dog").page == 1


def test_dispatch_and_api(engine):
    assert engine.search("dog", use_postgres="TRUE").total == 3
    assert engine.search("dog", mode="other").total == engine.search("dog").total == 4
    body = json.loads(engine.api(" dog ").first().response)
    assert body["total"] == 4 and body["page"] == 1 and body["total_pages"] == 1 and len(body["results"]) == 4
    for bad in ((" ", 1), ("dog", 0)):
        with pytest.raises(ValueError):
            engine.api(*bad)


def test_browse_and_log(engine):
    assert [r.url[-1] for r in engine.latest(1).results.collect()] == ["6", "5", "4", "3", "1"]
    assert engine.latest(9).page == 5 and engine.latest(9).results.count() == 0
    assert engine.random(3).first().url.endswith("/3") and engine.random(99).count() == 0
    assert engine.size() == 6
    engine.log("q1", "1.1.1.1", "2.2.2.2", "ua")
    engine.log("q2", "", "2.2.2.2", None)
    assert rows_of(engine.store.read("query_logs"), "id", "query", "ip_address") == [(1, "q1", "1.1.1.1"), (2, "q2", "2.2.2.2")]


def test_bm25_formula(spark):
    import math

    pages = spark.createDataFrame([(1, "a b", "c a"), (2, "x", "a y z"), (3, "q", "r")], "id long, title string, text string")
    got = {r.id: r.score for r in rank.bm25(index.keyword_postings(pages), index.keyword_stats(pages), ["a"]).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    part = lambda tf, dl, mean: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    assert got == pytest.approx({1: max(2 * part(1, 2, 4 / 3), part(1, 2, 2)), 2: part(1, 3, 2)})


@pytest.mark.parametrize("terms", [["dog"], ["dog", "hill"], ["the", "and", "dog"], ["absent"]])
def test_scan_ranks_as_the_index_does(engine, terms):
    pages = engine.pages
    indexed = {r.id: r.score for r in rank.bm25(engine.store.read("keyword_postings"), engine.store.read("keyword_stats"), terms).collect()}
    assert {r.id: r.score for r in rank.bm25_scan(pages, terms).collect()} == pytest.approx(indexed)


def test_covers():
    assert rank.covers([([1], 0), ([2], 0)]) == 1.0
    assert rank.covers([([1, 10], 0), ([4, 11], 0)]) == pytest.approx(1 / 3 + 1 / 6 + 1)
    assert rank.covers([([3, 9], 0)]) == 2.0
    assert rank.covers([]) == 0.0 and rank.covers([([], 0), ([1], 0)]) == 0.0


def test_restricted_postings_equal_full(spark, engine):
    pages = engine.pages
    full = index.keyword_postings(pages).where("term in ('dog', 'hill')")
    assert rows_of(full, "term", "id", "field", "tf", "dl") == rows_of(index.keyword_postings(pages, ["dog", "hill"]), "term", "id", "field", "tf", "dl")


def test_null_words_never_match(spark):
    pages = spark.createDataFrame([(1, None, "dog"), (2, "t", None), (3, "dog", "x")], "id long, title string, text string")
    found = index.text_postings(pages, stemmed=False)
    assert rows_of(rank.match(found, Q.web_query("dog", index.analysed(False))), "id") == [(3,)]


def test_streams(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    path = str(tmp_path / "q")
    queue.send(queue.messages(spark.createDataFrame([("f", "https://a.com/1"), ("f", "https://a.com/2/"), ("g", "http://www.a.com/2")], "feed string, url string"), "feed"), path)
    seen = spark.createDataFrame([("a.com/1",)], "stripped_url string")
    urls = queue.stream(spark, path, 1).select(F.explode("urls").alias("url"))
    out = jobs.collect_new(urls, store, "new", seen, str(tmp_path / "c"))
    assert rows_of(out, "stripped_url", "url") == [("a.com/2", "http://www.a.com/2")]
    again = jobs.collect_new(queue.stream(spark, path, 1).select(F.explode("urls").alias("url")), store, "new", seen, str(tmp_path / "c"))
    assert again.count() == 1  # nothing new came in
    src = str(tmp_path / "rows")
    spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("j", 2, "b")], "key string, seq int, v string").repartition(3).write.parquet(src)
    stream = jobs.table_stream(spark, src, spark.read.parquet(src).schema, 1)
    assert rows_of(jobs.upsert_stream(stream, store, "last", "key", "seq", str(tmp_path / "d")), "key", "v") == [("j", "b"), ("k", "c")]
    jobs.append_log(jobs.table_stream(spark, src, spark.read.parquet(src).schema), str(tmp_path / "log"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_tokens_lower_case(spark):
    row = spark.createDataFrame([("Ça VA, 12x!",)], "t string").select(T.tokens(F.col("t")).alias("w")).first()
    assert row.w == ["ça", "va", "12x"]
