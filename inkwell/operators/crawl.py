"""The two jobs of the crawl: from feeds to messages, and from messages to pages.

Fetching is left to whoever runs the job: feeds, robots files and pages come in as tables. Both jobs are plans over whole
batches, in batch and, through streaming.jobs, over streams of messages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import robots as R
from ..functions import urls as U
from ..sources import feeds, queue
from ..sources.schemas import PAGES, SKIPPED_URLS
from ..sources.store import Store
from . import index, ingest


def enqueue(fetched: DataFrame, pages: DataFrame, skipped: DataFrame, most: int = ingest.PER_FEED) -> DataFrame:
    """feed_url, message: for each of the feeds (feed_url, xml) its new addresses, so many at most and in order. A feed without any has no message."""
    found = ingest.candidates(feeds.feed_entries(fetched))
    fresh = ingest.new(found, ingest.seen_urls(pages, skipped))
    return queue.messages(ingest.capped(fresh, "feed_url", most), "feed_url", most=most)


@dataclass
class Scraped:
    """attempts (message_id, at, url, state), pages as ingest.save_pages takes them, and skipped as ingest.record_skipped does."""

    attempts: DataFrame
    pages: DataFrame
    skipped: DataFrame


def attempts(messages: DataFrame, fetched: DataFrame, robots: DataFrame) -> DataFrame:
    """message_id, at, url, html, state of every address of messages (message_id, urls).

    state is blocked where the robots file of the message's first address forbids it, abandoned after four errors in its message, error if
    nothing was fetched (url, html), else fetched. A message all of whose addresses are blocked or abandoned is done with all the same.
    """
    rows = messages.select("message_id", F.col("urls")[0].alias("_first"), F.posexplode("urls").alias("at", "url"))
    by_base = R.rules(robots).groupBy("base_url").agg(F.collect_list(F.struct("at", "prefix", "allow")).alias("_rules")).withColumnRenamed("base_url", "_base")
    rows = rows.withColumn("_base", U.base(F.col("_first"))).join(by_base, "_base", "left")
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/(.*)$", 1))
    rows = rows.select("message_id", "at", "url", R.permits(F.col("_rules"), path).alias("_ok"))
    once = fetched.groupBy("url").agg(F.max("html").alias("html"))
    read = rows.where("_ok").join(once, "url", "left")
    failed = F.coalesce(F.col("html"), F.lit("")) == ""
    tried = ingest.within_budget(read, "message_id", "at", failed).select("message_id", "at", "url", "html", F.when(failed, "error").otherwise("fetched").alias("state"))
    done = tried.select("message_id", "at", F.lit(True).alias("_done"))
    left = rows.where("_ok").join(done, ["message_id", "at"], "left_anti").select("message_id", "at", "url", F.lit(None).cast("string").alias("html"), F.lit("abandoned").alias("state"))
    blocked = rows.where("not _ok").select("message_id", "at", "url", F.lit(None).cast("string").alias("html"), F.lit("blocked").alias("state"))
    return tried.unionByName(left).unionByName(blocked)


def scrape(messages: DataFrame, fetched: DataFrame, robots: DataFrame) -> Scraped:
    """What a batch of messages brings: pages and skipped addresses of what was fetched. A page that can't be parsed, or holds no text, is dropped silently."""
    tried = attempts(messages, fetched, robots)
    read = tried.where("state = 'fetched'").withColumn("seq", F.concat_ws(":", F.col("message_id").cast("string"), F.lpad(F.col("at").cast("string"), 6, "0")))
    got = H.extract(read.withColumn("page_id", F.xxhash64("message_id", "at")), url="url").join(read.select(F.xxhash64("message_id", "at").alias("id"), "seq"), "id")
    pages, skipped = ingest.gate(got, keep=("seq",))
    return Scraped(tried.select("message_id", "at", "url", "state"), pages.drop("id"), skipped)


def keep(store: Store, got: Scraped) -> None:
    """Stores what a batch of messages brought, and brings the index up to date with it."""
    store.overwrite("skipped_urls", ingest.record_skipped(store.read("skipped_urls", SKIPPED_URLS), got.skipped))
    before = store.read("pages", PAGES)
    store.overwrite("pages", ingest.save_pages(before, got.pages))
    after = store.read("pages", PAGES)
    changed = after.join(before.select("id", "fingerprint"), ["id", "fingerprint"], "left_anti")
    if store.exists("documents_index"):
        index.upsert(store, changed)
    else:
        index.build(store, after)
