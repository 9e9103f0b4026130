"""python -m inkwell ROOT COMMAND ...: a thin command line over a store.

enqueue FEEDS QUEUE | scrape QUEUE PAGES ROBOTS | all FEEDS QUEUE PAGES ROBOTS | reindex | size | search QUERY [keyword|hybrid|full_text] [PAGE] | latest [PAGE] | random N | purge QUEUE | num_messages QUEUE | peek QUEUE
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.search import Engine, Page, first_rows
from .operators import crawl
from .sources import queue
from .sources.schemas import SKIPPED_URLS
from .sources.store import Store


def show(page: Page) -> None:
    print(f"{page.total} results, page {page.page} of {page.total_pages}")
    for r in first_rows(page).collect():
        print(f"- {r.title}  {r.url}")


def enqueue(engine: Engine, feeds: str, path: str) -> None:
    """Fetched feeds (feed_url, xml) to messages of what is new."""
    spark = engine.spark
    queue.purge(spark, path)
    queue.send(crawl.enqueue(spark.read.parquet(feeds), engine.pages, engine.store.read("skipped_urls", SKIPPED_URLS)), path)


def scrape(engine: Engine, path: str, fetched: str, robots: str) -> None:
    """All messages of a queue, with fetched pages (url, html) and robots files (base_url, robots)."""
    spark = engine.spark
    messages = queue.receive(spark, path).withColumn("message_id", F.xxhash64("urls"))
    crawl.keep(engine.store, crawl.scrape(messages, spark.read.parquet(fetched), spark.read.parquet(robots)))
    queue.purge(spark, path)


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    root, command, *rest = args
    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    engine = Engine(Store(spark, root))
    if command == "enqueue" and len(rest) == 2:
        enqueue(engine, *rest)
    elif command == "scrape" and len(rest) == 3:
        scrape(engine, *rest)
    elif command == "all" and len(rest) == 4:
        enqueue(engine, *rest[:2])
        scrape(engine, *rest[1:])
    elif command == "reindex":
        engine.reindex()
    elif command == "size":
        print(engine.size())
    elif command == "search" and rest:
        mode = rest[1] if len(rest) > 1 else "keyword"
        show(engine.search(rest[0], mode, str(mode == "full_text"), int(rest[2]) if len(rest) > 2 else 1))
    elif command == "latest":
        show(engine.latest(int(rest[0]) if rest else 1))
    elif command == "random" and rest:
        print(engine.random(int(rest[0])).toJSON().collect())
    elif command == "purge" and rest:
        queue.purge(spark, rest[0])
    elif command == "num_messages" and rest:
        print(queue.depth(spark, rest[0]))
    elif command == "peek" and rest:
        print(queue.peek(spark, rest[0]))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
