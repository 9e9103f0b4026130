"""Feed lists and feeds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def feed_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """feed_url: the distinct lines, trimmed, without trailing slashes; blank ones dropped."""
    url = F.regexp_replace(T.strip(F.col(column)), "/+$", "")
    return lines.select(url.alias("feed_url")).where(F.coalesce(F.col("feed_url"), F.lit("")) != "").distinct()


def read_feed_list(spark: SparkSession, path: str) -> DataFrame:
    return feed_list(spark.read.text(path))


def _name(tag: str) -> str:
    return tag.rpartition("}")[2].lower()


def _link(node) -> str | None:
    """An element's own link: text in RSS, href in Atom."""
    for kid in node:
        if _name(kid.tag) == "link":
            if kid.text and kid.text.strip():
                return kid.text.strip()
            if kid.get("href") and kid.get("rel", "alternate") == "alternate":
                return kid.get("href").strip()
    return None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xml.etree import ElementTree

    for batch in batches:
        rows, links = [], []
        for i, xml in enumerate(batch.column("xml")):
            try:
                root = ElementTree.fromstring(xml.as_py() or "")
            except ElementTree.ParseError:
                continue  # a feed that can't be read gives nothing
            channel = next((x for x in root.iter() if _name(x.tag) == "channel"), root)
            if not _link(channel):
                continue
            for entry in root.iter():
                if _name(entry.tag) in ("item", "entry") and (link := _link(entry)):
                    rows.append(i)
                    links.append(link)
        yield pa.RecordBatch.from_arrays([batch.column("feed_url").take(pa.array(rows, pa.int64())), pa.array(links, pa.string())], names=["feed_url", "url"])


def feed_entries(feeds: DataFrame) -> DataFrame:
    """feed_url, url: the links of RSS and Atom feeds (feed_url, xml) that have a link of their own."""
    return feeds.select("feed_url", "xml").mapInArrow(_parse, "feed_url string, url string")
