"""Pages: readability and extraction with the standard library's parser, over Arrow batches.

A page counts as readable if its paragraphs of 140 characters and more, each worth the root of what exceeds that, come to more than
20. Extraction takes title, date, canonical address and the text of the main part, without navigation, scripts and the like.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKIPPED = frozenset("script style nav noscript template svg form button select aside footer header iframe".split())
BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 br tr td table blockquote pre section article main title".split())
WEIGHED = frozenset(("p", "pre", "article"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DATES = frozenset(("article:published_time", "date", "dc.date", "datepublished", "pubdate"))
SCHEMA = "id long, page_url string, readable boolean, title string, url string, fingerprint string, date date, text string, failed boolean"


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.og_title, self.date, self.url = "", "", "", ""
        self.skip = self.main = 0
        self.in_title = False
        self.all: list[str] = []
        self.inner: list[str] = []
        self.sizes: list[int] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()
            if name == "og:title":
                self.og_title = self.og_title or a.get("content", "")
            elif name in DATES:
                self.date = self.date or a.get("content", "")
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.url = self.url or a.get("href", "")
        elif tag == "time":
            self.date = self.date or a.get("datetime", "")
        elif tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip += 1
        if tag in ("article", "main"):
            self.main += 1
        if tag in BLOCKS:
            self._break()
        if tag in WEIGHED and tag != "article":
            self.sizes.append(0)
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag in BLOCKS:
            self._break()
        if tag in ("article", "main") and self.main:
            self.main -= 1
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
            return
        if self.skip:
            return
        self.all.append(data)
        if self.main:
            self.inner.append(data)
        if self.open and self.sizes:
            self.sizes[-1] += len(data.strip())

    def _break(self) -> None:
        self.all.append("\n")
        if self.main:
            self.inner.append("\n")


def _tidy(parts: list[str]) -> str:
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x)


def fingerprint(title: str, text: str) -> str:
    """One value for one content, whatever its case and spacing."""
    return hashlib.sha256(" ".join(f"{title} {text}".lower().split()).encode("utf-8", "surrogatepass")).hexdigest()


def read_page(html: str | None) -> dict | None:
    """What a page holds, or None if it has no markup at all."""
    if not html or "<" not in html:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    text = _tidy(page.inner) or _tidy(page.all)
    title = " ".join((page.og_title or page.title).split())
    day = re.match(r"\d{4}-\d{2}-\d{2}", page.date.strip())
    score = sum((n - 140) ** 0.5 for n in page.sizes if n >= 140)
    return {"readable": score > 20, "title": title or None, "url": page.url or None, "date": day[0] if day else None, "text": text or None, "fingerprint": fingerprint(title, text)}


def title(html: Column) -> Column:
    """The title element's text as it is written: only the five whole references are read, so that one cut short stays; empty without such an element.

    extract's title is what a browser shows: it takes og:title first and reads every reference, one cut short as well.
    """
    out = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    for reference, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("readable", "title", "url", "fingerprint", "date", "text", "failed")}
        for html in batch.column("html"):
            try:
                found = read_page(html.as_py())
            except (ValueError, AssertionError):  # what the parser raises for broken markup
                found = None
            for k in out:
                out[k].append(found is None if k == "failed" else found and found[k])
        text = lambda k: pa.array(out[k], pa.string())  # noqa: E731, B023
        columns = [batch.column("id"), batch.column("page_url"), pa.array(out["readable"], pa.bool_()), text("title"), text("url"), text("fingerprint"), _days(out["date"]), text("text"), pa.array(out["failed"], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "page_url", "readable", "title", "url", "fingerprint", "date", "text", "failed"])


def _days(found: list[str | None]) -> pa.Array:
    import datetime

    def day(x: str | None) -> datetime.date | None:
        try:
            return datetime.date.fromisoformat(x) if x else None
        except ValueError:
            return None

    return pa.array([day(x) for x in found], pa.date32())


def extract(pages: DataFrame, id_: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """SCHEMA of every page; where nothing is found, failed is true and the rest null. The page's own address stands in for a missing one."""
    rows = pages.select(F.col(id_).cast("long").alias("id"), F.col(url).alias("page_url"), F.col(html).alias("html"))
    return rows.mapInArrow(_extract, SCHEMA).withColumn("url", F.coalesce("url", "page_url"))
