"""The search engine: keyword and full-text search, browsing, and the query log, over a store of pages and index tables.

Errors are raised, not turned into empty results. Ties go to the smaller id.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as T
from ..functions import urls as U
from ..sources.schemas import PAGES, QUERY_LOGS
from ..sources.store import Store
from . import index, ingest, rank

PER_PAGE = 6
FULL_TEXT_CANDIDATES, FULL_TEXT_RESULTS = 200, 24
LATEST_PAGES = 5
MIN_SCORE = 1.0
ROW = "title string, url string, date date, text string"


def site_filter(domains: list[str], url: str = "url") -> Column:
    """Whether an address contains every one of domains, case as it is."""
    out = F.lit(True)
    for d in domains:
        out = out & F.col(url).contains(d)
    return out


def shaped(pages: DataFrame, cut: int | None = None) -> DataFrame:
    """Result rows: empty for a missing title, no trailing slash, an excerpt of 300 words, of so many characters if cut."""
    body = F.col("text") if cut is None else T.left(F.col("text"), cut)
    return pages.select(F.coalesce("title", F.lit("")).alias("title"), U.without_slash(F.coalesce("url", F.lit(""))).alias("url"), "date", T.snippet(body).alias("text"))


@dataclass
class Page:
    """One page of results with what is around it."""

    results: DataFrame
    total: int
    page: int
    per_page: int | None
    total_pages: int

    def to_json(self) -> DataFrame:
        """One row: the response of the API as JSON."""
        rows = self.results.agg(F.collect_list(F.struct("title", "url", "date", "text")).alias("results"))  # a page's rows
        return rows.select(F.to_json(F.struct("results", F.lit(self.total).alias("total"), F.lit(self.page).alias("page"), F.lit(self.total_pages).alias("total_pages"))).alias("response"))


def first_rows(page: Page, n: int = 5) -> DataFrame:
    """title (60 characters), url of a page's first rows, as a shell shows them."""
    return page.results.limit(n).select(F.left("title", F.lit(60)).alias("title"), "url")


class Engine:
    def __init__(self, store: Store, min_score: float | None = MIN_SCORE):
        self.store, self.spark, self.min_score = store, store.spark, min_score

    @property
    def pages(self) -> DataFrame:
        return self.store.read("pages", PAGES)

    def size(self) -> int:
        return self.pages.count()

    def reindex(self, parts: int | None = None) -> None:
        index.build(self.store, self.pages, parts)

    def index_pages(self, ids: DataFrame) -> None:
        """Brings the index up to date with the pages whose id is in ids."""
        index.upsert(self.store, index.chosen(self.pages, ids))

    def _empty(self, page: int, per_page: int | None) -> Page:
        return Page(self.spark.createDataFrame([], ROW), 0, page, per_page, 0)

    def scored(self, query: str) -> DataFrame | None:
        """id, score of all hits of a keyword query; None for an empty one."""
        clean, sites, _ = Q.parse(query)
        if not clean and not sites:
            return None
        terms = [t for _, t in index.analysed(stemmed=False)(clean)]
        if clean and not terms:  # nothing but punctuation finds nothing
            return self.spark.createDataFrame([], "id long, score double")
        if terms:
            hits = rank.bm25(index.live(self.store, "keyword_postings"), self.store.read("keyword_stats"), terms)
            if sites:
                hits = hits.join(self._of(sites), "id", "left_semi")
        else:
            hits = self._of(sites).withColumn("score", F.lit(1.0))
        return hits if self.min_score is None else hits.where(F.col("score") >= self.min_score)

    def _of(self, sites: list[str]) -> DataFrame:
        """id of the indexed documents of sites."""
        return index.live(self.store, "documents_index").where(site_filter(sites)).select(F.col("id").cast("long").alias("id"))

    def keyword(self, text: str, page: int = 1, size: int | None = PER_PAGE) -> Page:
        """A page of the ranked hits. One job scores them, for the page and the total."""
        per_page, page = size or PER_PAGE, max(1, page)
        hits = self.scored(text)
        if hits is None:
            return self._empty(page, per_page)
        seen = Observation()
        counted = hits.observe(seen, F.count(F.lit(1)).alias("total"))
        top = counted.orderBy(F.desc("score"), "id").offset((page - 1) * per_page).limit(per_page).collect()  # per_page rows at most
        total = seen.get["total"]
        return Page(self._rows([(r.id, r.score) for r in top]), total, page, per_page, -(-total // per_page))

    def hybrid(self, text: str, page: int = 1, size: int | None = PER_PAGE) -> Page:
        """The keyword ranking; vectors have no part in it."""
        return self.keyword(text, page, size)

    def _rows(self, top: list[tuple[int, float]], cut: int | None = None) -> DataFrame:
        """The pages of a short list of (id, score), in its order."""
        order = self.spark.createDataFrame([(i, n) for n, (i, _) in enumerate(top)], "id long, n int")
        wide = self.pages.where(F.col("id").isin([i for i, _ in top])) if top else self.pages.limit(0)
        found = wide.join(F.broadcast(order), "id").orderBy("n")
        return shaped(found, cut)

    def full_text(self, query: str) -> Page:
        """The best 24 of the boolean query's matches; always page 1 of 1."""
        branches = Q.web_query(" ".join((query or "").split()), index.analysed())
        if not branches:
            return Page(self.spark.createDataFrame([], ROW), 0, 1, None, 1)
        postings = index.live(self.store, "text_postings")
        found = rank.cover_density(rank.match(postings, branches, self.pages.where(F.col("title").isNotNull() & F.col("text").isNotNull())))
        best = found.orderBy(F.desc("score"), "id").limit(FULL_TEXT_CANDIDATES).orderBy(F.desc("score"), "id").limit(FULL_TEXT_RESULTS).collect()
        return Page(self._rows([(r.id, r.score) for r in best], 1500), len(best), 1, None, 1)

    def search(self, query: str, mode: str = "keyword", use_postgres: str = "false", page: int = 1) -> Page:
        """As the site dispatches: full text if asked for, else by mode, of which all but keyword are hybrid."""
        if use_postgres.lower() == "true":
            return self.full_text(query)
        return self.keyword(query, page) if mode.lower() == "keyword" else self.hybrid(query, page)

    def api(self, query: str, page: int = 1) -> DataFrame:
        """One row of JSON; not logged."""
        if not query or not query.strip():
            raise ValueError("q is required")
        if page < 1:
            raise ValueError("page starts at 1")
        return self.keyword(query.strip(), page).to_json()

    def latest(self, page: int = 1) -> Page:
        """Six posts a page by date, the newest first; never past page 5."""
        page = max(1, min(page, LATEST_PAGES))
        return Page(shaped(latest(self.pages, page), 1500), LATEST_PAGES * PER_PAGE, page, PER_PAGE, LATEST_PAGES)

    def random(self, r: int | None = None) -> DataFrame:
        """The post with the smallest id from r on; r is drawn up to the largest id, unless given. So there always is one, if there are any."""
        if r is None:
            r = random.randint(1, max(1, self.pages.agg(F.max("id")).first()[0] or 1))
        first = self.pages.where(F.col("id") >= r).agg(F.min("id")).first()[0]  # ids alone are read for it
        return shaped(self.pages.where(F.col("id") == first).limit(1) if first is not None else self.pages.limit(0), 1500)

    def log(self, query: str, forwarded_for: str | None, peer: str | None, user_agent: str | None) -> None:
        """Appends one row to the query log."""
        top = self.store.read("query_logs", QUERY_LOGS).agg(F.max("id")).first()[0] or 0
        row = self.spark.createDataFrame([(query, forwarded_for, peer, user_agent)], "query string, forwarded_for string, peer string, user_agent string")
        self.store.append("query_logs", ingest.log_rows(row.withColumn("timestamp", F.current_timestamp()), top + 1))


def latest(pages: DataFrame, page: int, per_page: int = PER_PAGE) -> DataFrame:
    """So many dated pages, newest first: a top-k of ids and dates alone, joined back to the wide rows."""
    page = min(page, LATEST_PAGES)
    keys = pages.where(F.col("date").isNotNull()).select("id", "date").orderBy(F.desc("date"), "id").offset((page - 1) * per_page).limit(per_page)
    return pages.join(F.broadcast(keys.select("id")), "id").orderBy(F.desc("date"), "id")
