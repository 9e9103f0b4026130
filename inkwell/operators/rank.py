"""Rankers: BM25 over fields, and boolean full-text match with cover density.

Keyword: every query term must stand in some field; a term counts the larger of its fields' boosted BM25 (Robertson and Zaragoza
2009), with the document frequency of the field that has most. Full text: alternatives of required and forbidden words and
phrases; the score adds 1 / (1 + words in between) over the minimal covers of what is required (Clarke, Cormack and Tudhope 2000).
"""

from __future__ import annotations

from functools import reduce
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.query import Item

K1, B = 1.2, 0.75
BOOST = {"title": 2.0, "text": 1.0}


def bm25(postings: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """id, score of the documents that hold every one of terms. stats is keyword_stats' row; the frequencies come from the postings."""
    wanted = sorted(set(terms))
    found = postings.where(F.col("term").isin(wanted))
    df = found.groupBy("term", "field").agg(F.count("*").alias("n")).groupBy("term").agg(F.max("n").alias("df"))
    s = stats.first()
    n_docs, average = s["n_docs"], {"title": s["title_length"] or 1.0, "text": s["text_length"] or 1.0}
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("field") == "title", average["title"]).otherwise(average["text"])
    boost = F.when(F.col("field") == "title", BOOST["title"]).otherwise(BOOST["text"])
    part = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean))
    by_term = found.join(F.broadcast(df), "term").groupBy("id", "term").agg(F.max(part).alias("part"))  # a row for each query term
    return by_term.groupBy("id").agg(F.sum("part").alias("score"), F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("id", "score")


def bm25_scan(pages: DataFrame, terms: list[str]) -> DataFrame:
    """As bm25, straight from pages (id, title, text) without an index: one pass for the statistics, one for the scores, no shuffle."""
    wanted = sorted(set(terms))
    fields = ("title", "text")
    words = pages.where(~T.is_blank(F.col("text"))).select("id", *[T.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields])
    count = lambda f, t: F.size(F.filter(f, lambda w: w == t))
    rows = words.select("id", *[F.size(f).alias(f"dl_{f}") for f in fields], *[count(f, t).alias(f"tf_{f}_{i}") for f in fields for i, t in enumerate(wanted)])
    holds = [F.sum((F.col(f"tf_{f}_{i}") > 0).cast("int")).alias(f"df_{f}_{i}") for f in fields for i in range(len(wanted))]
    s = rows.agg(F.count("*").alias("n"), *[F.avg(f"dl_{f}").alias(f"mean_{f}") for f in fields], *holds).first()
    score, every = F.lit(0.0), F.lit(True)
    for i in range(len(wanted)):
        df = max(s[f"df_{f}_{i}"] or 0 for f in fields)
        idf = log(1 + (s["n"] - df + 0.5) / (df + 0.5))
        tf = {f: F.col(f"tf_{f}_{i}") for f in fields}
        parts = [BOOST[f] * idf * tf[f] * (K1 + 1) / (tf[f] + K1 * (1 - B + B * F.col(f"dl_{f}") / (s[f"mean_{f}"] or 1.0))) for f in fields]
        score, every = score + F.greatest(*parts), every & (F.greatest(*tf.values()) > 0)
    hit = F.array(F.struct("id", score.alias("score")))
    # a filter would be pushed below the counts, and every text taken apart again for it
    return rows.select(F.inline(F.when(every, hit).otherwise(F.slice(hit, 1, 0))))


def _places(item: Item, columns: dict[str, str]) -> Column:
    """Where an item begins, of the position lists in columns."""
    first = F.coalesce(F.col(columns[item.words[0]]), F.array().cast("array<int>"))
    rest = [(F.col(columns[w]), g) for w, g in zip(item.words[1:], item.gaps[1:])]
    if not rest:
        return first
    holds = lambda p: reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(c, p + g), F.lit(False)) for c, g in rest])
    return F.filter(first, holds)


def match(postings: DataFrame, branches: list[list[Item]], ids: DataFrame | None = None) -> DataFrame:
    """id and, for branch i, a column of the places of its required items (null if it doesn't match). ids is needed where a branch only forbids."""
    terms = sorted({w for b in branches for item in b for w in item.words})
    columns = {t: f"p{i}" for i, t in enumerate(terms)}
    found = postings.where(F.col("term").isin(terms)).groupBy("id").agg(*[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(c) for t, c in columns.items()])
    if any(all(item.negated for item in b) for b in branches):
        if ids is None:
            raise ValueError("a query that only excludes needs the ids of all documents")
        found = ids.select("id").join(found, "id", "left")
    out = []
    for i, b in enumerate(branches):
        places = [(_places(item, columns), item) for item in b]
        tests = [(F.size(p) > 0) != F.lit(item.negated) for p, item in places]
        needed = [F.struct(p.alias("at"), F.lit(max(item.gaps)).alias("width")) for p, item in places if not item.negated]
        needed = F.array(*needed) if needed else F.array().cast("array<struct<at:array<int>,width:int>>")
        out.append(F.when(reduce(lambda x, y: x & y, tests), needed).alias(f"b{i}"))
    matched = found.select("id", *out)
    return matched.where(reduce(lambda x, y: x | y, [F.col(f"b{i}").isNotNull() for i in range(len(branches))]))


def covers(lists: list[tuple[list[int], int]]) -> float:
    """The score of the minimal intervals that hold an item of every list (places, width)."""
    if not lists or any(not at for at, _ in lists):
        return 0.0
    events = sorted((p, p + width, k) for k, (at, width) in enumerate(lists) for p in at)
    total, last_begin = 0.0, -1
    latest: dict[int, tuple[int, int]] = {}
    for begin, end, k in events:
        latest[k] = (begin, end)
        if len(latest) == len(lists):
            low, high = min(b for b, _ in latest.values()), max(e for _, e in latest.values())
            if low > last_begin:
                last_begin = low
                total += 1 / (1 + max(0, high - low - sum(w for _, w in lists) - len(lists) + 1))
    return total


def cover_density(matched: DataFrame) -> DataFrame:
    """id, score: the best branch's covers."""

    @F.pandas_udf("double")
    def density(branch: pd.Series) -> pd.Series:
        return branch.map(lambda items: 0.0 if items is None else covers([(list(x["at"]), int(x["width"])) for x in items]))

    branches = [c for c in matched.columns if c != "id"]
    scores = [density(F.col(c)) for c in branches]
    return matched.select("id", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("score"))
