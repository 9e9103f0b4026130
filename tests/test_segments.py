"""The index by segments and generations."""

import random
from collections import Counter

import regex
from pyspark.sql import functions as F

from inkwell.functions.stem import STOP, stem
from inkwell.operators import index, search
from inkwell.sources.schemas import PAGES
from inkwell.sources.store import Store, shared_root

WORD = regex.compile(r"[\p{L}\p{N}]+")


def pages_of(spark, texts):
    return spark.createDataFrame([(i, t, f"https://s{i % 2}.example.com/{i}/", f"f{i}", None, x, None) for i, (t, x) in texts.items()], PAGES)


def some_texts(n, seed, words="the hill fox running runs dog Dogs of ponies pony hopping été x1"):
    rnd = random.Random(seed)
    made = {i: (rnd.choice(["A dog", "", "Hill fox", None]), " ".join(rnd.choices(words.split(), k=rnd.randrange(0, 40)))) for i in range(n)}
    return made | {n: ("only", "  "), n + 1: ("none", None), n + 2: ("punctuation", "!!! ...")}


def test_postings_are_counted_row_by_row(spark):
    texts = some_texts(60, 1)
    pages = pages_of(spark, texts)
    keyword, full = Counter(), {}
    for i, (title, text) in texts.items():
        if text and text.strip():
            for field, body in (("title", title or ""), ("text", text)):
                words = WORD.findall(body.lower())
                keyword.update({(w, i, field, n, len(words)): 1 for w, n in Counter(words).items()})
        if title is not None and text is not None:
            for at, w in enumerate(WORD.findall(f"{title} {text}".lower())):
                full.setdefault((w, i), []).append(at)
    found = index.keyword_postings(pages)
    assert Counter(tuple(r) for r in found.collect()) == keyword
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: {(r.term, r.id): list(r.positions) for r in df.select("term", "id", "positions").collect()}
    assert rows(index.text_postings(pages, stemmed=False)) == full
    stems = {}
    for (w, i), at in full.items():
        if w not in STOP:
            stems.setdefault((stem(w), i), []).extend(at)
    stems = {k: sorted(v) for k, v in stems.items()}
    assert rows(index.text_postings(pages)) == stems
    assert rows(index.text_postings(pages, terms=["poni", "hop", "dog"])) == {k: v for k, v in stems.items() if k[0] in ("poni", "hop", "dog")}
    assert rows(index.text_postings(pages, stemmed=False, terms=["the"])) == {k: v for k, v in full.items() if k[0] == "the"}
    df = {r.term: r.df for r in index.term_stats(pages).collect()}
    by_field = Counter((w, f) for w, _, f, _, _ in keyword)
    assert df == {w: max(by_field[w, "title"], by_field[w, "text"]) for w, _ in by_field}


def test_postings_in_slices():
    import pyarrow as pa

    lists = [["a", "b", "a"], [], ["c"], ["b"] * 5, ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10, 11], pa.int64()), pa.array(lists, pa.list_(pa.string()))], names=["id", "tokens"])
    want = {(w, i): [n for n, x in enumerate(t) if x == w] for i, t in zip([7, 8, 9, 10, 11], lists) for w in t}
    was = index.SLICE_TOKENS
    try:
        for index.SLICE_TOKENS in (1, 4, 100):
            out = [r for b in index._word_postings(iter([batch.slice(1), batch.slice(0, 1)])) for r in b.to_pylist()]
            assert {(r["term"], r["id"]): r["positions"] for r in out} == want and len(out) == len(want)
    finally:
        index.SLICE_TOKENS = was


def test_stems_keep_the_beginning_of_words():
    ends = "s sses ies y ed eed ing ational tional enci anci izer abli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti bility icate ative alize iciti ical ful ness e ll ion ement able ible ably bly".split()
    for root in ("", "b", "s", "tr", "hop", "fil", "sens", "conform", "rel", "y", "pon", "abil", "oss", "matt", "controll", "vi"):
        for one in ends:
            for two in ["", *ends]:
                w = root + one + two
                assert w.startswith(stem(w)[:-2]), w


def test_upserts_equal_a_new_build(spark, tmp_path):
    """Batches that change, add and blank pages, one of them done twice, against an index built at the end."""
    texts = some_texts(40, 2)
    store, fresh = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    engine, other = search.Engine(store, min_score=0.0), search.Engine(fresh, min_score=0.0)
    store.overwrite("pages", pages_of(spark, texts))
    engine.reindex(2)
    for n, batch in enumerate(({3: ("new fox", "fox dog dog"), 100: ("Added", "the hill of ponies")}, {3: ("x", " "), 5: ("again", "pony fox"), 6: (None, "dog")}, {5: ("last", "running pony")})):
        texts |= batch
        store.overwrite("pages", pages_of(spark, texts))
        ids = spark.createDataFrame([(i,) for i in (*batch, 999)], "id long")
        for _ in range(1 + (n == 1)):
            engine.index_pages(ids)
    fresh.overwrite("pages", pages_of(spark, texts))
    other.reindex(3)
    for name in index.MAKERS:
        columns = [c for c in fresh.read(name).columns if c != "gen"]
        rows = [sorted(map(str, index.live(s, name).select(*columns).collect())) for s in (store, fresh)]
        assert rows[0] == rows[1] and rows[0], name
    for query in ("dog", "fox pony", "hill site:s0"):
        a, b = engine.keyword(query), other.keyword(query)
        assert a.total == b.total and [tuple(r) for r in a.results.collect()] == [tuple(r) for r in b.results.collect()]
    assert engine.full_text("pony -dog").total == other.full_text("pony -dog").total > 0
    assert max(store.generations("lengths")) == 4 and not store.exists("index_batch")
    engine.reindex()
    assert engine.keyword("dog").total == other.keyword("dog").total and len(store.generations("lengths")) == 1
    engine.index_pages(spark.createDataFrame([(3,)], "id long"))
    assert store.read("replaced").count() == 1
    assert engine.keyword("dog").total == other.keyword("dog").total


def test_many_ids_are_chosen_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(index, "SENT_IDS", 3)
    pages = spark.range(20).withColumn("text", F.lit("t"))
    for ids in (range(0, 6, 2), range(0, 20, 2)):
        got = index.chosen(pages, spark.createDataFrame([(i,) for i in (*ids, *ids)], "id long"))
        assert sorted(r.id for r in got.collect()) == list(ids)


def test_terms_are_counted_before_anything_is_shuffled(spark):
    pages = spark.createDataFrame([(1, "a b", "a a c"), (2, None, "a"), (3, "a", "x"), (4, "b", " ")], "id long, title string, text string")
    found = index.term_stats(pages)
    assert {r.term: r.df for r in found.collect()} == {"a": 2, "b": 1, "c": 1, "x": 1}
    assert "id#" not in found._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[0]  # terms alone are shuffled


def test_a_query_builds_only_what_it_reads(spark, tmp_path):
    from inkwell.plans.searches import _Posts

    store = _Posts(spark, Store(spark, shared_root(spark)).scratch(), pages_of(spark, some_texts(10, 3)))
    engine = search.Engine(store, min_score=0.0)
    there = lambda: {t for t in (*index.MAKERS, "keyword_stats", "pages") if store.exists(t)}
    assert engine.search(" \t ").total == 0 and engine.random(2).count() == 1 and there() == set()
    assert engine.keyword("site:s1").total > 0 and there() == {"documents_index"}
    assert engine.keyword("dog").total > 0 and there() == {"documents_index", "keyword_postings", "lengths", "keyword_stats"}
    assert engine.full_text("dog").total > 0 and there() == {*index.MAKERS, "keyword_stats"}


def test_keyword_postings_in_slices():
    import pyarrow as pa

    lists = [["b", "é", "b", "a"], [], ["z"], ["b"] * 5, ["a", "\U0001f100", "ￜ"]]
    fields = ["title", "text", "title", "text", "text"]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 7, 9, 10, 11], pa.int64()), pa.array(fields), pa.array(lists, pa.list_(pa.string()))], names=["id", "field", "tokens"])
    want = sorted((w, i, f, n, len(t)) for i, f, t in zip([7, 7, 9, 10, 11], fields, lists) for w, n in Counter(t).items())
    was = index.SLICE_TOKENS
    try:
        for index.SLICE_TOKENS in (1, 4, 100):
            found = [[tuple(r.values()) for r in b.to_pylist()] for b in index._counts(iter([batch.slice(1), batch.slice(0, 1), batch.slice(1, 1)]))]
            assert sorted(r for b in found for r in b) == want
            for b in found:
                assert [r[0].encode() for r in b] == sorted(r[0].encode() for r in b)
    finally:
        index.SLICE_TOKENS = was


def test_a_postings_task_counts_no_token_by_lambda(spark):
    """The plan that makes the whole index has no function of every token of a row but the one that finds them."""
    plan = index.keyword_postings(pages_of(spark, some_texts(5, 4)))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan and "Exchange" not in plan
