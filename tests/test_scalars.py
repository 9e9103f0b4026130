"""Addresses, texts and query strings, each against tables of edge cases or a plain restatement."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import query as Q
from inkwell.functions import text as T
from inkwell.functions import urls as U
from inkwell.functions.stem import stem


def apply(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"n int, x {kind}")
    return [r.y for r in rows.select("n", f(F.col("x")).alias("y")).orderBy("n").collect()]


def test_stripped(spark):
    cases = {"https://www.a.com/p/": "a.com/p", "http://a.com//?q=1": "a.com", "www.a.com/x?y#z": "a.com/x", "a.com/P#f": "a.com/P#f", "HTTP://a.com": "HTTP://a.com", "": ""}
    assert apply(spark, U.stripped, [*cases, None]) == [*cases.values(), None]


def test_clean_and_base(spark):
    cases = {
        " HTTPS://A.Example.com/P?utm_source=x&b=2#f ": ("https://a.example.com/P?b=2", "https://a.example.com"),
        "http://a.com": ("http://a.com", "http://a.com"),
        "ftp://a.com": (None, None),
        "no address": (None, None),
        "http://a.com/?fbclid=1": ("http://a.com/", "http://a.com"),
    }
    assert apply(spark, U.clean, cases) == [c for c, _ in cases.values()]
    assert apply(spark, U.base, cases) == [b for _, b in cases.values()]
    assert apply(spark, U.domain, ["http://www.a.com:80/x", None, "x"]) == ["a.com:80", "", ""]
    assert apply(spark, U.is_valid, ["http://a.com", "http://-a.com", None, "http://a b"]) == [True, False, False, False]


@pytest.mark.parametrize(
    ("url", "post"),
    [
        ("https://a.com/tag", False), ("https://a.com/author", True), ("https://a.com/author/x", False), ("https://a.com/about/x", False), ("https://a.com/ABOUT", False), ("https://a.com/aboutx", True),
        ("http://localhost:8/x", False), ("http://0.0.0.0/", False), ("https://youtube.com/x", False), ("https://youtubeXcom/x", False), ("https://www.youtube.com/x", True), ("https://a.com/x/comic/", False), ("https://a.com/2024/post", True),
    ],
)
def test_is_post(spark, url, post):
    assert apply(spark, U.is_post, [url]) == [post]


def test_words_and_excerpts(spark):
    nbsp = "a b  c"
    assert apply(spark, T.word_count, [nbsp, "", None, " \n"]) == [3, 0, 0, 0]
    long = " ".join(["w"] * 301)
    exact = "  ".join(["w"] * 300)
    assert apply(spark, T.snippet, [long, exact, None, ""]) == [" ".join(["w"] * 300) + "...", exact, "", ""]
    assert apply(spark, T.description, ["x" * 280, "x" * 281, "", None]) == ["x" * 280, "x" * 280 + "...", T.NO_DESCRIPTION, T.NO_DESCRIPTION]
    assert apply(spark, T.title, ["x" * 101, "", None]) == ["x" * 100, "Untitled", "Untitled"]
    assert apply(spark, T.seconds, [145, 0, 1999], "int") == [0.15, 0.0, 2.0]


def chunks_of(text, target=800, most=1200):
    """The contract in plain Python."""
    if not text:
        return []
    if len(text) <= target:
        return [text]
    out, open_, size = [], [], 0

    def close():
        if open_:
            out.append(" ".join(open_))

    for x in (s.strip() for s in re.split(r"(?<=[!?.])\s+|\n{2,}", text)):
        if not x:
            continue
        if len(x) > most:
            close()
            open_, size = [], 0
            for w in x.split():
                if size + len(w) + 1 > most:
                    close()
                    open_, size = [w], len(w)
                else:
                    open_, size = [*open_, w], size + len(w) + 1
            continue
        if size + len(x) + 1 > target and open_:
            close()
            open_, size = [], 0
        open_, size = [*open_, x], size + len(x) + 1
    close()
    return out


def test_chunks(spark):
    cases = ["", None, "x" * 800, "x" * 801, " pad ", "One. " * 300, ("w" * 50 + " ") * 40, "y" * 1300 + " tail", "para one\n\npara two " * 60, ("a" * 900 + ". ") * 3, "short. " + "word " * 400 + ". end. " * 5]
    assert apply(spark, T.chunks, cases) == [chunks_of(c) for c in cases]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .!?\n", max_size=60), min_size=1, max_size=5))
def test_chunks_property(spark, texts):
    f = lambda c: T.chunks(c, 20, 30)
    assert apply(spark, f, texts) == [chunks_of(t, 20, 30) for t in texts]


def test_pages(spark):
    pairs = [(1, 1), (1, 9), (5, 9), (9, 9), (3, 5)]
    rows = spark.createDataFrame(pairs, "p int, t int").select(T.page_window(F.col("p"), F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [[], [1, 2, 3, 0, 9], [1, 0, 3, 4, 5, 6, 7, 0, 9], [1, 0, 7, 8, 9], [1, 2, 3, 4, 5]]


QUERIES = ['site:a.com x SITE:b.org -site:q website:z "q r"', "", "   ", "site:only.com", "site:a site:b", 'say "open', '"one" "two three"', "site:!!!", None, "plain  words"]


def test_query_parser(spark):
    parsed = [Q.parse(q) for q in QUERIES]
    assert parsed[0] == ('x - website:z "q r"', ["a.com", "b.org", "q"], ["q r"])
    assert [p[1] for p in parsed[3:5]] == [["only.com"], ["a", "b"]]
    assert apply(spark, Q.sites, QUERIES) == [p[1] for p in parsed]
    assert apply(spark, Q.phrases, QUERIES) == [p[2] for p in parsed]
    assert apply(spark, Q.clean, QUERIES) == [p[0] for p in parsed]


def test_web_query():
    def words(t):
        return list(enumerate(re.findall(r"\w+", t.lower())))

    def shape(q):
        return [[("-" if i.negated else "") + " ".join(i.words) for i in b] for b in Q.web_query(q, words)]

    assert shape("a b") == [["a", "b"]]
    assert shape('a or "b c" -d') == [["a"], ["b c", "-d"]]
    assert shape('-"x y" z') == [["-x y", "z"]]
    assert shape('"open phrase') == [["open phrase"]]
    assert shape("or or") == [] and shape("") == [] and shape(None) == [] and shape("- !") == []


@pytest.mark.parametrize(
    ("word", "root"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control"), ("is", "is"), ("naïves", "naïves")],
)
def test_stem(word, root):
    assert stem(word) == root
