"""Shared parts: word counts, copies, prefix sums, components."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.llm import common as C


def test_word_count(spark):
    texts = ["", None, " ", "a", " a", "a ", "\t a\x0bb\n\nc ", "a b", "x" * 10_000, "é è", "\x1fa \x1f"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in rows.select("i", C.word_count(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_copies(spark):
    big = C.COPIES_PER_TASK * 2 + 3
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", big), ("d", C.COPIES_PER_TASK)], "k string, n long")
    got = {r.k: (r.c, r.lo, r.hi, r.d) for r in C.copies(rows, "n", "i").groupBy("k").agg(F.count("*").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.countDistinct("i").alias("d")).collect()}
    assert got == {k: (n, 0, n - 1, n) for k, n in (("a", 1), ("b", 3), ("c", big), ("d", C.COPIES_PER_TASK))}


def test_running_starts(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(4), i, rng.randrange(5)) for i in range(200)] + [(None, 1, 900, 2), (None, 2, 901, 3)]
    got = C.running_starts(spark.createDataFrame(rows, "g string, b int, i int, n long"), ["g"], "b", ["i"], "n", "s").collect()
    want = {}
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            want[r[2]] = total
            total += r[3]
    assert {r.i: r.s for r in got} == want


@pytest.mark.parametrize("links", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (4, 9)], [(i, i + 1) for i in range(40)], [(50, i) for i in range(40)]])
def test_components(spark, links):
    root = {x: x for pair in links for x in pair}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


def test_cut_uses_the_shared_folder(spark):
    C.cut(spark.range(3)).count()
    from pathlib import Path

    assert any(p.name.startswith("inkwell-") for p in Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).iterdir())
