"""SimHash, paragraph and suffix-array de-duplication, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import paragraphs, queries, simhash, substrings, suffixes
from inkwell.llm.common import table


def plain_fingerprint(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(nodes, linked):
    """The least reachable node for each, by comparing all pairs."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@settings(max_examples=150, deadline=None)
@given(st.text("aB é\t\x0bÄİ\x1f", max_size=40))
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text), "big") == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    row = spark.createDataFrame([("ab c d é",)], "t string").select(F.xxhash64("t").alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("ab c d é".encode(), 42)


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("hot", [4096, 2])
def test_links_are_all_found(spark, hot):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {0, 1, 2**64 - 1} | {flipped(rng, b, rng.randrange(0, 7)) for b in base for _ in range(4)}
    near = rng.getrandbits(64) & ~0xFFF  # a full bucket: they share all but twelve bits
    fps |= {near | rng.randrange(4096) for _ in range(60)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(x),) for x in sorted(fps)], "fp long")
    got = {(r.a, r.b) for r in simhash.linked(df, hot=hot).collect()}
    s = sorted(map(signed, fps))
    assert got == {(a, b) for a in s for b in s if a < b and ((a ^ b) % 2**64).bit_count() <= 4}


def test_simhash_contract(spark, docs_of):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(12):
        text = [rng.choice(words) for _ in range(400)]
        rows.append((i * 10, " ".join(text)))
        for j in range(1, 4):
            text = list(text)
            text[rng.randrange(400)] = "changed"
            rows.append((i * 10 + j, " ".join(text)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "ONE"), (505, "one two three"), (506, "same text here ok now"), (506, "same text here ok now"), (None, "same text here ok now"), (None, None), (507, "long " * 60_000)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    fp = {(d, t): plain_fingerprint(t) for d, t in rows}
    root = grouped(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (d, _), f in fp.items():
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    assert Counter(map(tuple, got)) == Counter((d, f"{fp[d, t]:016x}", least[root[fp[d, t]]]) for d, t in rows)
    kept = simhash.keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(docs_of([])).collect() == [] and simhash.keep_one(docs_of([])).collect() == []


def pair_hash(a, b):
    h = lambda w: int.from_bytes(hashlib.md5(w).digest()[:8], "little") >> 33
    return (h(a) * 1103515245 + h(b) * 12345) % (2**31 - 1)


def brute_pieces(text, reach):
    """(piece, start, words) of a text, cut word by word."""
    w = re.sub("[\u4e00-\u9fff]", r" \g<0> ", (text or "").lower()).encode().split()
    n = len(w)
    g = [pair_hash(a, b) for a, b in zip(w, w[1:])] + [float("inf")]
    alike = lambda a, b: a >= 0 and b <= n and len(set(w[a:b])) == 1
    room = range(reach + 1, n - reach)
    ends = {i for i in room if w[i] != w[i - 1] and alike(i - reach - 1, i)}
    starts = {i for i in room if w[i] != w[i - 1] and alike(i, i + reach + 1) and not ends & set(range(i - reach, i))}
    forced = ends | starts
    least = {i for i in room if g[i] < min(g[i - reach : i]) and g[i] <= min(g[i + 1 : i + reach + 1]) and not forced & set(range(i - reach, i + reach + 1))}
    at = sorted({0} | least | forced) + [n] if n else []
    return [(k, a, w[a:b]) for k, (a, b) in enumerate(zip(at, at[1:]))]


def brute_paragraphs(rows, reach):
    shingles = lambda w: frozenset(b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    places = sorted({(d is None, d, k, a, len(w), shingles(w), t) for d, t in rows for k, a, w in brute_pieces(t, reach)}, key=lambda p: (p[0], p[1] or 0, p[2]))
    variants = sorted({p[5] for p in places}, key=sorted)
    number = {s: n for n, s in enumerate(variants)}
    root = grouped(range(len(variants)), lambda a, b: 5 * len(variants[a] & variants[b]) >= 4 * len(variants[a] | variants[b]))
    members = {}
    for p in places:
        members.setdefault(root[number[p[5]]], []).append(p)
    out = []
    for group in members.values():
        if len(group) > 1:
            for n, p in enumerate(group):
                out.append((p[1], p[2], p[3], p[4], group[0][1], group[0][2], n > 0))
    return sorted(out, key=str)


def in_order(got):
    return sorted({(r.doc_id, r.piece, r.start, r.words, r.first_doc, r.first_piece, r.removed) for r in got}, key=str)


@pytest.mark.parametrize(("reach", "hot"), [(3, 64), (12, 64), (6, 1)])
def test_paragraphs(spark, docs_of, reach, hot):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(200)]
    lines = [[rng.choice(words) for _ in range(rng.randrange(16, 90))] for _ in range(12)]
    rows = []
    for i in range(60):
        text = []
        for line in rng.sample(lines, 3):
            line = list(line)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(rng.choice(" \n").join(line))
        rows.append((i, rng.choice(" \n").join([f"own {i} line", *text, "a b c", "x y"])))
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, " ".join(lines[0]) + "\n" + " ".join(lines[0]).upper()), (104, rows[0][1]), (104, rows[0][1]), (105, " ".join(words * 300)), (None, rows[1][1])]
    rows += [(106, "of " * 90 + "the the one " + "the " * 30), (107, "one two " + "of " * 40 + "end"), (108, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往"), (109, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往"), (110, " \n ")]
    got = paragraphs.duplicate_paragraphs(docs_of(rows), reach, hot=hot).collect()
    assert in_order(got) == brute_paragraphs(rows, reach)
    assert paragraphs.duplicate_paragraphs(docs_of([])).collect() == []


def test_paragraphs_without_id(spark, docs_of):
    """Texts without id are places of their own, unless they are equal."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    got = paragraphs.duplicate_paragraphs(docs_of([(None, a), (None, a), (None, b), (None, b + " more"), (7, b)])).collect()
    assert sorted((r.doc_id or 0, r.words, r.first_doc, r.removed) for r in got) == [(0, 20, 7, True), (0, 21, 7, True), (7, 20, 7, False)]


@pytest.mark.parametrize("length", [51, 80, 120])
def test_paragraph_passages_within_lines(spark, docs_of, length):
    """A passage of over 50 words is found wherever it stands within longer lines."""
    rng = random.Random(length)
    own = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passages = [own(length) for _ in range(60)]
    rows = []
    for i, p in enumerate(passages):
        for j in range(2):
            words = own(40 + rng.randrange(60)) + p + own(40 + rng.randrange(60))
            rows.append((2 * i + j, "".join(w + rng.choice("      \n") for w in words)))
    rows += [(1000 + i, " ".join(own(200))) for i in range(40)]
    found = {r.doc_id for r in paragraphs.duplicate_paragraphs(docs_of(rows)).collect()}
    assert len(found & set(range(120))) >= 120 * (0.6 if length < 60 else 0.9)
    assert not {d for d in found if d >= 1000}


def test_paragraphs_fixture(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert in_order(queries.op9_substring_dedup(spark, sf_dir).collect()) == brute_paragraphs(rows, paragraphs.REACH)


def test_band_recall():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(300):
        shared = rng.integers(0, 2**63, 40).astype(np.uint64)
        a, b = (np.unique(np.concatenate((shared, rng.integers(0, 2**63, 5).astype(np.uint64)))) for _ in range(2))
        keys = paragraphs.minima(np.concatenate((a, b)), np.array([0, len(a)]))
        found += (keys[0] == keys[1]).any()
    assert found >= 292  # similarity 0.8


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array(values):
    a = [*values, 0]
    assert suffixes.suffix_array(np.array(a), 4).tolist() == sorted(range(len(a)), key=lambda i: a[i:])
    assert suffixes.suffix_array(np.array(a), 4, large=10**9).tolist() == sorted(range(len(a)), key=lambda i: a[i:])
    sa = suffixes.suffix_array(np.array(a), 4, large=0)
    assert sa.tolist() == sorted(range(len(a)), key=lambda i: a[i:])
    raw = np.array(values, np.uint8)
    order = sa[1:]
    want = {int(b): next((k for k in range(len(values)) if a + k >= len(values) or b + k >= len(values) or values[a + k] != values[b + k]), 0) for a, b in zip(order[:-1], order[1:])}
    assert suffixes.common_prefixes(raw, order).tolist() == [want.get(i, 0) for i in range(len(values))]


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array_of_long_texts(seed):
    """Several levels of recursion, with names by the thousand, and long common prefixes."""
    rng = random.Random(seed)
    words = [bytes(rng.choices(b"abcde", k=rng.randrange(2, 9))) for _ in range(300)]
    text = b" ".join(rng.choices(words, k=4000))
    text += text[:9000] + b"a" * 500 + text[3000:6000]
    s = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 0)
    sa = suffixes.suffix_array(s, 258)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: text[i:])
    lcp = suffixes.common_prefixes(np.frombuffer(text, np.uint8), sa[1:])
    for a, b in list(zip(sa[1:-1].tolist(), sa[2:].tolist()))[:: 1 + seed]:
        n = int(lcp[b])
        assert text[a : a + n] == text[b : b + n] and text[a + n : a + n + 1] != text[b + n : b + n + 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=30).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.integers(8, 11))
def test_repeat_classes(texts, length):
    got, want = {}, {}
    for o, f, k in zip(*suffixes.repeats(texts, length)):
        got.setdefault(k, set()).add((int(o), int(f)))
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            want.setdefault(t[j : j + length], set()).add((i, j))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def brute_repeats(rows, length=100):
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, out = set(), {}
    for no, d, t in order:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out[None if no else d, t] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return Counter(((d, *out[d, t or ""])) for d, t in rows)


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_contract(spark, docs_of, hot, monkeypatch):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("ab cé") for _ in range(n))
    shared = [letters(n) for n in (99, 100, 101, 180, 400, 1200)]
    rows = [(i, letters(rng.randrange(0, 300)) + rng.choice(shared) + letters(rng.randrange(0, 200)) + rng.choice(shared)) for i in range(60)]
    rows += [(70, "ab" * 300), (71, "a" * 99), (72, "a" * 100), (73, "a" * 101), (74, "a" * 5000), (75, None), (76, ""), (77, shared[5]), (78, shared[5]), (79, rows[3][1]), (80, rows[3][1]), (80, rows[3][1]), (None, rows[5][1]), (None, None), (81, rows[7][1][:-1] + "z")]
    if hot:
        args = {"hot_least": 3}
    else:
        args = {"text_per_shard": 3000, "fan": 3}
        monkeypatch.setattr(substrings, "SHARD_BYTES", 2000)
    got = substrings.remove_repeats(docs_of(rows), **args).collect()
    assert Counter(map(tuple, got)) == brute_repeats(rows)
    assert hot or substrings.remove_repeats(docs_of([])).collect() == []


def test_chunks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    rng = random.Random(0)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1000, 50, 100, 399, 400, 401, 250, 0)]
    starts = Counter()
    for raw, valid, text, offset in substrings._chunks(texts, 100):
        h, first, count = substrings.anchors(raw, valid)
        for f, c in zip(first, count):
            for k in range(c):
                assert text[f + k] == text[f] and offset[f + k] == offset[f] + k
                starts[int(text[f]), int(offset[f]) + k] += 1
    assert starts == Counter((i, j) for i, t in enumerate(texts) for j in range(len(t) - 99))


def test_equal_strings_have_equal_anchors():
    rng = random.Random(5)
    part = bytes(rng.choice(b"abcd ") for _ in range(300))
    hashes = []
    for pad in (b"", b"x" * 37, bytes(rng.choice(b"abcd ") for _ in range(411))):
        raw = np.frombuffer(pad + part + pad[::-1], np.uint8)
        h, first, count = substrings.anchors(raw, np.arange(len(raw)) <= len(raw) - 100)
        of = {int(f) + k: int(x) for x, f, c in zip(h, first, count) for k in range(c)}
        hashes.append([of[len(pad) + i] for i in range(201)])
    assert hashes[0] == hashes[1] == hashes[2]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.integers(0, 5)), min_size=1, max_size=50))
def test_packets(rows):
    a, b = (np.array(x, np.int64) for x in zip(*rows))
    x, y = substrings._unpack(substrings._pack(a, b), 2)
    assert x.tolist() == a.tolist() and y.tolist() == b.tolist()


def test_flush_costs_the_same_at_every_size():
    """A flush reaches a bounded number of receivers, and a row takes as many bytes, whether there are 64 shards or those of 100 TB."""
    rng = np.random.default_rng(0)
    n = 1 << 16
    key, g, doc, mark = (rng.integers(-(2**62), 2**62, n) for _ in range(4))
    doc = np.sort(np.abs(doc) % 10_000)
    low = rng.integers(0, 2000, n)
    done, no = rng.random(n) < 0.2, np.zeros(n, bool)
    sizes = []
    for shards in (64, 1_500, 120_000, 4_000_000):
        groups, each = substrings.groups_of(shards, 512 if shards < 200_000 else 2048)
        to = substrings.shard_of(key, done, doc, shards) // each
        out = substrings._packets(to, key, g, no, doc, mark, low, low + 9, done)
        assert out.num_rows <= groups <= 2048
        back = [substrings._unpacked(p.as_py()) for p in out.column("packet")]
        assert sum(len(b[0]) for b in back) == n and {int(m) for b in back for m in b[4]} == set(mark.tolist())
        sizes.append(sum(len(p.as_py()) for p in out.column("packet")) / n)
    assert max(sizes) < 1.25 * min(sizes)


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline as P

    from inkwell.llm import decontaminate, quality

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    outs = {}
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        docs = outs[name] = docs.persist()
        assert name == "sharding" or docs.columns == columns
    names = [n for n, _ in P.STAGES]
    rows = lambda n: [tuple(r) for r in outs[n].select(*columns).collect()]
    raw = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    good = {r.doc_id for r in quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect() if r.predicted}
    first, second, third, mixed = (rows(n) for n in names[:4])
    assert {r[0] for r in first} == good and all(raw[r[0]] == r[1] for r in first)
    fp = {r[0]: plain_fingerprint(r[1], 5) for r in first}
    root = grouped(sorted(set(fp.values())), lambda a, b: (a ^ b).bit_count() <= 4)
    assert {r[0] for r in second} == {min(d for d in fp if root[fp[d]] == g) for g in set(root.values())}
    items = [decontaminate.plain(r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert {r[0] for r in third} == {r[0] for r in second if not any(i in decontaminate.plain(r[1]) for i in items)}
    assert {r[0] for r in mixed} <= {r[0] for r in third}
    shards = outs[names[4]].collect()
    assert Counter(r.doc_id for r in shards) == Counter(r[0] for r in mixed)
    assert Counter(map(tuple, P.run(spark, sf_dir).collect())) == Counter(map(tuple, shards))
    for df in outs.values():
        df.unpersist()


def test_pipeline_with_null_and_empty_rows(spark, docs_of, tmp_path):
    """Nulls in any column, empty texts, repeated rows and an empty table pass through every stage."""
    import corpus_pipeline as P

    good = "the of and in that with by on one more sentence of plain words that says nothing twice."
    rows = [(1, good, "a"), (1, good, "a"), (2, None, "a"), (3, "", None), (None, good + " again", None), (None, None, None), (4, " \n ", "b"), (5, good + " " + " ".join(f"w{i}" for i in range(3000)), "b")]
    for name, table_rows in (("full", rows), ("empty", [])):
        folder = str(tmp_path / name)
        docs_of(table_rows).select(*P.COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "w7 w8 w9 w10 w11 w12 w13"), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = P.run(spark, folder).collect()
        assert {r.doc_id for r in got} <= {r[0] for r in table_rows} and 5 not in {r.doc_id for r in got}
        assert len({r.slot for r in got}) <= len(got) and (got or not table_rows)


def test_pipeline_stages_read_what_was_written(spark, sf_dir, monkeypatch):
    import corpus_pipeline as P

    read = []

    def stage(spark, docs, _):
        read.append(docs.inputFiles())
        return docs.where(F.col("doc_id") % 7 != len(read))

    monkeypatch.setattr(P, "STAGES", [(str(k), stage) for k in range(3)])
    got = sorted(r.doc_id for r in P.run(spark, sf_dir).collect())
    assert got == sorted(r.doc_id for r in table(spark, sf_dir, "documents").collect() if r.doc_id % 7 not in (1, 2, 3))
    shared = spark.conf.get("spark.checkpoint.dir")
    assert [all(shared in f for f in files) for files in read] == [False, True, True] and all(read)
