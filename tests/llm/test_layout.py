"""Sharding and mixing."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from inkwell.llm import mixing, sharding
from inkwell.llm.mixing import permuted
from inkwell.llm.sharding import balanced

ROWS = [(1, "a"), (2, ""), (3, None), (None, "n"), (None, "n"), (4, "é" * 50_000), (5, "same"), (6, "same"), (7, "rep"), (7, "rep"), (7, "other")] + [(i, f"text {i}") for i in range(100, 400)]


def test_sharding_contract(spark, docs_of):
    got = sharding.shard_documents(docs_of(ROWS), balanced(16), balanced(17)).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, size(t), crc(t)) for d, t in ROWS)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    again = sharding.shard_documents(docs_of(random.Random(2).sample(ROWS, len(ROWS))), balanced(16), balanced(17)).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def spark_hash(*parts):
    """Spark's xxhash64 of texts and whole numbers, signed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(8, "little", signed=True), h)
    return h - 2**64 if h >= 2**63 else h


def brute_shard(key, node, path=""):
    """One descent of the tree, draw by draw."""
    total = lambda x: float(x) if not isinstance(x, dict) else sum(map(total, x.values()))
    kids = [(k, v) for k, v in node.items() if total(v) > 0]
    draw = lambda k, v: math.log((((spark_hash(key, f"{path}/{k}") % 2**64) >> 11) + 0.5) / 2**53) / total(v)
    k, v = kids[0] if len(kids) == 1 else max(kids, key=lambda kid: draw(*kid))
    return brute_shard(key, v, f"{path}/{k}") if isinstance(v, dict) else k


def test_sharding_by_hand(spark, docs_of):
    """All of the result from a second implementation, one document after another."""
    tree = {"g0": {"k0": {0: 1.0, 1: 2.5}, "k1": {2: 0.0, 3: 1.0}}, "g1": {"k0": {4: 3.0}}, "g2": {"k0": {5: 0.0}}}
    for small, grown in ((balanced(16), balanced(17)), (tree, tree)):
        found = []
        for d, t in ROWS:
            key, crc = "null" if d is None else str(d), zlib.crc32((t or "").encode())
            shard = brute_shard(key, small)
            found.append((shard, spark_hash(key, "slot", crc) % 1024, (d is not None, d or 0), len((t or "").encode()) + 1, crc, brute_shard(key, grown), d))
        want, at = Counter(), Counter()
        for shard, _, _, size, crc, more, d in sorted(found, key=lambda x: x[:5]):
            want[d, size, crc, "key", shard, at[shard], more] += 1
            at[shard] += 1
        got = sharding.shard_documents(docs_of(ROWS), small, grown).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
        assert Counter(map(tuple, got.collect())) == want


def test_sharding_growth_and_weights(spark):
    ids = spark.range(20_000).selectExpr("id AS doc_id", "CAST(id AS STRING) AS k")
    from pyspark.sql import functions as F

    for n in (16, 20):
        rows = ids.select(sharding.shard_of(F.col("k"), balanced(n)).alias("a"), sharding.shard_of(F.col("k"), balanced(n + 1)).alias("b")).collect()
        moved = [r for r in rows if r.a != r.b]
        assert all(r.b == n for r in moved) and abs(len(moved) / 20_000 - 1 / (n + 1)) < 0.01
        assert max(Counter(r.a for r in rows).values()) < 1.2 * 20_000 / n
    tree = {"g": {"k": {0: 1.0, 1: 3.0}}, "e": {"k": {2: 0.0, 3: 4.0}}}
    heavier = {"g": {"k": {0: 1.0, 1: 5.0}}, "e": {"k": {2: 0.0, 3: 4.0}}}
    rows = ids.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).collect()
    share = Counter(r.a for r in rows)
    assert 2 not in share and abs(share[3] / 20_000 - 0.5) < 0.02 and abs(share[1] / 20_000 - 0.375) < 0.02
    # only the subtree whose weight grew takes documents in
    assert all(r.b in (0, 1) for r in rows if r.a != r.b) and any(r.a != r.b for r in rows)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("k"), {"g": {"k": {0: 0.0}}})


def test_sharding_empty(spark, docs_of):
    assert sharding.shard_documents(docs_of([]), balanced(16)).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 17, 64, 1000])
def test_permutations(size):
    one = permuted(np.arange(size), size, 5)
    assert sorted(one) == list(range(size))
    assert size < 17 or (one.tolist() != permuted(np.arange(size), size, 6).tolist() and one.tolist() != list(range(size)))


def targets_of(sizes):
    """Water filling in plain Python: sizes by source, sorted, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def test_mixing_contract(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 900), rng.choice(["hot", "hot", "b", "ñ", "𝒳", None])) for i in range(300)]
    rows += [(900, "tiny words", "small"), (901, None, "b"), (902, " ", None), (903, "x y z", "hot"), (903, "x y z", "hot"), (None, "a b c", "b"), (904, "w " * 40_000, "b")]
    got = mixing.mix(docs_of(rows)).collect()
    words = lambda t: len((t or "").split())
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += words(t)
    want = targets_of(sizes)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, _ in rows)
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.parts)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK
    again = mixing.mix(docs_of(rng.sample(rows, len(rows)))).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))


def test_mixed_texts_hold_what_the_mix_takes(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.randrange(0, 700))), rng.choice(["a", "a", "a", "b", "c"])) for i in range(60)]
    rows += [(70, "p q  r\n s", "b"), (70, "p q  r\n s", "b"), (71, None, "a")]
    docs = docs_of(rows)
    taken, held = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    out = mixing.mixed_texts(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    text_of = {d: t for d, t, _ in rows}
    for r in out.collect():
        found = r.text.split()
        held[r.doc_id] += len(found)
        assert set(found) <= set(text_of[r.doc_id].split()) and r.n_chars == len(r.text)
        assert len(set(found)) == len(found)  # a pass takes a word once
    assert held == Counter({d: n for d, n in taken.items() if n})


def test_mixing_degenerate(spark, docs_of):
    assert mixing.mix(docs_of([])).collect() == []
    assert mixing.mixed_texts(docs_of([])).collect() == []
    only_blank = mixing.mix(docs_of([(1, "", "a"), (2, None, None)])).collect()
    assert [(r.taken, r.target) for r in only_blank] == [(0, 0.0), (0, 0.0)]


def goals_of(spark):
    return spark.createDataFrame([(0, "a", 1000, 2500.0), (1, "b", 50, 150.0), (2, "c", 700, 0.0)], "sid long, source string, source_size long, target double")


def test_slots_cover_whole_passes(spark):
    per = defaultdict(list)
    for r in mixing.slots(goals_of(spark), 128, shards=4).collect():
        per[r.sid].append(r)
    assert set(per) == {0, 1}
    for rows in per.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    uses = Counter(r.block for r in per[0] if r.turn < 2)
    assert set(uses.values()) == {2} and len(uses) == 8
    assert abs(sum(r.words for r in per[0]) - 2500) < 128 and sum(r.words for r in per[1]) == 150
    assert len({r.shard for r in per[0]}) > 1


def brute_slots(sources, block, shards, seed):
    """(sid, shard, slot, block) by the definition; sources: sid -> (words, words to be taken)."""
    need = {}
    for sid, (size, words) in sources.items():
        need[sid] = words // size * -(-size // block) + -(-(words % size) // block)
    sids, every = sorted(s for s in need if need[s]), sum(need.values())
    drawn = {}
    for shard in range(shards):
        room = every // shards + (shard < every % shards)
        room = np.random.default_rng([seed, shard]).multinomial(room, [1.0])[0]
        p = np.array([float(need[s]) for s in sids])
        for s, n in zip(sids, np.random.default_rng([seed, shard, 1]).multinomial(room, p / p.sum())):
            drawn[s, shard] = int(n)
    out = set()
    for s in sids:
        total, done, n_blocks = sum(drawn[s, k] for k in range(shards)), 0, -(-sources[s][0] // block)
        for k in range(shards):
            for slot in range(done * need[s] // total, (done + drawn[s, k]) * need[s] // total):
                turn, i = divmod(slot, n_blocks)
                out.add((s, k, slot, int(permuted(np.array([i]), n_blocks, (seed << 40) ^ (s << 3) ^ turn)[0])))
            done += drawn[s, k]
    return out


@pytest.mark.parametrize(("shards", "seed"), [(1, 42), (5, 42), (40, 7)])
def test_slots_follow_the_draws(spark, shards, seed):
    got = mixing.slots(goals_of(spark), 16, shards, seed).collect()
    assert {(r.sid, r.shard, r.slot, r.block) for r in got} == brute_slots({0: (1000, 2500), 1: (50, 150)}, 16, shards, seed)


def test_mix_by_words(spark, docs_of):
    """taken and parts, counted word by word from where documents lie and what slots take; another seed gives another mix."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randrange(0, 300), rng.choice(["a", "a", "a", "b", None])) for i in range(80)]
    docs = docs_of(rows)
    counted = mixing.units(docs)
    goals = mixing.targets(counted).persist()
    sid = {r.source: r.sid for r in goals.collect()}
    size = {r.sid: r.source_size for r in goals.collect()}
    start = {}
    for r in mixing.layout(docs, goals, counted, 32).collect():
        start[r.doc_id] = (sid[r.source], r.start, r.size)
    for s, n in size.items():  # documents lie side by side
        at = sorted((a, a + k) for t, a, k in start.values() if t == s and k)
        assert [a for a, _ in at] == [0, *[b for _, b in at[:-1]]] and at[-1][1] == n
    want = defaultdict(Counter)
    owner = {(t, a + i): d for d, (t, a, k) in start.items() for i in range(k)}
    for r in mixing.slots(goals, 32, 7).collect():
        for i in range(r.block * 32, r.block * 32 + r.words):
            want[owner[r.sid, i]][r.shard] += 1
    got = {r.doc_id: {p.shard: p.words for p in r.parts} for r in mixing.mix(docs, block=32, shards=7).collect()}
    assert {d: p for d, p in got.items() if p} == {d: dict(p) for d, p in want.items()}
    other = {r.doc_id: {p.shard: p.words for p in r.parts} for r in mixing.mix(docs, block=32, shards=7, seed=1).collect()}
    assert other != got
