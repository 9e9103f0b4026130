"""Mixing sources to target weights, in blocks of a fixed number of words.

Every source is a stream of its documents, packed into blocks of `block` words. The mix has slots of a block each, as many as
its targets ask for, shared evenly by a fixed number of output shards. For each shard a multinomial draw says how many of its slots each
source fills; a source's counts are then scaled, so that over all shards they add up to what its target asks for. In that order the source's slots
are numbered: whole passes over all its blocks and one pass that ends where the target does. Slot i of a pass maps to a block by a
pseudorandom permutation of the source's block numbers, made anew for every pass; then slots and blocks join by number. So the draws say which
shard takes which words. All are seeded by shard and source rank, so reruns agree.

Targets: source weights repeat in order of the sources' code points (null last) and share all words; no target exceeds
`most` times its source's words, and what that leaves over is shared again by weight.

Defined cases: null, blank and empty texts have no words and take none; a null source is a source, the last; rows equal in
id, source and text are laid out one after another, each with its own words; an empty table gives no rows. Only the
columns of documents are read. No source, however large, is held in one task: streams are cut into hashed buckets, slots
into ranges. The table of sources (a row each) is joined to documents; Spark broadcasts it while it is under its own limit
of size, and beyond that splits the partitions of hot sources (skew join).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import copies, cut, running_starts, spread, word_count

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 128
BUCKETS = 1024
SHARDS = 16
SEED = 42
CHUNK = 1 << 16
#: Shards that one task draws for; sources that a draw takes together, as a power of two.
LOT, STRATUM = 256, 16
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = ["doc_id", "source", "size", "digest"]


def units(docs: DataFrame) -> DataFrame:
    """Rows of docs counted by id, source, number of words and text."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")).groupBy(*UNIT).agg(F.count("*").alias("n"))


def targets(counted: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """sid (rank), source, source_size, target of each source, without collecting the sources."""
    sizes = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ordered = cut(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = ordered.join(base, part == base["part"]).select("source", "source_size", (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("sid"))
    choose = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", choose))
    cap = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:  # each round adds sources at their limit; it ends when a round adds none
        at_cap = cap <= F.lit(level) * F.col("weight")
        n, full, rest = ranked.agg(F.count(F.when(at_cap, 1)), F.sum(F.when(at_cap, cap)), F.sum(F.when(~at_cap, F.col("weight")))).first()
        if n == held or not rest:
            break
        held, level = n, (total - (full or 0)) / rest
    return cut(ranked.select("sid", "source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target")))


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size) at index: a four-round Feistel network that walks until it is in range."""
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    x = out.copy()
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = x >> half, x & mask
            for r in range(4):
                h = (right + np.uint64((key * 4 + r) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(32)
                left, right = right, left ^ (h & mask)
            x = (left << half) | right
            done = x < size
            out[todo[done]] = x[done]
            todo, x = todo[~done], x[~done]
    return out.astype(np.int64)


def slots(goals: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """sid, shard, slot, block, turn, words: every slot of the mix, with the output shard it belongs to and the first words of the block it takes.

    A shard's draw over very many sources is made in two steps, over strata of them and within each, so no task holds all sources.
    """
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    words = F.least(F.round("target").cast("long"), F.col("source_size") * MOST)
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    left = words - passes * F.col("source_size")
    plan = goals.select("sid", "source_size", n_blocks.alias("n_blocks"), passes.alias("passes"), left.alias("left"), (passes * n_blocks + F.ceil(left / block)).cast("long").alias("n_slots"))
    plan = cut(plan.where("n_slots > 0"))
    stratum = F.shiftright("sid", STRATUM).alias("stratum")
    sums = sorted(tuple(r) for r in plan.groupBy(stratum).agg(F.sum("n_slots")).collect())  # one row for 2^STRATUM sources
    number = {k: i for i, (k, _) in enumerate(sums)}
    shares = np.array([n for _, n in sums], np.float64)
    every = sum(n for _, n in sums)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sids, needs = np.array(row.sids, np.int64), np.array(row.needs, np.float64)
                for shard in range(row.lot, min(row.lot + LOT, shards)):
                    room = every // shards + (shard < every % shards)
                    room = np.random.default_rng([seed, shard]).multinomial(room, shares / shares.sum())[number[row.stratum]]
                    count = np.random.default_rng([seed, shard, row.stratum + 1]).multinomial(room, needs / needs.sum())
                    yield pd.DataFrame({"sid": sids, "shard": shard, "drawn": count}).query("drawn > 0")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                slot = np.arange(row.first, min(row.first + CHUNK, row.upto))
                turn, i = slot // row.n_blocks, slot % row.n_blocks
                number = np.empty(len(slot), np.int64)
                for t in np.unique(turn):
                    number[turn == t] = permuted(i[turn == t], row.n_blocks, (seed << 40) ^ (row.sid << 3) ^ int(t))
                words = np.where(turn < row.passes, block, np.minimum(block, row.left - i * block))
                yield pd.DataFrame({"sid": row.sid, "shard": row.shard, "slot": slot, "block": number, "turn": turn, "words": np.minimum(words, row.source_size - number * block)})

    strata = plan.groupBy(stratum).agg(F.sort_array(F.collect_list(F.struct("sid", "n_slots"))).alias("all"))
    strata = strata.select("stratum", F.col("all.sid").alias("sids"), F.col("all.n_slots").alias("needs"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(LOT))).alias("lot"))
    drawn = strata.mapInPandas(draw, "sid long, shard int, drawn long")
    by_source = Window.partitionBy("sid")
    upto = F.sum("drawn").over(by_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    drawn = drawn.select("sid", "shard", "drawn", upto.alias("upto"), F.sum("drawn").over(by_source).alias("all"))
    counts = plan.join(drawn, "sid", "left").withColumns({"shard": F.coalesce("shard", F.pmod(F.xxhash64("sid"), F.lit(shards)).cast("int")), "drawn": F.coalesce("drawn", F.lit(1)), "upto": F.coalesce("upto", F.lit(1)), "all": F.coalesce("all", F.lit(1))})
    scaled = lambda c: F.expr(f"CAST((CAST({c} AS DECIMAL(19,0)) * CAST(n_slots AS DECIMAL(19,0))) DIV all AS LONG)")
    ranges = counts.select("sid", "source_size", "n_blocks", "passes", "left", "shard", scaled("upto - drawn").alias("low"), scaled("upto").alias("upto")).where("low < upto")
    ranges = ranges.withColumn("first", F.explode(F.sequence("low", F.col("upto") - 1, F.lit(CHUNK).cast("long")))).drop("low")
    ranges = ranges.repartition(spread(goals.sparkSession), "sid", "shard", "first")
    return ranges.mapInPandas(place, "sid long, shard int, slot long, block long, turn long, words long")


def layout(docs: DataFrame, goals: DataFrame, counted: DataFrame, block: int = BLOCK, buckets: int = BUCKETS) -> DataFrame:
    """UNIT, n, copy, sid, start: where each document lies in its source's stream of words."""
    names = goals.select("sid", F.col("source").alias("_source"))
    rows = counted.join(names, counted["source"].eqNullSafe(names["_source"])).drop("_source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("int")).withColumn("amount", F.col("size") * F.col("n"))
    placed = running_starts(rows, ["sid"], "bucket", ["doc_id", "digest", "size"], "amount", "begin")
    return copies(placed, "n", "copy").select(*UNIT, "n", "copy", "sid", (F.col("begin") + F.col("copy") * F.col("size")).alias("start"))


def taken_pieces(placed: DataFrame, goals: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """UNIT, copy, low, high, shard, turn: words low to high of a document go to an output shard, once for each row.

    What comes out of Python has no known size, so the join is told not to broadcast it.
    """
    used = slots(goals, block, shards, seed).groupBy("sid", "block").agg(F.collect_list(F.struct("shard", "turn", "words")).alias("uses"))  # at most `most` of a block
    end = F.col("start") + F.col("size")
    blocks = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    pieces = blocks.join(used.hint("merge"), ["sid", "block"]).select("*", F.inline("uses"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(end, F.col("block") * block + F.col("words"))
    return pieces.where(low < high).select(*UNIT, "copy", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high"), "shard", "turn")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and parts (shard, words: what each output shard takes of it) for every row of docs (doc_id, text, source)."""
    counted = cut(units(docs))
    goals = targets(counted, weights, most)
    placed = cut(layout(docs, goals, counted, block))
    pieces = taken_pieces(placed, goals, block, shards, seed)
    by_shard = pieces.groupBy(*UNIT, "copy", "shard").agg(F.sum(F.col("high") - F.col("low")).alias("words"))
    taken = by_shard.groupBy(*UNIT, "copy").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("parts"))
    taken = taken.select(*[F.col(c).alias(f"_{c}") for c in (*UNIT, "copy")], "taken", "parts")
    same = [placed[c].eqNullSafe(taken[f"_{c}"]) for c in (*UNIT, "copy")]
    by_source = goals.select("sid", "source_size", "target")
    none = F.array().cast("array<struct<shard:int,words:bigint>>")
    return placed.join(by_source, "sid").join(taken, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("parts", none).alias("parts"))


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One text for each output shard and time that takes any of a document's words: those words, in order."""
    for batch in batches:
        rows, texts = [], []
        for i, (text, pieces) in enumerate(zip(batch.column("text"), batch.column("pieces"))):
            text = text.as_py() or ""
            spans = [m.span() for m in WORD.finditer(text)]
            runs: dict[tuple[int, int], list[list[int]]] = {}
            for p in sorted(pieces.as_py(), key=lambda p: (p["turn"], p["shard"], p["low"])):
                own = runs.setdefault((p["turn"], p["shard"]), [])
                if own and own[-1][1] == p["low"]:
                    own[-1][1] = p["high"]
                else:
                    own.append([p["low"], p["high"]])
            for own in runs.values():
                rows.append(i)
                texts.append(" ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in own))
        take = lambda c: batch.column(c).take(pa.array(rows, pa.int64()))  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([take("doc_id"), pa.array(texts, pa.string()), take("lang"), take("source"), pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])


def mixed_texts(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself, as documents: of each document a row for every output shard that takes words of it, and for every time it does."""
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    counted = cut(units(docs))
    goals = targets(counted, weights, most)
    placed = cut(layout(docs, goals, counted, block))
    pieces = taken_pieces(placed, goals, block, shards, seed).groupBy(*UNIT, "copy").agg(F.collect_list(F.struct("low", "high", "shard", "turn")).alias("pieces"))
    pieces = pieces.select(*[F.col(c).alias(f"_{c}") for c in UNIT], "pieces")
    keyed = docs.select(*columns, word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))
    if counted.where("n > 1").limit(1).count():  # equal rows: one text stands for all of them, and is joined to each one's pieces
        keyed = keyed.groupBy(*UNIT).agg(F.min("text").alias("text"), F.min("lang").alias("lang"), F.min("n_chars").alias("n_chars"))
    same = [keyed[c].eqNullSafe(pieces[f"_{c}"]) for c in UNIT]
    joined = keyed.join(pieces, same).select("doc_id", "text", "lang", "source", "pieces")
    return joined.mapInArrow(_cutter, "doc_id long, text string, lang string, source string, n_chars long")
