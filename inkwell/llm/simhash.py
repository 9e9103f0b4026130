"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has a bit for each of 64 positions: set if more than half of the hashes of the text's word shingles have
it set. Fingerprints within `within` bits of each other are linked. With the bits in a ring of `parts` segments,
where parts - 2 >= within, two linked fingerprints agree in two whole segments at least, which are the join key; and
on the ring there is a segment from which the differences, summed over the next 1, 2, 3, ... segments, never exceed
that share of the budget (pigeonring). Pairs without such a chain are dropped before the full Hamming distance.

Only distinct fingerprints are compared, so a group of copies costs one row. A bucket of more than `hot` fingerprints
is divided again by the rest of the bits, one of whose within + 1 pieces agrees in every linked pair; that is exact too.

Defined cases: texts without words (null, empty, blank) have fingerprint 0, which links like any other; shorter texts than
a shingle are one shingle; equal rows each get a row; a null id never names a component unless all its ids are null; only
doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut

BITS = 64
SHINGLE = 4
WITHIN = 4
PARTS = 6
HOT = 64
STRIDE = 1 << 15


def fingerprint(text: str, words: int = SHINGLE) -> bytes:
    """Eight bytes, most significant first."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return bytes(8)
    whole = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_digest(whole, 42)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    ends, digest = ends[words - 1 :].tolist(), xxhash.xxh64_digest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), STRIDE):
        raw = b"".join([digest(whole[s:e], 42) for s, e in zip(starts[at : at + STRIDE], ends[at : at + STRIDE])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(starts)).tobytes()


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(x.as_py() or "", words) for x in batch.column("text"))
            fp = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, fp long")


def _segments(bits: range, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of the parts of a run of bits."""
    cuts = [bits.start + round(i * len(bits) / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(x: Column, seg: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(x, seg[0]).bitwiseAND(F.lit((1 << seg[1]) - 1))


def ring_chain(x: Column, parts: int, within: int) -> Column:
    """Whether the differences x, as a ring of parts, hold a chain that stays within its share of the budget."""
    d = [F.bit_count(_part(x, s)) for s in _segments(range(BITS), parts)]
    whole = F.lit(False)
    for i in range(parts):
        total, chain = d[i], d[i] <= within // parts
        for n in range(2, parts):
            total = total + d[(i + n - 1) % parts]
            chain = chain & (total <= n * within // parts)
        whole = whole | chain
    return whole


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def linked(fps: DataFrame, within: int = WITHIN, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of fp within so many bits; each pair at least once, and once only outside of hot buckets."""
    if parts - 2 < within:
        raise ValueError("two segments must stay free of differences: parts - 2 >= within")
    segs = _segments(range(BITS), parts)
    fp = F.col("fp")
    whole = [_mask(range(at, at + width)) for at, width in segs]
    keys = [F.struct(F.lit(k).alias("k"), fp.bitwiseAND(F.lit(_signed(whole[a] | whole[b]))).alias("key")) for k, (a, b) in enumerate(combinations(range(parts), 2))]
    rows = fps.select("fp", F.inline(F.array(*keys)))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("k", "key")))
    few, many = rows.where(F.col("n") <= hot).drop("n"), rows.where(F.col("n") > hot).drop("n")
    pieces = []
    for k, pair in enumerate(combinations(range(parts), 2)):
        rest = [b for i, (at, width) in enumerate(segs) if i not in pair for b in range(at, at + width)]
        for j in range(within + 1):
            own = rest[j * len(rest) // (within + 1) : (j + 1) * len(rest) // (within + 1)]
            pieces.append((k, j, _signed(_mask(own))))
    fine = [F.when(F.col("k") == k, fp.bitwiseAND(F.lit(mask))) for k, _, mask in pieces]
    by_j = [F.struct(F.lit(j).alias("j"), F.coalesce(*[f for f, (_, jj, _) in zip(fine, pieces) if jj == j]).alias("rest")) for j in range(within + 1)]
    many = many.select("fp", "k", "key", F.inline(F.array(*by_j)))

    def pairs(df: DataFrame, on: list[str]) -> DataFrame:
        x = F.col("a").bitwiseXOR(F.col("b"))
        first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(_signed(whole[a] | whole[b]))) == 0, k) for k, (a, b) in enumerate(combinations(range(parts), 2))])
        both = df.withColumnRenamed("fp", "a").join(df.withColumnRenamed("fp", "b"), on)
        near = (F.col("a") < F.col("b")) & ring_chain(x, parts, within) & (F.bit_count(x) <= within)
        return both.where(near & (F.col("k") == first)).select("a", "b")  # once, by the first key that agrees

    return pairs(few, ["k", "key"]).unionByName(pairs(many, ["k", "key", "j", "rest"]))


def _named(fps: DataFrame, within: int, parts: int, hot: int, least: Column) -> DataFrame:
    """fp and first, the least value of any fingerprint that links lead to."""
    groups = cut(fps.groupBy("fp").agg(F.min(least).alias("least")))
    roots = cut(components(linked(groups.select("fp"), within, parts, hot), "a", "b"))
    placed = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("first"))
    return placed.join(heads, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, within: int = WITHIN, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest id that links lead to, for every row."""
    fps = cut(fingerprints(docs, words), small=True)
    named = _named(fps, within, parts, hot, F.col("doc_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, words: int = SHINGLE, within: int = WITHIN, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """One row of docs for each component, with all its columns: that with the smallest id (null ids last).

    Rows equal in id and text are one before anything is shuffled, so a document that is listed very often is no burden.
    """
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    keyed = docs.withColumn("_row_key", key)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(fingerprint(x.as_py() or "", words) for x in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row_key"), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["doc_id", "row_key", "fp"])

    fps = cut(keyed.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "_row_key").mapInArrow(each, "doc_id long, row_key string, fp long"), small=True)
    first = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("row_key"))
    named = _named(fps, within, parts, hot, first)
    winners = cut(named.select(F.col("first.row_key").alias("_row_key")).distinct())
    return keyed.dropDuplicates(["_row_key"]).join(winners.hint("merge"), "_row_key", "left_semi").drop("_row_key")
