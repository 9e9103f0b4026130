"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted draws.

At every level each child draws ln(u) / weight, u in (0, 1) from a hash of the document's id
and the child's name, and the largest draw wins. A child's draw depends on nothing but itself, so
a changed weight moves documents only into or out of the subtree whose weight it is: the others'
draws stand as before. A region that is added takes documents only into itself.

Defined cases: a null id is hashed as a value of its own; a null or empty text has size 1 and checksum 0; equal ids
share a shard; rows that agree in id and text take neighbouring slots; an empty table gives no rows.
Only the columns doc_id and text are read, whatever else the table holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import copies, cut, running_starts

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]
#: Parts of one shard that are numbered each by itself.
BUCKETS = 1024
BASE = 16


def balanced(shards: int, base: int = BASE) -> Tree:
    """A tree for so many shards of weight 1: four to a region and two to a rack up to base, then a region for each more.

    Past base every further shard opens a region, so growth by one moves documents only into the new shard.
    """
    tree: Tree = {}
    for s in range(shards):
        region, rack = (f"g{s // 4}", f"k{s % 4 // 2}") if s < base else (f"x{s}", "k0")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11) + 0.5) / float(2**53)
    return F.log(u) / F.lit(float(weight))


def _descend(key: Column, node: dict, path: str, leaf: bool = False) -> Column:
    """The shard below node that key's draws lead to."""

    def weight(x) -> float:
        return float(x) if not isinstance(x, dict) else sum(map(weight, x.values()))

    kids = [(k, v) for k, v in node.items() if weight(v) > 0]
    if not kids:
        raise ValueError(f"no weight below {path or 'the root'}")
    results = [F.lit(k) if not isinstance(v, dict) else _descend(key, v, f"{path}/{k}") for k, v in kids]
    if len(kids) == 1:
        return results[0]
    draws = [_draw(key, f"{path}/{k}", weight(v)) for k, v in kids]
    best = F.array_max(F.array(*[F.struct(d.alias("d"), F.lit(-i).alias("i")) for i, d in enumerate(draws)]))["i"]
    out = F.when(best == 0, results[0])
    for i, r in enumerate(results[1:], 1):
        out = out.when(best == -i, r)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    return _descend(key, tree, "").cast("int")


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text).

    Slots are gapless from 0 in each shard, in order of a hash bucket, id, size and checksum. The
    numbering is a prefix sum over buckets; rows alike in id and text are counted before the shuffle.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    raw = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("slot"), F.crc32(raw.cast("binary"))), F.lit(buckets)).cast("int").alias("bucket"),
    )
    same = ["doc_id", "size", "text_crc32", "shard", "grown_shard", "bucket"]
    units = cut(rows.groupBy(*same).agg(F.count("*").alias("n")))
    placed = running_starts(units, ["shard"], "bucket", ["doc_id", "size", "text_crc32"], "n", "first")
    return copies(placed, "n", "copy").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy")).alias("slot"), "grown_shard"
    )
