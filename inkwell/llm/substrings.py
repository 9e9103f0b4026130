"""Suffix-array de-duplication: bytes covered by a string of `length` that also starts earlier are removed.

Suffix arrays are built by shards, and equal strings must meet in one. So every string of that length is given to an anchor:
the position in it whose `gram` bytes have the least hash. That depends on nothing but the string, so equal strings have
equal anchors, and strings that start side by side mostly share one; the bytes under an anchor's strings are its stretch.

1. Every stretch goes, as a hash, to the shard of its anchor. Of equal stretches all but the earliest are repeats throughout; those that
   a task finds among its own are told before the shuffle. An anchor with one stretch, however often, is done with.
2. Where the stretches of an anchor differ, the earliest of each go to the shard as bytes. The suffix array of the shard is induced, and the
   common prefixes of neighbours give the classes of equal strings; all but the earliest of a class are repeats.
3. Documents with repeats are cut; all others are digested as they are.

An anchor in a large part of all documents (say, in a short line that many hold) may have as many stretches as documents. Such
anchors are looked for in a sample of SAMPLE documents or more; their strings then go each by itself, under its own hash. The
sample decides only on the way, not on the result.

Between tasks stretches travel as compressed columns, a packet for each flush and receiver. Receivers are shards, or, where there
are more than FAN shards, groups of them that send on to their shards; so a flush costs the same, however large the corpus.

Defined cases: a null text is empty; rows equal in id and text are one document, listed so often; rows of one id with different texts are
ordered by checksum; null ids come last; texts under `length` bytes keep all; an empty table gives no rows. Texts
of any size are searched whole: anchors are found in chunks that overlap by length - 1 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import suffixes
from .common import cut

LENGTH = 100
GRAM = 32
SAMPLE = 20_000
#: An anchor is hot if it stands in more than HOT_LEAST documents of the sample, which holds one of EVERY documents at least: so in about
#: a million documents at most, however many there are.
HOT_LEAST, EVERY = 200, 5000
CHUNK = 1 << 20
ANCHORS_PER_FLUSH = 1 << 18
#: Most receivers of one flush; more shards than that are reached in two steps.
FAN = 2048
SHARD_BYTES = 2 << 20
TEXT_PER_SHARD = 8 << 20
POSITION = 24
PLACE = "doc_id long, mark long, h long, low long, high long"


def anchors(raw: np.ndarray, valid: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, number) of the runs of valid string starts in raw that share an anchor. raw has under 2^24 bytes."""
    n = len(raw) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    words = suffixes.words_at(raw)
    with np.errstate(over="ignore"):
        at = len(raw) - gram + 1
        h = words[:at] * np.uint64(0x9E3779B97F4A7C15)
        for i, odd in enumerate((0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93), 1):
            h ^= h >> np.uint64(29)
            h += words[i * (gram - 8) // 3 : i * (gram - 8) // 3 + at]
            h *= np.uint64(odd)
        h ^= h >> np.uint64(32)
    least = (h & ~np.uint64((1 << POSITION) - 1)) | np.arange(at, dtype=np.uint64)
    span, have = length - gram + 1, 1
    while have < span:
        more = min(have, span - have)
        least = np.minimum(least[:-more], least[more:])
        have += more
    owner = (least[:n] & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    ok = valid[:n]
    begin = ok.copy()
    begin[1:] &= (owner[1:] != owner[:-1]) | ~ok[:-1]
    first = np.flatnonzero(begin)
    end = ok.copy()
    end[:-1] &= begin[1:] | ~ok[1:]
    return h[owner[first]].view(np.int64), first, np.flatnonzero(end) - first + 1


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(raw, valid, text, offset) of pieces of about CHUNK bytes; a longer text is cut with an overlap."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), CHUNK):
            piece = t[a : a + CHUNK + length - 1]
            if len(piece) >= length:
                held.append((i, a, piece))
                size += len(piece)
            if size >= CHUNK:
                yield _joined(held, length)
                held, size = [], 0
    if held:
        yield _joined(held, length)


def _joined(held: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
    sizes = np.array([len(p) for _, _, p in held])
    begins = np.cumsum(sizes) - sizes
    text = np.repeat([i for i, _, _ in held], sizes)
    offset = np.arange(len(raw)) - np.repeat(begins - np.array([a for _, a, _ in held]), sizes)
    valid = np.ones(len(raw), bool)
    for b, n in zip(begins, sizes):
        valid[b + n - length + 1 : b + n] = False
    return raw, valid, text, offset


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch.column("text")]


def _docs_of(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(no id, id, mark) of the rows."""
    column = batch.column("doc_id")
    return column.is_null().to_numpy(zero_copy_only=False), column.fill_null(0).to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False)


def _ids(no: np.ndarray, doc: np.ndarray) -> pa.Array:
    return pa.array(doc, pa.int64(), mask=no)


def _hashes(raw: np.ndarray, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    import xxhash

    whole, digest = raw.tobytes(), xxhash.xxh3_64_digest
    ends = (first + size).tolist()
    return np.frombuffer(b"".join([digest(whole[a:b]) for a, b in zip(first.tolist(), ends)]), ">i8").astype(np.int64)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted keys differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _earliest(group: tuple, place: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are the earliest of their group, rows that are later ones); a row in the same place as the earliest is in neither."""
    order = np.lexsort((*place[::-1], *group[::-1]))
    new = _changes(*[k[order] for k in group])
    lead = order[new][np.cumsum(new) - 1] if len(order) else order
    later = np.logical_or.reduce([k[order] != k[lead] for k in place])
    return order[new], order[later]


def _runs(owner: tuple, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of the given rows' stretches of string starts, those that adjoin in one document joined."""
    order = rows[np.lexsort((low[rows], *[k[rows] for k in owner[::-1]]))]
    new = _changes(*[k[order] for k in owner])
    new[1:] |= low[order][1:] != high[order][:-1]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(order)) - 1 if len(begin) else begin
    return order[begin], low[order][begin], high[order][end]


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of 64 bits, compressed; sorted ones as differences."""
    raw = b"".join(np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)  # byte by byte: alike next to alike
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packet: bytes, columns: int) -> list[np.ndarray]:
    size = int.from_bytes(packet[:8], "little")
    raw = np.frombuffer(pa.decompress(packet[8:], size, "zstd", asbytes=True), np.uint8)
    n = size // 8 // columns
    return [raw[i * 8 * n : (i + 1) * 8 * n].reshape(8, n).T.copy().view(np.int64).ravel() for i in range(columns)]


def _packets(to: np.ndarray, key: np.ndarray, g: np.ndarray, no: np.ndarray, doc: np.ndarray, mark: np.ndarray, low: np.ndarray, high: np.ndarray, done: np.ndarray) -> pa.RecordBatch:
    """shard, packet: the rows of each receiver."""
    order = np.lexsort((low, mark, doc, to))
    first = np.flatnonzero(_changes(to[order]))
    packets = []
    for x, y in zip(first, np.append(first[1:], len(order))):
        r = order[x:y]
        packets.append(_pack(np.where(done[r], 0, key[r]), np.where(done[r], 0, g[r]), np.diff(doc[r], prepend=0), mark[r], low[r], (high[r] - low[r]) << 2 | done[r].astype(np.int64) << 1 | no[r]))
    return pa.RecordBatch.from_arrays([pa.array(to[order][first].astype(np.int32)), pa.array(packets, pa.binary())], names=["shard", "packet"])


def _unpacked(packet: bytes) -> tuple[np.ndarray, ...]:
    """key, g, no, doc, mark, low, high, done of a packet's rows."""
    key, g, doc, mark, low, rest = _unpack(packet, 6)
    return key, g, (rest & 1) > 0, np.cumsum(doc), mark, low, low + (rest >> 2), (rest & 2) > 0


def shard_of(key: np.ndarray, done: np.ndarray, doc: np.ndarray, shards: int) -> np.ndarray:
    """By anchor; what is done with goes anywhere."""
    return (np.where(done, doc, key).view(np.uint64) % np.uint64(shards)).astype(np.int64)


def groups_of(shards: int, fan: int = FAN) -> tuple[int, int]:
    """(groups of shards, shards in a group), so that a flush has at most fan receivers in either step (for fan^2 shards)."""
    each = -(-shards // fan)
    return -(-shards // each), each


def _stretches(length: int, gram: int, hot: np.ndarray, shards: int, each_group: int):
    """shard (or group of shards), packet: the earliest stretches of a task by anchor, and its repeats (of length 0 and no g)."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, g, no, doc, mark, low, high = (np.concatenate(x) for x in zip(*held))
        lead, later = _earliest((h, g), (no, doc, mark, low))
        row, a, b = _runs((no, doc, mark), later, low, high)
        both = np.concatenate((lead, row))
        done = np.arange(len(both)) >= len(lead)
        to = shard_of(h[both], done, doc[both], shards) // each_group
        return _packets(to, h[both], g[both], no[both], doc[both], mark[both], np.concatenate((low[lead], a)), np.concatenate((high[lead], b)), done)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            no, doc, mark = _docs_of(batch)
            for raw, valid, text, offset in _chunks(_texts(batch), length):
                h, first, count = anchors(raw, valid, length, gram)
                is_hot = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
                g = np.empty(len(h), np.int64)
                g[~is_hot] = _hashes(raw, first[~is_hot], count[~is_hot] + length - 1)
                if is_hot.any():  # a hot anchor's strings go each under its own hash
                    n = count[is_hot]
                    start = np.repeat(first[is_hot] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    h, g = np.concatenate((h[~is_hot], _hashes(raw, start, length))), np.concatenate((g[~is_hot], np.repeat(h[is_hot], n)))
                    first, count = np.concatenate((first[~is_hot], start)), np.concatenate((count[~is_hot], np.ones(len(start), np.int64)))
                t = text[first]
                held.append((h, g, no[t], doc[t], mark[t], offset[first], offset[first] + count))
                size += len(h)
                if size >= ANCHORS_PER_FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return each


def _regrouped(shards: int):
    """shard, packet: the rows of packets for groups of shards, for the shards themselves."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, g, no, doc, mark, low, high, done = (np.concatenate(x) for x in zip(*held))
            return _packets(shard_of(key, done, doc, shards), key, g, no, doc, mark, low, high, done)

        for batch in batches:
            for packet in batch.column("packet"):
                held.append(_unpacked(packet.as_py()))
                size += len(held[-1][0])
                if size >= ANCHORS_PER_FLUSH:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return each


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PLACE of each shard's repeats (h null), and of the stretches whose bytes must be compared (h their anchor)."""
    by_shard: dict[int, list[tuple[np.ndarray, ...]]] = {}  # a shard is sized to be held
    for batch in batches:
        for shard, packet in zip(batch.column("shard").to_pylist(), batch.column("packet")):
            by_shard.setdefault(shard, []).append(_unpacked(packet.as_py()))
    for shard in sorted(by_shard):
        key, g, no, doc, mark, low, high, done = (np.concatenate(x) for x in zip(*by_shard.pop(shard)))
        heads = np.flatnonzero(~done)
        lead, later = (heads[x] for x in _earliest((key[heads], g[heads]), (no[heads], doc[heads], mark[heads], low[heads])))
        _, which, count = np.unique(key[lead], return_inverse=True, return_counts=True)
        mixed = lead[count[which] > 1] if len(lead) else lead
        row, a, b = _runs((no, doc, mark), np.concatenate((np.flatnonzero(done), later)), low, high)
        rows = np.concatenate((row, mixed))
        h = pa.array(key[rows], pa.int64(), mask=np.arange(len(rows)) < len(row))
        columns = [_ids(no[rows], doc[rows]), pa.array(mark[rows], pa.int64()), h, pa.array(np.concatenate((a, low[mixed]))), pa.array(np.concatenate((b, high[mixed])))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "h", "low", "high"])


def _bytes_of(length: int):
    """h, doc_id, mark, low, stretch of the places that need comparing."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, h, low, found = [], [], [], []
            for i, (text, places) in enumerate(zip(_texts(batch), batch.column("places"))):
                for p in places.as_py():
                    rows.append(i)
                    h.append(p["h"])
                    low.append(p["low"])
                    found.append(text[p["low"] : p["high"] + length - 1])
            at = pa.array(rows, pa.int64())
            columns = [pa.array(h, pa.int64()), batch.column("doc_id").take(at), batch.column("mark").take(at), pa.array(low, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "doc_id", "mark", "low", "stretch"])

    return each


def _compared(length: int):
    """PLACE of the repeats among a shard's stretches, by its suffix array."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        no, doc, mark = _docs_of(table)
        text, offset, kind = suffixes.repeats(table.column("stretch").to_pylist(), length)
        start = table.column("low").to_numpy()[text] + offset
        _, later = _earliest((kind,), (no[text], doc[text], mark[text], start))
        row, low, high = _runs((text,), later, start, start + 1)
        row = text[row]
        yield pa.RecordBatch.from_arrays([_ids(no[row], doc[row]), pa.array(mark[row], pa.int64()), pa.nulls(len(row), pa.int64()), pa.array(low), pa.array(high)], names=["doc_id", "mark", "h", "low", "high"])

    return each


def _hot_anchors(texts: DataFrame, n_docs: int, length: int, gram: int, least: int) -> np.ndarray:
    """The anchors in more than least documents of a sample: 8 bytes for each, and no more than the sample's anchors / least."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, valid, text, _ in _chunks(_texts(batch), length):
                h, first, _ = anchors(raw, valid, length, gram)
                pairs = np.unique(np.stack([h, text[first]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0])], names=["h"])

    every = max(1, min(n_docs // SAMPLE, EVERY))
    some = texts.where(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(every)) == 0)
    counted = some.mapInArrow(each, "h long").groupBy("h").count()
    return np.array([r.h for r in counted.where(F.col("count") > least).collect()], np.int64)


def _cut_rows(length: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, places in zip(batch.column("text"), batch.column("places")):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                merged: list[list[int]] = []
                for low, high in sorted((r["low"], r["high"] + length - 1) for r in places.as_py()):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                digest, at = hashlib.sha256(), 0
                for low, high in merged:
                    digest.update(raw[at:low])
                    at = high
                digest.update(raw[at:])
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
                kept.append(digest.hexdigest())
            columns = [batch.column("doc_id"), batch.column("mark"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_removed", "n_spans", "kept_sha256"])

    return each


def _same(a: DataFrame, d: str = "_d", m: str = "_m") -> Column:
    return a["doc_id"].eqNullSafe(F.col(d)) & (a["mark"] == F.col(m))


def _by_document(places: DataFrame, name: str) -> DataFrame:
    grouped = places.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("h", "low", "high")).alias(name))
    return grouped.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), name).hint("merge")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_least: int = HOT_LEAST, fan: int = FAN, text_per_shard: int = TEXT_PER_SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs (doc_id, text)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long"), raw.alias("text"), F.xxhash64(raw).alias("mark"))
    slim = cut(texts.select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), small=True)
    n_docs, n_bytes = slim.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    hot = _hot_anchors(texts, n_docs, length, gram, hot_least)

    # 1. stretches by hash
    shards = int(n_bytes // text_per_shard) + 1
    groups, each_group = groups_of(shards, fan)
    found = texts.mapInArrow(_stretches(length, gram, hot, shards, each_group), "shard int, packet binary").repartitionById(groups, "shard")
    if each_group > 1:
        found = found.mapInArrow(_regrouped(shards), "shard int, packet binary").repartitionById(shards, "shard")
    places = cut(found.mapInArrow(_sorted_out, PLACE), free=True)

    # 2. stretches by their bytes, where they differ
    open_ = places.where("h is not null")
    size = open_.agg(F.coalesce(F.sum(F.col("high") - F.col("low") + length), F.lit(0))).first()[0]
    part = texts.join(_by_document(open_, "places"), _same(texts)).select("doc_id", "mark", "text", "places")
    stretches = part.mapInArrow(_bytes_of(length), "h long, doc_id long, mark long, low long, stretch binary")
    more = cut(stretches.repartition(int(size // SHARD_BYTES) + 1, "h").mapInArrow(_compared(length), PLACE), free=True, small=True)

    # 3. what is left
    repeats = places.where("h is null").unionByName(more)
    joined = texts.join(_by_document(repeats, "places"), _same(texts)).select("doc_id", "mark", "text", "places")
    cuts = joined.mapInArrow(_cut_rows(length), "doc_id long, mark long, n_removed long, n_spans long, kept_sha256 string")
    cuts = cuts.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), "n_removed", "n_spans", "kept_sha256").dropDuplicates(["_d", "_m"])
    rows = slim.join(cuts.hint("merge"), _same(slim), "left")
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
