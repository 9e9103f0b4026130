"""Substring de-duplication by paragraph MinHash banding.

A paragraph is a piece of a text's words, cut where the content itself says so: before a word whose hash, taken with the next word's,
is the least among `reach` positions on either side, and where a run of more than `reach` equal words begins or ends. Lines play no
part, so a passage gives the same pieces wherever it stands, within longer lines or over several. A piece has more than `reach` words; short
lines go with their neighbours, and a text of few words is one piece. Pieces are compared, in lower case, as the sets of their five-word
shingles (whole, if shorter). Pieces with one set are one variant. Variants with a Jaccard similarity of `alike`
or more are linked, classes are the components of the links, and of each class the first piece (smallest document id, then
place) stays.

Candidates collide in one of BANDS bands of ROWS minima: at 0.8 that finds 1 - (1 - 0.8^3)^7 = 99.3 % of the pairs, and more above.
Sets of fewer than four shingles are alike only if they are equal, so they take no bands. Every candidate is verified on the exact sets.
Within a bucket, each variant is first held against the bucket's least; then only variants of a bucket that aren't
in one component yet are held against one another. Variants of a bucket with more than HOT of those are held against one another only where their
prefixes share a shingle, as those of every linked pair do: with the rarest shingles first, the n - ceil(alike * n) + 1 first of n.
So a group of many variants costs links in proportion to its size, whether they are alike or merely share a part, and no link between
components is lost.

Defined cases: null and empty texts have no pieces; a character of a script without spaces is a word; rows equal in id and text are one
place, and stay or go together; texts of one id are ordered by checksum; null ids come last; a class needs two places or more; an empty
table gives no rows. Texts are read whole, and only doc_id and text of whatever columns there are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop

WORDS = 5
ALIKE = 0.8
REACH = 12
BANDS = 7
ROWS = 3
SEED = 42
HOT = 64
BATCH_WORDS = 1 << 17
KNOWN_WORDS = 1 << 19
KEYS = [f"k{i}" for i in range(BANDS)]
PLACES = "doc_id long, mark long, piece int, start int, words int, id long, n int, " + ", ".join(f"{k} long" for k in KEYS)
#: Thai to Myanmar, Khmer, kana, Han: scripts that set no spaces between words.
UNSPACED = re.compile("[฀-႟ក-៿぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff]")
FAR = np.iinfo(np.int64).max


class _Hashes(dict):
    """The first eight bytes of each word's MD5, as a number; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = out = int.from_bytes(hashlib.md5(word).digest()[:8], "little")
        return out


def tokens(text: str | None) -> list[bytes]:
    low = (text or "").lower()
    if UNSPACED.search(low):
        low = UNSPACED.sub(r" \g<0> ", low)
    return low.encode("utf-8", "surrogatepass").split()


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of x[i : i + span], for every i; FAR stands beyond the end."""
    out, have = x, 1
    while have < span:
        step = min(have, span - have)
        out = np.minimum(out, np.concatenate((out[step:], np.full(step, FAR))))
        have += step
    return out


def _behind(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    return np.concatenate((np.full(by, fill), x[:-by]))


def _ahead(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    return np.concatenate((x[by:], np.full(by, fill)))


def cuts(hashes: np.ndarray, sizes: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Whether a piece begins at each word; hashes are those of the words of texts with so many words each, one after another."""
    n_texts, ends = len(sizes), np.cumsum(sizes)
    text = np.repeat(np.arange(n_texts), sizes)
    local = np.arange(len(hashes)) - (ends - sizes)[text]
    at = np.arange(len(hashes)) + (text + 1) * reach  # texts stand apart, so that no window reaches another text
    room = len(hashes) + (n_texts + 1) * reach
    low = (hashes >> np.uint64(33)).astype(np.int64)
    last = local == sizes[text] - 1
    pair = (low * 1103515245 + _ahead(low, 1, 0) * 12345) % 2147483647
    pair[last] = FAR
    g = np.full(room, FAR)
    g[at] = pair
    same = np.zeros(room, np.int64)
    same[at[1:]] = (hashes[1:] == hashes[:-1]) & (local[1:] > 0)
    inner = np.zeros(room, bool)
    inner[at] = (local > reach) & (sizes[text] - local > reach)

    ahead, run = _least(g, reach), _least(same, reach)
    least = (g < _behind(ahead, reach, FAR)) & (g <= _ahead(ahead, 1, FAR)) & inner & (g < FAR)
    turn = inner & (same == 0)
    end = turn & (_behind(run, reach, 0) == 1)
    near = lambda x: np.minimum(_least(np.where(x, 0, 1), reach + 1), _behind(_least(np.where(x, 0, 1), reach), reach, 1)) == 0
    start = turn & (_ahead(run, 1, 0) == 1) & ~(_behind(_least(np.where(end, 0, 1), reach), reach, 1) == 0)
    forced = end | start
    return ((least & ~near(forced)) | forced)[at] | (local == 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, begins: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(flat, starts): the sorted distinct shingle hashes of every piece, one piece after another. begins: where pieces begin."""
    ends = np.append(begins[1:], len(hashes))
    piece = np.repeat(np.arange(len(begins)), ends - begins)
    end = ends[piece]
    at = np.arange(len(hashes))
    flat = np.zeros(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(words):  # of a piece with fewer words, the whole
            there = at + i < end
            flat = _mixed(flat + np.where(there, hashes[np.minimum(at + i, len(hashes) - 1)], np.uint64(i)))
    keep = (at + words <= end) | (at == begins[piece])
    flat, piece = flat[keep], piece[keep]
    order = np.lexsort((flat, piece))
    flat, piece = flat[order], piece[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (piece[1:] != piece[:-1])
    flat, piece = flat[new], piece[new]
    return flat, np.searchsorted(piece, np.arange(len(begins)))


def set_ids(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One number for each set."""
    with np.errstate(over="ignore"):
        size = np.diff(np.append(starts, len(flat))).astype(np.uint64)
        return _mixed(np.add.reduceat(_mixed(flat ^ np.uint64(SEED)), starts) + size).view(np.int64)


def minima(flat: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """A 64-bit key for each set and band."""
    rng = np.random.default_rng(seed)
    out = np.empty((len(starts), bands), np.int64)
    base = flat ^ (flat >> np.uint64(31))
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(starts), b + 1, np.uint64)
            for _ in range(rows):
                odd, add = rng.integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                key = _mixed(key ^ np.minimum.reduceat((base ^ add) * odd, starts))
            out[:, b] = key.view(np.int64)
    return out


def _cut_texts(texts: list[list[bytes]], known: _Hashes, reach: int) -> tuple[np.ndarray, ...]:
    """(text, piece, start, words, flat, starts) of the pieces of texts that aren't empty."""
    sizes = np.array([len(t) for t in texts])
    hashes = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, int(sizes.sum()))
    begins = np.flatnonzero(cuts(hashes, sizes, reach))
    first = np.cumsum(sizes) - sizes
    text = np.searchsorted(first, begins, "right") - 1
    piece = np.arange(len(begins)) - np.searchsorted(text, text)
    return text, piece, begins - first[text], np.diff(np.append(begins, len(hashes))), *shingles(hashes, begins)


def _batches(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """(rows, words) of a batch's texts, about BATCH_WORDS at a time; texts without words are left out."""
    rows, held, size = [], [], 0
    for i, text in enumerate(batch.column("text")):
        found = tokens(text.as_py())
        if found:
            rows.append(i)
            held.append(found)
            size += len(found)
        if size >= BATCH_WORDS:
            yield rows, held
            rows, held, size = [], [], 0
    if rows:
        yield rows, held


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text; the mark tells apart texts under one id, or under none."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), text.alias("text"))


def places(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """PLACES: every piece, with its set's id and size and its band keys.

    The keys are null where none are needed, and where the task has lately given those of the same set; so a set that stands in very many
    places brings few rows to a bucket.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for rows, texts in _batches(batch):
                text, piece, start, words, flat, starts = _cut_texts(texts, known, reach)
                at = pa.array(np.array(rows)[text])
                n = np.diff(np.append(starts, len(flat)))
                ids = set_ids(flat, starts)
                fresh, first = np.unique(ids, return_index=True)
                new = np.zeros(len(ids), bool)
                new[first[~np.isin(fresh, seen, assume_unique=True)]] = True
                seen = fresh if len(seen) > KNOWN_WORDS else np.union1d(seen, fresh)
                none = (n < 4) | ~new
                columns = [batch.column("doc_id").take(at), batch.column("mark").take(at), *(pa.array(c.astype(np.int32)) for c in (piece, start, words)), pa.array(ids), pa.array(n.astype(np.int32))]
                columns += [pa.array(k, pa.int64(), mask=none) for k in minima(flat, starts).T]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "piece", "start", "words", "id", "n", *KEYS])

    return _marked(docs).mapInArrow(each, PLACES)


def _sets_of(owners: DataFrame, docs: DataFrame, reach: int) -> DataFrame:
    """id, hashes of the variants in owners (doc_id, mark, piece, id): their texts are read again from docs."""
    wanted = owners.groupBy(F.col("doc_id").alias("_owner"), F.col("mark").alias("_mark")).agg(F.collect_list("piece").alias("want"))
    texts = _marked(docs)
    joined = texts.join(wanted, texts["doc_id"].eqNullSafe(F.col("_owner")) & (texts["mark"] == F.col("_mark"))).select("text", "want")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            for rows, texts in _batches(batch):
                text, piece, _, _, flat, starts = _cut_texts(texts, known, reach)
                want = {(i, p) for i, r in enumerate(rows) for p in batch.column("want")[r].as_py()}
                chosen = np.array([k for k, key in enumerate(zip(text.tolist(), piece.tolist())) if key in want], np.int64)
                ends = np.append(starts[1:], len(flat))
                sets = [flat[a:b].view(np.int64) for a, b in zip(starts[chosen], ends[chosen])]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(flat, starts)[chosen]), pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])

    return joined.mapInArrow(each, "id long, hashes array<long>").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    joined = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return joined.where(both >= F.lit(alike) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def _rest(mixed: DataFrame, sets: DataFrame, alike: float, hot: int) -> DataFrame:
    """Pairs (a, b) to be verified of mixed (id, n, key, root): of one key and different roots."""
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(alike) - 1e-9
    counts = mixed.groupBy("key").agg(F.count("*").alias("m"))
    mixed = cut(mixed.join(counts, "key"), small=True)

    def pairs(rows: DataFrame, on: list[str]) -> DataFrame:
        names = ["id", "n", "root"]
        left = rows.select(*on, *[F.col(c).alias(x) for c, x in zip(names, ("a", "na", "ra"))])
        right = rows.select(*on, *[F.col(c).alias(x) for c, x in zip(names, ("b", "nb", "rb"))])
        return left.join(right, on).where((F.col("ra") < F.col("rb")) & fits).select("a", "b")

    many = mixed.where(F.col("m") > hot).select("id", "n", "root").distinct().join(sets.hint("merge"), "id").select("id", "n", "root", F.explode("hashes").alias("shingle"))
    ranked = many.join(many.groupBy("shingle").agg(F.count("*").alias("df")).hint("merge"), "shingle").groupBy("id", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("all"))
    prefix = F.slice("all", 1, F.size("all") - F.ceil(F.size("all") * F.lit(alike) - 1e-9).cast("int") + 1)
    rare = ranked.select("id", "n", "root", F.explode(prefix.getField("shingle")).alias("shingle"))
    return pairs(mixed.where(F.col("m") <= hot), ["key"]).unionByName(pairs(rare, ["shingle"])).distinct()


def duplicate_paragraphs(docs: DataFrame, reach: int = REACH, alike: float = ALIKE, hot: int = HOT) -> DataFrame:
    """doc_id, piece, start, words, first_doc, first_piece, removed: every piece of every class of two places or more.

    start is the number of the piece's first word in its text, from 0. A class is named by its first place, first_doc and first_piece.
    """
    found = cut(places(docs, reach))
    rows = found.where(F.col(KEYS[0]).isNotNull()).select("id", F.explode(F.array(*KEYS)).alias("key"))
    ends = rows.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    ends = cut(ends, free=True, small=True)
    shared = cut(rows.join(ends.hint("merge"), "key").distinct(), free=True, small=True)
    drop(ends)
    sizes = cut(found.select("id", "n").join(shared.select("id").distinct(), "id", "left_semi").distinct(), small=True)
    fits = F.least("na", "n") >= F.greatest("na", "n") * F.lit(alike) - 1e-9
    stars = shared.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), "n"), "b").where(fits).select("a", "b")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark", "piece")
    owner = found.join(sizes.select("id"), "id", "left_semi").groupBy("id").agg(F.min(order).alias("at"))
    sets = cut(_sets_of(owner.select("id", "at.doc_id", "at.mark", "at.piece"), docs, reach), free=True)
    links = cut(_verified(stars, sets, alike), small=True)
    roots = cut(components(links, "a", "b"))
    named = shared.join(sizes, "id").join(roots, shared["id"] == roots["node"], "left").select("id", "n", "key", F.coalesce("root", "id").alias("root"))
    ranges = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    mixed = cut(named.join(ranges, "key"), small=True)
    more = None if mixed.isEmpty() else cut(_verified(_rest(mixed, sets, alike, hot), sets, alike), small=True)
    classes = roots if more is None or more.isEmpty() else cut(components(roots.toDF("a", "b").unionByName(more), "a", "b"))
    placed = found.join(classes, found["id"] == classes["node"], "left").select("doc_id", "mark", "piece", "start", "words", F.coalesce("root", "id").alias("class_id"))
    heads = placed.groupBy("class_id").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo <> hi").select("class_id", "lo")
    same = F.col("doc_id").eqNullSafe(F.col("lo.doc_id")) & (F.col("mark") == F.col("lo.mark")) & (F.col("piece") == F.col("lo.piece"))
    return placed.join(heads, "class_id").select("doc_id", "piece", "start", "words", F.col("lo.doc_id").alias("first_doc"), F.col("lo.piece").alias("first_piece"), (~same).alias("removed"))
