"""Benchmark decontamination by pigeonhole edit matching.

A test item may stand in a document with up to k changed, missing or added characters, k being `rate` of its length.
Cut into k + 1 pieces, at least one piece stands there unchanged: an Aho-Corasick automaton of all items' pieces finds those,
and Myers' bit-parallel distance decides about the stretch around each. Texts and items are compared in lower case with
single spaces.

The items are read in blocks of a bounded number of characters, each held against all documents; documents are dropped once, after the last.

An item of under `least` words says too little to be told with changes: it is searched for exactly, at word bounds. In scripts
without spaces each character counts as a word, and has a bound on either side.

Defined cases: items that are null, empty or blank take no part; null and empty texts have no hit; items alike in text each report theirs; repeated documents each report theirs; a null id is kept; of an
item's places in a document the nearest is reported, then the first. Texts are searched whole, and only their needed columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

RATE = 0.05
LEAST_WORDS = 5
BLOCK_CHARS = 1 << 20
SCHEMA = "doc_id long, item_id long, distance int, start long, `end` long"


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def unspaced(c: str) -> bool:
    """Whether c is of a script that sets no spaces between words: Thai to Myanmar, Khmer, kana, Han."""
    return "\u0e00" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\uff66" <= c <= "\uff9f" or "\U00020000" <= c <= "\U0003ffff"


def weight(text: str) -> int:
    """Words of a plain text; a character of a script without spaces is one."""
    return text.count(" ") + 1 + sum(map(unspaced, text))


def bounded(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] cuts no word in two."""
    return not any(0 < i < len(text) and all(c.isalnum() and not unspaced(c) for c in text[i - 1 : i + 1]) for i in (start, end))


def pieces(text: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cuts = [i * len(text) // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(masks: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in text of a pattern of m characters, if within k; the first of the best."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = ones, 0, m, None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & ones, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & ones, mh << 1 & ones
        pv, mv = mh | ~(xv | ph) & ones, ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


def masks_of(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Items:
    """A block of items and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int):
        import ahocorasick

        self.short = [weight(t) < least for _, t in items]
        budgets = [0 if short else int(len(t) * rate) for short, (_, t) in zip(self.short, items)]
        self.items = [(i, t, k, masks_of(t) if k else {}, masks_of(t[::-1]) if k else {}) for k, (i, t) in zip(budgets, items)]
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k, _, _) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                at.setdefault(piece, []).append((n, offset))
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of each item that text holds; offsets in the plain text."""
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int, int]] = {}
        for end, (n_piece, places) in self.automaton.iter(text) if len(self.automaton) else ():
            for n, offset in places:
                start = end - n_piece + 1 - offset
                if (n, start) in tried or (n in best and best[n][0] == 0):
                    continue
                tried.add((n, start))
                _, item, k, masks, back = self.items[n]
                if start >= 0 and text.startswith(item, start):
                    if self.short[n] and not bounded(text, start, start + len(item)):
                        continue
                    found = (0, start, start + len(item))
                else:
                    low, high = max(0, start - k), start + len(item) + k
                    hit = myers(masks, len(item), text[low:high], k) if k else None
                    if not hit:
                        continue
                    stop = low + hit[1]
                    first = myers(back, len(item), text[max(0, stop - len(item) - k) : stop][::-1], hit[0])
                    found = (hit[0], stop - (first[1] if first else len(item)), stop)
                if n not in best or found < best[n]:
                    best[n] = found
        return [(n, *best[n]) for n in sorted(best)]


def item_blocks(items: DataFrame, size: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(item_id, plain text) in blocks of so many characters, one at a time on the driver."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in items.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        text = plain(row.text)
        if not text:
            continue
        if block and held + len(text) > size:
            yield block
            block, held = [], 0
        block.append((row.item_id, text))
        held += len(text)
    if block:
        yield block


def _local(block: list[tuple[int, str]], rate: float, least: int):
    """Builds the automaton once in each task."""
    held: list[Items] = []

    def get() -> Items:
        if not held:
            held.append(Items(block, rate, least))
        return held[0]

    return get


def find_hits(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, item_id, distance, start, end: every item that stands in a document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def scan(block: list) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = _local(block, rate, least)
            for batch in batches:
                known = get()
                out: list[tuple] = []
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                    out += [(doc_id.as_py(), known.items[n][0], d, a, b) for n, d, a, b in known.find(plain(text.as_py()))]
                columns = list(zip(*out)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "distance", "start", "end"])

        return rows.mapInArrow(each, SCHEMA)

    out, waiting = None, None
    for block in item_blocks(items):
        if waiting is not None:
            done = cut(scan(waiting))
            out = done if out is None else out.unionByName(done)
        waiting = block
    if waiting is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return scan(waiting) if out is None else out.unionByName(scan(waiting))


def drop_contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE, least: int = LEAST_WORDS) -> DataFrame:
    """The rows of docs in which no item stands, with all their columns."""

    def scan(block: list, wanted: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            get = _local(block, rate, least)
            for batch in batches:
                known = get()
                yield batch.filter(pa.array([bool(known.find(plain(x.as_py()))) == wanted for x in batch.column("text")], pa.bool_()))

        return each

    last, hits = None, None
    text = F.col("text").cast("string")
    for block in item_blocks(items):
        if last is not None:  # several blocks: what the earlier ones find is kept as checksums of texts, and taken out at the end
            found = docs.select(text.alias("text")).mapInArrow(scan(last, True), "text string")
            found = cut(found.select(F.md5(F.col("text").cast("binary")).alias("_found")).distinct(), small=True)
            hits = found if hits is None else hits.unionByName(found)
        last = block
    if last is None:
        return docs
    if hits is not None:
        docs = docs.join(hits.distinct(), F.md5(text.cast("binary")).eqNullSafe(F.col("_found")), "left_anti")
    return docs.mapInArrow(scan(last, False), docs.schema)
