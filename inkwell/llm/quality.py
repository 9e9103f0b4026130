"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text falls into one of some bins; a score is the sigmoid of a base and one number per feature, and
per chosen pair of features, looked up by bin. Those tables are learnt by cyclic boosting: round after round, for one
feature after another, a tree of at most three leaves over that feature's bins is fitted to the gradient of the log loss and added
to its table, much shrunken; then trees of four leaves over pairs of features in the same way, for the pairs that explain most of
what is left. Scoring adds table entries over whole batches.

The features come from the text alone. Rows with crc32(doc_id) mod 5 = 0 are held out; of the other labelled rows the
SAMPLE with the smallest hash of their id are learnt from (all, if fewer), so the driver holds a bounded matrix of numbers. All
documents are scored whole.

Defined cases: null and empty texts are scored like any (their features are zero); a null id is held out; labels that are null
are no labels, repeated ones count once, and an id that bears many texts gives one; without labels, or with those of one class, every score is the share of label 1
(a half without any); only doc_id, text and the columns doc_id, quality of the labels are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
THRESHOLD = 0.3
BINS = 32
PAIR_BINS = 8
PAIRS = 8
ROUNDS = 200
PAIR_ROUNDS = 80
RATE = 0.1
RIDGE = 5.0

SYMBOLS = b"#$%&*|@^~<>{}[]=+\\_/"
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOPS = b".!?"
FEATURES = (
    "words", "word_length", "distinct", "repeats", "symbols", "digits", "capitals", "odd_ends", "stops", "compression",
    "repeated_lines", "line_words", "top_word", "top_pair", "stop_marks_doubled", "non_ascii", "commas",
)


def features(text: str | None) -> list[float]:
    """The numbers a text is judged by."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    low = raw.lower().split()
    count = Counter(low)
    pairs = Counter(zip(low, low[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    without = lambda marks: size - len(raw.translate(None, marks))
    ends = [w[-1:] for w in words]
    return [
        float(np.log1p(n)),
        size / n,
        len(count) / n**0.9,
        sum(a == b for a, b in zip(low, low[1:])) / n,
        without(SYMBOLS) / size,
        without(DIGITS) / size,
        without(UPPER) / size,
        sum(e in SYMBOLS for e in ends) / n,
        without(STOPS) / n,
        len(zlib.compress(raw, 1)) / size,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(n / len(lines))),
        max(count.values()) / n,
        max(pairs.values(), default=0) / n,
        (raw.count(b"!!") + raw.count(b"..") + raw.count(b"??")) / n,
        len(raw.translate(None, bytes(range(128)))) / size,
        raw.count(b",") / n,
    ]


def _one_leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The value of each bin in the best tree of so many leaves over the sums of gradients and curvatures by bin."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-12, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
            i = int(gain.argmax())
            best = max(best, (float(gain[i]), a + i + 1), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = _one_leaf(g[a:b].sum(), h[a:b].sum())
    return out


def tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, value of each cell) of the best tree that cuts the rows of a table once and either side's columns once."""

    def across(gg: np.ndarray, hh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cg, ch = np.cumsum(gg, -1), np.cumsum(hh, -1)
        gain = _gain(cg[..., :-1], ch[..., :-1]) + _gain(cg[..., -1:] - cg[..., :-1], ch[..., -1:] - ch[..., :-1])
        at = gain.argmax(-1)
        return np.take_along_axis(gain, at[..., None], -1)[..., 0], at + 1

    cg, ch = np.cumsum(g, 0), np.cumsum(h, 0)
    up, at_up = across(cg[:-1], ch[:-1])
    down, at_down = across(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
    i = int((up + down).argmax())
    out = np.empty_like(g)
    for rows, at in ((slice(0, i + 1), at_up[i]), (slice(i + 1, None), at_down[i])):
        for cols in (slice(0, at), slice(at, None)):
            out[rows, cols] = _one_leaf(g[rows, cols].sum(), h[rows, cols].sum())
    return float((up + down)[i] - _gain(g.sum(), h.sum())), out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(edges, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (a, b), t in zip(self.pairs, self.pair_tables):
            total += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Learns from features x and labels y (0 or 1)."""
    n = len(y)
    if not n or y.min() == y.max():
        share = np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6)
        return Model(float(np.log(share / (1 - share))))
    share = y.mean()
    model = Model(float(np.log(share / (1 - share))))
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    total = np.full(n, model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * tree_1d(np.bincount(at[j], g, len(t)), np.bincount(at[j], h, len(t)))
            t += step
            total += step[at[j]]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def table(a: int, b: int, v: np.ndarray) -> np.ndarray:
        rows, cols = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * cols + coarse[b], v, rows * cols).reshape(rows, cols)

    g, h = slopes()
    wide = [j for j, e in enumerate(model.pair_edges) if len(e)]
    gains = [(tree_2d(table(a, b, g), table(a, b, h))[0], (a, b)) for a, b in combinations(wide, 2)]
    model.pairs = [pair for _, pair in sorted(gains, key=lambda x: (-x[0], x[1]))[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * tree_2d(table(a, b, g), table(a, b, h))[1]
            t += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 5 == 0


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(x.as_py()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64())), batch.column("quality")], names=["doc_id", "x", "quality"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model learnt from at most sample labelled rows that aren't held out; of the texts of one id, from one."""
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # at most sample rows of two numbers
    measured = rows.mapInArrow(_measured, "doc_id long, x array<double>, quality int").groupBy("doc_id", "quality").agg(F.min("x").alias("x"))
    found = measured.toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = found.column("quality").to_numpy().astype(np.float64)
    order = np.lexsort((y, *x.T))  # one order, however the rows arrive
    return fit(x[order], y[order])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""
    model = train(docs, labels, sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    model = train(docs, labels, sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(each, docs.schema)
