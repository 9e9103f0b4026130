"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run only there, checksums confirm tokens.

Kinds: assign (a named value), access (a cloud access key), hex (a long lower-case hexadecimal run), and two
that a checksum proves: github (ghp_, gho_, ghu_, ghs_, ghr_) and npm (npm_), whose last six characters are the base-62
CRC-32 of the thirty before. A hexadecimal run has no keyword, so one scan for 32 such characters stands in for it.

Every match of a pattern begins at a keyword, so trying the pattern at the hits in turn, past the last match's
end, gives its leftmost matches without overlap. Letters fold by ASCII only.

Defined cases: a null or empty text has no spans (checksum of the empty string); a null id is kept as null; repeated rows are each
reported; spans that start together come in the order of KINDS; only doc_id and text are read. Rows pass one by one
through bounded Arrow batches, so a text of any length is scanned whole.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "github", "npm")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

NAMED = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ISSUED = re.compile(r"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
HINTS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "named"),
    "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "issued"),
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_automaton = None


def automaton():
    """One per process, built on first use."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in HINTS.items():
            _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32 of body."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


def folded(text: str) -> str:
    """text in lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start and then by kind."""
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    past = {"named": 0, "access": 0, "issued": 0}
    for end, (hint, n) in automaton().iter(folded(text)):
        start = end - n + 1
        if start < past[hint]:
            continue
        if hint == "named":
            if m := NAMED.match(text, start):
                past[hint] = m.end()
                if len(m[1]) >= 8:
                    found.append(("assign", *m.span()))
        elif hint == "access":
            if m := ACCESS.match(text, start):
                past[hint] = m.end()
                if m.end() - start >= 16:
                    found.append(("access", *m.span()))
        elif m := ISSUED.match(text, start):
            past[hint] = m.end()
            if checksum(m[2]) == m[3]:
                found.append(("npm" if m[1] == "npm" else "github", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(5)]
        for text in batch.column("text"):
            spans = find(text.as_py() or "")
            base = [x for x in spans if x[0] in KINDS[:3]]
            for i, kind in enumerate(KINDS[:3]):
                rows[i].append(sum(x[0] == kind for x in base))
            rows[3].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest())
            rows[4].append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
        counts = [pa.array(x, pa.int64()) for x in rows[:3]]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *counts, pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Counts and spans of the secrets in each row of docs (doc_id, text)."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)
