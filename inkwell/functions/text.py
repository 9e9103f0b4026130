"""Texts as column expressions: words, excerpts, chunks and tokens. White space is Unicode white space throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
TOKEN = r"[\p{L}\p{N}]+"
SENTENCE_END = r"(?U)(?<=[!.?])\s+|\n{2,}"
UNTITLED = "Untitled"
NO_DESCRIPTION = "No description available"


def words(text: Column) -> Column:
    """The words of a text; null for null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space alone; it looks no further than the first character that isn't."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def normal_space(text: Column) -> Column:
    """Words joined by single spaces."""
    return F.array_join(words(text), " ")


def snippet(text: Column, most: int = 300) -> Column:
    """A text of at most so many words as it is; a longer one cut, joined by single spaces, with an ellipsis."""
    w = words(text)
    short = F.coalesce(text, F.lit(""))
    return F.when(F.coalesce(F.size(w), F.lit(0)) <= most, short).otherwise(F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("...")))


def left(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def title(text: Column, most: int = 100) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", UNTITLED).otherwise(left(text, most))


def description(text: Column, most: int = 280) -> Column:
    plain = F.coalesce(text, F.lit(""))
    return F.when(plain == "", NO_DESCRIPTION).when(F.length(plain) > most, F.concat(left(plain, most), F.lit("..."))).otherwise(plain)


def first_line(text: Column) -> Column:
    """The title of a post that has none of its own."""
    return F.split_part(text, F.lit("\n"), F.lit(1))


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _flushed(state: Column) -> Column:
    """state with its open chunk, if any, among the chunks."""
    return F.when(F.size(state["open"]) > 0, F.concat(state["chunks"], F.array(F.array_join(state["open"], " ")))).otherwise(state["chunks"])


def _state(chunks: Column, open_: Column, size: Column) -> Column:
    return F.struct(chunks.alias("chunks"), open_.alias("open"), size.cast("int").alias("size"))


def chunks(text: Column, target: int = 800, most: int = 1200) -> Column:
    """Pieces of a text at sentence ends, of about target characters; only a sentence over most is split, at words.

    What is left of a split sentence opens the next chunk. A text up to target is one chunk as it stands, an empty one has none.
    """
    sentences = F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")
    nothing = F.array().cast("array<string>")
    start = _state(nothing, nothing, F.lit(0))

    def add_word(s: Column, w: Column) -> Column:
        over = s["size"] + F.length(w) + 1 > most
        closed = _state(_flushed(s), F.array(w), F.length(w))
        return F.when(over, closed).otherwise(_state(s["chunks"], F.concat(s["open"], F.array(w)), s["size"] + F.length(w) + 1))

    def add(s: Column, x: Column) -> Column:
        n = F.length(x)
        split = F.aggregate(words(x), _state(_flushed(s), nothing, F.lit(0)), add_word)
        full = (s["size"] + n + 1 > target) & (F.size(s["open"]) > 0)
        fresh = _state(_flushed(s), F.array(x), n + 1)
        return F.when(n > most, split).when(full, fresh).otherwise(_state(s["chunks"], F.concat(s["open"], F.array(x)), s["size"] + n + 1))

    many = F.aggregate(sentences, start, add, _flushed)
    return F.when(F.coalesce(text, F.lit("")) == "", nothing).when(F.length(text) <= target, F.array(text)).otherwise(many)


def total_pages(total: Column, per_page: int) -> Column:
    return F.when(total > 0, F.floor((total + per_page - 1) / per_page)).otherwise(0).cast("int")


def page_window(page: Column, total: Column) -> Column:
    """The numbers of the page links around page, with the first and last and 0 for a gap; none for one page."""
    around = F.sequence(F.greatest(F.lit(1), page - 2), F.least(total, page + 2))
    none = F.array().cast("array<int>")
    before = F.when(page - 2 > 2, F.array(F.lit(1), F.lit(0))).when(page - 2 > 1, F.array(F.lit(1))).otherwise(none)
    after = F.when(page + 2 < total - 1, F.array(F.lit(0), total)).when(page + 2 < total, F.array(total)).otherwise(none)
    return F.when(total > 1, F.concat(before, around, after)).otherwise(none)


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with two digits."""
    return F.floor(ms / 10 + 0.5) / 100
