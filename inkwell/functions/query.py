"""Query strings: site filters and phrases as column expressions, and the boolean query language as a tree."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

SITE = r'(?i)\bsite:([^\s"]+)'
#: The same for columns, where white space and word bounds are those of ASCII unless asked otherwise.
SITE_COLUMN = "(?U)" + SITE
#: What isn't part of a domain.
ODD = r"[^\w.-]+"
PHRASE = r'"([^"]+)"'


def sites(query: Column) -> Column:
    """Domains of the site: terms, of letters, digits, dot, dash and underscore; empty ones dropped."""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(SITE_COLUMN), F.lit(1))
    return F.filter(F.transform(found, lambda d: F.regexp_replace(d, ODD, "")), lambda d: d != "")


def without_sites(query: Column) -> Column:
    return F.regexp_replace(F.coalesce(query, F.lit("")), SITE_COLUMN, "")


def phrases(query: Column) -> Column:
    return F.regexp_extract_all(without_sites(query), F.lit(PHRASE), F.lit(1))


def clean(query: Column) -> Column:
    """What is left without site: terms, in single spaces; quotes stay."""
    return T.normal_space(without_sites(query))


class Parsed(NamedTuple):
    clean: str
    sites: list[str]
    phrases: list[str]


def parse(query: str | None) -> Parsed:
    """(clean, sites, phrases) of one query on the driver; the columns above say the same."""
    query = query or ""
    found = [re.sub(ODD, "", d, flags=re.A) for d in re.findall(SITE, query)]
    rest = re.sub(SITE, "", query)
    return Parsed(" ".join(rest.split()), [d for d in found if d], re.findall(PHRASE, rest))


@dataclass(frozen=True)
class Item:
    """A word, or the words of a phrase at their distances."""

    words: tuple[str, ...]
    gaps: tuple[int, ...]
    negated: bool = False


def web_query(query: str | None, analyse) -> list[list[Item]]:
    """Alternatives of required and forbidden items: words, "phrases", -not and or. Any text is a valid query.

    analyse turns a text into (position, term) pairs; words it drops take no part, and alternatives without items vanish.
    """
    branches: list[list[Item]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"?|(\S+)', query or ""):
        if m[3] and m[3].lower() == "or":
            branches.append([])
            continue
        negated = bool(m[1]) if m[3] is None else m[3].startswith("-") and len(m[3]) > 1
        found = analyse(m[2] if m[3] is None else m[3].lstrip("-"))
        if found:
            at = [p for p, _ in found]
            branches[-1].append(Item(tuple(t for _, t in found), tuple(p - at[0] for p in at), negated))
    return [b for b in branches if b]
