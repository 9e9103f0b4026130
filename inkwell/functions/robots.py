"""robots.txt: the rules that hold for one agent, and whether a path may be read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGENT = "InkwellBot"


def _rules(agent: str):
    from urllib.robotparser import RobotFileParser

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at, prefixes, allows = [], [], [], []
            for i, text in enumerate(batch.column("robots")):
                parser = RobotFileParser()
                parser.parse((text.as_py() or "").splitlines())
                entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
                for n, line in enumerate(entry.rulelines if entry else ()):
                    rows.append(i)
                    at.append(n)
                    prefixes.append("" if line.path == "*" else line.path)
                    allows.append(line.allowance)
            base = batch.column("base_url").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([base, pa.array(at, pa.int32()), pa.array(prefixes, pa.string()), pa.array(allows, pa.bool_())], names=["base_url", "at", "prefix", "allow"])

    return each


def rules(texts: DataFrame, agent: str = AGENT) -> DataFrame:
    """base_url, at, prefix, allow: the lines for the agent, else those for all, of robots files (base_url, robots); a missing file has none."""
    return texts.select("base_url", "robots").mapInArrow(_rules(agent), "base_url string, at int, prefix string, allow boolean")


def permits(found: Column, path: Column) -> Column:
    """Whether the first of the rules (at, prefix, allow) that fits a path allows it; no rule, or none that fits, does."""
    fits = F.filter(F.array_sort(found), lambda r: path.startswith(r["prefix"]))
    return F.coalesce(F.get(fits, F.lit(0))["allow"], F.lit(True))
