"""Places of all matches of a pattern, as built-in expressions.

A pattern cuts the text into the pieces between its matches, and both lists are
leftmost and non-overlapping, so running lengths of pieces and matches give every
place in code points. Patterns should be linear: possessive, and guarded where a
match can start in the middle of a run.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:bigint,stop:bigint,hit:string>>"


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def places(text: Column, pattern: str, hits: Column) -> Column:
    """``array<struct<start, stop, hit>>`` of ``hits``, which ``found`` returned."""
    pieces = F.split(text, pattern, -1)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        stop = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["hit"].alias("hit"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))
    pairs = F.arrays_zip(hits.alias("hit"), F.slice(pieces, 1, F.size(hits)).alias("piece"))
    spans = F.aggregate(pairs, zero, add, lambda acc: acc["out"])
    return F.when(F.size(hits) > 0, spans).otherwise(F.array().cast(SPANS))


def written(spans: Column, kind: str = "kind") -> Column:
    """``kind:start:stop`` of every span in order, joined by commas."""
    return F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", s[kind], s["start"], s["stop"]))
    )
