"""Canonical ids and seeded hashes, reproducible in any engine with SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separator inside content ids and the digest prefix lengths.
UNIT_SEPARATOR = "\u001f"
CONTENT_ID_HEX = 20
UNIT_HEX = 16


def _text(part: Column | str | int) -> Column:
    if isinstance(part, Column):
        return F.coalesce(part.cast("string"), F.lit(""))
    return F.lit(str(part))


def canonical_pair(a: Column, b: Column, prefix: str) -> Column:
    """struct<pair_id, node_a, node_b> with endpoints in text order."""
    left, right = F.least(a, b), F.greatest(a, b)
    return F.struct(
        F.concat_ws("_", F.lit(prefix), left, right).alias("pair_id"),
        left.alias("node_a"),
        right.alias("node_b"),
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """``PREFIX_`` + 20 hex digits of the joined parts; null counts as blank."""
    joined = F.concat_ws(UNIT_SEPARATOR, *[_text(p) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, CONTENT_ID_HEX))


def selection_key(*parts: Column | str | int) -> Column:
    """Hex SHA-256 of the ``:``-joined parts."""
    return F.sha2(F.concat_ws(":", *[_text(p) for p in parts]), 256)


def unit_hash(*parts: Column | str | int) -> Column:
    """First 64 bits of the selection key as a double in [0, 1)."""
    head = F.substring(selection_key(*parts), 1, UNIT_HEX)
    whole = F.conv(head, 16, 10).cast("decimal(20,0)").cast("double")
    return whole / F.lit(2.0**64)
