"""Texts of a set of rows: a bitmap of fixed size keeps the rest out of the shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a membership bitmap; it is one MiB whatever the data. More keys make it
#: pass more rows, never fewer.
BITMAP_BITS = 1 << 23


def slot(key: Column | str, bits: int = BITMAP_BITS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def bitmap(slots: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """The bitmap of a frame with one bigint column of slots, set on Spark; the
    driver gathers its words, ``bits / 64`` at most."""
    name = slots.columns[0]
    masks = slots.select(
        F.expr(f"`{name}` div 64").cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(`{name}` % 64 as int))").alias("m")
    )
    out = np.zeros(bits // 64, np.uint64)
    for w, m in masks.groupBy("w").agg(F.bit_or("m").alias("m")).toLocalIterator():
        out[w] = m & 0xFFFFFFFFFFFFFFFF
    return out


def holds(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    slots = slots.astype(np.uint64, copy=False)
    return (words[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def texts_of(docs: DataFrame, keys: DataFrame, key: str = "node", text: str = "text") -> DataFrame:
    """``key, text`` rows of ``docs`` that are in ``keys`` (distinct, one column),
    and possibly some more: join the result to the keys."""
    words = bitmap(keys.select(slot(key)))
    return filtered(docs.select(key, text, slot(key).alias("_slot")), words)


def filtered(rows: DataFrame, words: np.ndarray) -> DataFrame:
    """Rows whose bigint column ``_slot`` is set in the bitmap, without that column."""
    schema = rows.drop("_slot").schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = holds(words, batch.column("_slot").to_numpy(zero_copy_only=False))
            yield batch.drop_columns(["_slot"]).filter(pa.array(mask))

    return rows.mapInArrow(keep, schema)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
