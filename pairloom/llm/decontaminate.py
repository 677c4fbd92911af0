"""Benchmark decontamination by SimHash over item-sized windows.

An item of L words is compared with windows of L words. Every window and item
has a 64-bit SimHash of its words, cut into ``RADIUS + 1`` blocks: two fingerprints
within the radius agree in at least one block, so a join on (length, block number,
block value) finds all of them. Windows may share 80 percent of an item and be further
away; these are found by a join on shingles: of two sorted lists that share so many,
the first ones share one. What the joins find is verified exactly: the five-word
shingles that window and item share, each counted as often as both hold it, must weigh
at least 80 percent of the item. A document shorter than the item is one window.

A verified window needs that share of its places filled by shingles of items of
its length, so windows with fewer are left out before they are fingerprinted.
Membership is tested on bitmaps of fixed size, which may let windows through but
never lose one.

Words are runs of letters, digits and non-ASCII characters, ASCII lowered. Null
and empty texts have no windows; items of fewer than five words have no shingle
and match nothing. Repeated rows match alike, and a document and item pair is
reported once, at its best and then first window. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import fetch
from pairloom.llm.catalog import query, table
from pairloom.llm.words import Powers, chunks, combine, mix, words
from pairloom.runtime import stage

WIDTH = 5
PERCENT = 80
RADIUS = 11
#: Bits of each shingle bitmap: eight MiB whatever the benchmark.
SHINGLE_BITS = 1 << 26

_STRIP = np.zeros(256, bool)
_STRIP[[b for b in range(128) if not chr(b).isalnum()]] = True

_WINDOW = "doc_id bigint, start int, n_words int, print bigint, shingles array<bigint>"


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of words, each weighing as often as it occurs."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).view(np.int64)[0])


def _of_length(shingles: np.ndarray, n: int) -> np.ndarray:
    return mix(shingles ^ mix(np.full(1, n, np.uint64)))


def items_of(items: DataFrame) -> DataFrame:
    """``item_id, n_words, print, shingles`` of the rows of ``item_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids = batch.column(0).to_pylist()
            for row, data, starts in chunks(batch.column(1)):
                hashes, cut, _, _ = words(data, starts, Powers(), _STRIP)
                for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
                    if b - a >= WIDTH:
                        shingles = np.sort(combine(hashes[a:b], WIDTH)).view(np.int64)
                        for column, value in zip(out, (ids[row + k], b - a, fingerprint(hashes[a:b]), shingles)):
                            column.append(value)
            yield pa.record_batch(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))],
                names=["item_id", "n_words", "print", "shingles"],
            )

    return items.select("item_id", "text").mapInArrow(
        run, "item_id bigint, n_words int, print bigint, shingles array<bigint>"
    )


def windows_of(docs: DataFrame, lengths: list[int], known: np.ndarray, sized: np.ndarray) -> DataFrame:
    """Windows of the rows of ``doc_id, text`` in which enough places hold shingles
    of items of the window's length. ``known`` has all shingles, ``sized`` all
    shingles with the lengths of their items."""
    mask = np.uint64(SHINGLE_BITS - 1)

    def starts_of(places: np.ndarray, shingles: np.ndarray, n: int, total: int) -> np.ndarray:
        spots = n - WIDTH + 1
        least = -(-PERCENT * spots // 100)
        if len(places) < least:
            return places[:0]
        own = places[fetch.holds(sized, _of_length(shingles, n) & mask)]
        if len(own) < least:
            return own[:0]
        if total < n:
            return np.zeros(1, np.int64)
        # A place counts for the windows that start up to spots - 1 before it.
        change = np.zeros(total - n + 2, np.int64)
        low, high = np.maximum(own - spots + 1, 0), np.minimum(own, total - n) + 1
        good = low < high
        np.add.at(change, low[good], 1)
        np.add.at(change, high[good], -1)
        return np.flatnonzero(np.cumsum(change[:-1]) >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            ids = batch.column(0)
            out: list[list] = [[], [], [], [], []]
            for row, data, starts in chunks(batch.column(1)):
                hashes, cut, _, _ = words(data, starts, powers, _STRIP)
                shingles = combine(hashes, WIDTH)
                hits = np.flatnonzero(fetch.holds(known, shingles & mask))
                text = np.searchsorted(cut, hits, "right") - 1
                inside = hits + WIDTH <= cut[text + 1]
                hits, text = hits[inside], text[inside]
                edges = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1], [True]))) if len(text) else []
                for i, j in zip(edges[:-1], edges[1:]):
                    t = int(text[i])
                    a, total = int(cut[t]), int(cut[t + 1] - cut[t])
                    places = hits[i:j] - a
                    for n in lengths:
                        for s in starts_of(places, shingles[hits[i:j]], n, total).tolist():
                            end = a + min(s + n, total)
                            own = np.sort(shingles[a + s : end - WIDTH + 1]).view(np.int64)
                            values = (ids[row + t].as_py(), s, n, fingerprint(hashes[a + s : end]), own)
                            for column, value in zip(out, values):
                                column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            yield pa.record_batch(
                [pa.array(c, k) for c, k in zip(out, kinds)],
                names=["doc_id", "start", "n_words", "print", "shingles"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _WINDOW)


def blocks(fingerprints: Column, radius: int = RADIUS) -> Column:
    """``array<struct<block, value>>`` of ``radius + 1`` runs of bits."""
    cuts = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(fingerprints, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")).alias("value"),
            )
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
        ]
    )


def near_prints(left: DataFrame, right: DataFrame, key: list[str], radius: int = RADIUS) -> DataFrame:
    """Pairs of rows with equal ``key`` whose ``print`` differ in at most ``radius`` bits, each once."""
    x = left.withColumn("_b", F.explode(blocks(F.col("print"), radius))).select("*", "_b.*").drop("_b")
    y = right.withColumn("_b", F.explode(blocks(F.col("print"), radius))).select("*", "_b.*").drop("_b")
    y = y.withColumnsRenamed({"print": "print_y", "shingles": "shingles_y"})
    pairs = x.join(y, [*key, "block", "value"])
    bits = F.bit_count(F.col("print").bitwiseXOR(F.col("print_y")))
    first = F.least(
        *[
            F.when(F.element_at(blocks(F.col("print"), radius), k + 1) == F.element_at(blocks(F.col("print_y"), radius), k + 1), k)
            for k in range(radius + 1)
        ]
    )
    return pairs.withColumn("distance", bits).where((F.col("distance") <= radius) & (F.col("block") == first))


def far_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs of one length that may share enough shingles though their ``print`` differ in
    more than ``radius`` bits, each once: all but the shingles that have to be shared, and
    one more, are the first of a list, and two such heads have one in common."""
    spots = F.col("n_words") - (WIDTH - 1)
    least = F.ceil(spots * PERCENT / 100).cast("int")
    head = F.array_distinct(F.slice("shingles", 1, F.greatest(F.size("shingles") - least + 1, F.lit(0))))
    x = windows.withColumn("head", head).withColumn("s", F.explode("head"))
    y = items.withColumn("head_y", head).withColumn("s", F.explode("head_y"))
    pairs = x.join(y.withColumnsRenamed({"print": "print_y", "shingles": "shingles_y"}), ["n_words", "s"])
    return pairs.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("print_y")))).where(
        (F.col("distance") > radius) & (F.col("s") == F.array_min(F.array_intersect("head", "head_y")))
    )


def _shared_weight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = []
        for x, y in zip(batch.column("shingles").to_pylist(), batch.column("shingles_y").to_pylist()):
            x, nx = np.unique(np.array(x), return_counts=True)
            y, ny = np.unique(np.array(y), return_counts=True)
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            shared.append(int(np.minimum(nx[i], ny[j]).sum()))
        yield pa.record_batch(
            [*(batch.column(c) for c in ("doc_id", "item_id", "start", "n_words", "distance")), pa.array(shared, pa.int32())],
            names=["doc_id", "item_id", "start", "n_words", "distance", "shared"],
        )


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, distance, similarity`` of every
    document (``doc_id, text``) that holds an item (``item_id, text``)."""
    known = stage(items_of(items), "leak-items")
    lengths = sorted(r[0] for r in known.select("n_words").distinct().toLocalIterator())
    slots = known.select("n_words", F.explode("shingles").alias("s"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles = batch.column(1).to_numpy().view(np.uint64)
            n = batch.column(0).to_numpy().astype(np.uint64)
            both = mix(shingles ^ mix(n)) & np.uint64(SHINGLE_BITS - 1)
            alone = shingles & np.uint64(SHINGLE_BITS - 1)
            yield pa.record_batch([pa.array(alone.view(np.int64)), pa.array(both.view(np.int64))], names=["alone", "both"])

    slots = slots.mapInArrow(sized, "alone bigint, both bigint")
    windows = stage(
        windows_of(
            docs, lengths, fetch.bitmap(slots.select("alone"), SHINGLE_BITS), fetch.bitmap(slots.select("both"), SHINGLE_BITS)
        ),
        "leak-windows",
    )
    columns = ["doc_id", "item_id", "start", "n_words", "distance", "shingles", "shingles_y"]
    pairs = near_prints(windows, known, ["n_words"]).select(columns).union(far_pairs(windows, known).select(columns))
    checked = pairs.mapInArrow(
        _shared_weight, "doc_id bigint, item_id bigint, start int, n_words int, distance int, shared int"
    )
    best = F.struct("shared", (-F.col("start")).alias("back"), "n_words", (-F.col("distance")).alias("nearness"))
    return (
        checked.where(F.col("shared") * 100 >= (F.col("n_words") - (WIDTH - 1)) * PERCENT)
        .groupBy("doc_id", "item_id")
        .agg(F.max(best).alias("b"))
        .select(
            "doc_id",
            "item_id",
            (-F.col("b.back")).alias("start_word"),
            "b.n_words",
            (-F.col("b.nearness")).alias("distance"),
            F.round(F.col("b.shared") / (F.col("b.n_words") - (WIDTH - 1)), 4).alias("similarity"),
        )
    )


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
