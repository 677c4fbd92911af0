"""Runs: stretches of words that repeat with a period, found in whole texts.

A run with period q is at least twice as long, so it holds a block of ``m`` words at a
multiple of ``m`` whose copy q words on is inside as well, for ``m = 3 * 2**k`` with
``2m - 1 <= q <= 4m - 2`` (the shortest blocks serve all periods up to 10, since runs have 12
words or more). Each such block asks for its occurrences in the windows of ``m`` places
that follow: the suffixes that start with the block are an interval of the suffix array,
and a wavelet tree over the array finds an interval's next text place after a given one.
One or two occurrences are candidate periods themselves. Three or more in a window are an
arithmetic progression, because the block then has their difference as a period; it and
its copy lie in two stretches of that shorter period, and the run's period is the distance
of their right ends, or of their left ends, or, where the stretches touch, any place of the
progression. Candidates are extended both ways by comparing ranks of blocks, equal words
only, and a stretch keeps its least period.

The ranks of blocks come from prefix doubling, where only blocks that still have an equal
go on. Texts are joined with separators and words are numbered text by text, so many texts
take a few array operations and never meet. A text of any length is handled whole, in memory
proportional to its words times the logarithm of its longest repeat.

Null and empty texts have no runs and collapse to the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table

#: Least words of a run, and the shortest block; 2 * BLOCK - 1 <= MIN_LENGTH / 2.
MIN_LENGTH = 12
BLOCK = 3
#: Words that are worked on at once; a longer text is worked on alone.
CHUNK_WORDS = 1 << 18

RUNS = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


class WaveletTree:
    """Counts and order statistics of the values in intervals of an array."""

    def __init__(self, values: np.ndarray, limit: int) -> None:
        self.levels = []
        for shift in reversed(range(max(1, int(limit).bit_length()))):
            zero = (values >> shift & 1) == 0
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(zero, out=before[1:])
            self.levels.append((shift, before, int(before[-1])))
            values = np.concatenate([values[zero], values[~zero]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of ``[lo, hi)`` are less than x."""
        count = np.zeros(len(lo), np.int32)
        for shift, before, zeros in self.levels:
            one = (x >> shift & 1) == 1
            lo0, hi0 = before[lo], before[hi]
            count += np.where(one, hi0 - lo0, 0)
            lo = np.where(one, zeros + lo - lo0, lo0)
            hi = np.where(one, zeros + hi - hi0, hi0)
        return count

    def at(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) among those of ``[lo, hi)``."""
        value = np.zeros(len(lo), np.int64)
        for shift, before, zeros in self.levels:
            lo0, hi0 = before[lo], before[hi]
            one = k >= hi0 - lo0
            k = np.where(one, k - (hi0 - lo0), k)
            value += one.astype(np.int64) << shift
            lo = np.where(one, zeros + lo - lo0, lo0)
            hi = np.where(one, zeros + hi - hi0, hi0)
        return value


def classes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: index of the first of each one's class, and size of its class."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    return np.repeat(first, size), np.repeat(size, size)


@dataclass
class Repeats:
    """Ranks of all places by the blocks that start there, per block length, and for
    repeated blocks at multiples of their length: place and interval of suffixes."""

    words: np.ndarray
    ranks: list[np.ndarray]
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    tree: WaveletTree | None

    @classmethod
    def of(cls, words: np.ndarray) -> Repeats:
        """``words`` has a word of its own at either end and between texts."""
        n = len(words)
        rank = words
        for k in range(1, BLOCK):  # ranks of pairs, then of triples
            ahead = np.zeros(n, np.int64)
            ahead[: n - k] = words[k:]
            key = rank * (int(words.max()) + 1) + ahead
            order = np.argsort(key, kind="stable")
            first, size = classes(key[order])
            rank = np.empty(n, np.int64)
            rank[order] = first
        again = size > 1
        place, slot = order[again], np.flatnonzero(again)
        size, slots, suffix = size[again], slot, order.copy()
        rank = rank.astype(np.int32)
        ranks, blocks, m = [], [], BLOCK
        while len(place):
            ranks.append(rank)
            whole = place % m == 0
            low = np.searchsorted(slots, rank[place[whole]])
            blocks.append((place[whole], low, low + size[whole]))
            key = rank[place].astype(np.int64) * n + rank[place + m]
            order = np.argsort(key, kind="stable")
            place = place[order]
            suffix[slot] = place
            first, size = classes(key[order])
            rank = rank.copy()
            rank[place] = slot[first]
            again = size > 1
            place, slot, size, m = place[again], slot[again], size[again], 2 * m
        return cls(words, ranks, blocks, WaveletTree(suffix[slots], n) if len(slots) else None)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        start, last = i, len(self.words) - 1
        for k in reversed(range(len(self.ranks))):
            m = BLOCK << k
            same = self.ranks[k][np.minimum(i, last)] == self.ranks[k][np.minimum(j, last)]
            i, j = i + m * same, j + m * same
        for _ in range(BLOCK - 1):
            same = self.words[np.minimum(i, last)] == self.words[np.minimum(j, last)]
            i, j = i + same, j + same
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        start = i
        for k in reversed(range(len(self.ranks))):
            m = BLOCK << k
            same = (i >= m) & (self.ranks[k][np.maximum(i - m, 0)] == self.ranks[k][np.maximum(j - m, 0)])
            i, j = i - m * same, j - m * same
        for _ in range(BLOCK - 1):
            same = self.words[i - 1] == self.words[j - 1]
            i, j = i - same, j - same
        return start - i

    def stretch(self, at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest stretch with the period around words ``at`` and ``at + period``,
        which are equal."""
        return at - self.behind(at, at + period), at + period + self.ahead(at, at + period)

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods; every run has one of its own among them."""
        places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def add(b: np.ndarray, period: np.ndarray) -> None:
            places.append(b)
            periods.append(period)

        for k, (b, lo, hi) in enumerate(self.blocks):
            m = BLOCK << k
            for first, last in ((1, 4 * m - 2),) if k == 0 else ((2 * m - 1, 3 * m - 2), (3 * m - 1, 4 * m - 2)):
                self.ask(b, lo, hi, b + first, b + last, k > 0, add)
        return np.concatenate(places), np.concatenate(periods)

    def ask(self, b, lo, hi, first, last, progression, add) -> None:
        """Candidates from the occurrences in ``[first, last]`` of the blocks at ``b``."""
        n = len(self.words)
        skip = self.tree.below(lo, hi, np.minimum(first, n))
        found = self.tree.below(lo, hi, np.minimum(last + 1, n)) - skip
        at = np.flatnonzero(found)
        b, lo, hi, skip, found = b[at], lo[at], hi[at], skip[at], found[at]
        if not len(at):
            return
        one = self.tree.at(lo, hi, skip)
        if not progression:  # at most ten
            add(b, one - b)
            for i in range(1, int(found.max())):
                at = np.flatnonzero(found > i)
                add(b[at], self.tree.at(lo[at], hi[at], skip[at] + i) - b[at])
            return
        few = found < 3
        add(b[few], one[few] - b[few])
        at = np.flatnonzero(found > 1)
        b, one, found = b[at], one[at], found[at]
        step = self.tree.at(lo[at], hi[at], skip[at] + 1) - one
        few = found == 2
        add(b[few], one[few] + step[few] - b[few])
        many = ~few
        b, one, step, found = b[many], one[many], step[many], found[many]
        left, right = self.stretch(b, step)
        left2, right2 = self.stretch(one, step)
        other = left != left2
        add(b[other], right2[other] - right[other])
        add(b[other], left2[other] - left[other])
        touch = other & (right >= left2)
        count = found[touch]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        add(np.repeat(b[touch], count), np.repeat(one[touch] - b[touch], count) + nth * np.repeat(step[touch], count))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``start, end, period`` of all runs by start, then period."""
        if self.tree is None:
            return (np.zeros(0, np.int64),) * 3
        at, period = self.candidates()
        fits = (period > 0) & (at + period < len(self.words))
        at, period = at[fits], period[fits]
        fits = self.words[at] == self.words[at + period]
        at, period = at[fits], period[fits]
        start, end = self.stretch(at, period)
        long = end - start >= np.maximum(MIN_LENGTH, 2 * period)
        start, end, period = start[long], end[long], period[long]
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        least = np.ones(len(start), bool)
        least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, period = start[least], end[least], period[least]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, a separator in front of each text and one at the end, and
    the separators' places. A number belongs to one word of one text."""
    pieces, used = [], 0
    for words in texts:
        number = {w: i for i, w in enumerate(dict.fromkeys(words), used + 1)}
        pieces += [np.array([used]), np.fromiter(map(number.__getitem__, words), np.int64, len(words))]
        used += len(number) + 1
    cuts = np.cumsum([0, *(len(words) + 1 for words in texts)])
    return np.concatenate([*pieces, [used]]), cuts


def runs_of(texts: list[list[bytes]]) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """Runs a text, their ``start, length, period``, and the collapsed texts."""
    words, cuts = numbered(texts)
    start, end, period = Repeats.of(words).runs()
    owner = np.searchsorted(cuts, start, "right") - 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    keep = np.cumsum(edge) == 0
    counts = np.bincount(owner, minlength=len(texts))
    left = [
        b" ".join(compress(w, keep[a + 1 : a + 1 + len(w)].tolist()) if c else w)
        for w, a, c in zip(texts, cuts.tolist(), counts.tolist())
    ]
    return counts, [start - cuts[owner] - 1, end - start, period], left


def chunked(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    held, n = [], 0
    for text in texts:
        words = (text or b"").split()
        if held and n + len(words) > CHUNK_WORDS:
            yield held
            held, n = [], 0
        held.append(words)
        n += len(words) + 1
    if held:
        yield held


def periodic_runs(text: Column) -> Column:
    """Column ``struct(runs, collapsed)`` of a text column: ``start, length, period`` in
    words of every run, by start, then period; and the words that no run holds after its
    first period, joined by one space."""

    @F.arrow_udf(RUNS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, columns, left = [np.zeros(0, np.int64)], [[], [], []], []
            for texts in chunked(batch.cast(pa.large_binary()).to_pylist()):
                n, found, collapsed = runs_of(texts)
                counts.append(n)
                left += collapsed
                for column, values in zip(columns, found):
                    column.append(values)
            ends = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
            cells = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
            runs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(cells, ["start", "length", "period"]))
            yield pa.StructArray.from_arrays([runs, pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    return find(text)


def repeated_tail(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys, chosen by checksum, its words with a tail that
    repeats one of its stretches three to ten times."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    copies = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(copies, F.lit(1), n - a)), " ")
    chosen = (h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(chosen, changed).otherwise(text)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, longest and digest of the runs of every document, and of what is left."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", periodic_runs(repeated_tail(F.col("doc_id"), F.col("text"))).alias("r"))
    runs = F.col("r.runs")
    written = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    digests = found.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        longest.alias("top"),
        F.sha2(F.concat(F.array_join(written, "\n"), F.when(F.size(runs) > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2(F.col("r.collapsed"), 256).alias("collapsed_sha256"),
    )
    length, start, period = F.col("top.length"), -F.col("top.start"), -F.col("top.period")
    return digests.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
