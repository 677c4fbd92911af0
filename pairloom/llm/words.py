"""Words and shingles of whole Arrow batches as 64-bit hashes, without Python strings.

The bytes of a batch are one buffer. A word's hash is a difference of running
sums of ``table[byte] * base**place``, divided by the base at the word's start,
so all words of a batch come from a few passes over the buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finalizer of a public generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base, kept between chunks."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
        return self.up, self.down


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the start of every text in them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, starts`` of runs of rows of about ``CHUNK_BYTES``."""
    data, starts = buffers(texts)
    n, row = len(starts) - 1, 0
    while row < n:
        stop = int(np.searchsorted(starts, starts[row] + CHUNK_BYTES, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, data[starts[row] : starts[stop]], starts[row : stop + 1] - starts[row]
        row = stop


def words(data: np.ndarray, starts: np.ndarray, powers: Powers, strip: np.ndarray | None = None):
    """``hashes, word_starts, begin, end`` of all words, ASCII letters lowered.

    ``word_starts`` cuts the hashes by text; begin and end are byte places.
    ``strip`` marks more bytes that part words besides white space.
    """
    gap = _SPACE if strip is None else _SPACE | strip
    solid = ~gap[data]
    n = len(data)
    first, last = solid.copy(), solid.copy()
    if n:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = starts[(starts > 0) & (starts < n)]
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers.upto(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[_LOWER[data]] * up[:n], dtype=np.uint64)])
    hashes = mix((total[end] - total[begin]) * (down[begin] if n else begin.astype(np.uint64)))
    return hashes, np.searchsorted(begin, starts), begin, end


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, also of those across texts."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(5) + hashes[k : k + n] + np.uint64(k + 1))
    return out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of every text, sorted: windows of ``width``
    words, or all words as one where there are fewer; nothing without words."""
    powers = Powers()
    for _, data, starts in chunks(texts):
        hashes, cut, _, _ = words(data, starts, powers)
        windows = combine(hashes, width)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if b - a >= width:
                found = np.sort(windows[a : b - width + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]
            elif b > a:
                yield combine(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield windows[:0]
