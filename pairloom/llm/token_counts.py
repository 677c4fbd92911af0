"""Token counts by byte-pair merging, without building any token ids.

A text becomes a linked list of symbols; a heap pops the adjacent pair of
lowest rank until no pair is in the vocabulary. The count is the initial
symbols minus the merges, plus the extra bytes of symbols that the vocabulary
lacks. Space runs only ever start a piece, so a text falls into segments that
merge on their own, and a bounded cache keeps the counts of frequent segments.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pairloom.llm.catalog import query, table

#: Counts kept for each running task.
CACHED_SEGMENTS = 1 << 18
TOKEN_LIMIT = 4096

_COUNTS = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])


@dataclass(frozen=True)
class Vocabulary:
    """Order of every piece (lower merges first) and the single characters known."""

    order: dict[str, float]
    characters: frozenset[str]
    splits_at_newline: bool


def load_vocabulary(path: str) -> Vocabulary:
    """Read a piece vocabulary on the driver; its size is fixed by the file, not the data."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [
        i
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    order = {model.id_to_piece(i).replace("▁", " "): -model.get_score(i) for i in ids}
    for piece in order:
        if " " in piece.lstrip(" "):
            raise ValueError(f"a space inside the piece {piece!r} would join segments")
    return Vocabulary(
        {p: s for p, s in order.items() if len(p) > 1},
        frozenset(p for p in order if len(p) == 1),
        not any("\n" in p for p in order),
    )


def count_segment(segment: str, vocabulary: Vocabulary) -> int:
    """Tokens of one segment: symbols - merges + extra bytes of unknown symbols."""
    order = vocabulary.order
    parts: list[str | None] = list(segment)
    n = len(parts)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = order.get(segment[i : i + 2])
        if rank is not None:
            heap.append((rank, i, segment[i : i + 2]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, piece = heapq.heappop(heap)
        left = parts[i]
        j = after[i]
        if left is None or j >= n or left + parts[j] != piece:
            continue  # one of the two symbols has merged meanwhile
        parts[i], parts[j] = piece, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank = order.get(piece + parts[k])
            if rank is not None:
                heapq.heappush(heap, (rank, i, piece + parts[k]))
        h = before[i]
        if h >= 0:
            rank = order.get(parts[h] + piece)
            if rank is not None:
                heapq.heappush(heap, (rank, h, parts[h] + piece))
        merges += 1
    extra = sum(
        len(p.encode()) - 1
        for p in parts
        if p is not None and len(p) == 1 and p not in vocabulary.characters
    )
    return n - merges + extra


def text_counter(vocabulary: Vocabulary):
    """A function from text to its number of tokens, with a bounded cache."""
    cached = lru_cache(CACHED_SEGMENTS)(lambda s: count_segment(s, vocabulary))
    cut = re.compile(r" +[^ \n]*|\n|[^ \n]+" if vocabulary.splits_at_newline else r" +[^ ]*|[^ ]+")

    def count(text: str | None) -> int:
        return sum(map(cached, cut.findall(" " + text.replace("▁", " ")))) if text else 0

    return count


def token_counts(text: Column, vocabulary: Vocabulary) -> Column:
    """Column ``struct(n_bytes, n_tokens)`` of a text column."""

    @F.pandas_udf(_COUNTS)
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = text_counter(vocabulary)
        for texts in batches:
            yield pd.DataFrame(
                {
                    "n_bytes": [len(t.encode()) if t else 0 for t in texts],
                    "n_tokens": [count(t) for t in texts],
                },
                dtype="int64",
            )

    return counts(text)


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document under the 32k piece vocabulary."""
    import public_tokenizers

    vocabulary = load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", token_counts(F.col("text"), vocabulary).alias("c")).select(
        "doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )
