"""Token ids in binary files: ids by frequency rank, one to four bytes each.

Three passes over data that only Spark holds:

1. ``token_ids`` encodes every text with the tokenizer and ends it with an id of its own.
2. ``frequency_ranks`` counts the ids; the most frequent one gets rank 0, so that it takes
   one byte. The table has one entry per id of the vocabulary, whatever the data.
3. ``write_tokens`` orders the documents by id over all tasks. Each task writes one file.
   A file is named by one row of the manifest, which Spark commits with the task, so a file
   of a task that was lost or ran twice is in no manifest and is never read.

File format (all numbers little-endian): the magic ``TOKRANK1``, then blocks. A block is a
head of four u64 (documents, ids, control bytes, data bytes), the document ids (i64), a
byte per document that is 1 where its id is null, the ids per document (u64), the control
bytes and the data bytes. A control byte holds the lengths less one of four ranks, two bits
each, lowest bits first; the data are the ranks' low bytes, nothing else. The folder also
has ``ranks.u32``, the id of every rank, and the table ``manifest``.

Nulls and texts without words have the end id alone. A null document id comes last.
Repeated document ids stand side by side, ordered by a checksum of their ids; equal rows
are interchangeable. A text of any length is one row of ids and one block. An empty table
writes no file and reads as an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table
from pairloom.runtime import drop_stage, scratch_path, stage

MAGIC = b"TOKRANK1"
HEAD = "<4Q"
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 18
#: Words whose ids a task keeps, the longest such word in bytes, and texts taken at once.
CACHED_WORDS = 1 << 19
CACHED_BYTES = 32
TEXTS = 512
#: Printable ASCII that is neither letter, digit nor blank.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())

_PLACES = np.arange(4, dtype=np.uint8)
#: Lengths of the four values of every control byte.
LENGTHS = (np.arange(256, dtype=np.int64)[:, None] >> (2 * _PLACES) & 3) + 1
#: The bits that a value of so many bytes has.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        code[: len(values)] += values > limit
    four = code.reshape(-1, 4) << (2 * _PLACES)
    wanted = _PLACES <= code[: len(values), None]
    return np.bitwise_or.reduce(four, axis=1).tobytes(), values.view(np.uint8).reshape(-1, 4)[wanted].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of ``pack``."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(length) - length
    padded = data + bytes(4)
    at_any_byte = np.ndarray(len(padded) - 3, "<u4", padded, strides=(1,))
    return at_any_byte[start] & MASKS[length]


def byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of a word as bytes, from the library, kept for words that come again.

    The tokenizer turns white space into blanks and drops them, and no merge crosses a
    blank, so the ids of a text are those of its words. A word of Latin letters (those
    that normalisation leaves alone and whose small form is one letter) is one piece of
    the model, and ASCII marks behind it are pieces of their own.
    """

    def __init__(self, tokenizer, width: np.dtype) -> None:
        self.tokenizer = tokenizer
        self.bytes_of = [np.array(i, width).tobytes() for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self.shown = byte_letters()
        latin = r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+"
        self.plain = re.compile(rf"({latin})([!-/:-@\[-`{{-~]*)").fullmatch

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encoded(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encoded(self, word: bytes) -> bytes:
        # Most words are ASCII: the methods of bytes tell their letters from their marks.
        stem = word.rstrip(MARKS)
        if stem.isalpha():
            low = stem.lower()
            if low != word:
                return self[low] + self[word[len(stem) :]] if len(stem) < len(word) else self[low]
            ids = self.bytes_of
            return b"".join([ids[t.id] for t in self.tokenizer.model.tokenize(word.decode())])
        text = word.decode()
        if found := self.plain(text):
            letters, marks = found.groups()
            low = letters.lower()
            if marks or low != letters:
                return self[low.encode()] + (self[marks.encode()] if marks else b"")
            shown = word.decode("latin-1").translate(self.shown)
            return self.packed([t.id for t in self.tokenizer.model.tokenize(shown)])
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def packed(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@dataclass(frozen=True)
class Encoder:
    """A tokenizer as text, so that tasks need no file, and the id that ends a document.

    ``by_words`` says that white space parts texts into independent words, which
    ``read`` finds out from the file.
    """

    settings: str
    n_ids: int
    end_id: int
    by_words: bool

    @classmethod
    def read(cls, path: str, end_id: int) -> Encoder:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            settings = file.read()
        n_ids = Tokenizer.from_str(settings).get_vocab_size(with_added_tokens=True)
        if not 0 <= end_id < n_ids:
            raise ValueError(f"end_id {end_id} is not an id of {path}")
        return cls(settings, n_ids, end_id, parts_at_blanks(settings))

    @property
    def width(self) -> np.dtype:
        return np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")


def parts_at_blanks(settings: str) -> bool:
    """Whether the settings are of the kind ``WordIds`` is written for: blanks for white
    space, lower case, letters in pieces of their own, blanks removed, no added token
    with white space."""
    import json

    said = json.loads(settings)
    steps = (said.get("normalizer") or {}).get("normalizers") or []
    cuts = (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and (cuts[0]["behavior"], cuts[0]["invert"]) == ("Removed", True)
        and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        and all(re.fullmatch(r"<\|\S+", t["content"]) for t in said.get("added_tokens", []))
    )


def token_ids(docs: DataFrame, encoder: Encoder, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, row``: the ids of every text with the end id, as packed unsigned
    numbers of two bytes (four for a larger vocabulary), and a number of the row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(encoder.settings)
        words = WordIds(tokenizer, encoder.width)
        end = words.packed([encoder.end_id])
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                if encoder.by_words:
                    ids = [b"".join(map(words.__getitem__, (t or b"").split())) + end for t in texts]
                else:
                    found = (tokenizer.encode((t or b"").decode(), add_special_tokens=False).ids for t in texts)
                    ids = [words.packed(i) + end for i in found]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary())], ["key", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, "key long, ids binary").withColumn("row", F.monotonically_increasing_id())


def frequency_ranks(ids: DataFrame, encoder: Encoder) -> np.ndarray:
    """The id of every rank: by falling count, equal counts by id. Tasks count; what
    meets is at most one row per id and task, and the driver gets one per id."""
    n_ids, width = encoder.n_ids, encoder.width

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            data = batch.column(0).cast(pa.large_binary())
            bounds = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
            if bounds[-1] > bounds[0]:
                whole = np.frombuffer(data.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
                total += np.bincount(whole.view(width), minlength=n_ids)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    totals = np.zeros(n_ids, np.int64)
    for i, n in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).toLocalIterator():
        totals[i] = n
    return np.lexsort((np.arange(n_ids), -totals)).astype("<u4")


def storage(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as URI or absolute path."""
    folder = re.sub(r"^file:/+", "/", folder)
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def block(keys: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = struct.pack(HEAD, len(keys), len(ranks), len(control), len(data))
    null = bytes(k is None for k in keys)
    numbers = np.array([k or 0 for k in keys], "<i8").tobytes()
    return b"".join((head, numbers, null, np.array(counts, "<u8").tobytes(), control, data))


_MANIFEST = "shard int, name string, n_docs long, n_ids long, n_bytes long, crc long"


def write_tokens(ids: DataFrame, ranks: np.ndarray, folder: str, encoder: Encoder) -> None:
    """Write the rows of a staged ``token_ids`` table in ascending order of ``key``."""
    width = encoder.width
    spark = ids.sparkSession
    store, root = storage(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(posixpath.join(root, "ranks.u32")) as out:
        out.write(ranks.astype("<u4").tobytes())
    rank_of = np.empty(len(ranks), np.uint32)
    rank_of[ranks] = np.arange(len(ranks), dtype=np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = storage(folder)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        out = None
        keys, parts, n_docs, n_ids, n_bytes, crc = [], [], 0, 0, 0, 0

        def put(piece: bytes) -> None:
            nonlocal n_bytes, crc
            out.write(piece)
            n_bytes, crc = n_bytes + len(piece), zlib.crc32(piece, crc)

        def close_block() -> None:
            nonlocal n_docs, n_ids
            found = np.frombuffer(b"".join(parts), width)
            put(block(keys, [len(p) // width.itemsize for p in parts], rank_of[found]))
            n_docs, n_ids = n_docs + len(keys), n_ids + len(found)
            keys.clear(), parts.clear()

        held = 0
        for batch in batches:
            for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    out = store.open_output_stream(posixpath.join(root, name))
                    put(MAGIC)
                keys.append(key), parts.append(part)
                held += len(part) // width.itemsize
                if held >= BLOCK_IDS:
                    close_block()
                    held = 0
        if out is not None:
            if keys:
                close_block()
            out.close()
            columns = [[shard], [name], [n_docs], [n_ids], [n_bytes], [crc]]
            types = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["shard", "name", "n_docs", "n_ids", "n_bytes", "crc"],
            )

    # The checksum and the row number cut a document id that many rows share.
    order = [F.col("key").asc_nulls_last(), F.crc32("ids").asc(), F.col("row").asc()]
    ranged = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "ids")
    ranged.mapInArrow(write, _MANIFEST).write.parquet(posixpath.join(folder, "manifest"))


def blocks_of(file, name: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """``document ids, counts, ranks`` of every block of an open file."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError(f"{name} is not a token file")
    while head := file.read(struct.calcsize(HEAD)):
        n_docs, n_ids, n_control, n_data = struct.unpack(HEAD, head)
        numbers = np.frombuffer(file.read(8 * n_docs), "<i8")
        null = np.frombuffer(file.read(n_docs), np.uint8)
        counts = np.frombuffer(file.read(8 * n_docs), "<u8").astype(np.int64)
        ranks = unpack(file.read(n_control), file.read(n_data), n_ids)
        yield [None if x else k for k, x in zip(numbers.tolist(), null.tolist())], counts, ranks


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``key, start, n_ids, ids`` of every document in the files of the manifest:
    ids of all documents before it, its own number of ids, and these as packed
    little-endian unsigned 32-bit numbers."""
    manifest = spark.read.schema(_MANIFEST).parquet(posixpath.join(folder, "manifest"))
    files = manifest.count()
    # One row per file meets here.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("name", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = storage(folder)
        with store.open_input_stream(posixpath.join(root, "ranks.u32")) as file:
            id_of = np.frombuffer(file.read(), "<u4")
        for batch in batches:
            for row in batch.to_pylist():
                at, docs = row["base"], 0
                with store.open_input_stream(posixpath.join(root, row["name"])) as file:
                    for keys, counts, ranks in blocks_of(file, row["name"]):
                        packed = id_of[ranks].tobytes()
                        ends = np.cumsum(counts)
                        cuts = zip((4 * (ends - counts)).tolist(), (4 * ends).tolist())
                        yield pa.record_batch(
                            [
                                pa.array(keys, pa.int64()),
                                pa.array(at + ends - counts),
                                pa.array(counts),
                                pa.array([packed[a:b] for a, b in cuts], pa.binary()),
                            ],
                            ["key", "start", "n_ids", "ids"],
                        )
                        at, docs = at + len(ranks), docs + len(keys)
                if (at - row["base"], docs) != (row["n_ids"], row["n_docs"]):
                    raise ValueError(f"{row['name']} holds {docs} documents, the manifest has {row['n_docs']}")

    return placed.repartition(max(1, files)).mapInArrow(read, "key long, start long, n_ids long, ids binary")


def save_tokens(docs: DataFrame, encoder: Encoder, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Encode, rank and write ``docs`` to a new folder that all executors see."""
    ids = stage(token_ids(docs, encoder, key, text), "token-ids")
    write_tokens(ids, frequency_ranks(ids, encoder), folder, encoder)
    drop_stage(ids)


@query("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, and a checksum of its ids there."""
    import public_tokenizers

    encoder = Encoder.read(public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    folder = scratch_path(spark, "token-files")
    save_tokens(table(spark, sf_dir, "documents"), encoder, folder)
    return read_tokens(spark, folder).select(
        F.col("key").alias("doc_id"), "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
