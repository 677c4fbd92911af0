"""One delimited file read by many tasks, also where quoted cells hold line breaks.

A task that starts in the middle of a file cannot tell a line break between records from
one inside a quoted cell; that depends on the number of quotes before it. So:

1. every block counts its quotes and notes how it begins and ends;
2. a running parity over the blocks of a file, one short row each, says which blocks begin
   inside a quoted cell;
3. every block hands out the records that begin in it, and reads on to the end of the last.

Spark's own parser then splits each record into cells. Parity decides only where quotes
enclose whole cells and are doubled inside, and line ends are of one kind; step 1 checks
this for both parities and step 2 picks the answer. A file that fails is named by
``irregular`` and is left to the whole-file reader, as are single-member gzip files.

A gzip file of several members is cut at its members: ranges look for headers, what follows
a header is unpacked up to its checksum, and the members found must join to the end of the
file. Runs of members are then blocks.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.runtime import stage
from pairloom.sources.ranges import BLOCK_BYTES, chunks, dealt, each_row, ranges

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LF, CR = 10, 13
GZIP_HEAD = b"\x1f\x8b\x08"
BOM = b"\xef\xbb\xbf"


def unpacked(path: str, first: int, last: int | None) -> Iterator[bytes]:
    """The contents of the gzip members in ``[first, last)``, or to the end."""
    stream = zlib.decompressobj(31)
    for data in chunks(path, first, last):
        while data:
            if stream.eof:
                stream = zlib.decompressobj(31)
            yield stream.decompress(data)
            data = stream.unused_data
    if not stream.eof:
        raise EOFError(f"{path}: a gzip member ends early")


def contents(path: str, first: int, last: int | None, gzip: bool) -> Iterator[bytes]:
    return unpacked(path, first, last) if gzip else chunks(path, first, last)


def member_end(path: str, first: int) -> int | None:
    """Where the gzip member that begins at ``first`` ends, if one does."""
    stream, at = zlib.decompressobj(31), first
    try:
        for data in chunks(path, first):
            at += len(data)
            stream.decompress(data)
            if stream.eof:
                return at - len(stream.unused_data)
    except zlib.error:
        pass
    return None


def gzip_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, first, last) of the gzip files that consist of several members.

    A member that merely contains a gzip file is not cut: what was found inside it does
    not reach the end of the file without a gap.
    """

    def heads(row: dict) -> Iterator[dict]:
        held, at = b"", row["first"]
        for data in chunks(row["path"], row["first"], row["last"] + len(GZIP_HEAD) - 1):
            held += data
            place = held.find(GZIP_HEAD)
            while place >= 0:
                yield {"path": row["path"], "first": at + place}
                place = held.find(GZIP_HEAD, place + 1)
            kept = held[-(len(GZIP_HEAD) - 1) :]
            at, held = at + len(held) - len(kept), kept

    def ends(row: dict) -> Iterator[dict]:
        last = member_end(row["path"], row["first"])
        if last is not None:
            yield {"path": row["path"], "first": row["first"], "last": last}

    begun = each_row(dealt(ranges(files, block_bytes), "path", "block"), "path string, first long", heads)
    later = stage(begun.distinct().where("first > 0"), "gzip-heads")  # a header on a range edge is seen once
    later = each_row(dealt(later, "path", "first"), "path string, first long, last long", ends)
    following = F.lead("first").over(Window.partitionBy("path").orderBy("first"))
    joined = stage(later.withColumn("next", following), "gzip-members").join(files.select("path", "bytes"), "path")
    whole = F.coalesce(F.col("next"), F.col("bytes")) == F.col("last")
    good = joined.groupBy("path").agg(F.bool_and(whole).alias("good"), F.min("first").alias("f")).where("good")
    members = joined.select("path", "first", "last").join(good.select("path"), "path", "left_semi")
    members = members.unionByName(good.select("path", F.lit(0).cast("bigint").alias("first"), F.col("f").alias("last")))
    runs = members.groupBy("path", F.expr(f"first div {block_bytes}").alias("run")).agg(
        F.min("first").alias("first"), F.max("last").alias("last")
    )
    number = F.row_number().over(Window.partitionBy("path").orderBy("run")) - 1
    return runs.select("path", number.cast("bigint").alias("block"), "first", "last")


def _irregular(data: np.ndarray, quotes: np.ndarray, opening: np.ndarray, sep: int, quote: int) -> bool:
    """Whether an opening quote has text before it or a closing one behind it. The first
    and last byte of a block are judged with its neighbours."""
    edge = np.zeros(256, bool)
    edge[[sep, quote, LF, CR]] = True
    before = quotes[opening & (quotes > 0)] - 1
    after = quotes[~opening & (quotes < len(data) - 1)] + 1
    return not (edge[data[before]].all() and edge[data[after]].all())


_SEEN = "path string, block long, first long, last long, gzip boolean, bytes long, odd boolean, head long, tail long, cr long, crlf long, break long, bad0 boolean, bad1 boolean"


def scanned(blocks: DataFrame, sep: str = ",", quote: str = '"') -> DataFrame:
    """What every block holds: parity of its quotes, first and last byte, line ends, and
    whether its quotes are irregular if it begins outside or inside a cell."""
    sep_byte, quote_byte = ord(sep), ord(quote)

    def read(row: dict) -> Iterator[dict]:
        data = np.frombuffer(b"".join(contents(row["path"], row["first"], row["last"], row["gzip"])), np.uint8)
        quotes = np.flatnonzero(data == quote_byte)
        opening = np.arange(len(quotes)) % 2 == 0
        returns, feeds = np.flatnonzero(data == CR), np.flatnonzero(data == LF)
        pairs = int((data[returns[returns < len(data) - 1] + 1] == LF).sum())
        first = min(returns[:1].tolist() + feeds[:1].tolist(), default=None)
        yield {
            "path": row["path"], "block": row["block"], "first": row["first"], "last": row["last"], "gzip": row["gzip"],
            "bytes": len(data), "odd": len(quotes) % 2 == 1, "head": int(data[0]) if len(data) else None,
            "tail": int(data[-1]) if len(data) else None, "cr": len(returns), "crlf": pairs,
            "break": int(data[first]) if first is not None else None,
            "bad0": _irregular(data, quotes, opening, sep_byte, quote_byte),
            "bad1": _irregular(data, quotes, ~opening, sep_byte, quote_byte),
        }

    return each_row(dealt(blocks, "path", "block"), _SEEN, read)


def placed(seen: DataFrame, sep: str = ",", quote: str = '"') -> DataFrame:
    """``seen`` with ``inside`` (begins in a quoted cell), ``fresh`` (a record begins at its
    first byte), ``crlf_file`` and ``irregular``, the same for all blocks of a file.

    One short row a block meets per file, some ten thousand for a terabyte.
    """
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    behind = order.rowsBetween(1, Window.unboundedFollowing)
    file = Window.partitionBy("path")
    inside = F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1
    rows = seen.select(
        "*",
        inside.alias("inside"),
        F.last("tail", ignorenulls=True).over(before).alias("_before"),
        F.first("head", ignorenulls=True).over(behind).alias("_behind"),
        F.first("break", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_break"),
    )
    ends = F.col("inside") != F.col("odd")  # the state behind the block
    edges = [ord(sep), ord(quote), LF, CR]
    loose = lambda c: ~F.coalesce(F.col(c).isin(edges), F.lit(True))
    wrong = (
        F.when(F.col("inside"), F.col("bad1")).otherwise(F.col("bad0"))
        | F.coalesce(~F.col("inside") & (F.col("head") == ord(quote)) & loose("_before"), F.lit(False))
        | F.coalesce(~ends & (F.col("tail") == ord(quote)) & loose("_behind"), F.lit(False))
        | (F.col("_behind").isNull() & ends)
    )
    split_pair = (F.col("tail") == CR) & (F.col("_behind") == LF)
    pairs = F.col("crlf") + F.coalesce(split_pair, F.lit(False)).cast("int")
    mixed = F.sum(F.col("cr") - pairs).over(file) > 0
    returns = F.sum("cr").over(file)
    begun = F.coalesce(F.col("_before") == LF, F.lit(True))
    return rows.select(
        *seen.columns,
        "inside",
        (~F.col("inside") & begun).alias("fresh"),
        (returns > 0).alias("crlf_file"),
        (F.max(wrong).over(file) | mixed | ((returns > 0) & ~F.coalesce(F.col("_break") == CR, F.lit(False)))).alias("irregular"),
    )


def records(blocks: DataFrame, quote: str = '"', header: bool = True) -> DataFrame:
    """(path, block, place, record) of the blocks of regular files: every record with its
    number in the block, without its line end. Empty lines and, with ``header``, the
    first record of a file are left out."""
    quote_byte = ord(quote)

    def whole(row: dict) -> tuple[np.ndarray, np.ndarray] | None:
        """The bytes of the block's records, and where each ends."""
        data = b"".join(contents(row["path"], row["first"], row["last"], row["gzip"]))
        held = np.frombuffer(data, np.uint8)
        quotes = np.flatnonzero(held == quote_byte)
        feeds = np.flatnonzero(held == LF)
        outside = (np.searchsorted(quotes, feeds) + row["inside"]) % 2 == 0
        ends = feeds[outside] + 1
        start = 0 if row["fresh"] else int(ends[0]) if len(ends) else len(data)
        if start == len(data):
            return None
        ends = ends[ends > start]
        if not len(ends) or ends[-1] < len(data):  # read on to the end of the last record
            inside = (len(quotes) + row["inside"]) % 2 == 1
            rest = []
            for piece in contents(row["path"], row["last"], None, row["gzip"]) if row["more"] else ():
                more = np.frombuffer(piece, np.uint8)
                marks, feeds = np.flatnonzero(more == quote_byte), np.flatnonzero(more == LF)
                stops = feeds[(np.searchsorted(marks, feeds) + inside) % 2 == 0]
                rest.append(piece[: stops[0] + 1] if len(stops) else piece)
                if len(stops):
                    break
                inside = (len(marks) + inside) % 2 == 1
            held = np.frombuffer(data + b"".join(rest), np.uint8)
            ends = np.append(ends, len(held))
        return held[start:], ends - start

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = whole(row)
                if found is None:
                    continue
                held, ends = found
                text = held.tobytes()
                if row["crlf_file"]:  # as a reader that takes both for one line end
                    keep = np.ones(len(held), bool)
                    keep[np.flatnonzero(held == CR)] = False
                    ends = np.cumsum(keep)[ends - 1]
                    text = held[keep].tobytes()
                starts = np.concatenate([[0], ends[:-1]])
                skip = len(BOM) if row["block"] == 0 and text.startswith(BOM) else 0
                starts[0] += skip
                lines = (text[a:b].removesuffix(b"\n") for a, b in zip(starts.tolist(), ends.tolist()))
                kept = [x for x in lines if x][int(header and row["block"] == 0) :]
                for at in range(0, len(kept), 10_000):
                    part = kept[at : at + 10_000]
                    n = len(part)
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in part])]).astype(np.int32)
                    bodies = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(part))])
                    yield pa.record_batch(
                        [pa.array([row["path"]] * n), pa.array([row["block"]] * n), pa.array(range(at, at + n), pa.int64()), bodies],
                        ["path", "block", "place", "record"],
                    )

    last = F.max("block").over(Window.partitionBy("path"))
    rows = blocks.withColumn("more", F.col("block") < last)
    return dealt(rows, "path", "block").mapInArrow(work, "path string, block long, place long, record string")
