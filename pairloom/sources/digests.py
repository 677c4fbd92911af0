"""SHA-256 of files: by blocks in parallel, or of the whole file in constant memory."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.sources.ranges import BLOCK_BYTES, chunks, dealt, each_row, ranges

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Digests under one node of a tree.
FAN_OUT = 1024


def block_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, sha256) of every block of ``files`` (path, bytes)."""

    def read(row: dict) -> Iterator[dict]:
        digest = hashlib.sha256()
        for data in chunks(row["path"], row["first"], row["last"]):
            digest.update(data)
        yield {"path": row["path"], "block": row["block"], "sha256": digest.hexdigest()}

    return each_row(dealt(ranges(files, block_bytes), "path", "block"), "path string, block long, sha256 string", read)


def tree_digests(files: DataFrame, block_bytes: int = BLOCK_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """(path, tree_sha256): blocks are digested, then the joined hex digests of every
    ``fan_out`` neighbours, level by level, until a file has one; at least one level.
    So one huge file is read by many tasks, and no group exceeds ``fan_out`` digests."""
    most = files.agg(F.max("bytes")).first()[0] or 0
    width = max(1, -(-most // block_bytes))
    nodes = block_digests(files, block_bytes)
    while True:
        ordered = F.array_sort(F.collect_list(F.struct("block", "sha256")))
        joined = F.array_join(F.transform(ordered, lambda x: x["sha256"]), "")
        nodes = nodes.groupBy("path", F.expr(f"block div {fan_out}").alias("parent")).agg(F.sha2(joined, 256).alias("sha256"))
        nodes = nodes.withColumnRenamed("parent", "block")
        width = -(-width // fan_out)
        if width <= 1:
            return nodes.select("path", F.col("sha256").alias("tree_sha256"))


def whole_digests(files: DataFrame) -> DataFrame:
    """(path, sha256, lines) of whole files. SHA-256 is sequential, so a file is read by
    one task, a chunk at a time; files are read in parallel. A last line without a line
    end counts."""

    def read(row: dict) -> Iterator[dict]:
        digest, lines, end = hashlib.sha256(), 0, b"\n"
        for data in chunks(row["path"], 0):
            digest.update(data)
            lines += data.count(b"\n")
            end = data[-1:]
        yield {"path": row["path"], "sha256": digest.hexdigest(), "lines": lines + (end != b"\n")}

    return each_row(dealt(files.select("path"), "path"), "path string, sha256 string, lines long", read)
