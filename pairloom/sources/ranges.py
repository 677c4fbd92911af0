"""Files as byte ranges that tasks read on their own.

Spark's binary source hands out whole files. Here a file is listed by Spark and its
ranges are read inside tasks, in chunks, through the file systems of pyarrow (local and
mounted paths, object stores, and HDFS where its native client is installed).
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The functions below run in Python workers, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK = 1 << 20
BLOCK_BYTES = 64 << 20


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or absolute path."""
    local = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


def chunks(path: str, first: int, last: int | None = None) -> Iterator[bytes]:
    """The bytes of ``[first, last)``, or to the end, a chunk at a time."""
    store, name = storage(path)
    with store.open_input_file(name) as file:
        file.seek(first)
        while last is None or first < last:
            data = file.read(CHUNK if last is None else min(CHUNK, last - first))
            if not data:
                break
            first += len(data)
            yield data


def list_files(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, filename, bytes) of all files in or below a path; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    name = F.element_at(F.split("path", "/"), -1)
    found = reader.load(path)
    # A scan passes over empty files; the names that Spark's own listing keeps have them.
    named = [(re.sub("^file:/+", "file:/", unquote(f)),) for f in found.inputFiles()]
    listed = spark.createDataFrame(named, "path string").join(found.select("path", "length"), "path", "left")
    return listed.select("path", name.alias("filename"), F.coalesce("length", F.lit(0)).alias("bytes"))


def ranges(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, first, last): the blocks of every file from 0; an empty file has one."""
    last_block = F.greatest(F.ceil(F.col("bytes") / block_bytes).cast("bigint") - 1, F.lit(0))
    cut = files.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)).alias("block"))
    first = F.col("block") * block_bytes
    return cut.select("path", "block", first.alias("first"), F.least(F.col("bytes"), first + block_bytes).alias("last"))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows that name work, spread over as many tasks as a shuffle has."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def each_row(rows: DataFrame, schema: str, read: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """Rows of string, long and boolean columns that ``read`` makes of every row."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(","))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = list(read(row))
                if made:
                    yield pa.RecordBatch.from_pylist(made, fields)

    return rows.mapInArrow(work, schema)
