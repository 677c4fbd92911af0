"""Write-once deterministic outputs, and gzip files that can be read in parallel."""

from __future__ import annotations

import gzip
import posixpath
import sys
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.runtime import stage
from pairloom.sources.ranges import storage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text in one gzip member.
MEMBER_BYTES = 8 << 20


def write_once(
    df: DataFrame, path: str, sort_cols: Sequence[str], columns: Sequence[str] | None = None, fmt: str = "parquet"
) -> None:
    """Sorted rows in a fixed column order; an existing target is an error."""
    ordered = df.select(*(columns or df.columns)).sort(*sort_cols)
    writer = ordered.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    writer.format(fmt).save(path)


def write_gzip_members(
    df: DataFrame, path: str, sep: str = "\t", header: bool = True, member_bytes: int = MEMBER_BYTES
) -> DataFrame:
    """Delimited text, one gzip file per task made of members of about ``member_bytes``,
    which ``read_table`` reads in parallel. Returns (file, rows, members).

    A file appears under its final name when it is whole; a second attempt of its task
    replaces it. Cells are enclosed in quotes where they need it; null is empty.
    """
    text = lambda c: F.col(f"`{c}`").cast("string")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    unsafe = f'[{sep}"\\r\\n]'
    cells = [F.when(text(c).rlike(unsafe), quoted(text(c))).otherwise(F.coalesce(text(c), F.lit(""))) for c in df.columns]
    top = sep.join(df.columns) + "\n" if header else ""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = storage(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.gz"
        partial = posixpath.join(folder, f".{name}-{uuid.uuid4().hex}")
        rows = members = 0
        held, size = [top], len(top)
        with store.open_output_stream(partial, compression=None) as out:

            def close_member() -> None:
                nonlocal members
                out.write(gzip.compress("".join(held).encode(), mtime=0))
                members += 1

            for batch in batches:
                for line in batch.column(0).to_pylist():
                    held.append(line + "\n")
                    size += len(line) + 1
                    rows += 1
                    if size >= member_bytes:
                        close_member()
                        held, size = [], 0
            if held or not members:
                close_member()
        store.move(partial, posixpath.join(folder, name))
        yield pa.record_batch([pa.array([name]), pa.array([rows]), pa.array([members])], ["file", "rows", "members"])

    lines = df.select(F.concat_ws(sep, *cells).alias("line"))
    return stage(lines.mapInArrow(write, "file string, rows long, members long"), "gzip-files")
