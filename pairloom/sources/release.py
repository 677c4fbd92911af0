"""Releases that appear whole or not at all.

The tables of a release and, last, its manifest are written to a staging folder beside the
target; what was written is read back and checked against the manifest; then the folder
gets its final name by one rename that refuses an existing target. The rename is atomic on
local file systems and HDFS. A store without atomic renames (most object stores) moves file
by file there; ``recover`` then tells a torn release by its manifest.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from pairloom.sources.manifest import manifest, verify_manifest
from pairloom.sources.sinks import write_once

MANIFEST = "manifest"
STAGING = ".staging-"


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _hadoop(spark, path)
    return files.exists(target)


def commit(spark: SparkSession, staged: str, out: str) -> None:
    """Give a staged folder its final name; an existing target is an error."""
    _, source = _hadoop(spark, staged)
    _, target = _hadoop(spark, out)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri() if target.toUri().getScheme() else source.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(),
        spark._jsc.hadoopConfiguration(),
    )
    plain = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(source, target, plain)


def stored(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Manifest and tables of a release folder."""
    listing = spark.read.parquet(f"{folder}/{MANIFEST}")
    names = [r["table"] for r in listing.select("table").collect()]
    return listing, {n: spark.read.parquet(f"{folder}/{n}") for n in names if exists(spark, f"{folder}/{n}")}


def _drift(spark: SparkSession, folder: str, inputs: Mapping[str, DataFrame]) -> list[str]:
    listing, tables = stored(spark, folder)
    return [f"{r['table']} {r['issue']}" for r in verify_manifest(listing, {**inputs, **tables}).take(5)]


def publish(
    spark: SparkSession,
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]],
    out: str,
    inputs: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Publish ``name: (table, sort columns)`` at ``out``; returns the manifest, which
    also lists ``inputs``, tables that are not part of the release."""
    inputs = dict(inputs or {})
    if exists(spark, out):
        raise FileExistsError(f"{out} already exists")
    staged = f"{out}{STAGING}{uuid.uuid4().hex}"
    for name, (df, order) in tables.items():
        write_once(df, f"{staged}/{name}", order)
    written = {n: spark.read.parquet(f"{staged}/{n}") for n in tables}
    write_once(manifest({**inputs, **{n: df for n, (df, _) in tables.items()}}), f"{staged}/{MANIFEST}", ["table"])
    drift = _drift(spark, staged, {**inputs, **written})
    if drift:
        raise OSError("written tables differ: " + "; ".join(drift))
    commit(spark, staged, out)
    return spark.read.parquet(f"{out}/{MANIFEST}")


def _whole(spark: SparkSession, folder: str, inputs: Mapping[str, DataFrame]) -> bool:
    return exists(spark, f"{folder}/{MANIFEST}/_SUCCESS") and not _drift(spark, folder, inputs)


def recover(spark: SparkSession, out: str, inputs: Mapping[str, DataFrame] | None = None) -> str:
    """Clean up after a job that died while it published ``out``.

    ``published``: the release is there; leftovers are deleted. ``recovered``: a staged
    release was whole and got its name. ``discarded``: what was staged was torn and is
    deleted. ``nothing``: there was nothing. ``inputs`` are those given to ``publish``.
    """
    files, target = _hadoop(spark, out)
    inputs = dict(inputs or {})
    there = files.exists(target)
    if there and not _whole(spark, out, inputs):
        raise OSError(f"{out} is not whole; it was not made by one rename or was changed since")
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out}{STAGING}*"))
    state = "published" if there else "discarded" if len(found) else "nothing"
    for status in found:
        staged = status.getPath().toString()
        if state == "discarded" and _whole(spark, staged, inputs):
            commit(spark, staged, out)
            state = "recovered"
        else:
            files.delete(status.getPath(), True)
    return state
