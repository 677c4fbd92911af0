"""Source profiles and count summaries, each one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_rows(one_row: DataFrame) -> DataFrame:
    """(metric, value) rows from a one-row frame of bigint columns."""
    cells = [F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one_row.columns]
    return one_row.select(F.explode(F.array(*cells)).alias("m")).select("m.metric", "m.value")


def profile_pairs(df: DataFrame, a: str, b: str, valid: Column | None = None) -> DataFrame:
    """(metric, value): row, invalid, self, directed, undirected, duplicate and
    endpoint counts of a pair source."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    left, right = F.col(a), F.col(b)
    distinct = (
        df.groupBy(ok.alias("_ok"), left.alias("_a"), right.alias("_b"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # One row per distinct directed pair from here on.
    summary = distinct.agg(
        F.coalesce(F.sum(F.when(F.col("_ok"), F.col("_n"))), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~F.col("_ok"), F.col("_n"))), F.lit(0)).alias("invalid_rows"),
        F.coalesce(F.sum(F.when(F.col("_ok") & (F.col("_a") == F.col("_b")), F.col("_n"))), F.lit(0)).alias("self_pairs"),
        F.count_if("_ok").alias("directed_pairs"),
        F.count_distinct(
            F.when(F.col("_ok"), F.struct(F.least("_a", "_b"), F.greatest("_a", "_b")))
        ).alias("undirected_pairs"),
    ).select("*", (F.col("rows") - F.col("undirected_pairs")).alias("duplicate_or_reciprocal_rows"))
    ends = (
        distinct.where("_ok")
        .select(F.explode(F.array("_a", "_b")).alias("e"))
        .agg(F.count_distinct("e").alias("distinct_endpoints"))
    )
    return metric_rows(summary).unionByName(metric_rows(ends))


def funnel(df: DataFrame, levels: Mapping[str, Column], a: str, b: str) -> DataFrame:
    """(level, rows, distinct_pairs): each level keeps rows passing it and all
    earlier ones; the source is grouped once."""
    depth = F.lit(0)
    held = F.lit(True)
    names = ["all", *levels]
    for i, condition in enumerate(levels.values(), start=1):
        held = held & F.coalesce(condition, F.lit(False))
        depth = F.when(held, F.lit(i)).otherwise(depth)
    per_pair = df.groupBy(
        F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"), depth.alias("_d")
    ).agg(F.count(F.lit(1)).alias("_n"))
    deepest = per_pair.groupBy("_a", "_b").agg(
        F.max("_d").alias("_d"),
        *[
            F.sum(F.when(F.col("_d") >= i, F.col("_n")).otherwise(0)).alias(f"_r{i}")
            for i in range(len(names))
        ],
    )
    cells = []
    total = deepest.agg(
        *[F.coalesce(F.sum(f"_r{i}"), F.lit(0)).alias(f"r{i}") for i in range(len(names))],
        *[F.count_if(F.col("_d") >= i).alias(f"p{i}") for i in range(len(names))],
    )
    for i, name in enumerate(names):
        cells.append(
            F.struct(
                F.lit(name).alias("level"),
                F.col(f"r{i}").alias("rows"),
                F.col(f"p{i}").alias("distinct_pairs"),
            )
        )
    return total.select(F.explode(F.array(*cells)).alias("f")).select("f.*")


def top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most common values, ties in value order."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("value")).limit(k)


def count_summary(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dimension, value, n) for every dimension from one grouping-sets job."""
    sets = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")
    )
    # Bit i of the grouping id is clear for the dimension a row belongs to.
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, dim in enumerate(dims):
        own = F.col("_g").bitwiseAND(F.lit(1 << (len(dims) - 1 - i))) == 0
        name = F.when(own, F.lit(dim)).otherwise(name)
        value = F.when(own, F.col(dim).cast("string")).otherwise(value)
    return sets.select(name.alias("dimension"), F.coalesce(value, F.lit("")).alias("value"), "n")


def reason_histogram(df: DataFrame, col: str = "reasons") -> DataFrame:
    """Count reasons in an array column or in ``;``-joined text."""
    kind = dict(df.dtypes)[col]
    cells = F.col(col) if kind.startswith("array") else F.split(col, ";")
    return (
        df.select(F.explode(cells).alias("reason"))
        .where(F.col("reason") != "")
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cluster_stats(membership: DataFrame, cluster: str) -> DataFrame:
    """(metric, value): entities, clusters, largest cluster, singletons."""
    sizes = membership.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return metric_rows(
        sizes.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("entities"),
            F.count(F.lit(1)).alias("clusters"),
            F.coalesce(F.max("n"), F.lit(0)).alias("largest_cluster"),
            F.count_if(F.col("n") == 1).alias("singletons"),
        )
    )
