"""Order-dependent sums, ranks and quantiles that no single task has to hold.

A plain ``Window.partitionBy(group)`` sorts a whole group in one task. Here a
group is cut into contiguous slices first, so only slice totals (a bounded
number per group) meet in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.runtime import stage


def _slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_slices(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Stage ``df`` with ``_slice``: contiguous ranges of (by, order).

    Staged, because a slice number must be the same wherever it is used.
    """
    ranged = df.repartitionByRange(_slices(df), *[F.col(c) for c in by], *order)
    return stage(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def sliced_running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    inclusive: bool = True,
) -> DataFrame:
    """Add ``cum_<v>`` of sums and maxima over the rows up to this one (or
    before it), and ``all_<v>``, to a table with ``_slice``; keeps ``_slice``."""
    by = list(by)
    kinds = [(v, F.sum) for v in sums] + [(v, F.max) for v in maxima]
    totals = df.groupBy(*by, "_slice").agg(*[f(v).alias(f"_t_{v}") for v, f in kinds])
    # At most one row per slice and group meets here.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_slice",
        *[f(f"_t_{v}").over(before).alias(f"_o_{v}") for v, f in kinds],
        *[f(f"_t_{v}").over(group).alias(f"all_{v}") for v, f in kinds],
    )
    last = Window.currentRow if inclusive else -1
    inside = (
        Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    )

    def joined(v: str) -> Column:
        if v in maxima:
            return F.greatest(F.max(v).over(inside), F.col(f"_o_{v}"))
        return F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.coalesce(F.col(f"_o_{v}"), F.lit(0))

    return df.join(offsets, [*by, "_slice"]).select(
        *df.columns,
        *[joined(v).alias(f"cum_{v}") for v, _ in kinds],
        *[F.col(f"all_{v}") for v, _ in kinds],
    )


def sliced_running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], values: Sequence[str]
) -> DataFrame:
    """``running_totals`` of a table that already carries ``_slice``."""
    return sliced_running(df, by, order, sums=values).drop("_slice")


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], values: Sequence[str]
) -> DataFrame:
    """Add ``cum_<v>`` (inclusive running total) and ``all_<v>`` (group total).

    ``(by, order)`` must be unique and ``by`` non-null.
    """
    return sliced_running_totals(with_slices(df, by, order), by, order, values)


def hash_ranked(
    df: DataFrame, by: Sequence[str], hash_key: str, tie: str, limit: DataFrame, limit_col: str
) -> DataFrame:
    """Rows whose rank by (hash_key, tie) in their group is at most the group's
    ``limit_col``; adds ``hash_rank``.

    ``hash_key`` is a uniform hex digest, so its first four digits cut a group
    into 65,536 even slices. Slices that start beyond the limit are dropped
    before any sort.
    """
    by = list(by)
    cut = df.withColumn("_slice", F.substring(hash_key, 1, 4))
    totals = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(limit.select(*by, F.col(limit_col).alias("_limit")), by)
        .where(F.col("_before") < F.col("_limit"))
        .drop("_n")
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(hash_key, tie)
    return (
        cut.join(starts, [*by, "_slice"])
        .withColumn("hash_rank", F.row_number().over(inside) + F.col("_before"))
        .where(F.col("hash_rank") <= F.col("_limit"))
        .drop("_slice", "_before", "_limit")
    )


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per name.

    Works on (group, value, count) with running totals, so a group's values are
    never gathered. ``by`` must be non-null; null values are ignored.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    run = running_totals(counts, by, [F.col(value)], ["n"])
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    picks = []
    for name, p in probs.items():
        position = (F.col("all_n") - 1) * F.lit(p)
        for side, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when(at.between(first, last), F.col(value))).alias(f"_{name}_{side}"))
    picked = run.groupBy(*by).agg(F.max("all_n").alias("_n"), *picks)
    out = []
    for name, p in probs.items():
        position = (F.col("_n") - 1) * F.lit(p)
        weight = position - F.floor(position)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append(F.when(weight == 0, lo).otherwise(lo * (1 - weight) + hi * weight).alias(name))
    return picked.select(*by, *out)


def smallest_per_group(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """``by``, ``values``: the k smallest distinct values as a sorted array.

    The rank filter lets Spark keep at most k rows per group and task before
    the shuffle.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(value)
    top = df.select(*by, value).distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("values"))
