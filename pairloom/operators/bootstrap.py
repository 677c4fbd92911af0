"""Paired group bootstrap as weights, never as copied rows.

Replicate r draws G groups with replacement from G groups: draw j takes the
group with number floor(u * G), u = unit_hash(seed, r, j). Draws are counted
per (replicate, group) and used as weights on counts that were already reduced
to (group, score).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.keys import unit_hash
from pairloom.operators.ordered import (
    quantiles,
    running_totals,
    sliced_running_totals,
    with_slices,
)
from pairloom.operators.ranking import METRICS, ScoreState
from pairloom.operators.rules import union_all
from pairloom.runtime import stage

# Replicates that travel side by side in one row.
BLOCK = 16


def numbered_groups(df: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """(by, group, group_no, n_groups): groups numbered from 0 in text order."""
    ids = df.select(*by, F.col(group).alias("bootstrap_group")).distinct().withColumn("one", F.lit(1).cast("bigint"))
    run = running_totals(ids, by, [F.col("bootstrap_group")], ["one"])
    return run.select(
        *by, "bootstrap_group", (F.col("cum_one") - 1).alias("group_no"), F.col("all_one").alias("n_groups")
    )


def draw_weights(groups: DataFrame, by: Sequence[str], first: int, last: int, seed: int) -> DataFrame:
    """(by, block, bootstrap_group, d0..d15): how often each replicate of a
    block of sixteen drew the group.

    Every group row produces the draws that carry its own number. Blocks are
    dealt out over all tasks before their replicates are drawn, so a group
    table of one partition does not draw all of them in one task; the counts
    need no further shuffle.
    """
    blocks = F.sequence(F.lit(first // BLOCK), F.lit((last - 1) // BLOCK))
    rows = groups.select(*by, "n_groups", F.col("group_no").alias("draw"), F.explode(blocks).alias("block"))
    tasks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, *by, "block")
    place = F.explode(F.sequence(F.lit(0), F.lit(BLOCK - 1)))
    drawn = dealt.select("*", place.alias("k")).where(F.col("block") * BLOCK + F.col("k") < last)
    key = F.concat_ws(":", F.col("block") * BLOCK + F.col("k"), "draw")
    taken = F.floor(unit_hash(seed, key) * F.col("n_groups"))
    counted = drawn.groupBy(*by, "block", taken.alias("group_no")).agg(
        *[F.count_if(F.col("k") == k).cast("int").alias(f"d{k}") for k in range(BLOCK)]
    )
    named = counted.join(groups.select(*by, "group_no", "bootstrap_group"), [*by, "group_no"])
    return named.drop("group_no")


def unblocked(df: DataFrame, by: Sequence[str], names: Sequence[str], last: int) -> DataFrame:
    """One row per replicate from the columns ``<name>_<k>`` of a block."""
    cells = F.array(
        *[
            F.struct((F.col("block") * BLOCK + k).alias("replicate"), *[F.col(f"{m}_{k}").alias(m) for m in names])
            for k in range(BLOCK)
        ]
    )
    long = df.select(*by, F.explode(cells).alias("c")).select(*by, "c.replicate", *[f"c.{m}" for m in names])
    return long.where(F.col("replicate") < last)


def replicate_metrics(
    df: DataFrame,
    by: Sequence[str],
    scores: Sequence[str],
    names: Sequence[str],
    replicates: int,
    seed: int,
    group: str = "bootstrap_group",
    batch: int = 2000,
) -> DataFrame:
    """(by, score_name, replicate, one column per metric name) per replicate.
    ``names`` are keys of ``ranking.METRICS``; ``batch`` is a multiple of the
    block size.

    The score order is the same in every replicate, so the range slices of the
    running totals are fixed once on the distinct scores; a replicate only
    brings new weights, and all metrics read the same weighted totals. With
    more replicates than ``batch``, each batch's result, one short row per
    replicate, is staged before the next begins.
    """
    by, names = list(by), list(names)
    groups = stage(numbered_groups(df, by, group), "groups")
    sides = F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("score")) for s in scores])
    long = df.select(*by, F.col(group).alias("bootstrap_group"), "label", F.explode(sides).alias("s"))
    reduced = stage(
        long.groupBy(*by, "bootstrap_group", "s.score_name", "s.score").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("positives")
        ),
        "reduced",
    )
    distinct = reduced.select(*by, "score_name", "score").distinct()
    order = [F.col("score").desc()]
    sliced = with_slices(distinct, [*by, "score_name"], order)
    # A slice's cells lie together, so with few groups, whose weights Spark broadcasts by
    # the size of their files, the counts of a score are summed before they are shuffled.
    cells = reduced.join(sliced, [*by, "score_name", "score"]).repartition(*by, "score_name", "_slice")
    keys = ["block", *by, "score_name"]
    columns = range(BLOCK)
    parts = []
    for first in range(0, replicates, batch):
        last = min(first + batch, replicates)
        weights = stage(draw_weights(groups, by, first, last, seed), "weights")
        counts = (
            cells.join(weights, [*by, "bootstrap_group"])
            .groupBy(*keys, "_slice", "score")
            .agg(*[F.sum(F.col(v) * F.col(f"d{k}")).alias(f"{v}_{k}") for v in ("n", "positives") for k in columns])
            .repartition(*keys, "_slice")
        )
        run = sliced_running_totals(counts, keys, order, [f"{v}_{k}" for v in ("n", "positives") for k in columns])
        done = run.groupBy(*keys).agg(
            *[METRICS[m](ScoreState.named(f"_{k}")).alias(f"{m}_{k}") for m in names for k in columns]
        )
        parts.append(stage(unblocked(done, [*by, "score_name"], names, last), "replicates"))
    return union_all(parts)


def interval(values: DataFrame, by: Sequence[str], value: str, replicates: int) -> DataFrame:
    """(by, replicates_requested, replicates_valid, lower_95, upper_95)."""
    by = list(by)
    valid = values.groupBy(*by).agg(F.count(value).alias("replicates_valid"))
    bounds = quantiles(values, by, value, {"lower_95": 0.025, "upper_95": 0.975})
    if by:
        out = valid.join(bounds, by, "left")
    else:
        both = bounds.select(F.struct("lower_95", "upper_95")).scalar()
        out = valid.withColumn("_b", both).select("replicates_valid", "_b.lower_95", "_b.upper_95")
    return out.select(
        *by, F.lit(replicates).alias("replicates_requested"), "replicates_valid", "lower_95", "upper_95"
    )


def _measures(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, metric, value) from a row with one column per metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return df.select(*by, F.explode(cells).alias("c")).select(*by, "c.metric", "c.value")


def _nothing_drawn(df: DataFrame, by: Sequence[str], names: Sequence[str], replicates: int) -> DataFrame:
    slices = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return slices.select(
        *by,
        F.explode(F.array(*map(F.lit, names))).alias("metric"),
        F.lit(replicates).alias("replicates_requested"),
        F.lit(0).cast("bigint").alias("replicates_valid"),
        F.lit(None).cast("double").alias("lower_95"),
        F.lit(None).cast("double").alias("upper_95"),
    )


def bootstrap_intervals(
    df: DataFrame,
    by: Sequence[str],
    names: Sequence[str],
    replicates: int,
    seed: int,
    score: str = "score",
    **kwargs,
) -> DataFrame:
    """(by, metric, interval) of any metrics of ``ranking.METRICS``, all on the same
    draws. A replicate in which a metric is not defined does not count for it."""
    if replicates <= 0:
        return _nothing_drawn(df, by, names, replicates)
    values = replicate_metrics(df, by, [score], names, replicates, seed, **kwargs)
    return interval(_measures(values, by, names), [*by, "metric"], "value", replicates)


def bootstrap_deltas(
    aligned: DataFrame, by: Sequence[str], names: Sequence[str], replicates: int, seed: int, **kwargs
) -> DataFrame:
    """(by, metric, interval) of candidate minus baseline on the same draws. A
    replicate counts for a metric only when both values exist."""
    if replicates <= 0:
        return _nothing_drawn(aligned, by, names, replicates)
    scores = ["score_candidate", "score_baseline"]
    values = replicate_metrics(aligned, by, scores, names, replicates, seed, **kwargs)
    side = lambda m, s: F.max(F.when(F.col("score_name") == s, F.col(m)))
    paired = values.groupBy(*by, "replicate").agg(*[(side(m, scores[0]) - side(m, scores[1])).alias(m) for m in names])
    return interval(_measures(paired, by, names), [*by, "metric"], "value", replicates)


def bootstrap_average_precision(
    df: DataFrame, by: Sequence[str], replicates: int, seed: int, score: str = "score", **kwargs
) -> DataFrame:
    """Interval of the average precision per slice."""
    return bootstrap_intervals(df, by, ["average_precision"], replicates, seed, score, **kwargs).drop("metric")


def bootstrap_delta(
    aligned: DataFrame, by: Sequence[str], replicates: int, seed: int, **kwargs
) -> DataFrame:
    """Interval of candidate minus baseline average precision per slice."""
    return bootstrap_deltas(aligned, by, ["average_precision"], replicates, seed, **kwargs).drop("metric")


def bootstrap_means(
    df: DataFrame,
    by: Sequence[str],
    values: Mapping[str, Column],
    replicates: int,
    seed: int,
    group: str = "bootstrap_group",
) -> DataFrame:
    """(by, measure, interval) of the means of named row values, all measures
    on the same draws."""
    by = list(by)
    groups = stage(numbered_groups(df, by, group), "groups")
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("v")) for m, v in values.items()])
    reduced = (
        df.select(*by, F.col(group).alias("bootstrap_group"), F.explode(cells).alias("c"))
        .groupBy(*by, "bootstrap_group", "c.measure")
        .agg(F.sum("c.v").alias("s"), F.count("c.v").alias("n"))
    )
    weights = draw_weights(groups, by, 0, replicates, seed)
    means = [
        F.try_divide(F.sum(F.col("s") * F.col(f"d{k}")), F.sum(F.col("n") * F.col(f"d{k}"))).alias(f"mean_{k}")
        for k in range(BLOCK)
    ]
    blocks = reduced.join(weights, [*by, "bootstrap_group"]).groupBy("block", *by, "measure").agg(*means)
    means = unblocked(blocks, [*by, "measure"], ["mean"], replicates)
    return interval(stage(means, "means"), [*by, "measure"], "mean", replicates)
