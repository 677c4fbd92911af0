"""Tie-aware ranking metrics for any number of slices in one job.

Rows with equal scores enter together, so row order never matters. The input
shrinks to (slice, score, n, positives) first; running totals over that table
are cut into range slices, so one huge slice does not land in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip
from pairloom.operators.ordered import running_totals
from pairloom.operators.rules import Rule, duplicate_keys, require_min_rows, union_all, violations

ECE_BINS = 10
BEDROC_ALPHA = 20.0


def score_counts(
    df: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None
) -> DataFrame:
    """(by, score, n, positives); ``weight`` is a row multiplicity."""
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col(label).cast("bigint")).alias("positives")
    )


def score_groups(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts plus totals from the top (``cum_``) and of the slice (``all_``)."""
    return running_totals(counts, by, [F.col("score").desc()], ["n", "positives"])


@dataclass(frozen=True)
class ScoreState:
    """The columns a metric of score groups reads: counts of the group, totals from the
    top, totals of the slice. A group may be empty, as in a replicate that left it out."""

    score: Column
    n: Column
    positives: Column
    cum_n: Column
    cum_positives: Column
    all_n: Column
    all_positives: Column

    @classmethod
    def named(cls, suffix: str = "") -> ScoreState:
        counts = (f"{kind}{name}{suffix}" for kind in ("", "cum_", "all_") for name in ("n", "positives"))
        return cls(F.col("score"), *map(F.col, counts))


Metric = Callable[[ScoreState], Column]


def _average_precision(s: ScoreState) -> Column:
    share = F.try_divide(s.positives, s.all_positives)
    return F.when(F.max(s.all_positives) > 0, F.sum(F.when(s.positives > 0, F.try_divide(share * s.cum_positives, s.cum_n))))


def _pr_auc(s: ScoreState) -> Column:
    seen, hits = s.cum_n - s.n, s.cum_positives - s.positives
    previous = F.when(seen == 0, F.lit(1.0)).otherwise(F.try_divide(hits, seen))
    step = F.try_divide(s.positives, s.all_positives)
    area = step * (previous + F.try_divide(s.cum_positives, s.cum_n)) / 2
    return F.when(F.max(s.all_positives) > 0, F.sum(F.when(s.n > 0, area)))


def _auroc(s: ScoreState) -> Column:
    negatives = s.n - s.positives
    all_negatives = s.all_n - s.all_positives
    below = all_negatives - (s.cum_n - s.cum_positives)
    # Products of counts leave the range of bigint: they are taken as doubles.
    hits = s.positives.cast("double")
    wins = hits * below + F.lit(0.5) * hits * negatives
    pairs = F.max(s.all_positives.cast("double") * all_negatives)
    return F.when(pairs > 0, F.try_divide(F.sum(wins), pairs))


def _expected_hits(s: ScoreState, k: Column) -> Column:
    room = F.greatest(F.lit(0), k - (s.cum_n - s.n))
    return F.sum(F.try_divide(F.least(s.n, room) * s.positives, s.n))


def _one_percent(n: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(n * F.lit(0.01)))


def precision_at(k: int) -> Metric:
    return lambda s: F.try_divide(_expected_hits(s, F.lit(k)), F.least(F.lit(k), F.max(s.all_n)))


def recall_at(k: int) -> Metric:
    return lambda s: F.when(F.max(s.all_positives) > 0, F.try_divide(_expected_hits(s, F.lit(k)), F.max(s.all_positives)))


def _enrichment(s: ScoreState) -> Column:
    k = _one_percent(s.all_n)
    hits, rows, actives = _expected_hits(s, k), F.max(s.all_n), F.max(s.all_positives)
    return F.when(actives > 0, F.try_divide(F.try_divide(hits, F.least(F.max(k), rows)), F.try_divide(actives, rows)))


def bedroc(alpha: float) -> Metric:
    def metric(s: ScoreState) -> Column:
        total, actives = s.all_n, s.all_positives
        rate = F.try_divide(F.lit(alpha), total)

        def span(first: Column, count: Column) -> Column:
            """Sum of exp(-rate * r) over ``count`` ranks from ``first``."""
            return F.try_divide(F.exp(-rate * first) * F.expm1(-rate * count), F.expm1(-rate))

        group = span(s.cum_n - s.n + 1, s.n)
        observed = F.sum(F.try_divide(s.positives, s.n) * group)
        best = F.max(span(F.lit(1), actives))
        worst = F.max(span(total - actives + 1, actives))
        both = F.max((actives > 0) & (total > actives))
        value = F.try_divide(observed - worst, best - worst)
        return F.when(both & (best > worst), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))

    return metric


def _in_unit(s: ScoreState) -> Column:
    held = F.when(s.n > 0, s.score)
    return (F.min(held) >= 0) & (F.max(held) <= 1)


def _brier(s: ScoreState) -> Column:
    x, p = s.score, s.positives
    return F.when(_in_unit(s), F.try_divide(F.sum(p * (x - 1) * (x - 1) + (s.n - p) * x * x), F.max(s.all_n)))


def calibration_error(bins: int) -> Metric:
    def metric(s: ScoreState) -> Column:
        inside = s.score.between(0, 1)
        index = F.when(inside, F.least(F.floor(s.score * bins), F.lit(bins - 1)))
        gap = s.positives - s.score * s.n
        total = sum(
            (F.abs(F.coalesce(F.sum(F.when(index == i, gap)), F.lit(0.0))) for i in range(bins)), F.lit(0.0)
        )
        return F.when(_in_unit(s), F.try_divide(total, F.max(s.all_n)))

    return metric


#: Aggregates over the score groups of one slice, by name; extend it with one's own.
METRICS: dict[str, Metric] = {
    "n": lambda s: F.max(s.all_n),
    "positives": lambda s: F.max(s.all_positives),
    "negatives": lambda s: F.max(s.all_n) - F.max(s.all_positives),
    "prevalence": lambda s: F.try_divide(F.max(s.all_positives), F.max(s.all_n)),
    "average_precision": _average_precision,
    "pr_auc_trapezoid": _pr_auc,
    "auroc": _auroc,
    "precision_at_50": precision_at(50),
    "precision_at_100": precision_at(100),
    "recall_at_50": recall_at(50),
    "recall_at_100": recall_at(100),
    "ef_at_1_percent": _enrichment,
    "bedroc_alpha_20": bedroc(BEDROC_ALPHA),
    "k_at_1_percent": lambda s: F.max(_one_percent(s.all_n)),
    "brier_score": _brier,
    "ece_10_equal_width": calibration_error(ECE_BINS),
}


def metrics_from_groups(groups: DataFrame, by: Sequence[str], names: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """The named metrics of every slice, one aggregation over score groups."""
    state = ScoreState.named()
    return groups.groupBy(*by).agg(*[METRICS[m](state).alias(m) for m in names])


def metrics(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Full metric row per slice of a (by, label, score) table."""
    return metrics_from_groups(score_groups(score_counts(df, by, weight=weight), by), by)


def average_precision(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    groups = score_groups(score_counts(df, by, weight=weight), by)
    return metrics_from_groups(groups, by, ["average_precision"])


def metric_at_k(df: DataFrame, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by, k, expected_hits, precision, recall) for several cut-offs."""
    groups = score_groups(score_counts(df, by), by)
    wide = groups.groupBy(*by).agg(
        F.max("all_n").alias("_n"),
        F.max("all_positives").alias("_p"),
        *[_expected_hits(ScoreState.named(), F.lit(k)).alias(f"h{k}") for k in ks],
    )
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("expected_hits")) for k in ks])
    return wide.select(*by, "_n", "_p", F.explode(cells).alias("c")).select(
        *by,
        "c.k",
        "c.expected_hits",
        (F.col("c.expected_hits") / F.least(F.col("c.k"), F.col("_n"))).alias("precision"),
        F.when(F.col("_p") > 0, F.col("c.expected_hits") / F.col("_p")).alias("recall"),
    )


def stratified_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metric rows of all positives against each negative class.

    Positives are reduced to counts per score before they are repeated for
    each class.
    """
    by = list(by)
    negatives = score_counts(df.where(F.col("label") == 0), [*by, "evidence_class"])
    positives = score_counts(df.where(F.col("label") == 1), by)
    # The classes of a slice come from the contract vocabulary, a handful.
    listed = negatives.groupBy(*by).agg(F.collect_set("evidence_class").alias("_classes"))
    held = positives.join(listed, by) if by else positives.withColumn("_classes", listed.scalar())
    spread = held.select(*by, "score", "n", "positives", F.explode("_classes").alias("evidence_class"))
    columns = [*by, "evidence_class", "score", "n", "positives"]
    merged = negatives.select(*columns).unionByName(spread.select(*columns))
    keys = [*by, "evidence_class"]
    counts = merged.groupBy(*keys, "score").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    rows = metrics_from_groups(score_groups(counts, keys), keys)
    return rows.withColumn("stratum", F.concat(F.lit("positives_vs_"), "evidence_class")).drop("evidence_class")


def validate_predictions(df: DataFrame, partition: str) -> tuple[DataFrame, DataFrame]:
    """(typed predictions of the partition, violations). A blank group falls
    back to the pair id."""
    rows = df.where(strip(F.col("partition")) == partition)
    label, score = F.col("label").try_cast("int"), F.col("score").try_cast("double")
    typed = rows.select(
        strip(F.col("pair_id")).alias("pair_id"),
        label.alias("label"),
        score.alias("score"),
        strip(F.col("partition")).alias("partition"),
        strip(F.col("evidence_class")).alias("evidence_class"),
        F.when(F.coalesce(strip(F.col("bootstrap_group")), F.lit("")) == "", strip(F.col("pair_id")))
        .otherwise(strip(F.col("bootstrap_group")))
        .alias("bootstrap_group"),
    )
    finite = ~F.isnan("score") & (F.abs("score") < float("inf"))
    rules = [
        Rule("missing_pair_id", F.coalesce(F.col("pair_id"), F.lit("")) == ""),
        Rule("label_not_binary", ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))),
        Rule("score_not_finite", ~F.coalesce(finite, F.lit(False))),
    ]
    found = union_all(
        [
            violations(typed, ["pair_id"], rules),
            duplicate_keys(typed, ["pair_id"], "duplicate_pair_id"),
            require_min_rows(typed, 1, "empty_partition"),
        ]
    )
    return typed, found


def constant_reference(
    pairs: DataFrame, splits: DataFrame, partition: str = "test", score: float = 0.5
) -> DataFrame:
    """Constant-score predictions: their average precision is the prevalence."""
    chosen = splits.where(F.col("partition") == partition).select("pair_id", "partition")
    return pairs.join(chosen, "pair_id").select(
        "pair_id",
        "label",
        F.lit(score).alias("score"),
        "partition",
        "evidence_class",
        F.when(F.col("complex_group_id") == "", F.col("pair_id"))
        .otherwise(F.col("complex_group_id"))
        .alias("bootstrap_group"),
    )
