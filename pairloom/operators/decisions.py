"""Comparisons across seeds and the decision rules built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.bootstrap import bootstrap_delta, bootstrap_means
from pairloom.operators.coverage import align
from pairloom.operators.ranking import average_precision, metrics
from pairloom.operators.rules import duplicate_keys, union_all
from pairloom.runtime import stage

# The metrics summarised across seeds, and the gate's margins.
SUMMARY_METRICS = (
    "average_precision",
    "pr_auc_trapezoid",
    "auroc",
    "precision_at_50",
    "precision_at_100",
    "recall_at_50",
    "recall_at_100",
    "ef_at_1_percent",
    "bedroc_alpha_20",
    "brier_score",
    "ece_10_equal_width",
)
POINT_MARGIN = -0.05
FRACTION_MARGIN = -0.10
ACCEPTABLE_SCORE = 0.23
REPLICATES = 2000
BOOTSTRAP_SEED = 20260915
REGISTERED_SEEDS = (42, 123, 999)
REQUIRED_COHORTS = ("balanced_explicit_1to1", "full_evidence_pool", "balanced_curated_1to1", "balanced_screen_1to1")


def seed_summary(per_seed: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(by, metric, n_seeds, mean, sample_sd, minimum, maximum) over the seeds;
    everything but n_seeds is null when any seed's value is null."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in measures])
    long = per_seed.select(*by, F.explode(cells).alias("c")).select(*by, "c.metric", "c.value")
    gap = F.bool_or(F.col("value").isNull())

    def whole(col: Column, name: str) -> Column:
        return F.when(~gap, col).alias(name)

    return long.groupBy(*by, "metric").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        whole(F.avg("value"), "mean"),
        whole(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), "sample_sd"),
        whole(F.min("value"), "minimum"),
        whole(F.max("value"), "maximum"),
    )


def positive_deltas(deltas: DataFrame, by: Sequence[str], delta: str = "absolute_delta") -> DataFrame:
    up = F.coalesce(F.col(delta) > 0, F.lit(False))
    return deltas.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.count_if(up).alias("seeds_positive"),
        F.bool_and(up).alias("all_positive"),
    )


def deltas_of(aligned: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, candidate_ap, baseline_ap, absolute_delta, relative_delta) of an
    aligned table with score_candidate and score_baseline."""
    by = list(by)
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), F.col(f"score_{s}").alias("score"))
            for s in ("candidate", "baseline")
        ]
    )
    long = aligned.select(*by, "label", F.explode(sides).alias("s")).select(*by, "label", "s.side", "s.score")
    scored = average_precision(long, [*by, "side"])
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("average_precision")))
    wide = scored.groupBy(*by).agg(pick("candidate").alias("candidate_ap"), pick("baseline").alias("baseline_ap"))
    delta = F.col("candidate_ap") - F.col("baseline_ap")
    return wide.select(
        *by,
        "candidate_ap",
        "baseline_ap",
        delta.alias("absolute_delta"),
        F.when(F.col("baseline_ap") != 0, delta / F.col("baseline_ap")).alias("relative_delta"),
    )


def compare(
    candidate: DataFrame, baseline: DataFrame, by: Sequence[str] = (), key: Sequence[str] = ("pair_id",)
) -> tuple[DataFrame, DataFrame]:
    """(deltas, violations) of two prediction tables over the same keys."""
    aligned, found = align(candidate, baseline, [*by, *key], ["label", "bootstrap_group"])
    return deltas_of(aligned, by), found


def suite_rows(predictions: DataFrame, cohorts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cohort, seed, pair rows with both scores; violations).

    ``predictions(seed, pair_id, label, evidence_class, bootstrap_group,
    score_candidate, score_baseline)`` restricted to each cohort's members.
    """
    attrs = ("label", "evidence_class", "bootstrap_group")
    members = cohorts.select("cohort", "pair_id", *attrs)
    seeds = predictions.groupBy("pair_id").agg(F.count_distinct("seed").alias("_seeds"))
    joined = members.join(
        predictions.select(
            "seed", "pair_id", *[F.col(a).alias(f"_p_{a}") for a in attrs], "score_candidate", "score_baseline"
        ),
        "pair_id",
    )
    agrees = F.lit(True)
    for a in attrs:
        agrees = agrees & F.col(a).eqNullSafe(F.col(f"_p_{a}"))
    rows = joined.where(agrees).select("cohort", "seed", "pair_id", *attrs, "score_candidate", "score_baseline")
    mismatch = joined.where(~agrees).select(
        F.concat_ws("|", "cohort", F.col("seed").cast("string"), "pair_id").alias("key"),
        F.lit("cohort_attribute_mismatch").alias("rule_id"),
        F.lit("error").alias("severity"),
        F.lit("").alias("message"),
    )
    wanted = predictions.agg(F.count_distinct("seed")).scalar()
    missing = (
        members.join(seeds, "pair_id", "left")
        .where(F.coalesce("_seeds", F.lit(0)) < wanted)
        .select(
            F.concat_ws("|", "cohort", "pair_id").alias("key"),
            F.lit("missing_prediction").alias("rule_id"),
            F.lit("error").alias("severity"),
            F.lit("").alias("message"),
        )
    )
    return rows, union_all([mismatch, missing])


def coverage_plan(
    predictions: DataFrame, cohorts: DataFrame, rows: DataFrame, seeds: Sequence[int], names: Sequence[str] | None
) -> DataFrame:
    """(cohort, seed, issue): the grid of mandatory cohorts and registered seeds; issue is
    null where the slice holds every member once.

    ``names`` defaults to the cohorts there are. Only counts per slice meet the grid.
    """
    n_seeds = F.explode(F.array(*map(F.lit, seeds))).alias("seed")
    if names is None:
        listed = cohorts.select("cohort").distinct()
    else:
        listed = cohorts.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("cohort"))
    size = cohorts.groupBy("cohort").agg(F.count_distinct("pair_id").alias("_members"))
    got = rows.groupBy("cohort", "seed").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("pair_id").alias("_pairs"))
    grid = listed.select("cohort", n_seeds).join(size, "cohort", "left").join(got, ["cohort", "seed"], "left")
    issue = (
        F.when(F.col("_members").isNull(), F.lit("missing_cohort"))
        .when(F.col("_pairs").isNull(), F.lit("missing_seed"))
        .when(F.col("_pairs") < F.col("_members"), F.lit("incomplete_slice"))
        .when(F.col("_rows") > F.col("_pairs"), F.lit("repeated_pairs"))
    )
    return grid.select("cohort", "seed", issue.alias("issue"))


def plan_violations(plan: DataFrame, predictions: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """Gaps of the grid, one row per cohort where the whole cohort is missing; seeds that
    are not registered; and (seed, pair) rows that repeat."""

    def told(frame: DataFrame, key: Column, rule: Column) -> DataFrame:
        return frame.select(
            key.alias("key"), rule.alias("rule_id"), F.lit("error").alias("severity"), F.lit("").alias("message")
        )

    gap = plan.where(F.col("issue").isNotNull())
    whole = F.col("issue") == "missing_cohort"
    key = F.when(whole, F.col("cohort")).otherwise(F.concat_ws("|", "cohort", F.col("seed").cast("string")))
    other = predictions.where(~F.col("seed").isin(*seeds)).select("seed").distinct()
    return union_all(
        [
            told(gap, key, F.col("issue")).distinct(),
            told(other, F.col("seed").cast("string"), F.lit("unregistered_seed")),
            duplicate_keys(predictions, ["seed", "pair_id"], "duplicate_prediction"),
        ]
    )


def comparison_suite(
    predictions: DataFrame,
    cohorts: DataFrame,
    replicates: int = REPLICATES,
    seed: int = BOOTSTRAP_SEED,
    seeds: Sequence[int] = REGISTERED_SEEDS,
    names: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(one row per cohort and registered seed, violations): both average precisions,
    deltas and the paired bootstrap interval. All slices share each job.

    The grid of ``seeds`` and mandatory cohorts is checked first: a slice with a gap or
    with repeated pairs is a violation and gets no row, so no interval is computed for it.
    """
    rows, found = suite_rows(predictions, cohorts)
    rows = stage(rows, "suite-rows")
    plan = stage(coverage_plan(predictions, cohorts, rows, seeds, names), "suite-plan")
    by = ["cohort", "seed"]
    complete = rows.join(plan.where(F.col("issue").isNull()).select(*by), by, "left_semi")
    deltas = deltas_of(complete, by)
    bounds = bootstrap_delta(complete, by, replicates, seed)
    return deltas.join(bounds, by), union_all([found, plan_violations(plan, predictions, seeds)])


def support(
    suite: DataFrame,
    by: Sequence[str] = ("cohort",),
    seeds: Sequence[int] = REGISTERED_SEEDS,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Conservative support: every registered seed has a row, and mean delta, every
    seed's delta and every lower bound are above zero; a missing seed or bound counts
    against. A mandatory cohort in ``names`` without any row is a row that is not
    supported."""
    up = F.coalesce(F.col("absolute_delta") > 0, F.lit(False))
    firm = F.coalesce(F.col("lower_95") > 0, F.lit(False))
    rows = suite.where(F.col("seed").isin(*seeds)).groupBy(*by).agg(
        F.count_distinct("seed").alias("n_seeds"),
        F.avg("absolute_delta").alias("mean_delta"),
        F.bool_and(up).alias("all_deltas_positive"),
        F.bool_and(firm).alias("all_bounds_positive"),
    )
    if names is not None:
        listed = suite.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias(by[0]))
        rows = listed.join(rows, list(by), "left").fillna(0, ["n_seeds"]).fillna(False, ["all_deltas_positive", "all_bounds_positive"])
    mean_up = F.coalesce(F.col("mean_delta") > 0, F.lit(False))
    missing = F.lit(len(set(seeds))) - F.col("n_seeds")
    return rows.select(
        "*",
        mean_up.alias("mean_positive"),
        missing.alias("missing_seeds"),
        (mean_up & F.col("all_deltas_positive") & F.col("all_bounds_positive") & (missing == 0)).alias("claim_supported"),
    )


def paired_deltas(df: DataFrame, fields: Sequence[str], threshold_field: str, threshold: float = ACCEPTABLE_SCORE) -> DataFrame:
    """(measure, baseline, candidate, delta): means of each paired measure, and
    the share of rows reaching the threshold."""
    cells = [
        F.struct(
            F.lit(f).alias("measure"),
            F.col(f"baseline_{f}").cast("double").alias("b"),
            F.col(f"candidate_{f}").cast("double").alias("c"),
        )
        for f in fields
    ]
    reach = lambda side: (F.col(f"{side}_{threshold_field}") >= threshold).cast("double")
    cells.append(
        F.struct(
            F.lit(f"{threshold_field}_acceptable").alias("measure"),
            reach("baseline").alias("b"),
            reach("candidate").alias("c"),
        )
    )
    long = df.select(F.explode(F.array(*cells)).alias("m")).select("m.*")
    return long.groupBy("measure").agg(
        F.avg("b").alias("baseline_mean"),
        F.avg("c").alias("candidate_mean"),
        F.avg(F.col("c") - F.col("b")).alias("delta_mean"),
    )


def new_failures(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(flag, n): rows where the candidate fails and the baseline did not."""
    row = df.agg(
        *[F.count_if(F.col(f"candidate_{f}") & ~F.col(f"baseline_{f}")).alias(f) for f in flags]
    )
    cells = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in flags])
    return row.select(F.explode(cells).alias("c")).select("c.flag", "c.n")


def noninferiority(
    df: DataFrame,
    field: str,
    flags: Sequence[str],
    replicates: int = REPLICATES,
    seed: int = BOOTSTRAP_SEED,
    margins: Mapping[str, float] | None = None,
    threshold: float = ACCEPTABLE_SCORE,
    group: str = "bootstrap_group",
) -> DataFrame:
    """(check, value, bound, passed) of the gate; it passes when all do.

    Point and lower bound of the mean delta and of the acceptable-share delta
    must reach their margins, and no new failure may appear.
    """
    limits = {"point": POINT_MARGIN, "fraction": FRACTION_MARGIN, **(margins or {})}
    delta = F.col(f"candidate_{field}") - F.col(f"baseline_{field}")
    share = (F.col(f"candidate_{field}") >= threshold).cast("double") - (
        F.col(f"baseline_{field}") >= threshold
    ).cast("double")
    points = df.agg(F.avg(delta).alias("d"), F.avg(share).alias("s"))
    failures = new_failures(df, flags).agg(F.sum("n").cast("double").alias("value"))

    def check(frame: DataFrame, value: Column, name: str, bound: float) -> DataFrame:
        return frame.select(F.lit(name).alias("check"), value.cast("double").alias("value"), F.lit(bound).alias("bound"))

    bounds = bootstrap_means(df, [], {"delta": delta, "share": share}, replicates, seed, group)
    rows = union_all(
        [
            check(points, F.col("d"), "point_delta", limits["point"]),
            check(
                bounds.where(F.col("measure") == "delta"), F.col("lower_95"), "lower_95_delta", limits["point"]
            ),
            check(points, F.col("s"), "acceptable_share_delta", limits["fraction"]),
            check(
                bounds.where(F.col("measure") == "share"),
                F.col("lower_95"),
                "lower_95_acceptable_share",
                limits["fraction"],
            ),
            check(failures, -F.col("value"), "no_new_failures", 0.0),
        ]
    )
    return rows.withColumn("passed", F.coalesce(F.col("value") >= F.col("bound"), F.lit(False)))


def gate_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and("passed").alias("passed"))


def seed_metrics(predictions: DataFrame, by: Sequence[str] = ("seed",)) -> DataFrame:
    """Full metric rows per seed, the input of ``seed_summary``."""
    return metrics(predictions, list(by))
