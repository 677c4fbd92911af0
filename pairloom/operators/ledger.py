"""Cost ledgers: per-item and per-run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import is_digest, strip
from pairloom.operators.ordered import quantiles, smallest_per_group
from pairloom.operators.rules import Rule, duplicate_keys, union_all, violations

# Registered run seeds, row statuses, ids listed in a report.
REGISTERED_SEEDS = (42, 123, 999)
STATUSES = ("success", "failure")
LISTED_IDS = 20


def distributions(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """(by, measure, n, mean, median, p95, maximum, total), zeros when empty.

    All measures share one pass: they are unpivoted to (by, measure, value).
    """
    by = list(by)
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    long = df.select(*by, F.explode(cells).alias("c")).select(*by, "c.measure", "c.value")
    keys = [*by, "measure"]
    sums = long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.max("value").alias("maximum"),
        F.sum("value").alias("total"),
    )
    picked = quantiles(long, keys, "value", {"median": 0.5, "p95": 0.95})
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return sums.join(picked, keys, "left").select(
        *keys, "n", zero("mean"), zero("median"), zero("p95"), zero("maximum"), zero("total")
    )


def distribution(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return distributions(df, by, [col]).drop("measure")


GROUP = ("method", "seed", "stage")


def ledger_items(ledger: DataFrame, expected: DataFrame, by: Sequence[str] = GROUP, key: str = "pair_id") -> DataFrame:
    """Item-level summary per (method, seed, stage).

    Items are reduced to one row per (group, id) with its flags before they
    meet the expected ids. The full coverage lists are in ``ledger_coverage``.
    """
    by = list(by)
    success = F.col("status") == "success"
    wall = F.col("wall_time_seconds")
    per_id = ledger.groupBy(*by, key).agg(
        F.bool_or(success).alias("_ok"),
        F.sum(wall * F.col("gpu_count")).alias("_gpu_seconds"),
        F.sum(F.when(success, wall).otherwise(0.0)).alias("_ok_wall"),
        F.sum("output_bytes").alias("_bytes"),
        F.min("input_residues").alias("_lo"),
        F.max("input_residues").alias("_hi"),
    )
    known = expected.select(key).distinct().withColumn("_expected", F.lit(True))
    flagged = per_id.join(known, key, "left")
    is_expected = F.col("_expected").isNotNull()
    summary = flagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted_items"),
        F.count_if("_ok").alias("successful_items"),
        F.count_if(~F.col("_ok")).alias("failed_items"),
        F.count_if(is_expected).alias("_hit"),
        F.count_if(is_expected & F.col("_ok")).alias("_ok_hit"),
        (F.sum("_gpu_seconds") / 3600).alias("total_gpu_hours"),
        F.sum("_ok_wall").alias("_ok_wall"),
        F.sum("_bytes").alias("total_output_bytes"),
        F.min("_lo").alias("residues_min"),
        F.max("_hi").alias("residues_max"),
    )
    joined = summary.withColumn("expected_items", known.agg(F.count(F.lit(1))).scalar())
    unexpected = F.col("attempted_items") - F.col("_hit")
    return joined.select(
        *by,
        "attempted_items",
        "successful_items",
        "failed_items",
        "expected_items",
        (F.col("expected_items") - F.col("_hit")).alias("missing_items"),
        unexpected.alias("unexpected_items"),
        ((F.col("expected_items") == F.col("_hit")) & (unexpected == 0)).alias("attempt_coverage_complete"),
        ((F.col("_ok_hit") == F.col("expected_items")) & (F.col("successful_items") == F.col("_ok_hit"))).alias(
            "successful_coverage_complete"
        ),
        "total_gpu_hours",
        "total_output_bytes",
        F.when(
            F.col("_ok_wall") > 0, F.col("successful_items") / (F.col("_ok_wall") / 3600)
        ).alias("successful_items_per_wall_hour"),
        "residues_min",
        "residues_max",
    )


def ledger_coverage(ledger: DataFrame, expected: DataFrame, by: Sequence[str] = GROUP, key: str = "pair_id") -> DataFrame:
    """(by, issue, key) rows: missing, failed and unexpected ids of each group."""
    by = list(by)
    per_id = ledger.groupBy(*by, key).agg(F.bool_or(F.col("status") == "success").alias("_ok"))
    ids = expected.select(key).distinct()
    # Per id, the groups that attempted it; what is left of all groups is
    # missing. Both lists hold registered (method, seed, stage) groups only.
    group = F.struct(*by)
    everyone = ledger.select(group.alias("g")).distinct().agg(F.collect_list("g")).scalar()
    attempted = per_id.groupBy(key).agg(F.collect_list(group).alias("_seen"))
    left = ids.join(attempted, key, "left").withColumn("_all", everyone)
    absent = F.when(F.col("_seen").isNull(), F.col("_all")).otherwise(F.array_except("_all", "_seen"))
    missing = left.select(key, F.explode(absent).alias("g")).select(
        "g.*", F.lit("missing").alias("issue"), key
    )
    failed = per_id.where(~F.col("_ok")).drop("_ok").withColumn("issue", F.lit("failed"))
    unexpected = per_id.drop("_ok").join(ids, key, "left_anti").withColumn("issue", F.lit("unexpected"))
    columns = [*by, "issue", key]
    return union_all([df.select(*columns) for df in (missing, failed, unexpected)])


def listed_ids(coverage: DataFrame, by: Sequence[str] = GROUP, key: str = "pair_id", k: int = LISTED_IDS) -> DataFrame:
    """The first k ids of each (group, issue) for a report."""
    top = smallest_per_group(coverage, [*by, "issue"], key, k)
    return top.select(*by, "issue", F.array_join("values", ";").alias("first_ids"))


def gpu_models(ledger: DataFrame, by: Sequence[str] = GROUP) -> DataFrame:
    """(by, gpu_model) distinct nonblank models."""
    return ledger.where(F.coalesce("gpu_model", F.lit("")) != "").select(*by, "gpu_model").distinct()


def set_coverage(df: DataFrame, by: Sequence[str], col: str, expected: Sequence) -> DataFrame:
    """(by, observed, complete): the distinct values equal the registered set.
    Blank values are ignored; counts decide, so no value list is collected."""
    wanted = list(dict.fromkeys(expected))
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(*by)
        .agg(
            F.count_distinct(col).alias("observed"),
            F.count_distinct(F.when(F.col(col).isin(wanted), F.col(col))).alias("_hit"),
        )
        .select(
            *by,
            "observed",
            ((F.col("observed") == len(wanted)) & (F.col("_hit") == len(wanted))).alias("complete"),
        )
    )


def ledger_runs(runs: DataFrame, seeds: Sequence[int] = REGISTERED_SEEDS, by: Sequence[str] = ("method", "stage")) -> DataFrame:
    """Run-level summary per (method, stage). Runs without a seed are allowed;
    if any has one, the seeds must equal the registered set."""
    by = list(by)
    wanted = list(seeds)
    seed = F.col("seed")
    success = F.col("status") == "success"
    out = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(success).alias("successful_runs"),
        F.count_if(F.col("status") == "failure").alias("failed_runs"),
        F.count_distinct(seed).alias("observed_seeds"),
        F.count_distinct(F.when(seed.isin(wanted), seed)).alias("_hit"),
        (F.sum(F.col("wall_time_seconds") * F.col("gpu_count")) / 3600).alias("total_gpu_hours"),
        F.sum("output_bytes").alias("total_output_bytes"),
    )
    exact = (F.col("observed_seeds") == len(wanted)) & (F.col("_hit") == len(wanted))
    return out.withColumn("seed_coverage_complete", (F.col("observed_seeds") == 0) | exact).drop("_hit")


def ledger_status(items: DataFrame, seeds: DataFrame, runs: DataFrame) -> DataFrame:
    """(check, passed) over all groups: coverage, execution, registered seeds."""

    def every(df: DataFrame, condition: Column, name: str) -> DataFrame:
        return df.agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("passed")).select(
            F.lit(name).alias("check"), "passed"
        )

    return union_all(
        [
            every(items, F.col("attempt_coverage_complete"), "attempt_coverage"),
            every(items, F.col("successful_coverage_complete"), "successful_coverage"),
            every(runs, F.col("failed_runs") == 0, "no_failed_runs"),
            every(seeds, F.col("complete"), "registered_item_seeds"),
            every(runs, F.col("seed_coverage_complete"), "registered_run_seeds"),
        ]
    )


def validate_ledger(df: DataFrame, kind: str) -> DataFrame:
    """Row rules of an ``item`` or ``run`` ledger with typed columns."""
    if kind not in ("item", "run"):
        raise ValueError("kind is item or run")
    key = ["method", "seed", "stage"] + (["pair_id"] if kind == "item" else [])
    digests = ["command_sha256", "stdout_sha256"] + (["input_sha256"] if kind == "item" else [])
    gpu = F.col("gpu_count") > 0

    def below(name: str, low: float) -> Rule:
        value = F.col(name).cast("double")
        ok = (value >= low) & (value < float("inf")) & ~F.isnan(value)
        return Rule(f"invalid_{name}", ~F.coalesce(ok, F.lit(False)))

    rules = [
        Rule(f"missing_{c}", F.coalesce(strip(F.col(c)), F.lit("")) == "")
        for c in key
        if c != "seed"
    ]
    rules += [
        Rule("invalid_status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        below("gpu_count", 0),
        Rule("gpu_row_without_model", gpu & (F.coalesce(strip(F.col("gpu_model")), F.lit("")) == "")),
        Rule("gpu_row_without_memory", gpu & ~F.coalesce(F.col("peak_gpu_memory_mib") > 0, F.lit(False))),
        Rule("negative_memory", F.col("peak_gpu_memory_mib") < 0),
        below("wall_time_seconds", 0.000001),
        below("output_bytes", 0),
    ]
    if kind == "item":
        rules += [
            Rule("missing_seed", F.coalesce(F.col("seed") < 0, F.lit(True))),
            below("preprocessing_seconds", 0),
            below("input_residues", 1),
        ]
    rules += [Rule(f"invalid_{d}", ~is_digest(F.col(d))) for d in digests]
    return union_all([violations(df, key, rules), duplicate_keys(df, key, "duplicate_ledger_row")])
