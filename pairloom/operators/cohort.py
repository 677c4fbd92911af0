"""Deterministic evaluation cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.keys import selection_key
from pairloom.operators.ordered import hash_ranked
from pairloom.operators.rules import Rule, duplicate_keys, missing_keys, union_all, violations
from pairloom.runtime import stage

# Cohort names, which negative class each balanced cohort takes
# (None takes all), and the negative classes that may occur.
FULL_COHORT = "full_evidence_pool"
BALANCED_COHORTS = {
    "balanced_explicit_1to1": None,
    "balanced_curated_1to1": "curated_negative",
    "balanced_screen_1to1": "screen_negative",
}
NEGATIVE_CLASSES = ("curated_negative", "screen_negative", "compartment_negative")
EVALUATION_PARTITIONS = ("validation", "test")


def expected_pairs(
    pairs: DataFrame, splits: DataFrame, scheme: str = "c3_primary", fold: str = "0"
) -> tuple[DataFrame, DataFrame]:
    """(pair_id, partition, pair columns...; violations) of one split."""
    chosen = splits.where((F.col("split_scheme") == scheme) & (F.col("fold") == fold)).select(
        "pair_id", "partition"
    )
    known = pairs.withColumn("_known", F.lit(True))
    both = chosen.join(known, "pair_id", "left")
    present = F.col("_known").isNotNull()
    usable = (F.col("pair_status") == "eligible") & F.col("label").isin(0, 1)
    rules = [
        Rule("invalid_partition", ~F.coalesce(F.col("partition").isin("train", "validation", "test"), F.lit(False))),
        Rule("unknown_pair", ~present),
        Rule("pair_not_eligible", present & ~F.coalesce(usable, F.lit(False))),
    ]
    found = union_all(
        [violations(both, ["pair_id"], rules), duplicate_keys(chosen, ["pair_id"], "duplicate_assignment")]
    )
    return both.where(present).drop("_known"), found


def build_cohorts(expected: DataFrame, seed: int = 20260915) -> tuple[DataFrame, DataFrame]:
    """(membership, violations) from split pairs with label, evidence_class
    and complex_group_id.

    A balanced cohort has all negatives of its stratum and as many positives,
    those with the smallest seeded hash in that cohort and partition.
    """
    rows = expected.where(F.col("partition").isin(*EVALUATION_PARTITIONS)).select(
        "partition",
        "pair_id",
        "label",
        "evidence_class",
        F.when(F.col("complex_group_id") == "", F.col("pair_id"))
        .otherwise(F.col("complex_group_id"))
        .alias("bootstrap_group"),
    )
    # Read by every cohort below, so derived once.
    base = stage(rows, "cohort-base")
    names = [F.struct(F.lit(n).alias("cohort"), F.lit(c).cast("string").alias("stratum")) for n, c in BALANCED_COHORTS.items()]
    spread = base.select("*", F.explode(F.array(*names)).alias("c")).select("c.cohort", "c.stratum", *base.columns)
    in_stratum = F.col("stratum").isNull() | (F.col("evidence_class") == F.col("stratum"))
    negatives = spread.where((F.col("label") == 0) & in_stratum)
    positives = spread.where(F.col("label") == 1)
    by = ["cohort", "partition"]
    # At most three cohorts times two partitions.
    needed = negatives.groupBy(*by).agg(F.count(F.lit(1)).alias("n_negatives"))
    keyed = positives.withColumn("_key", selection_key(seed, F.col("cohort"), F.col("pair_id")))
    chosen = hash_ranked(keyed, by, "_key", "pair_id", needed, "n_negatives").drop("_key")

    def member_rows(df: DataFrame, reason: str, rank) -> DataFrame:
        return df.select(
            *by,
            "pair_id",
            "label",
            "evidence_class",
            "bootstrap_group",
            F.lit(reason).alias("selection_reason"),
            rank.cast("bigint").alias("positive_selection_rank"),
        )

    none = F.lit(None)
    membership = union_all(
        [
            member_rows(base.withColumn("cohort", F.lit(FULL_COHORT)), "all_c3_explicit_labeled_pairs", none),
            member_rows(negatives, "all_explicit_negatives", none),
            member_rows(chosen, "deterministic_positive_sample", F.col("hash_rank")),
        ]
    )
    sizes = spread.groupBy(*by).agg(
        F.count_if((F.col("label") == 0) & in_stratum).alias("_neg"),
        F.count_if(F.col("label") == 1).alias("_pos"),
    )
    found = union_all(
        [
            violations(
                sizes,
                by,
                [
                    Rule("no_negatives", F.col("_neg") == 0),
                    Rule("too_few_positives", F.col("_pos") < F.col("_neg")),
                ],
            ),
            violations(
                base,
                ["pair_id"],
                [
                    Rule(
                        "unsupported_negative_class",
                        (F.col("label") == 0) & ~F.col("evidence_class").isin(*NEGATIVE_CLASSES),
                    )
                ],
            ),
        ]
    )
    return membership, found


def cohort_counts(membership: DataFrame) -> DataFrame:
    return membership.groupBy("partition", "cohort").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("label").cast("bigint")).alias("positives"),
        F.sum((1 - F.col("label")).cast("bigint")).alias("negatives"),
        F.avg("label").alias("prevalence"),
    )


def unknown_split_pairs(splits: DataFrame, pairs: DataFrame) -> DataFrame:
    return missing_keys(splits, pairs, "pair_id", "pair_id", "unknown_pair")
