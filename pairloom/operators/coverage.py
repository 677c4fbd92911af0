"""Key coverage, alignment and overlap between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip
from pairloom.operators.rules import Rule, duplicate_keys, key_text, missing_keys, union_all, violations


def coverage(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key..., issue): keys missing from, unexpected in or repeated in
    ``observed``."""
    key = list(key)
    left = expected.groupBy(*key).agg(F.count(F.lit(1)).alias("_e"))
    right = observed.groupBy(*key).agg(F.count(F.lit(1)).alias("_o"))
    issues = F.array_compact(
        F.array(
            F.when(F.col("_o").isNull(), F.lit("missing")),
            F.when(F.col("_e").isNull(), F.lit("unexpected")),
            F.when(F.col("_o") > 1, F.lit("duplicate")),
        )
    )
    return left.join(right, key, "full_outer").select(*key, F.explode(issues).alias("issue"))


def align(
    candidate: DataFrame, baseline: DataFrame, key: Sequence[str], attrs: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(aligned, violations): both sides must hold the same keys with the same
    attributes. The aligned table has score_candidate and score_baseline."""
    key = list(key)
    left = candidate.select(*key, *[F.col(a).alias(f"_l_{a}") for a in attrs], F.col("score").alias("score_candidate"), F.lit(True).alias("_in_l"))
    right = baseline.select(*key, *[F.col(a).alias(f"_r_{a}") for a in attrs], F.col("score").alias("score_baseline"), F.lit(True).alias("_in_r"))
    both = left.join(right, key, "full_outer")
    present = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    rules = [
        Rule("missing_candidate", F.col("_in_l").isNull()),
        Rule("missing_baseline", F.col("_in_r").isNull()),
    ]
    rules += [
        Rule(f"{a}_mismatch", present & ~F.col(f"_l_{a}").eqNullSafe(F.col(f"_r_{a}"))) for a in attrs
    ]
    aligned = both.where(present).select(
        *key, *[F.col(f"_l_{a}").alias(a) for a in attrs], "score_candidate", "score_baseline"
    )
    return aligned, violations(both, key, rules)


def select_cohort(
    predictions: DataFrame,
    members: DataFrame,
    attrs: Sequence[str] = ("label", "evidence_class", "bootstrap_group"),
    key: str = "pair_id",
    carry: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """(selected, violations): one scored row per cohort member, attributes
    verified. ``carry`` names member columns (cohort, seed) to keep."""
    right = predictions.select(
        key, *[F.col(a).alias(f"_p_{a}") for a in attrs], "score", F.lit(True).alias("_scored")
    )
    both = members.select(key, *carry, *attrs).join(right, key, "left")
    scored = F.col("_scored").isNotNull()
    rules = [Rule("missing_prediction", ~scored)]
    rules += [
        Rule(f"{a}_mismatch", scored & ~F.col(a).eqNullSafe(F.col(f"_p_{a}"))) for a in attrs
    ]
    selected = both.where(scored).select(*carry, key, *attrs, "score")
    return selected, violations(both, [*carry, key], rules)


def apply_clusters(
    entities: DataFrame, membership: DataFrame, prefix: str, key: str = "entity_id"
) -> tuple[DataFrame, DataFrame]:
    """(entities with ``cluster_id``, violations): membership(representative,
    member) must hold every entity exactly once and no unknown id."""
    member = membership.select(F.col("member").alias(key), "representative")
    out = entities.join(member, key, "left").select(
        *entities.columns,
        F.when(
            F.col("representative").isNotNull(), F.concat(F.lit(f"{prefix}_"), "representative")
        ).alias("cluster_id"),
    )
    issues = coverage(entities.select(key), member.select(key), [key]).select(
        F.col(key).cast("string").alias("key"),
        F.concat(F.col("issue"), F.lit("_member")).alias("rule_id"),
        F.lit("error").alias("severity"),
        F.lit("").alias("message"),
    )
    unknown = missing_keys(membership, entities, "representative", key, "unknown_representative")
    return out, union_all([issues, unknown])


def unchanged_except(a: DataFrame, b: DataFrame, key: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """(key, column, before, after) for every difference outside ``allowed``.
    A row on one side only differs in ``(row)``."""
    key = list(key)
    fixed = [c for c in a.columns if c not in set(key) | set(allowed)]
    left = a.select(*key, F.struct(F.lit(1).alias("_here"), *fixed).alias("l"))
    right = b.select(*key, F.struct(F.lit(1).alias("_here"), *fixed).alias("r"))
    both = left.join(right, key, "full_outer")
    in_l, in_r = F.col("l").isNotNull(), F.col("r").isNotNull()

    def diff(name: str, when: Column, before: Column, after: Column) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(name).alias("column"),
                before.cast("string").alias("before"),
                after.cast("string").alias("after"),
            ),
        )

    cells = [
        diff(
            "(row)",
            ~(in_l & in_r),
            F.when(in_l, F.lit("present")).otherwise(F.lit("absent")),
            F.when(in_r, F.lit("present")).otherwise(F.lit("absent")),
        )
    ]
    for c in fixed:
        lc, rc = F.col("l")[c], F.col("r")[c]
        cells.append(diff(c, in_l & in_r & ~lc.eqNullSafe(rc), lc, rc))
    return both.select(key_text(key).alias("key"), F.explode(F.array_compact(F.array(*cells))).alias("d")).select(
        "key",
        "d.column",
        F.coalesce("d.before", F.lit("")).alias("before"),
        F.coalesce("d.after", F.lit("")).alias("after"),
    )


def eligible_hits(hits: DataFrame, min_identity: float, min_coverage: float) -> DataFrame:
    """Similarity hits passing the identity and the smaller-coverage bound."""
    return hits.where(
        (F.col("identity") >= min_identity) & (F.least("qcov", "tcov") >= min_coverage)
    )


def overlap_audit(
    members: DataFrame, hits: DataFrame, train: DataFrame, min_identity: float, min_coverage: float
) -> DataFrame:
    """Independence of each group from the training set.

    ``members(group_id, query, entity_id)``, ``hits(query, target, identity,
    qcov, tcov, bits)``, ``train(entity_id)``. The best hit per group is the
    first by (identity desc, bits desc, target); hits are reduced to one best
    row per query before they meet the members.
    """
    good = eligible_hits(hits, min_identity, min_coverage)
    rank = F.struct(
        (-F.col("identity")).alias("i"), (-F.col("bits")).alias("b"), F.col("target").alias("t")
    )
    per_query = good.groupBy("query").agg(F.count(F.lit(1)).alias("_hits"), F.min(rank).alias("_best"))
    known = train.select("entity_id").distinct().withColumn("_direct", F.lit(True))
    joined = members.join(known, "entity_id", "left").join(per_query, "query", "left")
    out = joined.groupBy("group_id").agg(
        F.bool_or(F.col("_direct").isNotNull()).alias("direct_overlap"),
        F.bool_or(F.col("_hits").isNotNull()).alias("homology_overlap"),
        F.sum(F.coalesce("_hits", F.lit(0))).alias("eligible_hits"),
        F.count(F.lit(1)).alias("n_members"),
        F.min("_best").alias("_best"),
    )
    return out.select(
        "group_id",
        "direct_overlap",
        "homology_overlap",
        (~F.col("direct_overlap") & ~F.col("homology_overlap")).alias("independence_passed"),
        "n_members",
        "eligible_hits",
        F.coalesce("_best.t", F.lit("")).alias("best_target"),
    )


def ranked_hits(hits: DataFrame, min_identity: float, min_coverage: float) -> DataFrame:
    """Eligible hits in report order, as rows rather than per-query lists."""
    good = eligible_hits(hits, min_identity, min_coverage)
    return good.orderBy("query", F.col("identity").desc(), F.col("bits").desc(), "target")


def overlap_violations(members: DataFrame, hits: DataFrame, train: DataFrame) -> DataFrame:
    """Hits must refer to audited queries and training targets."""
    return union_all(
        [
            missing_keys(hits, members, "query", "query", "hit_with_unknown_query"),
            missing_keys(hits, train, "target", "entity_id", "hit_with_non_training_target"),
        ]
    )


def apply_audit(set_df: DataFrame, audit: DataFrame, key: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """(set with audit flags, coverage violations)."""
    flags = audit.select(
        key,
        F.col("independence_passed").alias("homology_audit_passed"),
        F.col("direct_overlap").alias("train_overlap"),
    )
    kept = [c for c in set_df.columns if c not in ("homology_audit_passed", "train_overlap")]
    out = set_df.select(*kept).join(flags, key)
    issues = coverage(set_df.select(key), audit.select(key), [key]).select(
        F.col(key).cast("string").alias("key"),
        F.concat(F.col("issue"), F.lit("_audit_row")).alias("rule_id"),
        F.lit("error").alias("severity"),
        F.lit("").alias("message"),
    )
    return out, issues


CONFIRMATIONS = ("assembly_confirmed", "mapping_confirmed", "scope_confirmed")


def review_select(
    candidates: DataFrame, reviews: DataFrame, key: str, confirmations: Sequence[str] = CONFIRMATIONS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected candidates, violations, counts).

    ``reviews`` has the key, boolean ``include``, the confirmations,
    ``outputs_consulted`` and a ``reviewer_role``/``rationale``; a row may be
    included only when the candidate is ``auto_eligible``, every confirmation
    is true and no model output was consulted.
    """
    known = candidates.select(key, F.col("auto_eligible").alias("_auto"))
    both = reviews.join(known, key, "left")
    include = F.coalesce("include", F.lit(False))
    rules = [
        Rule("unknown_candidate", F.col("_auto").isNull()),
        Rule("missing_flag", F.col("include").isNull() | F.col("outputs_consulted").isNull()),
        Rule("missing_reviewer", F.coalesce(strip(F.col("reviewer_role")), F.lit("")) == ""),
        Rule("missing_rationale", F.coalesce(strip(F.col("rationale")), F.lit("")) == ""),
        Rule("included_but_ineligible", include & ~F.coalesce("_auto", F.lit(True))),
        Rule("selection_saw_outputs", include & F.coalesce("outputs_consulted", F.lit(False))),
    ]
    rules += [Rule(f"not_{c}", include & ~F.coalesce(c, F.lit(False))) for c in confirmations]
    found = union_all([violations(both, [key], rules), duplicate_keys(reviews, [key], "duplicate_review")])
    allowed = include & F.coalesce("_auto", F.lit(False)) & ~F.coalesce("outputs_consulted", F.lit(True))
    for c in confirmations:
        allowed = allowed & F.coalesce(c, F.lit(False))
    selected = candidates.join(both.where(allowed).select(key), key, "left_semi")
    counts = both.agg(
        F.count(F.lit(1)).alias("reviewed"),
        F.count_if(include).alias("included"),
        F.count_if(~include).alias("excluded"),
    )
    return selected, found, counts


def best_ranked(
    df: DataFrame, key: Sequence[str], rank: str, score: str, n: int
) -> tuple[DataFrame, DataFrame]:
    """(rank-0 rows, violations): ranks must be exactly 0..n-1 once each and
    rank 0 must hold the highest score. Counts stand in for rank lists."""
    key = list(key)
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct(rank).alias("_d"),
        F.min(rank).alias("_lo"),
        F.max(rank).alias("_hi"),
        F.max(score).alias("_best"),
        F.max(F.when(F.col(rank) == 0, F.col(score))).alias("_first"),
    )
    contiguous = (F.col("_n") == n) & (F.col("_d") == n) & (F.col("_lo") == 0) & (F.col("_hi") == n - 1)
    rules = [
        Rule("duplicate_rank", F.col("_d") < F.col("_n")),
        Rule("ranks_not_contiguous", ~contiguous),
        Rule("rank_zero_not_best", F.col("_first").isNull() | (F.col("_first") != F.col("_best"))),
    ]
    return df.where(F.col(rank) == 0), violations(per_key, key, rules)
