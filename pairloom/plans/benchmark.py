"""End-to-end jobs: evidence to pairs, and pairs to a frozen benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.classify import eligible
from pairloom.operators.cohort import build_cohorts, expected_pairs
from pairloom.operators.coverage import apply_clusters, unchanged_except
from pairloom.operators.graph import attach_groups, complex_groups
from pairloom.operators.pairs import (
    AMBIGUOUS_RECORD,
    canonicalise,
    dedupe_evidence,
    label_pairs,
    split_ambiguous,
    used_entities,
    with_evidence_id,
)
from pairloom.operators.resolve import UNRESOLVED_ENDPOINT, resolve_endpoints, split_unresolved
from pairloom.operators.rules import require_ok, union_all
from pairloom.operators.split import make_split, select_split, split_input_violations
from pairloom.operators.validate import validate_dataset
from pairloom.runtime import stage
from pairloom.sources import release
from pairloom.sources.manifest import verify_manifest

EVIDENCE_COLUMNS = [
    "evidence_id", "pair_id", "source_database", "source_version", "source_record_id",
    "interaction_type", "detection_method", "polarity", "negative_definition",
]


def build_benchmark(
    observations: DataFrame, resolution: DataFrame, entities: DataFrame, prefix: str, group_prefix: str = "PDB"
) -> dict[str, DataFrame]:
    """Normalised pairs, evidence, used entities, every quarantined row and colliding ids.

    ``observations`` has raw_a, raw_b, namespace, evidence_role, polarity,
    negative_class, group_id and the evidence columns; ``resolution`` maps the
    raw identifiers to entities. A record may give one evidence id several payloads: all
    stay in the evidence, ``collisions`` names the ids, and ``freeze`` refuses them.
    """
    usable, unresolved = split_unresolved(resolve_endpoints(observations, resolution))
    named = stage(canonicalise(usable, "resolved_a", "resolved_b", prefix), "observations")
    kept, ambiguous = split_ambiguous(named)
    kept = stage(kept, "kept")
    groups = complex_groups(kept.select("pair_id", "group_id"), group_prefix)
    pairs = attach_groups(label_pairs(kept), groups)
    evidence, collisions = dedupe_evidence(with_evidence_id(kept).select(*EVIDENCE_COLUMNS))
    used, missing = used_entities(pairs, entities)
    require_ok(missing)
    accepted = F.lit("accepted")
    quarantine = unresolved.unionByName(
        ambiguous.select(
            *[c for c in unresolved.columns if c not in ("status_a", "status_b", "reason", "evidence_role")],
            F.when(F.col("polarity") == "positive", F.lit("positive_evidence"))
            .otherwise(F.lit("negative_evidence"))
            .alias("evidence_role"),
            accepted.alias("status_a"),
            accepted.alias("status_b"),
            F.col("quarantine_reason").alias("reason"),
        )
    )
    return {"pairs": pairs, "evidence": evidence, "entities": used, "quarantine": quarantine, "collisions": collisions}


def cluster_only_changes(
    originals: DataFrame, entities: DataFrame, membership: DataFrame | None, prefix: str
) -> DataFrame:
    """Violations if clustering changed anything but ``cluster_id``, or set it to anything
    but the membership."""

    def told(changes: DataFrame, rule: str) -> DataFrame:
        message = F.concat_ws(" ", "column", F.lit("was"), "before", F.lit("is"), "after")
        return changes.select("key", F.lit(rule).alias("rule_id"), F.lit("error").alias("severity"), message.alias("message"))

    found = [told(unchanged_except(originals, entities, ["entity_id"], ["cluster_id"]), "entity_changed")]
    if membership is not None:
        bare = originals.drop("cluster_id")
        clustered, issues = apply_clusters(bare, membership, prefix)
        keys = ["entity_id", "cluster_id"]
        found += [issues, told(unchanged_except(clustered.select(*keys), entities.select(*keys), ["entity_id"], []), "cluster_changed")]
    return union_all(found)


# Sort keys of the published tables.
OUTPUT_ORDER = {
    "splits": ["pair_id"],
    "quarantined": ["pair_id"],
    "assignments": ["entity_id"],
    "cohorts": ["cohort", "partition", "pair_id"],
}


def freeze(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    out: str,
    prefix: str,
    expected_manifest: DataFrame | None = None,
    first_seed: int = 0,
    last_seed: int = 999,
    cohort_seed: int = 20260915,
    originals: DataFrame | None = None,
    membership: DataFrame | None = None,
    cluster_prefix: str = "CLU",
    **entity_options,
) -> DataFrame:
    """Verify, split, validate and publish; returns the written manifest.

    ``tables`` holds pairs, evidence and entities. ``originals`` are the entities
    before they were clustered and ``membership`` the clusters (representative,
    member): the entities must be the originals with just these cluster ids.
    Outputs are derived and checked in the shared staging folder first; the release
    appears under ``out`` by one rename, after every check and every table. An
    existing output is an error; ``sources.release.recover`` cleans up after a
    job that died.
    """
    if release.exists(spark, out):
        raise FileExistsError(f"{out} already exists")
    if expected_manifest is not None:
        drift = verify_manifest(expected_manifest, tables).take(5)
        if drift:
            raise ValueError("input drift: " + "; ".join(f"{r['table']} {r['issue']}" for r in drift))
    pairs, evidence, entities = (tables[n] for n in ("pairs", "evidence", "entities"))
    if originals is not None:
        require_ok(cluster_only_changes(originals, entities, membership, cluster_prefix))
    labelled = stage(eligible(pairs), "eligible")
    require_ok(split_input_violations(labelled, entities))
    seed = select_split(labelled, entities, first_seed, last_seed)
    results = {n: stage(df, n) for n, df in make_split(labelled, entities, seed).items()}
    require_ok(validate_dataset(entities, pairs, evidence, results["splits"], prefix, **entity_options))
    expected, found = expected_pairs(labelled, results["splits"])
    require_ok(found)
    membership, found = build_cohorts(expected, cohort_seed)
    require_ok(found)
    results["cohorts"] = stage(membership, "cohorts")
    return release.publish(spark, {n: (results[n], order) for n, order in OUTPUT_ORDER.items()}, out, tables)


def build_summary(built: dict[str, DataFrame]) -> DataFrame:
    """(item, n): table sizes, pair classes and quarantine reasons, also those of no row."""

    def counted(df: DataFrame, prefix: str, col: str) -> DataFrame:
        return df.groupBy(F.concat(F.lit(prefix), F.col(col)).alias("item")).agg(F.count(F.lit(1)).alias("n"))

    def size(name: str) -> DataFrame:
        return built[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"rows_{name}").alias("item"), "n")

    reasons = F.array(*[F.lit(f"quarantine_{r}") for r in (UNRESOLVED_ENDPOINT, AMBIGUOUS_RECORD)])
    none = built["quarantine"].sparkSession.range(1).select(
        F.explode(reasons).alias("item"), F.lit(0).cast("bigint").alias("n")
    )
    quarantined = counted(built["quarantine"], "quarantine_", "reason").unionByName(none)
    return union_all(
        [size(n) for n in ("pairs", "evidence", "entities", "quarantine")]
        + [
            counted(built["pairs"], "class_", "evidence_class"),
            counted(built["pairs"], "status_", "pair_status"),
            quarantined.groupBy("item").agg(F.sum("n").alias("n")),
        ]
    )
