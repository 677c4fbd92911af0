"""Identifier inventory, mapping and conservative resolution.

Joins keep the large side on the left and a unique-key table on the right.
None is broadcast by hint: Spark broadcasts a side only when its size is known
to be small, and splits a hot key on the left side otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import isoform_parts, strip
from pairloom.operators.rules import duplicate_keys, missing_keys

RESOLUTION_KEY = ("source_database", "source_version", "evidence_role", "namespace", "raw_identifier")


def unique_dim(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(table, violations): the table is usable as a dimension if none."""
    return df, duplicate_keys(df, key, "duplicate_dimension_key")


def merge_dims(base: DataFrame, extra: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): rows equal in both tables merge; a key with two
    different payloads is a conflict."""
    merged = base.unionByName(extra).distinct()
    return merged, duplicate_keys(merged, key, "conflicting_payload")


def resolve_endpoints(
    df: DataFrame,
    resolution: DataFrame,
    key: Sequence[str] = RESOLUTION_KEY,
    raw: tuple[str, str] = ("raw_a", "raw_b"),
    namespaces: tuple[str, str] = ("namespace", "namespace"),
) -> DataFrame:
    """Add ``resolved_a/b`` and ``status_a/b``; ``status`` is ``accepted`` or
    the reason the identifier could not be used."""
    shared = [k for k in key if k not in ("namespace", "raw_identifier")]
    out = df
    for side, raw_col, ns_col in zip("ab", raw, namespaces):
        dim = resolution.select(
            *shared,
            F.col("namespace").alias("_ns"),
            F.col("raw_identifier").alias("_raw"),
            F.col("resolution_status").alias("_status"),
            F.col("resolution_reason").alias("_reason"),
            F.col("resolved_id").alias("_id"),
        )
        on = [out[c] == dim[c] for c in shared]
        on += [out[ns_col] == dim["_ns"], out[raw_col] == dim["_raw"]]
        accepted = F.col("_status") == "accepted"
        out = out.join(dim, on, "left").select(
            *[out[c] for c in out.columns],
            F.when(accepted, F.col("_id")).otherwise(F.lit("")).alias(f"resolved_{side}"),
            F.when(F.col("_status").isNull(), F.lit("identifier_not_in_resolution_table"))
            .when(accepted, F.lit("accepted"))
            .otherwise(F.col("_reason"))
            .alias(f"status_{side}"),
        )
    return out


UNRESOLVED_ENDPOINT = "unresolved_endpoint"


def split_unresolved(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined): both endpoints must have an accepted id."""
    usable = (F.col("resolved_a") != "") & (F.col("resolved_b") != "")
    role = F.when(F.col("polarity") == "positive", F.lit("positive_evidence")).otherwise(
        F.lit("negative_evidence")
    )
    rejected = df.where(~usable).select(
        "source_database",
        "source_version",
        role.alias("evidence_role"),
        "source_record_id",
        "raw_a",
        "raw_b",
        "status_a",
        "status_b",
        F.lit(UNRESOLVED_ENDPOINT).alias("reason"),
    )
    return df.where(usable), rejected


def identifier_inventory(
    df: DataFrame,
    endpoints: Sequence[str],
    attributes: Sequence[str],
    namespace: str,
    accession_namespace: str,
    other_namespaces: Sequence[str] = (),
) -> DataFrame:
    """Count every (attributes, namespace, identifier) over all endpoints.

    Accessions are checked for isoform suffixes; an identifier of a namespace
    outside the accepted ones goes to manual review without a query id.
    """
    long = df.select(
        *attributes,
        F.col(namespace).alias("namespace"),
        F.explode(F.array(*[F.col(c) for c in endpoints])).alias("raw_identifier"),
    )
    counted = long.groupBy(*attributes, "namespace", "raw_identifier").agg(
        F.count(F.lit(1)).alias("occurrence_count")
    )
    parts = isoform_parts(F.col("raw_identifier"))
    is_accession = F.col("namespace") == accession_namespace
    accepted = is_accession | F.col("namespace").isin(list(other_namespaces) or [""])
    return counted.select(
        *attributes,
        "namespace",
        "raw_identifier",
        F.when(is_accession, parts["base_id"])
        .when(accepted, F.col("raw_identifier"))
        .otherwise(F.lit(""))
        .alias("mapping_query_id"),
        (is_accession & parts["isoform_specific"]).alias("isoform_specific"),
        F.when(is_accession, parts["status"])
        .when(accepted, F.lit("mapping_candidate"))
        .otherwise(F.lit("manual_review_non_uniprot_primary"))
        .alias("mapping_status"),
        "occurrence_count",
    )


def request_ids(inventory: DataFrame) -> DataFrame:
    """Distinct (namespace, mapping_query_id) to ask a mapping service for."""
    return (
        inventory.where(F.col("mapping_status") == "mapping_candidate")
        .select("namespace", "mapping_query_id")
        .distinct()
    )


def mapping_profile(mapping: DataFrame, requested: DataFrame) -> DataFrame:
    """(metric, value) rows describing how ``source`` ids map to ``target``."""
    per_source = mapping.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("target").alias("degree")
    )
    asked = requested.select("source").distinct().join(per_source, "source", "left")
    names = ("requested_ids", "mapping_rows", "mapped_ids", "unmapped_ids", "one_to_one_ids", "one_to_many_ids")
    summary = asked.agg(
        F.count(F.lit(1)).alias(names[0]),
        F.coalesce(F.sum("rows"), F.lit(0)).alias(names[1]),
        F.count("degree").alias(names[2]),
        F.count_if(F.col("degree").isNull()).alias(names[3]),
        F.count_if(F.col("degree") == 1).alias(names[4]),
        F.count_if(F.col("degree") > 1).alias(names[5]),
    )
    long = summary.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")
    ).select("m.metric", "m.value")
    targets = mapping.agg(F.count_distinct("target").alias("value")).select(
        F.lit("unique_target_ids").alias("metric"), "value"
    )
    return long.unionByName(targets)


def unrequested_sources(mapping: DataFrame, requested: DataFrame) -> DataFrame:
    return missing_keys(mapping, requested, "source", "source", "unrequested_source")


def resolve_mapping(
    inventory: DataFrame,
    mapping: DataFrame,
    reviewed: DataFrame,
    current: DataFrame | None = None,
) -> DataFrame:
    """Decide every inventory row: status, reason, resolved id and counts.

    ``mapping(source, target)``; ``reviewed(target)`` lists reviewed in-taxon
    records; ``current(target, in_taxon)`` are extra records, and without them
    an id with no reviewed target is deferred. Only counts and minima travel
    per id, never target lists.
    """
    pairs = mapping.select("source", "target").distinct()
    pairs = pairs.join(
        reviewed.select("target").distinct().withColumn("_reviewed", F.lit(True)), "target", "left"
    )
    if current is None:
        pairs = pairs.withColumn("in_taxon", F.lit(None).cast("boolean"))
    else:
        pairs = pairs.join(current.select("target", "in_taxon"), "target", "left")
    is_reviewed = F.col("_reviewed").isNotNull()
    human = F.coalesce(F.col("in_taxon"), F.lit(False))
    per_source = pairs.groupBy(F.col("source").alias("mapping_query_id")).agg(
        F.count(F.lit(1)).alias("n_targets"),
        F.count_if(is_reviewed).alias("n_reviewed"),
        F.count("in_taxon").alias("n_known"),
        F.count_if(human).alias("n_in_taxon"),
        F.min(F.when(is_reviewed, F.col("target"))).alias("_reviewed_target"),
        F.min(F.when(human, F.col("target"))).alias("_human_target"),
    )
    joined = inventory.join(per_source, "mapping_query_id", "left")
    n, reviewed_n = F.coalesce("n_targets", F.lit(0)), F.coalesce("n_reviewed", F.lit(0))
    known, human_n = F.coalesce("n_known", F.lit(0)), F.coalesce("n_in_taxon", F.lit(0))
    status = F.col("mapping_status")

    def verdict(state: str, reason: str, resolved: Column | None = None) -> Column:
        return F.struct(
            F.lit(state).alias("resolution_status"),
            F.lit(reason).alias("resolution_reason"),
            (F.lit("") if resolved is None else resolved).alias("resolved_id"),
        )

    chain = (
        F.when(
            status == "quarantine_isoform_specific",
            verdict("quarantine", "isoform_specific_source_not_folded_to_canonical"),
        )
        .when(
            status == "manual_review_non_uniprot_primary",
            verdict("manual_review", "non_uniprot_primary_identifier"),
        )
        .when(n == 0, verdict("quarantine", "unmapped_in_pinned_uniprot_release"))
        .when(
            reviewed_n == 1,
            verdict("accepted", "unique_reviewed_human_target", F.col("_reviewed_target")),
        )
        .when(reviewed_n > 1, verdict("quarantine", "multiple_reviewed_human_targets"))
    )
    if current is None:
        chain = chain.otherwise(
            verdict("deferred", "no_reviewed_human_target_requires_unreviewed_record_audit")
        )
    else:
        chain = (
            chain.when(
                (n == 1) & (human_n == 1),
                verdict("accepted", "unique_current_human_target_unreviewed", F.col("_human_target")),
            )
            .when(known < n, verdict("deferred", "target_record_missing_from_pinned_snapshot"))
            .when(human_n == 0, verdict("excluded", "no_human_target_in_pinned_release"))
            .otherwise(
                verdict(
                    "quarantine", "multiple_or_cross_species_targets_without_unique_human_mapping"
                )
            )
        )
    return joined.withColumn("_v", chain).select(
        *[joined[c] for c in inventory.columns],
        n.alias("n_targets"),
        reviewed_n.alias("n_reviewed"),
        "_v.resolution_status",
        "_v.resolution_reason",
        "_v.resolved_id",
    )


def resolution_targets(resolution: DataFrame, mapping: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Long form of the target lists: (mapping_query_id, target, is_reviewed)."""
    ids = resolution.select("mapping_query_id").where(F.col("mapping_query_id") != "").distinct()
    pairs = mapping.select(F.col("source").alias("mapping_query_id"), "target").distinct()
    flagged = reviewed.select("target").distinct().withColumn("is_reviewed", F.lit(True))
    return (
        pairs.join(ids, "mapping_query_id", "left_semi")
        .join(flagged, "target", "left")
        .select("mapping_query_id", "target", F.coalesce("is_reviewed", F.lit(False)).alias("is_reviewed"))
    )


def deferred_targets(resolution: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct targets of the deferred rows: the records still to obtain."""
    ids = (
        resolution.where(F.col("resolution_status") == "deferred")
        .select(F.col("mapping_query_id").alias("source"))
        .distinct()
    )
    return mapping.join(ids, "source", "left_semi").select("target").distinct()


def explode_targets(df: DataFrame, list_col: str) -> DataFrame:
    """Distinct targets from ``;``-joined list cells."""
    return (
        df.select(F.explode(F.split(list_col, ";")).alias("target"))
        .where(F.col("target") != "")
        .distinct()
    )


def missing_targets(targets: DataFrame, records: DataFrame) -> DataFrame:
    return targets.select("target").distinct().join(records.select("target"), "target", "left_anti")


def entity_table(resolution: DataFrame, reviewed: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Accepted ids with sequence, recomputed length and hash. A reviewed
    record wins over a current one; ``has_record`` is false if neither exists."""
    ids = (
        resolution.where(F.col("resolved_id") != "")
        .select(F.col("resolved_id").alias("entity_id"))
        .distinct()
    )
    out = ids.join(
        reviewed.select(F.col("target").alias("entity_id"), F.col("sequence").alias("_r")),
        "entity_id",
        "left",
    )
    if current is None:
        out = out.withColumn("_c", F.lit(None).cast("string"))
    else:
        out = out.join(
            current.select(F.col("target").alias("entity_id"), F.col("sequence").alias("_c")),
            "entity_id",
            "left",
        )
    sequence = F.upper(strip(F.coalesce("_r", "_c", F.lit(""))))
    return out.select(
        "entity_id",
        sequence.alias("sequence"),
        F.length(sequence).alias("sequence_length"),
        F.sha2(sequence, 256).alias("sequence_sha256"),
        F.col("_r").isNotNull().alias("is_reviewed"),
        F.coalesce("_r", "_c").isNotNull().alias("has_record"),
    )


def one_to_one_gate(
    df: DataFrame, mapping: DataFrame, ends: tuple[str, str] = ("raw_a", "raw_b")
) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): both endpoints must map to exactly one target."""
    degree = mapping.groupBy("source").agg(
        F.count_distinct("target").alias("_n"), F.min("target").alias("_t")
    )
    out = df
    for side, col in zip("ab", ends):
        dim = degree.select(
            F.col("source").alias(f"_s{side}"),
            F.col("_n").alias(f"_n{side}"),
            F.col("_t").alias(f"target_{side}"),
        )
        out = out.join(dim, out[col] == dim[f"_s{side}"], "left").drop(f"_s{side}")
        out = out.withColumn(f"mapping_count_{side}", F.coalesce(f"_n{side}", F.lit(0))).drop(f"_n{side}")
    both = (F.col("mapping_count_a") == 1) & (F.col("mapping_count_b") == 1)
    kept = out.where(both).drop("mapping_count_a", "mapping_count_b")
    rejected = (
        out.where(~both)
        .drop("target_a", "target_b")
        .withColumn("gate_reason", F.lit("mapping_not_one_to_one"))
    )
    return kept, rejected
