"""From evidence rows to labelled pairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.keys import canonical_pair, stable_id
from pairloom.operators.rules import duplicate_keys, missing_keys

AMBIGUOUS_RECORD = "source_record_maps_to_multiple_normalized_pairs"
RECORD_KEY = ("source_database", "source_version", "source_record_id")


def union_sources(
    sources: Sequence[tuple[DataFrame, Mapping[str, Column | str]]], columns: Sequence[str]
) -> DataFrame:
    """Bring sources to one observation schema and union them.

    Each source comes with a map from output column to an expression over the
    source or a constant text; a column without entry is taken by name.
    """
    frames = []
    for df, mapping in sources:
        picked = []
        for name in columns:
            value = mapping.get(name, F.col(name) if name in df.columns else "")
            picked.append((value if isinstance(value, Column) else F.lit(value)).alias(name))
        frames.append(df.select(*picked))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def canonicalise(df: DataFrame, a: str, b: str, prefix: str) -> DataFrame:
    """Add pair_id, node_a, node_b."""
    pair = canonical_pair(F.col(a), F.col(b), prefix)
    return df.withColumn("_p", pair).select(*df.columns, "_p.pair_id", "_p.node_a", "_p.node_b")


def with_evidence_id(df: DataFrame, prefix: str = "EVI") -> DataFrame:
    parts = [*RECORD_KEY, "pair_id", "polarity", "detection_method"]
    return df.withColumn("evidence_id", stable_id(prefix, *[F.col(p) for p in parts]))


def differ(*columns: str) -> Column:
    """Aggregate: whether rows differ in these columns; rows with a null in the first of
    them do not count, other nulls are values. It compares least and greatest of two 64-bit
    hashes, since numbers are aggregated by hash, and the least of texts only by sorting
    all rows."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]

    def apart(*salt: Column) -> Column:
        value = F.when(F.col(columns[0]).isNotNull(), F.xxhash64(*salt, *parts))
        return F.coalesce(F.min(value) != F.max(value), F.lit(False))

    return apart() | apart(F.lit("differ"))


def split_ambiguous(
    observations: DataFrame, record: Sequence[str] = RECORD_KEY, pair: str = "pair_id"
) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): a record naming two different pairs loses all its
    observations. Whether values differ combines map-side."""
    record = list(record)
    ambiguous = observations.groupBy(*record).agg(differ(pair).alias("_differ")).where("_differ").select(*record)
    reason = F.lit(AMBIGUOUS_RECORD)
    kept = observations.join(ambiguous, record, "left_anti")
    rejected = observations.join(ambiguous, record, "left_semi").withColumn("quarantine_reason", reason)
    return kept, rejected


def label_pairs(
    observations: DataFrame,
    polarity: str = "polarity",
    negative_class: str = "negative_class",
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per pair with label, class, status and exclusion reason, from
    one aggregation; ``extra`` adds aliased aggregates to it."""
    positive = F.col(polarity) == "positive"
    negative = F.col(polarity) == "negative"
    flags = observations.groupBy("pair_id", "node_a", "node_b").agg(
        F.bool_or(positive).alias("_pos"),
        F.bool_or(negative).alias("_neg"),
        F.bool_or(~positive & ~negative).alias("_other"),
        F.bool_or(negative & (F.col(negative_class) == "curated_negative")).alias("_curated"),
        F.count(F.lit(1)).alias("n_evidence"),
        *extra,
    )
    only_pos = F.col("_pos") & ~F.col("_neg") & ~F.col("_other")
    only_neg = F.col("_neg") & ~F.col("_pos") & ~F.col("_other")
    labelled = only_pos | only_neg
    self_pair = F.col("node_a") == F.col("node_b")
    return flags.select(
        "pair_id",
        "node_a",
        "node_b",
        F.when(only_pos, 1).when(only_neg, 0).alias("label"),
        F.when(only_pos, F.lit("direct_positive"))
        .when(only_neg & F.col("_curated"), F.lit("curated_negative"))
        .when(only_neg, F.lit("screen_negative"))
        .otherwise(F.lit("unlabeled"))
        .alias("evidence_class"),
        F.when(labelled & ~self_pair, F.lit("eligible")).otherwise(F.lit("quarantine")).alias("pair_status"),
        F.when(self_pair, F.lit("self_pair_outside_primary_heterotypic_scope"))
        .when(labelled, F.lit(""))
        .otherwise(F.lit("positive_negative_contradiction"))
        .alias("exclusion_reason"),
        *flags.columns[flags.columns.index("n_evidence"):],
    )


def dedupe_evidence(df: DataFrame, key: str = "evidence_id") -> tuple[DataFrame, DataFrame]:
    """(distinct evidence, collisions): one id with two payloads collides."""
    distinct = df.distinct()
    return distinct, duplicate_keys(distinct, [key], "evidence_id_collision")


def used_entities(pairs: DataFrame, entities: DataFrame, key: str = "entity_id") -> tuple[DataFrame, DataFrame]:
    """(entities used by some pair, endpoints without an entity row)."""
    ends = pairs.select(F.explode(F.array("node_a", "node_b")).alias(key)).distinct()
    used = entities.join(ends, key, "left_semi")
    return used, missing_keys(ends, entities, key, key, "endpoint_without_entity")
