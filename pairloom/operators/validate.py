"""Table contracts, cross-table rules and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.arrays import AMBIGUOUS_LETTERS, STANDARD_ALPHABET
from pairloom.functions.text import strip
from pairloom.operators.pairs import differ
from pairloom.operators.rules import Rule, duplicate_keys, missing_keys, union_all, violations

# Contract vocabularies and id shapes.
LABEL_OF_CLASS = {
    "direct_positive": 1,
    "curated_negative": 0,
    "screen_negative": 0,
    "compartment_negative": 0,
    "unlabeled": None,
}
PAIR_STATUSES = ("eligible", "quarantine", "excluded")
POLARITIES = ("positive", "negative", "context_only")
PARTITION_NAMES = ("train", "validation", "test")
CLUSTERED_SCHEMES = ("c3_primary", "homology_primary")
TERM_SHAPE = r"^MI:\d{4}$"
DIRECT_TERM = "MI:0407"
ENTITY_SHAPE = r"^[A-Z0-9]{6,10}$"


def sequence_rules(
    sequence: str = "sequence",
    length: str = "sequence_length",
    digest: str = "sequence_sha256",
    alphabet: str = STANDARD_ALPHABET + AMBIGUOUS_LETTERS,
    ambiguous: str = AMBIGUOUS_LETTERS,
) -> list[Rule]:
    """Alphabet, declared length and declared digest of a sequence column."""
    text = F.upper(strip(F.coalesce(F.col(sequence), F.lit(""))))
    declared = F.coalesce(F.col(length).try_cast("bigint"), F.lit(-1))
    return [
        Rule("invalid_sequence", (text == "") | ~text.rlike(f"^[{alphabet}]*$")),
        Rule("sequence_length_mismatch", declared != F.length(text)),
        Rule(
            "sequence_digest_mismatch",
            F.lower(strip(F.coalesce(F.col(digest), F.lit("")))) != F.sha2(text, 256),
        ),
        Rule("ambiguous_letters", text.rlike(f"[{ambiguous}]"), severity="warning"),
    ]


def validate_entities(
    df: DataFrame,
    id_shape: str = ENTITY_SHAPE,
    taxon: str | None = "9606",
    rules: Sequence[Rule] | None = None,
) -> DataFrame:
    checks = [Rule("invalid_entity_id", ~F.coalesce(F.col("entity_id").rlike(id_shape), F.lit(False)))]
    if taxon is not None:
        checks.append(Rule("wrong_taxon", F.coalesce(strip(F.col("taxid")), F.lit("")) != taxon))
    checks += sequence_rules() if rules is None else list(rules)
    return union_all(
        [violations(df, ["entity_id"], checks), duplicate_keys(df, ["entity_id"], "duplicate_entity")]
    )


def validate_pairs(pairs: DataFrame, entities: DataFrame, prefix: str) -> DataFrame:
    expected = F.concat_ws("_", F.lit(prefix), "node_a", "node_b")
    known_class = F.coalesce(F.col("evidence_class").isin(*LABEL_OF_CLASS), F.lit(False))
    conflict: Column = F.lit(False)
    for name, label in LABEL_OF_CLASS.items():
        fits = F.col("label").isNull() if label is None else F.col("label").eqNullSafe(F.lit(label))
        conflict = conflict | ((F.col("evidence_class") == name) & ~fits)
    rules = [
        Rule("endpoints_not_ordered", F.col("node_a") > F.col("node_b")),
        Rule(
            "self_pair_not_quarantined",
            (F.col("node_a") == F.col("node_b")) & (F.col("pair_status") != "quarantine"),
        ),
        Rule("missing_pair_id", F.coalesce(strip(F.col("pair_id")), F.lit("")) == ""),
        Rule("unexpected_pair_id", ~F.col("pair_id").eqNullSafe(expected)),
        Rule("invalid_evidence_class", ~known_class),
        Rule("label_conflicts_with_class", known_class & conflict),
        Rule("invalid_pair_status", ~F.coalesce(F.col("pair_status").isin(*PAIR_STATUSES), F.lit(False))),
    ]
    ends = pairs.select(F.explode(F.array("node_a", "node_b")).alias("node"))
    return union_all(
        [
            violations(pairs, ["pair_id"], rules),
            duplicate_keys(pairs, ["pair_id"], "duplicate_pair"),
            missing_keys(ends, entities, "node", "entity_id", "unknown_entity"),
        ]
    )


def validate_evidence(
    evidence: DataFrame,
    pairs: DataFrame,
    record: Sequence[str] = ("source_database", "source_version", "source_record_id"),
    terms: Sequence[str] = ("interaction_type", "detection_method"),
) -> DataFrame:
    rules = [Rule("missing_evidence_id", F.coalesce(strip(F.col("evidence_id")), F.lit("")) == "")]
    rules.append(
        Rule("invalid_polarity", ~F.coalesce(F.col("polarity").isin(*POLARITIES), F.lit(False)))
    )
    for name in terms:
        value = strip(F.coalesce(F.col(name), F.lit("")))
        rules.append(Rule(f"invalid_{name}", (value != "") & ~value.rlike(TERM_SHAPE)))
    # Nulls of both are values: every row counts.
    rows = evidence.withColumn("_row", F.lit(True))
    torn = rows.groupBy(*record).agg(differ("_row", "pair_id", "polarity").alias("_differ")).where("_differ")
    return union_all(
        [
            violations(evidence, ["evidence_id"], rules),
            duplicate_keys(evidence, ["evidence_id"], "duplicate_evidence"),
            missing_keys(evidence, pairs, "pair_id", "pair_id", "evidence_for_unknown_pair"),
            violations(torn, list(record), [Rule("contradictory_source_record", F.lit(True))]),
        ]
    )


def validate_support(pairs: DataFrame, evidence: DataFrame, direct_term: str = DIRECT_TERM) -> DataFrame:
    """Every eligible or labelled pair needs matching evidence."""
    positive, negative = F.col("polarity") == "positive", F.col("polarity") == "negative"
    undefined = F.coalesce(strip(F.col("negative_definition")), F.lit("")) == ""
    held = evidence.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(positive).alias("_pos"),
        F.count_if(positive & (strip(F.col("interaction_type")) == direct_term)).alias("_direct"),
        F.count_if(negative).alias("_neg"),
        F.count_if(negative & undefined).alias("_undefined"),
    )
    both = pairs.select("pair_id", "pair_status", "evidence_class").join(held, "pair_id", "left").fillna(
        0, ["_n", "_pos", "_direct", "_neg", "_undefined"]
    )
    is_positive = F.col("evidence_class") == "direct_positive"
    is_negative = F.col("evidence_class").endswith("negative")
    return violations(
        both,
        ["pair_id"],
        [
            Rule("eligible_without_evidence", (F.col("pair_status") == "eligible") & (F.col("_n") == 0)),
            Rule("positive_without_support", is_positive & (F.col("_pos") == 0)),
            Rule(
                "positive_without_direct_type",
                is_positive & (F.col("_pos") > 0) & (F.col("_direct") == 0),
                severity="warning",
            ),
            Rule(
                "negative_without_definition",
                is_negative & ((F.col("_neg") == 0) | (F.col("_undefined") > 0)),
            ),
        ],
    )


def _crossing(df: DataFrame, value: str, rule_id: str) -> DataFrame:
    """Values seen in more than one partition of a (scheme, fold). A partition
    is one bit, so a value needs one small number however often it occurs."""
    names = sorted(PARTITION_NAMES)
    bit = F.coalesce(*[F.when(F.col("partition") == n, F.lit(1 << i)) for i, n in enumerate(names)])
    spread = (
        df.groupBy("split_scheme", "fold", value).agg(F.bit_or(bit).alias("_bits")).where(F.bit_count("_bits") > 1)
    )
    named = [F.when(F.col("_bits").bitwiseAND(F.lit(1 << i)) > 0, F.lit(n)) for i, n in enumerate(names)]
    return spread.select(
        F.concat_ws("|", "split_scheme", "fold", value).alias("key"),
        F.lit(rule_id).alias("rule_id"),
        F.lit("error").alias("severity"),
        F.concat_ws("/", *named).alias("message"),
    )


def leakage(
    splits: DataFrame,
    pairs: DataFrame,
    entities: DataFrame,
    entity_schemes: Sequence[str] = ("c3_primary",),
    cluster_schemes: Sequence[str] = CLUSTERED_SCHEMES,
) -> DataFrame:
    """Entities and clusters that occur in two evaluation partitions."""
    placed = splits.where(F.col("partition").isin(*PARTITION_NAMES))
    ends = placed.join(pairs.select("pair_id", "node_a", "node_b"), "pair_id").select(
        "split_scheme", "fold", "partition", F.explode(F.array("node_a", "node_b")).alias("entity_id")
    ).distinct()
    by_entity = _crossing(ends.where(F.col("split_scheme").isin(*entity_schemes)), "entity_id", "entity_leakage")
    clustered = ends.where(F.col("split_scheme").isin(*cluster_schemes)).join(
        entities.select("entity_id", "cluster_id").where(F.coalesce("cluster_id", F.lit("")) != ""), "entity_id"
    )
    return by_entity.unionByName(_crossing(clustered, "cluster_id", "cluster_leakage"))


def group_leakage(splits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups whose pairs lie in more than one partition."""
    grouped = pairs.where(F.coalesce("complex_group_id", F.lit("")) != "").select("pair_id", "complex_group_id")
    placed = splits.where(F.col("partition").isin(*PARTITION_NAMES))
    return _crossing(placed.join(grouped, "pair_id"), "complex_group_id", "group_leakage")


def validate_splits(splits: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    rules = [
        Rule("invalid_partition", ~F.coalesce(F.col("partition").isin(*PARTITION_NAMES), F.lit(False))),
        Rule(
            "test_pair_not_marked",
            (F.col("split_scheme") == "c3_primary")
            & (F.col("partition") == "test")
            & (F.coalesce(F.col("pm_class"), F.lit("")) != "C3"),
        ),
    ]
    key = ["split_scheme", "fold", "pair_id"]
    # Clusters are only required once some split is cluster based.
    needed = splits.agg(F.count_if(F.col("split_scheme").isin(*CLUSTERED_SCHEMES)) > 0).scalar()
    unclustered = entities.where(F.coalesce(strip(F.col("cluster_id")), F.lit("")) == "").where(needed)
    return union_all(
        [
            violations(splits, key, rules),
            duplicate_keys(splits, key, "duplicate_assignment"),
            missing_keys(splits, pairs, "pair_id", "pair_id", "split_of_unknown_pair"),
            violations(unclustered, ["entity_id"], [Rule("entity_without_cluster", F.lit(True))]),
            leakage(splits, pairs, entities),
            group_leakage(splits, pairs),
        ]
    )


def validate_dataset(
    entities: DataFrame, pairs: DataFrame, evidence: DataFrame, splits: DataFrame, prefix: str, **entity_options
) -> DataFrame:
    """All violations of the four tables, tagged with the ``area`` checked."""
    areas = {
        "entities": validate_entities(entities, **entity_options),
        "pairs": validate_pairs(pairs, entities, prefix),
        "evidence": validate_evidence(evidence, pairs),
        "support": validate_support(pairs, evidence),
        "splits": validate_splits(splits, pairs, entities),
    }
    return union_all([df.withColumn("area", F.lit(a)) for a, df in areas.items()])


def validation_report(tables: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """(item, value): row counts, errors, warnings and passed (1 or 0)."""
    counts = union_all(
        [
            df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"rows_{n}").alias("item"), "value")
            for n, df in tables.items()
        ]
    )
    totals = found.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    cells = F.array(
        F.struct(F.lit("errors").alias("item"), F.col("errors").alias("value")),
        F.struct(F.lit("warnings").alias("item"), F.col("warnings").alias("value")),
        F.struct(F.lit("passed").alias("item"), (F.col("errors") == 0).cast("bigint").alias("value")),
    )
    return counts.unionByName(totals.select(F.explode(cells).alias("c")).select("c.item", "c.value"))
