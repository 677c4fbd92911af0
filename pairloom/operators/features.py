"""Pair features, vector contracts and window pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip
from pairloom.functions.arrays import composition, symmetric_features
from pairloom.operators.coverage import coverage
from pairloom.operators.rules import Rule, duplicate_keys, union_all, violations


def pair_features(
    pairs: DataFrame, vectors: DataFrame, vector: str = "vector", length: str = "length", key: str = "entity_id"
) -> DataFrame:
    """Pairs with ``features`` built from both endpoint vectors."""
    out = pairs
    for side in "ab":
        dim = vectors.select(
            F.col(key).alias(f"node_{side}"),
            F.col(vector).alias(f"_v_{side}"),
            F.col(length).alias(f"_l_{side}"),
        )
        out = out.join(dim, f"node_{side}")
    features = symmetric_features(F.col("_v_a"), F.col("_v_b"), F.col("_l_a"), F.col("_l_b"))
    return out.select(*pairs.columns, features.alias("features"))


def composition_vectors(entities: DataFrame, sequence: str = "sequence", alphabet: str | None = None) -> DataFrame:
    """(entity_id, vector, length) from sequences."""
    args = (F.col(sequence),) if alphabet is None else (F.col(sequence), alphabet)
    return entities.select(
        "entity_id", composition(*args).alias("vector"), F.length(strip(F.col(sequence))).alias("length")
    )


def build_examples(
    expected: DataFrame, vectors: DataFrame, partitions: Sequence[str] = ("train", "validation", "test")
) -> tuple[DataFrame, DataFrame]:
    """(examples with features, violations): every pair once, both labels in
    every partition."""
    rows = expected.where(F.col("partition").isin(*partitions))
    examples = pair_features(rows.select("pair_id", "partition", "label", "node_a", "node_b"), vectors)
    labels = rows.groupBy("partition").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    lost = rows.select("pair_id").join(examples.select("pair_id"), "pair_id", "left_anti")
    found = union_all(
        [
            duplicate_keys(rows, ["pair_id"], "duplicate_assignment"),
            violations(labels, ["partition"], [Rule("single_label_partition", F.col("_lo") == F.col("_hi"))]),
            violations(lost, ["pair_id"], [Rule("endpoint_without_vector", F.lit(True))]),
        ]
    )
    return examples, found


def finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def validate_vectors(
    vectors: DataFrame, entities: DataFrame, dimension: int, key: str = "entity_id", digest: str | None = "sequence_sha256"
) -> DataFrame:
    """One finite vector of the right size per entity, made from the entity's
    current sequence."""
    rules = [
        Rule("wrong_dimension", F.size("vector") != dimension),
        Rule("not_finite", ~F.coalesce(finite(F.col("vector")), F.lit(False))),
    ]
    parts = [
        violations(vectors, [key], rules),
        coverage(entities.select(key), vectors.select(key), [key]).select(
            F.col(key).cast("string").alias("key"),
            F.concat(F.col("issue"), F.lit("_vector")).alias("rule_id"),
            F.lit("error").alias("severity"),
            F.lit("").alias("message"),
        ),
    ]
    if digest is not None:
        both = vectors.select(key, F.col(digest).alias("_v")).join(
            entities.select(key, F.col(digest).alias("_e")), key
        )
        parts.append(violations(both, [key], [Rule("sequence_digest_mismatch", F.col("_v") != F.col("_e"))]))
    return union_all(parts)


def _cover_count(position: Column, last: Column, size: int, stride: int) -> Column:
    """How many fixed-stride windows 0..last contain a position."""
    newest = F.least(last, F.floor(position / stride))
    oldest = F.greatest(F.lit(0), F.ceil((position - size + 1) / F.lit(float(stride))))
    return (newest - oldest + 1).cast("double")


def pool_windows(
    windows: DataFrame, size: int, stride: int, key: str = "entity_id", start: str = "window_start",
    length: str = "length", values: str = "values",
) -> DataFrame:
    """(key, vector): each position averaged over its windows, then the mean
    over positions.

    ``values`` is array<array<double>> (position in window, dimension). With a
    fixed stride a position's cover count is known from its number, so every
    window reduces to one weighted vector on its own row and positions are
    never exploded.
    """
    last = F.greatest(F.lit(0), F.ceil((F.col(length) - size) / F.lit(float(stride))))
    dims = F.size(F.col(values)[0])
    zero = F.transform(F.sequence(F.lit(1), dims), lambda _: F.lit(0.0))
    indexed = F.transform(
        F.col(values),
        lambda v, i: F.struct(
            v.alias("v"), (1.0 / (_cover_count(F.col(start) + i, last, size, stride) * F.col(length))).alias("w")
        ),
    )
    partial = F.aggregate(
        indexed, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, x: a + x.cast("double") * p["w"])
    )
    per_window = windows.select(key, F.posexplode(partial).alias("dim", "part"))
    summed = per_window.groupBy(key, "dim").agg(F.sum("part").alias("value"))
    # One vector per key: bounded by the dimension.
    return summed.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector")
    )


def validate_windows(
    windows: DataFrame, size: int, stride: int, key: str = "entity_id", start: str = "window_start",
    length: str = "length", values: str = "values",
) -> DataFrame:
    """Every planned window once, with one value row per position."""
    last = F.greatest(F.lit(0), F.ceil((F.col(length) - size) / F.lit(float(stride)))).cast("bigint")
    per_key = windows.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_distinct(start).alias("_d"),
        F.max(start).alias("_hi"),
        F.max(last).alias("_last"),
    )
    rules = [
        Rule("off_stride_start", F.col(start) % stride != 0),
        Rule("wrong_window_height", F.size(values) != F.least(F.lit(size), F.col(length) - F.col(start))),
        Rule("not_finite", ~F.forall(values, finite)),
    ]
    plan = [
        Rule(
            "windows_incomplete",
            (F.col("_n") != F.col("_last") + 1) | (F.col("_d") != F.col("_n")) | (F.col("_hi") != F.col("_last") * stride),
        )
    ]
    return union_all([violations(windows, [key, start], rules), violations(per_key, [key], plan)])
