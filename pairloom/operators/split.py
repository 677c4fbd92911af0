"""Leakage-free cluster splits with a seeded search.

A cluster's pool under a seed is a pure function of (seed, cluster), so no
assignment table is joined for a single seed. For the search, the pools of one
cluster under all seeds are packed three bits per seed; a set of clusters lies
in one pool under a seed exactly when the OR of their bits has one bit set.
Pairs shrink to distinct (group, cluster pair) counts, and their sums per seed
come from matrix products of whole batches, so seeds never multiply rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip
from pairloom.functions.keys import unit_hash
from pairloom.operators.rules import Rule, duplicate_keys, missing_keys, union_all, violations
from pairloom.runtime import stage

# Python workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Partitions and the target shares of the split objective.
PARTITIONS = ("train", "validation", "test")
NODE_TARGETS = {"train": 0.60, "validation": 0.20, "test": 0.20}
PAIR_TARGETS = {"train": 0.80, "validation": 0.10, "test": 0.10}

# A pool as one bit; three bits per seed let 21 seeds share a 64-bit word.
POOL_BITS = {"train": 1, "validation": 2, "test": 4}
SEEDS_PER_WORD = 21


def pool(seed: Column | int, cluster: Column, targets: Mapping[str, float] = NODE_TARGETS) -> Column:
    """Partition of a cluster: its seeded hash against the cumulative targets."""
    u = unit_hash(seed, cluster)
    first, second = targets["train"], targets["train"] + targets["validation"]
    return (
        F.when(u < first, F.lit("train")).when(u < second, F.lit("validation")).otherwise(F.lit("test"))
    )


def assign_clusters(clusters: DataFrame, seed: int, targets: Mapping[str, float] = NODE_TARGETS) -> DataFrame:
    """(cluster_id, partition) for every distinct cluster."""
    return clusters.select("cluster_id").distinct().withColumn(
        "partition", pool(seed, F.col("cluster_id"), targets)
    )


def located_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs with the clusters of both endpoints."""
    out = pairs
    for side in "ab":
        dim = entities.select(
            F.col("entity_id").alias(f"node_{side}"), F.col("cluster_id").alias(f"cluster_{side}")
        )
        out = out.join(dim, f"node_{side}")
    return out


def retain_pairs(
    located: DataFrame, seed: int, targets: Mapping[str, float] = NODE_TARGETS
) -> DataFrame:
    """Add pool_a, pool_b, partition (blank if quarantined) and reason. A group
    whose endpoints span pools is quarantined whole, before the pair rule."""
    pooled = located.withColumn("pool_a", pool(seed, F.col("cluster_a"), targets)).withColumn(
        "pool_b", pool(seed, F.col("cluster_b"), targets)
    )
    bit = lambda c: F.coalesce(*[F.when(F.col(c) == p, F.lit(b)) for p, b in POOL_BITS.items()])
    spanning = (
        pooled.where(F.col("complex_group_id") != "")
        .groupBy(F.col("complex_group_id").alias("_key"))
        .agg(F.bit_or(bit("pool_a").bitwiseOR(bit("pool_b"))).alias("_pools"))
        .where(F.bit_count("_pools") > 1)
        .select("_key", F.lit(True).alias("_spans"))
    )
    # An ungrouped pair joins on its own id and finds nothing: the blank group
    # would be one hot key.
    alone = F.concat(F.lit("\u0000"), "pair_id")
    key = F.when(F.col("complex_group_id") != "", F.col("complex_group_id")).otherwise(alone)
    both = pooled.withColumn("_key", key).join(spanning, "_key", "left").drop("_key")
    reason = (
        F.when(F.col("_spans"), F.lit("complex_group_cross_partition_quarantine"))
        .when(F.col("pool_a") != F.col("pool_b"), F.lit("cross_partition_quarantine"))
        .otherwise(F.lit(""))
    )
    return both.withColumn("reason", reason).withColumn(
        "partition", F.when(F.col("reason") == "", F.col("pool_a")).otherwise(F.lit(""))
    ).drop("_spans")


def _packed(cluster: Column, first: int, last: int, targets: Mapping[str, float]) -> Column:
    """array<bigint>: three pool bits per seed, 21 seeds per word."""
    def bits(seed: Column) -> Column:
        u = unit_hash(seed, cluster)
        a, b = targets["train"], targets["train"] + targets["validation"]
        return F.when(u < a, 1).when(u < b, 2).otherwise(4).cast("bigint")

    starts = F.sequence(F.lit(first), F.lit(last), F.lit(SEEDS_PER_WORD))

    def word(start: Column) -> Column:
        seeds = F.sequence(start, F.least(start + SEEDS_PER_WORD - 1, F.lit(last)))
        # Later seeds sit in higher bits: fold from the last seed downwards.
        return F.aggregate(
            F.reverse(seeds), F.lit(0).cast("bigint"), lambda acc, s: acc * 8 + bits(s)
        )

    return F.transform(starts, word)


#: Rows whose pools under all seeds are unpacked at once.
UNPACKED_ROWS = 2048


def seed_sums(df: DataFrame, first: int, last: int, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(seed, by..., bits, values...): sums of bigint ``values`` per seed and pools of a
    packed ``words`` column; ``by`` are boolean.

    A batch is a matrix of rows by seeds, and a sum over rows is a product with it. So a
    task hands out one row per seed and pools, and nothing per row and seed.
    """
    by, values = list(by), list(values)
    n_seeds = last - first + 1
    kinds = 1 << len(by)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kinds, 8, len(values), n_seeds), np.int64)
        shifts = 3 * np.arange(SEEDS_PER_WORD)
        for whole in batches:
            for at in range(0, whole.num_rows, UNPACKED_ROWS):
                batch = whole.slice(at, UNPACKED_ROWS)
                n = batch.num_rows
                words = batch.column("words").flatten().to_numpy(zero_copy_only=False).reshape(n, -1, 1)
                bits = (words >> shifts & 7).astype(np.int8).reshape(n, -1)[:, :n_seeds]
                weights = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values])
                kind = np.zeros(n, np.int64)
                for place, name in enumerate(by):
                    kind += batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) << place
                for k in np.unique(kind):
                    rows = kind == k
                    # Sums of a chunk below 2**53 are exact as doubles.
                    exact = np.abs(weights[:, rows]).sum() < 2**53
                    w = weights[:, rows].astype(np.float64 if exact else np.int64)
                    for pools in range(1, 8):
                        total[k, pools] += (w @ (bits[rows] == pools)).astype(np.int64)
        k, pools, seed = np.nonzero(np.abs(total).sum(axis=2))
        columns = [pa.array(first + seed), *[pa.array((k >> i & 1) == 1) for i in range(len(by))], pa.array(pools)]
        columns += [pa.array(total[k, pools, v, seed]) for v in range(len(values))]
        yield pa.record_batch(columns, names)

    names = ["seed", *by, "bits", *values]
    schema = ", ".join(["seed long", *[f"{c} boolean" for c in by], "bits long", *[f"{v} long" for v in values]])
    sums = df.select(*by, *values, "words").mapInArrow(add, schema)
    return sums.groupBy(F.col("seed").cast("int").alias("seed"), *by, "bits").agg(*[F.sum(v).alias(v) for v in values])


def split_candidates(
    pairs: DataFrame,
    entities: DataFrame,
    first: int = 0,
    last: int = 999,
    min_per_class: int = 1,
    node_targets: Mapping[str, float] = NODE_TARGETS,
    pair_targets: Mapping[str, float] = PAIR_TARGETS,
) -> DataFrame:
    """One row per seed: counts, retention, ``feasible`` and ``score``.

    ``pairs`` are the eligible labelled pairs; ``entities(entity_id,
    cluster_id)``.
    """
    located = located_pairs(pairs, entities)
    cells = stage(
        located.groupBy(
            "complex_group_id",
            F.least("cluster_a", "cluster_b").alias("lo"),
            F.greatest("cluster_a", "cluster_b").alias("hi"),
        ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")),
        "cells",
    )
    clusters = stage(
        entities.groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("entities"))
        .withColumn("words", _packed(F.col("cluster_id"), first, last, node_targets)),
        "packed",
    )
    lo = clusters.select(F.col("cluster_id").alias("lo"), F.col("words").alias("words_lo"))
    hi = clusters.select(F.col("cluster_id").alias("hi"), F.col("words").alias("words_hi"))
    merged = cells.join(lo, "lo").join(hi, "hi").select(
        "complex_group_id",
        "n",
        "pos",
        F.zip_with("words_lo", "words_hi", lambda x, y: x.bitwiseOR(y)).alias("words"),
    )
    n_words = (last - first) // SEEDS_PER_WORD + 1
    grouped = (
        merged.where(F.col("complex_group_id") != "")
        .groupBy("complex_group_id")
        .agg(
            F.sum("n").alias("n"),
            F.sum("pos").alias("pos"),
            F.array(*[F.bit_or(F.col("words")[i]) for i in range(n_words)]).alias("words"),
        )
        .select(F.lit(True).alias("grouped"), "n", "pos", "words")
    )
    single = merged.where(F.col("complex_group_id") == "").select(
        F.lit(False).alias("grouped"), "n", "pos", "words"
    )
    pair_sums = seed_sums(grouped.unionByName(single), first, last, ["n", "pos"], ["grouped"])
    one_each = clusters.withColumn("clusters", F.lit(1).cast("bigint"))
    node_sums = seed_sums(one_each, first, last, ["entities", "clusters"])

    def total(col: str, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col(col))), F.lit(0))

    one_pool = F.col("bits").isin(*POOL_BITS.values())
    per_pairs = pair_sums.groupBy("seed").agg(
        F.sum("n").alias("labelled"),
        total("n", one_pool).alias("retained"),
        total("n", ~one_pool & F.col("grouped")).alias("group_quarantined"),
        total("n", ~one_pool & ~F.col("grouped")).alias("pair_quarantined"),
        *[total("n", F.col("bits") == b).alias(f"pairs_{p}") for p, b in POOL_BITS.items()],
        *[total("pos", F.col("bits") == b).alias(f"positives_{p}") for p, b in POOL_BITS.items()],
    )
    per_nodes = node_sums.groupBy("seed").agg(
        F.sum("entities").alias("all_entities"),
        *[total("entities", F.col("bits") == b).alias(f"entities_{p}") for p, b in POOL_BITS.items()],
        *[total("clusters", F.col("bits") == b).alias(f"clusters_{p}") for p, b in POOL_BITS.items()],
    )
    row = per_pairs.join(per_nodes, "seed")
    positives = sum((F.col(f"positives_{p}") for p in PARTITIONS), F.lit(0))
    overall = F.try_divide(positives, F.col("retained"))
    pair_dev = sum(
        (F.abs(F.try_divide(F.col(f"pairs_{p}"), F.col("retained")) - pair_targets[p]) for p in PARTITIONS),
        F.lit(0.0),
    )
    prev_dev = sum(
        (F.abs(F.try_divide(F.col(f"positives_{p}"), F.col(f"pairs_{p}")) - overall) for p in PARTITIONS),
        F.lit(0.0),
    )
    node_dev = sum(
        (F.abs(F.col(f"entities_{p}") / F.col("all_entities") - node_targets[p]) for p in PARTITIONS),
        F.lit(0.0),
    )
    feasible = F.col("retained") > 0
    for p in PARTITIONS:
        negatives = F.col(f"pairs_{p}") - F.col(f"positives_{p}")
        feasible = feasible & (F.col(f"positives_{p}") >= min_per_class) & (negatives >= min_per_class)
    retention = F.col("retained") / F.col("labelled")
    score = F.round(pair_dev + prev_dev + 0.5 * node_dev - 0.1 * retention, 12)
    return row.select(
        "*",
        retention.alias("retention"),
        feasible.alias("feasible"),
        F.when(feasible, score).alias("score"),
    )


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The feasible row with the least (score, seed)."""
    return candidates.where("feasible").orderBy("score", "seed").limit(1)


def find_split(
    pairs: DataFrame, entities: DataFrame, first: int = 0, last: int = 999, min_per_class: int = 1
) -> int | None:
    """The winning seed, or None where no seed is feasible. Only this one number reaches the driver."""
    best = best_candidate(split_candidates(pairs, entities, first, last, min_per_class)).first()
    return None if best is None else int(best["seed"])


def select_split(pairs: DataFrame, entities: DataFrame, first: int = 0, last: int = 999, min_per_class: int = 1) -> int:
    """The winning seed; it is an error when there is none."""
    seed = find_split(pairs, entities, first, last, min_per_class)
    if seed is None:
        raise ValueError("no candidate split satisfies the per-partition class minimum")
    return seed


def make_split(
    pairs: DataFrame, entities: DataFrame, seed: int, scheme: str = "c3_primary", fold: str = "0"
) -> dict[str, DataFrame]:
    """``splits``, ``quarantined`` pairs and entity ``assignments``.

    The located pairs are read twice and the decisions by two outputs, so each
    is staged, in the few columns it needs.
    """
    narrow = pairs.select("pair_id", "node_a", "node_b", "complex_group_id")
    located = stage(located_pairs(narrow, entities).drop("node_a", "node_b"), "located")
    decided = stage(retain_pairs(located, seed).drop("complex_group_id"), "decided")
    kept = decided.where(F.col("reason") == "").select(
        F.lit(scheme).alias("split_scheme"),
        F.lit(fold).alias("fold"),
        "pair_id",
        "partition",
        F.when(F.col("partition") == "train", F.lit("")).otherwise(F.lit("C3")).alias("pm_class"),
    )
    rejected = decided.where(F.col("reason") != "").select(
        "pair_id", "reason", "cluster_a", "cluster_b", "pool_a", "pool_b"
    )
    assigned = entities.select("entity_id", "cluster_id", pool(seed, F.col("cluster_id")).alias("partition"))
    return {"splits": kept, "quarantined": rejected, "assignments": assigned}


def split_input_violations(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """What must hold before a split: unique entities with clusters, and no
    pair endpoint without an entity."""
    rules = [
        Rule("missing_entity_id", F.coalesce(strip(F.col("entity_id")), F.lit("")) == ""),
        Rule("missing_cluster", F.coalesce(strip(F.col("cluster_id")), F.lit("")) == ""),
    ]
    ends = pairs.select(F.explode(F.array("node_a", "node_b")).alias("node"))
    return union_all(
        [
            violations(entities, ["entity_id"], rules),
            duplicate_keys(entities, ["entity_id"], "duplicate_entity"),
            missing_keys(ends, entities, "node", "entity_id", "pair_with_unknown_entity"),
        ]
    )
