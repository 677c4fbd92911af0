"""Connected components and ontology closure.

The iterative jobs stage every round, so a lost executor re-reads files
instead of replaying earlier rounds.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.rules import union_all
from pairloom.runtime import drop_stage, stage

# Python workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(lowest, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(lowest, "u").where(F.col("v") != F.col("m"))
    return (
        hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(lowest.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for an undirected edge table (u, v) of one type; the
    component is its smallest node.

    Alternating large-star and small-star steps need about log(n) rounds, also
    on long chains, and keep the edge count from growing. Stops when a round
    leaves the edge set unchanged.
    """
    loops = edges.where(F.col("u") == F.col("v")).select("u").distinct()
    current = stage(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "star")
    before = _state(current)
    settled = before[0] == 0
    while not settled:
        following = stage(_small_star(_large_star(current)), "star")
        drop_stage(current)
        current, after = following, _state(following)
        settled, before = after == before, after
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    linked = members.unionByName(roots).distinct()
    return linked.unionByName(alone.join(linked.select("node"), "node", "left_anti"))


#: Bytes of joined ids in one row, and hex digits of a name.
PACKED_BYTES = 1 << 20
NAME_DIGITS = 12


def _packed(groups: DataFrame) -> DataFrame:
    """(component, slice, part, n, first_id, ids): the sorted ids of every component joined by
    semicolons, in rows of about ``PACKED_BYTES``. The sort is a range sort over all
    tasks, so a large component is cut into many slices."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_no = TaskContext.get().partitionId()
        component, ids, size, part = None, [], 0, 0
        rows = []

        def close() -> None:
            if ids:
                rows.append((component, slice_no, part, len(ids), ids[0], ";".join(ids)))

        def ready() -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*rows)]
            rows.clear()
            return pa.record_batch(columns, ["component", "slice", "part", "n", "first_id", "ids"])

        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != component or size >= PACKED_BYTES:
                    close()
                    component, ids, size, part = name, [], 0, part + 1
                ids.append(one)
                size += len(one)
            if rows:
                yield ready()
        close()
        if rows:
            yield ready()

    order = ["component", "group_id"]
    ranged = groups.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(pack, "component string, slice long, part long, n long, first_id string, ids string")


def component_digests(groups: DataFrame) -> DataFrame:
    """(component, n, first_id, digest): number of ids, the smallest id, and the SHA-256
    of all ids sorted and joined by semicolons.

    The digest is sequential, so the rows of ``_packed`` stream through one task per
    component in order, and the hash is all that is kept of them.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, n, first, digest = None, 0, None, None
        done = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["component"] != component:
                    if digest:
                        done.append((component, n, first, digest.hexdigest()))
                    component, n, first = row["component"], 0, row["first_id"]
                    digest = hashlib.sha256(row["ids"].encode())
                else:
                    digest.update(b";" + row["ids"].encode())
                n += row["n"]
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], ["component", "n", "first_id", "digest"])
                done = []
        if digest:
            last = zip((component, n, first, digest.hexdigest()))
            yield pa.record_batch([pa.array(c) for c in last], ["component", "n", "first_id", "digest"])

    packed = _packed(groups).repartition("component").sortWithinPartitions("component", "slice", "part")
    return packed.mapInArrow(fold, "component string, n long, first_id string, digest string")


def complex_groups(pair_groups: DataFrame, prefix: str = "PDB") -> DataFrame:
    """(pair_id, component_group) from (pair_id, group_id) rows.

    Pairs sharing a group id, directly or through other pairs, get one name:
    ``PREFIX_<id>`` for a single id, otherwise ``PREFIX_COMPONENT_`` and the first
    twelve hex digits of the SHA-256 of the sorted ids joined by semicolons.
    """
    links = pair_groups.where(F.col("group_id").isNotNull() & (F.col("group_id") != ""))
    links = links.select("pair_id", "group_id").distinct()
    edges = links.select(
        F.concat(F.lit("g:"), "group_id").alias("u"), F.concat(F.lit("p:"), "pair_id").alias("v")
    )
    found = stage(components(edges), "components")
    groups = found.where(F.col("node").startswith("g:")).select(
        "component", F.expr("substring(node, 3)").alias("group_id")
    )
    name = F.when(F.col("n") == 1, F.concat(F.lit(f"{prefix}_"), "first_id")).otherwise(
        F.concat(F.lit(f"{prefix}_COMPONENT_"), F.substring("digest", 1, NAME_DIGITS))
    )
    named = component_digests(groups).select("component", name.alias("component_group"))
    return (
        found.where(F.col("node").startswith("p:"))
        .join(named, "component")
        .select(F.expr("substring(node, 3)").alias("pair_id"), "component_group")
    )


def attach_groups(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Add ``complex_group_id``; blank for pairs without any group."""
    return pairs.join(groups, "pair_id", "left").select(
        *pairs.columns, F.coalesce("component_group", F.lit("")).alias("complex_group_id")
    )


# Levels of a closure that are read apart before they are written as one.
LEVELS_APART = 8


def _reached(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``keys`` reachable downwards, level by level. Only newly reached
    rows are joined, so the walk ends by itself, also on cycles."""
    frontier = stage(roots.select(*keys).distinct(), "closure")
    levels = [frontier]
    while True:
        fresh = (
            edges.select("child", "parent")
            .join(frontier, edges["parent"] == frontier["term"])
            .drop("term", "parent")
            .withColumnRenamed("child", "term")
            .select(*keys)
            .distinct()
            .join(union_all(levels), keys, "left_anti")
        )
        frontier = stage(fresh, "closure")
        if frontier.isEmpty():
            return union_all(levels)
        levels.append(frontier)
        if len(levels) > LEVELS_APART:
            levels = [stage(union_all(levels), "closure")]


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(term): the roots and everything below them in (child, parent) edges."""
    return _reached(edges, roots, ["term"])


def closure_by_root(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, term) for several named root sets in one pass; ``roots`` has
    (root, term)."""
    return _reached(edges, roots, ["root", "term"])


def compile_policy(terms: DataFrame, edges: DataFrame, policy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term sets, violations) from ``policy(section, term)``.

    Sections: ``type_accept``, ``type_never`` (exact terms), ``method_accept``,
    ``method_never`` (roots, closed downwards) and ``method_manual`` (exact).
    ``terms(term, is_obsolete)``. The result has (term_set, term).
    """
    roots = policy.where(F.col("section").isin("type_accept", "method_accept", "method_never"))
    closed = stage(closure_by_root(edges, roots.select(F.col("section").alias("root"), "term")), "policy")

    def section(name: str) -> DataFrame:
        return policy.where(F.col("section") == name).select("term").distinct()

    def below(name: str) -> DataFrame:
        return closed.where(F.col("root") == name).select("term")

    obsolete = terms.where(F.col("is_obsolete")).select("term")
    accept_all, never_all = below("method_accept"), below("method_never")
    obsolete_auto = accept_all.join(obsolete, "term", "left_semi")
    sets = {
        "type_accept": section("type_accept"),
        "type_manual": below("type_accept").join(section("type_accept"), "term", "left_anti"),
        "type_never": section("type_never"),
        "method_accept": accept_all.join(obsolete, "term", "left_anti").join(
            section("method_manual"), "term", "left_anti"
        ),
        "method_obsolete": obsolete_auto,
        "method_manual": section("method_manual"),
        "method_never": never_all,
    }
    out = union_all([df.select(F.lit(n).alias("term_set"), "term") for n, df in sets.items()])

    def broken(df: DataFrame, rule_id: str) -> DataFrame:
        return df.select(
            F.col("term").alias("key"),
            F.lit(rule_id).alias("rule_id"),
            F.lit("error").alias("severity"),
            F.lit("").alias("message"),
        )

    named = policy.select("term").distinct()
    found = union_all(
        [
            broken(named.join(terms.select("term"), "term", "left_anti"), "unknown_term"),
            broken(named.join(obsolete, "term", "left_semi"), "obsolete_policy_term"),
            broken(accept_all.join(never_all, "term", "left_semi"), "accept_never_overlap"),
            broken(
                section("method_manual").join(accept_all, "term", "left_anti"),
                "manual_term_outside_closure",
            ),
        ]
    )
    return out, found
