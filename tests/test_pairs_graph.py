import hashlib

import pytest
import random

from conftest import rows_of
from pyspark.sql import functions as F

from pairloom.operators.graph import (
    _packed,
    attach_groups,
    closure,
    compile_policy,
    complex_groups,
    component_digests,
    components,
)
from pairloom.operators.pairs import (
    canonicalise,
    dedupe_evidence,
    label_pairs,
    split_ambiguous,
    union_sources,
    used_entities,
    with_evidence_id,
)

OBS = "source_database string, source_version string, source_record_id string, raw_a string, raw_b string, polarity string, negative_class string, detection_method string"


def observed(frame, rows):
    full = [("db", "1", rec, a, b, pol, cls, "MI:0018") for rec, a, b, pol, cls in rows]
    return canonicalise(frame(full, OBS), "raw_a", "raw_b", "P")


def test_labels_contradictions_and_self_pairs(frame):
    obs = observed(
        frame,
        [
            ("1", "A", "B", "positive", ""),
            ("2", "B", "A", "positive", ""),
            ("3", "A", "C", "negative", "screen_negative"),
            ("4", "C", "A", "negative", "curated_negative"),
            ("5", "A", "D", "negative", "screen_negative"),
            ("6", "B", "C", "positive", ""),
            ("7", "B", "C", "negative", "curated_negative"),
            ("8", "D", "D", "positive", ""),
            ("9", "E", "E", "positive", ""),
            ("10", "E", "E", "negative", "screen_negative"),
        ],
    )
    got = {r["pair_id"]: (r["label"], r["evidence_class"], r["pair_status"], r["exclusion_reason"]) for r in label_pairs(obs).collect()}
    self_reason = "self_pair_outside_primary_heterotypic_scope"
    assert got == {
        "P_A_B": (1, "direct_positive", "eligible", ""),
        "P_A_C": (0, "curated_negative", "eligible", ""),
        "P_A_D": (0, "screen_negative", "eligible", ""),
        "P_B_C": (None, "unlabeled", "quarantine", "positive_negative_contradiction"),
        "P_D_D": (1, "direct_positive", "quarantine", self_reason),
        "P_E_E": (None, "unlabeled", "quarantine", self_reason),
    }


def test_ambiguous_record_loses_everything(frame):
    obs = observed(frame, [("1", "A", "B", "positive", ""), ("1", "A", "C", "positive", ""), ("2", "A", "B", "positive", ""), ("2", "B", "A", "positive", "")])
    kept, rejected = split_ambiguous(obs)
    assert [r["source_record_id"] for r in kept.collect()] == ["2", "2"]
    assert [r["source_record_id"] for r in rejected.collect()] == ["1", "1"]


def test_evidence_ids_and_collisions(frame):
    obs = observed(frame, [("1", "A", "B", "positive", ""), ("1", "B", "A", "positive", "")])
    ids = with_evidence_id(obs).select("evidence_id", "pair_id").distinct().collect()
    expected = hashlib.sha256("\x1f".join(["db", "1", "1", "P_A_B", "positive", "MI:0018"]).encode()).hexdigest()[:20]
    assert [r["evidence_id"] for r in ids] == [f"EVI_{expected}"]
    distinct, collisions = dedupe_evidence(frame([("e", "x"), ("e", "x"), ("f", "x"), ("f", "y")], "evidence_id string, v string"))
    assert distinct.count() == 3 and [r["key"] for r in collisions.collect()] == ["f"]


def test_union_sources_and_used_entities(frame):
    a = frame([(1, "x")], "n int, raw string")
    b = frame([("q",)], "other string")
    out = union_sources([(a, {"src": "A"}), (b, {"src": "B", "raw": F.col("other")})], ["src", "raw"])
    assert rows_of(out) == [("A", "x"), ("B", "q")]
    pairs = frame([("A", "B"), ("A", "Z")], "node_a string, node_b string")
    used, missing = used_entities(pairs, frame([("A",), ("B",), ("C",)], "entity_id string"))
    assert rows_of(used) == [("A",), ("B",)] and [r["key"] for r in missing.collect()] == ["Z"]


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in list(parent))


def test_components_match_union_find(frame):
    rnd = random.Random(5)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    rnd.shuffle(chain)
    star = [("s999", f"s{i:03d}") for i in range(30)]
    noise = [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(50)]
    edges = chain + star + noise + [("loop", "loop")]
    got = components(frame(edges, "u string, v string").repartition(5))
    assert rows_of(got) == brute_components(edges)


def component_digest(ids):
    return hashlib.sha256(";".join(sorted(ids)).encode()).hexdigest()[:12]


def test_names_of_a_million_ids_stream_through_slices(spark):
    """One component of a million ids in many sorted slices and parts, beside small ones."""
    groups = spark.range(1_000_100).selectExpr(
        "if(id < 1000000, 'big', concat('c', id)) as component", "concat('G;', id) as group_id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    packed = _packed(groups)
    spread = packed.groupBy("component").agg(F.count_distinct("slice").alias("s"), F.count(F.lit(1)).alias("p"))
    big = spread.where("component = 'big'").first()
    got = {r["component"]: r for r in component_digests(groups).collect()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert big["s"] > 1 and big["p"] >= 8
    ids = sorted(f"G;{i}" for i in range(1_000_000))
    assert got["big"]["digest"] == hashlib.sha256(";".join(ids).encode()).hexdigest()
    assert (got["big"]["n"], got["big"]["first_id"], len(got)) == (1_000_000, "G;0", 101)
    assert got["c1000005"]["digest"] == hashlib.sha256(b"G;1000005").hexdigest()


def test_component_names(frame):
    links = [("p1", "1AAA"), ("p2", "1AAA"), ("p2", "2BBB"), ("p3", "2BBB"), ("p4", "9ZZZ"), ("p5", "")]
    digest = component_digest(["1AAA", "2BBB"])
    groups = complex_groups(frame(links, "pair_id string, group_id string"))
    pairs = frame([(f"p{i}",) for i in range(1, 7)], "pair_id string")
    big = f"PDB_COMPONENT_{digest}"
    assert rows_of(attach_groups(pairs, groups)) == [
        ("p1", big), ("p2", big), ("p3", big), ("p4", "PDB_9ZZZ"), ("p5", ""), ("p6", "")
    ]


@pytest.mark.parametrize("n", [40, 3000])
def test_components_of_any_size_are_named_alike(spark, n):
    links = spark.range(2 * n).selectExpr(
        "concat('p', floor(id / 2) div 2 + id % 2) as pair_id", "concat('g', floor(id / 2)) as group_id"
    )
    want = {f"PDB_COMPONENT_{component_digest([f'g{i}' for i in range(n)])}"}
    assert {r[0] for r in complex_groups(links.repartition(3)).select("component_group").distinct().collect()} == want


def test_closure_has_no_depth_limit(frame):
    edges = frame([(f"n{i + 1}", f"n{i}") for i in range(20)], "child string, parent string")
    assert closure(edges, frame([("n0",)], "term string")).count() == 21


EDGES = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "c"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "y")]


def test_closure_with_shared_descendants_and_cycle(frame):
    edges = frame(EDGES, "child string, parent string")
    roots = frame([("b",), ("x",)], "term string")
    assert {r[0] for r in closure(edges, roots).collect()} == {"b", "c", "d", "e", "x", "y", "z"}


def test_policy_sets_and_violations(frame):
    terms = frame([(t, t == "e") for t in "abcdexyz"], "term string, is_obsolete boolean")
    edges = frame(EDGES, "child string, parent string")
    policy = [("type_accept", "a"), ("type_never", "z"), ("method_accept", "b"), ("method_never", "x"), ("method_manual", "c")]
    sets, found = compile_policy(terms, edges, frame(policy, "section string, term string"))
    got = {}
    for s, t in sets.collect():
        got.setdefault(s, set()).add(t)
    assert got == {
        "type_accept": {"a"}, "type_manual": {"b", "c", "d", "e"}, "type_never": {"z"},
        "method_accept": {"b", "d"}, "method_obsolete": {"e"}, "method_manual": {"c"}, "method_never": {"x", "y", "z"},
    }
    assert found.count() == 0
    bad = policy + [("method_never", "d"), ("method_manual", "z"), ("type_never", "q"), ("type_never", "e")]
    _, found = compile_policy(terms, edges, frame(bad, "section string, term string"))
    assert {(r["rule_id"], r["key"]) for r in found.collect()} == {
        ("accept_never_overlap", "d"), ("accept_never_overlap", "e"), ("manual_term_outside_closure", "z"),
        ("unknown_term", "q"), ("obsolete_policy_term", "e"),
    }
