from conftest import rows_of
from pyspark.sql import functions as F

from pairloom.operators.coverage import (
    align,
    apply_audit,
    apply_clusters,
    best_ranked,
    coverage,
    overlap_audit,
    overlap_violations,
    ranked_hits,
    review_select,
    select_cohort,
    unchanged_except,
)
from pairloom.operators.profile import cluster_stats, count_summary, funnel, profile_pairs, top_k
from pairloom.operators.resolve import (
    deferred_targets,
    entity_table,
    explode_targets,
    identifier_inventory,
    mapping_profile,
    merge_dims,
    missing_targets,
    one_to_one_gate,
    request_ids,
    resolve_endpoints,
    resolve_mapping,
    split_unresolved,
    unrequested_sources,
)

INVENTORY = "source_database string, namespace string, raw_identifier string, mapping_query_id string, mapping_status string"


def inventory(frame, ids):
    return frame([("db", "ACC", i, q, s) for i, q, s in ids], INVENTORY)


CANDIDATE = "mapping_candidate"


def test_decision_tree_with_and_without_current_records(frame):
    ids = [(q, q, CANDIDATE) for q in ("one", "one_plus", "two", "none", "cur", "gone", "mouse", "multi", "unmapped")]
    ids += [("iso-2", "iso", "quarantine_isoform_specific"), ("other", "", "manual_review_non_uniprot_primary")]
    mapping = frame(
        [("one", "R1"), ("one_plus", "R1"), ("one_plus", "U1"), ("two", "R1"), ("two", "R2"), ("cur", "C1"), ("gone", "X1"),
         ("mouse", "M1"), ("multi", "C1"), ("multi", "M1"), ("none", "C1"), ("none", "C2"), ("one", "R1")],
        "source string, target string",
    )
    reviewed = frame([("R1",), ("R2",)], "target string")
    current = frame([("C1", True), ("C2", True), ("M1", False)], "target string, in_taxon boolean")
    got = {r["raw_identifier"]: (r["resolution_status"], r["resolution_reason"], r["resolved_id"]) for r in resolve_mapping(inventory(frame, ids), mapping, reviewed, current).collect()}
    assert got == {
        "one": ("accepted", "unique_reviewed_human_target", "R1"),
        "one_plus": ("accepted", "unique_reviewed_human_target", "R1"),
        "two": ("quarantine", "multiple_reviewed_human_targets", ""),
        "none": ("quarantine", "multiple_or_cross_species_targets_without_unique_human_mapping", ""),
        "cur": ("accepted", "unique_current_human_target_unreviewed", "C1"),
        "gone": ("deferred", "target_record_missing_from_pinned_snapshot", ""),
        "mouse": ("excluded", "no_human_target_in_pinned_release", ""),
        "multi": ("quarantine", "multiple_or_cross_species_targets_without_unique_human_mapping", ""),
        "unmapped": ("quarantine", "unmapped_in_pinned_uniprot_release", ""),
        "iso-2": ("quarantine", "isoform_specific_source_not_folded_to_canonical", ""),
        "other": ("manual_review", "non_uniprot_primary_identifier", ""),
    }
    first = resolve_mapping(inventory(frame, ids), mapping, reviewed)
    deferred = {r["raw_identifier"] for r in first.where("resolution_status = 'deferred'").collect()}
    assert deferred == {"none", "cur", "gone", "mouse", "multi"}
    targets = deferred_targets(first, mapping)
    assert rows_of(targets) == [("C1",), ("C2",), ("M1",), ("X1",)]
    assert rows_of(missing_targets(targets, current)) == [("X1",)]
    assert rows_of(explode_targets(frame([("b;a",), ("",), ("a",)], "t string"), "t")) == [("a",), ("b",)]


def test_inventory_requests_and_profile(frame):
    df = frame([("db", "ACC", "P12345-2", "P12345"), ("db", "ACC", "P12345", "Q99999"), ("db", "ebi", "E1", "E2")], "source string, ns string, a string, b string")
    inv = identifier_inventory(df, ["a", "b"], ["source"], "ns", "ACC")
    got = {r["raw_identifier"]: (r["mapping_query_id"], r["isoform_specific"], r["mapping_status"], r["occurrence_count"]) for r in inv.collect()}
    assert got["P12345"] == ("P12345", False, CANDIDATE, 2)
    assert got["P12345-2"] == ("P12345", True, "quarantine_isoform_specific", 1)
    assert got["E1"] == ("", False, "manual_review_non_uniprot_primary", 1)
    assert rows_of(request_ids(inv)) == [("ACC", "P12345"), ("ACC", "Q99999")]
    mapping = frame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1"), ("z", "9")], "source string, target string")
    asked = frame([("a",), ("b",), ("c",)], "source string")
    assert dict(rows_of(mapping_profile(mapping.where("source <> 'z'"), asked))) == {
        "requested_ids": 3, "mapping_rows": 4, "mapped_ids": 2, "unmapped_ids": 1, "one_to_one_ids": 1, "one_to_many_ids": 1, "unique_target_ids": 2,
    }
    assert [r["key"] for r in unrequested_sources(mapping, asked).collect()] == ["z"]


def test_endpoints_and_quarantine(frame):
    cols = "source_database string, source_version string, evidence_role string, namespace string, raw_identifier string, resolution_status string, resolution_reason string, resolved_id string"
    res = frame([("db", "1", "positive_evidence", "N", "a", "accepted", "unique", "A"), ("db", "1", "positive_evidence", "N", "b", "quarantine", "many", "")], cols)
    df = frame([("r1", "a", "a"), ("r2", "a", "b"), ("r3", "a", "q")], "source_record_id string, raw_a string, raw_b string")
    for name, value in (("source_database", "db"), ("source_version", "1"), ("evidence_role", "positive_evidence"), ("namespace", "N"), ("polarity", "positive")):
        df = df.withColumn(name, F.lit(value))
    usable, rejected = split_unresolved(resolve_endpoints(df, res))
    assert [r["source_record_id"] for r in usable.collect()] == ["r1"]
    got = {r["source_record_id"]: (r["status_a"], r["status_b"], r["evidence_role"]) for r in rejected.collect()}
    assert got == {"r2": ("accepted", "many", "positive_evidence"), "r3": ("accepted", "identifier_not_in_resolution_table", "positive_evidence")}


def test_entities_and_gate(frame):
    res = frame([("R",), ("C",), ("Z",), ("",), ("R",)], "resolved_id string")
    reviewed = frame([("R", " mac ")], "target string, sequence string")
    current = frame([("R", "other"), ("C", "ww")], "target string, sequence string")
    got = {r["entity_id"]: (r["sequence"], r["sequence_length"], r["is_reviewed"], r["has_record"]) for r in entity_table(res, reviewed, current).collect()}
    assert got == {"R": ("MAC", 3, True, True), "C": ("WW", 2, False, True), "Z": ("", 0, False, False)}
    kept, rejected = one_to_one_gate(
        frame([("a", "b"), ("a", "c"), ("q", "a")], "raw_a string, raw_b string"),
        frame([("a", "1"), ("a", "1"), ("b", "2"), ("c", "3"), ("c", "4")], "source string, target string"),
    )
    assert rows_of(kept.select("raw_a", "raw_b", "target_a", "target_b")) == [("a", "b", "1", "2")]
    assert rows_of(rejected.select("raw_a", "raw_b", "mapping_count_a", "mapping_count_b")) == [("a", "c", 1, 2), ("q", "a", 0, 1)]
    merged, conflicts = merge_dims(frame([("k", 1), ("m", 1)], "k string, v int"), frame([("k", 1), ("m", 2)], "k string, v int"), ["k"])
    assert merged.count() == 3 and [r["key"] for r in conflicts.collect()] == ["m"]


def test_coverage_alignment_cohort(frame):
    got = coverage(frame([("a",), ("b",)], "k string"), frame([("b",), ("b",), ("c",)], "k string"), ["k"])
    assert rows_of(got) == [("a", "missing"), ("b", "duplicate"), ("c", "unexpected")]
    cols = "pair_id string, label int, evidence_class string, bootstrap_group string"
    preds = frame([("a", 1, "x", "g", 0.5), ("b", 0, "x", "g", 0.1)], cols + ", score double")
    members = frame([("a", 1, "x", "g"), ("b", 1, "y", "h"), ("c", 0, "x", "g")], cols)
    selected, found = select_cohort(preds, members)
    assert selected.count() == 2
    assert rows_of(found.select("key", "rule_id")) == [("b", "bootstrap_group_mismatch"), ("b", "evidence_class_mismatch"), ("b", "label_mismatch"), ("c", "missing_prediction")]
    aligned, found = align(preds, preds, ["pair_id"], ["label"])
    assert aligned.count() == 2 and found.count() == 0


def test_clusters_and_changes(frame):
    out, found = apply_clusters(
        frame([("a",), ("b",), ("c",)], "entity_id string"),
        frame([("a", "a"), ("a", "b"), ("b", "b"), ("zz", "q")], "representative string, member string"),
        "CL",
    )
    assert ("a", "CL_a") in rows_of(out) and ("c", None) in rows_of(out)
    assert rows_of(found.select("key", "rule_id")) == [
        ("b", "duplicate_member"), ("c", "missing_member"), ("q", "unexpected_member"), ("zz", "unknown_representative")
    ]
    a = frame([(1, "x", None), (2, "y", "q")], "k int, v string, w string")
    b = frame([(1, "x", "new"), (3, "z", "q")], "k int, v string, w string")
    assert rows_of(unchanged_except(a, b, ["k"], [])) == [("1", "w", "", "new"), ("2", "(row)", "present", "absent"), ("3", "(row)", "absent", "present")]
    assert rows_of(unchanged_except(a, b.where("k = 1"), ["k"], ["w"])) == [("2", "(row)", "present", "absent")]


def test_overlap_audit(frame):
    members = frame([("g1", "q1", "A"), ("g1", "q2", "B"), ("g2", "q3", "T1"), ("g3", "q4", "D")], "group_id string, query string, entity_id string")
    hits = frame(
        [("q1", "T2", 0.5, 0.9, 0.6, 10.0), ("q1", "T1", 0.5, 0.9, 0.6, 10.0), ("q2", "T3", 0.4, 0.9, 0.9, 99.0), ("q4", "T1", 0.9, 0.9, 0.49, 5.0), ("q4", "T2", 0.29, 1.0, 1.0, 5.0)],
        "query string, target string, identity double, qcov double, tcov double, bits double",
    )
    train = frame([("T1",), ("T2",)], "entity_id string")
    audit = overlap_audit(members, hits, train, 0.3, 0.5)
    got = {r["group_id"]: (r["direct_overlap"], r["homology_overlap"], r["independence_passed"], r["eligible_hits"], r["best_target"]) for r in audit.collect()}
    assert got == {"g1": (False, True, False, 3, "T1"), "g2": (True, False, False, 0, ""), "g3": (False, False, True, 0, "")}
    assert [(r["query"], r["target"]) for r in ranked_hits(hits, 0.3, 0.5).collect()] == [("q1", "T1"), ("q1", "T2"), ("q2", "T3")]
    assert rows_of(overlap_violations(members, hits, train).select("key", "rule_id")) == [("T3", "hit_with_non_training_target")]
    out, issues = apply_audit(frame([("g1", True), ("g9", True)], "group_id string, homology_audit_passed boolean"), audit)
    assert rows_of(out) == [("g1", False, False)]
    assert rows_of(issues.select("key", "rule_id")) == [("g2", "unexpected_audit_row"), ("g3", "unexpected_audit_row"), ("g9", "missing_audit_row")]


def test_review_and_best_ranked(frame):
    cols = "id string, include boolean, assembly_confirmed boolean, mapping_confirmed boolean, scope_confirmed boolean, outputs_consulted boolean, reviewer_role string, rationale string"
    reviews = frame(
        [("a", True, True, True, True, False, "r", "ok"), ("b", True, True, True, True, False, "r", "ok"), ("c", False, False, False, False, True, "r", "no"),
         ("d", True, False, True, True, True, "r", " "), ("x", False, True, True, True, False, "r", "ok")],
        cols,
    )
    candidates = frame([("a", True), ("b", False), ("c", True), ("d", True)], "id string, auto_eligible boolean")
    selected, found, counts = review_select(candidates, reviews, "id")
    assert [r["id"] for r in selected.collect()] == ["a"]
    assert {(r["key"], r["rule_id"]) for r in found.collect()} == {
        ("b", "included_but_ineligible"), ("d", "not_assembly_confirmed"), ("d", "selection_saw_outputs"), ("d", "missing_rationale"), ("x", "unknown_candidate")
    }
    assert tuple(counts.first()) == (5, 3, 2)
    ranked = frame([("p", 0, 0.9), ("p", 1, 0.5), ("q", 0, 0.1), ("q", 1, 0.7), ("r", 0, 0.3), ("r", 0, 0.3)], "k string, rank int, s double")
    best, found = best_ranked(ranked, ["k"], "rank", "s", 2)
    assert best.where("k = 'p'").count() == 1
    assert {(r["key"], r["rule_id"]) for r in found.collect()} == {("q", "rank_zero_not_best"), ("r", "duplicate_rank"), ("r", "ranks_not_contiguous")}


def test_profiles(frame):
    df = frame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("bad", "a")], "x string, y string")
    assert dict(rows_of(profile_pairs(df, "x", "y", F.col("x") != "bad"))) == {
        "rows": 4, "invalid_rows": 1, "self_pairs": 1, "directed_pairs": 3, "undirected_pairs": 2, "duplicate_or_reciprocal_rows": 2, "distinct_endpoints": 3,
    }
    assert rows_of(funnel(df, {"a": F.col("x") != "bad", "b": F.col("x") == "a"}, "x", "y")) == [("a", 4, 2), ("all", 5, 3), ("b", 2, 1)]
    assert [tuple(r) for r in top_k(df, "x", 2).collect()] == [("a", 2), ("b", 1)]
    assert rows_of(count_summary(df, ["x", "y"])) == [("x", "a", 2), ("x", "b", 1), ("x", "bad", 1), ("x", "c", 1), ("y", "a", 2), ("y", "b", 2), ("y", "c", 1)]
    assert dict(rows_of(cluster_stats(df, "x"))) == {"entities": 5, "clusters": 4, "largest_cluster": 2, "singletons": 3}
