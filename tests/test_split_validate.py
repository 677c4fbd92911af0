import hashlib
import random
import uuid

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pairloom.operators.cohort import build_cohorts, cohort_counts, expected_pairs
from pairloom.operators.split import (
    NODE_TARGETS,
    PAIR_TARGETS,
    PARTITIONS,
    best_candidate,
    located_pairs,
    make_split,
    retain_pairs,
    seed_sums,
    select_split,
    split_candidates,
    split_input_violations,
)
from pairloom.operators.validate import (
    validate_dataset,
    validate_entities,
    validate_evidence,
    validate_pairs,
    validate_splits,
    validate_support,
    validation_report,
)
from pairloom.plans.benchmark import build_benchmark, cluster_only_changes, freeze
from pairloom.runtime import stage, work_dir
from pairloom.sources.manifest import manifest
from pairloom.sources.release import exists, recover

NODES = 60


def pool_of(seed, cluster):
    u = int.from_bytes(hashlib.sha256(f"{seed}:{cluster}".encode()).digest()[:8], "big") / 2**64
    return "train" if u < 0.6 else "validation" if u < 0.6 + 0.2 else "test"


def ring():
    """Dense ring over the nodes with alternating labels and a few groups."""
    rnd = random.Random(1)
    pairs = []
    for i in range(NODES):
        for step in range(1, 12):
            j = (i + step) % NODES
            a, b = sorted((f"N{i:03d}", f"N{j:03d}"))
            group = f"G{rnd.randrange(25)}" if rnd.random() < 0.1 else ""
            label = (i + step) % 2
            pairs.append((f"P_{a}_{b}", a, b, label, ["curated_negative", "screen_negative"][step // 2 % 2] if label == 0 else "direct_positive", "eligible", group))
    return pairs


PAIR_COLUMNS = "pair_id string, node_a string, node_b string, label int, evidence_class string, pair_status string, complex_group_id string"


@pytest.fixture
def tables(frame):
    pairs = frame(ring(), PAIR_COLUMNS)
    entities = frame([(f"N{i:03d}", f"C{i // 2}") for i in range(NODES)], "entity_id string, cluster_id string")
    return pairs, entities


def brute_candidate(seed, minimum=1):
    clusters = {f"N{i:03d}": f"C{i // 2}" for i in range(NODES)}
    pools = {n: pool_of(seed, c) for n, c in clusters.items()}
    seen = {}
    for _, a, b, *_, group in ring():
        if group:
            seen.setdefault(group, set()).update((pools[a], pools[b]))
    counts = {p: 0 for p in PARTITIONS}
    positives = dict(counts)
    for _, a, b, label, _, _, group in ring():
        if (group and len(seen[group]) > 1) or pools[a] != pools[b]:
            continue
        counts[pools[a]] += 1
        positives[pools[a]] += label
    kept = sum(counts.values())
    if any(positives[p] < minimum or counts[p] - positives[p] < minimum for p in PARTITIONS):
        return kept, None
    overall = sum(positives.values()) / kept
    nodes = {p: sum(v == p for v in pools.values()) for p in PARTITIONS}
    score = (
        sum(abs(counts[p] / kept - PAIR_TARGETS[p]) for p in PARTITIONS)
        + sum(abs(positives[p] / counts[p] - overall) for p in PARTITIONS)
        + 0.5 * sum(abs(nodes[p] / NODES - NODE_TARGETS[p]) for p in PARTITIONS)
        - 0.1 * kept / len(ring())
    )
    return kept, round(score, 12)


def test_search_matches_a_plain_evaluation(tables):
    pairs, entities = tables
    found = split_candidates(pairs, entities, 0, 47, min_per_class=3)
    got = {r["seed"]: (r["retained"], r["score"]) for r in found.collect()}
    assert sorted(got) == list(range(48))
    want = {s: brute_candidate(s, 3) for s in range(48)}
    for s in want:
        assert got[s][0] == want[s][0]
        assert (got[s][1] is None) == (want[s][1] is None)
        if want[s][1] is not None:
            assert abs(got[s][1] - want[s][1]) < 1e-11
    feasible = [(v, s) for s, (_, v) in want.items() if v is not None]
    assert best_candidate(found).first()["seed"] == min(feasible)[1] == select_split(pairs, entities, 0, 47, 3)


def test_no_feasible_seed_is_an_error(tables):
    pairs, entities = tables
    with pytest.raises(ValueError, match="no candidate split"):
        select_split(pairs, entities, 0, 5, min_per_class=10_000)


def test_split_is_complete_disjoint_and_repeatable(tables):
    pairs, entities = tables
    out = make_split(pairs, entities, 7)
    again = make_split(pairs.repartition(6), entities.repartition(3), 7)
    for name in out:
        assert rows_of(out[name]) == rows_of(again[name])
    assert out["splits"].count() + out["quarantined"].count() == len(ring())
    pools = {r["entity_id"]: r["partition"] for r in out["assignments"].collect()}
    for r in out["splits"].join(pairs, "pair_id").collect():
        assert pools[r["node_a"]] == pools[r["node_b"]] == r["partition"]
        assert r["pm_class"] == ("" if r["partition"] == "train" else "C3")


def test_group_across_pools_is_quarantined_whole(frame):
    seed = 0
    by_pool = {}
    for i in range(200):
        by_pool.setdefault(pool_of(seed, f"C{i}"), []).append(i)
    t, v = by_pool["train"][:4], by_pool["test"][:2]
    ends = [(t[0], t[1], "G1"), (t[2], v[0], "G1"), (t[0], t[3], ""), (t[1], v[1], ""), (v[0], v[1], "G2")]
    pairs = frame([(f"p{i}", f"N{a}", f"N{b}", 1, "x", "eligible", g) for i, (a, b, g) in enumerate(ends)], PAIR_COLUMNS)
    entities = frame([(f"N{i}", f"C{i}") for i in range(200)], "entity_id string, cluster_id string")
    got = {r["pair_id"]: (r["partition"], r["reason"]) for r in retain_pairs(located_pairs(pairs, entities), seed).collect()}
    whole = ("", "complex_group_cross_partition_quarantine")
    assert got == {"p0": whole, "p1": whole, "p2": ("train", ""), "p3": ("", "cross_partition_quarantine"), "p4": ("test", "")}


def test_split_inputs_are_checked(frame, tables):
    pairs, _ = tables
    bad = frame([("N000", "C1"), ("N000", "C2"), ("N001", " ")], "entity_id string, cluster_id string")
    rules = {r["rule_id"] for r in split_input_violations(pairs, bad).collect()}
    assert rules == {"duplicate_entity", "missing_cluster", "pair_with_unknown_entity"}


def test_cohorts(tables):
    pairs, entities = tables
    positives = pairs.where("label = 1").withColumn("pair_id", F.concat("pair_id", F.lit("x")))
    pairs = pairs.unionByName(positives)
    splits = make_split(pairs, entities, 7)["splits"]
    expected, found = expected_pairs(pairs, splits)
    assert found.count() == 0
    membership, found = build_cohorts(expected, seed=5)
    assert found.count() == 0
    rows = expected.where("partition <> 'train'").collect()
    want = set()
    for cohort, stratum in (("balanced_explicit_1to1", None), ("balanced_curated_1to1", "curated_negative"), ("balanced_screen_1to1", "screen_negative")):
        for part in ("validation", "test"):
            neg = [r["pair_id"] for r in rows if r["partition"] == part and r["label"] == 0 and stratum in (None, r["evidence_class"])]
            pos = [r["pair_id"] for r in rows if r["partition"] == part and r["label"] == 1]
            order = sorted((hashlib.sha256(f"5:{cohort}:{p}".encode()).hexdigest(), p) for p in pos)
            want |= {(cohort, part, p, None) for p in neg}
            want |= {(cohort, part, p, n) for n, (_, p) in enumerate(order[: len(neg)], 1)}
    want |= {("full_evidence_pool", r["partition"], r["pair_id"], None) for r in rows}
    got = {(r["cohort"], r["partition"], r["pair_id"], r["positive_selection_rank"]) for r in membership.collect()}
    assert got == want
    for r in cohort_counts(membership).collect():
        if r["cohort"] != "full_evidence_pool":
            assert r["positives"] == r["negatives"] and r["prevalence"] == 0.5
    assert all(r["bootstrap_group"] for r in membership.collect())


def test_cohort_violations(frame):
    cols = "partition string, pair_id string, label int, evidence_class string, complex_group_id string"
    rows = [("test", "a", 0, "curated_negative", ""), ("test", "b", 0, "curated_negative", ""), ("test", "c", 1, "direct_positive", ""), ("validation", "d", 1, "direct_positive", ""), ("test", "e", 0, "odd", "")]
    _, found = build_cohorts(frame(rows, cols))
    got = {(r["key"], r["rule_id"]) for r in found.collect()}
    assert ("balanced_curated_1to1|test", "too_few_positives") in got
    assert ("balanced_screen_1to1|test", "no_negatives") in got and ("balanced_explicit_1to1|validation", "no_negatives") in got
    assert ("e", "unsupported_negative_class") in got


def dataset(frame):
    seq = "MACD"
    digest = hashlib.sha256(seq.encode()).hexdigest()
    names = ["P00001", "P00002", "P00003", "P00004"]
    entities = frame([(n, "9606", seq, "4", digest, f"C{n}") for n in names], "entity_id string, taxid string, sequence string, sequence_length string, sequence_sha256 string, cluster_id string")
    pairs = frame(
        [("H_P00001_P00002", "P00001", "P00002", 1, "direct_positive", "eligible", "G"), ("H_P00003_P00004", "P00003", "P00004", 0, "curated_negative", "eligible", "")],
        PAIR_COLUMNS,
    )
    evidence = frame(
        [("e1", "H_P00001_P00002", "db", "1", "r1", "MI:0407", "MI:0018", "positive", ""), ("e2", "H_P00003_P00004", "db", "1", "r2", "", "MI:0018", "negative", "explicit")],
        "evidence_id string, pair_id string, source_database string, source_version string, source_record_id string, interaction_type string, detection_method string, polarity string, negative_definition string",
    )
    splits = frame([("c3_primary", "0", "H_P00001_P00002", "train", ""), ("c3_primary", "0", "H_P00003_P00004", "test", "C3")], "split_scheme string, fold string, pair_id string, partition string, pm_class string")
    return entities, pairs, evidence, splits


def rules_of(found):
    return {(r["rule_id"], r["severity"]) for r in found.collect()}


def test_clean_dataset_passes(frame):
    entities, pairs, evidence, splits = dataset(frame)
    found = validate_dataset(entities, pairs, evidence, splits, "H")
    assert found.count() == 0
    report = {r["item"]: r["value"] for r in validation_report({"pairs": pairs}, found).collect()}
    assert report == {"rows_pairs": 2, "errors": 0, "warnings": 0, "passed": 1}


@pytest.mark.parametrize(
    "table,column,value,where,rule",
    [
        ("entities", "taxid", "10090", "true", "wrong_taxon"),
        ("entities", "sequence_length", "5", "entity_id = 'P00001'", "sequence_length_mismatch"),
        ("entities", "sequence_sha256", "00", "entity_id = 'P00001'", "sequence_digest_mismatch"),
        ("entities", "cluster_id", "", "entity_id = 'P00001'", "entity_without_cluster"),
        ("entities", "cluster_id", "same", "true", "cluster_leakage"),
        ("pairs", "evidence_class", "direct_positive", "label = 0", "label_conflicts_with_class"),
        ("pairs", "pair_status", "odd", "true", "invalid_pair_status"),
        ("pairs", "pair_id", "X", "label = 0", "unexpected_pair_id"),
        ("pairs", "complex_group_id", "G", "true", "group_leakage"),
        ("evidence", "negative_definition", " ", "true", "negative_without_definition"),
        ("evidence", "polarity", "none", "evidence_id = 'e1'", "positive_without_support"),
        ("evidence", "interaction_type", "MI:0915", "evidence_id = 'e1'", "positive_without_direct_type"),
        ("evidence", "detection_method", "x", "true", "invalid_detection_method"),
        ("evidence", "source_record_id", "r", "true", "contradictory_source_record"),
        ("splits", "partition", "holdout", "true", "invalid_partition"),
        ("splits", "pm_class", "", "true", "test_pair_not_marked"),
        ("splits", "pair_id", "nope", "partition = 'test'", "split_of_unknown_pair"),
    ],
)
def test_each_corruption_is_reported(frame, table, column, value, where, rule):
    names = ("entities", "pairs", "evidence", "splits")
    data = dict(zip(names, dataset(frame)))
    data[table] = data[table].withColumn(column, F.when(F.expr(where), F.lit(value)).otherwise(F.col(column)))
    entities, pairs, evidence, splits = (data[n] for n in names)
    # The area that owns the rule; the whole validation is tested above.
    if rule in ("positive_without_support", "positive_without_direct_type", "negative_without_definition"):
        found = validate_support(pairs, evidence)
    elif rule.endswith(("leakage", "cluster", "partition", "marked")) or table == "splits":
        found = validate_splits(splits, pairs, entities)
    elif table == "entities":
        found = validate_entities(entities)
    elif table == "pairs":
        found = validate_pairs(pairs, entities, "H")
    else:
        found = validate_evidence(evidence, pairs)
    assert rule in {r for r, _ in rules_of(found)}


def test_shared_entity_leaks(frame):
    entities, pairs, evidence, splits = dataset(frame)
    extra = frame([("H_P00001_P00003", "P00001", "P00003", 1, "direct_positive", "quarantine", "")], PAIR_COLUMNS)
    more = frame([("c3_primary", "0", "H_P00001_P00003", "test", "C3")], "split_scheme string, fold string, pair_id string, partition string, pm_class string")
    found = validate_dataset(entities, pairs.unionByName(extra), evidence, splits.unionByName(more), "H")
    assert ("entity_leakage", "error") in rules_of(found)


def build_inputs(frame):
    rnd = random.Random(3)
    rows = []
    for i in range(900):
        a, b = sorted(rnd.sample(range(NODES), 2))
        negative = (a + b) % 3 == 0
        rows.append(("db", "1", f"r{i}", f"N{a:03d}", f"N{b:03d}", "negative" if negative else "positive", ["curated_negative", "screen_negative"][a % 2], "MI:0018", "MI:0407", "explicit" if negative else "", f"G{i}" if i % 40 == 0 else "", "node", "negative_evidence" if negative else "positive_evidence"))
    rows.append(("db", "1", "lost", "N000", "Q", "positive", "", "MI:0018", "MI:0407", "", "", "node", "positive_evidence"))
    cols = "source_database string, source_version string, source_record_id string, raw_a string, raw_b string, polarity string, negative_class string, detection_method string, interaction_type string, negative_definition string, group_id string, namespace string, evidence_role string"
    resolution = [("db", "1", role, "node", f"N{i:03d}", "accepted", "", f"N{i:03d}") for i in range(NODES) for role in ("positive_evidence", "negative_evidence")]
    rcols = "source_database string, source_version string, evidence_role string, namespace string, raw_identifier string, resolution_status string, resolution_reason string, resolved_id string"
    entities = frame([(f"N{i:03d}", f"C{i}") for i in range(NODES)], "entity_id string, cluster_id string")
    return frame(rows, cols), frame(resolution, rcols), entities


def test_build_and_freeze(spark, frame):
    built = build_benchmark(*build_inputs(frame), "P")
    assert [r["reason"] for r in built["quarantine"].collect()] == ["unresolved_endpoint"]
    inputs = {n: stage(built[n], n) for n in ("pairs", "evidence", "entities")}
    options = dict(first_seed=0, last_seed=30, id_shape=r"^N\d{3}$", taxon=None, rules=[])
    listed = manifest(inputs)
    out = f"{work_dir(spark)}/freeze-{uuid.uuid4().hex}"
    done = freeze(spark, inputs, out, "P", expected_manifest=listed, **options)
    assert {r["table"] for r in done.collect()} == {"pairs", "evidence", "entities", "splits", "quarantined", "assignments", "cohorts"}
    again = freeze(spark, inputs, out + "-2", "P", **options)
    assert rows_of(done) == rows_of(again)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        freeze(spark, inputs, out, "P", **options)
    assert recover(spark, out, inputs) == "published"
    clusters = frame([(f"N{i:03d}", f"N{i:03d}") for i in range(NODES)], "representative string, member string")
    own = inputs["entities"].withColumn("cluster_id", F.concat(F.lit("CLU_"), "entity_id"))
    plain = own.drop("cluster_id")
    used = clusters.join(plain, clusters["member"] == plain["entity_id"], "left_semi")
    assert cluster_only_changes(plain, own, used, "CLU").count() == 0
    moved = own.withColumn("cluster_id", F.when(F.col("entity_id") == "N003", "CLU_N004").otherwise(F.col("cluster_id")))
    assert [r["rule_id"] for r in cluster_only_changes(plain, moved, used, "CLU").collect()] == ["cluster_changed"]
    with pytest.raises(ValueError, match="entity_changed"):
        freeze(spark, inputs, out + "-5", "P", originals=inputs["entities"].where("entity_id <> 'N003'"), **options)
    assert not exists(spark, out + "-5")
    with pytest.raises(ValueError, match="pairs content_changed"):
        tampered = {**inputs, "pairs": inputs["pairs"].withColumn("label", 1 - F.col("label"))}
        freeze(spark, tampered, out + "-3", "P", expected_manifest=listed, **options)
    with pytest.raises(ValueError, match="validation failed"):
        bad = {**inputs, "evidence": inputs["evidence"].withColumn("negative_definition", F.lit(""))}
        freeze(spark, bad, out + "-4", "P", **options)


def test_colliding_evidence_is_reported_and_not_frozen(spark, frame):
    rows, resolution, entities = build_inputs(frame)
    again = rows.where("source_record_id = 'r1'").withColumn("interaction_type", F.lit("MI:0915"))
    built = build_benchmark(rows.unionByName(again), resolution, entities, "P")
    assert [(r["rule_id"], r["message"]) for r in built["collisions"].collect()] == [("evidence_id_collision", "2 rows")]
    assert built["evidence"].where("source_record_id = 'r1'").count() == 2
    inputs = {n: stage(built[n], n) for n in ("pairs", "evidence", "entities")}
    out = f"{work_dir(spark)}/freeze-{uuid.uuid4().hex}"
    with pytest.raises(ValueError, match="duplicate_evidence"):
        freeze(spark, inputs, out, "P", first_seed=0, last_seed=30, id_shape=r"^N\d{3}$", taxon=None, rules=[])
    assert not exists(spark, out)


def test_seed_sums_of_packed_pools(spark):
    """Sums per seed and pools against plain loops, over words that are only part full."""
    rng = random.Random(3)
    first, last = 5, 5 + 50
    rows = []
    for _ in range(300):
        bits = [rng.randrange(1, 8) for _ in range(last - first + 1)]
        words = [sum(b << (3 * i) for i, b in enumerate(bits[w : w + 21])) for w in range(0, len(bits), 21)]
        rows.append((rng.random() < 0.5, rng.choice([1, 7, 10**15, 2**52]), rng.randrange(3), words, bits))
    df = spark.createDataFrame([r[:4] for r in rows], "g boolean, n long, pos long, words array<long>").repartition(3)
    want = {}
    for g, n, pos, _, bits in rows:
        for i, b in enumerate(bits):
            a, c = want.get((first + i, g, b), (0, 0))
            want[first + i, g, b] = (a + n, c + pos)
    got = {(r["seed"], r["g"], r["bits"]): (r["n"], r["pos"]) for r in seed_sums(df, first, last, ["n", "pos"], ["g"]).collect()}
    assert got == want
    plan = seed_sums(df, first, last, ["n"])._jdf.queryExecution().toString()
    assert "Generate" not in plan and seed_sums(df.limit(0), first, last, ["n"]).count() == 0


def test_validators_store_shared_tables_once_and_sort_no_texts(spark, tmp_path, monkeypatch):
    from pairloom.operators.pairs import split_ambiguous
    from pairloom.plans import split_queries

    staged = []
    monkeypatch.setattr(
        split_queries, "stage", lambda df, label: staged.append((label, df)) or stage(df, label)
    )
    split_queries.broken_tables(spark, "/root/testdata/sf0.001", "evidence", "pairs")
    # The evidence is read for the kept rows and the nodes, and all else comes from what is stored.
    reads = {label: [f for f in df.inputFiles() if "lineitem" in f] for label, df in staged}
    assert [label for label, files in reads.items() if files] == ["kept", "nodes"]
    kept = dict(staged)["kept"]
    assert "SortAggregate" not in kept._jdf.queryExecution().executedPlan().toString()


def test_torn_records_with_nulls(frame):
    from pairloom.operators.validate import validate_evidence

    schema = "evidence_id string, pair_id string, polarity string, source_database string, source_version string, source_record_id string, interaction_type string, detection_method string"
    pairs = [("R1", "P1", "positive"), ("R1", "P1", "positive"), ("R2", "P1", "positive"), ("R2", "P1", None),
             ("R3", None, "positive"), ("R3", "positive", None), ("R4", None, None), ("R4", None, None)]
    evidence = frame([(f"E{i}", p, q, "d", "1", r, "", "") for i, (r, p, q) in enumerate(pairs)], schema)
    found = validate_evidence(evidence, frame([("P1",)], "pair_id string"))
    torn = {r.key for r in found.collect() if r.rule_id == "contradictory_source_record"}
    assert torn == {"d|1|R2", "d|1|R3"}
