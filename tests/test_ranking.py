import hashlib
import math
import random
import statistics

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pairloom.operators import bootstrap
from pairloom.operators.decisions import (
    compare,
    comparison_suite,
    gate_passed,
    noninferiority,
    paired_deltas,
    seed_summary,
    support,
)
from pairloom.operators.ordered import hash_ranked, quantiles, running_totals, smallest_per_group
from pairloom.operators.ranking import (
    average_precision,
    constant_reference,
    metric_at_k,
    metrics,
    stratified_metrics,
    validate_predictions,
)


def expected_ranks(rows):
    """Every order of tied rows averaged: (score, n, positives) descending."""
    table = {}
    for label, score in rows:
        n, p = table.get(score, (0, 0))
        table[score] = (n + 1, p + label)
    return [(s, *table[s]) for s in sorted(table, reverse=True)]


def brute(rows):
    """Metric values straight from their definitions."""
    n, pos = len(rows), sum(y for y, _ in rows)
    neg = n - pos
    groups = expected_ranks(rows)
    out = {"n": n, "positives": pos, "negatives": neg}
    if pos:
        total = 0.0
        for s, _, p in groups:
            at_least = [y for y, x in rows if x >= s]
            total += p / pos * sum(at_least) / len(at_least)
        out["average_precision"] = total
        curve = [(0.0, 1.0)]
        for s, _, _ in groups:
            at_least = [y for y, x in rows if x >= s]
            curve.append((sum(at_least) / pos, sum(at_least) / len(at_least)))
        out["pr_auc_trapezoid"] = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    if pos and neg:
        wins = sum((x > z) + 0.5 * (x == z) for y, x in rows if y for w, z in rows if not w)
        out["auroc"] = wins / (pos * neg)
        weight = lambda r: math.exp(-20 * r / n)
        start, seen = 1, 0.0
        for _, size, p in groups:
            seen += p / size * sum(weight(r) for r in range(start, start + size))
            start += size
        best = sum(weight(r) for r in range(1, pos + 1))
        worst = sum(weight(r) for r in range(n - pos + 1, n + 1))
        out["bedroc_alpha_20"] = min(1.0, max(0.0, (seen - worst) / (best - worst)))

    def hits(k):
        left, got = min(k, n), 0.0
        for _, size, p in groups:
            use = min(left, size)
            got += use * p / size
            left -= use
        return got

    for k in (50, 100):
        out[f"precision_at_{k}"] = hits(k) / min(k, n)
        if pos:
            out[f"recall_at_{k}"] = hits(k) / pos
    k1 = max(1, math.ceil(n * 0.01))
    if pos:
        out["ef_at_1_percent"] = hits(k1) / min(k1, n) / (pos / n)
    if all(0 <= x <= 1 for _, x in rows):
        out["brier_score"] = sum((x - y) ** 2 for y, x in rows) / n
        bins = {}
        for y, x in rows:
            bins.setdefault(min(int(x * 10), 9), []).append((y, x))
        out["ece_10_equal_width"] = sum(
            len(b) / n * abs(sum(y for y, _ in b) / len(b) - sum(x for _, x in b) / len(b)) for b in bins.values()
        )
    return out


def cases():
    rnd = random.Random(11)
    tied = [(rnd.random() < 0.3, rnd.randrange(8) / 7) for _ in range(140)]
    return {
        "perfect": [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)],
        "reversed": [(0, 0.9), (0, 0.8), (1, 0.2), (1, 0.1)],
        "all_tied": [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)],
        "no_positive": [(0, 0.1), (0, 0.7)],
        "no_negative": [(1, 0.1), (1, 1.0)],
        "out_of_unit": [(1, 2.0), (0, -1.0), (1, 0.5)],
        "tied": [(int(y), s) for y, s in tied],
        "distinct": [(int(rnd.random() < 0.25), rnd.random()) for _ in range(230)],
    }


def test_metrics_match_definitions(frame):
    data = [(name, y, float(s)) for name, rows in cases().items() for y, s in rows]
    df = frame(data, "slice string, label int, score double")
    for shuffled in (df, df.repartition(7, "score")):
        got = {r["slice"]: r.asDict() for r in metrics(shuffled, ["slice"]).collect()}
        for name, rows in cases().items():
            want = brute(rows)
            for metric, value in got[name].items():
                if metric in ("slice", "k_at_1_percent", "prevalence"):
                    continue
                if metric in want:
                    assert math.isclose(value, want[metric], abs_tol=1e-9), (name, metric, value, want[metric])
                else:
                    assert value is None, (name, metric, value)


def test_known_values(frame):
    df = frame([("a", y, s) for y, s in cases()["perfect"]], "g string, label int, score double")
    row = metrics(df).first()
    assert row["average_precision"] == 1.0 and row["auroc"] == 1.0 and row["bedroc_alpha_20"] == 1.0
    tied = frame([(y, s) for y, s in cases()["all_tied"]], "label int, score double")
    row = metrics(tied).first()
    assert row["average_precision"] == 0.5 and row["auroc"] == 0.5
    got = {r["k"]: (r["expected_hits"], r["precision"], r["recall"]) for r in metric_at_k(tied, [1, 3, 9]).collect()}
    assert got == {1: (0.5, 0.5, 0.25), 3: (1.5, 0.5, 0.75), 9: (2.0, 0.5, 1.0)}


def test_strata_keep_all_positives(frame):
    rnd = random.Random(3)
    rows = []
    for i in range(90):
        y = int(rnd.random() < 0.5)
        rows.append((y, rnd.randrange(10) / 10, "p" if y else rnd.choice(["curated_negative", "screen_negative"])))
    df = frame(rows, "label int, score double, evidence_class string")
    got = {r["stratum"]: r["average_precision"] for r in stratified_metrics(df).collect()}
    assert set(got) == {"positives_vs_curated_negative", "positives_vs_screen_negative"}
    for name, value in got.items():
        keep = [(y, s) for y, s, k in rows if y == 1 or f"positives_vs_{k}" == name]
        assert math.isclose(value, brute(keep)["average_precision"], abs_tol=1e-12)
    by = {
        (r["half"], r["stratum"]): r["auroc"]
        for r in stratified_metrics(df.withColumn("half", F.lit("x")), ["half"]).collect()
    }
    assert set(by) == {("x", n) for n in got}


def test_validation_and_constant_reference(frame):
    cols = "pair_id string, label string, score string, partition string, evidence_class string, bootstrap_group string"
    df = frame(
        [("a", "1", "0.5", "test", "p", ""), ("a", "0", "inf", "test", "n", "g"), (" ", "2", "x", " test", "n", "g"), ("z", "9", "q", "train", "n", "g")],
        cols,
    )
    typed, found = validate_predictions(df, "test")
    assert {(r["key"], r["rule_id"]) for r in found.collect()} == {
        ("a", "score_not_finite"), ("", "missing_pair_id"), ("", "label_not_binary"), ("", "score_not_finite"), ("a", "duplicate_pair_id")
    }
    assert [r["bootstrap_group"] for r in typed.where("score = 0.5").collect()] == ["a"]
    assert [r["rule_id"] for r in validate_predictions(df, "validation")[1].collect()] == ["empty_partition"]
    pairs = frame([("a", 1, "p", ""), ("b", 0, "n", "G"), ("c", 1, "p", "")], "pair_id string, label int, evidence_class string, complex_group_id string")
    splits = frame([("a", "test"), ("b", "test"), ("c", "train")], "pair_id string, partition string")
    reference = constant_reference(pairs, splits)
    assert rows_of(reference.select("pair_id", "bootstrap_group")) == [("a", "a"), ("b", "G")]
    assert metrics(reference).first()["average_precision"] == 0.5


def test_running_totals_and_quantiles(frame):
    rnd = random.Random(2)
    rows = [(g, rnd.randrange(40), rnd.randrange(100)) for g in "ab" for _ in range(150)]
    unique = {}
    for g, o, v in rows:
        unique[(g, o)] = v
    df = frame([(g, o, v) for (g, o), v in unique.items()], "g string, o int, v int")
    got = {(r["g"], r["o"]): (r["cum_v"], r["all_v"]) for r in running_totals(df, ["g"], [F.col("o").desc()], ["v"]).collect()}
    for (g, o), _ in unique.items():
        upto = sum(v for (h, p), v in unique.items() if h == g and p >= o)
        total = sum(v for (h, _), v in unique.items() if h == g)
        assert got[(g, o)] == (upto, total)
    values = frame([(g, float(v)) for g, _, v in rows] + [("a", None)], "g string, v double")
    want = values.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("m"), F.expr("percentile(v, 0.95)").alias("p"))
    have = quantiles(values, ["g"], "v", {"m": 0.5, "p": 0.95})
    for a, b in zip(rows_of(have), rows_of(want)):
        assert a[0] == b[0] and math.isclose(a[1], b[1]) and math.isclose(a[2], b[2])


def test_hash_ranked_equals_sorting(frame):
    ids = [(g, f"id{i}") for g in "xy" for i in range(200)]
    df = frame(ids, "g string, id string").withColumn("h", F.sha2(F.concat("g", "id"), 256))
    limit = frame([("x", 30), ("y", 5)], "g string, k int")
    got = sorted((r["g"], r["hash_rank"], r["id"]) for r in hash_ranked(df, ["g"], "h", "id", limit, "k").collect())
    want = []
    for g, k in (("x", 30), ("y", 5)):
        order = sorted((hashlib.sha256((g + i).encode()).hexdigest(), i) for h, i in ids if h == g)
        want += [(g, n, i) for n, (_, i) in enumerate(order[:k], 1)]
    assert got == sorted(want)


def test_smallest_per_group_limits_before_the_shuffle(frame):
    df = frame([(g, f"{i:03d}") for g in "ab" for i in range(99)], "g string, v string")
    out = smallest_per_group(df, ["g"], "v", 3)
    assert rows_of(out) == [("a", ["000", "001", "002"]), ("b", ["000", "001", "002"])]
    assert "WindowGroupLimit" in out._jdf.queryExecution().toString()


def draws(seed, replicate, groups):
    out = []
    for j in range(len(groups)):
        digest = hashlib.sha256(f"{seed}:{replicate}:{j}".encode()).digest()
        out.append(groups[math.floor(int.from_bytes(digest[:8], "big") / 2**64 * len(groups))])
    return out


def percentile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    lo, hi = math.floor(at), math.ceil(at)
    return values[lo] * (1 - (at - lo)) + values[hi] * (at - lo)


def ledger_rows():
    rnd = random.Random(8)
    return [(f"g{rnd.randrange(9)}", int(rnd.random() < 0.4), rnd.randrange(12) / 11, rnd.randrange(12) / 11) for _ in range(80)]


@pytest.mark.parametrize("replicates,batch", [(40, 2000), (40, 16), (37, 16)])
def test_bootstrap_matches_resampling(frame, replicates, batch):
    rows = ledger_rows()
    df = frame(rows, "bootstrap_group string, label int, score_candidate double, score_baseline double")
    groups = sorted({g for g, *_ in rows})
    deltas, singles = [], []
    for r in range(replicates):
        sample = [row for g in draws(5, r, groups) for row in rows if row[0] == g]
        if any(y for _, y, _, _ in sample):
            cand = brute([(y, c) for _, y, c, _ in sample])["average_precision"]
            base = brute([(y, b) for _, y, _, b in sample])["average_precision"]
            deltas.append(cand - base)
            singles.append(cand)
    got = bootstrap.bootstrap_delta(df, [], replicates, 5, batch=batch).first()
    assert got["replicates_requested"] == replicates and got["replicates_valid"] == len(deltas)
    assert math.isclose(got["lower_95"], percentile(deltas, 0.025), abs_tol=1e-9)
    assert math.isclose(got["upper_95"], percentile(deltas, 0.975), abs_tol=1e-9)
    one = bootstrap.bootstrap_average_precision(df.withColumnRenamed("score_candidate", "score"), [], replicates, 5, batch=batch).first()
    assert math.isclose(one["lower_95"], percentile(singles, 0.025), abs_tol=1e-9)


NAMED = ["average_precision", "pr_auc_trapezoid", "auroc", "bedroc_alpha_20", "recall_at_50", "brier_score", "ef_at_1_percent", "ece_10_equal_width"]


def test_bootstrap_of_named_metrics(frame):
    """Every metric of every replicate against the metric of the copied rows."""
    rows = ledger_rows()
    df = frame(rows, "bootstrap_group string, label int, score_candidate double, score_baseline double")
    groups = sorted({g for g, *_ in rows})
    want = {}
    for r in range(37):
        sample = [row for g in draws(5, r, groups) for row in rows if row[0] == g]
        for side, at in (("score_candidate", 2), ("score_baseline", 3)):
            want[side, r] = brute([(row[1], row[at]) for row in sample])
    values = bootstrap.replicate_metrics(df, [], ["score_candidate", "score_baseline"], NAMED, 37, 5).collect()
    assert len(values) == len(want)
    for row in values:
        for m in NAMED:
            x, y = row[m], want[row["score_name"], row["replicate"]][m]
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=1e-9)), (m, row["replicate"])
    got = {r["metric"]: r for r in bootstrap.bootstrap_deltas(df, [], NAMED, 37, 5).collect()}
    for m in NAMED:
        deltas = [want["score_candidate", r][m] - want["score_baseline", r][m] for r in range(37) if want["score_candidate", r][m] is not None]
        assert got[m]["replicates_valid"] == len(deltas)
        assert math.isclose(got[m]["lower_95"], percentile(deltas, 0.025), abs_tol=1e-9)
        assert math.isclose(got[m]["upper_95"], percentile(deltas, 0.975), abs_tol=1e-9)


def test_bootstrap_of_slices_and_of_nothing(frame):
    rows = [(i % 2, *r) for i, r in enumerate(ledger_rows())] + [(2, "g0", 0, 0.5, 0.5)]
    df = frame(rows, "seed int, bootstrap_group string, label int, score double, score_baseline double")
    both = bootstrap.bootstrap_intervals(df, ["seed"], ["auroc", "brier_score"], 20, 3)
    got = {(r["seed"], r["metric"]): r for r in both.collect()}
    one = {r["metric"]: r for r in bootstrap.bootstrap_intervals(df.where("seed = 1"), [], ["auroc", "brier_score"], 20, 3).collect()}
    assert len(got) == 6 and got[2, "auroc"]["replicates_valid"] == 0 and got[2, "auroc"]["lower_95"] is None
    for m in one:
        assert math.isclose(got[1, m]["lower_95"], one[m]["lower_95"]) and got[1, m]["replicates_valid"] == one[m]["replicates_valid"]
    none = bootstrap.bootstrap_intervals(df, ["seed"], ["auroc"], 0, 3).collect()
    assert sorted((r["seed"], r["replicates_requested"], r["replicates_valid"], r["lower_95"]) for r in none) == [(s, 0, 0, None) for s in range(3)]


def test_bootstrap_counts_replicates_without_positives_as_invalid(frame):
    rows = [("g0", 1, 0.9)] + [(f"g{i}", 0, 0.1 * i) for i in range(1, 5)]
    df = frame(rows, "bootstrap_group string, label int, score double")
    groups = sorted({g for g, *_ in rows})
    valid = sum("g0" in draws(1, r, groups) for r in range(64))
    got = bootstrap.bootstrap_average_precision(df, [], 64, 1).first()
    assert 0 < valid < 64 and got["replicates_valid"] == valid


def test_bootstrap_means(frame):
    rnd = random.Random(4)
    rows = [(f"g{rnd.randrange(6)}", rnd.random()) for _ in range(40)]
    df = frame(rows, "bootstrap_group string, v double")
    groups = sorted({g for g, _ in rows})
    means = []
    for r in range(30):
        sample = [v for g in draws(2, r, groups) for h, v in rows if h == g]
        means.append(sum(sample) / len(sample))
    got = bootstrap.bootstrap_means(df, [], {"m": F.col("v")}, 30, 2).first()
    assert math.isclose(got["lower_95"], percentile(means, 0.025)) and math.isclose(got["upper_95"], percentile(means, 0.975))


def test_seed_summary(frame):
    df = frame([(1, 0.2, 0.1), (2, 0.4, None), (3, 0.9, 0.3)], "seed int, x double, y double")
    got = {r["metric"]: r for r in seed_summary(df, [], ["x", "y"]).collect()}
    assert math.isclose(got["x"]["mean"], 0.5) and math.isclose(got["x"]["sample_sd"], statistics.stdev([0.2, 0.4, 0.9]))
    assert got["y"]["mean"] is None and got["y"]["n_seeds"] == 3
    single = seed_summary(df.limit(1), [], ["x"]).first()
    assert single["sample_sd"] == 0.0


def test_compare_reports_mismatches(frame):
    cols = "pair_id string, label int, score double, bootstrap_group string"
    a = frame([("p", 1, 0.9, "g"), ("q", 0, 0.5, "g"), ("r", 1, 0.1, "g")], cols)
    b = frame([("p", 1, 0.1, "g"), ("q", 1, 0.5, "h"), ("s", 1, 0.1, "g")], cols)
    deltas, found = compare(a, b)
    assert {(r["key"], r["rule_id"]) for r in found.collect()} == {
        ("q", "label_mismatch"), ("q", "bootstrap_group_mismatch"), ("r", "missing_baseline"), ("s", "missing_candidate")
    }
    same, found = compare(a, a.withColumn("score", F.lit(0.5)))
    assert found.count() == 0
    row = same.first()
    assert math.isclose(row["baseline_ap"], 2 / 3) and math.isclose(row["relative_delta"], row["absolute_delta"] / (2 / 3))


def test_suite_and_support(frame):
    rows = ledger_rows()
    scored = [
        (seed, f"p{i}", y, "k", g, min(1.0, y * 0.6 + 0.2 * (seed % 2) * c), b)
        for seed in (42, 123, 999)
        for i, (g, y, c, b) in enumerate(rows)
    ]
    cols = "seed int, pair_id string, label int, evidence_class string, bootstrap_group string, score_candidate double, score_baseline double"
    preds = frame(scored, cols)
    members = preds.where("seed = 42").select(F.lit("full").alias("cohort"), "pair_id", "label", "evidence_class", "bootstrap_group")
    suite, found = comparison_suite(preds, members, replicates=32, seed=9)
    assert found.count() == 0
    rows_by_seed = {r["seed"]: r for r in suite.collect()}
    assert set(rows_by_seed) == {42, 123, 999} and all(r["replicates_valid"] == 32 for r in rows_by_seed.values())
    assert support(suite).first()["claim_supported"]
    weak = suite.withColumn("lower_95", F.when(F.col("seed") == 42, F.lit(None)).otherwise(F.col("lower_95")))
    assert not support(weak).first()["claim_supported"]
    _, found = comparison_suite(preds.where("not (seed = 42 and pair_id = 'p1')"), members, replicates=16, seed=9)
    assert sorted(r["rule_id"] for r in found.collect()) == ["incomplete_slice", "missing_prediction"]


def test_gaps_of_seeds_and_cohorts(frame):
    rows = ledger_rows()[:30]
    scored = [(s, f"p{i}", y, "k", g, 0.9 * y + 0.05, b) for s in (42, 123, 7) for i, (g, y, c, b) in enumerate(rows)]
    cols = "seed int, pair_id string, label int, evidence_class string, bootstrap_group string, score_candidate double, score_baseline double"
    preds = frame(scored + [scored[0]], cols)
    members = preds.where("seed = 7").select(F.lit("full").alias("cohort"), "pair_id", "label", "evidence_class", "bootstrap_group")
    suite, found = comparison_suite(preds, members, replicates=16, seed=9, names=["full", "other"])
    assert {(r["rule_id"], r["key"]) for r in found.collect()} == {
        ("missing_cohort", "other"), ("missing_seed", "full|999"), ("repeated_pairs", "full|42"), ("unregistered_seed", "7"),
        ("duplicate_prediction", "42|p0"),
    }
    assert [(r["cohort"], r["seed"]) for r in suite.collect()] == [("full", 123)]
    claims = {r["cohort"]: (r["n_seeds"], r["missing_seeds"], r["claim_supported"]) for r in support(suite, names=["full", "other"]).collect()}
    assert claims == {"full": (1, 2, False), "other": (0, 3, False)}
    assert support(suite, seeds=[123]).first()["claim_supported"]


def test_noninferiority_gate(frame):
    rows = [(f"g{i}", 0.5, 0.5 + (i % 3 - 1) * 0.001, False, False) for i in range(30)]
    cols = "bootstrap_group string, baseline_q double, candidate_q double, baseline_x boolean, candidate_x boolean"
    good = frame(rows, cols)
    assert gate_passed(noninferiority(good, "q", ["x"], replicates=64, seed=1)).first()["passed"]
    failing = frame(rows[:-1] + [("g29", 0.5, 0.5, False, True)], cols)
    checks = {r["check"]: r["passed"] for r in noninferiority(failing, "q", ["x"], replicates=64, seed=1).collect()}
    assert not checks.pop("no_new_failures") and all(checks.values())
    worse = good.withColumn("candidate_q", F.lit(0.2))
    checks = {r["check"]: r["passed"] for r in noninferiority(worse, "q", ["x"], replicates=64, seed=1).collect()}
    assert checks == {
        "point_delta": False, "lower_95_delta": False, "acceptable_share_delta": False,
        "lower_95_acceptable_share": False, "no_new_failures": True,
    }
    deltas = {r["measure"]: r["delta_mean"] for r in paired_deltas(worse, ["q"], "q").collect()}
    assert math.isclose(deltas["q"], -0.3) and deltas["q_acceptable"] == -1.0


def test_average_precision_by_slice(frame):
    data = [(n, y, float(s)) for n, rows in cases().items() for y, s in rows]
    got = {r["slice"]: r["average_precision"] for r in average_precision(frame(data, "slice string, label int, score double"), ["slice"]).collect()}
    assert got["no_positive"] is None and got["no_negative"] == 1.0
