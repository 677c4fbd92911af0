import math
import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pairloom.functions.arrays import window_starts
from pairloom.operators.features import (
    build_examples,
    composition_vectors,
    pool_windows,
    validate_vectors,
    validate_windows,
)
from pairloom.operators.ledger import (
    distribution,
    gpu_models,
    ledger_coverage,
    ledger_items,
    ledger_runs,
    ledger_status,
    listed_ids,
    set_coverage,
    validate_ledger,
)
from pairloom.operators.model import (
    LogisticFit,
    balanced_weights,
    certificate,
    early_stop,
    fit_logistic,
    fit_prepared,
    grid_scores,
    prepare,
    select_and_refit,
)

ITEMS = (
    "method string, seed int, stage string, pair_id string, status string, gpu_count int, gpu_model string, "
    "peak_gpu_memory_mib double, wall_time_seconds double, preprocessing_seconds double, output_bytes bigint, "
    "input_residues int, input_sha256 string, command_sha256 string, stdout_sha256 string"
)
D = "a" * 64


def item(pair, status="success", seed=42, wall=10.0, **changes):
    row = dict(method="m", seed=seed, stage="s", pair_id=pair, status=status, gpu_count=1, gpu_model="g", peak=100.0, wall=wall, pre=1.0, out=5, res=30, i=D, c=D, o=D)
    row.update(changes)
    return tuple(row.values())


def test_item_summary(frame):
    df = frame([item("a"), item("b", "failure", wall=30.0), item("z", res=99)], ITEMS)
    expected = frame([("a",), ("b",), ("c",)], "pair_id string")
    row = ledger_items(df, expected).first().asDict()
    assert (row["attempted_items"], row["successful_items"], row["failed_items"], row["expected_items"]) == (3, 2, 1, 3)
    assert (row["missing_items"], row["unexpected_items"], row["attempt_coverage_complete"]) == (1, 1, False)
    assert math.isclose(row["total_gpu_hours"], 50 / 3600) and math.isclose(row["successful_items_per_wall_hour"], 2 / (20 / 3600))
    assert (row["residues_min"], row["residues_max"], row["total_output_bytes"]) == (30, 99, 15)
    assert rows_of(ledger_coverage(df, expected).select("issue", "pair_id")) == [("failed", "b"), ("missing", "c"), ("unexpected", "z")]
    many = frame([(f"{i:03d}",) for i in range(50)], "pair_id string")
    first = {r["issue"]: r["first_ids"] for r in listed_ids(ledger_coverage(df, many)).collect()}
    assert first["missing"] == ";".join(f"{i:03d}" for i in range(20))
    assert rows_of(gpu_models(df).select("gpu_model")) == [("g",)]


def test_runs_status_and_sets(frame):
    seeds = [42, 123, 999]
    full = [item(p, seed=s) for p in "ab" for s in seeds]
    df = frame(full, ITEMS)
    expected = frame([("a",), ("b",)], "pair_id string")
    runs = ledger_runs(df.drop("pair_id"))
    assert runs.first()["seed_coverage_complete"]
    cover = set_coverage(df, ["method", "stage"], "seed", seeds)
    assert all(r["passed"] for r in ledger_status(ledger_items(df, expected), cover, runs).collect())
    part = df.where("seed <> 999")
    checks = dict(rows_of(ledger_status(ledger_items(part.where("pair_id = 'a'"), expected), set_coverage(part, ["method"], "seed", seeds), ledger_runs(part))))
    assert checks == {
        "attempt_coverage": False, "successful_coverage": False, "no_failed_runs": True, "registered_item_seeds": False, "registered_run_seeds": False,
    }
    unseeded = df.withColumn("seed", F.lit(None).cast("int"))
    assert ledger_runs(unseeded).first()["seed_coverage_complete"]


def test_distribution_of_empty_and_odd_groups(frame):
    df = frame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", None)], "g string, v double")
    got = {r["g"]: tuple(r)[1:] for r in distribution(df, "v", ["g"]).collect()}
    assert got["b"] == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
    n, mean, median, p95, top, total = got["a"]
    assert (n, median, top, total) == (3, 2.0, 10.0, 13.0) and math.isclose(mean, 13 / 3) and math.isclose(p95, 9.2)


@pytest.mark.parametrize(
    "changes,rule",
    [
        ({"status": "odd"}, "invalid_status"),
        ({"gpu_model": " "}, "gpu_row_without_model"),
        ({"peak": 0.0}, "gpu_row_without_memory"),
        ({"wall": 0.0}, "invalid_wall_time_seconds"),
        ({"wall": float("inf")}, "invalid_wall_time_seconds"),
        ({"pre": -1.0}, "invalid_preprocessing_seconds"),
        ({"res": 0}, "invalid_input_residues"),
        ({"o": "zz"}, "invalid_stdout_sha256"),
        ({"method": ""}, "missing_method"),
    ],
)
def test_ledger_rules(frame, changes, rule):
    found = validate_ledger(frame([item("a"), item("b", **changes)], ITEMS), "item")
    assert [r["rule_id"] for r in found.collect()] == [rule]


def test_ledger_duplicates_and_cpu_rows(frame):
    cpu = item("c", gpu_count=0, gpu_model="", peak=None)
    found = validate_ledger(frame([item("a"), item("a"), cpu], ITEMS), "item")
    assert [r["rule_id"] for r in found.collect()] == ["duplicate_ledger_row"]


def test_pooling_matches_numpy(frame):
    rnd = np.random.default_rng(3)
    size, stride, dim = 5, 3, 2
    rows, want = [], {}
    for key, length in (("short", 4), ("exact", 5), ("long", 17), ("edge", 11)):
        starts = [0]
        while starts[-1] + size < length:
            starts.append(starts[-1] + stride)
        sums, counts = np.zeros((length, dim)), np.zeros(length)
        for s in starts:
            block = rnd.normal(size=(min(size, length - s), dim))
            rows.append((key, s, length, block.tolist()))
            sums[s : s + size] += block
            counts[s : s + size] += 1
        want[key] = (sums / counts[:, None]).mean(axis=0)
    df = frame(rows, "entity_id string, window_start int, length int, values array<array<double>>")
    assert validate_windows(df, size, stride).count() == 0
    got = {r["entity_id"]: r["vector"] for r in pool_windows(df, size, stride).collect()}
    for key, vector in want.items():
        np.testing.assert_allclose(got[key], vector, atol=1e-12)
    lost = df.where("not (entity_id = 'long' and window_start = 3)")
    assert [r["rule_id"] for r in validate_windows(lost, size, stride).collect()] == ["windows_incomplete"]
    starts = frame([(17,)], "n int").select(window_starts(F.col("n"), size, stride)).first()[0]
    assert starts == [0, 3, 6, 9, 12]


def test_vector_contract_and_examples(frame):
    vectors = frame([("a", [1.0, 2.0], "h"), ("b", [1.0], "h"), ("c", [1.0, float("nan")], "old"), ("x", [0.0, 0.0], "h")], "entity_id string, vector array<double>, sequence_sha256 string")
    entities = frame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h")], "entity_id string, sequence_sha256 string")
    found = validate_vectors(vectors, entities, 2)
    assert rows_of(found.select("key", "rule_id")) == [
        ("b", "wrong_dimension"), ("c", "not_finite"), ("c", "sequence_digest_mismatch"), ("d", "missing_vector"), ("x", "unexpected_vector")
    ]
    sequences = frame([("a", "AAC"), ("b", "WY")], "entity_id string, sequence string")
    expected = frame([("p", "train", 1, "a", "b"), ("q", "train", 1, "a", "zz"), ("q", "train", 1, "a", "zz")], "pair_id string, partition string, label int, node_a string, node_b string")
    examples, found = build_examples(expected, composition_vectors(sequences))
    assert len(examples.first()["features"]) == 63
    assert {(r["key"], r["rule_id"]) for r in found.collect()} == {
        ("q", "duplicate_assignment"), ("train", "single_label_partition"), ("q", "endpoint_without_vector")
    }


def examples(frame, n=160, seed=0):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        x = rnd.normal(loc=[0.8 * y, 0.0, 5.0], scale=[1.0, 2.0, 0.5]).tolist() + [7.0]
        part = "train" if i % 10 < 6 else "validation" if i % 10 < 8 else "test"
        rows.append((f"p{i}", part, y, x))
    return frame(rows, "pair_id string, partition string, label int, features array<double>")


def newton(x, y, c):
    """Reference solver of 0.5 w'w + C sum of balanced log losses."""
    scale = x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.hstack([(x - x.mean(axis=0)) / scale, np.ones((len(x), 1))])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = penalty @ w + c * z.T @ (weight * (p - y))
        hessian = penalty + c * (z.T * (weight * p * (1 - p))) @ z
        w -= np.linalg.solve(hessian, gradient)
    return w, 1 / (1 + np.exp(-z @ w))


def test_certificate_tells_an_optimum(frame):
    """The gradient against numpy; a fit for another penalty is not stationary."""
    training = prepare(examples(frame))
    fit = fit_prepared(training, 1.0)
    own = certificate(training, fit, 1.0).first()
    assert own["stationary"] and own["parameters"] == len(fit.model.coefficients) + 1
    other = certificate(training, fit, 50.0).first()
    rows = training.rows.collect()
    x, y, w = (np.array([r[k] for r in rows]) for k in ("_x", "label", "weight"))
    b, b0 = np.array(fit.model.coefficients), fit.model.intercept
    pull = w * (1 / (1 + np.exp(-(x @ b + b0))) - y) / w.sum()
    gradient = np.append(x.T @ pull + b / (50.0 * training.n), pull.sum())
    assert not other["stationary"] and np.isclose(other["largest_gradient"], np.abs(gradient).max())
    assert isinstance(fit, LogisticFit)


def test_logistic_matches_newton(frame):
    df = examples(frame)
    rows = df.collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])
    for c in (0.1, 10.0):
        fit = fit_logistic(df, c)
        want, prob = newton(x, y, c)
        np.testing.assert_allclose(fit.model.coefficients.toArray(), want[:-1], atol=1e-4)
        got = {r["pair_id"]: r["score"] for r in fit.score(df).collect()}
        np.testing.assert_allclose([got[r["pair_id"]] for r in rows], prob, atol=1e-4)


def test_weights_grid_and_refit(frame):
    df = examples(frame)
    weights = balanced_weights(df).groupBy("label").agg(F.sum("weight").alias("s")).collect()
    assert all(math.isclose(r["s"], 80.0) for r in weights)
    grid = {r["c"]: r["average_precision"] for r in grid_scores(df.where("partition = 'train'"), df.where("partition = 'validation'"), (0.1, 1.0)).collect()}
    best = min(grid, key=lambda c: (-grid[c], c))
    scored, chosen, _ = select_and_refit(df, grid=(0.1, 1.0))
    assert chosen == best and scored.count() == 32
    # Equal average precisions go to the smaller C.
    same = df.where("partition <> 'validation'").unionByName(df.where("partition = 'validation'").withColumn("label", F.lit(1)))
    assert select_and_refit(same, grid=(0.1, 1.0))[1] == 0.1


def test_early_stop(frame):
    rnd = random.Random(6)
    curves = {f"r{k}": [round(rnd.random(), 1) for _ in range(30)] for k in range(12)}
    curves["flat"] = [0.5] * 20
    curves["short"] = [0.1, 0.2]
    df = frame([(k, e, v) for k, vs in curves.items() for e, v in enumerate(vs, 1)], "run string, epoch int, metric double")
    got = {r["run"]: (r["best_epoch"], r["best_metric"], r["stopped_epoch"]) for r in early_stop(df, ["run"], patience=5).collect()}
    for run, values in curves.items():
        best, at, waited = -1.0, 0, 0
        for epoch, v in enumerate(values, 1):
            waited += 1
            if v > best:
                best, at, waited = v, epoch, 0
            if waited >= 5:
                break
        assert got[run] == (at, best, epoch), run
