import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """Full searches in whole Python numbers: {row number: (code, error)}, codebook."""
    kept = [(i, r) for i, r in enumerate(rows) if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    dim = max([len(r[1]) for _, r in kept], default=0)
    dim = -(-max(dim, 1) // parts) * parts
    w = dim // parts
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (dim - len(r[1])) for i, r in kept}
    first = {}
    for _, r in sorted(kept, key=lambda e: (e[1][0] is None, e[1][0] or 0, [float(np.float32(x)) for x in e[1][1]])):
        first.setdefault(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (dim - len(r[1])))
    seeds = list(first.values())[:entries]
    books = [[s[p * w : p * w + w] for s in seeds] for p in range(parts)]

    def assign():
        return {
            i: [min((sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            for i, v in whole.items()
        }

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            groups = defaultdict(list)
            for i, found in got.items():
                groups[found[p][1]].append(whole[i][p * w : p * w + w])
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    got = assign()
    text = ",".join(str(x) for book in books for e in book for x in e)
    return (
        {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in got.items()},
        hashlib.sha256(text.encode()).hexdigest(),
    )


def table(rng, n, dim, scale=0.2):
    rows = [(i * 7 % n, [rng.gauss(0, scale) for _ in range(dim)], rng.choice([1, 2, None])) for i in range(n)]
    rows += [(n + 1, rows[0][1], 1), rows[5], (None, rows[3][1], 2), (n + 2, None, 1), (n + 3, [None] * dim, 1)]
    rows += [(-4, [math.nan] + [0.0] * (dim - 1), 1), (-3, [math.inf] * dim, 2), (-2, [0.5] * (dim - 3), 2), (-1, [], None)]
    return rows + [(2 * n + i, [round(x * 4) / 4 for x in rows[i][1]], 3) for i in range(n // 3)]  # many ties


@pytest.mark.parametrize("parts,entries,rounds,groups,dim", [(16, 64, 2, 4, 64), (4, 7, 5, 3, 10), (3, 300 // 2, 3, 1, 9), (2, 5, 0, 9, 4)])
def test_codes_are_those_of_a_full_search(spark, parts, entries, rounds, groups, dim):
    rng = random.Random(dim)
    rows = table(rng, 120, dim)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "vector", "code", "sums", "whole", "error")})
    made = vc.compress(df.repartition(3), parts=parts, entries=entries, rounds=rounds, groups=groups)
    want, digest = plain(rows, parts, entries, rounds)
    assert made.digest() == digest
    got = made.rows.collect()
    assert sorted([(r.id, r.label, r.code, r.error) for r in got], key=repr) == sorted(
        [(rows[i][0], rows[i][2], *x) for i, x in want.items()], key=repr
    )
    totals = defaultdict(int)
    for r in got:
        totals[r.label] += r.error
    with_totals = vc.with_label_error(made.rows).collect()
    assert len(with_totals) == len(got) and all(r.label_error == totals[r.label] for r in with_totals)


@pytest.mark.parametrize("small", [True, False])
def test_bounds_hold_and_save_distances(small):
    """Moves of many kinds: bounds never exclude the nearest entry, and rounds with
    settled entries measure next to nothing."""
    rng = np.random.default_rng(7)
    x = rng.integers(-300, 300, (400, 3))
    books = [rng.integers(-300, 300, (20, 3))]
    kept = vc.Bounds.open(len(x), 4)
    costs = []
    for t in range(9):
        best, cost = vc.nearest(x, np.stack(books), kept, small, last=t == 8)
        full = vc.squares(x, books[-1], small)
        assert (kept.code == full.argmin(1)).all()
        if t == 8:
            assert (best == full.min(1)).all()
        costs.append(cost.mean())
        # Entries go away and come back: their net move is zero, the sum of moves is not.
        books.append(books[0] if t % 2 else books[0] + rng.integers(-9, 9, books[0].shape))
    assert costs[0] == 21 and costs[2] < 6 and costs[4] < 6


def test_net_moves_are_used():
    """Forty away and back: added up, the moves would let the bounds meet (80 and 20)."""
    x = np.array([[0, 0], [100, 0]])
    home = np.array([[0, 0], [100, 0], [50, 400], [60, 400]])
    away = home + np.array([[0, 40]] * 4)
    kept = vc.Bounds.open(2, 2)
    for t, books in enumerate(([home], [home, away], [home, away, home])):
        _, cost = vc.nearest(x, np.stack(books), kept, True, False)
        assert (cost > 0).all() if t == 0 else (cost == 0).all()
    assert kept.near_round.tolist() == [0, 0] and kept.code.tolist() == [0, 1]


def test_large_components_and_empty_tables(spark):
    rows = [(i, [float(i * 4001), -8000.5 * i, 3.0], None) for i in range(40)]
    made = vc.compress(spark.createDataFrame(rows, SCHEMA), parts=3, entries=6)
    want, digest = plain(rows, 3, 6, 2)
    assert made.digest() == digest
    assert {(r.id, r.code, r.error) for r in made.rows.collect()} == {(rows[i][0], *x) for i, x in want.items()}
    for none in ([], [(1, None, 1)]):
        made = vc.compress(spark.createDataFrame(none, SCHEMA))
        assert made.history == [] and vc.with_label_error(made.rows).count() == 0
    with pytest.raises(OverflowError):
        vc.compress(spark.createDataFrame([(1, [1e30], 1)], SCHEMA))


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = plain(rows, 16, 64, 2)
    got = vc.op11_vector_codes(spark, sf).collect()
    assert {(r.vec_id, r.code, r.error) for r in got} == {(rows[i][0], *x) for i, x in want.items()}
    assert {r.codebooks_sha256 for r in got} == {digest}
    totals = defaultdict(int)
    for i, (_, error) in want.items():
        totals[rows[i][2]] += error
    assert {r.vec_id: r.label_error for r in got} == {rows[i][0]: totals[rows[i][2]] for i in want}
