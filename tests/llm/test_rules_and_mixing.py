import math
import random
from collections import Counter
from fractions import Fraction

import pytest
from cases import SCHEMA, WORD, documents, with_extras, words_of
from pyspark.sql import functions as F

from pairloom.llm import mixing, quality_rules
from pairloom.llm.quality_rules import CURRENT, POLICIES, Policy


def measured(text):
    t = text or ""
    w = words_of(t)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
    )


def test_measurements_equal_definition(spark):
    rows = documents() + [(9001, "a b c a b c a b", "a"), (9002, "x x x x x x\nx\n x\nx", "a")]
    df = with_extras(spark.createDataFrame(rows, SCHEMA))
    ledger = quality_rules.rule_ledger(df)
    got = ledger.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failure_bits").collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *measured(t)) for i, t, _ in rows)
    for r in got:
        assert bool(r.failure_bits & 3) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality_rules.rule_ledger(df.limit(0)).count() == 0
    assert {"kind", "line", "shard"} <= set(ledger.columns)


def test_policies_and_ablations(spark):
    rows = [(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 4, 8, 12, 16, 32, 63])]
    ledger = spark.createDataFrame(rows, "doc_id bigint, failure_bits bigint")
    place = {r.name: k for k, r in enumerate(quality_rules.rules())}
    for p in POLICIES:
        mask = sum(1 << place[r] for r in p.rules)
        kept = {r.doc_id for r in ledger.where(quality_rules.passes(p)).collect()}
        assert kept == {i for i, b in rows if b & mask == 0}
    for r in quality_rules.ablations(ledger).collect():
        mask = sum(1 << place[n] for n in next(p for p in POLICIES if p.version == r.version).rules)
        bit = 1 << place[r.rule]
        assert r.n_kept == sum(b & mask == 0 for _, b in rows)
        assert r.n_kept_without == sum(b & mask & ~bit == 0 for _, b in rows)
        assert r.n_rejected_alone == r.n_kept_without - r.n_kept


def test_filter_on_the_verdict_stays_cheap(spark):
    df = spark.createDataFrame([(1, "word " * 400, "a"), (2, " ".join(f"w{i}" for i in range(400)), "a")], SCHEMA)
    kept = quality_rules.rule_ledger(df).where(quality_rules.passes(CURRENT)).select("doc_id").collect()
    assert [r[0] for r in kept] == [2]
    assert quality_rules.rule_ledger(df).where(quality_rules.passes(Policy("none", ()))).count() == 2


@pytest.mark.parametrize("seed", range(6))
def test_seats_are_the_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for g in range(8):
        n = rng.randint(1, 9)
        votes = [rng.choice([0.0, 1.0, 2.5, rng.random() * 60, float(rng.randint(1, 20))]) for _ in range(n)]
        caps = [rng.choice([0, 1, 3, 40, 200]) for _ in range(n)]
        house = rng.randint(0, 60)
        names = [None if i == 3 else f"s{i}" for i in range(n)]
        rows += [(g, a, v, house, c) for a, v, c in zip(names, votes, caps)]
        bids = sorted(
            (-Fraction(v) / (2 * k + 1), -v, a is None, a or "", i)
            for i, (a, v, c) in enumerate(zip(names, votes, caps))
            if v > 0
            for k in range(c)
        )
        won = Counter(b[4] for b in bids[:house])
        for i, a in enumerate(names):
            want[g, a] = won[i]
    df = spark.createDataFrame(rows, "g int, source string, votes double, house bigint, cap bigint")
    got = {(r.g, r.source): r.seats for r in mixing.sainte_lague(df, "g", "source", "votes", "house", "cap").collect()}
    assert got == want


def shared_out(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(names)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > most * sizes[s]]
        if not over:
            return {**fixed, **{s: weight[s] * level for s in free}}
        fixed.update({s: Fraction(most * sizes[s]) for s in over})


def test_mix(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "ü", "Z", None])) for i in range(600)]
    rows += [(9000 + i, "v " * 2000, "hot") for i in range(60)] + [(9999, None, "empty"), rows[5], (None, "x y", "b")]
    df = with_extras(spark.createDataFrame(rows, SCHEMA))
    got = mixing.mix(df, shard_words=1 << 14).collect()
    size = lambda t: len(words_of(t))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = shared_out(dict(sizes))
    source = {i: s for i, _, s in rows}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        assert math.isclose(r.target, float(targets[source[r.doc_id]]), rel_tol=1e-9, abs_tol=1e-6)
        taken[source[r.doc_id]] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(0.03 * t, 64), (s, taken[s], float(t))
    again = mixing.mix(df.repartition(7), shard_words=1 << 14).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mix_of_little(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in empty) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    one = mixing.mix(spark.createDataFrame([(1, "a b c d e f g h", "x")], SCHEMA)).collect()
    assert [(r.target, r.taken) for r in one] == [(8.0, 8)]
