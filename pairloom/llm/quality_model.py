"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on each document: bad, good or nothing.
Expectation-maximisation over the counts of vote patterns estimates how often each
labeller votes and is right, from agreement alone; the posterior of a pattern is a
soft label. A linear scorer over hashed words and word shapes is fitted to the
posteriors of a bounded sample and then scores every whole text.

Two such models are built, for low quality and for abuse, and a document is kept
where both scores are below their threshold.

Null and empty texts have no features; they get the score of the intercept and
are not kept, as a text without words has no quality. Repeated rows score alike.
An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table
from pairloom.llm.quality_rules import measure
from pairloom.llm.words import Powers, chunks, mix, words
from pairloom.runtime import stage

#: Documents that the scorers are fitted on, at most; those of lowest seeded hash.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 18
#: The measurements of the quality rules that labellers read.
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_upper", "n_distinct")
ROUNDS = 40
SEED = 23

#: Common English insults.
INSULTS = (
    "clown disgusting dumb filthy garbage idiot imbecile jerk loser moron pathetic scum stupid trash "
    "ugly useless vermin worthless".split()
)


@dataclass(frozen=True)
class Labeller:
    """Votes 1 (bad) where ``bad`` holds, 0 (good) where ``good`` holds, else nothing."""

    name: str
    bad: Column
    good: Column


def quality_labellers() -> tuple[Labeller, ...]:
    w = F.greatest(F.col("n_words"), F.lit(1))
    symbols, capitals = F.col("n_symbols") / w, F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))
    repeated, marks = F.col("n_repeat_words") / w, F.col("n_marks") / w
    length, distinct = F.col("word_chars") / w, F.col("n_distinct") / w
    return (
        Labeller("symbols", symbols > 0.1, symbols < 0.01),
        Labeller("capitals", capitals > 0.4, capitals < 0.2),
        Labeller("repeats", repeated > 0.5, repeated < 0.2),
        Labeller("exclamations", marks > 0.2, marks < 0.02),
        Labeller("variety", distinct < 0.15, distinct > 0.4),
        Labeller("symbols_or_marks", (symbols + marks) > 0.3, (symbols + marks) < 0.02),
        Labeller("odd_words", (length < 2.5) | (length > 7) | ((length < 4.7) & (symbols > 0.3)), length.between(4.4, 6)),
    )


def abuse_labellers() -> tuple[Labeller, ...]:
    n, w = F.col("n_insults"), F.greatest(F.col("n_words"), F.lit(1))
    return (
        Labeller("any_insult", n >= 1, n == 0),
        Labeller("several_insults", n >= 2, n == 0),
        Labeller("insult_share", n * 200 > w, n * 2000 < w),
    )


def with_signals(docs: DataFrame) -> DataFrame:
    """The measurements that the labellers read, of the rows of ``doc_id, text``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    # The first letter is tested first: most places end there.
    letters = "".join(sorted({x[0] for x in INSULTS}))
    insult = rf"(?i)(?=[{letters}])(?<![\p{{L}}\p{{N}}])(?:" + "|".join(INSULTS) + r")(?![\p{L}\p{N}])"
    return measure(docs, names=SIGNALS).withColumns(
        {
            "n_marks": F.length(body) - F.length(F.translate(body, "!", "")),
            "n_insults": F.regexp_count(body, F.lit(insult)),
        }
    )


def votes(labellers: tuple[Labeller, ...]) -> Column:
    """All votes as one number, two bits each: 0 bad, 1 good, 2 nothing."""
    digits = [
        F.when(x.bad, F.lit(0)).when(x.good, F.lit(1)).otherwise(F.lit(2)) * (1 << 2 * k)
        for k, x in enumerate(labellers)
    ]
    return reduce(lambda a, b: a + b, digits).cast("long")


@dataclass(frozen=True)
class LabelModel:
    """Share of bad documents, and for each labeller the chance of each vote by class."""

    bad: float
    chances: np.ndarray  # class (bad, good), labeller, vote (bad, good, nothing)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of bad for vote patterns."""
        n = self.chances.shape[1]
        seen = (patterns[:, None] >> 2 * np.arange(n)) & 3
        logs = np.log(self.chances[:, np.arange(n)[None, :], seen]).sum(axis=2)
        logs[0] += np.log(self.bad)
        logs[1] += np.log(1 - self.bad)
        return 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -60, 60)))


def fit_labels(counts: dict[int, int], n: int, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over pattern counts.

    It starts from labellers that are mostly right and keeps that belief as a
    prior of a few votes, which also settles which class is the bad one.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    seen = (patterns[:, None] >> 2 * np.arange(n)) & 3
    prior = np.empty((2, n, 3))
    prior[0], prior[1] = (0.45, 0.15, 0.4), (0.02, 0.78, 0.2)
    model = LabelModel(0.1, prior)
    strength = 0.02 * max(weight.sum(), 1.0) + 1
    for _ in range(rounds if len(patterns) else 0):
        bad = model.posterior(patterns)
        chances = prior * strength
        for c, share in enumerate((bad, 1 - bad)):
            for v in range(3):
                chances[c, :, v] += ((seen == v) * (share * weight)[:, None]).sum(axis=0)
        chances /= chances.sum(axis=2, keepdims=True)
        total = weight.sum()
        model = LabelModel(float(((bad * weight).sum() + 1) / (total + 10)), chances)
    return model


def hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """Distinct feature buckets of every text: its words, the shapes of its words
    (length, final byte, capitals) and how often the commonest word fills it."""
    powers = Powers()
    mask = np.uint64(BUCKETS - 1)
    for _, data, starts in chunks(texts):
        hashes, cut, begin, end = words(data, starts, powers, _STRIP)
        _, rough, first, last = words(data, starts, powers)
        tail = data[last - 1].astype(np.uint64) if len(last) else last.astype(np.uint64)
        head = data[first].astype(np.uint64) if len(first) else first.astype(np.uint64)
        second = data[np.minimum(first + 1, max(len(data) - 1, 0))].astype(np.uint64) if len(first) else tail
        capital = ((second >= 65) & (second <= 90)).astype(np.uint64)
        plain = np.where((tail >= 97) | (tail >= 65) & (tail <= 90), np.uint64(97), tail)
        lone = (last - first == 1).astype(np.uint64) * (head + np.uint64(1))
        shapes = mix(plain + (capital << np.uint64(8)) + (lone << np.uint64(9)) + np.uint64(1 << 40))
        for a, b, c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), rough[:-1].tolist(), rough[1:].tolist()):
            own = np.unique(hashes[a:b])
            kinds, times = np.unique(shapes[c:d], return_counts=True)
            # A shape counts with its share of the words, in steps of two.
            level = np.floor(np.log2(times / max(d - c, 1)) + 8).clip(0).astype(np.uint64) if len(kinds) else times.astype(np.uint64)
            some = [own, mix(kinds + (level << np.uint64(50)))]
            if b > a:
                spread = np.uint64(int(8 * len(own) / (b - a)))
                some.append(mix(np.array([spread + np.uint64(1 << 41)], np.uint64)))
            yield np.unique(np.concatenate(some) & mask).astype(np.int64)


_STRIP = np.zeros(256, bool)
_STRIP[[b for b in range(128) if not chr(b).isalnum()]] = True


def fit_linear(rows: list[np.ndarray], targets: np.ndarray, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Logistic weights of buckets by averaged adaptive gradient steps on soft
    targets; a class that is rare weighs more."""
    rng = np.random.default_rng(SEED)
    weights, grown, bias, bias_grown = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6), 0.0, 1e-6
    share = float(np.clip(targets.mean(), 0.02, 0.98)) if len(targets) else 0.5
    importance = np.where(targets > 0.5, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            row = rows[k]
            scale = 1 / np.sqrt(len(row) + 1)
            p = 1 / (1 + np.exp(-np.clip(weights[row].sum() * scale * 4 + bias, -30, 30)))
            step = (p - targets[k]) * importance[k]
            gradient = step * scale * 4 + 2e-4 * weights[row]
            grown[row] += gradient**2
            weights[row] -= 0.15 * gradient / np.sqrt(grown[row])
            bias_grown += step**2
            bias -= 0.15 * step / np.sqrt(bias_grown)
    return weights, bias


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float

    def score(self, buckets: np.ndarray) -> float:
        z = self.weights[buckets].sum() * 4 / np.sqrt(len(buckets) + 1) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit_scorers(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[LabelModel, Scorer]]:
    """Label model and scorer for low quality and for abuse.

    The votes of all documents make the label models: their patterns are at most
    three to the number of labellers. Only the sample's features reach the driver.
    """
    kinds = (quality_labellers(), abuse_labellers())
    signals = with_signals(docs.select("doc_id", "text"))
    voted = stage(
        signals.select(
            "doc_id",
            F.xxhash64(F.lit(SEED), "doc_id", "text").alias("order"),
            *[votes(x).alias(f"votes{k}") for k, x in enumerate(kinds)],
        ),
        "quality-votes",
    )
    models = []
    for k, labellers in enumerate(kinds):
        counts = {p: n for p, n in voted.groupBy(f"votes{k}").count().collect()}
        models.append(fit_labels(counts, len(labellers)))
    chosen = voted.orderBy("order", "doc_id").limit(sample_rows)
    picked = (
        docs.select("text", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("order"))
        .join(F.broadcast(chosen.select("order", "votes0", "votes1").distinct()), "order")  # at most sample_rows
        .select("text", "votes0", "votes1", "order")
        .dropDuplicates(["order"])  # a document that stands many times is one row of the sample
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tolist() for r in hashed(batch.column(0))]
            yield pa.record_batch(
                [pa.array(rows, pa.list_(pa.int32())), *(batch.column(i) for i in (1, 2, 3))],
                names=["buckets", "votes0", "votes1", "order"],
            )

    sample = picked.mapInArrow(run, "buckets array<int>, votes0 bigint, votes1 bigint, order bigint").toArrow()
    sample = sample.sort_by("order")
    rows = [np.array(r, np.int64) for r in sample.column("buckets").to_pylist()]
    out = []
    for k, model in enumerate(models):
        targets = model.posterior(sample.column(f"votes{k}").to_numpy().astype(np.int64)) if len(rows) else np.zeros(0)
        out.append((model, Scorer(*fit_linear(rows, targets))))
    return out


def scored(docs: DataFrame, scorers: list[Scorer], thresholds: tuple[float, ...] = (0.5, 0.5)) -> DataFrame:
    """``doc_id, low_quality, abuse, kept`` of the rows of ``doc_id, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[list[float]] = [[] for _ in scorers]
            kept = []
            for buckets in hashed(batch.column(1)):
                values = [s.score(buckets) for s in scorers]
                for column, value in zip(scores, values):
                    column.append(value)
                kept.append(bool(len(buckets)) and all(v < t for v, t in zip(values, thresholds)))
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.float64()) for c in scores), pa.array(kept, pa.bool_())],
                names=["doc_id", "low_quality", "abuse", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, low_quality double, abuse double, kept boolean")


@query("op7_quality_model")
def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, [s for _, s in fit_scorers(docs)])
