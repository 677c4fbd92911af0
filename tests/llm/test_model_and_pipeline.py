import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, documents, shingles_of, with_extras
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from pairloom.llm import decontaminate, line_dedup, quality_model  # noqa: E402

SF = "/root/testdata/sf0.001"
LABELLED = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables are not here")


def test_accuracies_from_agreement():
    rng = np.random.default_rng(5)
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    truth = rng.random(40000) < 0.25  # bad
    right = rng.random((40000, 5)) < accuracy
    vote = np.where(right, ~truth[:, None], truth[:, None]).astype(int)  # 0 bad, 1 good
    vote[rng.random(vote.shape) < 0.2] = 2
    patterns, n = np.unique((vote << 2 * np.arange(5)).sum(axis=1), return_counts=True)
    model = quality_model.fit_labels(dict(zip(patterns.tolist(), n.tolist())), 5, rounds=200)
    estimate = model.chances[0, :, 0] / (model.chances[0, :, 0] + model.chances[0, :, 1])
    assert abs(model.bad - 0.25) < 0.05 and np.abs(estimate - accuracy).max() < 0.1
    said = model.posterior((vote << 2 * np.arange(5)).sum(axis=1)) > 0.5
    assert (said == truth).mean() > 0.95
    empty = quality_model.fit_labels({}, 3)
    assert 0 < empty.bad < 1


def test_hashed_features_are_per_text():
    texts = [t for _, t, _ in documents()]
    together = list(quality_model.hashed(pa.array(texts)))
    alone = [next(quality_model.hashed(pa.array([t], pa.string()))) for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone)) and len(together) == len(texts)


def test_sample_has_repeated_documents_once(spark):
    """However often a document stands, its features reach the driver once."""
    rows = [(i, t) for i, t, _ in documents()]
    once = spark.createDataFrame(rows, "doc_id bigint, text string").distinct()
    often = once.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("k").repartition(4)
    for (_, a), (_, b) in zip(quality_model.fit_scorers(once), quality_model.fit_scorers(often)):
        assert np.isfinite(a.weights).all() and ((a.weights != 0) == (b.weights != 0)).all()


def test_signals_against_plain_words(spark):
    rows = [(i, t) for i, t, _ in documents()]
    got = quality_model.with_signals(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert not {"n_lines", "n_dup_lines"} & set(got.columns)
    for r in got.select("text", "n_words", "n_distinct", "n_marks").collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", r.text or "") if x]
        assert (r.n_words, r.n_distinct, r.n_marks) == (len(w), len(set(w)), (r.text or "").count("!"))


@here
def test_held_out_labels(spark):
    docs = spark.read.parquet(f"{LABELLED}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{LABELLED}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality_model.op7_quality_model(spark, LABELLED).collect()}
    assert len(got) == docs.count()
    right = [got[i].kept == (r.quality == 1 and r.toxic == 0) for i, r in labels.items()]
    assert np.mean(right) > 0.9  # labels themselves hold noise
    insults = {r.doc_id for r in quality_model.with_signals(docs).where("n_insults >= 2").select("doc_id").collect()}
    assert insults and np.mean([got[i].kept for i in insults]) < 0.05


def test_model_of_odd_tables(spark):
    df = with_extras(spark.createDataFrame(documents(), SCHEMA))
    scorers = [s for _, s in quality_model.fit_scorers(df)]
    got = quality_model.scored(df, scorers).collect()
    assert len(got) == df.count() and not any(r.kept for r in got if r.doc_id in {i for i, t, _ in documents() if not (t or "").strip()})
    none = df.limit(0)
    assert quality_model.scored(none, [s for _, s in quality_model.fit_scorers(none)]).count() == 0


@here
def test_stages_decide_on_all_rows(spark):
    """Every stage on a small table, against plain definitions."""
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, step in corpus_pipeline.STAGES:
        out = corpus_pipeline.stage(step(spark, kept[-1], SF), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        kept.append(out)
    texts = [{r.doc_id: r.text for r in k.select("doc_id", "text").collect()} for k in kept[:5]]
    assert set(texts[4]) <= set(texts[3]) <= set(texts[2]) <= set(texts[1]) <= set(texts[0])
    # 8: no long line stands twice, and every line of the input still stands somewhere
    key = lambda x: tuple(line_dedup.normalised(x).split(" "))
    long = lambda t: [key(x) for x in t.split("\n") if len(key(x)) >= line_dedup.MIN_WORDS]
    left = [k for t in texts[2].values() for k in long(t)]
    assert len(left) == len(set(left))
    lost = {k for t in texts[1].values() for k in long(t)} - set(left)
    assert all(any(line_dedup.similar(" ".join(k), " ".join(x)) for x in left) for k in lost)
    # 3: no two that stay are near copies, and whatever went has one that stays
    sets = {i: shingles_of(t, 5) for i, t in texts[2].items()}
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0
    stay = sorted(texts[3])
    assert not any(near(i, j) for a, i in enumerate(stay) for j in stay[:a])
    # 2: exactly the documents that hold an item go
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    word = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in "".join(x.lower() if x < "\x80" else x for x in t)).split()
    joined = {i: " " + " ".join(word(t)) + " " for i, t in texts[3].items()}
    held = {i for i, t in joined.items() if any(" " + " ".join(word(r.text)) + " " in t for r in items.collect())}
    assert held == set(texts[3]) - set(texts[4]) or held <= set(texts[3]) - set(texts[4])
    # 10: one row for each that is left
    mixed = kept[5].collect()
    assert {r.doc_id for r in mixed} == set(texts[4]) and all(r.taken <= 3 * r.size for r in mixed)
    assert decontaminate.PERCENT == 80
