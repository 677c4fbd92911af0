"""Weighted, standardised logistic regression and model selection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.ordered import sliced_running, with_slices
from pairloom.operators.ranking import average_precision
from pairloom.operators.rules import union_all
from pairloom.runtime import stage

# The regularisation grid and the iteration limit of the solver.
C_GRID = (0.01, 0.1, 1.0, 10.0, 100.0)
MAX_ITERATIONS = 5000
TOLERANCE = 1e-8


def class_counts(df: DataFrame) -> DataFrame:
    """(label, n) for the labels 0 and 1: at most two rows."""
    return df.where(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def balanced_weights(df: DataFrame) -> DataFrame:
    """Add ``weight`` = n / (2 n_class)."""
    counts = class_counts(df)
    sizes = counts.groupBy().agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("label") == 0, F.col("n"))).alias("n0"),
        F.sum(F.when(F.col("label") == 1, F.col("n"))).alias("n1"),
    )
    packed = sizes.select(F.struct("n", "n0", "n1")).scalar()
    own = F.when(F.col("label") == 1, F.col("_s.n1")).otherwise(F.col("_s.n0"))
    return df.withColumn("_s", packed).withColumn("weight", F.col("_s.n") / (2 * own)).drop("_s")


def scaling(df: DataFrame, features: str = "features") -> tuple[list[float], list[float]]:
    """(means, population SDs); a constant column scales by 1. One vector
    reaches the driver, as model parameters do."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(features)))
    s = df.select(summary.alias("s")).first()["s"]
    shrink = (s["count"] - 1) / s["count"]
    spread = [math.sqrt(v * shrink) for v in s["variance"]]
    return [float(m) for m in s["mean"]], [x if x > 0 else 1.0 for x in spread]


@dataclass(frozen=True)
class LogisticFit:
    """A fitted baseline: scaling and the Spark ML model on scaled features."""

    means: list[float]
    scales: list[float]
    model: LogisticRegressionModel

    def scaled(self, features: Column) -> Column:
        centred = F.zip_with(features, F.array(*[F.lit(float(m)) for m in self.means]), lambda x, m: x - m)
        return F.zip_with(centred, F.array(*[F.lit(float(s)) for s in self.scales]), lambda x, s: x / s)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of label 1."""
        ready = df.withColumn("_x", array_to_vector(self.scaled(F.col("features"))))
        out = self.model.transform(ready)
        return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))


@dataclass(frozen=True)
class Training:
    """Scaled, weighted rows, staged once for any number of fits."""

    means: list[float]
    scales: list[float]
    n: int
    rows: DataFrame


def prepare(df: DataFrame, weighted: bool = True) -> Training:
    means, scales = scaling(df)
    n = class_counts(df).agg(F.sum("n")).first()[0]
    rows = balanced_weights(df) if weighted else df.withColumn("weight", F.lit(1.0))
    ready = rows.select(
        F.col("label").cast("double").alias("label"),
        "weight",
        array_to_vector(LogisticFit(means, scales, None).scaled(F.col("features"))).alias("_x"),
    )
    return Training(means, scales, n, stage(ready, "train"))


def fit_prepared(training: Training, c: float) -> LogisticFit:
    """L2 logistic regression minimising 0.5 w'w + C * sum of weighted losses.

    Spark averages the loss, so its penalty is 1 / (C n); balanced weights sum
    to n. Features were scaled with the population SD.
    """
    solver = LogisticRegression(
        featuresCol="_x",
        labelCol="label",
        weightCol="weight",
        regParam=1.0 / (c * training.n),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITERATIONS,
        tol=TOLERANCE,
    )
    return LogisticFit(training.means, training.scales, solver.fit(training.rows))


def fit_logistic(df: DataFrame, c: float, weighted: bool = True) -> LogisticFit:
    return fit_prepared(prepare(df, weighted), c)


#: Largest component of the gradient of a fit that counts as an optimum.
STATIONARY = 1e-5


def certificate(training: Training, fit: LogisticFit, c: float) -> DataFrame:
    """(c, parameters, largest_gradient, stationary): the gradient of the penalised mean
    loss at the fitted parameters, summed anew over the training rows.

    The loss is convex, so parameters with a gradient near zero are near the only
    optimum, whatever the solver reports.
    """
    intercept = F.lit(-1).alias("place")
    probability = vector_to_array("probability")[1]
    rows = fit.model.transform(training.rows).select(
        (F.col("weight") * (probability - F.col("label"))).alias("pull"), "weight", vector_to_array("_x").alias("x")
    )
    parts = rows.select("pull", "weight", F.posexplode("x").alias("place", "x"))
    ends = rows.select("pull", "weight", intercept, F.lit(1.0).alias("x"))
    slopes = parts.select("place", "pull", "weight", "x").unionByName(ends.select("place", "pull", "weight", "x"))
    sums = slopes.groupBy("place").agg((F.sum(F.col("pull") * F.col("x")) / F.sum("weight")).alias("slope"))
    values = F.array(*[F.lit(float(b)) for b in fit.model.coefficients])
    penalty = F.when(F.col("place") < 0, F.lit(0.0)).otherwise(F.get(values, F.col("place")) / (c * training.n))
    return sums.agg(
        F.lit(float(c)).alias("c"), F.count(F.lit(1)).alias("parameters"), F.max(F.abs(F.col("slope") + penalty)).alias("largest_gradient")
    ).withColumn("stationary", F.col("largest_gradient") < STATIONARY)


def grid_certificates(train: DataFrame, grid: Sequence[float] = C_GRID) -> DataFrame:
    """A certificate for the fit of every grid value."""
    training = prepare(train)
    return union_all([certificate(training, fit_prepared(training, c), c) for c in grid])


def grid_scores(train: DataFrame, selection: DataFrame, grid: Sequence[float] = C_GRID) -> DataFrame:
    """(c, average_precision) on the selection rows for every grid value."""
    training = prepare(train)
    scored = []
    for c in grid:
        rows = fit_prepared(training, c).score(selection)
        scored.append(rows.select(F.lit(float(c)).alias("c"), "label", "score"))
    return average_precision(union_all(scored), ["c"])


def select_and_refit(
    examples: DataFrame, selection: DataFrame | None = None, grid: Sequence[float] = C_GRID
) -> tuple[DataFrame, float, LogisticFit]:
    """(scored test rows, chosen C, fit): choose C by average precision on the
    selection rows (validation by default), ties to the smaller C, refit on
    train and validation, score test only."""
    held = stage(examples, "examples")
    train = held.where(F.col("partition") == "train")
    validation = held.where(F.col("partition") == "validation")
    chosen = (
        grid_scores(train, validation if selection is None else selection, grid)
        .where(F.col("average_precision").isNotNull())
        .orderBy(F.col("average_precision").desc(), "c")
        .first()
    )
    if chosen is None:
        raise ValueError("validation average precision is undefined")
    fit = fit_logistic(held.where(F.col("partition").isin("train", "validation")), chosen["c"])
    return fit.score(held.where(F.col("partition") == "test")), float(chosen["c"]), fit


def early_stop(curves: DataFrame, by: Sequence[str], patience: int = 10, epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """(by, best_epoch, best_metric, stopped_epoch) of every logged run.

    An epoch improves when its metric is strictly above all earlier ones; the
    run stops once ``patience`` epochs pass without improvement. Epochs count
    from 1. Running maxima are taken in range slices, so a very long run does
    not land in one task.
    """
    by = list(by)
    base = curves.select(*by, F.col(epoch).alias("epoch"), F.col(metric).alias("metric"))
    sliced = with_slices(base, by, [F.col("epoch")])
    earlier = sliced_running(sliced, by, [F.col("epoch")], maxima=["metric"], inclusive=False)
    improved = F.col("metric") > F.coalesce(F.col("cum_metric"), F.lit(-1.0))
    marked = earlier.select(*by, "_slice", "epoch", "metric", F.when(improved, F.col("epoch")).alias("best"))
    held = sliced_running(marked, by, [F.col("epoch")], maxima=["best"])
    gap = F.col("epoch") - F.coalesce(F.col("cum_best"), F.lit(0))
    stop = held.groupBy(*by).agg(
        F.coalesce(F.min(F.when(gap >= patience, F.col("epoch"))), F.max("epoch")).alias("stopped_epoch")
    )
    kept = marked.where(F.col("best").isNotNull()).join(stop, by).where(F.col("epoch") <= F.col("stopped_epoch"))
    return kept.groupBy(*by).agg(
        F.max("epoch").alias("best_epoch"),
        F.max_by("metric", "epoch").alias("best_metric"),
        F.max("stopped_epoch").alias("stopped_epoch"),
    )
