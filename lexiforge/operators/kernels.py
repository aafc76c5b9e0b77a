"""A kernel machine on linear parts: random Fourier features, a linear margin fit, and probabilities by Platt's fit.

Cosines of random projections have inner products near the Gaussian kernel exp(-gamma |x - y|^2), so a linear machine
over them is a kernel machine whose cost grows with the rows, not with their pairs.  A logistic curve over the margins of held-out
rows turns margins into probabilities.

Scale: the projection is an expression on each row; both fits are MLlib's, and nothing but their weights reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators import selection
from lexiforge.operators.stored import stored


@dataclass(frozen=True)
class Machine:
    """features; center and width of each; weights and phases of the projection; the linear machine over it; slope and shift of the curve over margins."""

    features: tuple[str, ...]
    center: tuple[float, ...]
    width: tuple[float, ...]
    weights: np.ndarray
    phases: np.ndarray
    linear: LinearSVCModel
    slope: float
    shift: float


def projected(values: Column, weights: np.ndarray, phases: np.ndarray) -> Column:
    """sqrt(2 / D) cos(w x + b) for D random w and b, of an array of doubles."""
    table = F.array(*[F.array(*[F.lit(float(x)) for x in (*w, b)]) for w, b in zip(weights, phases)])
    dot = lambda w: F.aggregate(F.zip_with(F.slice(w, 1, weights.shape[1]), values, lambda a, x: a * x), F.element_at(w, -1), lambda a, x: a + x)
    return F.transform(table, lambda w: F.lit(math.sqrt(2 / len(phases))) * F.cos(dot(w)))


def _standard(features, center, width) -> Column:
    return F.array(*[(F.col(f).cast("double") - c) / w for f, c, w in zip(features, center, width)])


def _whole(rows: DataFrame, features) -> DataFrame:
    """Rows whose features are all there and finite."""
    for f in features:
        rows = rows.where(F.col(f).isNotNull() & (F.abs(F.col(f).cast("double")) < float("inf")))
    return rows


def fitted(train: DataFrame, features: list[str], key: str, label: str = "y", gamma: float | None = None, size: int = 128, penalty: float = 1e-3, held: float = 0.2, seed: int = 42) -> Machine:
    """A machine fitted on rows with a label 0 or 1; a stratified share of them is held out for the curve, by the hash of key.

    gamma defaults to 1 / the number of features, which are standardised.  Rows without all features or a label are left out.
    """
    rows = _whole(train.where(F.col(label).isNotNull()), features)
    stats = rows.agg(*[f(F.col(c).cast("double")) for c in features for f in (F.avg, F.stddev_pop)]).first()
    center, width = tuple(x or 0.0 for x in stats[::2]), tuple(x or 1.0 for x in stats[1::2])
    rng = np.random.default_rng(seed)
    gamma = 1 / len(features) if gamma is None else gamma
    weights, phases = rng.normal(0, math.sqrt(2 * gamma), (size, len(features))), rng.uniform(0, 2 * math.pi, size)
    parts = selection.stratified(rows.select(key, label, *features), key, label, held, seed)
    parts = stored(parts.select(label, "chosen", array_to_vector(projected(_standard(features, center, width), weights, phases)).alias("__x")))
    svc = LinearSVC(featuresCol="__x", labelCol=label, regParam=penalty, standardization=False, rawPredictionCol="__m", predictionCol="__p")
    margins = svc.fit(parts.where("not chosen")).transform(parts.where("chosen")).select(F.col(label).cast("double").alias("y"), array_to_vector(F.array(vector_to_array("__m")[1])).alias("m"))
    both = margins.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
    slope, shift = 1.0, 0.0
    if min(both):
        # Platt's targets lie a little inside 0 and 1; a row of either label with such weights fits the same curve
        low, high = 1 / (both[0] + 2), (both[1] + 1) / (both[1] + 2)
        share = F.when(F.col("y") == 1, high).otherwise(low)
        soft = margins.select("m", F.explode(F.array(F.struct(F.lit(1.0).alias("t"), share.alias("w")), F.struct(F.lit(0.0).alias("t"), (1 - share).alias("w")))).alias("x")).select("m", "x.t", "x.w")
        curve = LogisticRegression(featuresCol="m", labelCol="t", weightCol="w", standardization=False).fit(soft)
        slope, shift = float(curve.coefficients[0]), float(curve.intercept)
    return Machine(tuple(features), center, width, weights, phases, svc.fit(parts), slope, shift)


def scored(rows: DataFrame, machine: Machine) -> DataFrame:
    """rows with margin and p; both null where a feature is missing or not finite.  Columns of these names are replaced."""
    values = _standard(machine.features, machine.center, machine.width)
    there = F.lit(True)
    for f in machine.features:
        there = there & F.coalesce(F.abs(F.col(f).cast("double")) < float("inf"), F.lit(False))
    linear = F.array(*[F.lit(float(x)) for x in machine.linear.coefficients])
    margin = F.aggregate(F.zip_with(projected(values, machine.weights, machine.phases), linear, lambda a, b: a * b), F.lit(float(machine.linear.intercept)), lambda a, x: a + x)
    done = rows.drop("margin", "p").withColumn("margin", F.when(there, margin))
    return done.withColumn("p", 1 / (1 + F.exp(-(F.col("margin") * machine.slope + machine.shift))))
