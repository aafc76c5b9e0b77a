"""Calibration of a coherence model: features, folds, gradient descent, thresholds, importance, ablation.

Scores and labels are rows; curves come from one aggregation of counts per threshold step, so a curve over any number of
rows is a shuffle of at most folds x steps rows.  Models are fitted by sums over tasks, all folds in one job a step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import sequences as N
from lexiforge.functions.sequences import wilson
from lexiforge.operators.pairs import ranked_within, share
from lexiforge.operators.selection import weakest
from lexiforge.operators.stored import stored


def standardised(rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with features less their mean by their sample deviation (1 where that is at most 1e-8 or undefined)."""
    stats = rows.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features])
    dev = lambda f: F.when(F.coalesce(F.col(f"s_{f}"), F.lit(0.0)) > 1e-8, F.col(f"s_{f}")).otherwise(1.0)
    scaled = rows.crossJoin(F.broadcast(stats)).withColumns({f: (F.col(f) - F.col(f"m_{f}")) / dev(f) for f in features})
    return scaled.select(*rows.columns)


def linear(features: dict[str, float], bias: float) -> Column:
    """sum of coefficient * feature, plus bias."""
    out = F.lit(0.0)
    for f, a in features.items():
        out = out + F.lit(a) * F.col(f)
    return out + F.lit(bias)


def kept_by_rule(rows: DataFrame, coefficients: dict[str, float], bias: float, name: str = "label") -> DataFrame:
    """rows with label 1 where the rule is at least 0, else -1; missing features give -1."""
    return rows.withColumn(name, F.when(linear(coefficients, bias) >= 0, 1).otherwise(-1))


def raw_rule(weights: dict[str, float], means: dict[str, float], stds: dict[str, float], bias: float, threshold: float) -> tuple[dict[str, float], float]:
    """Coefficients and constant on raw features: standardisation folded in, the threshold's logit taken off."""
    p = min(max(threshold, 1e-12), 1 - 1e-12)
    return {f: w / stds[f] for f, w in weights.items()}, bias - sum(w * means[f] / stds[f] for f, w in weights.items()) - float(np.log(p / (1 - p)))


# ---- thresholds ----


def curve(scored: DataFrame, steps: int = 201, by: list[str] | None = None, p: str = "p", y: str = "y") -> DataFrame:
    """One row per group and threshold i / (steps - 1): kept, coh_kept, total, total_coh and their metrics; kept means p >= t.

    Rows are counted at the highest step that keeps them, then summed from the top.
    """
    by = by or []
    top = F.floor(F.col(p) * (steps - 1) + 1e-9).cast("int")
    # p may lie just under i / (steps - 1) in doubles: the step is checked against the exact comparison
    step = F.when((top + 1 <= steps - 1) & (F.col(p) >= (top + 1) / F.lit(float(steps - 1))), top + 1).when(F.col(p) < top / F.lit(float(steps - 1)), top - 1).otherwise(top)
    counts = scored.groupBy(*by, step.alias("i")).agg(F.count("*").alias("n"), F.sum(y).alias("c"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"), F.sum("c").alias("total_coh"))
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    low = counts.where("i >= 0")
    down = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(low, [*by, "i"], "left").withColumns({"kept": F.coalesce(F.sum("n").over(down), F.lit(0)), "coh_kept": F.coalesce(F.sum("c").over(down), F.lit(0))})
    return full.select(
        *by, (F.col("i") / F.lit(float(steps - 1))).alias("threshold"), *[F.col(c).cast("long").alias(c) for c in ("kept", "coh_kept", "total", "total_coh")],
        share(F.col("kept"), F.col("total")).alias("coverage"), share(F.col("coh_kept"), F.col("kept")).alias("precision"), N.wilson(F.col("coh_kept"), F.col("kept")).alias("precision_lcb"),
        share(F.col("coh_kept"), F.col("total_coh")).alias("recall"), share(F.col("coh_kept"), F.col("total")).alias("coherent_kept_rate"),
    )


def averaged(curves: DataFrame) -> DataFrame:
    """Mean and deviation (0 for one fold) over folds of each metric by threshold."""
    names = ("coverage", "precision", "precision_lcb", "recall", "coherent_kept_rate")
    return curves.groupBy("threshold").agg(*[F.avg(c).alias(f"{c}_mean") for c in names], *[F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std") for c in names])


def chosen(curves: DataFrame, least: float, lcb: bool = True, by: list[str] | None = None, min_accepted: int = 1) -> DataFrame:
    """Per group the threshold that keeps most coherent rows among those precise enough; the lowest wins a tie.

    If none is precise enough, the most precise (by the same measure) with enough accepted; if none accepts enough, t = 1
    with nothing accepted.  fallback says which.
    """
    by = by or []
    measure = F.col("precision_lcb" if lcb else "precision")
    ok = measure >= least
    rank = Window.partitionBy(*by).orderBy(
        F.desc(F.col("kept") >= min_accepted), F.desc(ok), F.desc(F.when(ok, F.col("coh_kept").cast("double")).otherwise(measure)), "threshold"
    )
    first = curves.withColumn("__at", F.row_number().over(rank)).where("__at = 1").drop("__at")
    enough = F.col("kept") >= min_accepted
    fallback = F.when(~enough, "none").when(~ok, "best").otherwise("met")
    zero = {c: F.when(enough, F.col(c)).otherwise(F.lit(0).cast("double")) for c in ("coverage", "precision", "precision_lcb", "recall", "coherent_kept_rate")}
    return first.withColumns({"fallback": fallback, "threshold": F.when(enough, F.col("threshold")).otherwise(1.0)} | zero)


def median_threshold(choices: DataFrame) -> DataFrame:
    return choices.agg(F.median("threshold").alias("threshold"))


# ---- models ----


def fit_arrays(x: np.ndarray, y: np.ndarray, lr: float = 0.05, epochs: int = 4000, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full-batch gradient descent of the mean log loss from zero on standardised features: weights (bias first), means, deviations."""
    mean = x.mean(axis=0)
    std = np.sqrt(((x - mean) ** 2).sum(axis=0) / max(1, len(x) - 1))
    std[std <= 1e-8] = 1.0
    xb = np.hstack([np.ones((len(x), 1)), (x - mean) / std])
    w, decay = np.zeros(xb.shape[1]), np.r_[0.0, np.full(x.shape[1], l2)]
    for _ in range(epochs):
        w -= lr * (xb.T @ (1 / (1 + np.exp(-np.clip(xb @ w, -500, 500))) - y) / len(y) + decay * w)
    return w, mean, std


def probabilities(x: np.ndarray, w: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / std) @ w[1:], -500, 500)))


def _fitted(rows: DataFrame, k: int, d: int, l2: float, steps: int, close: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Weights (bias first), means and deviations of each fold's model, trained on the rows (fold, y, x) of the other folds.

    Newton's steps to the optimum that gradient descent of the same loss approaches.  A step is one job for all folds: tasks
    add up gradients and second derivatives, a few numbers for each fold, and the driver solves for the weights.
    """

    def summed(f) -> np.ndarray:
        """f(x, y, fold, held) -> rows of numbers, summed over the rows that each fold trains on; (k, numbers)."""

        def run(batches):
            import pyarrow as pa

            total = None
            for b in batches:
                fold, y = b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                part = np.stack([f(x[fold != h], y[fold != h], h) for h in range(k)])
                total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["held", "v"])

        got = rows.select("fold", "y", "x").mapInArrow(run, "held int, v array<double>").toArrow().sort_by("held").to_pylist()  # k rows a task
        out = np.zeros((k, len(got[0]["v"]) if got else 0))
        for r in got:
            out[r["held"]] += r["v"]
        return out

    sums = summed(lambda x, y, h: np.r_[len(x), x.sum(axis=0)])
    if not sums.size:
        return []
    n = np.maximum(sums[:, 0], 1)
    means = sums[:, 1:] / n[:, None]
    stds = np.sqrt(summed(lambda x, y, h: ((x - means[h]) ** 2).sum(axis=0)) / np.maximum(n - 1, 1)[:, None])
    stds[stds <= 1e-8] = 1.0
    w, decay = np.zeros((k, d + 1)), np.r_[0.0, np.full(d, l2)]

    def slopes(x, y, h):
        xb = np.hstack([np.ones((len(x), 1)), (x - means[h]) / stds[h]])
        p = 1 / (1 + np.exp(-np.clip(xb @ w[h], -500, 500)))
        return np.r_[xb.T @ (p - y), (xb.T @ (xb * (p * (1 - p))[:, None])).ravel()]

    for _ in range(steps):
        s = summed(slopes)
        move = np.stack([np.linalg.lstsq(s[h, d + 1 :].reshape(d + 1, d + 1) / n[h] + np.diag(decay), s[h, : d + 1] / n[h] + decay * w[h], rcond=None)[0] for h in range(k)])
        move *= np.minimum(1, 4 / np.maximum(np.abs(move).max(axis=1), 1e-12))[:, None]  # no wild step from far off
        w -= move
        if np.abs(move).max() < close:
            break
    return [(w[h], means[h], stds[h]) for h in range(k)]


def cross_validated(rows: DataFrame, key: str, features: list[str], k: int = 5, l2: float = 1e-3, steps: int = 40, close: float = 1e-10) -> DataFrame:
    """(fold, key, y, p, weights, means, stds): each fold's rows scored by a logistic regression of the others, features standardised.

    rows has y and fold.  Training is sums over tasks (see _fitted), scoring an expression; the input is read once and kept meanwhile.
    """
    d, kind = len(features), dict(rows.dtypes)[key]
    held = rows.select("fold", F.col("y").cast("int").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(key).alias("__key"))
    held = stored(held)
    models = _fitted(held, k, d, l2, steps, close)
    if not models:
        return rows.sparkSession.createDataFrame([], f"fold int, {key} {kind}, y int, p double, weights array<double>, means array<double>, stds array<double>")
    table = F.array(*[F.struct(*[F.array(*[F.lit(float(v)) for v in part]).alias(name) for name, part in zip(("w", "m", "s"), m)]) for m in models])
    scored = held.withColumn("m", F.get(table, F.col("fold")))
    terms = F.zip_with(F.zip_with(F.col("x"), F.col("m.m"), lambda a, b: a - b), F.zip_with(F.slice("m.w", 2, d), F.col("m.s"), lambda a, b: a / b), lambda a, b: a * b)
    z = F.aggregate(terms, F.get("m.w", F.lit(0)), lambda a, b: a + b)
    return scored.select(F.col("fold").cast("int").alias("fold"), F.col("__key").alias(key), "y", (1 / (1 + F.exp(-z))).alias("p"), F.col("m.w").alias("weights"), F.col("m.m").alias("means"), F.col("m.s").alias("stds"))


def weight_summary(scored: DataFrame, features: list[str]) -> DataFrame:
    """(feature, pos, weight_mean, weight_std, weight_mean_abs, sign_consistency) over folds."""
    models = scored.groupBy("fold").agg(F.first("weights").alias("w"))
    names = F.array(*[F.lit(f) for f in features])
    each = models.select("fold", F.posexplode(F.expr("slice(w, 2, size(w) - 1)")).alias("pos", "v")).withColumn("feature", F.get(names, F.col("pos")))
    return each.groupBy("feature", "pos").agg(
        F.avg("v").alias("weight_mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("weight_std"), F.avg(F.abs("v")).alias("weight_mean_abs"),
        F.greatest(F.avg((F.col("v") > 0).cast("int")), F.avg((F.col("v") < 0).cast("int"))).alias("sign_consistency"),
    )


def ordered(summary: DataFrame, by: str = "weight_mean_abs", pos: str | None = "pos") -> DataFrame:
    """A summary of features with place 1, 2, ..., the largest value first, ties in feature order (one row a feature, small by nature)."""
    ties = [pos] if pos else []
    return summary.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), *ties)))


def permutation_importance(rows: DataFrame, scored: DataFrame, choices: DataFrame, key: str, features: list[str], repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, metric, delta_mean, delta_std): how much each metric falls at a fold's own threshold when a feature is shuffled within the fold.

    A shuffle pairs each row with the one of the same rank in another hash order of its fold; all is joins and sums.
    """
    d = len(features)
    names = F.array(*[F.lit(f) for f in features])
    base = rows.select(F.col(key).alias("k"), "fold", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))

    def placed(s: int, name: str) -> DataFrame:
        return ranked_within(base.withColumn("__h", F.struct(F.md5(F.concat_ws(":", F.lit(str(s)), F.col("k").cast("string")).cast("binary")).alias("h"), "k")), "fold", "__h", name).drop("__h")

    own = stored(placed(seed, "rank").select("k", "fold", "rank", "x"))
    other = None
    for r in range(repeats):
        one = placed(seed + r + 1, "rank").select(F.col("fold").alias("f2"), F.col("rank").alias("r2"), F.col("x").alias("z"), F.lit(r).alias("repeat"))
        other = one if other is None else other.unionByName(one)
    met = own.join(other, (F.col("fold") == F.col("f2")) & (F.col("rank") == F.col("r2"))).select("k", "repeat", "z")
    held = scored.select(F.col(key).alias("k"), "fold", "y", "p", "weights", "stds").join(own.select("k", "x"), "k").join(choices.select("fold", "threshold"), "fold")
    logit = F.ln(F.col("p") / (1 - F.col("p")))
    moved = lambda j: logit + (F.get("z", j) - F.get("x", j)) / F.get("stds", j) * F.get("weights", j + 1)
    each = held.join(met, "k").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(d - 1)))).withColumn("keep", moved(F.col("j")) >= F.ln(F.col("threshold") / (1 - F.col("threshold"))))
    sums = lambda df, by, keep: df.groupBy(*by).agg(F.count("*").alias("total"), F.sum("y").alias("good"), F.count_if(keep).alias("kept"), F.count_if(keep & (F.col("y") == 1)).alias("hit"))

    def metrics(n, prefix):
        share = F.coalesce(F.try_divide(n["hit"].cast("double"), n["kept"].cast("double")), F.lit(0.0))
        of = lambda a, b: F.coalesce(F.try_divide(n[a].cast("double"), n[b].cast("double")), F.lit(0.0))
        return F.struct(of("hit", "total").alias("coherent_kept_rate"), share.alias("precision"), wilson(n["hit"], n["kept"]).alias("precision_lcb"), of("kept", "total").alias("coverage"), of("hit", "good").alias("recall")).alias(prefix)

    columns = ("total", "good", "kept", "hit")
    asis = sums(held, ["fold"], F.col("p") >= F.col("threshold"))
    before = asis.select("fold", metrics({c: asis[c] for c in columns}, "own"))
    shuffled_ = sums(each, ["fold", "j", "repeat"], F.col("keep"))
    after = shuffled_.select("fold", "j", metrics({c: shuffled_[c] for c in columns}, "new"))
    parts = ("coherent_kept_rate", "precision", "precision_lcb", "coverage", "recall")
    means = after.groupBy("fold", "j").agg(*[F.avg(f"new.{c}").alias(c) for c in parts]).join(before, "fold")
    deltas = means.select(F.get(names, F.col("j")).alias("feature"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), (F.col(f"own.{c}") - F.col(c)).alias("delta")) for c in parts])).alias("m"))
    return deltas.groupBy("feature", "m.metric").agg(F.avg("m.delta").alias("delta_mean"), F.coalesce(F.stddev_samp("m.delta"), F.lit(0.0)).alias("delta_std"))


def ablation(rows: DataFrame, key: str, features: list[str], least: float, lcb: bool = True, protected: tuple[str, ...] = (), fewest: int = 2, **training) -> list[dict]:
    """Backward elimination: at each step the folds' mean metrics with the features left, then the weakest goes.  A driver loop over Spark jobs."""
    left, removed, out = list(features), None, []
    while True:
        scored = cross_validated(rows, key, left, **training).persist()
        best = chosen(curve(scored, by=["fold"]), least, lcb, by=["fold"])
        row = best.agg(*[F.avg(c).alias(c) for c in ("coherent_kept_rate", "precision", "precision_lcb", "coverage", "recall")], F.median("threshold").alias("chosen_t")).first().asDict()
        out.append({"step": len(out), "n_features": len(left), "removed": removed, "features": list(left)} | row)
        weak = weakest(weight_summary(scored, left), list(protected) or [""]).first()
        scored.unpersist()
        if len(left) <= fewest or weak is None:
            return out
        removed = weak["feature"]
        left.remove(removed)


def minimal_set(steps: list[dict], tolerance: float = 0.01, measure: str = "coherent_kept_rate") -> dict:
    """The last step whose measure is at least the best less the tolerance's share."""
    best = max(s[measure] for s in steps)
    return [s for s in steps if s[measure] >= best * (1 - tolerance)][-1]
