"""Numbers over arrays, and scores, composed of built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions import python

#: Weights of the composite score: embedding, bigrams, subsequence, corrected words, reduction.
COMPOSITE = (0.15, 0.15, 0.10, 0.50, 0.10)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(v: Column) -> Column:
    return F.try_divide(total(v), F.size(v).cast("double"))


def quantile(v: Column, q: float) -> Column:
    """The value at rank floor(q * (n - 1)) of the sorted array."""
    n = F.size(v)
    at = F.lit(1) if q <= 0 else n if q >= 1 else F.floor(F.lit(q) * (n - 1)).cast("int") + 1
    return F.when(n > 0, F.try_element_at(F.array_sort(v), at))


def longest_run(v: Column, over: float) -> Column:
    """Length of the longest stretch of values above a bound."""
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("now"))

    def step(acc, x):
        now = F.when(x > over, acc["now"] + 1).otherwise(0)
        return F.struct(F.greatest(acc["best"], now).alias("best"), now.alias("now"))

    return F.aggregate(v, start, step, lambda acc: acc["best"])


def share_over(v: Column, bound: float) -> Column:
    return F.try_divide(F.size(F.filter(v, lambda x: x > bound)).cast("double"), F.size(v).cast("double"))


def repetition(tokens: Column) -> dict[str, Column]:
    """Share of distinct tokens, of adjacent repeats, and of bigrams that occur more than once; (1, 0, 0) for one token or none."""
    m = python.repetition(tokens)
    part = lambda x, of, other: F.when(m["n"] <= 1, F.lit(other)).otherwise(F.try_divide(m[x].cast("double"), of.cast("double")))
    return {"uniq_token_ratio": part("distinct", m["n"], 1.0), "rep_1gram": part("same", m["n"] - 1, 0.0), "rep_2gram": part("again", m["n"] - 1, 0.0)}


def surprise(v: Column) -> dict[str, Column]:
    """Features of a sequence of negative log probabilities."""
    return {
        "n_tokens": F.size(v).cast("double"), "avg_nll": mean(v), "p95": quantile(v, 0.95), "p99": quantile(v, 0.99), "max_surp": F.array_max(v),
        "spike_frac_35": share_over(v, 3.5), "spike_frac_50": share_over(v, 5.0),
        "run_norm_35": F.try_divide(longest_run(v, 3.5).cast("double"), F.size(v).cast("double")),
    }


def top_gap(top: Column, true: Column) -> Column:
    """Mean difference of the best and the true token's probability."""
    return mean(F.zip_with(top, true, lambda a, b: a - b))


def top_mean(top: Column) -> Column:
    """Mean of the best tokens' probabilities."""
    return mean(top)


def three_way(nll: Column, p95: Column, run: Column) -> Column:
    """-1 for weird, 1 for coherent, 0 for neither."""
    return F.when((nll > 3.5) | (p95 > 7.0) | (run >= 4), -1).when((nll < 2.2) & (p95 < 5.0) & (run <= 1), 1).otherwise(0)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return F.ln(q / (1 - q))


def wilson(good: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share; 0 without trials, never negative."""
    m = n.cast("double")
    p = good / m
    spread = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(n > 0, F.greatest(F.lit(0.0), (p + z * z / (2 * m) - spread) / (1 + z * z / m))).otherwise(F.lit(0.0))


def composite(cosine_: Column, bleu: Column, rouge: Column, corrected: Column, reduction: Column, weights: tuple[float, ...] = COMPOSITE) -> Column:
    """Weighted sum of five scores; the reduction is held in [-1, 1], and a null one counts as the corrected share."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    kept = F.when(reduction.isNull(), corrected).otherwise(F.greatest(F.lit(-1.0), F.least(reduction, F.lit(1.0))))
    parts = [w * c for w, c in zip(weights, (cosine_, bleu, rouge, corrected, kept))]
    return parts[0] + parts[1] + parts[2] + parts[3] + parts[4]


def unknown_share(terms: Column, known: Column) -> Column:
    """Distinct terms that aren't known, by distinct terms; 0 without terms."""
    distinct = F.array_distinct(terms)
    return F.coalesce(F.try_divide(F.size(F.array_except(distinct, known)).cast("double"), F.size(distinct).cast("double")), F.lit(0.0))


def too_long(length: Column, most: int = 30) -> Column:
    """The plain measure of complexity: more words than that."""
    return length > most


def complex_sentence(length: Column, depth: Column, least_zipf: Column) -> Column:
    """Long, deep, or with a rare word."""
    return (length > 24) | (depth > 4) | (least_zipf < 3)
