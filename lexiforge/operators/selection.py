"""Splits, shuffles and selections.  Randomness is a hash order, so results don't depend on partitioning."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.pairs import ranked, ranked_within
from lexiforge.operators.stored import stored


def hash_order(key: Column, seed: int = 42) -> Column:
    """A pseudo-random order of keys: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """rows with place: 1..n in hash order."""
    return ranked(rows.withColumn("__h", F.struct(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))), "__h", "place").drop("__h")


def first_and_rest(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """rows with part: first (n of them) or rest."""
    return shuffled(rows, key, seed).withColumn("part", F.when(F.col("place") <= n, "first").otherwise("rest"))


def counted_split(rows: DataFrame, key: str, dev: int, test: int, seed: int = 42) -> DataFrame:
    """rows with part: the first dev, the next test, the rest train."""
    part = F.when(F.col("place") <= dev, "dev").when(F.col("place") <= dev + test, "test").otherwise("train")
    return shuffled(rows, key, seed).withColumn("part", part)


def ninths_split(rows: DataFrame, key: str, train: int | None = None, seed: int = 42) -> DataFrame:
    """rows with part: in hash order the first `train` train and a ninth as many dev, others are null; without a number nine tenths train, one tenth dev, both rounded down."""
    if train is not None and train <= 0:
        raise ValueError("the number of training rows must be positive")
    sizes = rows.agg(F.count("*").alias("__n")).select(*([F.lit(train).cast("long").alias("__a"), F.lit(train // 9).cast("long").alias("__b")] if train else [F.expr("__n * 90 div 100").alias("__a"), F.expr("__n * 10 div 100").alias("__b")]))
    part = F.when(F.col("place") <= F.col("__a"), "train").when(F.col("place") <= F.col("__a") + F.col("__b"), "dev")
    return shuffled(rows, key, seed).crossJoin(F.broadcast(sizes)).withColumn("part", part).drop("__a", "__b")


def first_lines(rows: DataFrame, n: int, order: str = "row_id", start: int = 0) -> DataFrame:
    """The rows whose number (from start) is among the first n: a filter that reaches the scan, not a limit over an unordered table."""
    return rows.where(F.col(order) < start + n)


def shared_split(rows: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """rows with part: percent of them train, of the rest the first half dev, the other test."""
    total = F.broadcast(rows.agg(F.count("*").alias("__n")))
    cut = F.expr(f"__n * {percent} div 100")
    half = F.expr(f"(__n - __n * {percent} div 100) div 2")
    part = F.when(F.col("place") <= cut, "train").when(F.col("place") <= cut + half, "dev").otherwise("test")
    return shuffled(rows, key, seed).crossJoin(total).withColumn("part", part).drop("__n")


def ends_split(rows: DataFrame, key: str, chunk: int, end: int) -> DataFrame:
    """rows by key order with part: of the first `chunk`, the first `end` are dev, the last test (they may overlap: test wins), all others train."""
    part = F.when(F.col("place") > chunk, "train").when(F.col("place") > chunk - end, "test").when(F.col("place") <= end, "dev").otherwise("train")
    return ranked(rows, key, "place").withColumn("part", part)


def hashed_split(rows: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """rows with train: about percent of them, decided row by row (no sort)."""
    return rows.withColumn("train", F.conv(F.substring(hash_order(F.col(key), seed), 1, 7), 16, 10).cast("long") % 100 < percent)


def stratified(rows: DataFrame, key: str, stratum: str, fraction: float, seed: int = 42) -> DataFrame:
    """rows with chosen: in each stratum the first round-half-even(fraction * n) in hash order."""
    placed = ranked_within(rows.withColumn("__h", F.struct(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"))), stratum, "__h", "__at")
    sizes = rows.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    chosen = F.col("__at") <= F.bround(F.col("__n") * fraction)
    return placed.join(sizes, F.col(stratum).eqNullSafe(F.col("__s"))).withColumn("chosen", chosen).drop("__h", "__at", "__n", "__s")


def folds(rows: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """rows with fold 0..k-1: place in hash order modulo k."""
    return shuffled(rows, key, seed).withColumn("fold", ((F.col("place") - 1) % k).cast("int")).drop("place")


def random_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order (a sampling operator)."""
    return rows.orderBy(hash_order(F.col(key), seed), key).limit(n)


def _prime_from(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def with_distractors(rows: DataFrame, key: str, terms: str, pool: DataFrame, low: float = 1.5, high: float = 3.5, seed: int = 42) -> DataFrame:
    """rows with candidates: their terms and others drawn from the whole pool, in hash order; n terms get round(u * n) - n others
    (the whole pool if it has fewer), u in [low, high).

    The pool is ranked in hash order.  A row draws the ranks start, start + step, ... modulo the least prime that isn't below
    the pool's size, which never repeat; ranks beyond the pool are passed over.  Draws meet the pool in an equi-join.
    """
    stock = ranked(pool.select(F.col(pool.columns[0]).alias("__t")).distinct().withColumn("__h", F.struct(hash_order(F.col("__t"), seed).alias("h"), F.col("__t").alias("k"))), "__h", "__rank").select("__t", "__rank")
    size = stock.count()
    prime = _prime_from(size)
    number = lambda s: F.conv(F.substring(hash_order(F.col(key), s), 1, 7), 16, 10).cast("long")
    u = number(seed + 1).cast("double") / float(1 << 28) * (high - low) + low
    n = F.size(terms)
    more = F.least(F.greatest(F.lit(0), F.bround(u * n).cast("int") - n), F.lit(size))
    start, step = number(seed + 2) % prime, 1 + number(seed + 3) % max(1, prime - 1)
    places = F.transform(F.sequence(F.lit(0), more + (prime - size)), lambda i: (start + i * step) % prime)
    drawn = F.slice(F.filter(places, lambda p: p < size), 1, more)
    each = rows.select(F.col(key).alias("__key"), F.explode(drawn).alias("__rank")).withColumn("__rank", F.col("__rank") + 1)
    got = each.join(stock, "__rank").groupBy("__key").agg(F.collect_list("__t").alias("__drawn"))
    order = lambda t: F.struct(F.md5(F.concat_ws(":", F.col(key).cast("string"), t).cast("binary")).alias("h"), t.alias("t"))
    both = F.concat(F.col(terms), F.coalesce("__drawn", F.array().cast("array<string>")))
    return rows.join(got, F.col(key) == F.col("__key"), "left").withColumn("candidates", F.array_sort(F.transform(both, order))["t"]).drop("__key", "__drawn")


def balanced_merge(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All bins' rows in one shuffled order (place)."""
    return shuffled(rows, key, seed)


def best_candidates(rows: DataFrame, group: str, score: str, marks: str, order: str, allowed: Column, least: float) -> DataFrame:
    """The candidate of each group by bin (few marks and good score, few marks, any), then by score, then first; with its criteria."""
    few, good = F.col(marks) <= allowed, F.col(score) >= least
    rank = F.when(few & good, 0).when(few, 1).otherwise(2)
    at = F.row_number().over(Window.partitionBy(group).orderBy(rank, F.desc(score), order))
    return rows.withColumn("met_ok", few).withColumn("sim_ok", good).withColumn("__at", at).where("__at = 1").drop("__at")


def greedy_cover(rows: DataFrame, bin_: str, key: str, terms: str, most: int, at_once: int = 512) -> DataFrame:
    """(bin, key, rank, gain): in each bin up to `most` rows that add the most uncovered terms, ties to the smallest key.

    When nothing adds a term, the rest is filled in hash order.  Rounds over (bin, key, term) rows: Spark counts what every
    row still adds, and a bin's best at_once rows are picked from in one task for as long as none outside can beat them (a
    row never adds more than it did before); their terms leave by an anti-join.  The picks are what one at a time would give.
    """
    kind = dict(rows.dtypes)
    narrow = rows.select(F.col(bin_).alias("b"), F.col(key).alias("k"), F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t))).alias("t")).where("size(t) > 0")
    left = narrow.select("b", "k", F.explode("t").alias("t"))
    schema = f"b {kind[bin_]}, k {kind[key]}, rank int, gain int, t array<bigint>"

    def pick(pdf):
        import pandas as pd

        pdf = pdf.sort_values("at")
        inside = pdf[pdf["at"] <= at_once]
        outside = [(-int(g), k) for g, k in zip(pdf["gain"], pdf["k"])][at_once:]
        sets, n, covered, out = {k: set(t) for k, t in zip(inside["k"], inside["t"])}, int(pdf["n"].iloc[0]), set(), []
        heap = [(-len(s), k) for k, s in sets.items()]
        heapq.heapify(heap)
        while heap and len(out) < most - n and not (outside and outside[0] < heap[0]):
            bound, k = heapq.heappop(heap)
            gain = len(sets[k] - covered)
            if gain == -bound:
                out.append((pdf["b"].iloc[0], k, n + len(out) + 1, gain, list(sets[k])))
                covered |= sets[k]
            elif gain:
                heapq.heappush(heap, (-gain, k))
        return pd.DataFrame(out, columns=["b", "k", "rank", "gain", "t"])

    spark, picks, counts = rows.sparkSession, None, {}
    while True:
        done = spark.createDataFrame(list(counts.items()) or [], f"b {kind[bin_]}, n int")
        gains = left.groupBy("b", "k").agg(F.count("*").alias("gain"), F.collect_list("t").alias("t"))
        gains = gains.join(F.broadcast(done), gains["b"].eqNullSafe(done["b"]), "left").drop(done["b"]).withColumn("n", F.coalesce("n", F.lit(0))).where(f"n < {most}")
        best = gains.withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("gain"), "k"))).where(f"at <= {at_once + 1}")
        got = stored(best.groupBy("b").applyInPandas(pick, schema))
        found = got.groupBy("b").agg(F.max("rank")).collect()  # a row for each bin
        if not found:
            break
        counts |= {b: n for b, n in found}
        picks = got if picks is None else picks.unionByName(got)
        used = got.select(F.col("b").alias("__b"), F.explode("t").alias("__t"))
        left = stored(left.join(used, left["b"].eqNullSafe(used["__b"]) & (left["t"] == used["__t"]), "left_anti"))
    if picks is None:
        return narrow.select(F.col("b").alias(bin_), F.col("k").alias(key), F.lit(0).alias("rank"), F.lit(0).alias("gain")).limit(0)
    picked = picks.select("b", "k", "rank", "gain")
    done = spark.createDataFrame(list(counts.items()), f"b {kind[bin_]}, n int")
    rest = narrow.select("b", "k").join(picked.select(F.col("k").alias("__k"), F.col("b").alias("__b")), (F.col("k") == F.col("__k")) & F.col("b").eqNullSafe(F.col("__b")), "left_anti")
    rest = rest.withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy(hash_order(F.col("k")), "k"))).where(f"at <= {most}")
    rest = rest.join(F.broadcast(done), rest["b"].eqNullSafe(done["b"])).drop(done["b"]).where(f"n + at <= {most}").select("b", "k", (F.col("n") + F.col("at")).cast("int").alias("rank"), F.lit(0).alias("gain"))
    return picked.unionByName(rest).select(F.col("b").alias(bin_), F.col("k").alias(key), "rank", "gain")


def weakest(summary: DataFrame, protected: list[str], name: str = "feature", mean_abs: str = "weight_mean_abs", pos: str = "pos") -> DataFrame:
    """The unprotected feature of the least weight."""
    return summary.where(~F.col(name).isin(protected)).orderBy(mean_abs, F.desc(pos)).limit(1)
