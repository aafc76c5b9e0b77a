"""Two-level scans against single windows, the range join against all pairs, and long statements."""

import random
from time import perf_counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiforge.functions import python as P
from lexiforge.functions import sequences as N
from lexiforge.functions import text as X
from lexiforge.operators import oov as V
from lexiforge.operators import pairs as O


@pytest.mark.parametrize("how, before", [(h, b) for h in ("last", "sum", "max") for b in (False, True)])
def test_scans_match_one_window(spark, how, before):
    rng = random.Random(4)
    cells = [(rng.choice(["a", "b", None]), i, rng.choice([None, None, rng.randint(-5, 5)])) for i in range(-20, 300)]
    rows = spark.createDataFrame(cells, "file string, n long, v int").repartition(7)
    f = {"last": lambda v: F.last(v, ignorenulls=True), "sum": F.sum, "max": F.max}[how]
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = sorted(map(tuple, rows.withColumn("x", f("v").over(w)).collect()), key=str)
    for stretch in (1, 7, 1000):
        assert sorted(map(tuple, O.scanned(rows, F.col("v"), "n", ["file"], how, "x", before, stretch).collect()), key=str) == want
    assert O.scanned(rows.limit(0), F.col("v"), "n", ["file"], how, "x").columns == ["file", "n", "v", "x"]


def test_one_large_file_is_many_tasks(spark):
    """A million lines of one file: equal to the plain numbers, and no task has all of them."""
    rows = spark.range(1_000_000).select(F.lit("f").alias("file"), F.col("id").alias("line_num"), F.when(F.col("id") % 1009 == 0, "").otherwise("x").alias("value"))
    done = O.segments(rows, F.col("value") == "", "line_num", ["file"], stretch=50_000)
    assert done.where(F.col("segment") != F.floor(F.col("line_num") / 1009) + 1).count() == 0
    words = rows.withColumn("word", F.when(F.col("line_num") % 10 == 9, ".").otherwise("w"))
    assert O.corpus_sentences(words, stretch=50_000).where(F.col("sentence") != F.floor(F.col("line_num") / 10)).count() == 0
    shares = [r.n for r in done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(shares) > 1 and max(shares) < 700_000


def test_rows_after_the_first_marker(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 2, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 1), ("a", 4, 0), ("b", 1, 0)], "g string, n int, m int")
    assert sorted(map(tuple, O.after_marker(rows, F.col("m") == 1, "n", ["g"]).collect()), key=str) == [("a", 3, 1), ("a", 4, 0), (None, 2, 0)]


def test_range_join_matches_all_pairs(spark):
    rng = random.Random(5)
    words = [(s, rng.randint(0, 60), "".join(rng.choices("ab.,!", k=rng.randint(0, 40)))) for s in (1, 2, None) for _ in range(25)]
    hits = [(s, rng.randint(0, 110)) for s in (1, 2, 3) for _ in range(8)] + [(1, None)]
    want = {(s, a, w.strip("!.,")) for s, a, w in words for t, p in hits if s is not None and s == t and p is not None and a <= p < a + len(w)}
    for cell in (1, 16, 500):
        got = V.snapped_join(spark.createDataFrame(words, "sentence_id int, start int, word string"), spark.createDataFrame(hits, "sentence_id int, at int"), cell).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_long_statements_take_linear_time(spark):
    texts = ["(a (b c)) " * 100_000, "(" * 500_000 + ")" * 500_000, ")" * 1_000_000, "x" * 1_000_000, None, "", "a ) ( b (c)", "(p) q (r) s t"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    at = perf_counter()
    got = [r.p for r in rows.select("k", X.statement_parts(F.col("s")).alias("p")).orderBy("k").collect()]
    assert perf_counter() - at < 30
    assert got[0] == ["(a (b c))"] * 100_000 and got[1] == [texts[1]] and got[3] == [texts[3]] and got[4] is None and got[5] == []
    assert got[2] == [texts[2]] and got[6] == ["a ) ( b (c)"] and got[7] == ["(p)", "q (r) s t"]


def test_repetition_counts(spark):
    rng = random.Random(6)
    rows = [rng.choices(["a", "b", "\0", "a\0", None, "日"], k=rng.randint(0, 12)) for _ in range(80)] + [None]
    got = spark.createDataFrame(list(enumerate(rows)), "k int, t array<string>").select("k", P.repetition(F.col("t")).alias("m"), *[c.alias(n) for n, c in N.repetition(F.col("t")).items()]).orderBy("k").collect()
    for t, r in zip(rows, got):
        if t is None:
            assert r.m is None
            continue
        pairs = list(zip(t, t[1:]))
        assert tuple(r.m) == (len(t), len(set(t)), sum(a == b for a, b in pairs), sum(pairs.count(p) > 1 for p in pairs))
        assert len(t) > 1 or (r.uniq_token_ratio, r.rep_1gram, r.rep_2gram) == (1, 0, 0)
