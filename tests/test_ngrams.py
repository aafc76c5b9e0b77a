"""The word model against a plain one in Python, sums to one, and odd rows."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import gramcells, ngrams


def plain(texts, order):
    """p(word, words before it) of interpolated modified Kneser-Ney, straight from its definition, and the words."""
    counts = [None] * (order + 1)
    counts[order] = Counter(tuple(p[i : i + order]) for t in texts for p in [[""] * (order - 1) + t] for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    ds, kids = [None] * (order + 1), [None] * (order + 1)
    for k in range(1, order + 1):
        n = [sum(v == j for v in counts[k].values()) for j in range(5)]
        ds[k] = (0.5, 1.0, 1.5)
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            ds[k] = tuple(min(max(j - (j + 1) * y * n[j + 1] / n[j], 0), j) for j in (1, 2, 3))
        kids[k] = defaultdict(dict)
        for g, c in counts[k].items():
            kids[k][g[:-1]][g[-1]] = c
    words = {g[0] for g in counts[1]}

    def p(w, before, k=order):
        if k == 0:
            return 1 / (len(words) + 1)
        before = before[len(before) - (k - 1) :]
        own = kids[k].get(before)
        if not own:
            return p(w, before[1:], k - 1)
        off = lambda c: ds[k][min(c, 3) - 1]
        total = sum(own.values())
        return (own[w] - off(own[w]) if w in own else 0) / total + sum(map(off, own.values())) / total * p(w, before[1:], k - 1)

    return p, words


TEXTS = [t.split() for t in ("the cat sat on the mat", "the dog sat on the cat", "a cat and a dog", "the the the", "on the mat the cat sat", "dog", "a b c d e a b c a b", "the cat sat", "")]
OTHERS = [t.split() for t in ("the cat flew on a mat", "zebra zebra", "c d e a dog sat on", "x", "the a")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_match_the_definition(spark, order):
    own = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None)], "k int, w array<string>").repartition(3)
    other = spark.createDataFrame(list(enumerate(OTHERS)), "k int, w array<string>")
    model = ngrams.trained(own, F.col("w"), order)
    p, words = plain(TEXTS, order)
    for rows, texts in ((own, TEXTS), (other, OTHERS)):
        got = {r.k: r for r in ngrams.scored(rows, "k", F.col("w"), model).collect()}
        for k, t in enumerate(texts):
            before = [tuple([""] * (order - 1) + t[:i])[-(order - 1) :] if order > 1 else () for i in range(len(t))]
            if len(t) < 2:
                assert got[k].nll is None and got[k].top is None
                continue
            assert got[k].nll == pytest.approx([-math.log(p(w, b)) for w, b in list(zip(t, before))[1:]])
            assert got[k].top == pytest.approx([max(p(w, b) for w in words | {"?"}) for b in before[1:]])
    context = ("the", "cat")[2 - (order - 1) :] if order > 1 else ()
    assert sum(p(w, context) for w in words | {"?"}) == pytest.approx(1)


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "k int, w array<string>")
    model = ngrams.trained(empty, F.col("w"), 2)
    assert ngrams.scored(empty, "k", F.col("w"), model).collect() == []
    clash = spark.createDataFrame([(1, ["a\x1fb", "c", "a\x1eb"]), (2, ["a", "b\x1fc", "a\x1e1b"])], "k int, w array<string>")
    assert ngrams.gram_counts(clash, F.col("w"), 2).count() == 6
    rows = spark.createDataFrame([(None, ["a", "b"], "z"), (1, None, "z"), (2, ["a", "a", "a"], "z")], "k int, w array<string>, nll string")
    got = {r.k: r for r in ngrams.scored(rows, "k", F.col("w"), model, first=True).collect()}
    assert got[None].nll == [0.0, 0.0] and got[1].nll is None and len(got[2].nll) == 3
    with pytest.raises(ValueError):
        ngrams.trained(empty, F.col("w"), 0)


@pytest.mark.parametrize("sizes", [{}, {"frequent": 3, "piece": 5, "cell": 3, "heavy": 4, "bits": 7}])
def test_own_texts_match_the_definition(spark, sizes):
    rows = spark.createDataFrame(list(enumerate(TEXTS)) + [(99, None), (None, ["on", "the", "cat"])], "k int, w array<string>").repartition(3)
    texts = [*TEXTS, ["on", "the", "cat"]]
    p, words = plain(texts, 3)
    got = {r.k: r for r in gramcells.scored(rows, "k", F.col("w"), **sizes).collect()}
    assert set(got) == {k for k, t in [*enumerate(TEXTS), (None, texts[-1])] if len(t) > 1}
    for k, t in [*enumerate(TEXTS), (None, texts[-1])]:
        if len(t) > 1:
            before = [tuple(["", ""] + t[:i])[-2:] for i in range(1, len(t))]
            assert got[k].nll == pytest.approx([-math.log(p(w, b)) for w, b in zip(t[1:], before)])
            assert got[k].top == pytest.approx([max(p(w, b) for w in words | {"?"}) for b in before])


def test_own_texts_odd_rows(spark):
    empty = spark.createDataFrame([], "k int, w array<string>")
    assert gramcells.scored(empty, "k", F.col("w")).collect() == []
    twice = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b", "c"]), (2, ["x"]), (3, [])], "k int, w array<string>")
    assert [(r.k, len(r.nll), len(r.top)) for r in gramcells.scored(twice, "k", F.col("w")).collect()] == [(1, 3, 3)]


def test_own_texts_shuffle_few_bytes_a_word(spark):
    rows = spark.range(40).select("id", F.expr("transform(sequence(1, 1000), i -> concat('word', cast(pow(pmod(xxhash64(id, i), 1000) / 10.0D, 2) as int)))").alias("w"))
    sent = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = sent()
    gramcells.scored(rows, "id", F.col("w")).write.format("noop").mode("overwrite").save()
    assert sent() - before < 40 * 40_000  # 119 bytes a word by joins with tables of grams
