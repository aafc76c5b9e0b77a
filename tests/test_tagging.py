"""The hidden Markov tagger against all paths, its tables, unknown words, and accuracy on sentences it hasn't seen."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import tagging as T


def test_best_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(8)
    for n in range(6):
        moves = np.log(rng.dirichlet(np.ones(4), 5))
        steps = [sorted((int(t), float(rng.normal())) for t in rng.choice(4, int(rng.integers(1, 5)), replace=False)) for _ in range(n)]
        got, score = T.best_path(moves, steps)
        all_ = {tuple(t for t, _ in p): sum(v for _, v in p) + sum(moves[0 if i == 0 else p[i - 1][0] + 1, t] for i, (t, _) in enumerate(p)) for p in product(*steps)}
        assert score == pytest.approx(max(all_.values())) and all_[tuple(got)] == pytest.approx(score)


def rows_of(spark, sentences):
    """word/TAG/root texts as tokens."""
    cells = [(i, p, *x.split("/")) for i, s in enumerate(sentences) for p, x in enumerate(s.split())]
    return spark.createDataFrame([(*c, None)[:5] for c in cells], "sentence_id int, pos int, word string, tag string, root string")


GIVEN = ["the/D/the dogs/N/dog ran/V/run", "the/D/the runs/N/run ended/V/end", "he/P/he runs/V/run", "she/P/she runs/V/run", "a/D/a cat/N/cat jumped/V/jump", "she/P/she walked/V/walk"]


def test_tables_and_tags(spark):
    tokens = rows_of(spark, GIVEN)
    tagger = T.trained(tokens.repartition(5))
    assert tagger.tags == ("D", "N", "P", "V")
    row = np.full(4, T.ADDED) + [3, 0, 3, 0]
    assert tagger.moves[0] == pytest.approx(np.log(row / row.sum()))
    lexicon = {r.word: [(o.tag, o.score) for o in r.options] for r in tagger.lexicon.collect()}
    assert lexicon["runs"] == [(1, pytest.approx(math.log(1 / 3))), (3, pytest.approx(math.log(2 / 6)))]
    new = spark.createDataFrame([(7, 0, "the"), (7, 1, "runs"), (7, 2, "talked"), (8, 0, "he"), (8, 1, "runs"), (9, 0, None), (8, 2, "日")], "sentence_id int, pos int, word string")
    got = sorted((r.sentence_id, r.pos, r.text, r.lemma, r.upos) for r in T.tagged(new, tagger).collect())
    assert got[:5] == [(7, 0, "the", "the", "D"), (7, 1, "runs", "run", "N"), (7, 2, "talked", "talked", "V"), (8, 0, "he", "he", "P"), (8, 1, "runs", "run", "V")]
    assert len(got) == 6 and got[5][:4] == (8, 2, "日", "日")
    seen = {r.word: r.known for r in T.options(new.select("word").where("word is not null").distinct(), tagger).collect()}
    assert seen == {"the": True, "runs": True, "talked": False, "he": True, "日": False}


def test_endings_are_smoothed_from_shorter_ones(spark):
    tagger = T.trained(rows_of(spark, GIVEN))
    prior = np.array([3, 3, 3, 6]) / 15
    theta = np.std(prior, ddof=1)
    of = {r.ending: {o.tag: o.score for o in r.options} for r in tagger.endings.collect()}
    one = (np.array([0, 0, 0, 3]) / 3 + theta * prior) / (1 + theta)  # d: ended, jumped, walked
    two = (np.array([0, 0, 0, 1.0]) + theta * one) / (1 + theta)  # ed
    assert of["ed"] == pytest.approx(dict(enumerate(np.log(two / prior)))) and of[""] == pytest.approx(dict.fromkeys(range(4), 0.0))


def test_accuracy_on_unseen_sentences(spark):
    """Texts made by a hidden chain of tags, whose words' endings tell of the tag: tags of held-out sentences, with words not seen before."""
    rng = np.random.default_rng(9)
    chain, ends = rng.dirichlet(np.ones(4) * 0.4, 5), ["ing", "ed", "ly", "ness"]
    words = [[f"{''.join(rng.choice(list('abcdefgh'), 4))}{ends[t]}" for _ in range(150)] + ["set", "run", "like"] for t in range(4)]
    cells = []
    for s in range(600):
        t = -1
        for p in range(12):
            t = int(rng.choice(4, p=chain[t + 1]))
            cells.append((s, p, str(rng.choice(words[t])), "ABCD"[t]))
    tokens = spark.createDataFrame(cells, "sentence_id int, pos int, word string, tag string")
    tagger = T.trained(tokens.where("sentence_id < 60"))
    held = tokens.where("sentence_id >= 60")
    both = T.tagged(held.drop("tag"), tagger).join(held, ["sentence_id", "pos"])
    right, unknown = both.agg(F.avg((F.col("upos") == F.col("tag")).cast("int"))).first()[0], held.join(tagger.lexicon, "word", "left_anti").count()
    assert right > 0.97 and unknown > 500


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "sentence_id int, pos int, word string, tag string")
    tagger = T.trained(empty)
    assert tagger.tags == () and T.tagged(empty, tagger).collect() == []
    one = T.trained(spark.createDataFrame([(1, 0, "a", "X"), (None, 0, "b", "X"), (1, 1, None, "Y")], "sentence_id int, pos int, word string, tag string"))
    assert [(r.text, r.upos) for r in T.tagged(spark.createDataFrame([(1, 0, "zz"), (1, 0, "zz")], "sentence_id int, pos int, word string"), one).collect()] == [("zz", "X")] * 2


def test_sentences_together_have_the_paths_they_have_alone():
    rng = np.random.default_rng(3)
    moves, size, sizes = np.log(rng.dirichlet(np.ones(4), 5)), rng.integers(1, 5, 20), rng.integers(1, 6, 40)
    tags = np.concatenate([np.sort(rng.choice(4, n, replace=False)) for n in size])
    scores, words = rng.normal(size=len(tags)), rng.integers(0, 20, sizes.sum())
    start, ends = np.cumsum(size) - size, np.cumsum(sizes)
    path, best = T.best_paths(moves, sizes, words, size, tags, scores)
    for n, e, score in zip(sizes, ends, best):
        assert T.best_path(moves, [[(int(tags[j]), float(scores[j])) for j in range(start[w], start[w] + size[w])] for w in words[e - n : e]]) == (path[e - n : e].tolist(), score)


def test_words_of_texts_are_looked_up_once_a_piece(spark):
    texts = spark.range(40).select(F.col("id").alias("sentence_id"), F.expr("transform(sequence(1, 1000), i -> concat('word', pmod(xxhash64(id, i), 300)))").alias("w"))
    tokens = texts.select("sentence_id", F.posexplode("w").alias("pos", "word")).withColumn("tag", F.substring("word", -1, 1))
    links = T.text_transitions(texts, F.transform("w", lambda w: F.substring(w, -1, 1)))
    assert sorted(map(str, links.collect())) == sorted(map(str, T.transitions(tokens).collect()))
    tagger = T.trained(tokens, links)
    sent = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = sent()
    T.tagged_texts(texts, F.col("sentence_id"), F.col("w"), tagger).write.format("noop").mode("overwrite").save()
    assert sent() - before < 10 * 40_000  # tokens carried their options before
