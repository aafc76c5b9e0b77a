"""Batched tables that are written twice or half, rows read by number, and constrained decoding against all cuts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import decoding as D
from lexiforge.sources import batches as B
from lexiforge.sources import tokenised as T


def test_batches_repeated_or_half_written_change_nothing(spark, tmp_path):
    words = B.words_table(spark, f"{tmp_path}/words")
    assert words.read().collect() == [] and words.committed() == []
    first = spark.createDataFrame([("run", "verb"), ("dog", "noun"), ("run", "verb"), ("run", None), (None, "noun")], "root string, pos string")
    assert B.add_words(words, first, 1) and not B.add_words(words, first.limit(1), 1)
    before = sorted(map(tuple, words.read().collect()), key=str)
    assert len(before) == 3
    os.makedirs(f"{tmp_path}/words/batch=2")  # a batch that stopped before its mark
    spark.createDataFrame([("x", "half", "noun")], words.schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/words/batch=2")
    os.remove(f"{tmp_path}/words/batch=2/_SUCCESS")
    assert words.committed() == [1] and sorted(map(tuple, words.read().collect()), key=str) == before
    assert B.add_words(words, first.unionByName(spark.createDataFrame([("cat", "noun"), ("run", "noun")], "root string, pos string")), 2)
    got = words.read().collect()
    assert len(got) == 5 and {r.root for r in got if r.batch == 2} == {"cat", "run"} and len({r.id for r in got}) == 5 and words.committed() == [1, 2]

    def bad(x):
        raise ValueError("stop")

    with pytest.raises(Exception):
        words.append(got and spark.createDataFrame(got).select(F.udf(bad)("id").alias("id"), "root", "pos"), 3)
    assert words.committed() == [1, 2] and words.read().count() == 5


def test_unknown_words_go_on_from_the_largest_id(spark, tmp_path):
    table = B.unknown_table(spark, f"{tmp_path}/unknown")
    one = spark.createDataFrame([(1, 0, "Zork ", "noun"), (1, 1, "blip", "noun"), (1, 2, "zork", "noun"), (1, 3, "hum", "verb"), (2, 0, "zork", "noun"), (2, 1, None, "noun")], "sentence_id long, pos int, word string, type string")
    assert B.add_unknown_words(table, one, 0) and not B.add_unknown_words(table, one, 0)
    two = spark.createDataFrame([(1, 0, "aaa", "noun"), (1, 1, "blip", "noun"), (1, 2, "bbb", "noun"), (3, 0, "zork", "noun")], one.schema)
    assert B.add_unknown_words(table, two, 1)
    assert sorted((r.sentence_id, r.type, r.id, r.word) for r in table.read().collect()) == [
        (1, "noun", 1, "zork"), (1, "noun", 2, "blip"), (1, "noun", 3, "aaa"), (1, "noun", 4, "bbb"), (1, "verb", 1, "hum"), (2, "noun", 1, "zork"), (3, "noun", 1, "zork")
    ]
    assert [r.id for r in B.unknown_id(table, " BLIP", "noun", 1).collect()] == [2] and B.unknown_id(table, "blip", "noun", 2).count() == 0


def test_insert_takes_the_first_by_order(spark, tmp_path):
    t = B.BatchedTable(spark, f"{tmp_path}/t", "k int, v string")
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (2, "c", 1), (None, "n", 1), (None, "m", 2)], "k int, v string, at int")
    assert t.insert_or_ignore(rows, 0, ["k"], ["at"]) and sorted(((r.k, r.v) for r in t.read().collect()), key=str) == [(1, "b"), (2, "c"), (None, "n")]
    assert t.insert_or_ignore(rows, 1, ["k"]) and t.read().count() == 3


def _files(df):
    """Files that the scan of an executed query read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getSimpleName() else plan
    todo = [plan]
    while todo:
        p = todo.pop()
        if p.metrics().contains("numFiles"):
            return p.metrics().apply("numFiles").value(), p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]


def test_rows_by_number_read_their_blocks_only(spark, tmp_path):
    rows = spark.range(40_000).select(F.col("id").alias("row_id"), F.concat(F.lit("w"), "id").alias("text"))
    done = T.encoded(rows, {"text": "ids"}, lambda ts: [[ord(c) for c in t] for t in ts], most=4)
    path = f"{tmp_path}/rows"
    T.write(done, path, span=5_000)
    T.write(done.limit(1), path, span=5_000)  # there already: nothing happens
    assert spark.read.parquet(path).count() == 40_000
    wanted = [7, 12_345, 12_346, 39_999, 50_000]
    got = T.at(spark, path, wanted, span=5_000)
    files, read = _files(got)
    assert files == 3 and read < 3 * 5_000 / 5  # three of eight folders, and few of their pages
    assert sorted((r.row_id, r.ids, r.ids_mask) for r in got.collect()) == [(n, [ord(c) for c in f"w{n}"][:4], [1] * len(f"w{n}"[:4])) for n in wanted[:-1]]
    chosen = spark.createDataFrame([(n,) for n in wanted] * 2, "row_id long")
    assert sorted(r.row_id for r in T.where(spark, path, chosen, span=5_000).collect()) == wanted[:-1]
    odd = T.encoded(spark.createDataFrame([(1, None), (2, "")], "row_id long, text string"), {"text": "ids"}, lambda ts: [[] for _ in ts]).orderBy("row_id").collect()
    assert odd[0].ids is None and odd[0].ids_mask is None and odd[1].ids == []


def _allowed(tokens, terms):
    """By all cuts of the tokens into terms and a prefix."""
    reached = {0}
    for e in range(1, len(tokens) + 1):
        if any(s in reached and tuple(tokens[s:e]) in terms for s in range(e)):
            reached.add(e)
    out = {t[len(tokens) - s] for s in reached for t in terms if len(t) > len(tokens) - s and list(t[: len(tokens) - s]) == tokens[s:]}
    return sorted(out), len(tokens) in reached


def test_following_tokens_match_all_cuts(spark):
    rng = random.Random(3)
    terms = {tuple(rng.choices(range(4), k=rng.randint(1, 4))) for _ in range(9)}
    table = spark.createDataFrame([(list(t),) for t in terms] * 2 + [([],), (None,)], "tokens array<int>")
    nodes, depth = D.trie(table), D.longest(table)
    assert depth == max(map(len, terms)) and nodes.where("size(prefix) = 0").first().next == sorted({t[0] for t in terms})
    rows = [[]] + [rng.choices(range(4), k=rng.randint(1, 9)) for _ in range(120)] + [[x for t in rng.choices(sorted(terms), k=4) for x in t] for _ in range(60)]
    got = D.following(spark.createDataFrame([*enumerate(rows), (None, rows[5]), (999, None)], "k int, tokens array<int>"), "k", "tokens", nodes, depth).collect()
    by = {r.k: (r.next, r.ends) for r in got}
    assert len(got) == len(rows) + 2 and by[999] == (None, None) and by[None] == _allowed(rows[5], terms)
    for k, t in enumerate(rows):
        assert by[k] == _allowed(t, terms), t
    none = D.trie(spark.createDataFrame([], "tokens array<int>"))
    assert none.collect() == [] and [tuple(r)[2:] for r in D.following(spark.createDataFrame([(1, [1]), (2, [])], "k int, tokens array<int>"), "k", "tokens", none, 0).orderBy("k").collect()] == [([], False), ([], True)]
