"""Transitions of tags: against plain code on odd rows, and without lists of a sentence's tokens."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexiforge.operators import tagging as T

KIND = "sentence_id bigint, pos int, tag string"


def test_transitions_match_plain_code(spark):
    rng = random.Random(10)
    cells = [(s, p, rng.choice(["A", "B", "C", None])) for s in (None, 1, 2, 3) for p in (None, -2, 0, 1, 5, 9) for _ in range(rng.randint(1, 3))]
    cells += cells[:9] + [(4, 0, None), (5, 3, "A")]  # repeated rows, sentences of one token
    rng.shuffle(cells)
    last = lambda x: (x is not None, x if x is not None else 0)
    want = Counter()
    for s in {c[0] for c in cells}:
        own = [t for _, t in sorted(((p, t) for k, p, t in cells if k == s), key=lambda c: (last(c[0]), c[1] is not None, c[1] or ""))]
        want.update(zip([None, *own], own))
    tokens = spark.createDataFrame(cells, KIND).repartition(6)
    done = T.transitions(tokens)
    assert done.columns == ["before", "tag", "n"]
    assert {(r.before, r.tag): r.n for r in done.collect()} == want
    assert T.transitions(tokens.limit(0)).collect() == []


def test_no_task_collects_tokens(spark):
    tokens = spark.range(10).select(F.col("id").alias("sentence_id"), F.lit(0).alias("pos"), F.lit("A").alias("tag"))
    plan = T.transitions(tokens)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("Exchange hashpartitioning(sentence_id") == 1
