"""Ids by first appearance: against plain code on odd rows, and without a sort of every occurrence."""

import random

import pytest

from lexiforge.operators import pairs as O

LEAST, MOST = -(2**63), 2**63 - 1


def wanted(cells):
    first = lambda c: (c[0] is not None, c[0] if c[0] is not None else 0, c[1] is not None, c[1] or 0)
    met = {}
    for c in sorted(cells, key=first):
        met.setdefault(c[2], []).append(c)
    return [(t, i + 1, len(own)) for i, (t, own) in enumerate(met.items())]


@pytest.mark.parametrize("kind, keys", [("bigint", [None, LEAST, LEAST + 1, -1, 0, 1, 7, MOST - 1, MOST]), ("int", [None, -5, 0, 3]), ("string", [None, "", "a", "b"])])
def test_ids_follow_the_first_place(spark, kind, keys):
    rng = random.Random(9)
    places = [(k, p) for k in keys for p in (None, -3, 0, 1, 2, 2**31 - 1)]
    cells = [(k, p, f"t{i % 23}" if i % 7 else None) for i, (k, p) in enumerate(places)]
    cells += rng.choices(cells, k=30)  # repeated rows
    rng.shuffle(cells)
    rows = spark.createDataFrame(cells, f"row_id {kind}, pos int, term string").repartition(5)
    done = O.term_ids(rows)
    assert done.dtypes == [("term", "string"), ("id", "bigint"), ("count", "bigint")]
    assert sorted(map(tuple, done.collect()), key=lambda r: r[1]) == wanted(cells)
    assert O.term_ids(rows.limit(0)).collect() == []


def test_no_task_sorts_the_occurrences(spark):
    rows = spark.createDataFrame([(1, 0, "a")], "row_id bigint, pos int, term string")
    assert "SortAggregate" not in O.term_ids(rows)._jdf.queryExecution().executedPlan().toString()
