"""Plans that the driver holds stay small: long ones are cut before they would stand in another several times over."""

from lexiforge.llm import common, mixing


def test_the_schedule_is_not_in_the_plan_of_the_mixed_texts(spark, odd):
    """Of the mix's windows only the one that numbers repeated rows is left."""
    got = mixing.mixed_documents(odd)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert got.columns == odd.columns


def test_edges_to_roots_settle_in_one_round(spark):
    edges = [(k, k % 3) for k in range(3, 60)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), most_rounds=1).collect()}
    assert got == {k: k % 3 for k in range(60)}
