"""Commands that no other test runs, the kernel machine, and trained models in the commands' places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge import api
from lexiforge.operators import kernels as R
from lexiforge.operators import models as M
from lexiforge.operators import tagging as T

KIF = ["(subclass Dog Animal)", "(instance Rex Dog)", "(subclass Animal Object)", "; (subclass Ghost Thing)"]


@pytest.fixture
def base(tmp_path):
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "Merge.kif").write_text("\n".join(KIF))
    return str(tmp_path / "kb")


def session(spark, tmp_path, **more):
    return api.Session(spark, str(tmp_path / "base"), spark.createDataFrame([("dog", "noun")], "root string, pos string"), **more)


def test_statements_are_checked(spark, tmp_path, base):
    (tmp_path / "set.txt").write_text("(instance Rex Dog)\n\n(instance Cat Dog\n(subclass Dog Animal)\n")
    s = session(spark, tmp_path)
    got = {r.row_id: r for r in s.run(f"rsts {tmp_path}/set.txt {base}").collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "valid", 3: "invalid", 4: "valid"}
    assert got[3].missing == "Cat" and got[1].missing in ("", "None", None)
    some = s.rrts(spark.createDataFrame([(i, "(instance Rex Dog)") for i in range(9)], "row_id int, statement string"), base, 4).collect()
    assert len(some) == 4 and s.run(f"runrandtestset {tmp_path}/set.txt {base}").count() == 3


def test_new_terms_from_mapping_lines(spark, tmp_path, base):
    (tmp_path / "map.txt").write_text("; comment\n00000001 05 n 01 puppy 0 000 | a young dog &%Dog+\n00000002 05 n 01 dog 0 000 | a dog &%Dog=\n")
    got = [r.value for r in session(spark, tmp_path).run(f"gwnk {tmp_path}/map.txt {base}").collect()]
    assert "(subclass PuppyDog Dog)" in got and '(termFormat EnglishLanguage PuppyDog "puppy")' in got


def test_a_file_line_by_line(spark, tmp_path):
    (tmp_path / "in.txt").write_text("One dog. Two dogs.\n\nThree.\n")
    got = session(spark, tmp_path, translate=lambda t: f"({t})").run(f"add_lbl {tmp_path}/in.txt").collect()
    assert sorted((r.line_number, r.value) for r in got) == [(1, "!!"), (1, "(One dog .)"), (1, "(Two dogs .)"), (3, "!!"), (3, "(Three .)")]


def test_a_trained_tagger_takes_the_rules_place(spark, tmp_path):
    cells = [(i, p, *x.split("/")) for i, t in enumerate(["the/X dog/NOUN sleeps/VERB", "a/X cat/NOUN eats/VERB"]) for p, x in enumerate(t.split())]
    tagger = T.trained(spark.createDataFrame(cells, "sentence_id int, pos int, word string, tag string"))
    got = M.tagged(spark.createDataFrame([(1, "the cat sleeps"), (2, ""), (3, None)], "sentence_id int, text string"), tagger).orderBy("pos").collect()
    assert [(r.sentence_id, r.text, r.upos) for r in got] == [(1, "the", "X"), (1, "cat", "NOUN"), (1, "sleeps", "VERB")]
    hidden, words = session(spark, tmp_path, tagger=tagger).masked(spark.createDataFrame([(1, "the cat sleeps"), (2, "a dog eats")], "sentence_id int, text string"))
    assert sorted(r.text for r in hidden.collect()) == ["a dog UNK_verb_1", "the UNK_noun_1 UNK_verb_1"] and words.count() == 3


def test_projection_nears_the_kernel(spark):
    rng = np.random.default_rng(1)
    w, b = rng.normal(0, math.sqrt(2 * 0.5), (3000, 3)), rng.uniform(0, 2 * math.pi, 3000)
    x = rng.normal(size=(5, 3))
    z = np.array([r.z for r in spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>").orderBy("i").select(R.projected(F.col("v"), w, b).alias("z")).collect()])
    want = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.08 and np.allclose(z, math.sqrt(2 / 3000) * np.cos(x @ w.T + b))


def test_kernel_machine_learns_what_no_line_can(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 2))
    y = ((x**2).sum(1) < 1.4).astype(int)
    rows = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "k int, a double, b double, y int")
    machine = R.fitted(rows.where("k < 900"), ["a", "b"], "k", size=64, gamma=0.7)
    held = R.scored(rows.where("k >= 900"), machine)
    right, mean = held.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")), F.avg("p")).first()
    same = M.fit_and_score(rows.where("k < 900"), rows.where("k >= 900"), ["a", "b"], "kernel")
    assert same.columns == [*rows.columns, "p"] and same.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0] > 0.93
    assert right > 0.93 and abs(mean - y[900:].mean()) < 0.06
    margins = [(r.margin, r.p) for r in held.orderBy("margin").collect()]
    assert machine.slope > 0 and all(p <= q for (_, p), (_, q) in zip(margins, margins[1:]))
    odd = R.scored(spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 0.0, 0.0)], "k int, a double, b double"), machine).orderBy("k").collect()
    assert odd[0].p is None and odd[1].p is None and odd[2].p > 0.5
