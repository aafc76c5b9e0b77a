"""Goldens, shuffled inputs, and empty or odd rows for table operators, sources, streams and commands."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge import api
from lexiforge.functions import text as X
from lexiforge.operators import calibration as K
from lexiforge.operators import knowledge as G
from lexiforge.operators import models as M
from lexiforge.operators import oov as V
from lexiforge.operators import pairs as O
from lexiforge.operators import scramble as C
from lexiforge.operators import selection as S
from lexiforge.operators import wordnet as W
from lexiforge.sources import readers, writers
from lexiforge.streaming import rowlocal


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tokens(spark, sentences):
    out = [(i, p, w, w.lower(), "VERB" if w in ("hike", "swim", "went") else "NOUN" if w in ("dog", "park") else "X") for i, s in enumerate(sentences) for p, w in enumerate(s.split())]
    return spark.createDataFrame(out, "sentence_id int, pos int, text string, lemma string, upos string")


def test_masking_goldens(spark):
    known = spark.createDataFrame([("run", "verb"), ("play", "verb"), ("go", "verb"), ("dog", "noun"), ("went", "verb")], "root string, pos string")
    typed = V.unknown_tokens(tokens(spark, ["We hike and swim", "John and his dog went to the park", "hike hike swim"]), known)
    typed = typed.withColumn("type", F.when(F.col("text") == "John", "PERSON").otherwise(F.col("type")))
    text, words = V.masked(typed)
    assert rows(text) == [(0, "We UNK_verb_1 and UNK_verb_2"), (1, "UNK_PERSON_1 and his dog went to the UNK_noun_1"), (2, "UNK_verb_1 UNK_verb_1 UNK_verb_2")]
    assert rows(V.masked(typed.repartition(7))[0]) == rows(text)
    assert V.largest_id(words).where("sentence_id = 9").count() == 0
    back = V.unmasked(text.select("sentence_id", F.lit(1).alias("line_num"), "text"), words)[0]
    assert rows(back.select("sentence_id", "text"))[0] == (0, "We hike and swim")


def test_unmask_goldens(spark):
    words = spark.createDataFrame([(1, 1, "Paris", "GPE"), (2, 1, "John", "PERSON"), (3, 1, "Google", "ORG"), (4, 1, "123Main", "LOC")], "id int, sentence_id int, word string, type string")
    lines = readers_lines(spark, ["SentenceId:1", "UNK_GPE_1 UNK_PERSON_2 UNK_ORG_3 UNK_LOC_4", "UNK_WORK_OF_ART_12 stays"])
    done, used = V.unmasked(V.read_tagged(lines), words)
    assert [r.text for r in done.orderBy("line_num").collect()] == ["Paris John Google num_123Main", "UNK_WORK_OF_ART_12 stays"]
    got = sorted(r.value for r in V.axioms(used).collect())
    assert got == ['( and ( instance John Human ) (names "John" John ) )', "( instance Google Organization )", "( instance Paris GeopoliticalArea )", "( instance num_123Main GeographicArea )"]


def readers_lines(spark, lines, file="f"):
    return spark.createDataFrame([(file, i + 1, v) for i, v in enumerate(lines)], "file string, line_num int, value string")


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "?x"), ("d", "e"), ("a", "a")], "parent string, child string")
    assert rows(G.closure(edges, "a")) == [("a",), ("b",), ("c",)] and rows(G.closure(edges, "?q")) == [] and rows(G.closure(edges, "z")) == [("z",)]


def test_statements_and_type_check(spark):
    lines = readers_lines(spark, ["(subclass Dog Animal) ; note", ";; (x y)", "(instance Rex Dog)", "not one", "()", "(=> (p ?X) q)"], "a/b.kif")
    st = readers.statements(lines)
    assert [(r.relation, r.args) for r in st.orderBy("line_num").collect()] == [("subclass", ["Dog", "Animal"]), ("instance", ["Rex", "Dog"]), ("=>", ["(p", "?X)", "q"])]
    assert rows(G.closure(G.downward_edges(st), "Animal")) == [("Animal",), ("Dog",), ("Rex",)]
    known = spark.createDataFrame([("Dog", "b.kif"), ("Dog", "a.kif")], "word string, file string")
    got = G.type_check(spark.createDataFrame([(1, "(instance Cat Dog)"), (2, "")], "row_id int, statement string"), known).orderBy("row_id").collect()
    assert tuple(got[0]) == (1, "Word: 'Cat' not found in any .kif files. | Word: 'Dog' found in a.kif", "Cat", "Cat") and tuple(got[1]) == (2, "", "None", "None")
    assert G.coverage(lines.limit(0).withColumn("row_id", F.lit(1)), X.checked_terms(F.col("value")), known.select(F.col("word").alias("term"))).first().pct_all_unknown == 0


def test_dedupe_ranks_and_splits(spark):
    p = spark.createDataFrame([(3, "b", "z"), (1, "a", "x"), (2, "a", "y"), (4, None, "n"), (5, None, "m")], "row_id long, input string, output string")
    assert rows(O.first_copies(p)) == [(1, "a", "x"), (3, "b", "z"), (4, None, "n")] and rows(O.later_copies(p)) == [(2, "a", "y"), (5, None, "m")]
    n = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"))
    assert all(r.k + 1 == r.place for r in O.ranked(n.repartition(9), "k", "place", 13).collect())
    assert O.ranked(n.limit(0), "k", "place").count() == 0
    assert rows(S.shuffled(n.limit(200), "k").select("k", "place")) == rows(S.shuffled(n.limit(200).repartition(5), "k").select("k", "place"))
    picked = S.stratified(spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(10)], "k int, s string"), "k", "s", 0.5)
    assert rows(picked.groupBy("s").agg(F.sum(F.col("chosen").cast("int")))) == [("a", 2), ("b", 2)]


def test_greedy_cover_matches_plain_greedy(spark):
    rng = np.random.default_rng(1)
    sets = {i: set(rng.choice(30, rng.integers(0, 8)).tolist()) for i in range(40)}
    df = spark.createDataFrame([("b", i, [str(x) for x in s]) for i, s in sets.items()], "bin string, k int, t array<string>")
    got = [(r.k, r.gain) for r in S.greedy_cover(df, "bin", "k", F.col("t"), 12).orderBy("rank").collect()]
    covered, left, plain = set(), dict(sets), []
    while len(plain) < 12:
        k = max(sorted(left), key=lambda i: len(left[i] - covered))
        gain = len(left.pop(k) - covered)
        if not gain:
            break
        covered |= sets[k]
        plain.append((k, gain))
    assert got[: len(plain)] == plain and len(got) == 12


def test_candidates_sections_and_preamble(spark):
    c = spark.createDataFrame([(1, 0, 0.9, 3), (1, 1, 0.5, 0), (1, 2, 0.5, 0), (2, 0, 0.9, 0), (2, 1, 0.95, 9)], "g int, o int, s double, m int")
    assert [(r.g, r.o) for r in S.best_candidates(c, "g", "s", "m", "o", F.lit(1), 0.8).orderBy("g").collect()] == [(1, 1), (2, 0)]
    text = ["VALID: 1", "---- VALID SENTENCES ----", "good one", "", "---- INVALID SENTENCES ----", "a valid sentence", "---- Unclassified SENTENCES ----", "odd"]
    assert rows(readers.sectioned(readers_lines(spark, text)).select("sentence", "label")) == [("a valid sentence", -1), ("good one", 1)]
    assert ("odd", 0) in rows(readers.sectioned(readers_lines(spark, text), strict=False).select("sentence", "label"))
    pre = readers_lines(spark, ["junk,1", "Sentence,Valid/Invalid", '"a, b",2', "c,-1", "c,3"])
    assert rows(readers.after_preamble(pre)) == [("a, b", "2"), ("c", "3")]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"input": "a", "output": "(b)"}, {"input": "c", "output": "(d)"}]))
    (tmp_path / "s.txt").write_text("one\n\n two \n")
    (tmp_path / "o.jsonl").write_text('{"kind": "Dog"}\n{bad\n{"x": 1}\n')
    assert [r.input for r in readers.pairs(spark, str(tmp_path / "p.json")).orderBy("row_id").collect()] == ["a", "c"]
    assert rows(readers.sentence_lines(spark, str(tmp_path / "s.txt"))) == [(1, "one"), (3, "two")]
    good, bad = readers.json_lines(spark, str(tmp_path / "o.jsonl"), "kind")
    assert rows(good) == [("Dog",)] and bad.count() == 2
    with pytest.raises(ValueError):
        readers.json_lines(spark, str(tmp_path / "s.txt"), "kind")
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.kif").write_text('; c\n(p ?X "q r\n s" Dog)\n')
    assert {r.word for r in readers.knowledge_words(spark, str(tmp_path / "k")).collect()} == {"p", "Dog"}
    assert "X" in {r.word for r in readers.knowledge_words(spark, str(tmp_path / "k"), variables=True).collect()}
    tok = readers.corpus_tokens(readers_lines(spark, ["1\t2\tw\tr\tnp1", "w2\tr2\tvv", "bad"]))
    assert [tuple(r)[1:] for r in tok.orderBy("line_num").collect()] == [("w", "r", "np1"), ("w2", "r2", "vv")] and rows(O.phrase_vocabulary(tok)) == [("r", "noun-phrase")]
    kb = writers.KnowledgeBase(spark, str(tmp_path / "kb"))
    kb.add(spark.createDataFrame([("(p)\r",)], "value string"))
    assert rows(kb.list()) == [("(p)",)]
    kb.clear()
    assert kb.list().count() == 0
    assert "| a |" in writers.report("t", {"x": spark.createDataFrame([(1.5,)], "a double")})
    assert rows(writers.fixed_decimals(spark.createDataFrame([(0.1234567,)], "a double"), ["a"])) == [("0.123457",)]


def test_wordnet_terms(spark):
    lines = readers_lines(spark, [
        "; comment", "00000001 05 n 02 robin 0 redbreast 0 001 @ 00000002 n 0000 | a small bird &%Bird+", "00000002 05 n 01 song-thrush 0 000 | a \"bird\" &%Bird+",
        "00000003 05 n 01 dog 0 000 | a dog &%Dog=",
    ])
    parsed = readers.wordnet_lines(lines)
    assert [(r.synset_id, r.words, r.hypernyms, r.gloss) for r in parsed.orderBy("line_num").collect()][0] == ("00000001-n", ["robin", "redbreast"], ["00000002-n"], "a small bird")
    terms = W.new_terms(parsed)
    assert rows(terms.select("synset_id", "term", "parent", "level")) == [("00000001-n", "RobinSongThrush", "SongThrushBird", 1), ("00000002-n", "SongThrushBird", "Bird", 0)]
    out = [r.value for r in W.statements(terms).orderBy("line_num", "ord").collect()]
    assert out[1] == "(subclass RobinSongThrush SongThrushBird)" and out[2] == '(termFormat EnglishLanguage RobinSongThrush "robin")' and len(out) == 7
    assert rows(W.updated_lines(parsed, terms))[2] == (4, "00000003 05 n 01 dog 0 000 | a dog &%Dog=")


@pytest.mark.parametrize("few", [100_000, 0])
def test_numbers_behind_names_go_in_order(spark, monkeypatch, few):
    monkeypatch.setattr(G, "FEW", few)
    names = ["Dog", "Dog", "Dog1", "Cat", "Dog", "Dog1", "Cat"]
    given, want = {"Cat", "Dog2"}, []
    for n in names:
        u = next(x for k in range(99) if (x := n if k == 0 else f"{n}{k}") not in given)
        given.add(u)
        want.append(u)
    df = spark.createDataFrame(list(enumerate(names)), "o int, n string")
    got = G.numbered_names(df, "n", "o", spark.createDataFrame([("Cat",), ("Dog2",)], "term string"))
    assert [r.unique for r in got.orderBy("o").collect()] == want


def test_wordnet_attributes_relations_and_clashes(spark):
    """Several mappings, relations left out, attributes and instances carried down, names that are taken."""
    term = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    lines = readers_lines(spark, [
        "00000001 05 a 01 calm 0 000 | quiet &%Mood+", "00000002 05 a 01 calmer 0 001 @ 00000001 a 0000 | more so &%Mood+", "00000003 05 a 01 blue 0 000 | sad &%Mood+ &%Color+",
        "00000004 05 a 01 odd 0 000 | strange &%Mood+ &%Thing+", "00000005 05 v 01 link 0 000 | to link &%related+", "00000006 05 n 01 calm 0 000 | a calm &%Mood+",
    ])
    terms = W.new_terms(readers.wordnet_lines(lines), taken=term("CalmMood1"), relations=term("related"), attributes=term("Mood", "Color"), instances=term("Color"))
    got = {r.synset_id: (r.term, [tuple(x) for x in r.links]) for r in terms.collect()}
    assert got == {
        "00000001-a": ("CalmMood", [("instance", "Mood")]), "00000002-a": ("CalmerCalm", [("subAttribute", "CalmMood")]),
        "00000003-a": ("BlueMood", [("instance", "Mood"), ("subAttribute", "Color")]), "00000004-a": ("OddMood", [("attribute", "Mood"), ("subclass", "Thing")]),
        "00000006-n": ("CalmMood2", [("instance", "Mood")]),
    }


def test_calibration(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=200) > 0).astype(int)
    w, mean, std = K.fit_arrays(x, y, epochs=500, lr=0.5)
    assert abs(w[1]) > 5 * abs(w[2]) and ((K.probabilities(x, w, mean, std) >= 0.5) == y).mean() > 0.9
    a, c = K.raw_rule({"f": 2.0}, {"f": 3.0}, {"f": 4.0}, 1.0, 0.5)
    assert a == {"f": 0.5} and c == pytest.approx(-0.5)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(200)], "k int, y int, a double, b double, c double")
    scored = K.cross_validated(S.folds(df, "k", 4), "k", ["a", "b", "c"], k=4)
    assert scored.count() == 200
    for f in range(4):  # the optimum that gradient descent approaches on the other folds' rows
        own = {r.k for r in scored.where(f"fold = {f}").collect()}
        rest = [i for i in range(200) if i not in own]
        plain, m, s = K.fit_arrays(x[rest], y[rest], epochs=20000, lr=0.5)
        got = scored.where(f"fold = {f}").first()
        assert np.allclose(got.weights, plain, atol=1e-4) and np.allclose(got.means, m) and np.allclose(got.stds, s)
    curve = K.curve(scored, 21).orderBy("threshold").collect()
    p = np.array([(r.p, r.y) for r in scored.collect()])
    for i, r in enumerate(curve):
        assert (r.kept, r.coh_kept) == ((p[:, 0] >= i / 20).sum(), p[p[:, 0] >= i / 20, 1].sum())
    best = K.chosen(K.curve(scored, 21), 0.99, min_accepted=500).first()
    assert (best.threshold, best.fallback, best.precision) == (1.0, "none", 0.0)
    steps = K.ablation(S.folds(df, "k", 5), "k", ["a", "b", "c"], 0.8, fewest=2)
    assert [s["n_features"] for s in steps] == [3, 2] and steps[1]["removed"] in ("b", "c")
    assert K.minimal_set([{"coherent_kept_rate": 1.0}, {"coherent_kept_rate": 0.995}, {"coherent_kept_rate": 0.5}]) == {"coherent_kept_rate": 0.995}
    assert all((r.kept, r.precision) == (0, 0.0) for r in K.curve(scored.limit(0), 21).collect())


def test_metrics_without_rows(spark):
    none = O.metrics(O.confusion(spark.createDataFrame([], "a boolean, k boolean"), F.col("a"), F.col("k"))).first()
    assert (none.precision, none.recall, none.f1, none.coverage, none.leakage) == (0.0,) * 5
    odd = O.confusion(spark.createDataFrame([(None, True), (True, None), (False, True)], "a boolean, k boolean"), F.col("a"), F.col("k")).first()
    assert (odd.tp, odd.fp, odd.tn, odd.fn, odd.ignored) == (0, 1, 0, 1, 1)


def test_models_and_resolution(spark):
    asked = []
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "i int, t string")
    assert rows(M.rewritten(df, "t", str.upper)) == [(1, "A"), (2, "A"), (3, None)] and not asked
    doc = spark.createDataFrame([(1, i, s) for i, s in enumerate(["Bob ran.", "He sat.", "He ate. Oops.", "He left."])], "d int, o int, t string")
    got = M.resolved(doc, "d", "o", "t", lambda s: s.replace("He", "Bob"), lambda s: [x.strip() + "." for x in s.split(".") if x.strip()])
    assert [r.text for r in got.orderBy("ord").collect()] == ["Bob ran.", "Bob sat.", "Bob left."]
    met = M.metaphor_rewrites(spark.createDataFrame([("s", 6)], "sentence string, met_count int"), lambda s, k: None if k == 0 else {"1": "x" * k}, lambda s: 1, lambda a, b: 0.9 if b == "xx" else 0.1)
    assert [r.candidate for r in met.orderBy("ord").collect()] == ["x", "xx"]


def test_codes_are_unique(spark):
    df = spark.createDataFrame([(1, 'the cat "quoted words" sat ?X')], "i int, t string")
    codes = C.code_map(df, "t").collect()
    assert {r.token for r in codes} == {"the", "cat", "sat", "X", "?"} and len({r.code for r in codes}) == 5 and all(len(r.code) == 5 for r in codes)


def test_stream_is_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One (two.\n\nThree.\n")
    stream = rowlocal.described(rowlocal.sentence_stream(spark, str(tmp_path / "in")))
    rowlocal.started(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    batch = rowlocal.described(spark.read.text(str(tmp_path / "in")))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
    rowlocal.started(rowlocal.described(rowlocal.sentence_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
    masked = spark.createDataFrame([(["The", "cat", "Cat", "dog"], ["the"])], "w array<string>, k array<string>").select(rowlocal.masked_row(F.col("w"), F.col("k")).alias("m")).first().m
    assert masked == ["The", "UNK_noun_1", "UNK_noun_1", "UNK_noun_2"]


def test_commands(spark, tmp_path):
    known = spark.createDataFrame([("dog", "noun")], "root string, pos string")
    s = api.Session(spark, str(tmp_path / "kb"), known, translate=lambda t: f"(says {t})")
    got = [r.value for r in s.run("add The dog met Fido.").orderBy("part", "ord").collect()]
    assert got == ["(says The dog met Fido .)"] and s.run("list").count() == 1
    assert s.run("ask Who?").first().value.startswith("fof(name1,conjecture,") and s.run("kb").count() == 1
    assert {r.stage for r in s.run("flow").collect()} >= {"input", "simplified", "masked", "logic", "unmasked"}
    assert s.run("hist").count() >= 4 and s.run("help").count() > 10 and s.run("clear").count() == 0 and s.run("quit") is None
    for bad, kind in (("prover", NotImplementedError), ("nonsense", ValueError)):
        with pytest.raises(kind):
            s.run(bad)


def test_split_by_ninths(spark):
    df = spark.range(40).select("id")
    assert sorted(map(str, [r.part for r in S.ninths_split(df, "id").collect()])) == ["dev"] * 4 + ["train"] * 36
    assert sorted(map(str, [r.part for r in S.ninths_split(df, "id", 18).collect()])) == ["None"] * 20 + ["dev"] * 2 + ["train"] * 18
    assert S.ninths_split(df.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        S.ninths_split(df, "id", 0)


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame([("3", "1.5"), ("x", "1"), (None, "1"), ("nan", "1"), ("1", "1"), ("-1", None), ("-2", "NaN"), ("-2", "0")], "human_label string, f string")
    assert rows(O.usable_counts(df, ["f"], "human_label")) == [(3, 1, 2, 2)]
    assert rows(O.usable(df, ["f"], "human_label").select("y")) == [(0,), (1,)]
    assert rows(O.usable_counts(df.limit(0), ["f"], "human_label")) == [(0, 0, 0, 0)]


def test_points_take_the_last_label(spark):
    points = spark.createDataFrame([("a ", 1.0), ("b", 2.0), ("c", 3.0), (None, 4.0)], "sentence string, run double")
    labels = spark.createDataFrame([(1, "a", "1", "x"), (2, " a", "-1", "x"), (3, "b", "", "x"), (4, "c", "2.5", "x"), (5, "a", "0", "y"), (6, None, "1", "x")], "row_id int, sentence string, label string, source_file string")
    assert rows(O.labelled_points(points, labels, ["run"])) == [("a", 1.0, 0)]
    assert rows(O.labelled_points(points, labels, ["run"], "x")) == [("a", 1.0, -1)]


def test_score_summary_of_odd_rows(spark):
    df = spark.createDataFrame([("1", "Y", "1"), ("nan", "N", "1"), ("3", "?", "1"), ("x", "Y", None), (None, None, "0")], "s string, label string, found string")
    assert rows(O.score_summary(df, ["s"], "label", "found")) == [(2.0, 0.5, 0.5, 1.0)]
    assert rows(O.score_summary(df.limit(0), ["s"], "label", "found")) == [(None, 0.0, 0.0, 0.0)]


def test_result_files_and_tables(spark, tmp_path):
    for model, method, text in (("m1", "a", "one\ntwo\n"), ("m2", "a", "three\n"), ("m1", "b", "four\n")):
        folder = tmp_path / "results" / model / method
        folder.mkdir(parents=True)
        (folder / "out.txt").write_text(text)
        (folder / "notes.md").write_text("left out")
    base = str(tmp_path / "results")
    assert rows(readers.result_lines(spark, base, "m1", "a").select("model", "method", "line_num", "value")) == [("m1", "a", 1, "one"), ("m1", "a", 2, "two")]
    assert readers.result_lines(spark, base).count() == 4 and readers.result_lines(spark, base, "m3").count() == 0
    for _ in range(2):
        writers.create_table(spark, "words_of_test", "id STRING, word STRING", str(tmp_path / "words"))
    assert spark.table("words_of_test").columns == ["id", "word"]
    spark.sql("DROP TABLE words_of_test")


def test_pair_array_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "x"\n', "(p)"), (5, "ü", None), (9, "", "(q)")], "row_id int, input string, output string")
    text = "\n".join(r.value for r in writers.pair_array(df).orderBy("ord").collect())
    assert json.loads(text) == [{"input": 'say "x"\n', "output": "(p)"}, {"input": "ü", "output": ""}, {"input": "", "output": "(q)"}]
    (tmp_path / "pairs.json").write_text(text)
    assert readers.pairs(spark, str(tmp_path / "pairs.json")).count() == 3
    scored = writers.scored_lines(df.select("row_id", F.col("input").alias("prediction"), F.col("output").alias("reference")), 0.5, "BLEU")
    assert [r.value for r in scored.orderBy("ord").collect()][-1] == "BLEU\t0.500000"


def test_threshold_from_held_out_rows(spark):
    dev = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + (F.col("id") % 7) / 20).alias("f"), (F.col("id") % 3).cast("double").alias("g"))
    dev = dev.repartition(2).persist()
    done, best = M.fitted_with_threshold(dev, dev, ["f", "g"], "id", "plain_logreg", least=1.0)
    assert best["precision"] == 1 and best["total"] == 40
    assert done.where("label = 1 and y = 0").isEmpty() and done.where("label = 1").count() > 50
    for kind in ("plain_forest",):
        assert M.fit_and_score(dev, dev, ["f", "g"], kind).where((F.col("p") >= 0.5) != (F.col("y") == 1)).isEmpty()
    dev.unpersist()


def test_models_as_functions(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "id int, sentence string")
    assert rows(M.log_probabilities(df, "sentence", lambda t: [1.0] * len(t.split())).select("id", "nll")) == [(1, [1.0, 1.0]), (2, None), (3, None)]
    assert rows(M.compared(df, {"up": str.upper, "same": str}).select("id", "model", "output")) == rows(spark.createDataFrame([(1, "up", "A B"), (2, "up", "C"), (3, "up", None), (1, "same", "a b"), (2, "same", "c"), (3, "same", None)]))
    assert rows(M.judged(df, "sentence", lambda t: "Invalid" if t == "c" else "Valid").select("id", "verdict")) == [(1, 1), (2, -1), (3, None)]
