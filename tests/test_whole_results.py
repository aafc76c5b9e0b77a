"""Queries on rows that once gave other results than their SQL, and steps whose cost must not grow faster than the input."""

import duckdb

from lexiforge.plans import catalogue


def same_as_sql(spark, folder, name, **tables):
    """A query on tables made here gives its SQL's rows."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    found = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    text = lambda v: repr(v + 0.0) if isinstance(v, float) else str(v)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(map(text, r)) for r in found.fetchall())
    return got


def test_linear_rule_on_its_bound_and_without_text(spark, tmp_path):
    texts = ["!" * 7 + "a" * 193, "!" * 8 + "a" * 192, "a", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert same_as_sql(spark, tmp_path, "linear_rule", documents=docs) == [("0", "1"), ("1", "-1"), ("2", "1"), ("3", "1"), ("4", "-1")]


def test_sentences_keep_digits_at_their_ends(spark, tmp_path):
    texts = ["0 a 0. 1 b 1. 22.2!  c　? ", "", None, "x.\ty"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ("0", "1", "1 b 1.") in same_as_sql(spark, tmp_path, "sentence_split", documents=docs)


def test_masks_and_what_brings_them_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "zz yy zz the yy Zz"), (2, "yy the"), (3, ""), (4, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, "The end")], "item_id long, text string")
    assert len(same_as_sql(spark, tmp_path, "oov_mask_ids", documents=docs, benchmark=known)) == 2
    plan = catalogue.QUERIES["oov_mask_ids"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the tokens by sentence, and the known words


def test_bleu_counts_both_sides_at_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a b c d the e"), (1, 2, "the the the the"), (2, 1, None), (3, 1, "")], "conv_id long, turn int, text string")
    same_as_sql(spark, tmp_path, "corpus_bleu", conversations=rows)
    assert "Join" not in catalogue.QUERIES["corpus_bleu"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "").replace("Join Inner\n", "")


def test_senses_of_a_frequent_lemma_are_made_in_many_tasks(spark):
    from lexiforge.operators import models

    words = spark.createDataFrame([(i, "x", t) for i, t in enumerate(["NN", "VB", "DT", None] * 5)], "id int, lemma string, tag string")
    table = spark.createDataFrame([("x", p, s) for s, p in enumerate(["n", "v", None] * 20)], "lemma string, pos string, sense int")
    done = models.senses(words, table)
    assert done.columns == ["lemma", "id", "tag", "pos", "sense"]
    kind = {"NN": ["n"], "VB": ["v"]}
    assert sorted((r.id, r.sense) for r in done.collect()) == sorted((w.id, s.sense) for w in words.collect() for s in table.collect() if w.tag not in kind or s.pos in kind[w.tag])
    assert sum(n > 0 for n in done.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 8


def test_snapped_words_that_span_cells_and_overlap(spark):
    from lexiforge.operators import oov

    words = [(1, 0, "abcdefgh"), (1, 2, "(cd)"), (1, 9, "i"), (2, 0, "x"), (None, 0, "n")]
    hits = [(1, 5), (1, 7), (1, 10), (2, 1), (None, 0)]
    for cell in (2, 4096):
        got = oov.snapped_join(spark.createDataFrame(words, "sentence_id int, start int, word string"), spark.createDataFrame(hits, "sentence_id int, at int"), cell)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted(map(tuple, got.collect())) == [(1, 0, "abcdefgh"), (1, 2, "cd")]


def test_tagged_paths_of_known_and_unknown_words(spark, tmp_path):
    rows = [(1, "the cat sat The end", "en"), (2, "le chat the fin 12", "fr"), (3, "the newcats", None), (4, "", "en"), (5, None, "en"), (6, "The The le", "en")]
    assert len(same_as_sql(spark, tmp_path, "tagged_paths", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == 4


def test_masks_are_not_dealt_out_to_be_undone(spark, tmp_path):
    from lexiforge.operators import oov

    docs = spark.createDataFrame([(1, "zz yy zz the yy Zz"), (2, "yy the"), (3, ""), (4, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, "The end")], "item_id long, text string")
    assert len(same_as_sql(spark, tmp_path, "oov_unmask", documents=docs, benchmark=known)) == 2
    plan = catalogue.QUERIES["oov_unmask"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") <= 2  # the words of the texts, for lines and for their words, but no masks
    lines = spark.createDataFrame([(1, 1, "UNK_a_1_2 x UNK_n_01 UNK_n_3"), (1, 2, None), (1, 3, ""), (2, 1, "UNK_n_1"), (None, 1, "UNK_n_1 y")], "sentence_id int, line_num int, text string")
    words = spark.createDataFrame([(1, "a_1", 2, "b c"), (1, "n", 1, "p"), (1, "n", 3, None), (None, "n", 1, "q")], "sentence_id int, type string, id int, word string")
    got = sorted(map(str, [tuple(r) for r in oov.unmasked(lines, words)[0].collect()]))
    assert got == ["(1, 1, 'b_c x p UNK_n_3')", "(1, 2, None)", "(1, 3, '')", "(2, 1, 'UNK_n_1')", "(None, 1, 'UNK_n_1 y')"]
