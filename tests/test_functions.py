"""Goldens and edge cases of column functions and helpers."""

import math

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import python as P
from lexiforge.functions import sequences as N
from lexiforge.functions import text as X


def value(spark, expression, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<double>' if isinstance(v, list) and (not v or isinstance(v[0], float)) else 'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'int'}" for k, v in cells.items()))
    return row.select(expression.alias("v")).first().v


@pytest.mark.parametrize("word, expected", [("Hello, World!", "Hello_World"), ("123MainSt", "num_123MainSt"), ("12.34%", "num_1234_"), ("Special@Char$", "Special_Char_"), ("A_B.C,D", "A_BCD"), ("  spaces  ", "spaces"), ("", "")])
def test_word_format(spark, word, expected):
    assert value(spark, X.format_word(F.col("w")), w=word) == expected


def test_terms(spark):
    s = '(=> (and (instance ?X Human) (p ?Y "quoted word" 12 UNK_noun_1)) (q Dog))'
    assert value(spark, X.logic_terms(F.col("s")), s=s) == ["and", "instance", "Human", "p", "quoted", "word", "UNK_noun_1", "q", "Dog"]
    assert value(spark, X.named_terms(F.col("s")), s=s)[-1] == "Dog" and "UNK_noun_1" not in value(spark, X.named_terms(F.col("s")), s=s)
    assert value(spark, X.prompt_terms(F.col("s")), s=s) == ["Human", "p", "12", "UNK_noun_1", "q", "Dog"]
    assert value(spark, X.checked_terms(F.col("s")), s=s) == ["Human", "p", "q", "Dog"]
    assert value(spark, X.statement_words(F.col("s")), s="(instance Foo-1 ?X) exists Bar") == ["Foo1", "Bar"]
    assert value(spark, X.term_format_head(F.col("s")), s='(termFormat EnglishLanguage Dog "dog")') == "Dog"
    assert value(spark, X.logic_terms(F.col("s")), s="") == []


def test_variables_keep_longer_names_unless_compat(spark):
    s = "(p ?A ?AB) (q ?AB ?A)"
    assert value(spark, X.numbered_variables(F.col("s")), s=s) == "(p ?X1 ?X2) (q ?X2 ?X1)"
    assert value(spark, X.numbered_variables(F.col("s"), compat=True), s=s) == "(p ?X1 ?X1B) (q ?X1B ?X1)"
    assert value(spark, X.numbered_variables(F.col("s")), s="none") == "none"


def test_statement_parts_and_balance(spark):
    assert value(spark, X.statement_parts(F.col("s")), s="(a (b)) (c) d") == ["(a (b))", "(c) d"]
    assert value(spark, X.statement_parts(F.col("s")), s="only") == ["only"]
    assert value(spark, X.balanced(F.col("s")), s="((a)") is False


def test_replies(spark):
    assert value(spark, X.verdict(F.col("s")), s="It is Invalid") == -1 and value(spark, X.verdict(F.col("s")), s="Valid.") == 1 and value(spark, X.verdict(F.col("s")), s="valid") is None
    assert value(spark, X.unquoted(F.col("s")), s='" hi "') == "hi" and value(spark, X.unquoted(F.col("s")), s='"hi') is None and value(spark, X.unquoted(F.col("s")), s='"') is None
    assert value(spark, X.last_object(F.col("s")), s='x {"a": 1} y {"Simple": "ok"} z') == {"Simple": "ok"} and value(spark, X.last_object(F.col("s")), s="no") is None
    assert value(spark, X.numbered_replies(F.col("s")), s='say {"1": "a"\n"2": "b", "x": "c",} end') == {"1": "a", "2": "b"}
    assert value(spark, X.entity_term(F.col("s")), s="DATE") is None and value(spark, X.entity_term(F.col("s")), s="PERSON") == "Human"
    assert value(spark, X.spaced_marks(F.col("s")), s="p? q") == "p  ?q"


def test_sequences(spark):
    v = [5.0, 1.0, 4.0, 4.5, 0.0, 6.0]
    assert value(spark, N.quantile(F.col("v"), 0.95), v=v) == sorted(v)[math.floor(0.95 * 5)] and value(spark, N.quantile(F.col("v"), 0), v=v) == 0.0
    assert value(spark, N.quantile(F.col("v"), 0.5), v=[]) is None and value(spark, N.mean(F.col("v")), v=[]) is None
    assert value(spark, N.longest_run(F.col("v"), 3.5), v=v) == 2 and value(spark, N.longest_run(F.col("v"), 3.5), v=[]) == 0
    rep = lambda t: [value(spark, c, t=t) for c in N.repetition(F.col("t")).values()]
    assert rep(["a", "a", "b", "a", "a"]) == [0.4, 0.5, 0.5] and rep(["a"]) == [1.0, 0.0, 0.0] and rep(["a", "a", "a"]) == [1 / 3, 1.0, 1.0]
    assert [value(spark, N.three_way(F.col("a"), F.col("b"), F.col("c")), a=a, b=b, c=c) for a, b, c in ((3.6, 1.0, 0), (1.0, 1.0, 4), (2.0, 4.0, 1), (3.0, 4.0, 1))] == [-1, -1, 1, 0]


def test_scores(spark):
    assert value(spark, N.wilson(F.col("k"), F.col("n")), k=0, n=0) == 0.0
    assert value(spark, N.wilson(F.col("k"), F.col("n")), k=9, n=10) == pytest.approx(0.59585, abs=1e-4)
    one = [F.lit(1.0)] * 4
    assert value(spark, N.composite(*one, F.col("r")), r=-7.0) == pytest.approx(0.8)
    assert value(spark, N.composite(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.5), F.col("r").try_cast("double")), r=None) == pytest.approx(0.3)
    with pytest.raises(ValueError):
        N.composite(*one, F.lit(0.0), weights=(1, 1, 1, 1, 1))
    assert value(spark, N.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[2.0, 0.0]) == 1.0 and value(spark, N.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) is None


def test_python_helpers():
    assert P.rouge_l_score("a b c d", "a c d e") == 0.75 and P.rouge_l_score("", "a") == 0.0
    assert P.bleu_score("the cat sat", "the cat sat") == 1.0 and P.bleu_score("a b", "c d") == 0.0
    assert P.bleu_score("the cat sat here", "the cat ran far") == pytest.approx(1 / 3)
    assert P.bleu_score("a b c", "c a") == pytest.approx(math.exp(1 - 3 / 2) / (2 * 5 / math.log(2)))
    assert P.plain_text("Café �") == "Cafe " and P.nfkc_text(" a \t b ") == "a b"
    assert P.snapped_words("Oh, running fast!", [4, 6, 12]) == [{"start": 4, "word": "running"}, {"start": 12, "word": "fast"}]
    assert P.term_name("robin", "BirdAnimal", "Animal") == "RobinBird" and P.term_name("24-carat", "Gold") == "TwoFourCaratGold"
    assert P.gerund_of("to run") == "running" and P.gerund_of("make") == "making" and P.gerund_of("born") == "born" and P.gerund_of("zzz", frozenset({"x"})) == "zzz"
    codes = {"cat": "ABCDE", "?": "QQQQQ", "X": "ZZZZZ"}
    hidden = P.scrambled_text('(cat ?X "cat")', codes)
    assert hidden == '(ABCDE QQQQQZZZZZ "cat")' and P.unscrambled_text(hidden, {v: k for k, v in codes.items()}) == '(cat ?X "cat")'
    assert P.tree_depth([1, 1, 1, 2]) == 3 and P.tree_depth([1, 0]) == -1 and P.tree_depth([]) == 0
    tokens = [{"i": 0, "head": 1, "text": "I", "dep": "s"}, {"i": 1, "head": 1, "text": "ran", "dep": "ROOT"}, {"i": 2, "head": 1, "text": "and", "dep": "cc"}, {"i": 3, "head": 1, "text": "sat", "dep": "conj"}]
    assert P.clauses_of(tokens) == ["I ran and sat", "I ran and sat"] and P.clauses_of([]) == []
    assert P.assembled([{"text": "He", "upos": "PRON", "rep": "Bob", "poss": True}, {"text": "dog"}, {"text": "."}, {"text": "well"}, {"text": "-"}, {"text": "known"}]) == "Bob's dog. well-known"
    with pytest.raises(ValueError):
        P.similarity("nothing", None, None)


def test_prompts(spark):
    from lexiforge.functions import prompts

    got = value(spark, prompts.rewrite_batch(F.col("s"), F.col("w"), again=True), s="It flew.", w=["flew"])
    assert '"It flew."' in got and "flew." in got and got.startswith("Earlier")
    assert value(spark, prompts.retry(F.col("s"), F.col("w"), F.array(), F.array()), s="x", w=["a", "b"]) == 'Try again with a literal version. Still figurative: a | b. Sentence: "x"'
    assert "1) bank; 2) shore" in value(spark, prompts.word_sense(F.col("s"), F.lit("bank"), F.col("w")), s="x", w=["bank", "shore"])
    with pytest.raises(ValueError):
        prompts.simplify(F.col("s"), ["a"], [])


def test_quotes_of_a_megabyte(spark):
    """Long quotes, floods of escapes and quotes that never close neither crash nor take quadratic time."""
    texts = ['(a "' + "x" * 1_000_000 + '" b)', 'a "' + '\\"' * 300_000, 'a "' + '\\"' * 300_000 + '" b', 'a "b c', '(a "b \\" c" d) "e" "f', '"' * 400_001]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.checked_terms(F.col("t")).alias("w")).orderBy("k").collect()
    assert [r.w for r in got[:1]] == [["a", "b"]] and got[2].w == ["a", "b"] and got[3].w == ["a", '"b', "c"] and got[4].w == ["a", "d", '"f']
    assert got[1].w == ["a", texts[1][2:]] and got[5].w == ['"']
