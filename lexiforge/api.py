"""The command surface: one method per command, each a DataFrame.  What needs an external prover raises."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.operators import knowledge, models, oov, pairs, selection, tagging
from lexiforge.sources import readers, writers

#: Former names of the commands.
ALIASES = {"kb": "list", "test": "prover", "proofvisual": "pv", "last": "flow", "history": "hist", "man": "help", "exit": "quit", "runstandardtestset": "rsts", "runrandtestset": "rrts", "generateWordNetKif": "gwnk"}


class Session:
    """A pipeline over a knowledge base and a vocabulary; models are plain functions and default to doing nothing."""

    def __init__(
        self, spark: SparkSession, base: str, vocabulary: DataFrame, metaphor: models.Rewrite = str, simplify: models.Rewrite = str,
        translate: models.Rewrite = str, tagger: Callable | tagging.Tagger = models.plain_tagger,
    ):
        self.spark, self.kb, self.vocabulary = spark, writers.KnowledgeBase(spark, base), vocabulary
        self.metaphor, self.simplify, self.translate, self.tagger = metaphor, simplify, translate, tagger
        self.commands: list[str] = []
        self.trace: dict[str, DataFrame] = {}

    def _text(self, text: str | DataFrame) -> DataFrame:
        return text if isinstance(text, DataFrame) else self.spark.createDataFrame([(0, text)], "line_num int, text string")

    def mh(self, text: str | DataFrame) -> DataFrame:
        """Metaphors rewritten: (line_num, text)."""
        return models.rewritten(self._text(text), "text", self.metaphor)

    def ss(self, text: str | DataFrame) -> DataFrame:
        """Simplified, one sentence a row: (sentence_id, text); ids number sentences by line and place."""
        return self._sentences(text).select("sentence_id", "text")

    def _sentences(self, text: str | DataFrame) -> DataFrame:
        done = models.rewritten(self._text(text), "text", self.simplify)
        each = done.select("line_num", F.posexplode(X.sentences(F.col("text"))).alias("ord", "text"))
        return pairs.ranked(each.withColumn("at", F.struct("line_num", "ord")), "at", "sentence_id").select(F.col("sentence_id").cast("int").alias("sentence_id"), "line_num", "text")

    def masked(self, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
        tokens = models.tagged(sentences, self.tagger)
        return oov.masked(oov.unknown_tokens(tokens, self.vocabulary))

    def l2l(self, text: str | DataFrame) -> DataFrame:
        """Translated lines."""
        return models.translated(self._text(text), self.translate).withColumn("text", F.trim(X.spaced_marks(F.col("text"))))

    def oov(self, text: str | DataFrame) -> DataFrame:
        """Masked, translated and unmasked: (ord, value), type axioms first."""
        return self._logic(self.ss(text))

    def _logic(self, sentences: DataFrame) -> DataFrame:
        hidden, words = self.masked(sentences)
        logic = models.translated(hidden, self.translate).select("sentence_id", F.col("sentence_id").alias("line_num"), "text")
        done, used = oov.unmasked(logic, words)
        self.trace |= {"masked": hidden.select("text"), "logic": logic.select("text"), "unmasked": done.select("text")}
        first = oov.axioms(used).select(F.lit(0).alias("part"), F.col("first.line_num").alias("ord"), "value")
        return first.unionByName(done.select(F.lit(1).alias("part"), F.col("line_num").alias("ord"), F.col("text").alias("value")))

    def _whole(self, text: str | DataFrame) -> DataFrame:
        source = self._text(text)
        plain = self.mh(source)
        short = self.ss(plain)
        self.trace = {"input": source.select("text"), "metaphor": plain.select("text"), "simplified": short.select("text")}
        return self._logic(short)

    def add(self, text: str | DataFrame) -> DataFrame:
        """The statements of a text, appended to the knowledge base."""
        logic = self._whole(text).persist()
        self.kb.add(logic)
        return logic

    def ask(self, text: str | DataFrame) -> DataFrame:
        """The conjectures that a prover would be asked, as text; proving is outside."""
        return self._whole(text).where("part = 1").select(F.format_string("fof(name1,conjecture, %s).", "value").alias("value"))

    def add_lbl(self, path: str) -> DataFrame:
        """A file line by line: (line_number, value), each line's results closed by '!!'."""
        source = readers.sentence_lines(self.spark, path).select("line_num", F.col("sentence").alias("text"))
        short = self._sentences(self.mh(source)).persist()
        logic = self._logic(short.select("sentence_id", "text")).withColumnRenamed("ord", "sentence_id")
        got = logic.join(short.select("sentence_id", "line_num"), "sentence_id")
        return writers.separated(got.select(F.col("line_num").alias("line_number"), "value"))

    def rsts(self, statements: DataFrame, base: str) -> DataFrame:
        """Syntax by balance and types by the knowledge base, of (row_id, statement)."""
        checked = knowledge.type_check(statements, readers.knowledge_words(self.spark, base))
        return statements.withColumn("verdict", F.when(X.balanced(F.col("statement")), "valid").otherwise("invalid")).join(checked, "row_id")

    def rrts(self, statements: DataFrame, base: str, n: int = 125) -> DataFrame:
        return self.rsts(selection.random_rows(statements, "row_id", n), base)

    def gwnk(self, lines: DataFrame, base: str) -> DataFrame:
        """Statements of new terms for WordNet mapping lines (line_num, value), given the knowledge base's folder."""
        from lexiforge.operators import wordnet

        known = readers.statements(readers.knowledge_lines(self.spark, base))
        below = knowledge.downward_edges(known)
        terms = wordnet.new_terms(
            readers.wordnet_lines(lines), knowledge.mentions(known).select("term").distinct(), knowledge.closure(below, "Relation"), knowledge.closure(below, "Attribute"),
            known.where("relation = 'instance'").select(F.col("args")[0].alias("term")).distinct(),
        )
        return wordnet.statements(terms)

    def list(self) -> DataFrame:
        return self.kb.list()

    def clear(self) -> DataFrame:
        self.kb.clear()
        return self.kb.list()

    def flow(self) -> DataFrame:
        """What the last text was after each stage."""
        return writers.traced(self.trace) if self.trace else self.spark.createDataFrame([], "stage string, text string")

    def hist(self) -> DataFrame:
        return self.spark.createDataFrame([(i, c) for i, c in enumerate(self.commands)], "ord int, command string")

    def help(self) -> DataFrame:
        rows = [(n, (getattr(Session, n).__doc__ or "").split("\n")[0]) for n in ("ask", "add", "add_lbl", "rsts", "rrts", "gwnk", "clear", "list", "flow", "mh", "ss", "l2l", "oov", "hist", "help")]
        return self.spark.createDataFrame(rows, "command string, what string")

    def prover(self, *_) -> DataFrame:
        raise NotImplementedError("a theorem prover is an external program")

    def pv(self, *_) -> DataFrame:
        raise NotImplementedError("proof pictures need an external program")

    def run(self, line: str) -> DataFrame | None:
        """A command line: its first word names the method, the rest is its text; quit gives None, an unknown name raises."""
        name, _, rest = line.strip().partition(" ")
        name = ALIASES.get(name, name)
        if not name or name == "quit":
            return None
        self.commands.append(line)
        if name in ("rsts", "rrts", "gwnk"):  # a file and the knowledge base's folder
            path, _, base = rest.partition(" ")
            rows = readers.lines(self.spark, path) if name == "gwnk" else readers.sentence_lines(self.spark, path).select(F.col("line_num").alias("row_id"), F.col("sentence").alias("statement"))
            return getattr(self, name)(rows, base.strip())
        if name not in ("ask", "add", "add_lbl", "clear", "list", "flow", "mh", "ss", "l2l", "oov", "hist", "help", "prover", "pv"):
            raise ValueError(f"unknown command {name!r}")
        return getattr(self, name)(*([rest] if rest else []))


def exact_match(rows: DataFrame, prediction: str, reference: str) -> DataFrame:
    return pairs.exact_match(rows, F.col(prediction), F.col(reference))
