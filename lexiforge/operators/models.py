"""Model-backed steps behind one protocol: a model is a function of a pandas frame that returns one.

Networks are passed in as functions; the defaults are plain rules that make the steps run, and no parity is claimed for
them.  A word model (operators.ngrams) and a tagger (operators.tagging) can be trained here and take their places.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.operators import calibration, kernels, selection, tagging

Rewrite = Callable[[str], str]


def applied(rows: DataFrame, model: Callable, schema: str) -> DataFrame:
    """model(pandas frame) -> pandas frame over Arrow batches; equal rows may be answered in any batch."""

    def run(batches):
        for b in batches:
            yield model(b)

    return rows.mapInPandas(run, schema)


def rewritten(rows: DataFrame, c: str, rewrite: Rewrite, name: str | None = None) -> DataFrame:
    """rows with a text rewritten; each distinct text is sent to the model once and joined back."""
    once = rows.select(c).where(F.col(c).isNotNull()).distinct()

    @F.pandas_udf("string")
    def run(col):
        return col.map(rewrite)

    answers = once.select(F.col(c).alias("__q"), run(c).alias("__a"))
    out = rows.join(answers, F.col(c) == F.col("__q"), "left").withColumn(name or c, F.col("__a"))
    return out.drop("__q", "__a")


def compared(sentences: DataFrame, models: dict[str, Rewrite], c: str = "sentence") -> DataFrame:
    """(…, model, output): every sentence by every model."""
    parts = [rewritten(sentences, c, f, "output").withColumn("model", F.lit(n)) for n, f in models.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def translated(lines: DataFrame, model: Rewrite) -> DataFrame:
    """Lines (…, text) through a translator; SentenceId lines pass."""
    plain = rewritten(lines, "text", lambda t: t if t.startswith("SentenceId") else model(t), "text")
    return plain


def judged(rows: DataFrame, c: str, ask: Rewrite) -> DataFrame:
    """rows with reply and verdict (-1, 1 or null)."""
    out = rewritten(rows, c, ask, "reply")
    return out.withColumn("verdict", X.verdict(F.col("reply")))


def plain_tagger(sentence: str) -> list[dict]:
    """A rule that stands in for a tagger: words ending in -ing, -ed and short function words are told apart from nouns."""
    small = {"the", "a", "an", "and", "or", "of", "to", "in", "on", "is", "was", "it", "he", "she", "we", "they", "his", "her", "with", "for"}
    out = []
    for i, w in enumerate(re.findall(r"\w+|[^\w\s]", sentence)):
        low = w.lower()
        kind = "PUNCT" if not w[0].isalnum() else "X" if low in small else "VERB" if re.search("(ing|ed)$", low) else "NOUN"
        out.append({"pos": i, "text": w, "lemma": low, "upos": kind})
    return out


def tagged(sentences: DataFrame, tagger: Callable[[str], list[dict]] | tagging.Tagger = plain_tagger) -> DataFrame:
    """(sentence_id, pos, text, lemma, upos) of sentences (sentence_id, text), by a function of a text or a trained tagger (see operators.tagging)."""
    if isinstance(tagger, tagging.Tagger):
        words = F.regexp_extract_all(F.col("text"), F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))
        return tagging.tagged(sentences.select("sentence_id", F.posexplode(words).alias("pos", "word")), tagger)

    @F.pandas_udf("array<struct<pos:int,text:string,lemma:string,upos:string>>")
    def run(col):
        return col.map(lambda t: tagger(t or ""))

    return sentences.select("sentence_id", F.explode(run("text")).alias("t")).select("sentence_id", "t.*")


def log_probabilities(rows: DataFrame, c: str, scorer: Callable[[str], list[float]]) -> DataFrame:
    """rows with nll, array<double>: null for fewer than two tokens."""

    @F.pandas_udf("array<double>")
    def run(col):
        return col.map(lambda t: v if t is not None and len(v := scorer(t)) >= 2 else None)

    return rows.withColumn("nll", run(c))


def metaphor_rewrites(rows: DataFrame, propose: Callable, detect: Callable, similar: Callable, batches: int = 4, retries: int = 5, reduction: float = 0.82, least: float = 0.8) -> DataFrame:
    """Candidates (sentence, ord, candidate, score, met_count, allowed) of rows (sentence, met_count).

    propose(sentence, attempt) gives a dict of candidates or None (asked again up to `retries` times); batches end early
    once a candidate is good enough.  The loop is one row's own and stays in one call; selection is best_candidates.
    """

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for s, n in zip(pdf["sentence"], pdf["met_count"]):
                allowed, done, ord_ = math.floor(n * (1 - reduction)), False, 0
                for attempt in range(batches):
                    got = next((g for _ in range(retries) if (g := propose(s, attempt))), None)
                    for cand in (got or {}).values():
                        score, left = float(similar(s, cand)), int(detect(cand))
                        out.append((s, ord_, cand, score, left, allowed))
                        ord_ += 1
                        done |= left <= allowed and score >= least
                    if done:
                        break
            yield pd.DataFrame(out, columns=["sentence", "ord", "candidate", "score", "met_count", "allowed"])

    return rows.select("sentence", "met_count").mapInPandas(run, "sentence string, ord int, candidate string, score double, met_count int, allowed int")


def simplified(rows: DataFrame, c: str, simplify: Callable[[str, float], str | None], faithful: Callable[[str, str], bool], tries: int = 100, ladder: tuple[float, ...] = (0.0, 0.3, 0.6, 0.9)) -> DataFrame:
    """rows with simple: the first answer that stays faithful, with rising temperature; the text itself if none does."""

    @F.pandas_udf("string")
    def run(col):
        def one(t):
            if t is None:
                return None
            for i in range(tries):
                got = simplify(t, ladder[min(i * len(ladder) // tries, len(ladder) - 1)])
                if got and faithful(t, got):
                    return got
            return t

        return col.map(one)

    return rows.withColumn("simple", run(c))


def resolved(rows: DataFrame, key: str, order: str, c: str, resolve: Callable[[str], str], split: Callable[[str], list[str]]) -> DataFrame:
    """(key, ord, text): references resolved over a sliding pair of sentences, the last resolved one carried on.

    A pair that doesn't come back as two sentences is dropped.  The state is one document's, so documents run in parallel.
    """
    kind = dict(rows.dtypes)[key]

    def run(pdf):
        import pandas as pd

        said = pdf.sort_values(order)[c].tolist()
        done = split(resolve(" ".join(said[:2])))
        for s in said[2:]:
            if done and len(pair := split(resolve(done[-1] + " " + s))) == 2:
                done.append(pair[1])
        return pd.DataFrame({key: pdf[key].iloc[0], "ord": range(len(done)), "text": done})

    return rows.groupBy(key).applyInPandas(run, f"{key} {kind}, ord int, text string")


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)


def fit_and_score(train: DataFrame, test: DataFrame, features: list[str], kind: str, label: str = "y", seed: int = 42) -> DataFrame:
    """test with p, from MLlib: logreg, forest (500 trees of depth 12, leaves of 5, root-many features) or svm.

    The baselines plain_logreg, plain_forest and plain_svm take the usual defaults instead: a penalty of 1 against the sum
    of losses, 100 trees as deep as MLlib lets them be (30) with leaves of 1.  MLlib has no kernel machines: svm is linear,
    with its margin through a sigmoid; kernel is operators.kernels' machine.  Rows with missing features get no p.
    """
    if kind == "kernel":
        return kernels.scored(test, kernels.fitted(train.withColumn("__k", F.xxhash64(*features)), features, "__k", label, seed=seed)).drop("margin")
    if kind in ("plain_logreg", "plain_svm"):
        weak = 1 / max(1, train.count())
        model = LogisticRegression(labelCol=label, regParam=weak, maxIter=1000) if kind == "plain_logreg" else LinearSVC(labelCol=label, regParam=weak)
    elif kind == "plain_forest":
        model = RandomForestClassifier(labelCol=label, numTrees=100, maxDepth=30, featureSubsetStrategy="sqrt", seed=seed)
    elif kind == "logreg":
        model = LogisticRegression(labelCol=label, regParam=1e-3, standardization=True)
    elif kind == "forest":
        model = RandomForestClassifier(labelCol=label, numTrees=500, maxDepth=12, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=seed)
    elif kind == "svm":
        model = LinearSVC(labelCol=label, regParam=1e-2)
    else:
        raise ValueError(f"unknown model {kind!r}")
    done = model.fit(_assembled(train, features)).transform(_assembled(test, features))
    if kind.endswith("svm"):
        return done.withColumn("p", 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))).drop("features", "rawPrediction", "prediction")
    return done.withColumn("p", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fitted_with_threshold(
    dev: DataFrame, test: DataFrame, features: list[str], key: str, kind: str = "forest", label: str = "y", held: float = 0.2, least: float = 0.9, lcb: bool = False,
    steps: int = 201, min_accepted: int = 1, seed: int = 42,
) -> tuple[DataFrame, dict]:
    """test with p and label (1 from the threshold on, else -1), and the chosen threshold's row.

    A stratified share of dev is held out; a model of the rest scores it and the threshold is chosen there.  The model that
    scores test is then fitted on all of dev.
    """
    parts = selection.stratified(dev, key, label, held, seed)
    scored = fit_and_score(parts.where("not chosen"), parts.where("chosen"), features, kind, label, seed)
    best = calibration.chosen(calibration.curve(scored, steps, y=label), least, lcb, min_accepted=min_accepted).first()  # one row
    if best is None:
        raise ValueError("no row is held out")
    done = fit_and_score(dev, test, features, kind, label, seed)
    return done.withColumn("label", F.when(F.col("p") >= best["threshold"], 1).otherwise(-1)), best.asDict()


def allowed_tokens(scores, allowed):
    """Token scores with all but the allowed ids at minus infinity (arrays as columns)."""
    return F.transform(scores, lambda s, i: F.when(F.array_contains(allowed, i), s).otherwise(F.lit(float("-inf"))))


#: A lemma's senses are dealt over so many cells, and the words go to each, so that a frequent lemma's pairs are made in many tasks.
CELLS, PARTS = 32, 96


def senses(words: DataFrame, table: DataFrame) -> DataFrame:
    """Senses (lemma, pos, sense) of words (lemma, tag), of the part of speech that the tag stands for, or of all if it stands for none.

    There are as many rows as a lemma's words times its senses; no pair is made of another part of speech.
    """
    typed = words.withColumn("pos_of", X.wordnet_pos(F.col("tag")))
    cells, own = F.sequence(F.lit(0), F.lit(CELLS - 1)), [c for c in typed.columns if c not in ("lemma", "pos_of")]
    dealt = typed.withColumn("__cell", F.explode(cells))
    table = table.withColumn("__cell", F.pmod(F.xxhash64(*table.columns), F.lit(CELLS)))
    columns = ["lemma", *own, *[c for c in table.columns if c not in ("lemma", "__cell")]]
    by = lambda df, *keys: df.repartition(PARTS, *keys, "__cell")
    kind = ["lemma", "pos", "__cell"]
    some = by(dealt.where("pos_of is not null").withColumnRenamed("pos_of", "pos"), "lemma", "pos").join(by(table, "lemma", "pos"), kind)
    every = by(dealt.where("pos_of is null").drop("pos_of"), "lemma").join(by(table, "lemma"), ["lemma", "__cell"])
    return some.select(columns).unionByName(every.select(columns))
