"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence is toxic with probability sigmoid(bias + the weights of its features: words, their first four and five
letters); a document with the noisy-or of its sentences, 1 - prod(1 - p).  Weights are fitted to the documents' labels
by gradient steps through the noisy-or, and the sentence scores then locate the offending sentences.

The classifier is fitted on a bounded sample of labelled rows (SAMPLE documents in hash order of their ids) and on at
most FEATURES features; every document is scored over its whole text, row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import appended, held_out, table

SAMPLE, FEATURES, LEAST_DOCS, LEAST_Z = 9000, 4096, 3, 3.0
TOXIC = 0.7
_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGE = "\"'()[]{}<>,;:-–—*_«»„“”¡¿"


@dataclass
class Model:
    bias: float
    weights: dict[str, float]


def features(word: str) -> tuple[str, ...]:
    w = word.strip(_EDGE)
    return (w, w[:4] + "*", w[:5] + "*") if len(w) > 5 else (w, w[:4] + "*") if len(w) > 4 else (w,) if w else ()


def sentences(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(start, end, lower-cased sentence) in code points."""
    for m in _SENTENCE.finditer(text or ""):
        if not m[0].isspace():
            yield m.start(), m.end(), m[0].lower()


class Memo(dict):
    """word -> the places of its known features; it forgets everything when it grows too large."""

    def __init__(self, known: dict[str, int], most: int = 200_000):
        super().__init__()
        self.known, self.most = known, most

    @classmethod
    def of(cls, known: dict[str, int]) -> Memo:
        """One for the calls of a task: the last is kept while known is the same object."""
        if not _MEMOS or _MEMOS[0].known is not known:
            _MEMOS[:] = [cls(known)]
        return _MEMOS[0]

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        got = tuple(self.known[f] for f in features(word) if f in self.known)
        self[word] = got
        return got


_MEMOS: list[Memo] = []
_TOXICITY = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def bag(text: str | None, memo: Memo) -> tuple[list[tuple[int, int, list[int]]], int]:
    """Sentences with known features, and the number of the others."""
    hit, others = [], 0
    for start, end, s in sentences(text):
        got = {f for w in s.split() for f in memo[w]}
        if got:
            hit.append((start, end, sorted(got)))
        else:
            others += 1
    return hit, others


def _chosen(rows: DataFrame) -> list[str]:
    """Features whose document frequency is higher among toxic documents, the surest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[Counter[str]] = [Counter(), Counter()]
        for b in batches:
            for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = {w for _, _, s in sentences(t) for w in s.split()}
                sums[toxic].update({f for w in words for f in features(w)} | {""})
        for toxic, c in enumerate(sums):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["f", "toxic", "n"])

    sums = rows.mapInArrow(count, "f string, toxic int, n long").groupBy("f").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    sums = sums.where(f"a >= {LEAST_DOCS}").persist()
    all_docs = sums.where("f = ''").first()
    if all_docs is None:
        sums.unpersist()
        return []
    odds = F.log((F.col("a") + 0.5) / (all_docs["a"] - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (all_docs["b"] - F.col("b") + 0.5))
    z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    got = [r["f"] for r in sums.where("f <> ''").withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(FEATURES).collect()]
    sums.unpersist()
    return got


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 400) -> Model:
    """Fit on at most `sample` rows of labels (doc_id, toxic); null labels are left out; no rows give a model that scores 0."""
    some = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = some.where("toxic in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = found.orderBy("doc_id").select("text", "toxic").persist()  # one text an id, in the same order in every run
    names = _chosen(rows)
    known = {f: i for i, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(known)
        for b in batches:
            got = [bag(t, memo) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1).cast(pa.int32()), pa.array([[f for _, _, f in hit] for hit, _ in got], pa.list_(pa.list_(pa.int32()))), pa.array([n for _, n in got], pa.int64())],
                ["toxic", "hits", "others"],
            )

    got = rows.mapInArrow(bags, "toxic int, hits array<array<int>>, others long").toArrow().to_pylist() if names else []
    rows.unpersist()
    return _descend(got, names, rounds) if got else Model(-20.0, {})


def _descend(docs: list[dict], names: list[str], rounds: int, decay: float = 2e-4, rate: float = 0.1) -> Model:
    """Adam on the mean log loss of the noisy-or, with decay on the weights."""
    y = np.array([d["toxic"] for d in docs], float)
    others = np.array([d["others"] for d in docs], float)
    doc = np.repeat(np.arange(len(docs)), [len(d["hits"]) for d in docs])
    flat = [s for d in docs for s in d["hits"]]
    sent = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    feat = np.array([f for s in flat for f in s], int)
    w = np.append(np.full(len(names), 1.0), -6.0)  # the last is the bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    softplus = lambda x: np.logaddexp(0, x)  # noqa: E731  -log(1 - sigmoid(x))
    for t in range(1, rounds + 1):
        x = w[-1] + np.bincount(sent, w[feat], len(flat))
        clean = np.bincount(doc, softplus(x), len(docs)) + others * softplus(w[-1])  # -log P(no toxic sentence)
        toxic = np.maximum(-np.expm1(-clean), 1e-12)
        g_clean = ((1 - y) - y * np.exp(-clean) / toxic) / len(docs)  # of the loss by clean
        sig = 1 / (1 + np.exp(-x))
        gx = g_clean[doc] * sig
        g = np.append(np.bincount(feat, gx[sent], len(names)), gx.sum() + (g_clean * others).sum() / (1 + np.exp(-w[-1])))
        g[:-1] += decay * w[:-1] / max(1, len(names)) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model(float(w[-1]), dict(zip(names, w[:-1].tolist())))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with toxicity: struct<score, offending: array<struct<start, end, score>>>, sentences of 0.5 or more.

    Null and empty texts score 0; equal texts score alike; sentences are given in order, in code points, end exclusive;
    a column of docs that is called toxicity is replaced; an empty table stays empty.
    """
    names = list(model.weights)
    known, w, bias = {f: i for i, f in enumerate(names)}, np.array([model.weights[f] for f in names]), model.bias

    def of(col: pa.Array) -> list[pa.Array]:
        memo, out = Memo.of(known), []
        for t in col.to_pylist():
            hit, others = bag(t, memo)
            x = np.array([bias + w[f].sum() for _, _, f in hit])
            clean = np.logaddexp(0, x).sum() + others * np.logaddexp(0, bias)
            p = 1 / (1 + np.exp(-x))
            found = [{"start": a, "end": b, "score": float(q)} for (a, b, _), q in zip(hit, p) if q >= 0.5]
            out.append({"score": float(min(1.0, max(0.0, -np.expm1(-clean)))), "offending": found})
        return [pa.array(out, _TOXICITY)]

    return appended(docs, text, "toxicity struct<score:double,offending:array<struct<start:int,end:int,score:double>>>", of)


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of op7 and of the pipeline: learnt from labels that aren't held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return fit(docs, labels.where(~held_out(F.col("doc_id"), 3, 1)))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the documents that score TOXIC or more; columns are kept as they are."""
    return scored(docs.withColumn("__t", F.col("text")), model, "__t").where(F.col("toxicity.score") < TOXIC).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: doc_id, held_out, score, predicted, and how many sentences offend, of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = scored(docs, trained(spark, docs, sf_dir))
    score = F.col("toxicity.score")
    return got.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), score.alias("score"),
        (score >= TOXIC).cast("int").alias("predicted"), F.size("toxicity.offending").alias("n_offending"),
    )
