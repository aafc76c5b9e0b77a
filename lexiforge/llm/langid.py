"""Language identification by multilingual mixture inference.

Learning counts byte trigrams of letters per language.  A document is a mixture of languages: its trigrams are drawn
from the languages' distributions in unknown proportions, found by expectation-maximisation.  The set of languages is
chosen by penalised likelihood: from all languages down, the least is dropped and the proportions are fitted again,
and the set with the best likelihood less a penalty per language wins.

Scale: learning is one pass with a bounded table of languages x 65536 counts per task, summed by Spark; the model is
that table, whatever the corpus; prediction is per row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import held_out, table

GRAMS = 1 << 16
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased letters of a text, non-letters as one space; empty if it has no letter."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, words)):
        return np.empty(0, np.uint16)
    b = np.frombuffer(f" {words} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities (GRAMS, languages), from all rows of docs with a language and text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(name, np.zeros(GRAMS, np.int64))
                sums[name] += np.bincount(grams(t), minlength=GRAMS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text)
    got = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    n = np.zeros((GRAMS, len(names)))
    place = {x: i for i, x in enumerate(names)}
    n[got["gram"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    return names, np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * GRAMS)) if names else np.empty((GRAMS, 0))


def mixtures(found: list[np.ndarray], logp: np.ndarray, rounds: int = 12, penalty: float = 6.0) -> np.ndarray:
    """Language proportions (documents, languages) of the chosen set; rows of zeros for documents without trigrams."""
    size, many = len(found), logp.shape[1]
    out = np.zeros((size, many))
    live = np.array([i for i, g in enumerate(found) if len(g)], int)
    if not len(live) or not many:
        return out
    unique = [np.unique(found[i], return_counts=True) for i in live]
    lens = np.array([len(u) for u, _ in unique])
    begin = np.r_[0, np.cumsum(lens)[:-1]]
    doc = np.repeat(np.arange(len(live)), lens)
    w = np.concatenate([c for _, c in unique]).astype(float)
    total = np.add.reduceat(w, begin)
    lp = logp[np.concatenate([u for u, _ in unique])]
    top = lp.max(axis=1)
    p = np.exp(lp - top[:, None])
    base = np.add.reduceat(w * top, begin)
    active = np.ones((len(live), many), bool)
    best, chosen = np.full(len(live), -np.inf), np.zeros((len(live), many))
    for k in range(many, 0, -1):
        share = active / active.sum(axis=1, keepdims=True)
        for _ in range(rounds if k > 1 else 1):
            r = p * share[doc]
            s = r.sum(axis=1)
            share = np.add.reduceat(r * (w / s)[:, None], begin) / total[:, None]
        score = base + np.add.reduceat(w * np.log((p * share[doc]).sum(axis=1)), begin) - penalty * (k - 1) * np.log(total + 1)
        better = score > best
        best[better], chosen[better] = score[better], share[better]
        least = np.where(active, share, np.inf).argmin(axis=1)
        active[np.arange(len(live)), least] = False
    out[live] = chosen
    return out


def predicted(docs: DataFrame, names: list[str], logp: np.ndarray, text: str = "text", at_once: int = 300_000) -> DataFrame:
    """docs with languages, array<struct<lang, share>> of the chosen set, largest first; empty for null or letterless texts.

    Empty texts count as letterless; ties go to the language that sorts first; equal texts get equal results; a column
    of docs that is called languages is replaced; an empty table, or a model without languages, gives empty arrays.
    """

    @F.pandas_udf("array<struct<lang:string,share:double>>")
    def of(col):
        import pandas as pd

        rows, held, size = [], [], 0

        def solve():
            for share in mixtures(held, logp):
                order = [j for j in np.argsort(-share, kind="stable") if share[j] > 0]
                rows.append([{"lang": names[j], "share": float(min(1.0, share[j]))} for j in order])
            held.clear()

        for t in col:
            held.append(grams(t))
            size += min(len(held[-1]), GRAMS)
            if size >= at_once or len(held) == 256:  # texts whose distinct trigrams fit in memory together
                solve()
                size = 0
        solve()
        return pd.Series(rows, index=col.index)

    return docs.withColumn("languages", of(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    names, logp = learn(docs.where("not held_out"))
    first = F.get("languages", F.lit(0))
    return predicted(docs.select("doc_id", "text", "held_out"), names, logp).select(
        "doc_id", "held_out", F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"), F.coalesce(first["share"], F.lit(0.0)).alias("score"),
        F.size("languages").alias("n_languages"),
    )
