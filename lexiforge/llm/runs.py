"""Periodic runs in documents: words that go round, found by probing a harmonic grid.

A run of period p that is at least three periods long holds two grid points jp and (j+1)p whose words each equal the
word p further on.  So for every period only the n / p grid points are probed, n log n in all, in one array comparison
for most documents.  Survivors are compared at a few more places, then extended to both sides in chunks that double.
Grid points inside a run that was found with a divisor of the period are skipped: what repeats there is that run.

Scale: per-row work, no shuffle; a text of any length is handled whole, in memory that grows with its words alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import appended, table

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Documents of up to so many words are probed in one comparison over a kept table of grid points (5 MB), longer ones a period at a time.
TABLE_WORDS = 65536
#: Further places at which survivors are compared before they are extended; words of the first chunk.
PLACES, CHUNK = 8, 32
WORD = re.compile(r"[^\x20\x09-\x0D]+")

Run = tuple[int, int, int]
_TABLE: list[np.ndarray] = [np.zeros(0, np.int32)] * 3


def _grid(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, periods) of the grid for n words; a point is followed by two words at its period's distance."""
    if n > TABLE_WORDS:
        raise ValueError("too many words for the table")
    if not len(_TABLE[0]) or n > _TABLE[2][-1] + 1:
        size = max(256, 1 << (n - 1).bit_length())
        points = [np.arange(0, size - 2 * p, p, dtype=np.int32) for p in range(1, size // 2)]
        at = np.concatenate(points)
        step = np.repeat(np.arange(1, size // 2, dtype=np.int32), [len(x) for x in points])
        order = np.argsort(at + 2 * step, kind="stable")
        _TABLE[:] = [at[order], step[order], (at + 2 * step)[order]]
    fit = np.searchsorted(_TABLE[2], n)
    return _TABLE[0][:fit], _TABLE[1][:fit]


def _survivors(w: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(period, ascending grid points) with equal words at jp, (j+1)p and (j+2)p, periods ascending."""
    n = len(w)
    if n > TABLE_WORDS:
        for p in range(1, n // LEAST_PERIODS + 1):
            same = w[:-p:p] == w[p::p]
            if (both := same[:-1] & same[1:]).any():
                yield p, np.flatnonzero(both) * p
        return
    at, step = _grid(n)
    first = w[at] == w[at + step]
    at, step = at[first], step[first]
    keep = (w[at] == w[at + 2 * step]) & (step <= n // LEAST_PERIODS)
    at, step = at[keep], step[keep]
    order = np.lexsort((at, step))
    at, step = at[order], step[order]
    ends = np.flatnonzero(np.diff(step, append=0))
    for a, b in zip([0, *(ends[:-1] + 1)], ends + 1):
        yield int(step[a]), at[a:b]


def _extent(w: np.ndarray, p: int, at: int) -> tuple[int, int]:
    """The stretch [a, b) of places around `at` whose words equal those p further on."""
    a, b, n = at, at + 1, len(w) - p
    size = CHUNK
    while b < n:
        differ = np.flatnonzero(w[b : min(b + size, n)] != w[b + p : min(b + size, n) + p])
        if len(differ):
            b += int(differ[0])
            break
        b, size = min(b + size, n), size * 2
    size = CHUNK
    while a > 0:
        low = max(a - size, 0)
        differ = np.flatnonzero(w[low:a] != w[low + p : a + p])
        if len(differ):
            a = low + int(differ[-1]) + 1
            break
        a, size = low, size * 2
    return a, b


def found(w: np.ndarray) -> list[Run]:
    """(start, length, period) of every run in an array of word numbers, by start, then period.

    The period is the run's smallest; the run is as long as that period lasts; runs of different periods may overlap.
    """
    runs: dict[int, list[Run]] = {}
    if len(w) < LEAST_WORDS:
        return []
    for p, at in _survivors(w):
        for k in range(1, min(p, PLACES + 1)):  # all places between two grid points of a run are equal
            at = at[w[at + k] == w[at + k + p]]
        for q in runs if len(at) else ():
            if p % q == 0:
                for start, length, _ in runs[q]:
                    at = at[(at < start) | (at + p > start + length)]
        done = -1
        for i in at.tolist():
            if i < done:
                continue
            a, done = _extent(w, p, i)
            if done - a + p >= max(LEAST_WORDS, LEAST_PERIODS * p):
                runs.setdefault(p, []).append((a, done - a + p, p))
    return sorted((r for own in runs.values() for r in own), key=lambda r: (r[0], r[2]))


def numbered(words: list[str]) -> np.ndarray:
    numbers: dict[str, int] = {}
    return np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int32, len(words))


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay if every run keeps its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the run that a document's id calls for in one of ten; a null id calls for none."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    own = words[a : a + p]
    return words[:a] + (own * ((n - a) // p + 1))[: n - a]


def with_runs(docs: DataFrame, text: str = "text", change: Callable[[list[str], int | None], list[str]] | None = None, key: str = "doc_id") -> DataFrame:
    """docs with n_words, runs (array<struct<start, length, period>>, words numbered from 0) and collapsed: the text with each run's first period only, its words joined by one space.

    change may alter the words, given also the row's key.  Null and empty texts have no words, no runs and an empty
    collapsed text; texts of any length are searched whole; equal texts give equal runs; columns of docs with these
    names are replaced; an empty table stays empty.
    """

    def compute(col: pa.Array) -> list[pa.Array]:
        counts, all_runs, texts = [], [], []
        for one, own in zip(col.field("text").to_pylist(), col.field("key").to_pylist()):
            words = WORD.findall(one or "")
            words = change(words, own) if change else words
            runs = found(numbered(words))
            counts.append(len(words))
            all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            texts.append(" ".join(compress(words, kept(len(words), runs))) if runs else " ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return [pa.array(counts, pa.int64()), pa.array(all_runs, kind), pa.array(texts, pa.string())]

    given = docs.withColumn("__in", F.struct(F.col(text).cast("string").alias("text"), F.col(key).alias("key")))
    return appended(given, "__in", "n_words long; runs array<struct<start:long,length:long,period:long>>; collapsed string", compute, at_once=64).drop("__in")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's runs after planting, the strongest of them, and digests of all runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_runs(docs, change=planted)
    # of equal exponents the first wins: runs come by start, then period
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
