"""Periodic runs against a plain search, planted runs, and odd texts."""

import hashlib
import zlib
from time import perf_counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiforge.llm import runs as R


def plain(w):
    """Every run, found by comparing all words at all distances."""
    n, out = len(w), []
    for p in range(1, n // 3 + 1):
        a = 0
        while a < n - p:
            b = a
            while b < n - p and w[b] == w[b + p]:
                b += 1
            length = b - a + p
            if b > a and length >= max(24, 3 * p) and not any(all(w[k] == w[k + q] for k in range(a, a + length - q)) for q in range(1, p)):
                out.append((a, length, p))
            a = max(b, a + 1) if b > a else a + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 14)), max_size=5))
def test_runs_match_a_plain_search(parts):
    w = [x for block, times in parts for x in block * times][:160]
    assert R.found(np.array(w, np.int32)) == plain(w)


@pytest.mark.parametrize("small", [True, False])
def test_table_and_loop_agree(small, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(R, "TABLE_WORDS", 65536 if small else 0)
    for letters in (1, 2, 3, 40):
        w = rng.integers(0, letters, 140).tolist() + [7, 8, 9, 10, 11] * 6 + rng.integers(0, letters, 20).tolist()
        assert R.found(np.array(w, np.int32)) == plain(w)
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a  # Fibonacci words are as periodic as words get
    assert R.found(np.array(b, np.int32)) == plain(b)


def test_long_documents_take_little_time():
    rng = np.random.default_rng(6)
    kinds = {"one word": np.zeros(400_000, np.int32), "two words": rng.integers(0, 2, 300_000), "varied": rng.integers(0, 5000, 400_000), "long period": np.tile(rng.integers(0, 50, 100_000), 4)[:399_000]}
    for name, w in kinds.items():
        at = perf_counter()
        got = R.found(w.astype(np.int32))
        assert perf_counter() - at < 30, name
        if name != "two words":
            assert got == {"one word": [(0, 400_000, 1)], "varied": [], "long period": [(0, 399_000, 100_000)]}[name]


def test_kept():
    assert np.flatnonzero(R.kept(10, [(1, 6, 2)])).tolist() == [0, 1, 2, 7, 8, 9]


def _expected(doc_id, text):
    words = R.WORD.findall(text or "")
    h, n = (1, len(words)) if doc_id is None else (zlib.crc32(str(doc_id).encode()), len(words))
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if runs else None
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    text = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n_},{q}\n" for s, n_, q in runs)), sha(text))


def test_query_matches_a_plain_search(spark, tmp_path):
    rng = np.random.default_rng(7)
    texts = [" ".join(map(str, rng.integers(0, 3 if i % 3 else 90, int(rng.integers(0, 90))))) for i in range(60)]
    rows = [*enumerate(texts), (None, "a b " * 20), (70, None), (71, ""), (72, " x\t" * 30), (70, None), (-5, "q " * 25)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = R.query(spark, str(tmp_path)).drop("n_words").collect()
    assert sorted(map(tuple, got), key=str) == sorted((_expected(*r) for r in rows), key=str)
    assert sum(r.n_runs > 0 for r in got) >= 4


def test_odd_rows(spark, odd, empty):
    done = R.with_runs(odd)
    assert sorted(done.columns) == sorted([*odd.columns, "n_words", "runs", "collapsed"])
    by = {r.doc_id: r for r in done.collect()}
    assert by[2].n_words == 0 and by[2].collapsed == "" and by[5].runs[0].period == 7 and by[5].collapsed == "le chat ▁ est là 漢字 😀"
    assert R.with_runs(empty).collect() == []
