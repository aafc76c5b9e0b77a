"""Alignment of two tokenizers against a plain computation with the tokenizers' own libraries."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

from lexiforge.llm import alignment as L

pytestmark = pytest.mark.skipif(not os.path.isfile(L.BYTE_PAIRS), reason="no tokenizers")
TEXTS = [
    "The cat sat on the mat. It was warm.", "The cat sat on the mat. It was warm.", None, "", " ", "a", "12 34 \t\n .. !!", "le chat est là 漢字 😀 naïve",
    "le chat ▁ est là", "<|endoftext|> and <s> </s> <unk> <0x41>", "unbelievable unbelievably, the cats' warmth; THE CAT", "xxxxxxxxxxxx" * 40, "\x00 nul", "ﬁne ligature é é",
    "  two  blanks   three ", "the the the cat the", "線を引く" * 9 + " 　", "don't we'll they've I'm", "tab\tand\nnewline\r\n",
    "a" + " \n" * 900 + "b" + " " * 1500, " " * 1200 + "x", " " * 999 + "　\x1cy",
]


def plain(rows):
    """All of it for (doc_id, text) rows, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_own = Tokenizer.from_file(L.BYTE_PAIRS)
    a_own.encode_special_tokens = True
    b_own = sentencepiece.SentencePieceProcessor(model_file=L.PIECES)
    letters = L._byte_letters()
    spans, out = [], []
    for _, text in rows:
        raw = b" " + (text or "").encode()
        a = a_own.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_own.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_own.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_own.id_to_piece(i)[3:5], 16)]) if b_own.is_byte(i) else b_own.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            spans.append(([], []))
            continue
        both = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i, p in zip(ids, parts):
                own.append((i, at, at + len(p)))
                at += len(p)
            both.append(own)
        spans.append(tuple(both))
    docs = Counter()
    links = []
    for a, b in spans:
        own = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
        links.append(own)
        docs.update(set(own))
    top = defaultdict(int)
    for (x, _), n in docs.items():
        top[x] = max(top[x], n)
    for (doc_id, _), (a, b), own in zip(rows, spans, links):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        keys, low = [], 0
        for e in ends:
            keys.append("|".join(",".join(str(i) for i, s, t in side if low <= s and t <= e) for side in (a, b)))
            low = e
        sha = hashlib.sha256(";".join(keys).encode()).hexdigest() if keys else ""
        out.append((doc_id, len(a), len(b), len(keys), len(own), sum(docs[x] == top[x[0]] for x in own), sum(docs[x] for x in own), sha))
    return out


def test_documents_match_a_plain_computation(spark):
    rows = [*enumerate(TEXTS), (None, "the cat"), (3, "the cat"), (3, "the cat")]
    got = L.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), L.load())
    assert got.documents.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.documents.collect()), key=str) == sorted(plain(rows), key=str)


@pytest.mark.parametrize("heavy", [1, 3, 10**9])
def test_heavy_groups_change_nothing(spark, heavy, monkeypatch):
    monkeypatch.setattr(L, "HEAVY", heavy)
    rows = list(enumerate(TEXTS * 2))
    got = L.aligned(spark.createDataFrame(rows, "doc_id long, text string"), L.load()).documents.collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 1500").collect()][:70]
    got = L.aligned(spark.createDataFrame(rows, "doc_id long, text string"), L.load()).documents.collect()
    assert sorted(map(tuple, got)) == sorted(plain(rows))


def test_odd_rows(spark, odd, empty):
    clash = odd.withColumns({c: odd.ids for c in ("row", "own", "keys", "times", "docs", "n_a", "count_sum", "best")})
    done = L.aligned(clash, L.load()).documents
    assert len(done.columns) == len(set(done.columns)) and done.count() == odd.count() and {"docs", "best", "own"} <= set(done.columns)
    by = {r.doc_id: r for r in done.collect()}
    assert by[5].n_a == 0 and by[5].groups_sha256 == "" and by[2].n_links == 0 and by[6].n_groups >= 1 and by[6].n_links > 100
    found = L.aligned(empty, L.load())
    assert found.documents.count() == found.pairs.count() == found.groups.count() == 0


def test_long_texts_without_common_ends_take_linear_time():
    from time import perf_counter

    pair = L.Pair(L.load())
    at = perf_counter()
    for text in ("x" * 1_000_000, "　" * 200_000, "aé" * 300_000, " " * 1_000_000 + "x", "漢" * 300_000):
        [(a, b)] = pair.tokens([text])
        counts = Counter(pair.groups(a, b))
        assert sum(len(pair.links(k)) for k in counts) <= len(a) + len(b) and len(pair.again(counts)) <= len(a) + len(b)
    assert perf_counter() - at < 60
