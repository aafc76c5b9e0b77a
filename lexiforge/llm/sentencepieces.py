"""SentencePiece encoding and decoding with an Aho-Corasick automaton and a single-pass Viterbi.

The automaton over all pieces is walked once; at each position its output links give the pieces that end there, and
each relaxes the best score of that position.  The result is the segmentation with the greatest sum of piece scores.
Characters outside the vocabulary cost the least score less 10 and become their UTF-8 bytes' pieces.

No piece holds a space after another character, nor a line break, so the text falls into parts (spaces and the word
after them) that no piece crosses: their segmentations are independent, and a task remembers those of frequent parts.

Scale: per-row work on a fixed vocabulary, which the driver reads once and ships with the task; no shuffle.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import appended, table

#: Where the query's vocabulary lies; any SentencePiece model file will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY, REMEMBERED = 10.0, 100_000
#: A byte-pair model's scores are merge ranks, not log probabilities, and their sums would shun every late merge.  By the law of
#: Zipf and Mandelbrot a piece of rank r stands for the log probability -log(r + OFFSET), up to a constant; nothing is trained.
OFFSET = 100


@dataclass(frozen=True)
class Vocabulary:
    """pieces: (text with spaces as spaces, id, score); bytes: 256 ids or none; unk: the id for what is left."""

    pieces: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    unk: int
    prefix: bool = True

    @property
    def unknown_score(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY


def load(path: str = VOCABULARY) -> Vocabulary:
    """Read pieces, scores and the space before a text from a SentencePiece model file; the library is used for nothing else.

    Scores that are all whole and not positive are merge ranks and become log probabilities.  The model's normaliser isn't
    applied: texts are encoded as they are, so that they decode exactly.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    own, bytes_ = [], {}
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            bytes_[int(p[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            own.append((p.replace("▁", " "), i, m.get_score(i)))
    if all(score <= 0 and score == int(score) for _, _, score in own):
        own = [(text, i, -math.log(OFFSET - score)) for text, i, score in own]
    first = m.encode("a", out_type=str)[:1]
    return Vocabulary(tuple(own), tuple(bytes_[b] for b in range(256)) if len(bytes_) == 256 else (), m.unk_id(), first == [] or first[0].startswith("▁"))


class Encoder:
    """Built once in each Python worker; text to ids and back."""

    def __init__(self, v: Vocabulary):
        import ahocorasick

        self.v, self.automaton, self.memo = v, ahocorasick.Automaton(), Memo(self)
        for text, i, score in v.pieces:
            self.automaton.add_word(text, (i, len(text), score))
        self.automaton.make_automaton()
        self.unknown = v.unknown_score
        lone = all("\n" not in p for p, _, _ in v.pieces)
        inner = any(" " in p.lstrip(" ") for p, _, _ in v.pieces)
        self.parts = re.compile(r" *[^ \n]+| +|\n" if lone else r" *[^ ]+| +") if not inner else re.compile(r"(?s).+")
        known = {i: p.encode("utf-8", "surrogatepass") for p, i, _ in v.pieces} | {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        self.raw = [known.get(i, "\ufffd".encode()) for i in range(max(known, default=-1) + 1)]

    def viterbi(self, part: str) -> bytes:
        """Ids (int32) of the best segmentation; of equal scores, the longer last piece."""
        n, unknown = len(part), self.unknown
        best, back, at = [0.0] * (n + 1), [None] * (n + 1), 0
        for end, found in self.automaton.iter(part):
            end += 1
            while at < end:  # a position starts from its character taken as unknown
                at += 1
                best[at] = best[at - 1] + unknown
            score = best[end - found[1]] + found[2]
            if score > best[end]:
                best[end], back[end] = score, found
        out: list[int] = []
        while n:
            if back[n] is None:
                raw = part[n - 1].encode("utf-8", "surrogatepass")
                out.extend([self.v.byte_ids[b] for b in reversed(raw)] if self.v.byte_ids else [self.v.unk])
                n -= 1
            else:
                out.append(back[n][0])
                n -= back[n][1]
        return array("i", reversed(out)).tobytes()

    def encode(self, text: str) -> bytes:
        parts = self.parts.findall((" " + text) if self.v.prefix and text else text)
        return b"".join(map(self.memo.__getitem__, parts))

    def decode(self, ids: list[int]) -> str:
        """The text of ids; those that the vocabulary lacks give U+FFFD."""
        try:
            if ids and min(ids) < 0:
                raise IndexError
            raw = b"".join(map(self.raw.__getitem__, ids))
        except (IndexError, TypeError):
            n = len(self.raw)
            raw = b"".join(self.raw[i] if i is not None and 0 <= i < n else "\ufffd".encode() for i in ids)
        return (raw[1:] if self.v.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


class Memo(dict):
    """part -> ids of frequent parts: two generations, the older dropped when the younger is full; long parts aren't kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def __missing__(self, part: str) -> bytes:
        got = self.old.get(part) or self.encoder.viterbi(part)
        if len(part) <= 64:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[part] = got
        return got


_ENCODERS: dict[int, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    key = hash(v)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v)
    return _ENCODERS[key]


def _ids(texts: list[str | None], enc: Encoder) -> pa.Array:
    """Ids of texts as one list array, without a Python number for each."""
    raw = [None if t is None else enc.encode(t) for t in texts]
    ends = np.cumsum([0] + [len(r or b"") // 4 for r in raw]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(r or b"" for r in raw), np.int32))
    missing = pa.array([r is None for r in raw] + [False])
    return pa.ListArray.from_arrays(pa.array(ends, mask=missing.to_numpy(zero_copy_only=False)), values)


def _texts(ids: list[list[int] | None], enc: Encoder) -> list[str | None]:
    return [None if x is None else enc.decode(x) for x in ids]


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of a text as array<int>; null stays null, an empty text has none.

    Texts of any length are encoded whole; a literal U+2581 is kept apart from spaces (as bytes); equal texts get
    equal ids; a column of docs that is called like ids is replaced; an empty table stays empty.
    """
    return appended(docs, text, f"{ids} array<int>", lambda c: [_ids(c.to_pylist(), _encoder(vocabulary))])


def decoded(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of an array of ids: the inverse of encoded; null stays null, unknown ids give U+FFFD."""
    return appended(rows, ids, f"{text} string", lambda c: [pa.array(_texts(c.to_pylist(), _encoder(vocabulary)), pa.string())])


def tokens(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids, n_ids (null text: 0), and exact: whether decoding the ids gives the text again (also null for null)."""

    def both(col: pa.Array) -> list[pa.Array]:
        enc, texts = _encoder(vocabulary), col.to_pylist()
        ids = _ids(texts, enc)
        back = _texts(ids.to_pylist(), enc)
        return [ids, pa.array([a == b for a, b in zip(texts, back)])]

    done = appended(docs.select("doc_id", "text"), "text", "ids array<int>; exact boolean", both)
    return done.select("doc_id", "ids", F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_ids"), "exact")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the ids of every document, and whether they decode to its text."""
    return tokens(table(spark, sf_dir, "documents"), load())
