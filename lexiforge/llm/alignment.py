"""Alignment of two tokenizers' ids over a corpus by a dictionary of distinct groups.

Where tokens of both tokenizers end at the same byte a text is cut into groups, so that a group's ids alone tell which
of its tokens overlap.  The same few groups make up most of all texts: each document becomes its distinct groups with
their frequencies, the groups of all documents are interned in a dictionary, and links are expanded once for each
distinct group.  A pair of ids counts the documents of every group that holds it, less one for each further group of
the same document that does (the only thing that is found out document by document).  Each group's sums over its links
are then joined back by its key and multiplied by its frequency in the document.

Scale: groups are counted before the shuffle.  A group of which more than one in HEAVY of all (document, group) rows
is, of which there can be at most HEAVY, is joined by broadcast, so no key of the shuffled join is large.  Tables
between the steps are written to the shared folder; the tokenizers' files are read by the driver and go with the tasks.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import appended, shared_dir, table

#: The query's tokenizers: byte-level byte pairs, and a SentencePiece model.
BYTE_PAIRS, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
HEAVY = 20_000
#: A worker remembers what it made for the latest keys of up to so many characters, for at least so many of them.
KEY_LENGTH, REMEMBERED = 64, 200_000
# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Long white space, whose part is cut out here: the engine of PARTS would remember each of its characters as a place to go back to.
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}+")

NONE = np.zeros(0, np.int32)


@dataclass(frozen=True)
class Files:
    """Contents of the two vocabulary files."""

    a: bytes
    b: bytes

    @cached_property
    def name(self) -> str:
        return hashlib.sha256(self.a + self.b).hexdigest()


def load(byte_pairs: str = BYTE_PAIRS, pieces: str = PIECES) -> Files:
    with open(byte_pairs, "rb") as f, open(pieces, "rb") as g:
        return Files(f.read(), g.read())


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memo(dict):
    """Values of make for keys that came lately: two generations, the older dropped when the younger is full; long keys aren't kept."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if isinstance(key, int) or len(key) <= KEY_LENGTH:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Pair:
    """Both tokenizers in a worker."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken

        model = json.loads(files.a)["model"]
        letters = _byte_letters()
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        first = len(model["vocab"]) - len(merges)
        if any(model["vocab"].get(x + y) != first + k for k, (x, y) in enumerate(merges)):
            raise ValueError("ids of the byte pairs must follow the order of their merges")
        # merges in the order of ids give the same tokens as the file's list, several times faster
        self.a = tiktoken.Encoding("a", pat_str=PARTS, mergeable_ranks={t: i for i, t in self.a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_length = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_length[list(self.a_bytes)] = list(map(len, self.a_bytes.values()))
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        self.numbers = list(map(str, range(max(len(self.a_length), len(self.b_length)))))
        self.lone = Memo(lambda k: f"{k >> 32}|{k & 0xFFFFFFFF}")
        self.distinct_pairs = Memo(lambda k: tuple({f"{x}|{y}" for x, y in self.links(k)}))

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of a blank and each text; none where either tokenizer doesn't give these bytes back."""
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1)):
            whole, a, at = " " + (text or ""), [], 0
            for m in _BLANKS.finditer(whole):
                end = m.end() - (m.end() < len(whole))  # the last blank goes with what follows
                a += self.a.encode_ordinary(whole[at : m.start()]) + self.a._encode_single_piece(whole[m.start() : end])
                at = end
            a = a + self.a.encode_ordinary(whole[at:]) if at else self.a.encode_ordinary(whole)
            raw = whole.encode()
            same = text and self.a.decode_bytes(a) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else (NONE, NONE))
        return out

    def groups(self, a: np.ndarray, b: np.ndarray) -> list[str]:
        """Keys of a text's groups in order: the ids of both, as in 5,17|9."""
        if not len(a):
            return []
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        there = np.zeros(int(ends_a[-1]) + 1, bool)
        there[ends_b] = True
        cut_a = np.flatnonzero(there[ends_a])
        cut_b = np.searchsorted(ends_b, ends_a[cut_a])
        from_a, from_b = np.append(0, cut_a[:-1] + 1), np.append(0, cut_b[:-1] + 1)
        out = list(map(self.lone.__getitem__, (a[from_a].astype(np.int64) << 32 | b[from_b]).tolist()))
        several = np.flatnonzero((cut_a > from_a) | (cut_b > from_b))  # all others are of one token each
        a, b, number = a.tolist(), b.tolist(), self.numbers.__getitem__
        for g, i, x, j, y in zip(*(v.tolist() for v in (several, from_a[several], cut_a[several] + 1, from_b[several], cut_b[several] + 1))):
            out[g] = f"{','.join(map(number, a[i:x]))}|{','.join(map(number, b[j:y]))}"
        return out

    def links(self, key: str) -> list[tuple[int, int]]:
        """All pairs of ids in a group whose bytes overlap, an occurrence each: one more is passed at a time, so never more than its tokens."""
        a, b = ([int(x) for x in side.split(",")] for side in key.split("|"))
        ends_a, ends_b = np.cumsum(self.a_length[a]).tolist(), np.cumsum(self.b_length[b]).tolist()
        out, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            out.append((a[i], b[j]))
            low = min(ends_a[i], ends_b[j])
            i, j = i + (ends_a[i] == low), j + (ends_b[j] == low)
        return out

    def again(self, counts: Counter) -> list[str]:
        """Pairs that more than one of a document's distinct groups hold, once for each further one."""
        seen, out = set(), []
        for key in counts:
            if "," in key:
                for p in self.distinct_pairs[key]:
                    if p in counts or p in seen:
                        out.append(p)
                    else:
                        seen.add(p)
        return out


_PAIRS: dict[str, Pair] = {}


def _pair(files: Files) -> Pair:
    if files.name not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[files.name] = Pair(files)
    return _PAIRS[files.name]


GROUPED = "n_a long; n_b long; n_groups long; groups_sha256 string; keys array<string>; times array<int>; again array<string>"


def grouped(docs: DataFrame, files: Files, text: str = "text") -> DataFrame:
    """docs with the columns of GROUPED: numbers of tokens and groups, a digest of the groups in order, the distinct groups' keys with their frequencies, and repeated pairs (Pair.again)."""

    def compute(col: pa.Array) -> list[pa.Array]:
        pair, out = _pair(files), []
        for a, b in pair.tokens(col.to_pylist()):
            keys = pair.groups(a, b)
            counts = Counter(keys)
            digest = hashlib.sha256(";".join(keys).encode()).hexdigest() if keys else ""
            out.append((len(a), len(b), len(keys), digest, list(counts), list(counts.values()), pair.again(counts)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
        return [pa.array([row[k] for row in out], kind) for k, kind in enumerate(kinds)]

    return appended(docs, text, GROUPED, compute, at_once=64)


def expanded(dictionary: DataFrame, files: Files) -> DataFrame:
    """dictionary (a column key and others) with links: array<struct<a, b, n>>, the distinct linked pairs of a group with their occurrences in it."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))

    def compute(col: pa.Array) -> list[pa.Array]:
        pair = _pair(files)
        return [pa.array([[{"a": a, "b": b, "n": n} for (a, b), n in Counter(pair.links(k)).items()] for k in col.to_pylist()], kind)]

    return appended(dictionary, "key", "links array<struct<a:int,b:int,n:int>>", compute)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


@dataclass(frozen=True)
class Aligned:
    """documents: a row a document; pairs: (a, b, docs, best), docs being a pair's count and best whether it is the highest of its a; groups: (key, docs, n_links, n_best, count_sum)."""

    documents: DataFrame
    pairs: DataFrame
    groups: DataFrame


def aligned(docs: DataFrame, files: Files, text: str = "text") -> Aligned:
    """Align both tokenizers over docs; documents has the columns of docs but text, and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A null or empty text, and one that a tokenizer doesn't give back byte by byte, has no tokens: zeros, and an empty
    digest.  Rows are documents: repeated ones count each.  Texts of any length are cut whole; ties for the highest
    count are all best; columns of docs with these names are replaced; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    results = ["n_links", "n_best", "count_sum"]
    own = [c for c in docs.columns if c not in {text, "row", *results, *(x.strip().split(" ")[0] for x in GROUPED.split(";"))}]
    given = docs.select(text, F.struct(*[F.col(f"`{c}`") for c in own]).alias("own")).withColumn("row", F.monotonically_increasing_id())
    rows = _stored(grouped(given, files, text).drop(text), folder, "rows")  # from here on row is fixed

    held = rows.select(F.explode("keys").alias("key"))
    groups = _stored(expanded(held.groupBy("key").agg(F.count("*").alias("docs")), files), folder, "groups")
    links = groups.select("key", "docs", F.explode("links").alias("x")).select("key", "docs", "x.a", "x.b", "x.n")
    part = lambda k: F.split_part("p", F.lit("|"), F.lit(k)).cast("int")
    less = rows.select(F.explode("again").alias("p")).groupBy("p").agg(F.count("*").alias("n")).select(part(1).alias("a"), part(2).alias("b"), (-F.col("n")).alias("docs"))
    counts = links.groupBy("a", "b").agg(F.sum("docs").alias("docs")).unionByName(less).groupBy("a", "b").agg(F.sum("docs").alias("docs"))
    counts = _stored(counts, folder, "counts")
    top = counts.groupBy("a").agg(F.max("docs").alias("top"))  # as many rows at most as the first tokenizer has ids
    pairs = counts.join(F.broadcast(top), "a").select("a", "b", "docs", (F.col("docs") == F.col("top")).alias("best"))

    each = links.select("key", "a", "b", "n").join(pairs, ["a", "b"])
    sums = [F.sum("n"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)), F.sum(F.col("n") * F.col("docs"))]
    scored = each.groupBy("key").agg(*[s.cast("long").alias(c) for s, c in zip(sums, results)])
    scored = _stored(scored.join(groups.select("key", "docs"), "key"), folder, "scored")
    total = groups.agg(F.sum("docs")).first()[0] or 0
    often = F.col("docs") > total / HEAVY  # true of fewer than HEAVY groups, whatever the data
    spread = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    frequent = F.broadcast(scored.where(often))
    seldom = spread.join(frequent.select("key"), "key", "left_anti").join(scored.where(~often), "key")
    times = lambda df: df.groupBy("row").agg(*[F.sum(F.col(c) * F.col("times")).alias(c) for c in results])
    empty = F.lit(None)
    stats = ["n_a", "n_b", "n_groups", "groups_sha256"]
    facts = rows.select("row", "own", *stats, *[empty.cast("long").alias(c) for c in results])
    nothing = [empty.cast(rows.schema["own"].dataType).alias("own"), *[empty.cast(rows.schema[c].dataType).alias(c) for c in stats]]
    found = [times(df).select("row", *nothing, *results) for df in (spread.join(frequent, "key"), seldom)]
    merged = facts.unionByName(found[0]).unionByName(found[1]).groupBy("row").agg(
        F.first("own", ignorenulls=True).alias("own"), *[F.max(c).alias(c) for c in stats], *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in results]
    )
    return Aligned(merged.select("own.*", "n_a", "n_b", "n_groups", *results, "groups_sha256"), pairs, scored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document's tokens, groups and links in numbers, with the digest of its groups."""
    return aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), load()).documents
