"""Media columns: store payloads as media, and sniff what a column of bytes really holds.

One Aho-Corasick pass finds every magic number in the bytes; the format's validator then follows the structure and
its lengths from there.  What starts at the first byte corrects the declared type; what is found further in and
validates is carved out as embedded media.  Magic bytes alone, as in running text, are not enough.

Scale: per-row work, no shuffle; rows of any size are handled one at a time, in time that grows with their bytes: chunks that
several headers reach are walked once, and checksums of long chunks come from running sums.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import operator
import re
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import table

UNIT, RATE = 64, 8000
#: Magic bytes of the formats known here, and their validators.
MAGIC = (
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"%PDF-", "application/pdf"),
)


#: Forms of RIFF files: type, and the chunks of which one must be there (all of the first tuple for sound).
RIFF = {b"WAVE": ("audio/wav", (b"fmt ", b"data"), 2), b"WEBP": ("image/webp", (b"VP8 ", b"VP8L", b"VP8X"), 1), b"AVI ": ("video/x-msvideo", (b"LIST",), 1)}


#: Chunk names that any form asks for.
RIFF_NAMES = sorted({n for _, names, _ in RIFF.values() for n in names})


class Chains:
    """Chunk chains of all RIFF headers in some bytes, each chunk walked once.

    From a chunk the next one follows from its own length alone, so chains that meet go on together and make a forest
    whose roots lie at the end.  Whether a file's declared end is on the chain of its first chunk is then a matter of
    the order in which the forest is numbered, and which chunks lie between follows from counts along the chains.
    """

    def __init__(self, b: bytes):
        after: dict[int, int] = {}
        at = b.find(b"RIFF")
        while at >= 0:
            c = at + 12
            while c + 8 <= len(b) and c not in after:
                size = int.from_bytes(b[c + 4 : c + 8], "little")
                after[c] = c + 8 + size + size % 2
                c = after[c]
            at = b.find(b"RIFF", at + 1)
        weight: dict[int, int] = {}
        for c in sorted(after):
            weight[c] = weight.get(c, 0) + 1
            weight[after[c]] = weight.get(after[c], 0) + weight[c]
        for root in set(after.values()) - set(after):
            weight[root] = weight.get(root, 0) + 1
        self.place, self.counts, self.weight, free, roots = {}, {}, weight, {}, 0
        for c in sorted(weight, reverse=True):
            up = after.get(c)
            if up is None:
                self.place[c], roots = roots, roots + weight[c]
                self.counts[c] = (0,) * len(RIFF_NAMES)
            else:
                self.place[c], free[up] = free[up], free[up] + weight[c]
                name = b[c : c + 4]
                self.counts[c] = tuple(n + (name == x) for n, x in zip(self.counts[up], RIFF_NAMES))
            free[c] = self.place[c] + 1

    def between(self, first: int, end: int) -> set[bytes] | None:
        """Names that matter of the chunks from first up to end; None if end isn't on first's chain."""
        if first == end:
            return set()
        if first not in self.place or end not in self.place or not self.place[end] <= self.place[first] < self.place[end] + self.weight[end]:
            return None
        return {x for x, n, m in zip(RIFF_NAMES, self.counts[first], self.counts[end]) if n > m}


def _riff(b: bytes, at: int, dead: Dead) -> tuple[int, str] | None:
    """(end, type) of a valid file of the format that starts at `at`, else None (as for all validators); dead keeps what was found out about these bytes."""
    form = RIFF.get(b[at + 8 : at + 12])
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if form is None or end > len(b):
        return None
    kind, need, least = form
    if dead.chains is None:
        dead.chains = Chains(b)
    names = dead.chains.between(at + 12, end)
    return (end, kind) if names is not None and len(names & set(need)) >= least else None


def _zeros() -> list[list[int]]:
    """What 2^k zero bytes, k = 0, 1, ..., do to a CRC-32, as columns of a matrix over bits."""
    times = lambda m, v: functools.reduce(operator.xor, (m[i] for i in range(32) if v >> i & 1), 0)
    one = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    out = []
    for k in range(3 + 40):
        if k >= 3:
            out.append(one)
        one = [times(one, v) for v in one]
    return out


class Sums:
    """CRC-32 of any stretch of some bytes after one pass: sums up to every STEP bytes, and what lies between."""

    STEP = 1024

    def __init__(self, b: bytes):
        self.b, self.upto = b, [0]
        for i in range(0, len(b), self.STEP):
            self.upto.append(zlib.crc32(b[i : i + self.STEP], self.upto[-1]))

    def _to(self, n: int) -> int:
        k = n // self.STEP
        return zlib.crc32(self.b[k * self.STEP : n], self.upto[k])

    def of(self, start: int, end: int) -> int:
        if end - start <= 4 * self.STEP:
            return zlib.crc32(self.b[start:end])
        if not _ZEROS:
            _ZEROS.extend(_zeros())
        v, n, k = self._to(start), end - start, 0
        while n:
            if n & 1:
                v = functools.reduce(operator.xor, (c for i, c in enumerate(_ZEROS[k]) if v >> i & 1), 0)
            n, k = n >> 1, k + 1
        return v ^ self._to(end)


_ZEROS: list[list[int]] = []


def _png(b: bytes, at: int, dead: Dead) -> tuple[int, str] | None:
    chunk, first, walked = at + 8, True, []
    while chunk + 12 <= len(b) and chunk not in dead:
        size, name = struct.unpack(">I4s", b[chunk : chunk + 8])
        end = chunk + 12 + size
        if end > len(b) or first != (name == b"IHDR") or (first and size != 13):
            break
        walked += [] if first else [chunk]
        if dead.sums is None:
            dead.sums = Sums(b)
        if dead.sums.of(chunk + 4, end - 4) != int.from_bytes(b[end - 4 : end], "big"):
            break
        if name == b"IEND":
            return end, "image/png"
        chunk, first = end, False
    dead.update(walked)
    return None


def _gif(b: bytes, at: int, dead: Dead) -> tuple[int, str] | None:
    if at + 13 > len(b):
        return None
    pos, walked = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0), []
    while pos < len(b) and ("gif", pos) not in dead:
        walked.append(("gif", pos))
        if b[pos] == 0x3B:
            return pos + 1, "image/gif"
        if b[pos] == 0x21:
            pos += 2
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 0x80 else 0)
        else:
            break
        while pos < len(b) and b[pos] and ("sub", pos) not in dead:
            walked.append(("sub", pos))
            pos += b[pos] + 1
        if ("sub", pos) in dead:
            break
        pos += 1
    dead.update(walked)
    return None


class Dead(set):
    """Places from which validators failed before, and what is found out once for all of them when it is asked for: work stays linear in the bytes."""

    marks: list[int] | None = None
    chains: Chains | None = None
    sums: Sums | None = None


_MARK = re.compile(rb"\xff(?=[^\x00\xd0-\xd7])", re.S)


def _jpeg(b: bytes, at: int, dead: Dead) -> tuple[int, str] | None:
    pos, frame, walked = at + 2, False, []
    while pos + 4 <= len(b) and b[pos] == 0xFF and (frame, pos) not in dead:
        walked.append((frame, pos))
        mark, size = b[pos + 1], int.from_bytes(b[pos + 2 : pos + 4], "big")
        frame |= 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        pos += 2 + size
        if size < 2:
            break
        if mark == 0xDA:  # picture data goes on to the next real marker
            if dead.marks is None:
                dead.marks = [m.start() for m in _MARK.finditer(b)]
            found = bisect.bisect_left(dead.marks, pos)
            if found == len(dead.marks):
                break
            pos = dead.marks[found]
        if b[pos : pos + 2] == b"\xff\xd9":
            if frame:
                return pos + 2, "image/jpeg"
            break
    dead.update(walked)
    return None


def _bmp(b: bytes, at: int, dead: Dead) -> tuple[int, str] | None:
    if at + 26 > len(b):
        return None
    size, zero, data, head = struct.unpack("<IIII", b[at + 2 : at + 18])
    return (at + size, "image/bmp") if zero == 0 and head in (12, 40, 108, 124) and 14 + head <= data < size and at + size <= len(b) else None


def _pdf(b: bytes, at: int, dead: Dead) -> tuple[int, str] | None:
    """To the last end mark before the next header, so that files saved again are whole; searches stay between headers."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    limit = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, limit if limit >= 0 else len(b))
    return (end + 5, "application/pdf") if end > at and b.find(b"startxref", at, end) > 0 else None


_VALID = {"riff": _riff, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf}
_AUTOMATON: list = []


def sniffed(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of every valid medium, the whole's first, then those carved from inside it or its plain parts.

    A medium inside a carved one is not listed again; inside the one at byte 0 it is.
    """
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for magic, kind in MAGIC:
            a.add_word(magic.decode("latin-1"), (len(magic), kind))
        a.make_automaton()
        _AUTOMATON.append(a)
    found, free, dead = [], 0, Dead()
    for last, (n, kind) in _AUTOMATON[0].iter(data.decode("latin-1")):
        at = last + 1 - n
        if at >= free and (got := _VALID[kind](data, at, dead)):
            found.append((got[1], at, got[0] - at))
            free = got[0] if at else 1
    return found


def wav(payload: bytes) -> bytes:
    """payload as the samples of an 8-bit mono WAV file (its length is even)."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    """The bytes of a WAV file's data chunk."""
    pos = 12
    while media[pos : pos + 4] != b"data":
        size = int.from_bytes(media[pos + 4 : pos + 8], "little")
        pos += 8 + size + size % 2
    return media[pos + 8 : pos + 8 + int.from_bytes(media[pos + 4 : pos + 8], "little")]


def stored(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return wav(raw + bytes(-len(raw) % UNIT if raw else UNIT))


def with_media(docs: DataFrame, text: str = "text", name: str = "media") -> DataFrame:
    """docs with their text stored as a WAV file; a null text is stored as an empty one, as 64 zero samples."""

    @F.pandas_udf("binary")
    def of(col):
        return col.map(stored)

    return docs.withColumn(name, of(F.col(text)))


def typed(rows: DataFrame, media: str = "media", declared: Column | None = None) -> DataFrame:
    """rows with found: struct<type, declared_ok, length, carved: array<struct<type, start, length>>>.

    type is what the bytes validate as from the first one, or application/octet-stream; length is that file's own.
    Null bytes have type null, and empty ones application/octet-stream, both with nothing carved; a null declared type
    is never right; equal bytes give equal results; a column called found is replaced; an empty table stays empty.
    """

    @F.pandas_udf("struct<type:string,length:long,carved:array<struct<type:string,start:long,length:long>>>")
    def of(col):
        import pandas as pd

        out = []
        for b in col:
            got = sniffed(b) if b is not None else []
            whole = got[0] if got and got[0][1] == 0 else None
            kind = None if b is None else whole[0] if whole else "application/octet-stream"
            out.append((kind, whole[2] if whole else len(b or b""), [{"type": k, "start": a, "length": n} for k, a, n in got if a]))
        return pd.DataFrame(out, columns=["type", "length", "carved"], index=col.index)

    given = F.lit(None).cast("string") if declared is None else declared
    got = rows.withColumn("__found", of(F.col(media)))
    ok = F.coalesce(given == F.col("__found.type"), F.lit(False))
    return got.withColumn("found", F.struct("__found.type", ok.alias("declared_ok"), "__found.length", "__found.carved")).drop("__found")


def digests(rows: DataFrame, media: str = "media") -> DataFrame:
    """rows with digest: what the stored samples and the stored form hash to, read back from the stored bytes."""

    @F.pandas_udf("struct<payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,mean:double,power:double,crossings:long>")
    def of(col):
        import pandas as pd

        out = []
        for b in col:
            p = samples(b)
            a = np.frombuffer(p, np.uint8)
            n = len(a)
            total = sum(int(a[i : i + 65536].sum(dtype=np.int64)) for i in range(0, n, 65536))
            power = sum(int((a[i : i + 65536].astype(np.int64) ** 2).sum()) for i in range(0, n, 65536))
            up = a >= 128
            out.append((n, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(b), hashlib.sha256(b).hexdigest(), total / n, power / n, int((up[1:] != up[:-1]).sum())))
        return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "mean", "power", "crossings"], index=col.index)

    return rows.withColumn("digest", of(F.col(media)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: what each document's stored form and the samples read back from it hash to, and their features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    media = with_media(docs.withColumn("n_bytes", n)).select("doc_id", "n_bytes", "media")
    rows = digests(typed(media, declared=F.lit("audio/basic")))  # a wrong declaration, to be corrected
    embedded = F.array_join(F.transform("found.carved", lambda c: F.concat_ws(":", c["type"], c["start"].cast("string"), c["length"].cast("string"))), ",")
    feature = F.format_string("type=%s;length=%d;mean=%.4f;power=%.4f;crossings=%d;embedded=%s", "found.type", "found.length", "digest.mean", "digest.power", "digest.crossings", embedded)
    return rows.select("doc_id", "n_bytes", "digest.payload_bytes", "digest.payload_sha256", "digest.tail_crc32", "digest.media_bytes", "digest.media_sha256", feature.alias("feature"), F.col("found.type").alias("media_type"))
