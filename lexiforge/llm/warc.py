"""WARC archives with a two-level capture index.

Pages are written as gzip members, one record each, into rolling .warc.gz files.  The index is built from what was
written: lines keyed by reversed-host URL, sorted over the whole cluster, packed into compressed blocks; a directory
holds the first key and the place of each block, and a master list the first key of each index part.  A look-up
bisects the master list, that part's directory and the block's lines, then reads the record's byte range.

Scale: each task writes and reads its own files in the given shared folder through pyarrow's file systems, under names
that no other attempt uses; only what a finished task reports counts, so a lost executor leaves unused files behind and
nothing else.  The driver holds the master list alone, one row per index partition.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import cut, shared_dir, table

ROLL, LINES, READ_AT_ONCE = 256 << 20, 2000, 4 << 20
#: Records that a task indexes or looks up, and bytes of archives that it reads.
KEYS_A_TASK, BYTES_A_TASK = 100_000, 64 << 20
DATE = "2024-01-01T00:00:00Z"


def _fs(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def surt(url: Column) -> Column:
    """The reversed-host key of a URL: com,example,www)/path?query; what isn't a URL is its own key, null an empty one."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(F.coalesce(host, F.lit("")) == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def index_key(url: Column, page_id: Column) -> Column:
    """What the index is sorted by: the URL's key and the page's id, without line breaks."""
    return F.regexp_replace(F.concat(surt(url), F.lit(" "), F.coalesce(page_id.cast("string"), F.lit("null"))), r"[\t\r\n]", "%")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that has the response's HTTP headers but not its payload."""
    name = lambda i: f"<urn:lexiforge:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"Content-Length: {len(body)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """What a record says: page_id, record_type, refers_to, payload_bytes, payload_digest and, for responses, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    got = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(got["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    number = lambda x: None if (n := x.rpartition(":")[2].rstrip(">")) == "null" else int(n)
    revisit = got["WARC-Type"] == "revisit"
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {got['WARC-Record-ID']}")
    return {
        "page_id": number(got["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": got["WARC-Type"],
        "refers_to": number(got["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def with_record_type(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages (page_id, url, html) with top: for a revisit the page_id of its response, and revisit.

    Of records with equal payloads of at least `least` bytes, that with the largest page_id is the response (rows that
    share it all are; a null id is the smallest); the others revisit it.  Types are found on rows of id and digest, so a
    frequent payload is aggregated and only narrow rows meet by digest; pages are dealt by id and digest.
    """
    own = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    narrow = own.where(F.octet_length("html") >= least).select("page_id", "sha")
    twice = narrow.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    tops = narrow.distinct().join(twice, "sha").select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), "top")
    typed = own.join(tops.hint("shuffle_hash"), own["page_id"].eqNullSafe(tops["__id"]) & (own["sha"] == tops["__sha"]), "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return typed.select("page_id", "url", "html", "top", revisit.alias("revisit"), index_key(F.col("url"), F.col("page_id")).alias("k"))


class _Roll:
    """Appends to files of a folder, a new one when the last is large."""

    def __init__(self, folder: str, prefix: str, suffix: str):
        self.fs, self.path = _fs(folder)
        self.stem, self.suffix, self.count, self.out, self.at = f"{prefix}-{uuid.uuid4().hex}", suffix, 0, None, 0

    def write(self, data: bytes) -> tuple[str, int]:
        if self.out is None or self.at >= ROLL:
            self.close()
            self.fs.create_dir(self.path, recursive=True)
            self.name = f"{self.stem}-{self.count:05d}{self.suffix}"
            self.out, self.at, self.count = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, self.count + 1
        start = self.at
        self.out.write(data)
        self.at += len(data)
        return self.name, start

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _tasks(spark: SparkSession, amount: int | None, each: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-(amount or 0) // each))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write the archives; rows (k, file, start, length), one per record, computed once."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = _Roll(folder, "pages", ".warc.gz")
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):  # pages may be long
            rows = []
            for page_id, url, html, top, revisit, k in zip(*(c.to_pylist() for c in b.columns)):
                data = gzip.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), top, revisit), 5, mtime=0)
                rows.append((k, *roll.write(data), len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["k", "file", "start", "length"])
        roll.close()

    return cut(with_record_type(pages, least).mapInArrow(out, "k string, file string, start long, length long"))


def build_index(written: DataFrame, folder: str, lines: int = LINES) -> list[tuple[str, str, int, int]]:
    """Sort the records' keys into compressed blocks with a directory per part; the master list, sorted."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, entries, block, first = _Roll(folder, "index", ".cdx.gz"), [], [], None

        def flush() -> None:
            nonlocal block
            if block:
                data = gzip.compress("\n".join(block).encode("utf-8", "surrogatepass"), 6, mtime=0)
                file, start = roll.write(data)
                entries.append("\t".join((block[0].split("\t", 1)[0], file, str(start), str(len(data)))))
                block = []

        for b in batches:
            for k, file, start, length in zip(*(c.to_pylist() for c in b.columns)):
                first = k if first is None else first
                block.append(f"{k}\t{file}\t{start}\t{length}")
                if len(block) >= lines:
                    flush()
        flush()
        if entries:
            data = gzip.compress("\n".join(entries).encode("utf-8", "surrogatepass"), 6, mtime=0)
            directory = _Roll(folder, "directory", ".gz")
            name, start = directory.write(data)
            directory.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, name, start, len(data))], ["k", "file", "start", "length"])
        roll.close()

    ordered = written.repartitionByRange(_tasks(written.sparkSession, written.count(), KEYS_A_TASK), "k").sortWithinPartitions("k", "file", "start")
    # one job, whose finished tasks alone report their parts: a row for each index partition
    return sorted(map(tuple, ordered.mapInArrow(out, "k string, file string, start long, length long").collect()))


def look_up(requests: DataFrame, folder: str, master: list[tuple[str, str, int, int]], tasks: int | None = None) -> DataFrame:
    """The records' places (k, file, start, length) for distinct keys k; keys that the index lacks give no row."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        firsts = [m[0] for m in master]
        held: dict[str, tuple] = {}

        def read(kind: str, file: str, start: int, length: int) -> tuple[list[str], list[str]]:
            """Lines of a compressed range and their keys; the last of each kind is remembered."""
            place = (file, start)
            if held.get(kind, (None,))[0] != place:
                with fs.open_input_file(f"{path}/{file}") as f:
                    text = gzip.decompress(f.read_at(length, start)).decode("utf-8", "surrogatepass")
                rows = text.split("\n")
                held[kind] = (place, rows, [r.split("\t", 1)[0] for r in rows])
            return held[kind][1:]

        def entries(k: str) -> Iterator[list[str]]:
            for part in range(max(0, bisect.bisect_left(firsts, k) - 1), bisect.bisect_right(firsts, k)):
                rows, keys = read("directory", *master[part][1:])
                for i in range(max(0, bisect.bisect_left(keys, k) - 1), bisect.bisect_right(keys, k)):
                    _, file, start, length = rows[i].split("\t")
                    lines, own = read("block", file, int(start), int(length))
                    for j in range(bisect.bisect_left(own, k), bisect.bisect_right(own, k)):
                        yield lines[j].split("\t")

        for b in batches:
            got = [(k, f, int(s), int(n)) for k in b.column(0).to_pylist() for k, f, s, n in entries(k)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], ["k", "file", "start", "length"])

    asked = requests.select("k").distinct().repartitionByRange(tasks or _tasks(requests.sparkSession, requests.count(), KEYS_A_TASK), "k").sortWithinPartitions("k")
    return asked.mapInArrow(out, "k string, file string, start long, length long")


def read(places: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The records at places; neighbouring ranges are read at once."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for b in batches:
            rows, at = list(zip(*(c.to_pylist() for c in b.columns))), 0
            while at < len(rows):
                file, start, _ = rows[at]
                to, end = at, start
                while to < len(rows) and rows[to][0] == file and rows[to][1] == end and (to == at or end - start < READ_AT_ONCE):
                    end += rows[to][2]
                    to += 1
                with fs.open_input_file(f"{path}/{file}") as f:
                    data = f.read_at(end - start, start)
                got = [parsed(gzip.decompress(data[s - start : s - start + n])) for _, s, n in rows[at:to]]
                yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], k) for c, k in zip(names, kinds)], names)
                at = to

    total = places.agg(F.sum("length")).first()[0]
    near = places.select("file", "start", "length").repartitionByRange(_tasks(places.sparkSession, total, BYTES_A_TASK), "file", "start").sortWithinPartitions("file", "start")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return near.mapInArrow(out, schema)


def round_trip(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages, index them, look every page up and read it back; one row per page.

    A null html is an empty payload; a null url has an empty key; ids may be null or repeat (rows that share id and
    url are separate records under one key); an empty table writes nothing and gives no rows; other columns are ignored.
    """
    own = pages.select("page_id", "url", "html")
    written = write(own, folder, least)
    master = build_index(written, folder)
    asked = own.select(index_key(F.col("url"), F.col("page_id")).alias("k"))
    tasks = _tasks(pages.sparkSession, written.count(), KEYS_A_TASK)
    return read(cut(look_up(asked, folder, master, tasks)), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every page as its archive record says; the archives are removed once they are read."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    got = cut(round_trip(table(spark, sf_dir, "pages"), folder))
    fs, path = _fs(folder)
    if fs.get_file_info(path).type.name == "Directory":
        fs.delete_dir(path)
    return got


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS top FROM p),
b AS (SELECT *,
  list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda j:
    ((instr('0123456789abcdef', hex[((i * 5 + j) // 4 + 1)]) - 1) >> (3 - (i * 5 + j) % 4)) % 2 << (4 - j)))) AS five FROM s)
SELECT page_id, payload_bytes, list_aggregate(list_transform(five, lambda v: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v + 1)::BIGINT]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM b
"""
