"""Embeddings, archives, media and the pipeline on odd rows and against brute force."""

import hashlib
import math
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiforge.llm import common, embeddings, media, toxicity, warc
from tests.llm.conftest import ODD


def brute_links(rows):
    unit = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v) / np.linalg.norm(np.array(v, float)) if ok else None)
    links = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9] for i, a in enumerate(unit)]
    root = list(range(len(rows)))
    for i, js in enumerate(links):
        for j in js:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    return [len(x) for x in links], root


def vectors():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 16))
    rows = [rng.normal(size=16) for _ in range(300)] + [c + rng.normal(size=16) * s for c in centre for s in (0, 0.1, 0.2, 0.3)]
    rows += [centre[0] + rng.normal(size=16) * 0.05 for _ in range(150)] + [rows[0], rows[0] * 3]
    rows = [np.float32(v).tolist() for v in rows]
    return list(enumerate(rows + [None, [], [0.0] * 16, [1.0] + [None] * 15, [math.nan] * 16, [math.inf] * 16, [1.0, 2.0], [2.0, 4.0]]))


def test_embedding_links_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, node string, w string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    links, root = brute_links(rows)
    assert [got[i].n_links for i, _ in rows] == links
    assert [got[i].component_id for i, _ in rows] == root
    assert all(got[i].kept == (root[i] == i) for i, _ in rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    again = embeddings.near_duplicates(df.where("vec_id = 3").union(df.where("vec_id = 3")).union(df.where("vec_id = 3").selectExpr("null", "embedding", "node", "w")))
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in again.collect()) == [("3", 2, 3), ("3", 2, 3), ("None", 2, 3)]


def test_graph_search_finds_neighbours():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = embeddings.Shard(x, link=0.6)
    true = x[:200] @ x.T >= 0.6
    i, j = shard.links(x[:200])
    assert true[i, j].all() and len(set(zip(i, j))) >= 0.98 * true.sum()
    ids, _ = shard.graph.search(np.float32(x[:200]), 64)
    nearest = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([set(a) <= set(b) for a, b in zip(nearest, ids)]) > 0.9


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if None not in e for n in e}
    for a, b in [e for e in edges if None not in e] * 2:
        x, y = root[a], root[b]
        root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    assert all(got.get(n, n) == r for n, r in root.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_archive_round_trip_and_look_up(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"https://h{i % 7}.example.com/p/{i}?q#{i}", "<p>" + "x" * rng.randint(0, 5)) for i in range(500)]
    rows += [(1000, None, None), (1001, "not a url", ""), (1002, "http://A.b/é", "漢" * 5000), (None, "http://a.b/", "only"), (7, rows[7][1], rows[7][2])]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, k string, sha string")
    folder = str(tmp_path / "w")
    got = warc.round_trip(pages, folder).collect()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    expect = []
    for i, _, h in rows:
        b, t = (h or "").encode(), top[h or ""]
        revisit = t != -1 and i != t
        expect.append((i, len(b), warc.base32_sha1(b), "revisit" if revisit else "response", t if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(expect, key=str)
    written = warc.write(pages, str(tmp_path / "v"))
    master = warc.build_index(written, str(tmp_path / "v"), lines=3)
    asked = pages.where("page_id in (3, 7, 1002)").select(warc.index_key(F.col("url"), F.col("page_id")).alias("k")).union(spark.createDataFrame([("zz)/ 1",)], "k string"))
    found = warc.read(warc.look_up(asked, str(tmp_path / "v"), master), str(tmp_path / "v"), payload=True).collect()
    assert sorted(r.page_id for r in found) == [3, 7, 7, 1002]
    assert next(r.payload for r in found if r.page_id == 1002).decode() == "漢" * 5000
    assert warc.round_trip(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_reversed_host_keys(spark):
    urls = {"http://www.Example.com:80/a?b": "com,example,www)/a?b", "https://u@x.y/": "y,x)/", "plain": "plain", None: "", "ftp://h": "h)"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(warc.surt(F.col("u")).alias("k")).collect()
    assert [r.k for r in got] == list(urls.values())


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


GIF = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"\x2c" + bytes(8) + b"\0" + b"\x02\x02\x44\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x04cd\xff\xda\x00\x04ef12\xff\x0034\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIii", 58, 0, 54, 40, 1, 1) + bytes(32)
PDF = b"%PDF-1.4 x startxref 0 %%EOF"


def test_sniffing_validates_corrects_and_carves(spark):
    for kind, data in (("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("image/bmp", BMP), ("application/pdf", PDF), ("audio/wav", media.wav(bytes(64)))):
        assert media.sniffed(data) == [(kind, 0, len(data))]
        assert media.sniffed(b"text " + data + b" more") == [(kind, 5, len(data))]
        assert media.sniffed(data[:-1]) == [] and media.sniffed(data[: len(data) // 2]) == []
    damaged = bytearray(png())
    damaged[20] ^= 1
    assert media.sniffed(bytes(damaged)) == [] and media.sniffed(b"BM RIFF %PDF- GIF89a") == []
    inside = media.wav(b"ab" + png() + GIF + bytes(len(png() + GIF) % 2))
    rows = spark.createDataFrame([(1, inside), (2, b""), (3, None), (4, png())], "i int, media binary")
    got = {r.i: r.found for r in media.typed(rows, declared=F.lit("image/png")).collect()}
    assert (got[1].type, got[1].declared_ok, [c.type for c in got[1].carved], got[1].carved[0].start) == ("audio/wav", False, ["image/png", "image/gif"], 46)
    assert (got[2].type, got[3].type, got[4].declared_ok) == ("application/octet-stream", None, True)


def test_stored_texts_read_back(odd, spark):
    for t in [x[1] for x in ODD]:
        raw = (t or "").encode()
        p = media.samples(media.stored(t))
        assert p[: len(raw)] == raw and not any(p[len(raw) :]) and len(p) % 64 == 0 and 0 < len(p) < len(raw) + 65 and len(p) >= len(raw)
    got = {(r.doc_id, r.n_chars): r.digest for r in media.digests(media.with_media(odd)).collect()}
    p = media.samples(media.stored(ODD[0][1]))
    assert got[1, 36].payload_sha256 == hashlib.sha256(p).hexdigest() and got[1, 36].tail_crc32 == zlib.crc32(p[-64:])
    assert got[2, None] == got[3, 0]
    assert media.digests(media.typed(media.with_media(odd.limit(0)))).count() == 0


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(300)]
    docs = []
    for i in range(360):
        t = " ".join(rng.choices(words, k=120))
        if i % 6 == 0:
            t += rng.choice([" idiot", " stupid"]) + "."
        if i % 10 == 3:
            t += " call +1 (456) 555-2186"
        docs.append((i, t, "en", f"s{i % 4}", len(t)))
    docs += [(500 + i, t, "en", s, n) for i, t, _, s, n in docs[:40]] + [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(360)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return f"file://{at}", docs


def test_pipeline_stage_by_stage(spark, small):
    at, docs = small
    frame = spark.read.parquet(f"{at}/documents.parquet")
    (_, reject), (_, near), (_, hide), (_, mix), (_, encode) = corpus_pipeline.STAGES
    left = reject(spark, frame, at)
    toxic = {i for i, t, *_ in docs if t and ("idiot" in t or "stupid" in t)}
    assert left.columns == frame.columns and {r.doc_id for r in left.collect()} == {d[0] for d in docs} - toxic
    kept = near(spark, left, at)
    # null and empty texts share the fingerprint zero, so one of the two stays
    assert {r.doc_id for r in kept.collect()} == {i for i in range(360) if i not in toxic} | {900}
    hidden = hide(spark, kept, at).collect()
    assert not any("555-2186" in (r.text or "") for r in hidden) and all(r.text is None or len(r.text) == r.n_chars for r in hidden)
    mixed = mix(spark, spark.createDataFrame(hidden, kept.schema), at)
    assert mixed.columns == frame.columns and mixed.count() > 100
    done = encode(spark, mixed, at)
    assert done.where("not exact").count() == 0 and done.count() == mixed.count()
    assert corpus_pipeline.run(spark, at).count() == mixed.count()


def test_empty_tables_pass_every_stage(spark, small):
    at, _ = small
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
    assert docs.count() == 0 and toxicity.clean(docs.selectExpr("doc_id", "'' as text"), toxicity.Model(-20.0, {})).count() == 0


def test_blind_graph_falls_back_to_exact_scans(monkeypatch):
    """A graph that finds nothing, or only the vector itself, fails the audit; the shard is then scanned and loses no link."""
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(500, 24)), 3, axis=0) + rng.normal(size=(1500, 24)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= embeddings.LINK))}
    good = embeddings.Shard(x)
    assert good.beam > 0 and good.recall >= embeddings.RECALL

    def blind(self, q, ef):
        ids = np.full((len(q), ef), -1)
        ids[:, 0] = (q @ self.x.T).argmax(axis=1)  # the vector itself
        return ids, np.where(ids >= 0, np.take_along_axis(q @ self.x.T, ids, 1), -np.inf)

    monkeypatch.setattr(embeddings.Graph, "search", blind)
    shard = embeddings.Shard(x)
    assert shard.beam == 0 and set(zip(*shard.links(x))) == true


def _png_file():
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def _riff_file(form, *chunks):
    body = form + b"".join(n + struct.pack("<I", len(d)) + d + bytes(len(d) % 2) for n, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


MEDIA = [
    media.wav(b"ab" * 32), _png_file(), b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(9) + b"\x02\x02\x44\x01\x00\x3b",
    b"\xff\xd8\xff\xc0\x00\x04ab\xff\xda\x00\x02data\xff\x00more\xff\xd9", b"%PDF-1.4\nstartxref 9 %%EOF more startxref 9 %%EOF",
    b"BM" + struct.pack("<IIII", 60, 0, 54, 40) + bytes(42), _riff_file(b"WEBP", (b"VP8L", b"abc")), _riff_file(b"AVI ", (b"LIST", b"movi")),
]


def test_sniffing_matches_every_validator_at_every_place():
    """Files among text, damaged files and each other: the same as trying all validators at all places without any memory."""
    rng = random.Random(9)
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            f = bytearray(rng.choice(MEDIA))
            if rng.random() < 0.3:
                f[rng.randrange(len(f))] ^= 1 << rng.randrange(8)
            parts += [bytes(f[: len(f) if rng.random() < 0.8 else rng.randrange(len(f))]), rng.choice([b"", b"text", b"\xff\xd8\xff", b"RIFF", b"%PDF-", b"BM"])]
        data, want, free = b"".join(parts), [], 0
        for at in range(len(data)):
            for magic, kind in media.MAGIC:
                if at >= free and data.startswith(magic, at) and (got := media._VALID[kind](data, at, media.Dead())):
                    want.append((got[1], at, got[0] - at))
                    free = got[0] if at else 1
        assert media.sniffed(data) == want
    assert [media.sniffed(f)[0][0] for f in MEDIA] == [
        "audio/wav", "image/png", "image/gif", "image/jpeg", "application/pdf", "image/bmp", "image/webp", "video/x-msvideo"]
    assert media.sniffed(MEDIA[4])[0][2] == len(MEDIA[4])


@pytest.mark.parametrize("unit", [b"%PDF-1 ", b"RIFF\xff\xff\x0f\x00WAVE", b"GIF89a", b"\xff\xd8\xff\xda\x00\x02", b"\xff\xd8\xff\xe0\x00\x02", b"\x89PNG\r\n\x1a\n", b"BM"])
def test_repeated_magic_bytes_take_linear_time(unit):
    data = unit * (10_000_000 // len(unit))
    began = time.perf_counter()
    media.sniffed(data)
    assert time.perf_counter() - began < 60
