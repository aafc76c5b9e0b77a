"""SimHash near-duplicates with pigeonring filtering.

A fingerprint is cut into m segments on a ring.  If two fingerprints differ in at most tau bits, then some
start i exists from which every chain of l consecutive segments differs in at most l * tau / m bits.  While
l * tau / m < 1 the chain is equal; the next segments, up to l * tau / m < 2, hold one difference at most, so
all but one of them are equal.  An index key is therefore: the start, the equal chain, and one equal choice of
the following segments.  Two fingerprints within tau share a key (exact, nothing is lost), and pairs that share
one are pruned segment by segment along the chain before the last sum is the full Hamming distance.

Scale: equal fingerprints are one class before anything is paired, so a hot group of copies is one row.  A key
held by many classes is dealt into tiles of bounded size, and a tile returns a spanning forest of its links,
never all its pairs; components need no more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import appended, components, cut, table

TILE = 2048
#: Keys hold the pattern's number above so many bits of segments.
PATTERN_SHIFT = 48
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash of h (k = 0: h itself)."""
    if k == 0:
        return h
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """64-bit hashes of the text's shingles of words in order; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    toks = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not toks:
        return np.empty(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(toks) - shingle + 1)
    line = b" ".join(toks)
    size = np.fromiter(map(len, toks), np.int64, len(toks))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:n].tolist()
    stop = end[min(shingle, len(toks)) - 1 :].tolist()
    return np.fromiter((digest(line[s:e], seed) for s, e in zip(start, stop)), np.uint64, n)


def folded(hashes: np.ndarray, words: int = 1) -> bytes:
    """SimHash of 64 * words bits of hashes, big-endian: a bit is set if more than half of the hashes set it; zero without any."""
    counts = np.zeros(64 * words, np.int64)
    for a in range(0, len(hashes), 32768):  # bounded memory for very long texts
        h = hashes[a : a + 32768]
        for k in range(words):
            bits = np.unpackbits(_mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            counts[64 * k : 64 * k + 64] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprint(text: str | None, shingle: int = 3, words: int = 1, seed: int = 42) -> bytes:
    """SimHash of the text's shingles, repeats included; a text without words (or null) gives zero."""
    return folded(shingle_hashes(text, shingle, seed), words)


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, words: int = 1, name: str = "fp") -> DataFrame:
    """docs with a binary fingerprint column; per-row work, no shuffle."""
    return appended(docs, text, f"{name} binary", lambda c: [pa.array([fingerprint(t, shingle, words) for t in c.to_pylist()], pa.binary())])


class Ring:
    """Segments, budgets and index keys for fingerprints of so many bits."""

    def __init__(self, bits: int, tau: int, segments: int):
        self.bits, self.tau, self.m, self.words = bits, tau, segments, bits // 64
        edge = [round(j * bits / segments) for j in range(segments + 1)]
        self.spans = list(zip(edge, edge[1:]))
        self.masks = np.zeros((segments, self.words), np.uint64)
        for j, (a, b) in enumerate(self.spans):
            for k in range(a, b):
                self.masks[j, k // 64] |= np.uint64(1 << (63 - k % 64))
        self.budget = [math.floor(n * tau / segments) for n in range(segments + 1)]
        exact = max(n for n in range(segments) if n * tau < segments)
        one = max(n for n in range(segments) if n * tau < 2 * segments)
        left = list(range(exact, one))  # of these one may differ
        keep = [[j for j in left if j != out] for out in left] if left else [[]]
        self.patterns = [(i, [(i + j) % segments for j in [*range(exact), *more]]) for i in range(segments) for more in keep]

    def keys(self, fps: np.ndarray) -> np.ndarray:
        """(n, patterns) of int64 keys."""
        segs = []
        bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
        for a, b in self.spans:
            segs.append(bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a, dtype=np.int64)[::-1]))
        out = np.empty((len(fps), len(self.patterns)), np.int64)
        for p, (_, chosen) in enumerate(self.patterns):
            k = np.zeros(len(fps), np.int64)
            for j in chosen:
                k = (k << (self.spans[j][1] - self.spans[j][0])) | segs[j]
            out[:, p] = k | (p << PATTERN_SHIFT)
        return out

    def linked(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which rows of x (differences of pairs) keep every chain from their start within budget, to the full distance."""
        alive, total = np.arange(len(x)), np.zeros(len(x), np.int64)
        for n in range(1, self.m + 1):
            mask = self.masks[(start[alive] + n - 1) % self.m]
            total = total + np.bitwise_count(x[alive] & mask).sum(axis=1, dtype=np.int64)
            ok = total <= self.budget[n]
            alive, total = alive[ok], total[ok]
        return alive

    def near(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Which of the given rows of x (differences of pairs) are within tau: those with a start whose chains keep within budget.

        Rows without such a start are dropped as soon as it is known; the last chain is the full Hamming distance.
        """
        alive = np.arange(len(x)) if rows is None else rows
        seg = np.stack([np.bitwise_count(x[alive] & m).sum(axis=1, dtype=np.int64) for m in self.masks], axis=1)
        total, going = np.zeros_like(seg), np.ones(seg.shape, bool)
        for n in range(1, self.m + 1):
            total += np.roll(seg, 1 - n, axis=1)
            going &= total <= self.budget[n]
            keep = going.any(axis=1)
            alive, seg, total, going = alive[keep], seg[keep], total[keep], going[keep]
        return alive


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest index in its component of links (i, j)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _tile_links(ring: Ring, run: np.ndarray, start: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, root) as row numbers, for rows in runs of equal key; runs are whole and in order."""
    n = len(run)
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    size = np.diff(np.r_[first, n])
    ii, jj = [], []
    small = np.repeat(size <= 64, size)
    for d in range(1, int(min(64, size.max())) if n else 0):
        i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:])) if n > d else np.empty(0, int)
        if len(i) == 0:
            break
        ok = ring.linked(fps[i] ^ fps[i + d], start[i])
        ii.append(i[ok])
        jj.append(i[ok] + d)
    for f, s in zip(first[size > 64], size[size > 64]):
        own = np.arange(f, f + s)
        lab = np.arange(s)
        step = max(1, 1_000_000 // s)
        for a in range(0, s, step):
            i, j = np.meshgrid(np.arange(a, min(s, a + step)), np.arange(s), indexing="ij")
            up = (i < j) & (lab[i] != lab[j])  # pairs already connected need no check
            i, j = i[up], j[up]
            ok = ring.linked(fps[f + i] ^ fps[f + j], np.full(len(i), start[f]))
            lab = _forest(s, np.r_[np.arange(s), i[ok]], np.r_[lab, j[ok]])
        ii.append(own)
        jj.append(f + lab)
    i, j = (np.concatenate(x) if x else np.empty(0, int) for x in (ii, jj))
    lab = _forest(n, i, j)
    moved = np.flatnonzero(lab != np.arange(n))
    return moved, lab[moved]


def _as_words(col: pa.Array) -> np.ndarray:
    """(n, words) of the fingerprints' 64-bit words."""
    return np.frombuffer(b"".join(col.to_pylist()), ">u8").astype(np.uint64).reshape(len(col), -1)


def links(classes: DataFrame, ring: Ring, fp: str = "fp", tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect exactly what pairs within ring.tau connect."""

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                col = whole.column(0).slice(at, 2000)
                keys = ring.keys(_as_words(col))
                ids = whole.column(1).slice(at, 2000).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])

    def to_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = np.array([i for i, _ in ring.patterns])
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.Table) -> pa.RecordBatch:
            run, pat = rows["run"].to_numpy(), rows["pattern"].to_numpy()
            col = rows["fp"].combine_chunks()
            node, root = _tile_links(ring, run, begin[pat], _as_words(col))
            return pa.RecordBatch.from_arrays([col.take(pa.array(node)), col.take(pa.array(root))], ["a", "b"])

        seen, last = 0, None
        for batch in batches:
            key, ti, tj = (batch.column(k).to_numpy() for k in ("key", "ti", "tj"))
            if not len(key):
                continue
            new = np.r_[(key[0], ti[0], tj[0]) != last, (key[1:] != key[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])]
            run, last = seen + np.cumsum(new), (key[-1], ti[-1], tj[-1])
            seen = int(run[-1])
            own = pa.RecordBatch.from_arrays([pa.array(run), batch.column("pattern"), batch.column("fp")], ["run", "pattern", "fp"])
            tail = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch; a tile's size bounds it
            if tail == 0 and not new[0]:
                held.append(own)
                continue
            if tail or held:
                yield solve(pa.Table.from_batches([*held, own.slice(0, tail)]))
            held = [own.slice(tail)]
        if held:
            yield solve(pa.Table.from_batches(held))

    # rows of the index hold a hash of the fingerprint; should two share it, both come back and are told apart by their bits
    prints = classes.select(F.col(fp).alias("fp"), F.xxhash64(fp).alias("id"))
    keyed = prints.mapInArrow(to_keys, "key long, id long")
    by_key = Window.partitionBy("key")
    met = (
        keyed.withColumns({"rn": F.row_number().over(by_key.orderBy("id")), "n": F.count("*").over(by_key)})
        .where("n > 1")
        .withColumns({"own": F.expr(f"int((rn - 1) div {tile})"), "all": F.expr(f"int((n - 1) div {tile})")})
        .withColumn("other", F.explode(F.expr("sequence(0, all)")))
        .join(prints, "id")
    )
    dealt = met.select(
        "key", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), F.shiftright("key", PATTERN_SHIFT).cast("int").alias("pattern"), "fp"
    )
    return dealt.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj").mapInArrow(to_links, "a binary, b binary").distinct()


def classes_with_component(docs: DataFrame, ring: Ring, rep: str = "rep", fp: str = "fp") -> DataFrame:
    """Rows (fp, rep): for each distinct fingerprint the smallest non-null rep of its component.  docs: (rep, fp)."""
    first = cut(docs.groupBy(fp).agg(F.min(rep).alias("own")))
    roots = components(links(first.select(fp), ring, fp))
    placed = first.join(roots, first[fp] == roots["node"], "left").select(
        fp, "own", "root", F.col("root").isNull().alias("alone")
    )
    best = placed.where("not alone").groupBy("root").agg(F.min("own").alias(rep))
    return placed.where("alone").select(fp, F.col("own").alias(rep)).unionByName(placed.where("not alone").join(best, "root").select(fp, rep))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, ring: Ring | None = None) -> DataFrame:
    """One row per document: doc_id, fp (binary), component_id.

    Documents link when their fingerprints differ in ring.tau bits or fewer (3 of 64 unless given).
    Null and empty texts have fingerprint zero and link like any other; repeated rows are in one component;
    component_id ignores null ids and is null where a component has no other; an empty table gives no rows.
    Only doc_id and text are read, so other columns can't clash.
    """
    ring = ring or Ring(64, 3, 7)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = cut(with_fingerprint(own, "text", shingle, ring.words).select("doc_id", "fp"))
    comp = classes_with_component(prints.select(F.col("doc_id").alias("component_id"), "fp"), ring, "component_id")
    return prints.join(comp, "fp").select("doc_id", "fp", "component_id")


#: The pipeline's stage: two documents link when their sets of distinct five-word shingles have a Jaccard similarity of 4/5 or
#: more, so i common of a and b shingles link when 9 * i >= 4 * (a + b).
#: Keys that at most SMALL classes share are paired one by one, others in blocks of BLOCK (DENSE: with more pairs a row than
#: that, a block's texts are compared together); a group of pairs has about MEMBERS.
SMALL, BLOCK, DENSE, MEMBERS, SEEN = 64, 512, 4, 256, 200_000
#: One text in SAMPLED tells which shingles are common: those that OFTEN or more of its texts hold.  It is a share and not a number of
#: texts, so a shingle of about OFTEN * SAMPLED texts is common in a table of any size, and pairs a key don't grow with the table.
#: Common shingles are kept by the low CELL_BITS of their hashes: a byte a cell (16 MB), however many there are.
SAMPLED, OFTEN, CELL_BITS = 4, 3, 24
#: A pair (x, y) of index rows that may link, by their sizes and by what is left behind the shared key in both.
_MAY_LINK = "5 * least({x}n, {y}n) >= 4 * greatest({x}n, {y}n) and 9 * least({x}n - {x}pos, {y}n - {y}pos) >= 4 * ({x}n + {y}n)"
#: At a Jaccard similarity of 4/5, fingerprints of 256 bits differ in 39 bits, with a deviation of 6: 76 are 6.5 deviations off.
#: The estimate holds for large sets; pairs with fewer than WIDE shingles go to the exact comparison at once.
STAGE_RING, WIDE = (256, 76, 16), 64


def _set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def _rare_first(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A set in the order of index keys: shingles that few hold first, then the common ones from rare to common."""
    return s[np.argsort(level[(s & np.uint64(len(level) - 1)).astype(np.int64)], kind="stable")]


def _common_shingles(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the shingles that a share of the texts holds often, and their levels (8 for each doubling of their texts).

    Only the order of index keys depends on them, so they change the work and never the result; a rare shingle in the
    cell of a common one only comes later in the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_set(value.as_py(), shingle).view(np.int64))], ["h"])

    some = docs.select(F.col(text).alias("t")).withColumn("k", F.xxhash64("t")).where(F.pmod("k", F.lit(SAMPLED)) == 0).dropDuplicates(["k"])
    counts = some.select("t").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("k")).where(f"k >= {OFTEN}")
    cell, level = F.expr(f"int(h & {2**CELL_BITS - 1})"), F.expr("smallint(least(floor(8 * log2(k)), 255))")
    top = counts.groupBy(cell.alias("cell")).agg(F.max(level).alias("level")).toArrow()
    return top["cell"].to_numpy(), top["level"].to_numpy().astype(np.uint8)


def shingle_classes(docs: DataFrame, rep: str, text: str, shingle: int = 5) -> DataFrame:
    """Rows (id, fp, n, sim, keys, own), one per distinct shingle set: a number and the set's digest, size, SimHash of 256
    bits, index keys, and the smallest rep of its documents.  To be stored before use, since the numbers follow the rows.

    The keys are the first n // 5 + 1 shingles in one order of all.  Sets of Jaccard similarity 4/5 have 4/5 of the greater
    in common, so they share a key (exact, nothing is lost).  A task gives the keys of a class once and null after that,
    so a hot group of copies stays narrow and is aggregated before the shuffle.
    """
    common, how = _common_shingles(docs, text, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        level = np.zeros(2**CELL_BITS, np.uint8)
        level[common] = how
        seen: set[bytes] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b, rows = whole.slice(at, 64), []
                for t in b.column(1).to_pylist():
                    s = _set(t, shingle)
                    n, fp = len(s), xxhash.xxh3_128_digest(s.tobytes())
                    keys = sim = None
                    if n and fp not in seen:
                        sim = folded(s, STAGE_RING[0] // 64)
                        keys = _rare_first(s, level)[: n // 5 + 1].view(np.int64)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(fp)
                    rows.append((fp, n, sim, keys))
                kinds = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["rep", "fp", "n", "sim", "keys"])

    own = docs.select(F.col(rep).alias("rep"), F.col(text).alias("text"))
    rows = own.mapInArrow(run, f"rep {own.schema['rep'].dataType.simpleString()}, fp binary, n int, sim binary, keys array<long>")
    classes = rows.groupBy("fp").agg(F.min("rep").alias("own"), F.max("n").alias("n"), F.max("sim").alias("sim"), F.max("keys").alias("keys"))
    return classes.withColumn("id", F.monotonically_increasing_id())


def _pruned(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of ids whose fingerprints pass the pigeonring chains and the full Hamming check, and small sets."""
    ring = Ring(*STAGE_RING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                ok = b.column(4).to_numpy() < WIDE
                big = np.flatnonzero(~ok)
                x, y = (_as_words(b.column(k).take(pa.array(big))) for k in (2, 3))
                ok[big[ring.near(x ^ y)]] = True
                yield b.select([0, 1]).filter(pa.array(ok))

    x, y = (classes.select(F.col("id").alias(side), F.col("sim").alias(f"s{side}"), F.col("n").alias(f"n{side}")) for side in "ab")
    met = pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb", F.least("na", "nb").alias("n"))
    return met.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, held: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) of fps: those of the pairs (a, b) of ids whose sets, of texts held (id, fp, text), have a Jaccard similarity of 4/5 or more.

    The pairs of one a are dealt into groups of about MEMBERS; a group has the text of a once and those of its partners.
    """
    many = pairs.groupBy("a").agg(F.count("*").alias("m"))
    dealt = pairs.join(many, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), m div {MEMBERS} + 1)").alias("part"))
    members = dealt.join(held, F.col("b") == F.col("id")).select("a", "part", F.lit(1).alias("turn"), "fp", "text")
    heads = dealt.select("a", "part").distinct().join(held, F.col("a") == F.col("id")).select("a", "part", F.lit(0).alias("turn"), "fp", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = first = None
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                got = []
                for turn, fp, text in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns[2:])):
                    s = _set(text, shingle)
                    if turn == 0:
                        head, first = fp, s
                        continue
                    both = np.sort(np.concatenate([first, s]), kind="stable")
                    if 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both):
                        got.append((head, fp))
                if got:
                    a, b = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    grouped = members.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", "turn")
    return grouped.mapInArrow(run, "a binary, b binary")


def _with_text(ids: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (id, fp, text) of the classes of ids: the text of the class's own document, found by its id and text hash."""
    want = classes.join(ids, "id").select("id", "fp", F.col("own.id").alias("__id"), F.col("own.h").alias("__h"))
    same = F.col("doc").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    return cut(texts.withColumnRenamed("id", "doc").join(want.hint("shuffle_hash"), same).select("id", "fp", "text").dropDuplicates(["fp"]))


def _block_pairs(rows: pa.Table, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a block, one in the first tile and one in the second, that may link: of different roots,
    by their sizes, and by pigeonring chains and the Hamming distance unless the smaller is small."""
    lab = np.unique(np.array(rows["root"].to_pylist(), object), return_inverse=True)[1]
    left, right = (np.flatnonzero(rows[k].to_numpy()) for k in ("first", "second"))
    n, pos, sim = rows["n"].to_numpy(), rows["pos"].to_numpy(), _as_words(rows["sim"].combine_chunks())
    i, j = (g.ravel() for g in np.meshgrid(left, right, indexing="ij"))
    once = i < j if np.array_equal(left, right) else True
    fit = once & (lab[i] != lab[j]) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))
    i, j = i[fit], j[fit]
    fit = 9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j])
    i, j = i[fit], j[fit]
    ok = np.minimum(n[i], n[j]) < WIDE
    big = np.flatnonzero(~ok)
    ok[big[ring.near(sim[i[big]] ^ sim[j[big]])]] = True
    return i[ok], j[ok]


def _block_links(rows: pa.Table, ring: Ring, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row numbers) of a block's rows with text; the common shingles of its pairs are a matrix product."""
    i, j = _block_pairs(rows, ring)
    if not len(i):
        return i, j
    used = np.unique(np.concatenate([i, j]))
    sets = [_set(t, shingle) for t in rows["text"].take(pa.array(used)).to_pylist()]
    size = np.array([len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    owner, column = owner[times[column] > 1], (np.cumsum(times > 1) - 1)[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter, width = np.zeros((len(used), len(used)), np.float32), 2048
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [low, low + width])
        held = np.zeros((len(used), width), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        inter += held @ held.T
    x, y = np.searchsorted(used, i), np.searchsorted(used, j)
    ok = 9 * inter[x, y].astype(np.int64) >= 4 * (size[x] + size[y])
    root = _forest(rows.num_rows, i[ok], j[ok])
    moved = np.flatnonzero(root != np.arange(rows.num_rows))
    return moved, root[moved]


def _by_block(rows: DataFrame, solve, schema: str) -> DataFrame:
    """solve(key, ti, tj, table) -> batch of schema, for each block of rows (key, ti, tj, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            run_of = [batch.column(k).to_numpy() for k in range(3)]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in run_of], axis=0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if (now := tuple(int(x[a]) for x in run_of)) != last and held:
                    yield solve(*last, pa.Table.from_batches(held))
                    held.clear()
                last = now
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(*last, pa.Table.from_batches(held))

    return rows.repartition("key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "id").mapInArrow(run, schema)


def _in_blocks(apart: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For classes that share a key of apart, dealt into blocks of two tiles of BLOCK: pairs (a, b) of ids that may link, and
    the rows of dense blocks, which have so many of these that their texts are compared block by block."""
    ring = Ring(*STAGE_RING)

    def solve(key: int, ti: int, tj: int, rows: pa.Table) -> pa.RecordBatch:
        i, j = _block_pairs(rows, ring)
        ids = rows["id"].to_numpy()
        a, b = (pa.array(ids[k]) for k in (i, j)) if len(i) <= DENSE * rows.num_rows else (pa.nulls(1, pa.int64()),) * 2
        return pa.RecordBatch.from_arrays([a, b, *(pa.array([v] * len(a), k) for v, k in ((key, pa.int64()), (ti, pa.int32()), (tj, pa.int32())))], ["a", "b", "key", "ti", "tj"])

    by_key = Window.partitionBy("key").orderBy("n", "id")
    dealt = (
        apart.withColumn("own", F.floor((F.row_number().over(by_key) - 1) / BLOCK).cast("int"))
        .withColumn("other", F.explode(F.expr(f"sequence(0, int((m - 1) div {BLOCK}))")))
        .withColumns({"ti": F.least("own", "other"), "tj": F.greatest("own", "other")})
        .join(classes.select("id", "sim"), "id")
        .select("key", "ti", "tj", (F.col("own") == F.col("ti")).cast("int").alias("first"), (F.col("own") == F.col("tj")).cast("int").alias("second"), "id", "fp", "root", "n", "pos", "sim")
    )
    got = cut(_by_block(dealt, solve, "a long, b long, key long, ti int, tj int"))
    dense = got.where("a is null").select("key", "ti", "tj")
    pairs = got.where("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs, dealt.join(dense, ["key", "ti", "tj"])


def _dense_links(dense: DataFrame, held: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) of fps within dense blocks."""
    ring = Ring(*STAGE_RING)

    def solve(key: int, ti: int, tj: int, rows: pa.Table) -> pa.RecordBatch:
        node, root = _block_links(rows, ring, shingle)
        fps = rows["fp"].combine_chunks()
        return pa.RecordBatch.from_arrays([fps.take(pa.array(node)), fps.take(pa.array(root))], ["a", "b"])

    return _by_block(dense.join(held.select("id", "text"), "id").select("key", "ti", "tj", *[c for c in dense.columns if c not in ("key", "ti", "tj")], "text"), solve, "a binary, b binary").distinct()


def jaccard_links(classes: DataFrame, texts: DataFrame, shingle: int = 5) -> DataFrame:
    """Links (a, b) of fps that connect exactly what pairs of sets with a Jaccard similarity of 4/5 or more connect.

    First the classes of a key are paired with its smallest; groups of near copies hang together by that.  Where it leaves
    classes of a key in different components, all their pairs are compared, in blocks if they are many.
    """
    index = classes.where("keys is not null").select("id", F.expr("posexplode(keys)").alias("pos", "key"), "n")
    shared = index.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")  # the widest shuffles carry no more than they must
    index = index.select("key", "id", F.expr("shiftleft(bigint(n), 32) + pos").alias("at"))
    met = index.join(shared.hint("shuffle_hash"), "key").select("key", "id", F.expr("int(shiftright(at, 32))").alias("n"), F.expr("int(at & 4294967295)").alias("pos"), "m")
    met = cut(met)
    star = met.join(met.groupBy("key").agg(F.min(F.struct("id", "n", "pos")).alias("c")), "key")
    star = star.where("c.id < id and " + _MAY_LINK.format(x="c.", y="")).select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()
    star = cut(_pruned(star, classes))
    linked = cut(_verified(star, _with_text(_ends(star), classes, texts), shingle))
    roots = components(linked)
    linked = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))  # connects the same, and settles at once
    named = classes.select("id", "fp").join(roots, F.col("fp") == F.col("node"), "left").select("id", "fp", F.coalesce("root", "fp").alias("root"))
    named = met.join(named, "id").select("key", "pos", "id", "n", "m", "fp", "root")
    apart = named.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    apart = cut(named.join(apart.hint("shuffle_hash"), "key"))
    few, many = apart.where(f"m <= {SMALL}"), apart.where(f"m > {SMALL}")
    pairs = few.alias("x").join(few.alias("y"), "key").where("x.id < y.id and x.root <> y.root and " + _MAY_LINK.format(x="x.", y="y."))
    pairs = _pruned(pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), classes)
    if many.isEmpty():
        pairs = cut(pairs)
        return linked.union(_verified(pairs, _with_text(_ends(pairs), classes, texts), shingle))
    more, dense = _in_blocks(many, classes)
    pairs = cut(pairs.union(more).distinct())
    held = _with_text(_ends(pairs).union(dense.select("id")).distinct(), classes, texts)
    return linked.union(cut(_verified(pairs, held, shingle).union(_dense_links(dense, held, shingle))))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays (null ids last, then by text hash).

    Two documents are near copies at a Jaccard similarity of 0.8 or more of their sets of five-word shingles.  Candidates
    share an index key, which loses none; pigeonring chains over their SimHash fingerprints and the full Hamming distance
    prune those far below 0.8; what is left is compared exactly (by 64-bit hashes of the shingles).  Texts without words
    are copies of each other.  Repeated rows (same id and text) leave one.  Columns are kept as they are.
    """
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    rep = F.struct(F.col("id").isNull().alias("x"), "id", "h").alias("rep")
    classes = cut(shingle_classes(texts.select(rep, "text"), "rep", "text", shingle))
    roots = components(jaccard_links(classes, texts, shingle))
    placed = classes.select("fp", "own").join(roots, F.col("fp") == F.col("node"), "left")
    best = placed.where("root is null").select("own").unionByName(placed.where("root is not null").groupBy("root").agg(F.min("own").alias("own")).select("own"))
    again = texts.select(rep).groupBy("rep").agg(F.count("*").alias("__n"))
    best = best.join(again, F.col("own") == F.col("rep")).select(F.col("own.id").alias("__id"), F.col("own.h").alias("__h"), "__n")
    keyed = docs.withColumn("__key", F.xxhash64(text))
    same = keyed[doc_id].eqNullSafe(best["__id"]) & (keyed["__key"] == best["__h"])
    kept = keyed.join(best.hint("shuffle_hash"), same)
    once = kept.where("__n = 1").select(*docs.columns)
    again = kept.where("__n > 1").dropDuplicates([doc_id, "__key"]).select(*docs.columns)  # repeated rows only
    return once.unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: doc_id, fingerprint, component_id of every document."""
    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
