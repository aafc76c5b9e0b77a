"""Embedding near-duplicates with a hierarchical navigable small-world graph per shard.

Equal vectors are one class.  Classes are dealt to shards by hash; each shard builds its graph, and every pair of shards
is compared once, one side's vectors querying the other's graph (a shard's own vectors query it too).  A recall audit
against brute force on a stated set of the shard's vectors widens the beam until it passes; a shard that fails it with
the widest beam is scanned exactly in blocks.  A query whose beam is full of links is asked again with a wider one, and
beyond the widest beam the shard is scanned for it, so large groups lose nothing.  What a graph finds is verified by cosine in double precision; components unite the links.

Scale: a shard holds at most SHARD vectors, so a graph's memory is bounded; the query side streams through in batches;
a query leaves a count and one link per component of the shard that it touches, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import components, cut, table
from lexiforge.llm.simhash import _forest

#: Vectors in a shard at most, on average; shards at least, so that small inputs use all executors.
SHARD, LEAST_SHARDS = 65_536, 6
LINK, DEGREE, BUILD_BEAM, FIRST_BEAM, WIDEST, AUDITED, RECALL, AT_ONCE = 0.9, 12, 48, 32, 256, 128, 0.99, 512


class Graph:
    """Layers of neighbour lists over unit vectors x; nodes of high levels are inserted first, in growing batches."""

    def __init__(self, x: np.ndarray, seed: int = 42, degree: int = DEGREE, beam: int = BUILD_BEAM):
        n = len(x)
        self.x, self.degree = np.ascontiguousarray(x, np.float32), degree
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(degree)).astype(int), 6)
        order = np.argsort(-level, kind="stable")
        self.top = int(level[order[0]]) if n else 0
        self.layers = [np.full((n, degree * (2 if k == 0 else 1)), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(order[0]) if n else -1
        at = 1
        while at < n:
            batch = order[at : at + min(AT_ONCE, at)]
            self._insert(batch, level[batch], beam)
            at += len(batch)

    def _insert(self, batch: np.ndarray, level: np.ndarray, beam: int) -> None:
        q = self.x[batch]
        found = np.full((len(batch), 1), self.entry)
        near = q @ q.T
        for k in range(self.top, -1, -1):
            joins = np.flatnonzero(level >= k)
            found, _ = self._beam(q, found, beam if len(joins) else 4, k)
            if not len(joins):
                continue
            cand = found[joins]
            if len(joins) > 1:  # the batch's own members, which no list has yet
                s = near[np.ix_(joins, joins)].copy()
                np.fill_diagonal(s, -np.inf)
                m = min(self.degree, len(joins) - 1)
                cand = np.hstack([cand, batch[joins][np.argpartition(-s, m - 1, axis=1)[:, :m]]])
            kept = self._pruned(batch[joins], cand, self.layers[k].shape[1])
            self.layers[k][batch[joins]] = kept
            own, other = np.repeat(batch[joins], kept.shape[1]), kept.ravel()
            own, other = own[other >= 0], other[other >= 0]
            order = np.argsort(other, kind="stable")
            own, other = own[order], other[order]
            nodes, first, count = np.unique(other, return_index=True, return_counts=True)
            width = min(int(count.max()), 4 * self.degree) if len(count) else 0
            rank = np.arange(len(other)) - np.repeat(first, count)
            more = np.full((len(nodes), width), -1, np.int64)
            ok = rank < width
            more[np.repeat(np.arange(len(nodes)), count)[ok], rank[ok]] = own[ok]
            for a in range(0, len(nodes), 1024):
                part = nodes[a : a + 1024]
                self.layers[k][part] = self._pruned(part, np.hstack([self.layers[k][part], more[a : a + 1024]]), self.layers[k].shape[1])

    def _pruned(self, base: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """Diverse neighbours: a candidate nearer to base than to those kept, then the nearest of the rest."""
        cand = np.sort(cand, axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        cand[cand == base[:, None]] = -1
        sim = np.einsum("acd,ad->ac", self.x[cand], self.x[base])
        sim[cand < 0] = -np.inf
        wide = min(cand.shape[1], 2 * most)
        pick = np.argsort(-sim, axis=1, kind="stable")[:, :wide]
        cand, sim = np.take_along_axis(cand, pick, 1), np.take_along_axis(sim, pick, 1)
        v = self.x[cand]
        cross = v @ v.transpose(0, 2, 1)
        nearest = np.full(cand.shape, -np.inf, np.float32)
        kept = np.zeros(cand.shape, bool)
        for j in range(wide):
            ok = (cand[:, j] >= 0) & (sim[:, j] > nearest[:, j])
            kept[ok, j] = True
            nearest[ok] = np.maximum(nearest[ok], cross[ok, j])
        key = np.where(cand < 0, 2, np.where(kept, 0, 1)) * wide + np.arange(wide)
        cand = np.take_along_axis(cand, np.argsort(key, axis=1), 1)[:, :most]
        return np.hstack([cand, np.full((len(cand), most - cand.shape[1]), -1, cand.dtype)])

    def _beam(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of each query's ef best nodes found from its entries, -1 where there are fewer."""
        lists, rows = self.layers[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(self.x) + 1), bool)  # the last column stands for "no node"
        seen[:, -1] = True
        ids = np.full((len(q), ef), -1, np.int64)
        sim = np.full((len(q), ef), -np.inf, np.float32)
        m = min(ef, entry.shape[1])
        s = np.einsum("qed,qd->qe", self.x[entry], q)
        s[entry < 0] = -np.inf
        best = np.argsort(-s, axis=1)[:, :m]
        ids[:, :m], sim[:, :m] = np.take_along_axis(entry, best, 1), np.take_along_axis(s, best, 1)
        seen[rows[:, None], ids] = True
        fresh = ids >= 0
        live = rows
        while len(live):
            open_sim = np.where(fresh[live], sim[live], -np.inf)
            w = min(step, ef)
            pick = np.argpartition(-open_sim, w - 1, axis=1)[:, :w]
            chosen = np.where(np.take_along_axis(open_sim, pick, 1) > -np.inf, np.take_along_axis(ids[live], pick, 1), -1)
            going = (chosen >= 0).any(axis=1)
            live, chosen, pick = live[going], chosen[going], pick[going]
            if not len(live):
                break
            fresh[live[:, None], pick] = False
            nb = np.where(chosen[:, :, None] >= 0, lists[chosen], -1).reshape(len(live), -1)
            nb = np.sort(nb, axis=1)
            nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
            nb[seen[live[:, None], nb]] = -1
            seen[live[:, None], nb] = True
            s = np.einsum("amd,ad->am", self.x[nb], q[live])
            s[nb < 0] = -np.inf
            all_ids, all_sim = np.hstack([ids[live], nb]), np.hstack([sim[live], s])
            all_new = np.hstack([fresh[live], nb >= 0])
            top = np.argpartition(-all_sim, ef - 1, axis=1)[:, :ef]
            ids[live], sim[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sim, top, 1)
            fresh[live] = np.take_along_axis(all_new, top, 1)
        return ids, sim

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        found = np.full((len(q), 1), self.entry)
        for k in range(self.top, 0, -1):
            found, _ = self._beam(q, found, 4, k)
        return self._beam(q, found, ef, 0)


class Shard:
    """A graph with its audited beam; unit vectors in double precision verify what it finds."""

    def __init__(self, vectors: np.ndarray, link: float = LINK):
        self.unit, self.link = vectors, link
        self.graph = Graph(vectors)
        self.beam, self.recall = self._audit()

    def _audit(self) -> tuple[int, float]:
        """The first beam whose recall passes, and that recall; beyond the widest beam 0 stands for exact scans.

        Evenly spaced vectors are asked, and probes that just link to them, against brute force.  Three recalls must pass,
        each averaged over its queries: the vectors' links but themselves, the probes' own vectors, and the probes' other links.
        """
        n, d = self.unit.shape
        some = np.unique(np.linspace(0, n - 1, min(n, AUDITED)).astype(int))
        own = self.unit[some]
        away = np.random.default_rng(7).normal(size=own.shape)
        away -= (away * own).sum(axis=1, keepdims=True) * own
        size = np.sqrt((away * away).sum(axis=1, keepdims=True))
        cos = min(1.0, self.link + 1e-3)
        probes = np.where(size > 1e-9, cos * own + math.sqrt(1 - cos * cos) * away / np.maximum(size, 1e-9), own)
        asked, k, rows = np.vstack([own, probes]), len(some), np.arange(len(some))
        true = asked @ self.unit.T >= self.link
        base = np.zeros_like(true)
        base[rows, some] = base[k + rows, some] = True
        groups = [(true & ~base)[:k], (true & base)[k:], (true & ~base)[k:]]
        beam = FIRST_BEAM
        while beam <= WIDEST:
            i, j, _ = self._found(asked.astype(np.float32), beam, np.full(len(asked), self.link - 1e-5, np.float32))
            hit = np.zeros_like(true)
            hit[i, j] = True
            parts = [(g, (g & h).sum(axis=1), g.sum(axis=1)) for g, h in zip(groups, (hit[:k], hit[k:], hit[k:]))]
            recall = min((float((got[of > 0] / of[of > 0]).mean()) for _, got, of in parts if (of > 0).any()), default=1.0)
            if recall >= RECALL:
                return beam, recall
            beam *= 2
        return 0, 1.0

    def _found(self, q: np.ndarray, beam: int, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, similarity) at or above each query's bar; beams full of such are widened, then the shard is scanned (beam 0: at once)."""
        out, todo = [], np.arange(len(q))
        while len(todo) and 0 < beam <= WIDEST and beam < len(self.unit):
            parts = []
            for a in range(0, len(todo), AT_ONCE):
                ids, sim = self.graph.search(q[todo[a : a + AT_ONCE]], beam)
                parts.append((ids, sim))
            ids, sim = (np.concatenate(p) for p in zip(*parts))
            good = (ids >= 0) & (sim >= bar[todo, None])
            full = good.all(axis=1)
            i, c = np.nonzero(good & ~full[:, None])
            out.append((todo[i], ids[i, c], sim[i, c]))
            todo, beam = todo[full], beam * 4
        for a in range(0, len(todo), 256):
            own = todo[a : a + 256]
            s = q[own] @ self.graph.x.T
            i, j = np.nonzero(s >= bar[own, None])
            out.append((own[i], j, s[i, j]))
        return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.empty(0, int),) * 3

    def links(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) with a cosine of at least link, near the bar by doubles."""
        i, j, s = self._found(unit.astype(np.float32), self.beam, np.full(len(unit), self.link - 1e-5, np.float32))
        i, j = i.astype(int), j.astype(int)
        near = np.abs(s - self.link) < 1e-4
        ok = s >= self.link
        ok[near] = np.einsum("pd,pd->p", unit[i[near]], self.unit[j[near]]) >= self.link
        return i[ok], j[ok]


def _unit(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)  # tiny and huge components square safely
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def class_links(classes: DataFrame, shards: int, link: float = LINK) -> DataFrame:
    """classes (node, vec, w) -> rows (a, b, n): b null: a has n linked vectors more; else a and b are linked, perhaps over others.

    Shard t is queried by shards t - 1, ..., t - shards / 2 on a ring, so each pair of shards meets once.
    """
    half = shards // 2

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda k: pa.nulls(k, pa.string())
        names = ["a", "b", "n"]
        place, held, shard, node, w, got, lab = None, [], None, None, None, None, None

        def build() -> pa.RecordBatch:
            nonlocal shard, node, w, got, lab, held
            rows = pa.Table.from_batches(held)
            held = []
            unit = _unit(rows["vec"].combine_chunks())
            shard, node, w = Shard(unit, link), rows["node"].combine_chunks(), rows["w"].to_numpy()
            i, j = shard.links(unit)
            key = np.unique(np.minimum(i, j) * len(unit) + np.maximum(i, j))  # either side may have found it
            i, j = key // len(unit), key % len(unit)
            i, j = i[i != j], j[i != j]
            got = np.bincount(i, w[j], len(unit)) + np.bincount(j, w[i], len(unit))
            lab = _forest(len(unit), i, j)
            moved = np.flatnonzero(lab != np.arange(len(unit)))
            return pa.RecordBatch.from_arrays([node.take(pa.array(moved)), node.take(pa.array(lab[moved])), pa.array(np.zeros(len(moved), np.int64))], names)

        def counts() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([node, none(len(node)), pa.array(got.astype(np.int64))], names)

        def ask(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            unit, own = _unit(rows.column("vec")), rows.column("w").to_numpy()
            i, j = shard.links(unit)
            yield pa.RecordBatch.from_arrays([rows.column("node"), none(len(unit)), pa.array(np.bincount(i, w[j], len(unit)).astype(np.int64))], names)
            np.add.at(got, j, own[i])
            pair = np.unique(i * len(node) + lab[j])
            a, b = pair // len(node), pair % len(node)
            yield pa.RecordBatch.from_arrays([rows.column("node").take(pa.array(a)), node.take(pa.array(b)), pa.array(np.zeros(len(a), np.int64))], names)

        for b in batches:
            here = b.column("place").to_numpy()
            asks = b.column("asks").to_numpy(zero_copy_only=False).astype(int)
            cuts = np.flatnonzero(np.r_[True, (here[1:] != here[:-1]) | (asks[1:] != asks[:-1])]) if len(here) else []
            for a, z in zip(cuts, [*cuts[1:], len(here)]):
                rows = b.slice(a, z - a)
                if here[a] != place:
                    if held:
                        yield build()
                    if node is not None:
                        yield counts()
                    place, shard, node = here[a], None, None
                if asks[a] == 0:
                    held.append(rows)
                    continue
                if held:
                    yield build()
                if node is not None:
                    for at in range(0, rows.num_rows, AT_ONCE):
                        yield from ask(rows.slice(at, AT_ONCE))
        if held:
            yield build()
        if node is not None:
            yield counts()

    own = F.pmod(F.xxhash64(F.lit("shard"), "node"), F.lit(shards)).cast("int")
    reach = F.sequence(F.lit(0), F.lit(half))
    if shards % 2 == 0:  # opposite shards on the ring meet once
        reach = F.when(F.col("own") < half, reach).otherwise(F.sequence(F.lit(0), F.lit(half - 1)))
    dealt = (
        classes.withColumn("own", own).withColumn("asks", F.explode(reach))
        .withColumn("place", F.size("vec").cast("long") * shards + F.expr(f"(own + asks) % {shards}"))
        .withColumn("asks", F.col("asks") > 0).select("place", "asks", "node", "vec", "w")
    )
    ordered = dealt.repartitionByRange(shards, "place").sortWithinPartitions("place", "asks", "node")
    return ordered.mapInArrow(out, "a string, b string, n long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", link: float = LINK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths don't link; equal vectors do.  Ids may be null (the smallest other is the component's) or repeat (each row
    counts as a vector); an empty table gives no rows; other columns are ignored.
    """
    own = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    key = F.concat(F.hex(F.xxhash64("vec")), F.lit("."), F.hex(F.xxhash64(F.lit("again"), "vec")))
    own = own.withColumn("node", F.when(F.coalesce(sound, F.lit(False)), key))
    classes = cut(own.where("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("w"), F.min("vec_id").alias("least")))
    shards = max(LEAST_SHARDS, -(-classes.count() // SHARD))
    found = cut(class_links(classes.select("node", "vec", "w"), shards, link))
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null").select("a", "b"))
    told = (
        classes.select("node", "w", "least").join(counts, F.col("node") == F.col("a"), "left").drop("a")
        .join(roots.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").drop("r")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(least, "root").select(F.col("node").alias("told"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    done = own.select("vec_id", "node").join(told, F.col("node") == F.col("told"), "left")
    component = F.when(F.col("told").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: links, component and whether it is kept, of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
