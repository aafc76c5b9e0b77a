"""Each word's probability in the very texts that a word model of order 3 is counted from: `ngrams` without its tables of grams.

Nearly every three words of a corpus are new, so tables of grams, and joins of them with their places, are many times the texts.
Here a word is a number: its rank if it is frequent, else its hash, of which is checked that no two words share one.  Texts are packed
into pieces.  A piece sends each of its distinct grams once to the cell of the gram's middle word, which holds all that two-word and
three-word counts need; cells ask for the counts of single words; and a piece gets its grams' values back in the order it sent them.
What is sent are compressed columns, a row for each piece and cell.

Scale: a piece has a bounded number of words (or one text), a cell too: a frequent word has a cell of its own, which goes through its
grams in shares by their first word and keeps only the word's distinct followers.  Frequent words (FREQUENT) go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.ngrams import discounts_of
from lexiforge.operators.pieces import PIECE, packed, pieces, repeated, unpacked, words_of
from lexiforge.operators.stored import saved

#: Words numbered by rank; words of a cell; a word is given a cell of its own from this many on; bits of a hash.
FREQUENT, CELL, HEAVY, BITS = 65536, 1_000_000, 500_000, 62
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SENT = "cell int, share int, piece long, size int, data binary"


def _numbers(words: pa.Array, seed: int, bits: int, frequent: pa.Array | None = None) -> np.ndarray:
    """int64 numbers of different words: from 1 the rank of the frequent, of others a hash beyond all ranks."""
    hashes = pd.util.hash_array(np.asarray(words.to_pandas(), dtype=object), hash_key=f"{seed:016d}", categorize=False) >> np.uint64(64 - bits)
    of = hashes.astype(np.int64) + (1 << bits)
    if frequent is not None:
        rank = pc.fill_null(pc.index_in(words, frequent), -1).to_numpy(zero_copy_only=False)
        of = np.where(rank < 0, of, rank + 1)
    return of


def _spread(numbers: np.ndarray, n) -> np.ndarray:
    """Numbers dealt to 0 .. n - 1."""
    return (((numbers.view(np.uint64) * _MIX) >> np.uint64(20)) % np.asarray(n, np.uint64)).astype(np.int64)


def _distinct(first: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair of small numbers occurs first, in the order of pairs, and each row's place among them."""
    _, at, of = np.unique(first * (int(then.max(initial=0)) + 1) + then, return_index=True, return_inverse=True)
    return at, of


class _Piece:
    """The distinct grams (a, b, c, n) of a piece's words, in the order of their cells and shares; of: each word's gram; heads: where cells and shares begin."""

    def __init__(self, numbers: np.ndarray, own: np.ndarray, sizes: np.ndarray, cells: int, shares: np.ndarray):
        place = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # a word's place in its text
        sort = np.argsort(numbers)
        known, rank = np.append(0, numbers[sort]), np.empty(len(numbers), np.int64)  # 0: the empty word before a text
        rank[sort] = np.arange(1, len(numbers) + 1)
        own = rank[own]
        back = lambda k: np.where(place >= k, np.roll(own, k), 0)
        a, b = back(2), back(1)
        at, of = _distinct(_distinct(b, a)[1], own)
        cell, share = _cell(known[b[at]], known[a[at]], cells, shares)
        order = np.lexsort((share, cell))
        self.cell, self.share = cell[order], share[order]
        self.n = np.bincount(of, minlength=len(at))[order]
        self.a, self.b, self.c = (known[x[at[order]]] for x in (a, b, own))
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        self.of = rank[of]
        self.heads = np.flatnonzero(np.diff(self.cell, prepend=-1) | np.diff(self.share, prepend=-1))

    def parts(self) -> Iterator[slice]:
        return (slice(i, j) for i, j in zip(self.heads, np.append(self.heads[1:], len(self.n))))


def _cell(b: np.ndarray, a: np.ndarray, cells: int, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A gram's cell, by its middle word, and its share of the cell, by its first word; shares: how many the words with cells of their own have."""
    own = (b > 0) & (b <= len(shares))
    n = np.append(shares, 1)[np.where(own, b - 1, len(shares))]
    return np.where(own, cells + b - 1, _spread(b, cells)), _spread(a, n)


class _Cell:
    """Counts of a cell's rows (share, piece, size, data)."""

    def __init__(self, rows: pa.Table):
        order = np.lexsort((rows["piece"].to_numpy(), rows["share"].to_numpy()))
        self.rows = rows.take(pa.array(order))
        share = self.rows["share"].to_numpy()
        self.heads = np.flatnonzero(np.diff(share, prepend=-1)) if len(share) else np.zeros(0, int)
        self.seen, parts = np.zeros(5, np.int64), []
        for grams in self.shares():
            self.seen += _histogram(grams["n"])
            of_two = grams["two"][grams["first"]]  # of distinct grams
            parts.append((grams["b"][grams["at_two"]], grams["c"][grams["at_two"]], np.bincount(of_two, minlength=len(grams["at_two"]))))
        b, c, n = (np.concatenate(x) for x in zip(*parts))
        self.words, own = np.unique(c, return_inverse=True)
        self.befores, first = np.unique(b, return_inverse=True)
        at, of = _distinct(first, own)
        self.first, self.last = first[at], own[at]  # of distinct pairs of words, in order
        self.n = np.bincount(of, weights=n).astype(np.int64)

    def shares(self) -> Iterator[dict]:
        """Of each share its rows (from, sizes), grams as sent (b, c) and three, each one's place among the distinct ones, whose counts are n."""
        ends = np.append(self.heads[1:], self.rows.num_rows)
        for i, j in zip(self.heads, ends):
            rows = self.rows.slice(i, j - i)
            sizes = rows["size"].to_numpy()
            a, b, c, n = (np.concatenate(x) for x in zip(*(unpacked(d.as_buffer(), s, 4) for d, s in zip(rows["data"], sizes))))
            first, mid, last = (np.unique(x, return_inverse=True)[1] for x in (a, b, c))
            at_two, two = _distinct(mid, last)
            at, three = _distinct(first, two)
            context_at, context = _distinct(first, mid)
            yield {"pieces": rows["piece"].to_numpy(), "sizes": sizes, "b": b, "c": c, "at_two": at_two, "two": two, "first": at, "three": three,
                   "n": np.bincount(three, weights=n).astype(np.int64), "context": context, "context_at": context_at}

    def pair_places(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of pairs of words their places among the cell's distinct ones."""
        wide = len(self.words) + 1
        return np.searchsorted(self.first * wide + self.last, np.searchsorted(self.befores, b) * wide + np.searchsorted(self.words, c))


def _histogram(n: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4 and anything."""
    return np.append(np.bincount(np.minimum(n, 5), minlength=6)[1:5], len(n))


def _levels(n: np.ndarray, of: np.ndarray, size: int, taken: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Discounted shares of grams with counts n in their contexts (of, size of them), and what each context leaves for the lower order."""
    off = np.asarray(taken)[np.minimum(n, 3) - 1]
    total = np.bincount(of, weights=n, minlength=size)
    return (n - off) / total[of], np.bincount(of, weights=off, minlength=size) / total


def _highest(values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size)
    np.maximum.at(out, of, values)
    return out




def scored(rows: DataFrame, key: str, words: Column, frequent: int = FREQUENT, piece: int = PIECE, cell: int = CELL, heavy: int = HEAVY, bits: int = BITS) -> DataFrame:
    """(key, nll, top) of the texts (arrays of words) in rows that have two words at least, under the model of order 3 of all rows.

    nll and top are array<double> without the first word, as `ngrams.scored` gives them: each word's negative log
    probability after the two words before it, and the best word's probability there.  Rows with an equal key have one list.
    """
    key_type = rows.schema[key].dataType.simpleString()
    made = pieces(rows, F.col(key), words, piece)
    for seed in range(100):
        known = saved(_vocabulary(made, seed, bits))
        if known.groupBy("number").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("hashes of words collide")
    total, n_words = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = known.orderBy(F.desc("n"), "word").limit(frequent).select("word", "n").collect()
    ranked = pa.array([r.word for r in most], pa.string())
    shares = np.array([r.n // cell + 1 for r in most if r.n >= heavy], np.int64)
    cells, lows = max(16, total // cell), max(4, n_words // cell)

    read = _reader(seed, bits, ranked, cells, shares)
    sent = made.select("piece", "sizes", "words", "data").mapInArrow(_sent(read), _SENT)
    asked = saved(sent.groupBy("cell").applyInArrow(_asked(lows), "low int, cell int, size int, data binary, seen2 array<long>, seen3 array<long>"))
    told = saved(asked.where("low >= 0").select("low", "cell", "size", "data").groupBy("low").applyInArrow(_told, "cell int, low int, size int, data binary, seen array<long>, total long, most long"))

    counted = lambda df, c: tuple(df.agg(*[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for i in range(5)]).first())
    ones, twos, threes = counted(told, "seen"), counted(asked, "seen2"), counted(asked, "seen3")
    taken = [discounts_of(x) for x in (ones, twos, threes)]
    ends = told.agg(F.sum("total"), F.max("most")).first()
    model = _Ones(taken[0], ones, *(int(x or 0) for x in ends))

    values = sent.groupBy("cell").cogroup(told.where("cell >= 0").select("cell", "low", "size", "data").groupBy("cell")).applyInArrow(_valued(model, taken, lows), "piece long, cell int, share int, size int, data binary")
    done = values.groupBy("piece").cogroup(made.groupBy("piece")).applyInArrow(_lists(read), f"key {key_type}, nll array<double>, top array<double>")
    if repeated(made):
        done = done.groupBy("key").agg(F.flatten(F.collect_list("nll")).alias("nll"), F.flatten(F.collect_list("top")).alias("top"))
    return done.withColumnRenamed("key", key)


class _Ones:
    """Probabilities of single words by how many words they follow."""

    def __init__(self, taken: tuple, seen: tuple, total: int, most: int):
        self.taken, self.total = np.asarray(taken), max(total, 1)
        lost = seen[0] * taken[0] + seen[1] * taken[1] + (seen[4] - seen[0] - seen[1]) * taken[2]
        self.unknown = lost / self.total / (seen[4] + 1)
        here = [n for n in (1, 2, most) if n and (n > 2 or seen[n - 1])]
        self.best = max([self.unknown, *self.of(np.array(here, np.int64))])

    def of(self, n: np.ndarray) -> np.ndarray:
        return (n - self.taken[np.minimum(n, 3) - 1]) / self.total + self.unknown


def _vocabulary(made: DataFrame, seed: int, bits: int) -> DataFrame:
    """(word, number, n) of all words."""

    def counted(batches):
        for batch in batches:
            for words, sizes, data in zip(*batch.columns):
                own = words.values
                n = np.bincount(words_of(sizes, data)[1], minlength=len(own))
                yield pa.RecordBatch.from_arrays([own, pa.array(_numbers(own, seed, bits)), pa.array(n)], ["word", "number", "n"])

    each = made.select("words", "sizes", "data").mapInArrow(counted, "word string, number long, n long")
    return each.groupBy("word", "number").agg(F.sum("n").alias("n"))


def _reader(seed: int, bits: int, frequent: pa.Array, cells: int, shares: np.ndarray):
    def read(words: pa.ListScalar, sizes: pa.ListScalar, data: pa.Scalar) -> tuple[_Piece, np.ndarray]:
        sizes, own = words_of(sizes, data)
        return _Piece(_numbers(words.values, seed, bits, frequent), own, sizes, cells, shares), sizes

    return read


def _sent(read):
    def sent(batches):
        for batch in batches:
            for piece, sizes, words, data in zip(*batch.columns):
                own, _ = read(words, sizes, data)
                parts = list(own.parts())
                at = [p.start for p in parts]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own.cell[at], pa.int32()), pa.array(own.share[at], pa.int32()), pa.array([piece.as_py()] * len(at), pa.int64()), pa.array([p.stop - p.start for p in parts], pa.int32()),
                    pa.array([packed(own.a[p], own.b[p], own.c[p], own.n[p]) for p in parts], pa.binary()),
                ], ["cell", "share", "piece", "size", "data"])

    return sent


def _table(columns: dict, schema: list) -> pa.Table:
    return pa.table({name: pa.array(columns[name], kind) for name, kind in schema})


_LONGS = pa.list_(pa.int64())


def _asked(lows: int):
    def asked(rows: pa.Table) -> pa.Table:
        """How often two and three words occur, and for how many pairs in a cell its words are the last."""
        cell = _Cell(rows)
        n = np.bincount(cell.last)
        low = _spread(cell.words, lows)
        to = np.unique(low)
        picked = [low == k for k in to]
        columns = {"low": [-1, *to], "size": [0, *(int(x.sum()) for x in picked)], "data": [None, *(packed(cell.words[x], n[x]) for x in picked)],
                   "cell": [rows["cell"][0].as_py()] * (len(to) + 1), "seen2": [_histogram(cell.n), *[None] * len(to)], "seen3": [cell.seen, *[None] * len(to)]}
        return _table(columns, [("low", pa.int32()), ("cell", pa.int32()), ("size", pa.int32()), ("data", pa.binary()), ("seen2", _LONGS), ("seen3", _LONGS)])

    return asked


def _told(rows: pa.Table) -> pa.Table:
    """Each word's count in all cells, to the cells that asked for it, in their order."""
    sizes = rows["size"].to_numpy()
    parts = [unpacked(d.as_buffer(), s, 2) for d, s in zip(rows["data"], sizes)]
    _, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(of, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    ends = np.cumsum(sizes)
    columns = {"cell": [-1, *rows["cell"].to_pylist()], "low": [rows["low"][0].as_py()] * (len(sizes) + 1), "size": [0, *sizes], "data": [None, *(packed(n[of[e - s : e]]) for s, e in zip(sizes, ends))],
               "seen": [_histogram(n), *[None] * len(sizes)], "total": [int(n.sum()), *[None] * len(sizes)], "most": [int(n.max()), *[None] * len(sizes)]}
    return _table(columns, [("cell", pa.int32()), ("low", pa.int32()), ("size", pa.int32()), ("data", pa.binary()), ("seen", _LONGS), ("total", pa.int64()), ("most", pa.int64())])


def _valued(model: _Ones, taken: list[tuple], lows: int):
    kinds = [("piece", pa.int64()), ("cell", pa.int32()), ("share", pa.int32()), ("size", pa.int32()), ("data", pa.binary())]

    def valued(rows: pa.Table, told: pa.Table) -> pa.Table:
        """Probabilities of a cell's grams and of the best words in their contexts, to their pieces."""
        cell = _Cell(rows)
        low, ones = _spread(cell.words, lows), np.zeros(len(cell.words), np.int64)
        for k, size, data in zip(told["low"].to_pylist(), told["size"].to_pylist(), told["data"]):
            ones[low == k] = unpacked(data.as_buffer(), size, 1)[0]
        own, rest2 = _levels(cell.n, cell.first, len(cell.befores), taken[1])
        two = own + rest2[cell.first] * model.of(ones)[cell.last]
        top2 = np.maximum(_highest(two, cell.first, len(cell.befores)), rest2 * model.best)
        out = []
        for share, g in enumerate(cell.shares()):
            at, size = g["first"], len(g["context_at"])
            own, rest = _levels(g["n"], g["context"][at], size, taken[2])
            pair = cell.pair_places(g["b"][g["at_two"]], g["c"][g["at_two"]])
            p = own + rest[g["context"][at]] * two[pair][g["two"][at]]
            low_top = top2[np.searchsorted(cell.befores, g["b"][g["context_at"]])]
            top = np.maximum(_highest(p, g["context"][at], size), rest * low_top)
            each, best = p[g["three"]].view(np.int64), top[g["context"]].view(np.int64)
            ends, number = np.cumsum(g["sizes"]), cell.rows["share"][int(cell.heads[share])].as_py()
            out += [(k, number, s, packed(each[e - s : e], best[e - s : e] ^ each[e - s : e])) for k, s, e in zip(g["pieces"], g["sizes"], ends)]
        pieces, shares, sizes, data = zip(*out)
        return _table({"piece": pieces, "cell": [rows["cell"][0].as_py()] * len(out), "share": shares, "size": sizes, "data": data}, kinds)

    return valued


def _lists(read):
    def lists(values: pa.Table, pieces: pa.Table) -> pa.Table:
        """A piece's texts with the values of their words."""
        own, sizes = read(pieces["words"][0], pieces["sizes"][0], pieces["data"][0])
        order = np.lexsort((values["share"].to_numpy(), values["cell"].to_numpy()))  # as they were sent
        p, top = (np.concatenate(x) for x in zip(*(unpacked(values["data"][int(i)].as_buffer(), values["size"][int(i)].as_py(), 2) for i in order)))
        later = np.arange(len(own.of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) > 0
        of, many = own.of[later], sizes > 1
        ends = pa.array(np.append(0, np.cumsum(sizes[many] - 1)), pa.int32())
        nll, best = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (-np.log(p.view(np.float64)[of]), (top ^ p).view(np.float64)[of]))
        return pa.table({"key": pieces["keys"][0].values.filter(pa.array(many)), "nll": nll, "top": best})

    return lists
