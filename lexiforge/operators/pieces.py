"""Texts packed into pieces: rows of a bounded number of words, each distinct word of a piece once, the texts' words as places among them.

A piece asks for what it needs of each distinct word, so large tables of words meet pieces, not the words of all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.stored import saved

#: Words of a piece; a longer text has one of its own.
PIECE = 1_000_000


def packed(*columns: np.ndarray) -> bytes:
    """Columns of eight-byte numbers of equal length, byte by byte of all their numbers, which compresses well."""
    return pa.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), "zstd", asbytes=True)


def unpacked(data: bytes, size: int, n: int) -> list[np.ndarray]:
    """n columns of int64."""
    raw = np.frombuffer(pa.decompress(data, size * 8 * n, "zstd", asbytes=True), np.uint8).reshape(n, 8, size)
    return [np.ascontiguousarray(x.T).view(np.int64).reshape(-1) for x in raw]


def pieces(rows: DataFrame, key: Column, words: Column, most: int = PIECE) -> DataFrame:
    """(piece, keys, sizes, words, data), saved, of the arrays of words in rows; null and empty ones are left out.

    keys and sizes have an entry a text, words one a distinct word; words_of reads the places in data.
    """
    texts = rows.select(key.alias("key"), words.alias("words")).where(F.size("words") > 0)

    def made(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes, i = pc.list_value_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64), 0
            ends = np.cumsum(sizes)
            while i < len(sizes):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
                part = batch.slice(i, j - i)
                own = part.column("words").flatten().dictionary_encode()
                data = packed(own.indices.to_numpy().astype(np.int64))
                keys, known = (pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays([part.column("key")]), own.dictionary))
                yield pa.RecordBatch.from_arrays([pa.array([task << 32 | n], pa.int64()), keys, pa.array([sizes[i:j]], pa.list_(pa.int32())), known, pa.array([data], pa.binary())], ["piece", "keys", "sizes", "words", "data"])
                i, n = j, n + 1

    return saved(texts.mapInArrow(made, f"piece long, keys array<{texts.schema['key'].dataType.simpleString()}>, sizes array<int>, words array<string>, data binary"))


def words_of(sizes: pa.ListScalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """How many words a piece's texts have, and each word's place among the piece's distinct ones."""
    sizes = sizes.values.to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, unpacked(data.as_buffer(), int(sizes.sum()), 1)[0]


def repeated(made: DataFrame, column: str = "key") -> bool:
    """Whether two texts in pieces have an equal key."""
    return not made.select(F.explode("keys").alias("key")).groupBy(column).count().where("count > 1").isEmpty()
