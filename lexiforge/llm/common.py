"""What several operators need: lineage cuts in the shared folder and connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges in a file of a components round.
EDGES_A_FILE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine (tests), a temporary one where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not (spark.conf.get("spark.checkpoint.dir", None) or re.fullmatch(r"local(\[[^\]]*\])?", sc.master)):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexiforge-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appended(rows: DataFrame, source: str, schema: str, compute: Callable[[pa.Array], list[pa.Array]], at_once: int = 256) -> DataFrame:
    """rows with the columns of schema ("name type; name type"), from compute(values of source).

    compute gets a few rows at a time whatever the size of an Arrow batch, so long texts need little memory in a worker
    and results go back in small batches.  Columns of rows that have one of the names are replaced.
    """
    names = [x.strip().split(" ", 1)[0] for x in schema.split(";")]
    kept = rows.drop(*[n for n in names if n != source])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            place = whole.schema.get_field_index(source)
            for at in range(0, whole.num_rows, at_once):
                b = whole.slice(at, at_once)
                yield pa.RecordBatch.from_arrays([*b.columns, *compute(b.column(place))], [*b.schema.names, *names])

    return kept.mapInArrow(run, f"{fields}, {schema.replace(';', ',')}")


def held_out(doc_id, mod: int, remainder: int):
    """crc32 of the id as text falls on the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def _state(e: DataFrame) -> tuple:
    """The number of edges (u, v) and the sum of their hashes."""
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of any orderable type: rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds: only group minima and equi-joins, so a node of a million
    edges is pre-aggregated before the shuffle and its join partition can be split.  Nodes without edges to
    another node don't appear; an empty table gives an empty result.  Edges that already lead each node to its root
    settle in one round.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(e)
    for _ in range(most_rounds):
        files = 1 + state[0] // EDGES_A_FILE  # few files for few edges
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large.coalesce(files))  # else its plan stands in the round's plan three times over, and the driver holds each
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(files))
        now = _state(e)
        if now == state:
            tops = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(tops)
        state = now
    raise RuntimeError("connected components did not settle")
