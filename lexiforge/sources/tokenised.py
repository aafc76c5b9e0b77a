"""Tokenised rows that are read by number, without a scan.

Rows lie in folders of a fixed span of row numbers, sorted, in files with small pages and their index.  Reading some
rows prunes folders by number and, within the files, pages by the index; so k rows cost their own blocks.

Scale: one shuffle by span when writing; a span of rows is one sorted task's file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN, PAGE_BYTES = 100_000, 64 * 1024


def encoded(rows: DataFrame, texts: dict[str, str], encode: Callable[[list[str]], list[list[int]]], most: int | None = None) -> DataFrame:
    """rows with the ids of texts ({column: name of its ids}) as array<int>, cut to `most` ids, and a mask of ones beside each (name_mask).

    encode gets the texts of a batch; a null text has null ids.
    """
    names = list(texts.values())
    kept = rows.drop(*names, *[f"{n}_mask" for n in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = []
            for c in texts:
                own = b.column(b.schema.get_field_index(c)).to_pylist()
                got = iter(encode([t for t in own if t is not None]))
                columns.append(pa.array([None if t is None else list(next(got))[:most] for t in own], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, *names])

    out = kept.mapInArrow(run, f"{fields}, " + ", ".join(f"`{n}` array<int>" for n in names))
    return out.withColumns({f"{n}_mask": F.transform(n, lambda _: F.lit(1)) for n in names})


def write(rows: DataFrame, path: str, row_id: str = "row_id", span: int = SPAN) -> None:
    """Write rows (row_id: a number) for reading by number; nothing happens if they are there already."""
    block = F.floor(F.col(row_id) / span).cast("long")
    out = rows.withColumn("block", block).repartition("block").sortWithinPartitions("block", row_id)
    out.write.mode("ignore").partitionBy("block").option("parquet.page.size", PAGE_BYTES).option("parquet.page.row.count.limit", max(100, span // 100)).option("parquet.block.size", 16 << 20).parquet(path)


def at(spark: SparkSession, path: str, wanted: list[int], row_id: str = "row_id", span: int = SPAN) -> DataFrame:
    """The rows of these numbers; other folders and pages aren't read."""
    blocks = sorted({w // span for w in wanted})
    return spark.read.parquet(path).where(F.col("block").isin(blocks) & F.col(row_id).isin(sorted(set(wanted)))).drop("block")


def where(spark: SparkSession, path: str, chosen: DataFrame, row_id: str = "row_id", span: int = SPAN) -> DataFrame:
    """The rows of the numbers in a table `chosen` (row_id): a join on folder and number, so that Spark prunes folders at run time where chosen is small."""
    numbers = chosen.select(F.col(row_id), F.floor(F.col(row_id) / span).cast("long").alias("block")).distinct()
    return spark.read.parquet(path).join(numbers, ["block", row_id]).drop("block")
