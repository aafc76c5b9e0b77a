"""Sentences as a stream: row-local functions need no state, so a stream is the same columns between a source and a sink.

Masking needs one sentence's tokens only; on a stream it is done within the row, on an array of tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexiforge.functions import text as X


def sentence_stream(spark: SparkSession, path: str) -> DataFrame:
    """(value) of text files as they arrive."""
    return spark.readStream.text(path)


def described(rows: DataFrame, c: str = "value") -> DataFrame:
    """rows with shape features, lexical measures and balance; works on batches and streams alike."""
    return rows.where(F.trim(c) != "").withColumns(X.shape(F.col(c)) | X.lexical(F.col(c)) | {"balanced": X.balanced(F.col(c))})


def masked_row(words, known):
    """An array of words with those that an array of known words lacks masked, numbered by first appearance (equal words alike)."""
    low = F.transform(words, F.lower)
    unknown = F.array_distinct(F.filter(low, lambda w: ~F.array_contains(known, w)))
    mask = lambda w: F.concat(F.lit("UNK_noun_"), F.array_position(unknown, F.lower(w)).cast("string"))
    return F.transform(words, lambda w: F.when(F.array_contains(unknown, F.lower(w)), mask(w)).otherwise(w))


def started(rows: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stream to Parquet; with a checkpoint it resumes where it stopped, each row once."""
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(events: DataFrame, late: str = "10 minutes", wide: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) per event-time window, with a watermark on streams: an extra beside the reference's work."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", wide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def each_batch(rows: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
