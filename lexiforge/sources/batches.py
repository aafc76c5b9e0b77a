"""Tables that grow by numbered batches: a repeated or half-written batch changes nothing.

A batch is a Parquet folder that Spark's committer marks as complete at its very end; folders without the mark are not
read and are overwritten when the batch comes again.  So a job or a stream (foreachBatch gives the number) may stop
anywhere and be run again.  Adding by key leaves out the keys that are there, and numbering goes on from the largest.

Scale: adding joins new rows with the keys of the table, both sides shuffled by key; nothing is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class BatchedTable:
    """A table of columns `schema` under a folder that all executors reach."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.columns = spark.createDataFrame([], schema).columns

    def committed(self) -> list[int]:
        """Numbers of the complete batches, ascending."""
        jvm = self.spark._jvm
        marks = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch=*/_SUCCESS")
        found = marks.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(marks) or []
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found)

    def read(self) -> DataFrame:
        """The rows of all complete batches, with the column batch."""
        paths = [f"{self.path}/batch={b}" for b in self.committed()]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, batch int")
        return self.spark.read.schema(f"{self.schema}, batch int").option("basePath", self.path).parquet(*paths)

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add rows as that batch; whether it was new.  Only one writer a batch number may run at a time."""
        if batch in self.committed():
            return False
        rows.select(*[f"`{c}`" for c in self.columns]).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def insert_or_ignore(self, rows: DataFrame, batch: int, keys: list[str], order: list[Column | str] | None = None) -> bool:
        """Add the rows whose keys the table lacks, of several with the same keys one (the first by order, else by all columns); whether the batch was new.

        Null keys count as equal to one another.
        """
        if batch in self.committed():
            return False
        first = F.struct(*[F.struct(*(order or [])).alias("o"), F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("r")]) if order else F.struct(F.struct(*[F.col(f"`{c}`") for c in self.columns]).alias("r"))
        one = rows.groupBy(*keys).agg(F.min(first).alias("__x")).select("__x.r.*")
        have = self.read().select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
        on = [one[k].eqNullSafe(have[f"__{k}"]) for k in keys]
        return self.append(one.join(have, on, "left_anti"), batch)


def words_table(spark: SparkSession, path: str) -> BatchedTable:
    """The vocabulary: id, root, pos."""
    return BatchedTable(spark, path, "id string, root string, pos string")


def add_words(table: BatchedTable, words: DataFrame, batch: int) -> bool:
    """Add (root, pos) to a vocabulary; an id is a digest of both, so it doesn't depend on when a word came."""
    if batch in table.committed():
        return False
    one = words.where("root is not null").select("root", "pos").distinct()
    have = table.read().select(F.col("root").alias("__root"), F.col("pos").alias("__pos"))
    new = one.join(have, one["root"].eqNullSafe(have["__root"]) & one["pos"].eqNullSafe(have["__pos"]), "left_anti")
    return table.append(new.select(F.sha2(F.to_json(F.struct("root", "pos")), 224).alias("id"), "root", "pos"), batch)  # digests of new words only


def unknown_table(spark: SparkSession, path: str) -> BatchedTable:
    """Unknown words: id, sentence_id, word, type."""
    return BatchedTable(spark, path, "id int, sentence_id long, word string, type string")


def add_unknown_words(table: BatchedTable, tokens: DataFrame, batch: int) -> bool:
    """Add the words of tokens (sentence_id, pos, word, type), trimmed and in lower case: new ones of a sentence and type get ids after its largest, by first place."""
    if batch in table.committed():
        return False
    own = tokens.where("word is not null and type is not null").withColumn("word", F.lower(F.trim("word")))
    first = own.groupBy("sentence_id", "type", "word").agg(F.min("pos").alias("first"))
    have = table.read()
    new = first.join(have.select("sentence_id", "type", "word"), ["sentence_id", "type", "word"], "left_anti")
    place = F.row_number().over(Window.partitionBy("sentence_id", "type").orderBy("first", "word"))  # a sentence's words of a type
    largest = have.groupBy("sentence_id", "type").agg(F.max("id").alias("largest"))
    rows = new.withColumn("place", place).join(largest, ["sentence_id", "type"], "left")
    return table.append(rows.withColumn("id", (F.col("place") + F.coalesce("largest", F.lit(0))).cast("int")), batch)


def unknown_id(table: BatchedTable, word: str, kind: str, sentence_id: int) -> DataFrame:
    """The row of a word of a sentence, if there is one."""
    return table.read().where((F.col("word") == word.strip().lower()) & (F.col("type") == kind) & (F.col("sentence_id") == sentence_id))
