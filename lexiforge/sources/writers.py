"""Writers.  Tables go to Parquet, JSON or CSV folders; only reports and model files, small by nature, are made on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions import text as X


def write_pairs(rows: DataFrame, path: str) -> None:
    rows.select("input", "output").write.mode("overwrite").json(path)


def pair_array(rows: DataFrame) -> DataFrame:
    """(ord, value): the lines of one JSON array of pairs (row_id, input, output) in row order, four blanks deep; written with one file if order must show.

    Only the first and last row's ids are looked up, so no task holds all pairs.
    """
    ends = rows.agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    item = F.concat(F.lit('    {\n        "input": '), quoted(F.col("input")), F.lit(',\n        "output": '), quoted(F.col("output")), F.lit("\n    }"))
    each = rows.crossJoin(F.broadcast(ends)).select(
        F.col("row_id").alias("ord"), F.concat(F.when(F.col("row_id") == F.col("a"), "[\n").otherwise(""), item, F.when(F.col("row_id") == F.col("b"), "\n]").otherwise(",")).alias("value")
    )
    return each


def scored_lines(rows: DataFrame, score: float, name: str = "score") -> DataFrame:
    """(ord, value): tab-separated prediction and reference of rows (row_id, prediction, reference), then the score's line."""
    body = rows.select(F.col("row_id").cast("long").alias("ord"), F.concat_ws("\t", F.coalesce("prediction", F.lit("")), F.coalesce("reference", F.lit(""))).alias("value"))
    return body.unionByName(rows.sparkSession.createDataFrame([(2**62, f"{name}\t{score:.6f}")], "ord long, value string"))


def count_line(lines: DataFrame) -> DataFrame:
    """One row (value): how many lines a file of term formats has, as its comment."""
    return lines.agg(F.format_string("; %d termFormat lines", F.count("*")).alias("value"))


def create_table(spark: SparkSession, name: str, schema: str, path: str | None = None) -> None:
    """The table exists afterwards; one of that name is left as it is.  Spark has no indexes: sort or bucket by the key instead."""
    at = "" if path is None else " LOCATION '" + path.replace("'", "\\'") + "'"
    quoted = ".".join(f"`{part}`" for part in name.split("."))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {quoted} ({schema}) USING parquet{at}")


def fixed_decimals(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with these columns as text of six decimals."""
    return rows.withColumns({c: F.format_string("%.6f", F.col(c).cast("double")) for c in columns})


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', quote='"')


def write_resumable(new: DataFrame, path: str) -> None:
    """Append finished rows; resumption leaves out what is there (see operators.pairs.remaining)."""
    new.write.mode("append").parquet(path)


def write_once(rows: DataFrame, path: str) -> None:
    """Nothing happens if the output exists."""
    rows.write.mode("ignore").parquet(path)


def by_bin(rows: DataFrame, path: str, column: str = "bin") -> None:
    rows.write.mode("overwrite").partitionBy(column).parquet(path)


def wrapped(c: Column) -> Column:
    return F.format_string("SUOKIF{ %s }", c)


def term_format(term: Column, phrase: Column) -> Column:
    return F.format_string('(termFormat EnglishLanguage %s "%s")', term, phrase)


def term_format_lines(rows: DataFrame) -> DataFrame:
    """(term, phrase) -> distinct lines by term and phrase; the order is for the writer."""
    return rows.select("term", "phrase").distinct().orderBy("term", "phrase").select(term_format(F.col("term"), F.col("phrase")).alias("value"))


def documentation(term: Column, gloss: Column) -> Column:
    return F.format_string('(documentation %s EnglishLanguage "%s")', term, gloss)


def separated(rows: DataFrame) -> DataFrame:
    """(line_number, value) with a line '!!' after each line's results; ordering is the writer's."""
    marks = rows.select("line_number").distinct().select("line_number", F.lit("!!").alias("value"), F.lit(1).alias("mark"))
    return rows.select("line_number", "value", F.lit(0).alias("mark")).unionByName(marks)


def sections(rows: DataFrame) -> DataFrame:
    """(ord, value): a sectioned result of rows (sentence, label) as text lines with counts."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    names = {1: "VALID", -1: "INVALID", 0: "UNCLASSIFIED"}
    title = F.lit(None).cast("string")
    for k, v in names.items():
        title = F.when(F.col("label") == k, v).otherwise(title)
    heads = counts.select(F.format_string("---- %s SENTENCES ----", title).alias("value"), (F.col("label") * -2).alias("ord"))
    totals = counts.select(F.format_string("%s: %d", title, F.col("n")).alias("value"), F.lit(-9).alias("ord"))
    body = rows.select(F.col("sentence").alias("value"), (F.col("label") * -2 + 1).alias("ord"))
    return totals.unionByName(heads).unionByName(body).select("ord", "value")


def traced(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, text): what the text is after each stage."""
    parts = [df.select(F.lit(name).alias("stage"), "text") for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insert_missing(config: DataFrame, wanted: DataFrame) -> DataFrame:
    """Lines of config and those wanted lines that it lacks."""
    return config.select("value").unionByName(wanted.select("value").join(config.select("value"), "value", "left_anti"))


class KnowledgeBase:
    """A table of statements: append, list, clear."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        rows.select(X.without_returns(F.col("value")).alias("value")).write.mode("append").parquet(self.path)

    def list(self) -> DataFrame:
        return self.spark.read.schema("value string").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], "value string").write.mode("overwrite").parquet(self.path)


def model_json(model: dict) -> str:
    return json.dumps(model, indent=2, sort_keys=True)


def report(title: str, tables: dict[str, DataFrame], most: int = 200) -> str:
    """A Markdown report of small result tables (at most so many rows of each)."""
    out = [f"# {title}"]
    for name, df in tables.items():
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.limit(most).collect()]
    return "\n".join(out) + "\n"


def statement_table(rows: DataFrame) -> DataFrame:
    """Statements (file, line_num, terms) as text in file and line order."""
    return rows.orderBy("file", "line_num").select(F.concat(F.lit("("), F.array_join("terms", " "), F.lit(")")).alias("value"))
