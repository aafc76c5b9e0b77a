"""Queries that write tables to files in the shared folder and read them back, and that parse lines made from tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiforge.operators.stored import shared_folder
from lexiforge.plans.common import query, r6
from lexiforge.sources import readers, writers


def _path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_FLAT = r"regexp_replace(text, '[\r\n]+', ' ', 'g')"


@query("file_sentences", f"SELECT trim({_FLAT}, ' ') AS sentence, count(*) AS n FROM documents WHERE trim({_FLAT}, ' ') <> '' GROUP BY 1")
def _(t, spark):
    path = _path(spark, "sentences")
    t("documents").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).where("value is not null").write.text(path)
    return readers.sentence_lines(spark, path).groupBy("sentence").agg(F.count("*").alias("n"))


@query("file_line_numbers", "SELECT count(*) AS n, count(*) AS numbers FROM documents WHERE text IS NOT NULL")
def _(t, spark):
    """Lines of each file are numbered from 1 without a gap: as many (file, number) pairs as lines, each file's largest number its count."""
    path = _path(spark, "lines")
    t("documents").select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).where("value is not null").write.text(path)
    each = readers.lines(spark, path).groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("line_num").alias("d"), F.max("line_num").alias("m"), F.min("line_num").alias("a"))
    return each.agg(F.sum("n").alias("n"), F.sum(F.when((F.col("d") == F.col("m")) & (F.col("a") == 1), F.col("m")).otherwise(0)).cast("long").alias("numbers"))


@query("file_json_lines", "SELECT text AS output, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text")
def _(t, spark):
    path = _path(spark, "pairs")
    writers.write_pairs(t("documents").select(F.col("lang").alias("input"), F.col("text").alias("output")), path)
    good, _ = readers.json_lines(spark, path, "output")
    return good.groupBy("output").agg(F.count("*").alias("n"))


@query("file_lacking_lines", "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 7 = 0 AND lang IS NOT NULL GROUP BY lang")
def _(t, spark):
    path = _path(spark, "lacking")
    docs = t("documents").select(F.col("lang").alias("input"), F.when(F.col("doc_id") % 7 != 0, F.coalesce("text", F.lit(""))).alias("output"))
    writers.write_pairs(docs, path)
    _, bad = readers.json_lines(spark, path, "output")
    return bad.select(F.get_json_object("value", "$.input").alias("lang")).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"))


@query("file_features", "SELECT 'say \"' || event_type || '\", ' || user_id AS sentence, round(value, 4) AS score, (event_id % 3)::VARCHAR AS human_label, count(*) AS n FROM events GROUP BY ALL")
def _(t, spark):
    path = _path(spark, "features")
    rows = t("events").select(F.concat(F.lit('say "'), "event_type", F.lit('", '), F.col("user_id").cast("string")).alias("sentence"), F.col("value").alias("score"), (F.col("event_id") % 3).alias("human_label"))
    writers.write_csv(writers.fixed_decimals(rows, ["score"]), path)
    back = readers.feature_csv(spark, path, ("score",), "human_label")
    return back.select("sentence", F.round("score", 4).alias("score"), "human_label").groupBy("sentence", "score", "human_label").agg(F.count("*").alias("n"))


@query("validity_lines", "SELECT p_brand || ' \"x\"' AS sentence, arg_max(CASE WHEN p_size % 2 = 0 THEN 'Valid' ELSE 'Invalid' END, p_partkey) AS validity FROM part WHERE p_partkey > 50 GROUP BY 1")
def _(t, spark):
    row = F.concat(F.lit('"'), "p_brand", F.lit(' ""x""",'), F.when(F.col("p_size") % 2 == 0, "Valid").otherwise("Invalid"))
    value = F.when(F.col("p_partkey") == 50, " Sentence , Valid/Invalid, more").otherwise(row)
    return readers.after_preamble(t("part").select(F.col("p_partkey").alias("line_num"), value.alias("value")))


@query("kif_statements", """SELECT p_partkey AS line_num, CASE WHEN p_size % 5 = 3 THEN 'subclass' ELSE 'instance' END AS relation, list_value(replace(p_brand, '#', ''), '?X' || p_size) AS args FROM part WHERE p_size % 5 >= 2 AND p_partkey % 10 <> 0""")
def _(t, spark):
    body = F.concat(F.when(F.col("p_size") % 5 == 3, "subclass  ").otherwise("instance "), F.replace(F.col("p_brand"), F.lit("#"), F.lit("")), F.lit(" ?X"), F.col("p_size").cast("string"), F.lit(")"))
    start = F.when(F.col("p_size") % 5 == 0, "; (").when(F.col("p_size") % 5 == 1, "").otherwise("(")
    name = F.when(F.col("p_partkey") % 10 == 0, "kb/pictureList.kif").otherwise("kb/Merge.kif")
    lines = t("part").select(name.alias("file"), F.col("p_partkey").alias("line_num"), F.concat(F.lit("  "), start, body, F.lit(" ; a note (x y)")).alias("value"))
    return readers.statements(lines).select("line_num", "relation", "args")


@query("corpus_token_lines", "SELECT p_partkey AS line_num, p_brand AS word, lower(p_brand) AS root, 'nn' || p_size AS pos FROM part WHERE p_size % 4 < 2")
def _(t, spark):
    cells = [F.col("p_brand"), F.lower("p_brand"), F.concat(F.lit("nn"), F.col("p_size").cast("string"))]
    value = F.when(F.col("p_size") % 4 == 0, F.concat_ws("\t", *cells)).when(F.col("p_size") % 4 == 1, F.concat_ws("\t", F.lit("7"), F.lit("x"), *cells)).when(F.col("p_size") % 4 == 2, F.concat_ws("\t", *cells[:2])).otherwise("")
    return readers.corpus_tokens(t("part").select(F.col("p_partkey").alias("line_num"), value.alias("value")))


@query("rows_by_number", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id IN (3, 50, 77, 150)")
def _(t, spark):
    return readers.at_rows(t("documents"), [3, 50, 77, 150], "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("bin_folders", "SELECT p_size::INT AS bin, p_partkey FROM part")
def _(t, spark):
    path = _path(spark, "bins")
    writers.by_bin(t("part").select("p_partkey", F.col("p_size").alias("bin")), path)
    return spark.read.parquet(path).select("bin", "p_partkey")


@query("knowledge_base", "SELECT '(instance ' || c_name || ' ' || c_mktsegment || ')' AS value FROM customer")
def _(t, spark):
    kb = writers.KnowledgeBase(spark, _path(spark, "kb"))
    kb.add(t("customer").select(F.concat(F.lit("(gone "), "c_name", F.lit(")")).alias("value")))
    kb.clear()
    rows = t("customer").select("c_custkey", F.concat(F.lit("(instance "), "c_name", F.lit("\r "), "c_mktsegment", F.lit(")")).alias("value"))
    for part in (0, 1):
        kb.add(rows.where(F.col("c_custkey") % 2 == part))
    return kb.list()


@query("missing_lines", "SELECT DISTINCT p_brand AS value FROM part")
def _(t, spark):
    config = t("part").where("p_size > 25").select(F.col("p_brand").alias("value")).distinct()
    return writers.insert_missing(config, t("part").select(F.col("p_brand").alias("value")).distinct())


@query("labelled_sections", """SELECT 'VALID: ' || count(*) AS value, -9 AS ord FROM labels WHERE quality = 1 HAVING count(*) > 0 UNION ALL SELECT 'INVALID: ' || count(*), -9 FROM labels WHERE quality = 0 HAVING count(*) > 0 UNION ALL SELECT '---- VALID SENTENCES ----', -2 FROM labels WHERE quality = 1 HAVING count(*) > 0
UNION ALL SELECT '---- INVALID SENTENCES ----', 2 FROM labels WHERE quality = 0 HAVING count(*) > 0 UNION ALL SELECT doc_id::VARCHAR, CASE WHEN quality = 1 THEN -1 ELSE 3 END FROM labels WHERE quality IS NOT NULL""")
def _(t, spark):
    rows = t("labels").where("quality is not null").select(F.col("doc_id").cast("string").alias("sentence"), F.when(F.col("quality") == 1, 1).otherwise(-1).alias("label"))
    return writers.sections(rows).select("value", "ord")


@query("written_once", "SELECT n_nationkey, n_name FROM nation")
def _(t, spark):
    path = _path(spark, "once")
    rows = t("nation").select("n_nationkey", "n_name")
    writers.write_once(rows, path)
    writers.write_once(rows.unionAll(rows), path)  # there already: nothing happens
    return spark.read.parquet(path)


@query("resumed_rows", "SELECT o_orderkey, round(o_totalprice, 2) AS total FROM orders")
def _(t, spark):
    path = _path(spark, "resumed")
    rows = t("orders").select("o_orderkey", r6(F.col("o_totalprice")).alias("total"))
    writers.write_resumable(rows.where("o_orderkey % 3 = 0"), path)
    done = spark.read.parquet(path).select("o_orderkey")
    writers.write_resumable(rows.join(done, "o_orderkey", "left_anti"), path)
    return spark.read.parquet(path).select("o_orderkey", F.round("total", 2).alias("total"))
