"""Queries over counts, summaries and line formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import sequences as N
from lexiforge.functions import text as X
from lexiforge.operators import calibration as K
from lexiforge.operators import models as M
from lexiforge.operators import pairs as O
from lexiforge.operators import selection as S
from lexiforge.plans.common import WORDS_SQL, query, r6
from lexiforge.sources import writers


@query("first_lines", "SELECT doc_id, lang FROM documents WHERE doc_id < 150")
def _(t, spark):
    return S.first_lines(t("documents"), 150, "doc_id").select("doc_id", "lang")


@query("ninths_split", "SELECT doc_id, CASE WHEN p <= n * 90 // 100 THEN 'train' WHEN p <= n * 90 // 100 + n * 10 // 100 THEN 'dev' END AS share, CASE WHEN p <= 95 THEN 'train' WHEN p <= 105 THEN 'dev' END AS counted FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents)")
def _(t, spark):
    docs = t("documents").select("doc_id")
    counted = S.ninths_split(docs, "doc_id", 95).select("doc_id", F.col("part").alias("counted"))
    return S.ninths_split(docs, "doc_id").select("doc_id", F.col("part").alias("share")).join(counted, "doc_id")


@query("merged_bins", "SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) AS place FROM documents")
def _(t, spark):
    return S.balanced_merge(t("documents").select("doc_id"), "doc_id", 7)


@query("text_totals", "SELECT source, count(*) AS lines, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def _(t, spark):
    return O.totals(t("documents"), F.col("text"), ["source"])


@query("long_sentences", f"SELECT doc_id, len({WORDS_SQL}) > 30 AS long FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", N.too_long(X.lexical(F.col("text"))["sentence_length"]).alias("long"))


_GRADE = "CASE event_id % 4 WHEN 0 THEN '2.5' WHEN 1 THEN '-1' WHEN 2 THEN '0.5' ELSE event_type END"
_VALUE = "CASE WHEN event_id % 5 = 0 THEN '' ELSE round(value, 2)::VARCHAR END"


def _graded(t):
    grade = F.get(F.array(F.lit("2.5"), F.lit("-1"), F.lit("0.5"), F.col("event_type")), (F.col("event_id") % 4).cast("int"))
    return t("events").select("event_id", grade.alias("human_label"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.round("value", 2).cast("string")).alias("score"))


@query("usable_counts", f"""WITH g AS (SELECT try_cast({_GRADE} AS DOUBLE) AS g, try_cast({_VALUE} AS DOUBLE) AS v FROM events)
SELECT count(*) FILTER (WHERE g IS NULL) AS no_number, count(*) FILTER (WHERE g > -1 AND g < 2) AS borderline, count(*) FILTER (WHERE (g >= 2 OR g <= -1) AND v IS NULL) AS missing_feature, count(*) FILTER (WHERE (g >= 2 OR g <= -1) AND v IS NOT NULL) AS kept FROM g""")
def _(t, spark):
    return O.usable_counts(_graded(t), ["score"], "human_label")


@query("signed_rows", f"SELECT event_id, CASE WHEN g > 0 THEN 1 ELSE 0 END AS y FROM (SELECT event_id, try_cast({_GRADE} AS DOUBLE) AS g, try_cast({_VALUE} AS DOUBLE) AS v FROM events) WHERE g <> 0 AND v IS NOT NULL")
def _(t, spark):
    return O.signed(_graded(t), ["score"], "human_label").select("event_id", "y")


@query("score_summary", f"""WITH r AS (SELECT try_cast({_VALUE} AS DOUBLE) AS s, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS y, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 0 END AS p FROM events)
SELECT round(avg(s), 4) AS score, round(count(*) FILTER (WHERE p = y)::DOUBLE / count(p), 6) AS accuracy, round(count(*) FILTER (WHERE p = 1 AND y = 1)::DOUBLE / count(*) FILTER (WHERE p = 1), 6) AS precision,
 round(count(*) FILTER (WHERE p = 1 AND y = 1)::DOUBLE / count(*) FILTER (WHERE y = 1 AND p IS NOT NULL), 6) AS recall FROM r""")
def _(t, spark):
    kind = F.when(F.col("event_type") == "view", "1").when(F.col("event_type") == "click", "0")
    rows = _graded(t).join(t("events").select("event_id", kind.alias("found")), "event_id").withColumn("label", F.when(F.col("event_id") % 3 == 0, "Y").otherwise("N"))
    done = O.score_summary(rows, ["score"], "label", "found")
    return done.select(F.round("score", 4).alias("score"), *[r6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall")])


@query("labelled_points", """WITH l AS (SELECT trim(p_name) AS sentence, arg_max(p_size, p_partkey) AS label FROM part WHERE p_size % 3 <> 0 AND p_partkey % 4 <> 0 GROUP BY 1)
SELECT p.p_partkey::DOUBLE AS run, trim(p_name) AS sentence, label FROM part p JOIN l ON l.sentence = trim(p_name)""")
def _(t, spark):
    labels = t("part").select(F.concat(F.lit(" "), "p_name").alias("sentence"), F.when(F.col("p_size") % 3 == 0, "none").otherwise(F.col("p_size").cast("string")).alias("label"), F.when(F.col("p_partkey") % 4 != 0, " a ").otherwise("b").alias("source_file"), "p_partkey")
    points = t("part").select(F.concat("p_name", F.lit(" ")).alias("sentence"), F.col("p_partkey").alias("run"))
    return O.labelled_points(points, labels, ["run"], "a", "p_partkey")


_WEIGHTS = "SELECT p_brand AS feature, min(p_partkey)::INT AS pos, round(avg(abs(p_size - 25)), 6) AS weight_mean_abs FROM part GROUP BY p_brand"


def _weights(t):
    return t("part").groupBy(F.col("p_brand").alias("feature")).agg(F.min("p_partkey").cast("int").alias("pos"), r6(F.avg(F.abs(F.col("p_size") - 25))).alias("weight_mean_abs"))


@query("ordered_summary", f"SELECT *, row_number() OVER (ORDER BY weight_mean_abs DESC, pos)::INT AS place FROM ({_WEIGHTS})")
def _(t, spark):
    return K.ordered(_weights(t))


@query("weakest_feature", f"SELECT * FROM ({_WEIGHTS}) WHERE feature <> 'Brand#1' ORDER BY weight_mean_abs, pos DESC LIMIT 1")
def _(t, spark):
    return S.weakest(_weights(t), ["Brand#1"])


_TOP = "list_transform(embedding, lambda x: abs(x::DOUBLE))"


@query("top_probabilities", f"SELECT vec_id, round(list_sum({_TOP}) / len(embedding), 6) AS top1_prob_mean, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE) - x::DOUBLE)) / len(embedding), 6) AS top1_minus_true_mean FROM embeddings")
def _(t, spark):
    true = F.transform("embedding", lambda x: x.cast("double"))
    top = F.transform(true, F.abs)
    return t("embeddings").select("vec_id", r6(N.top_mean(top)).alias("top1_prob_mean"), r6(N.top_gap(top, true)).alias("top1_minus_true_mean"))


@query("seq_run_norm", """WITH s AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, embedding AS v FROM embeddings), o AS (SELECT vec_id, i, v[i]::DOUBLE * 60 > 3.5 AS hot FROM s),
g AS (SELECT vec_id, hot, i - row_number() OVER (PARTITION BY vec_id, hot ORDER BY i) AS grp FROM o), c AS (SELECT vec_id, count(*) AS n FROM g WHERE hot GROUP BY vec_id, grp)
SELECT e.vec_id, round(coalesce(max(n), 0)::DOUBLE / any_value(len(embedding)), 6) AS run_norm_35 FROM embeddings e LEFT JOIN c USING (vec_id) GROUP BY e.vec_id""")
def _(t, spark):
    return t("embeddings").select("vec_id", r6(N.surprise(F.transform("embedding", lambda x: x.cast("double") * 60))["run_norm_35"]).alias("run_norm_35"))


@query("allowed_tokens", "SELECT vec_id, len(list_filter(range(1, len(embedding) + 1), lambda i: list_contains([0, 3, 7], i - 1) AND embedding[i] > 0))::BIGINT AS open FROM embeddings")
def _(t, spark):
    kept = M.allowed_tokens(F.col("embedding"), F.array(F.lit(0), F.lit(3), F.lit(7)))
    return t("embeddings").select("vec_id", F.size(F.filter(kept, lambda x: x > 0)).cast("long").alias("open"))


@query("word_senses", """WITH s AS (SELECT p_brand AS lemma, CASE p_size % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'v' WHEN 2 THEN 'n' ELSE 'r' END AS pos, p_partkey AS sense FROM part),
w AS (SELECT s_suppkey, 'Brand#' || (1 + s_nationkey % 25) AS lemma, CASE s_nationkey % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'v' END AS kind FROM supplier) SELECT s_suppkey, sense FROM w JOIN s USING (lemma) WHERE kind IS NULL OR kind = pos""")
def _(t, spark):
    table = t("part").select(F.col("p_brand").alias("lemma"), F.get(F.array(*map(F.lit, "avnr")), (F.col("p_size") % 4).cast("int")).alias("pos"), F.col("p_partkey").alias("sense"))
    words = t("supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (1 + F.col("s_nationkey") % 25).cast("string")).alias("lemma"), F.get(F.array(F.lit("NNS"), F.lit("VBD"), F.lit("DT")), (F.col("s_nationkey") % 3).cast("int")).alias("tag"))
    return M.senses(words, table).select("s_suppkey", "sense")


@query("term_format_lines", """SELECT DISTINCT '(termFormat EnglishLanguage ' || p_brand || ' "' || p_type || '")' AS value FROM part UNION ALL SELECT '; ' || count(DISTINCT (p_brand, p_type)) || ' termFormat lines' FROM part""")
def _(t, spark):
    made = writers.term_format_lines(t("part").select(F.col("p_brand").alias("term"), F.col("p_type").alias("phrase")))
    return made.unionByName(writers.count_line(made))


@query("separated_lines", "SELECT conv_id AS line_number, text AS value, 0 AS mark FROM conversations UNION ALL SELECT DISTINCT conv_id, '!!', 1 FROM conversations")
def _(t, spark):
    return writers.separated(t("conversations").select(F.col("conv_id").alias("line_number"), F.col("text").alias("value")))


@query("pair_array", r"""SELECT conv_id, turn, '    {' || chr(10) || '        "input": ' || to_json(role)::VARCHAR || ',' || chr(10) || '        "output": ' || to_json(turn::VARCHAR)::VARCHAR || chr(10) || '    }' AS item FROM conversations""")
def _(t, spark):
    rows = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("input"), F.col("turn").cast("string").alias("output"))
    item = F.regexp_replace("value", r"^\[\n|,$|\n\]$", "")
    return writers.pair_array(rows).select(F.expr("ord div 1000").alias("conv_id"), (F.col("ord") % 1000).alias("turn"), item.alias("item"))


_SEP = "trim(value) = '' OR starts_with(value, ';') OR starts_with(value, '!!')"
_FILE = "SELECT p_brand AS file, p_partkey AS line_num, CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN '; ' || p_name WHEN 2 THEN '!!' ELSE '(' || p_type || ')' END AS value FROM part"


def _file(t):
    value = F.get(F.array(F.lit(""), F.concat(F.lit("; "), "p_name"), F.lit("!!")), (F.col("p_size") % 6).cast("int"))
    return t("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line_num"), F.coalesce(value, F.format_string("(%s)", "p_type")).alias("value"))


@query("statement_groups", f"""WITH l AS ({_FILE}), s AS (SELECT *, {_SEP} AS sep FROM l), g AS (SELECT *, sum(sep::INT) OVER (PARTITION BY file ORDER BY line_num)::BIGINT AS segment FROM s)
SELECT file, segment, string_agg(value, ' ' ORDER BY line_num) AS text FROM g WHERE NOT sep GROUP BY file, segment""")
def _(t, spark):
    return O.statement_groups(_file(t))


@query("corpus_sentences", """WITH w AS (SELECT p_brand AS file, p_partkey AS line_num, CASE p_size % 5 WHEN 0 THEN '.' WHEN 1 THEN '<p>' ELSE p_name END AS word FROM part)
SELECT line_num, coalesce(sum((word IN ('.', '<p>'))::INT) OVER (PARTITION BY file ORDER BY line_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM w""")
def _(t, spark):
    word = F.coalesce(F.get(F.array(F.lit("."), F.lit("<p>")), (F.col("p_size") % 5).cast("int")), F.col("p_name"))
    tokens = t("part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line_num"), word.alias("word"))
    return O.corpus_sentences(tokens).select("line_num", "sentence")


@query("translation_quality", """WITH p AS (SELECT p_partkey, p_size % 4 AS k FROM part), m AS (SELECT k <> 3 AS ok, CASE k WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS miss FROM p)
SELECT round(avg(ok::INT), 6) AS syntax_validity, round(avg((miss = 0)::INT), 6) AS terms_valid, round(avg(miss), 6) AS mean_penalty FROM m""")
def _(t, spark):
    said = F.get(F.array(F.lit("(likes Anna ?X)"), F.lit("(likes Zoe ?X)"), F.lit("(sees Zoe ?X)"), F.lit("((likes Anna ?X)")), (F.col("p_size") % 4).cast("int"))
    done = O.translation_quality(t("part"), said, F.array(F.lit("likes"), F.lit("Anna")))
    return done.select(*[r6(F.col(c)).alias(c) for c in done.columns])
