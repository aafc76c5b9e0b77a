"""Queries over pairs and labels: dedupe, joins, splits, order-dependent operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import sequences as N
from lexiforge.functions import text as X
from lexiforge.operators import pairs as O
from lexiforge.operators import scramble as C
from lexiforge.operators import selection as S
from lexiforge.plans.common import WORDS_SQL, query, r6
from lexiforge.sources import readers


def _pairs(t):
    return t("documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("input"), F.col("source").alias("output"))


@query("dedupe_keep_first", "SELECT doc_id AS row_id, md5(text) AS input, source AS output FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def _(t, spark):
    return O.first_copies(_pairs(t)).select("row_id", F.md5(F.col("input").cast("binary")).alias("input"), "output")


@query("dedupe_later_copies", "SELECT doc_id AS row_id, source AS output FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def _(t, spark):
    return O.later_copies(_pairs(t)).select("row_id", "output")


@query("valid_semi_join", "SELECT min(doc_id) AS row_id FROM documents d WHERE text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality = 1) GROUP BY text")
def _(t, spark):
    good = t("documents").join(t("labels").where("quality = 1"), "doc_id").select("text")
    return O.valid_pairs(_pairs(t), good).select("row_id")


@query("label_left_join", "SELECT d.doc_id, coalesce(l.quality::VARCHAR, '') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t, spark):
    return O.with_labels(t("documents").select("doc_id"), t("labels"), "doc_id", "quality", "doc_id")


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t, spark):
    return O.remaining(t("documents").select("doc_id"), t("labels"), "doc_id")


@query("pair_zip", "SELECT u.conv_id, u.turn, u.text || '#' || a.text AS merged, u.text AS english, a.text AS logic FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND NOT contains(u.text, '#')")
def _(t, spark):
    c = t("conversations")
    a = c.where("role = 'user' and not contains(text, '#')").select(F.struct("conv_id", "turn").alias("line_num"), F.col("text").alias("a"))
    b = c.where("role = 'assistant'").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("line_num"), F.col("text").alias("b"))
    both = O.zipped(a, b).select("line_num.*", O.merged_fields(F.col("a"), F.col("b")).alias("merged"))
    left, right = O.split_fields(F.col("merged"))
    return both.select("conv_id", "turn", "merged", left.alias("english"), right.alias("logic"))


@query("vocab_sorted", "SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS token FROM documents) WHERE token <> ''")
def _(t, spark):
    return O.sorted_vocabulary(t("documents"), F.col("text"))


@query("vocabulary", "SELECT md5(root || '|' || pos) AS id, root, pos FROM (SELECT DISTINCT lower(p_brand) AS root, CASE WHEN p_size % 3 = 0 THEN 'noun' ELSE 'verb' END AS pos FROM part WHERE p_size % 3 < 2)")
def _(t, spark):
    return O.vocabulary(t("part").select(F.col("p_brand").alias("lemma"), F.element_at(F.array(F.lit("NOUN"), F.lit("VERB"), F.lit("ADJ")), F.col("p_size") % 3 + 1).alias("upos")))


_TRUTH = "SELECT d.doc_id, lang, quality = 1 AS y, len(regexp_extract_all(text, '[!-/:-@\\[-`{-~]'))::DOUBLE / greatest(length(text), 1) < 0.035 AS kept FROM documents d JOIN labels l USING (doc_id)"
_COUNTS = f"SELECT lang, count(*) FILTER (WHERE y AND kept) AS tp, count(*) FILTER (WHERE NOT y AND kept) AS fp, count(*) FILTER (WHERE NOT y AND NOT kept) AS tn, count(*) FILTER (WHERE y AND NOT kept) AS fn, 0::BIGINT AS ignored FROM ({_TRUTH}) GROUP BY lang"


def _judged(t):
    rows = t("documents").join(t("labels"), "doc_id")
    return O.confusion(rows, F.col("quality") == 1, X.shape(F.col("text"))["punct_ratio"] < 0.035, ["lang"])


@query("confusion", _COUNTS)
def _(t, spark):
    return _judged(t)


_METRICS = f"""WITH c AS ({_COUNTS}), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS pr FROM c)
SELECT lang, tp, fp, tn, fn, ignored, round(pr, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
 round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy,
 round((tp + fn)::DOUBLE / (tp + fp + tn + fn), 6) AS prevalence, round((tp + fp)::DOUBLE / (tp + fp + tn + fn), 6) AS coverage, round(tp::DOUBLE / (tp + fp + tn + fn), 6) AS coherent_kept_rate,
 round(CASE WHEN fp + tn > 0 THEN fp::DOUBLE / (fp + tn) ELSE 0 END, 6) AS leakage,
 round(CASE WHEN tp + fp > 0 THEN greatest(0, (pr + 1.96 * 1.96 / (2 * (tp + fp)) - 1.96 * sqrt(pr * (1 - pr) / (tp + fp) + 1.96 * 1.96 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 1.96 * 1.96 / (tp + fp))) ELSE 0 END, 6) AS precision_lcb FROM p"""


@query("flagship_coherence", _METRICS)
def _(t, spark):
    done = O.metrics(_judged(t))
    return done.select(*[r6(F.col(c)).alias(c) if k == "double" else F.col(c) for c, k in done.dtypes])


@query("wilson_by_group", """WITH g AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source), p AS (SELECT *, k::DOUBLE / n AS f FROM g)
SELECT source, round(greatest(0, (f + 3.8416 / (2 * n) - 1.96 * sqrt(f * (1 - f) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)), 6) AS lcb FROM p""")
def _(t, spark):
    g = t("documents").join(t("labels"), "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    return g.select("source", r6(N.wilson(F.col("k"), F.col("n"))).alias("lcb"))


@query("exact_match", "SELECT avg(CASE WHEN trim(lang) = trim(substr(lang, 1, 1) || CASE lang WHEN 'en' THEN 'n ' ELSE 'x' END) THEN 100.0 ELSE 0.0 END)::DOUBLE AS exact_match FROM documents")
def _(t, spark):
    guess = F.concat(F.substring("lang", 1, 1), F.when(F.col("lang") == "en", "n ").otherwise("x"))
    return O.exact_match(t("documents"), F.col("lang"), guess)


@query("column_numeric_frac", """SELECT 'props' AS "column", (count(*) FILTER (WHERE try_cast(trim(props) AS DOUBLE) IS NOT NULL))::DOUBLE / count(*) FILTER (WHERE trim(props) <> '') AS fraction FROM events
UNION ALL SELECT 'value', (count(*) FILTER (WHERE value IS NOT NULL))::DOUBLE / count(value) FROM events UNION ALL SELECT 'event_type', (count(*) FILTER (WHERE try_cast(trim(event_type) AS DOUBLE) IS NOT NULL))::DOUBLE / count(*) FILTER (WHERE trim(event_type) <> '') FROM events""")
def _(t, spark):
    return O.numeric_fractions(t("events"), ["props", "value", "event_type"])


@query("usable_rows", "SELECT doc_id, n_chars::DOUBLE AS n_chars, CASE WHEN quality * 3 - 1 >= 2 THEN 1 ELSE 0 END AS y FROM documents JOIN labels USING (doc_id) WHERE quality * 3 - 1 >= 2 OR quality * 3 - 1 <= -1")
def _(t, spark):
    rows = t("documents").join(t("labels"), "doc_id").withColumn("human_label", (F.col("quality") * 3 - 1).cast("string"))
    return O.usable(rows, ["n_chars"], "human_label").select("doc_id", "n_chars", "y")


# ---- splits ----


def _by_hash(order="md5('42:' || doc_id)"):
    return f"row_number() OVER (ORDER BY {order}, doc_id)"


@query("shuffle", f"SELECT doc_id, {_by_hash()} AS place FROM documents")
def _(t, spark):
    return S.shuffled(t("documents").select("doc_id"), "doc_id")


@query("first_n_split", f"SELECT doc_id, CASE WHEN p <= 100 THEN 'dev' WHEN p <= 200 THEN 'test' ELSE 'train' END AS part FROM (SELECT doc_id, {_by_hash()} AS p FROM documents)")
def _(t, spark):
    return S.counted_split(t("documents").select("doc_id"), "doc_id", 100, 100).select("doc_id", "part")


@query("percent_split", f"SELECT doc_id, CASE WHEN p <= n * 96 // 100 THEN 'train' WHEN p <= n * 96 // 100 + (n - n * 96 // 100) // 2 THEN 'dev' ELSE 'test' END AS part FROM (SELECT doc_id, {_by_hash()} AS p, count(*) OVER () AS n FROM documents)")
def _(t, spark):
    return S.shared_split(t("documents").select("doc_id"), "doc_id", 96).select("doc_id", "part")


@query("keep_first_n", f"SELECT doc_id, CASE WHEN p <= 300 THEN 'first' ELSE 'rest' END AS part FROM (SELECT doc_id, {_by_hash()} AS p FROM documents)")
def _(t, spark):
    return S.first_and_rest(t("documents").select("doc_id"), "doc_id", 300).select("doc_id", "part")


@query("ends_split", "SELECT doc_id, CASE WHEN p > 500 THEN 'train' WHEN p > 300 THEN 'test' WHEN p <= 200 THEN 'dev' ELSE 'train' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents)")
def _(t, spark):
    return S.ends_split(t("documents").select("doc_id"), "doc_id", 500, 200).select("doc_id", "part")


@query("hashed_split", "SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 7))::BIGINT % 100 < 80 AS train FROM documents")
def _(t, spark):
    return S.hashed_split(t("documents").select("doc_id"), "doc_id", 80)


@query("stratified_split", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= round_even(count(*) OVER (PARTITION BY lang) * 0.3, 0) AS chosen FROM documents")
def _(t, spark):
    return S.stratified(t("documents").select("doc_id", "lang"), "doc_id", "lang", 0.3).select("doc_id", "chosen")


@query("kfold_assign", f"SELECT doc_id, (({_by_hash()} - 1) % 5)::INT AS fold FROM documents")
def _(t, spark):
    return S.folds(t("documents").select("doc_id"), "doc_id", 5)


@query("random_lines", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 125")
def _(t, spark):
    return S.random_rows(t("documents").select("doc_id"), "doc_id", 125)


@query("split_counts", f"WITH s AS (SELECT lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= round_even(count(*) OVER (PARTITION BY lang) * 0.3, 0) THEN 'dev' ELSE 'test' END AS part FROM documents) SELECT lang, part, count(*) AS n FROM s GROUP BY ALL")
def _(t, spark):
    done = S.stratified(t("documents").select("doc_id", "lang"), "doc_id", "lang", 0.3)
    return done.groupBy("lang", F.when(F.col("chosen"), "dev").otherwise("test").alias("part")).agg(F.count("*").alias("n"))


@query("candidate_pick", """SELECT label, vec_id, sim, marks, marks <= 1 AS met_ok, sim >= 0.8 AS sim_ok FROM (SELECT label, vec_id, abs(embedding[1]::DOUBLE) * 4 AS sim, vec_id % 4 AS marks FROM embeddings)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY CASE WHEN marks <= 1 AND sim >= 0.8 THEN 0 WHEN marks <= 1 THEN 1 ELSE 2 END, sim DESC, vec_id) = 1""")
def _(t, spark):
    rows = t("embeddings").select("label", "vec_id", (F.abs(F.col("embedding")[0].cast("double")) * 4).alias("sim"), (F.col("vec_id") % 4).alias("marks"))
    return S.best_candidates(rows, "label", "sim", "marks", "vec_id", F.lit(1), 0.8)


@query("selection_counts", """WITH b AS (SELECT label, marks <= 1 AS met_ok, sim >= 0.8 AS sim_ok FROM (SELECT label, vec_id, abs(embedding[1]::DOUBLE) * 4 AS sim, vec_id % 4 AS marks FROM embeddings)
QUALIFY row_number() OVER (PARTITION BY label ORDER BY CASE WHEN marks <= 1 AND sim >= 0.8 THEN 0 WHEN marks <= 1 THEN 1 ELSE 2 END, sim DESC, vec_id) = 1) SELECT met_ok, sim_ok, count(*) AS n FROM b GROUP BY ALL""")
def _(t, spark):
    rows = t("embeddings").select("label", "vec_id", (F.abs(F.col("embedding")[0].cast("double")) * 4).alias("sim"), (F.col("vec_id") % 4).alias("marks"))
    return S.best_candidates(rows, "label", "sim", "marks", "vec_id", F.lit(1), 0.8).groupBy("met_ok", "sim_ok").agg(F.count("*").alias("n"))


@query("greedy_cover")
def _(t, spark):
    rows = t("documents").select("doc_id", "lang", F.array_distinct(X.logic_terms(F.col("text"))).alias("terms"))
    return S.greedy_cover(rows, "lang", "doc_id", F.col("terms"), 40)


@query("distractors", rf"""WITH s AS (SELECT t, row_number() OVER (ORDER BY md5('42:' || t), t) - 1 AS r FROM (SELECT DISTINCT unnest({WORDS_SQL}) AS t FROM benchmark)),
z AS (SELECT count(*) AS n FROM s), p AS (SELECT n, (SELECT min(q) FROM unnest(range(n, n + 300)) AS u(q) WHERE len(list_filter(range(2, sqrt(q)::BIGINT + 1), lambda d: q % d = 0 AND d < q)) = 0 AND q > 1) AS p FROM z),
c AS (SELECT conv_id || '-' || turn AS row, list_distinct({WORDS_SQL}) AS own FROM conversations),
h AS (SELECT *, ('0x' || substr(md5('43:' || row), 1, 7))::BIGINT AS a, ('0x' || substr(md5('44:' || row), 1, 7))::BIGINT % p AS b, 1 + ('0x' || substr(md5('45:' || row), 1, 7))::BIGINT % (p - 1) AS e FROM c, p),
m AS (SELECT *, least(greatest(0, round_even((a::DOUBLE / 268435456.0::DOUBLE * 2.0::DOUBLE + 1.5::DOUBLE) * len(own), 0)::BIGINT - len(own)), n)::BIGINT AS more FROM h),
d AS (SELECT row, own, list_filter(list_transform(range(0, more + p - n + 1), lambda i: (b + i * e) % p), lambda x: x < n)[1:more] AS ranks FROM m),
e AS (SELECT row, unnest(own) AS t FROM d UNION ALL SELECT row, t FROM (SELECT row, unnest(ranks) AS r FROM d) JOIN s USING (r))
SELECT c.row, coalesce(string_agg(t, ' ' ORDER BY md5(c.row || ':' || t), t), '') AS candidates FROM c LEFT JOIN e ON c.row = e.row GROUP BY c.row""")
def _(t, spark):
    pool = t("benchmark").select(F.explode(X.words(F.col("text"))).alias("term"))
    rows = t("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("row"), F.array_distinct(X.words(F.col("text"))).alias("terms"))
    return S.with_distractors(rows, "row", "terms", pool).select("row", F.array_join("candidates", " ").alias("candidates"))


# ---- order-dependent ----


@query("role_carry_down", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations")
def _(t, spark):
    return O.carried(t("conversations"), F.when(F.col("role") == "user", F.col("turn")), "turn", ["conv_id"]).select("conv_id", "turn", "carried")


@query("turn_segments", "SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS segment FROM conversations")
def _(t, spark):
    return O.segments(t("conversations"), F.col("role") == "user", "turn", ["conv_id"]).select("conv_id", "turn", "segment")


@query("after_marker", "SELECT conv_id, turn FROM conversations QUALIFY max((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1")
def _(t, spark):
    return O.after_marker(t("conversations"), F.col("role") == "assistant", "turn", ["conv_id"]).select("conv_id", "turn")


_LINES = "SELECT conv_id::VARCHAR AS file, turn, text, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 WHEN 'system' THEN 0 END AS head FROM conversations"


@query("section_labels", f"""WITH l AS (SELECT file, turn * 2 AS n, head, NULL AS text FROM ({_LINES}) UNION ALL SELECT file, turn * 2 + 1, NULL, text FROM ({_LINES})),
f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY n) AS label FROM l) SELECT file, (n)::INT AS line_num, label FROM f WHERE head IS NULL AND label <> 0""")
def _(t, spark):
    c = t("conversations").withColumn("file", F.col("conv_id").cast("string"))
    title = F.when(F.col("role") == "user", "---- VALID SENTENCES ----").when(F.col("role") == "assistant", "---- INVALID SENTENCES ----").otherwise("---- UNCLASSIFIED SENTENCES ----")
    heads = c.select("file", (F.col("turn") * 2).cast("int").alias("line_num"), title.alias("value"))
    body = c.select("file", (F.col("turn") * 2 + 1).cast("int").alias("line_num"), F.concat(F.col("file"), F.lit("|"), "text").alias("value"))
    return readers.sectioned(heads.unionByName(body)).select(F.substring_index("sentence", "|", 1).alias("file"), "line_num", "label")


@query("scramble_map", r"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(text, '".*?"', ' ', 'g'), '[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+|\?')) AS token FROM benchmark),
n AS (SELECT token, row_number() OVER (ORDER BY token) * 7368787 % 11881376 AS n FROM t)
SELECT token, chr((65 + n // 456976 % 26)::INT) || chr((65 + n // 17576 % 26)::INT) || chr((65 + n // 676 % 26)::INT) || chr((65 + n // 26 % 26)::INT) || chr((65 + n % 26)::INT) AS code FROM n""")
def _(t, spark):
    return C.code_map(t("benchmark").select("text"), "text")


@query("scramble_roundtrip", "SELECT item_id, true AS same FROM benchmark")
def _(t, spark):
    rows = t("benchmark").select("item_id", F.regexp_replace("text", "[^a-z ]", " ").alias("text"))
    codes = C.code_map(rows, "text")
    each = rows.select("item_id", F.posexplode(F.split("text", " ")).alias("at", "token")).join(codes, "token", "left")
    line = lambda c: F.array_join(F.array_sort(F.collect_list(F.struct("at", F.coalesce(c, "token").alias("v"))))["v"], " ")
    hidden = each.groupBy("item_id").agg(line("code").alias("hidden"))
    back = C.unscrambled_words(hidden, "item_id", "hidden", codes)
    return rows.join(back.withColumnRenamed("text", "back"), "item_id").select("item_id", (F.col("text") == F.col("back")).alias("same"))


@query("label_means", "SELECT round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM labels")
def _(t, spark):
    return t("labels").agg(*[r6(F.avg(F.col(c).cast("string").try_cast("double"))).alias(c) for c in ("quality", "toxic")])


@query("corpus_bleu", rf"""WITH h AS (SELECT conv_id, turn, {WORDS_SQL.replace("text", "replace(text, 'the', 'a')")} AS p, {WORDS_SQL} AS r FROM conversations),
k AS (SELECT 'p' AS side, conv_id, turn, p AS w FROM h UNION ALL SELECT 'r', conv_id, turn, r FROM h),
o AS (SELECT side, conv_id, turn, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM k, range(1, 5) AS z(n)),
g AS (SELECT side, conv_id, turn, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g, count(*) AS c FROM o GROUP BY ALL),
m AS (SELECT a.n, sum(least(a.c, coalesce(b.c, 0))) AS hit, sum(a.c) AS al FROM (SELECT * FROM g WHERE side = 'p') a LEFT JOIN (SELECT * FROM g WHERE side = 'r') b USING (conv_id, turn, n, g) GROUP BY a.n)
SELECT round(CASE WHEN count(*) = 4 AND min(hit) > 0 THEN (SELECT CASE WHEN sum(len(p)) > sum(len(r)) THEN 1 ELSE exp(1 - sum(len(r))::DOUBLE / sum(len(p))) END FROM h) * exp(sum(ln(hit::DOUBLE / al)) / 4) ELSE 0 END, 6)::DOUBLE AS bleu FROM m""")
def _(t, spark):
    rows = t("conversations").select("text", F.regexp_replace("text", "the", "a").alias("other"))
    return O.corpus_bleu(rows, F.col("other"), F.col("text")).select(r6(F.col("bleu")).alias("bleu"))
