"""Queries over statements, vocabularies and masks; tables stand in for a knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import python as P
from lexiforge.functions import text as X
from lexiforge.operators import knowledge as G
from lexiforge.operators import models as M
from lexiforge.operators import oov as V
from lexiforge.plans.common import ASCII_SQL, query
from lexiforge.streaming import rowlocal


@query("kb_closure", """WITH RECURSIVE c(term) AS (SELECT '7' UNION SELECT p_partkey::VARCHAR FROM part JOIN c ON (p_partkey // 10)::VARCHAR = c.term WHERE p_partkey > 0) SELECT term FROM c""")
def _(t, spark):
    edges = t("part").select(F.floor(F.col("p_partkey") / 10).cast("string").alias("parent"), F.col("p_partkey").cast("string").alias("child"))
    return G.closure(edges, "7")


def _statements(t):
    in_region = t("nation").select(F.lit("nation.kif").alias("file"), F.lit("subclass").alias("relation"), F.array("n_name", F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).alias("args"))
    named = t("region").select(F.lit("region.kif").alias("file"), F.lit("instance").alias("relation"), F.array(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), F.lit("?X"), "r_name").alias("args"))
    return in_region.unionByName(named)


@query("kb_relations", "SELECT 'nation.kif' AS file, n_name || ' R' || n_regionkey AS args FROM nation WHERE n_regionkey = 1")
def _(t, spark):
    return G.with_term(_statements(t), "R1", "subclass").select("file", F.array_join("args", " ").alias("args"))


@query("kb_exists", "SELECT n_name AS term FROM nation UNION SELECT r_name FROM region UNION SELECT 'R' || r_regionkey FROM region")
def _(t, spark):
    asked = t("nation").select(F.col("n_name").alias("term")).union(t("region").select("r_name")).union(spark.range(9).select(F.concat(F.lit("R"), "id")))
    return G.exists(_statements(t), asked)


@query("kb_instances", "SELECT 'R' || r_regionkey AS term FROM region")
def _(t, spark):
    return G.is_instance(_statements(t), spark.range(9).select(F.concat(F.lit("R"), "id").alias("term")))


@query("kb_downward", "SELECT 'R' || n_regionkey AS term, count(*) + 1 AS n FROM nation WHERE n_regionkey = 2 GROUP BY n_regionkey")
def _(t, spark):
    found = G.closure(G.downward_edges(_statements(t)), "R2")
    return found.agg(F.count("*").alias("n")).select(F.lit("R2").alias("term"), "n")


_KNOWN = f"(SELECT DISTINCT unnest(regexp_extract_all({ASCII_SQL}, '[a-zA-Z_]+')) AS term FROM benchmark)"
_PLAIN = f"regexp_replace({ASCII_SQL}, '[^a-zA-Z ]', ' ', 'g')"


def _known(t):
    return t("benchmark").select(F.explode(F.regexp_extract_all(X.ascii_only(F.col("text")), F.lit("[a-zA-Z_]+"), F.lit(0))).alias("term")).distinct()


def _plain(t):
    return t("documents").select(F.col("doc_id").alias("row_id"), F.regexp_replace(X.ascii_only(F.col("text")), "[^a-zA-Z ]", " ").alias("text"))


@query("coverage_stats", f"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex({_PLAIN}, ' +'), lambda x: x <> '' AND NOT list_contains(['subclass','relation','subrelation','instance','and','or','xor','exists','forall','not','Now','equal'], x))) AS term FROM documents),
j AS (SELECT w.*, k.term IS NULL AS miss FROM w LEFT JOIN {_KNOWN} k ON k.term = w.term)
SELECT count(DISTINCT term) AS unique_terms, round(100.0 * count(DISTINCT term) FILTER (WHERE miss) / count(DISTINCT term), 2) AS pct_unique_unknown, count(*) AS total_terms, round(100.0 * count(*) FILTER (WHERE miss) / count(*), 2) AS pct_all_unknown,
 (SELECT count(*) FROM documents) AS total_lines, count(DISTINCT doc_id) FILTER (WHERE miss) AS unknown_lines, round(100.0 * count(DISTINCT doc_id) FILTER (WHERE miss) / (SELECT count(*) FROM documents), 2) AS pct_lines_unknown FROM j""")
def _(t, spark):
    return G.coverage(_plain(t), X.checked_terms(F.col("text")), _known(t))


@query("first_unknown", f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex({_PLAIN}, ' +'), lambda x: x <> '' AND NOT list_contains(['subclass','relation','subrelation','instance','and','or','xor','exists','forall','not','Now','equal'], x)) AS w FROM documents),
o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM d), e AS (SELECT doc_id, i, w[i] AS term FROM o WHERE w[i] NOT IN (SELECT term FROM {_KNOWN})), f AS (SELECT term, min(doc_id * 10000000 + i) AS first FROM e GROUP BY term)
SELECT term, first // 10000000 AS row_id FROM f ORDER BY first LIMIT 50""")
def _(t, spark):
    return G.first_unknown(_plain(t), X.checked_terms(F.col("text")), _known(t), 50)


@query("type_check", """WITH p AS (SELECT p_partkey, unnest(['instance ' || replace(p_brand, '#', ''), p_type]) AS s FROM part) SELECT p_partkey AS row_id,
 "missing" FROM (SELECT p_partkey, string_agg(w, ', ' ORDER BY i) AS missing FROM (SELECT p_partkey, unnest(list_filter(regexp_extract_all(replace(p_brand, '#', '') || ' ' || p_type, '\\w+'), lambda x: true)) AS w, unnest(range(len(regexp_extract_all(replace(p_brand, '#', '') || ' ' || p_type, '\\w+')))) AS i FROM part)
 WHERE w NOT IN (SELECT unnest(string_split(p_type, ' ')) FROM part WHERE p_partkey % 7 = 0) GROUP BY p_partkey)""")
def _(t, spark):
    phrases = t("part").select(F.col("p_partkey").alias("row_id"), F.concat_ws(" ", "p_brand", "p_type").alias("statement"))
    known = t("part").where("p_partkey % 7 = 0").select(F.explode(F.split("p_type", " ")).alias("word"), F.lit("part.kif").alias("file"))
    return G.type_check(phrases, known).where("missing <> 'None'").select("row_id", "missing")


@query("syntax_statistics", "SELECT count(*) AS total_lines, count(*) FILTER (WHERE len(replace(text, '(', '')) <> len(replace(text, ')', ''))) AS lines_with_errors, round(100.0 * count(*) FILTER (WHERE len(replace(text, '(', '')) <> len(replace(text, ')', ''))) / count(*), 2) AS pct_errors FROM documents")
def _(t, spark):
    docs = t("documents")
    return G.syntax_statistics(docs, docs.where(~X.balanced(F.col("text"))).select(F.col("doc_id").alias("line_num")))


# the name itself and the numbers 1, 4, 7, ... behind it are taken, so the r-th row gets 2, 3, 5, 6, 8, ...
@query("term_names", "SELECT p_partkey, p_brand || '-' || (3 * ((r - 1) // 2) + 2 + (r - 1) % 2) AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def _(t, spark):
    rows = t("part").select("p_partkey", F.concat("p_brand", F.lit("-")).alias("base"))
    free = rows.groupBy("base").agg(F.count("*").alias("n"))
    taken = free.select(F.col("base").alias("term")).union(free.select(F.explode(F.expr("transform(sequence(0, n), i -> concat(base, string(3 * i + 1)))"))))
    return G.numbered_names(rows, "base", "p_partkey", taken).select("p_partkey", F.col("unique").alias("name"))


@query("part_names", "SELECT p_partkey, p_brand || '-' || CASE WHEN r = 1 THEN '' ELSE (r - 1)::VARCHAR END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def _(t, spark):
    return G.numbered_names(t("part").select("p_partkey", F.concat("p_brand", F.lit("-")).alias("base")), "base", "p_partkey").select("p_partkey", F.col("unique").alias("name"))


@query("new_formats", "SELECT DISTINCT p_brand AS term, p_type AS phrase FROM part EXCEPT SELECT p_brand, p_type FROM part WHERE p_size < 25")
def _(t, spark):
    rows = t("part").select(F.col("p_brand").alias("term"), F.col("p_type").alias("phrase"), "p_size")
    return G.new_term_formats(rows, rows.where("p_size < 25"))


# ---- masks: every word is taken for a noun, the benchmark's words are known ----

_TOKENS = f"t AS (SELECT doc_id AS sentence_id, unnest(range(1, len(w) + 1)) - 1 AS pos, w FROM (SELECT doc_id, list_filter(string_split_regex({_PLAIN}, ' +'), lambda x: x <> '') AS w FROM documents)), k AS (SELECT sentence_id, pos, w[pos + 1] AS word FROM t)"
_WORDS = f"u AS (SELECT sentence_id, word, min(pos) AS first FROM k WHERE lower(word) NOT IN (SELECT lower(term) FROM {_KNOWN}) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY sentence_id ORDER BY first) AS id FROM u)"


def _tokens(t):
    each = _plain(t).select(F.col("row_id").alias("sentence_id"), F.posexplode(X.words(F.col("text"))).alias("pos", "text"))
    tokens = each.select("sentence_id", "pos", "text", F.col("text").alias("lemma"), F.lit("NOUN").alias("upos"))
    return V.unknown_tokens(tokens, _known(t).select(F.col("term").alias("root"), F.lit("noun").alias("pos")))


@query("oov_unknown_words", f"WITH {_TOKENS}, {_WORDS} SELECT sentence_id, 'noun' AS type, word, id FROM n")
def _(t, spark):
    return V.unknown_words(_tokens(t)).select("sentence_id", "type", "word", F.col("id").cast("long").alias("id"))


@query("oov_mask_ids", f"WITH {_TOKENS}, {_WORDS} SELECT k.sentence_id, md5(string_agg(coalesce('UNK_noun_' || n.id, k.word), ' ' ORDER BY k.pos)) AS text FROM k LEFT JOIN n ON n.sentence_id = k.sentence_id AND n.word = k.word GROUP BY k.sentence_id")
def _(t, spark):
    return V.masked(_tokens(t))[0].select("sentence_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("oov_largest_id", f"WITH {_TOKENS}, {_WORDS} SELECT sentence_id, 'noun' AS type, max(id) AS max_id FROM n GROUP BY sentence_id")
def _(t, spark):
    return V.largest_id(V.unknown_words(_tokens(t))).select("sentence_id", "type", F.col("max_id").cast("long").alias("max_id"))


@query("oov_unmask", f"WITH {_TOKENS} SELECT sentence_id, md5(string_agg(word, ' ' ORDER BY pos)) AS text FROM k GROUP BY sentence_id")
def _(t, spark):
    hidden, words = V.masked(_tokens(t))
    lines = hidden.select("sentence_id", F.col("sentence_id").alias("line_num"), "text")
    return V.unmasked(lines, words)[0].select("sentence_id", F.md5(F.col("text").cast("binary")).alias("text"))


@query("oov_axioms", """SELECT w AS word, type, CASE type WHEN 'PERSON' THEN '( and ( instance ' || w || ' Human ) (names "' || w || '" ' || w || ' ) )' ELSE '( instance ' || w || ' Organization )' END AS value
FROM (SELECT DISTINCT replace(c_name, '#', '_') AS w, CASE c_nationkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' END AS type FROM customer) WHERE type IS NOT NULL""")
def _(t, spark):
    words = t("customer").select((F.col("c_custkey") % 40).alias("sentence_id"), F.element_at(F.array(F.lit("PERSON"), F.lit("ORG"), F.lit("DATE")), F.col("c_nationkey") % 3 + 1).alias("type"), F.col("c_custkey").cast("int").alias("id"), F.col("c_name").alias("word"))
    lines = words.select("sentence_id", F.col("id").alias("line_num"), F.format_string("(p UNK_%s_%d)", "type", "id").alias("text"))
    return V.axioms(V.unmasked(lines, words)[1]).select("word", "type", "value")


@query("snapped_words", r"""WITH p AS (SELECT doc_id, string_split(text, ' ') AS ws, length(text) AS n FROM documents), u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM p),
w AS (SELECT doc_id, word, (sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(word) - 1)::BIGINT AS start FROM u), h AS (SELECT doc_id, unnest(range(0, n, 37)) AS place FROM p)
SELECT doc_id, w.start, regexp_replace(word, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g') AS word FROM w JOIN h USING (doc_id) WHERE place >= w.start AND place < w.start + length(word) GROUP BY ALL""")
def _(t, spark):
    parts = F.split("text", " ", -1)
    words = t("documents").select(F.col("doc_id").alias("sentence_id"), F.explode(F.arrays_zip(parts.alias("word"), P.starts(F.transform(parts, F.length)).alias("start"))).alias("x")).select("sentence_id", "x.word", "x.start")
    hits = t("documents").where("length(text) > 0").select(F.col("doc_id").alias("sentence_id"), F.explode(F.expr("sequence(0L, length(text) - 1L, 37L)")).alias("at"))
    return V.snapped_join(words, hits).select(F.col("sentence_id").alias("doc_id"), "start", "word")


@query("tagged_tokens")
def _(t, spark):
    return M.tagged(t("benchmark").select(F.col("item_id").alias("sentence_id"), "text"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t, spark):
    return rowlocal.event_counts(t("events")).withColumn("total", F.round("total", 4))


@query("resolved_sentences", r"""WITH RECURSIVE s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
r(conv_id, i, done) AS (SELECT conv_id, least(2, any_value(n)), list_filter(string_split(replace(string_agg(text, ' ' ORDER BY i), chr(10), ' '), '. '), lambda x: trim(x) <> '') FROM s WHERE i <= 2 GROUP BY conv_id
 UNION ALL SELECT r.conv_id, s.i, CASE WHEN len(done) > 0 AND len(list_filter(string_split(replace(done[-1] || ' ' || text, chr(10), ' '), '. '), lambda x: trim(x) <> '')) = 2
  THEN list_append(done, list_filter(string_split(replace(done[-1] || ' ' || text, chr(10), ' '), '. '), lambda x: trim(x) <> '')[2]) ELSE done END FROM r JOIN s ON s.conv_id = r.conv_id AND s.i = r.i + 1)
SELECT conv_id, (unnest(range(1, len(done) + 1)) - 1)::INT AS ord, unnest(done) AS text FROM (SELECT conv_id, arg_max(done, i) AS done FROM r GROUP BY conv_id)""")
def _(t, spark):
    rows = t("conversations").select("conv_id", "turn", "text")
    return M.resolved(rows, "conv_id", "turn", "text", lambda s: s, lambda s: [x for x in s.replace("\n", " ").split(". ") if x.strip()])


@query("metaphor_candidates", """WITH c AS (SELECT text, a, u, unnest([u, text[1:a + 5]]) AS candidate, unnest([0, 1]) AS j FROM (SELECT text, replace(upper(text), 'ẞ', 'SS') AS u FROM benchmark), range(4) AS z(a) WHERE a = 0 OR length(u) % 3 = 2)
SELECT text AS sentence, (2 * a + j)::INT AS ord, candidate, CASE WHEN u = candidate THEN 1.0 ELSE 0.1 END::DOUBLE AS score, (length(candidate) % 3)::INT AS met_count, 1 AS allowed FROM c""")
def _(t, spark):
    rows = t("benchmark").select(F.col("text").alias("sentence"), F.lit(6).alias("met_count"))
    return M.metaphor_rewrites(rows, lambda s, k: {"1": s.upper(), "2": s[: k + 5]}, lambda s: len(s) % 3, lambda a, b: 1.0 if a.upper() == b else 0.1)
