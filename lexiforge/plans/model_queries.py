"""Queries of models that are counted from the tables: the word model and what it says of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexiforge.functions import sequences as N
from lexiforge.functions import text as X
from lexiforge.operators import decoding, gramcells, ngrams, pieces, tagging
from lexiforge.operators.stored import shared_folder
from lexiforge.plans.common import WORDS_SQL, query, r6
from lexiforge.sources import batches, tokenised


def _ngram_sql(order: int) -> str:
    """Tables of a word model of documents: c1.. (counts), p1.. (gram, p), g2.. (context, rest, top), and u (unknown, best)."""
    off = "CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"
    each = lambda k: f"CASE WHEN n1 > 0 AND n2 > 0 AND n3 > 0 THEN least(greatest({k} - {k + 1} * (n1 / (n1 + 2 * n2)) * n{k + 1} / n{k}, 0), {k}) ELSE {(0.5, 1.0, 1.5)[k - 1]} END AS d{k}"
    parts = [
        f"t AS (SELECT doc_id, list_concat({['']* (order - 1)!r}, {WORDS_SQL}) AS ws FROM documents)",
        f"k AS (SELECT doc_id, i, ws[i:i + {order - 1}] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {order - 2})) AS i FROM t))",
        f"c{order} AS (SELECT gram, count(*) AS n FROM k GROUP BY gram)",
    ]
    parts += [f"c{k} AS (SELECT gram[2:] AS gram, count(*) AS n FROM c{k + 1} GROUP BY 1)" for k in range(order - 1, 0, -1)]
    for k in range(1, order + 1):
        parts.append(f"q{k} AS (SELECT {', '.join(f'count(*) FILTER (n = {j})::DOUBLE AS n{j}' for j in (1, 2, 3, 4))} FROM c{k})")
        parts.append(f"d{k} AS (SELECT {', '.join(map(each, (1, 2, 3)))} FROM q{k})")
        parts.append(f"o{k} AS (SELECT gram, gram[:len(gram) - 1] AS context, n, {off} AS lost FROM c{k}, d{k})")
        parts.append(f"s{k} AS (SELECT context, sum(n) AS total, sum(lost) / sum(n) AS rest FROM o{k} GROUP BY context)")
        if k == 1:
            parts.append("w AS (SELECT (SELECT rest FROM s1) / ((SELECT count(*) FROM c1) + 1) AS unknown)")
            parts.append("p1 AS (SELECT gram, (n - lost) / total + unknown AS p FROM o1, s1, w)")
            parts.append("u AS (SELECT unknown, (SELECT max(p) FROM p1) AS best FROM w)")
        else:
            parts.append(f"f{k} AS (SELECT o.gram, o.context, (n - lost) / total + rest * b.p AS p FROM o{k} o JOIN s{k} USING (context) JOIN p{k - 1} b ON b.gram = o.gram[2:])")
            parts.append(f"p{k} AS (SELECT gram, p FROM f{k})")
            low = "u.best" if k == 2 else "coalesce(b.top, u.best)"
            above = "" if k == 2 else f" LEFT JOIN g{k - 1} b ON b.context = s.context[2:]"
            parts.append(f"g{k} AS (SELECT s.context, s.rest, greatest(seen, s.rest * {low}) AS top FROM s{k} s JOIN (SELECT context, max(p) AS seen FROM f{k} GROUP BY context) m ON m.context = s.context CROSS JOIN u{above})")
    return "WITH " + ",\n".join(parts)


_FEATURES = """len(v)::DOUBLE AS n_tokens, round(list_avg(v), 6) AS avg_nll, round(list_sort(v)[floor(0.95 * (len(v) - 1))::INT + 1], 6) AS p95, round(list_max(v), 6) AS max_surp,
 round(len(list_filter(v, lambda x: x > 3.5))::DOUBLE / len(v), 6) AS spike_frac_35, round(list_avg(tops), 6) AS top1_prob_mean, round(list_avg(tops) - list_avg(list_transform(v, lambda x: exp(-x))), 6) AS top1_minus_true_mean"""


def _features(scored, key):
    f = N.surprise(F.col("nll"))
    true = F.transform("nll", lambda x: F.exp(-x))
    named = [f["n_tokens"].alias("n_tokens"), *[r6(f[c]).alias(c) for c in ("avg_nll", "p95", "max_surp", "spike_frac_35")]]
    return scored.where("nll is not null").select(key, *named, r6(N.top_mean(F.col("top"))).alias("top1_prob_mean"), r6(N.top_gap(F.col("top"), true)).alias("top1_minus_true_mean"))


@query("ngram_surprise", f"""{_ngram_sql(3)},
v AS (SELECT doc_id, list(-ln(p) ORDER BY i) AS v, list(top ORDER BY i) AS tops FROM k JOIN p3 USING (gram) JOIN g3 ON g3.context = gram[:2] WHERE i > 1 GROUP BY doc_id)
SELECT doc_id, {_FEATURES} FROM v""")
def _(t, spark):
    return _features(gramcells.scored(t("documents"), "doc_id", X.words(F.col("text"))), "doc_id")


@query("ngram_foreign", f"""{_ngram_sql(2)},
b AS (SELECT item_id, i, ws[i - 1:i] AS gram FROM (SELECT item_id, ws, unnest(range(2, len(ws) + 1)) AS i FROM (SELECT item_id, {WORDS_SQL} AS ws FROM benchmark))),
x AS (SELECT item_id, i, coalesce(p2.p, coalesce(g2.rest, 1) * coalesce(p1.p, u.unknown)) AS p, coalesce(g2.top, u.best) AS top FROM b CROSS JOIN u LEFT JOIN p2 ON p2.gram = b.gram LEFT JOIN g2 ON g2.context = b.gram[:1] LEFT JOIN p1 ON p1.gram = b.gram[2:]),
v AS (SELECT item_id, list(-ln(p) ORDER BY i) AS v, list(top ORDER BY i) AS tops FROM x GROUP BY item_id)
SELECT item_id, {_FEATURES} FROM v""")
def _(t, spark):
    model = ngrams.trained(t("documents"), X.words(F.col("text")), 2)
    items = t("benchmark").select("item_id", X.words(F.col("text")).alias("words"))
    return _features(ngrams.scored(items, "item_id", F.col("words"), model), "item_id")


#: A token's tag in these queries: the document's language and how the word begins.
_BEGINS = "CASE WHEN regexp_matches(w, '^[A-Z]') THEN 'A' WHEN regexp_matches(w, '^[a-z]') THEN 'a' ELSE '0' END"
_TOKENS_SQL = f"""t AS (SELECT doc_id, lang, {WORDS_SQL} AS ws FROM documents), k AS (SELECT doc_id, lang, i, ws[i] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM t)),
y AS (SELECT doc_id, i, w, lang || '-' || {_BEGINS} AS tag FROM k WHERE lang IS NOT NULL)"""
_MOVES_SQL = "m AS (SELECT lag(tag) OVER (PARTITION BY doc_id ORDER BY i) AS before, tag FROM y)"


def _begins(word):
    first = F.substring(word, 1, 1)
    return F.when(first.between("A", "Z"), "A").when(first.between("a", "z"), "a").otherwise("0")


def _tokens(t, spark):
    words = t("documents").select("doc_id", "lang", F.posexplode(X.words(F.col("text"))).alias("pos", "word"))
    return words.select(F.col("doc_id").alias("sentence_id"), "pos", "word", F.concat("lang", F.lit("-"), _begins(F.col("word"))).alias("tag"), "lang")


@query("tag_transitions", f"WITH {_TOKENS_SQL}, {_MOVES_SQL} SELECT before, tag, count(*) AS n FROM m GROUP BY ALL")
def _(t, spark):
    return tagging.transitions(_tokens(t, spark).where("lang is not null"))


_LEVELS_SQL = ", ".join(
    f"l{k} AS (SELECT c.ending, c.j, (c.n / c.total + th.theta * b.p) / (1 + th.theta) AS p FROM c{k} c JOIN l{k - 1} b ON b.ending = right(c.ending, {k - 1}) AND b.j = c.j CROSS JOIN th)" for k in range(1, 5)
)
_COUNTS_SQL = ", ".join(
    f"c{k} AS (SELECT g.ending, n.j, coalesce(x.n, 0)::DOUBLE AS n, g.total FROM (SELECT right(w, {k}) AS ending, sum(n)::DOUBLE AS total FROM rare WHERE length(w) >= {k} GROUP BY 1) g CROSS JOIN n "
    f"LEFT JOIN (SELECT right(w, {k}) AS ending, j, sum(n) AS n FROM rare WHERE length(w) >= {k} GROUP BY 1, 2) x ON x.ending = g.ending AND x.j = n.j)" for k in range(1, 5)
)


@query("tagged_paths", f"""WITH {_TOKENS_SQL}, {_MOVES_SQL}, n AS (SELECT tag, row_number() OVER (ORDER BY tag) AS j, c AS of_tag, c / sum(c) OVER () AS prior FROM (SELECT tag, count(*)::DOUBLE AS c FROM y GROUP BY tag)),
e AS (SELECT w, j, c, sum(c) OVER (PARTITION BY w) AS of_word, ln(c / of_tag) AS score FROM (SELECT w, tag, count(*) AS c FROM y GROUP BY ALL) JOIN n USING (tag)),
v AS (SELECT a.j AS a, b.j AS b, ln((coalesce(x.n, 0) + 0.1) / (coalesce(s.n, 0) + 0.1 * (SELECT count(*) FROM n))) AS move FROM (SELECT j, tag FROM n UNION ALL SELECT 0, NULL) a CROSS JOIN n b
 LEFT JOIN (SELECT before, tag, count(*) AS n FROM m GROUP BY ALL) x ON x.before IS NOT DISTINCT FROM a.tag AND x.tag = b.tag LEFT JOIN (SELECT before, count(*) AS n FROM m GROUP BY ALL) s ON s.before IS NOT DISTINCT FROM a.tag),
mv AS (SELECT list(r ORDER BY b) FILTER (WHERE b > 0) AS moves FROM (SELECT b, list(move ORDER BY a) FILTER (WHERE a > 0) AS r FROM v GROUP BY b)), st AS (SELECT list(move ORDER BY b) AS first FROM v WHERE a = 0),
th AS (SELECT stddev_samp(prior) AS theta FROM n), rare AS (SELECT lower(w) AS w, j, c AS n FROM e WHERE of_word <= 10), l0 AS (SELECT '' AS ending, j, prior AS p FROM n), {_COUNTS_SQL}, {_LEVELS_SQL},
en AS (SELECT ending, j, ln(l.p / prior) AS score FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4) l JOIN n USING (j)),
nw AS (SELECT DISTINCT w FROM k WHERE w NOT IN (SELECT w FROM e)), be AS (SELECT w, arg_max(ending, length(ending)) AS ending FROM (SELECT w, right(lower(w), unnest([0, 1, 2, 3, 4])) AS ending FROM nw) JOIN (SELECT DISTINCT ending FROM en) USING (ending) GROUP BY w),
o AS (SELECT w, j, score, true AS known FROM e UNION ALL SELECT w, j, score, false FROM be JOIN en USING (ending)),
ov AS (SELECT u.w, u.known, list(coalesce(o.score, '-Infinity'::DOUBLE) ORDER BY n.j) AS s FROM (SELECT DISTINCT w, known FROM o) u CROSS JOIN n LEFT JOIN o ON o.w = u.w AND o.j = n.j GROUP BY u.w, u.known),
d AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE known) AS n_known, list(s ORDER BY i) AS path FROM k JOIN ov ON ov.w = k.w GROUP BY doc_id)
SELECT doc_id, n_words, n_known, round(list_max(list_reduce(path[2:], lambda acc, x: list_transform(moves, lambda r, b: x[b] + list_max(list_transform(r, lambda y, a: y + acc[a]))), list_transform(first, lambda y, a: y + path[1][a]))), 3) AS score FROM d, mv, st""")
def _(t, spark):
    made = pieces.pieces(t("documents"), F.col("doc_id"), X.words(F.col("text")))
    if pieces.repeated(made):  # the words of texts with one id are one sentence
        tokens = _tokens(t, spark)
        tagger = tagging.trained(tokens.where("lang is not null"))
        done = tagging.tagged_sentences(tokens.select("sentence_id", "pos", "word"), tagger).withColumnRenamed("sentence_id", "key")
    else:
        texts = t("documents").where("doc_id is not null and lang is not null").select("lang", X.words(F.col("text")).alias("words"))
        links = tagging.text_transitions(texts, F.transform("words", lambda w: F.concat("lang", F.lit("-"), _begins(w))))
        done = tagging.tagged_pieces(made, tagging.trained(_tokens(t, spark).where("lang is not null"), links))
    known = F.size(F.filter("known", lambda x: x)).cast("long")
    return done.select(F.col("key").alias("doc_id"), F.size("words").cast("long").alias("n_words"), known.alias("n_known"), F.round("score", 3).alias("score"))


@query("word_batches", f"SELECT w AS root, lang AS pos, min(doc_id % 2)::INT AS batch FROM (SELECT doc_id, lang, unnest({WORDS_SQL}) AS w FROM documents) GROUP BY ALL")
def _(t, spark):
    table = batches.words_table(spark, f"{shared_folder(spark)}/words-{uuid.uuid4().hex}")
    words = t("documents").select("doc_id", F.explode(X.words(F.col("text"))).alias("root"), F.col("lang").alias("pos"))
    batches.add_words(table, words.where("doc_id % 2 = 0"), 0)
    batches.add_words(table, words, 0)  # again: nothing happens
    batches.add_words(table, words, 1)
    return table.read().select("root", "pos", "batch")


@query("unknown_batches", f"""WITH k AS (SELECT conv_id, role, lower(ws[i]) AS word, turn % 2 AS b, turn * 100000 + i AS pos FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, {WORDS_SQL} AS ws FROM conversations))),
f AS (SELECT conv_id, role, word, min(b) AS batch FROM k GROUP BY ALL), p AS (SELECT f.*, min(pos) AS first FROM f JOIN k USING (conv_id, role, word) WHERE b = batch GROUP BY ALL)
SELECT conv_id AS sentence_id, role AS type, word, row_number() OVER (PARTITION BY conv_id, role ORDER BY batch, first, word)::INT AS id, batch::INT AS batch FROM p""")
def _(t, spark):
    table = batches.unknown_table(spark, f"{shared_folder(spark)}/unknown-{uuid.uuid4().hex}")
    words = t("conversations").select(F.col("conv_id").alias("sentence_id"), F.col("role").alias("type"), "turn", F.posexplode(X.words(F.col("text"))).alias("i", "word"))
    tokens = words.withColumn("pos", F.col("turn") * 100000 + F.col("i"))
    for batch in (0, 1, 0):
        batches.add_unknown_words(table, tokens.where(F.col("turn") % 2 == batch), batch)
    return table.read().select("sentence_id", "type", "word", "id", "batch")


@query("tokenised_rows", """SELECT doc_id, len(c)::BIGINT AS n, coalesce(list_sum(c), 0)::BIGINT AS total FROM (SELECT doc_id, list_transform(regexp_extract_all(left(text, 50), '(?s).'), lambda x: unicode(x)) AS c FROM documents JOIN labels USING (doc_id))""")
def _(t, spark):
    path = f"{shared_folder(spark)}/tokenised-{uuid.uuid4().hex}"
    rows = t("documents").where("doc_id is not null").select(F.col("doc_id").alias("row_id"), "text")
    tokenised.write(tokenised.encoded(rows, {"text": "ids"}, lambda texts: [[ord(c) for c in x] for x in texts], most=50), path, span=1000)
    got = tokenised.where(spark, path, t("labels").select(F.col("doc_id").alias("row_id")), span=1000)
    return got.select(F.col("row_id").alias("doc_id"), F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("next_tokens", f"""WITH RECURSIVE terms AS (SELECT DISTINCT unnest({WORDS_SQL}) AS t FROM benchmark), words AS (SELECT DISTINCT unnest({WORDS_SQL}) AS w FROM documents), lens AS (SELECT DISTINCT length(t) AS k FROM terms),
r(w, e) AS (SELECT w, 0::BIGINT FROM words UNION SELECT r.w, r.e + k FROM r JOIN lens ON r.e + k <= length(r.w) JOIN terms ON t = substr(r.w, r.e + 1, k)),
x AS (SELECT DISTINCT w, substr(t, length(w) - e + 1, 1) AS nx FROM r JOIN (SELECT t, substr(t, 1, j) AS start, j FROM (SELECT t, unnest(range(0, length(t))) AS j FROM terms)) p ON start = substr(w, e + 1) AND length(w) - e = j)
SELECT w AS word, coalesce(n, 0)::BIGINT AS n_next, e IS NOT NULL AS ends FROM words LEFT JOIN (SELECT w, count(*) AS n FROM x GROUP BY w) USING (w) LEFT JOIN (SELECT DISTINCT w, e FROM r WHERE e = length(w)) USING (w)""")
def _(t, spark):
    letters = lambda rows: rows.select(F.explode(X.words(F.col("text"))).alias("word")).distinct().withColumn("tokens", F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))
    terms = letters(t("benchmark"))
    done = decoding.following(letters(t("documents")), "word", "tokens", decoding.trie(terms), decoding.longest(terms))
    return done.select("word", F.size("next").cast("long").alias("n_next"), "ends")
