"""Queries over texts: terms, formats, shapes, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import python as P
from lexiforge.functions import sequences as N
from lexiforge.functions import text as X
from lexiforge.operators import pairs as O
from lexiforge.plans.common import ASCII_SQL, TERMS_SQL, WORDS_SQL, query, r6


@query("term_counts", f"WITH t AS (SELECT unnest({TERMS_SQL}) AS term FROM documents) SELECT term, count(*) AS count FROM t GROUP BY term")
def _(t, spark):
    docs = t("documents").select("doc_id", X.ascii_only(F.col("text")).alias("text"))
    return O.term_counts(O.term_rows(docs, X.logic_terms(F.col("text")), "doc_id"))


@query(
    "term_first_seen",
    f"""WITH d AS (SELECT doc_id, {TERMS_SQL} AS terms FROM documents),
t AS (SELECT doc_id, unnest(range(1, len(terms) + 1)) AS pos, terms FROM d), o AS (SELECT doc_id, pos, terms[pos] AS term FROM t),
f AS (SELECT term, count(*) AS count, min(doc_id * 10000000 + pos) AS first FROM o WHERE NOT starts_with(term, 'UNK') GROUP BY term)
SELECT term, row_number() OVER (ORDER BY first) AS id, count FROM f""",
)
def _(t, spark):
    docs = t("documents").select("doc_id", X.ascii_only(F.col("text")).alias("text"))
    return O.term_ids(O.term_rows(docs, X.named_terms(F.col("text")), "doc_id"), "doc_id")


@query(
    "complexity_hist",
    f"WITH b AS (SELECT least(len({TERMS_SQL}) // 5, 7)::INT AS bin FROM documents), z AS (SELECT range::INT AS bin FROM range(8)) SELECT z.bin, count(b.bin) AS n FROM z LEFT JOIN b USING (bin) GROUP BY z.bin",
)
def _(t, spark):
    return O.complexity_histogram(t("documents").select(X.ascii_only(F.col("text")).alias("text")), X.logic_terms(F.col("text")))


@query("complexity_bin_rows", f"SELECT doc_id, least(len({TERMS_SQL}) // 5, 7)::INT AS bin FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", X.complexity_bin(X.logic_terms(X.ascii_only(F.col("text")))).alias("bin"))


@query("prompt_terms", r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '"[^"]*"', '', 'g'), '[\s()]+'), lambda x: x <> '' AND NOT starts_with(x, '?')
  AND NOT list_contains(['now','instance','subclass','exists','forall','relation','subrelation','attribute','and','or','xor','not','=>'], lower(x))))::BIGINT AS n FROM documents""")
def _(t, spark):
    return t("documents").select("doc_id", F.size(X.prompt_terms(F.col("text"))).cast("long").alias("n"))


@query("checked_terms", r"""SELECT doc_id, len(list_filter(string_split_regex(trim(translate(regexp_replace(text, '"(?:[^"\\]|\\.)*"', ' ', 'g'), '()', '  ')), '\s+'), lambda x: x <> '' AND NOT starts_with(x, '?') AND NOT starts_with(x, 'UNK_')
  AND NOT regexp_full_match(x, '[0-9]+') AND NOT list_contains(['subclass','relation','subrelation','instance','and','or','xor','exists','forall','=>','not','Now','equal'], x)))::BIGINT AS n FROM documents""")
def _(t, spark):
    return t("documents").select("doc_id", F.size(X.checked_terms(F.col("text"))).cast("long").alias("n"))


@query("known_terms", f"""WITH k AS (SELECT list(DISTINCT w) AS known FROM (SELECT unnest(regexp_extract_all({ASCII_SQL}, '[a-zA-Z_]+')) AS w FROM benchmark))
SELECT doc_id, len(list_intersect(list_distinct({TERMS_SQL}), known))::BIGINT AS n FROM documents, k""")
def _(t, spark):
    word = F.explode(F.regexp_extract_all(X.ascii_only(F.col("text")), F.lit("[a-zA-Z_]+"), F.lit(0)))
    # the known-term set is the benchmark's, a table of bounded size by its role
    known = t("benchmark").select(word.alias("w")).distinct()
    each = t("documents").select("doc_id", F.explode(F.array_distinct(X.logic_terms(X.ascii_only(F.col("text"))))).alias("w"))
    hit = each.join(known, "w").groupBy("doc_id").agg(F.count("*").alias("n"))
    return t("documents").select("doc_id").join(hit, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("word_format", r"""WITH w AS (SELECT p_partkey, regexp_replace(regexp_replace(trim(p_name || ' #' || p_brand || ', 12!'), '[^a-zA-Z0-9,.!?\s]', '_', 'g'), '[,.!?]', '', 'g') AS p FROM part)
SELECT p_partkey, replace(CASE WHEN regexp_matches(p, '^[0-9]') THEN 'num_' || p ELSE p END, ' ', '_') AS word FROM w""")
def _(t, spark):
    return t("part").select("p_partkey", X.format_word(F.concat("p_name", F.lit(" #"), "p_brand", F.lit(", 12!"))).alias("word"))


@query("logic_spacing", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([()?])', ' \1 ', 'g'), ' +', ' ', 'g')) AS logic, md5(regexp_replace(replace(text, ',', ' , '), ' +', ' ', 'g')) AS english FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", F.md5(X.spaced_logic(F.col("text")).cast("binary")).alias("logic"), F.md5(X.spaced_english(F.col("text")).cast("binary")).alias("english"))


@query("mark_spacing", r"SELECT doc_id, md5(replace(replace(text, '? ', ' ?'), '?', ' ?')) AS marks, md5(regexp_replace(text, ' ([,.])', '\1', 'g')) AS attached, md5(regexp_replace(text, '\? +', '?', 'g')) AS joined FROM documents")
def _(t, spark):
    md5 = lambda f: F.md5(f(F.col("text")).cast("binary"))
    return t("documents").select("doc_id", md5(X.spaced_marks).alias("marks"), md5(X.attached_punctuation).alias("attached"), md5(X.joined_variables).alias("joined"))


@query("variable_names", """SELECT p_partkey, '(=> (p ?X1 ?X2) (q ?X2 ?X1 ?X3 ?X' || CASE WHEN p_size % 2 = 0 THEN '1' ELSE '4' END || '))' AS logic FROM part""")
def _(t, spark):
    a, b = F.concat(F.lit("?A"), F.col("p_size").cast("string")), F.concat(F.lit("?AB"), F.col("p_size").cast("string"))
    other = F.when(F.col("p_size") % 2 == 0, a).otherwise("?A")
    return t("part").select("p_partkey", X.numbered_variables(F.format_string("(=> (p %s %s) (q %s %s ?Z %s))", a, b, b, a, other)).alias("logic"))


@query("ner_category", """SELECT event_id, CASE event_type WHEN 'click' THEN 'SocialInteraction' WHEN 'view' THEN 'Human' WHEN 'purchase' THEN 'CurrencyMeasure' END AS term FROM events""")
def _(t, spark):
    kind = F.when(F.col("event_type") == "click", "EVENT").when(F.col("event_type") == "view", "PERSON").when(F.col("event_type") == "purchase", "MONEY").otherwise("DATE")
    return t("events").select("event_id", X.entity_term(kind).alias("term"))


@query("word_type", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'noun' WHEN n_nationkey % 4 = 1 THEN 'verb' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' WHEN 2 THEN 'noun-phrase' END AS older FROM nation")
def _(t, spark):
    tag = F.element_at(F.array(F.lit("NOUN"), F.lit("VERB"), F.lit("PROPN"), F.lit("ADJ")), F.col("n_nationkey") % 4 + 1)
    return t("nation").select("n_nationkey", X.word_type(tag).alias("kind"), X.word_type(tag, phrases=True).alias("older"))


@query("paren_balance", "SELECT doc_id, len(text) - len(replace(text, '(', '')) = len(text) - len(replace(text, ')', '')) AS balanced FROM documents")
def _(t, spark):
    return t("documents").select("doc_id", X.balanced(F.col("text")).alias("balanced"))


@query("reply_classify", "SELECT conv_id, turn, CASE WHEN contains(r, 'Invalid') THEN -1 WHEN contains(r, 'Valid') THEN 1 END AS verdict FROM (SELECT *, CASE role WHEN 'user' THEN 'Invalid ' || text WHEN 'assistant' THEN 'Valid ' || text ELSE text END AS r FROM conversations)")
def _(t, spark):
    reply = F.when(F.col("role") == "user", F.concat(F.lit("Invalid "), "text")).when(F.col("role") == "assistant", F.concat(F.lit("Valid "), "text")).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", X.verdict(reply).alias("verdict"))


@query("json_prop", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t, spark):
    return t("events").select("event_id", X.reply_field(F.col("props"), "k").alias("k"))


@query("unquoted_replies", "SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE turn % 2 = 0")
def _(t, spark):
    quoted = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), "text", F.lit('"'))).otherwise(F.col("text"))
    return t("conversations").where("not startswith(text, '\"')").select("conv_id", "turn", X.unquoted(quoted).alias("text")).where("text is not null")


@query("shape_features", r"""SELECT doc_id, round(coalesce(len(regexp_extract_all(text, '[!-/:-@\[-`{-~]'))::DOUBLE / nullif(length(text), 0), 0), 6) AS punct_ratio,
  round(coalesce(len(regexp_extract_all(text, '\p{Nd}'))::DOUBLE / nullif(length(text), 0), 0), 6) AS digit_ratio, round(coalesce(len(regexp_extract_all(text, '\p{Lu}'))::DOUBLE / nullif(length(text), 0), 0), 6) AS upper_ratio,
  abs(len(regexp_extract_all(text, '\(')) - len(regexp_extract_all(text, '\)')))::DOUBLE AS paren_imbalance_abs,
  (abs(len(regexp_extract_all(text, '\[')) - len(regexp_extract_all(text, '\]'))) + abs(len(regexp_extract_all(text, '\{')) - len(regexp_extract_all(text, '\}'))))::DOUBLE AS bracket_imbalance_abs FROM documents""")
def _(t, spark):
    return t("documents").select("doc_id", *[r6(c).alias(n) for n, c in X.shape(F.col("text")).items()])


@query("lexical_stats", f"WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS sentence_length, round(coalesce(len(list_distinct(w))::DOUBLE / nullif(len(w), 0), 0), 6) AS lexical_diversity, round(coalesce(len(w)::DOUBLE / nullif(list_sum(list_transform(w, lambda x: length(x))), 0), 0), 6) AS readability FROM w")
def _(t, spark):
    c = X.lexical(F.col("text"))
    return t("documents").select("doc_id", c["sentence_length"].cast("long").alias("sentence_length"), r6(c["lexical_diversity"]).alias("lexical_diversity"), r6(c["readability"]).alias("readability"))


@query("token_repetition", f"""WITH w AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w),
b AS (SELECT doc_id, w[i] AS a, w[i + 1] AS c FROM p), g AS (SELECT doc_id, a, c, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT doc_id, sum(CASE WHEN a = c THEN n ELSE 0 END) AS same, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS again FROM g GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN len(w) <= 1 THEN 1 ELSE round(len(list_distinct(w))::DOUBLE / len(w), 6) END::DOUBLE AS uniq_token_ratio,
  CASE WHEN len(w) <= 1 THEN 0 ELSE round(same::DOUBLE / (len(w) - 1), 6) END::DOUBLE AS rep_1gram, CASE WHEN len(w) <= 1 THEN 0 ELSE round(again::DOUBLE / (len(w) - 1), 6) END::DOUBLE AS rep_2gram FROM w LEFT JOIN s USING (doc_id)""")
def _(t, spark):
    return t("documents").select("doc_id", *[r6(c).alias(n) for n, c in N.repetition(X.words(F.col("text"))).items()])


_SEQ = "list_transform(embedding, lambda x: x::DOUBLE * 20)"


@query("seq_percentile", f"WITH s AS (SELECT vec_id, list_sort({_SEQ}) AS v FROM embeddings) SELECT vec_id, round(v[floor(0.95 * (len(v) - 1))::INT + 1], 6) AS p95, round(v[floor(0.99 * (len(v) - 1))::INT + 1], 6) AS p99, round(v[1], 6) AS p0, round(v[len(v)], 6) AS p100 FROM s")
def _(t, spark):
    v = F.transform("embedding", lambda x: x.cast("double") * 20)
    return t("embeddings").select("vec_id", *[r6(N.quantile(v, q)).alias(n) for n, q in (("p95", 0.95), ("p99", 0.99), ("p0", 0.0), ("p100", 1.0))])


@query("seq_longest_run", f"""WITH s AS (SELECT vec_id, unnest(range(1, 65)) AS i, {_SEQ} AS v FROM embeddings), o AS (SELECT vec_id, i, v[i] > 0.5 AS hot FROM s),
g AS (SELECT vec_id, hot, i - row_number() OVER (PARTITION BY vec_id, hot ORDER BY i) AS grp FROM o), c AS (SELECT vec_id, count(*) AS n FROM g WHERE hot GROUP BY vec_id, grp)
SELECT e.vec_id, coalesce(max(n), 0) AS longest FROM embeddings e LEFT JOIN c USING (vec_id) GROUP BY e.vec_id""")
def _(t, spark):
    v = F.transform("embedding", lambda x: x.cast("double") * 20)
    return t("embeddings").select("vec_id", N.longest_run(v, 0.5).cast("long").alias("longest"))


@query("seq_surprise", f"""WITH s AS (SELECT vec_id, {_SEQ} AS v FROM embeddings) SELECT vec_id, len(v)::DOUBLE AS n_tokens, round(list_sum(v) / len(v), 6) AS avg_nll, round(list_max(v), 6) AS max_surp,
  round(len(list_filter(v, lambda x: x > 3.5))::DOUBLE / len(v), 6) AS spike_frac_35, round(len(list_filter(v, lambda x: x > 5.0))::DOUBLE / len(v), 6) AS spike_frac_50 FROM s""")
def _(t, spark):
    f = N.surprise(F.transform("embedding", lambda x: x.cast("double") * 20))
    return t("embeddings").select("vec_id", *[r6(f[n]).alias(n) for n in ("n_tokens", "avg_nll", "max_surp", "spike_frac_35", "spike_frac_50")])


@query("rule_3way", f"""WITH s AS (SELECT vec_id, list_sum({_SEQ}) / 64 + label AS nll, list_sort({_SEQ})[60] + label AS p95, label % 5 AS run FROM embeddings)
SELECT vec_id, CASE WHEN nll > 3.5 OR p95 > 7 OR run >= 4 THEN -1 WHEN nll < 2.2 AND p95 < 5 AND run <= 1 THEN 1 ELSE 0 END AS verdict FROM s""")
def _(t, spark):
    v = F.transform("embedding", lambda x: x.cast("double") * 20)
    return t("embeddings").select("vec_id", N.three_way(N.mean(v) + F.col("label"), N.quantile(v, 0.95) + F.col("label"), F.col("label") % 5).alias("verdict"))


@query("cosine_to_anchor", "WITH a AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS cosine FROM embeddings, a")
def _(t, spark):
    anchor = F.broadcast(t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("v")))
    return t("embeddings").crossJoin(anchor).select("vec_id", r6(N.cosine(F.col("embedding"), F.col("v"))).alias("cosine"))


@query("composite_score", "SELECT l_orderkey, l_linenumber, round(0.15 * l_discount + 0.15 * l_tax + 0.1 * 0.5 + 0.5 * (l_quantity / 50) + 0.1 * CASE WHEN l_linestatus = 'O' THEN l_quantity / 50 ELSE greatest(-1, least(1, (l_quantity - 25) / 10)) END, 6) AS score FROM lineitem")
def _(t, spark):
    part = F.col("l_quantity") / 50
    reduction = F.when(F.col("l_linestatus") != "O", (F.col("l_quantity") - 25) / 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", r6(N.composite(F.col("l_discount"), F.col("l_tax"), F.lit(0.5), part, reduction)).alias("score"))


@query("sigmoid_logit", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS p, round(c_acctbal / 1000, 6) AS x FROM customer")
def _(t, spark):
    p = N.sigmoid(F.col("c_acctbal") / 1000)
    return t("customer").select("c_custkey", r6(p).alias("p"), r6(N.logit(p)).alias("x"))


@query("unknown_share", f"""WITH k AS (SELECT list(DISTINCT w) AS known FROM (SELECT unnest(regexp_extract_all({ASCII_SQL}, '[a-zA-Z_]+')) AS w FROM benchmark)),
d AS (SELECT doc_id, list_distinct({TERMS_SQL}) AS terms FROM documents)
SELECT doc_id, round(coalesce((len(terms) - len(list_intersect(terms, known)))::DOUBLE / nullif(len(terms), 0), 0), 6) AS penalty FROM d, k""")
def _(t, spark):
    word = F.regexp_extract_all(X.ascii_only(F.col("text")), F.lit("[a-zA-Z_]+"), F.lit(0))
    known = t("benchmark").select(F.explode(word).alias("w")).distinct()
    each = t("documents").select("doc_id", F.explode_outer(F.array_distinct(X.logic_terms(X.ascii_only(F.col("text"))))).alias("w")).join(known.withColumn("k", F.lit(1)), "w", "left")
    share = F.coalesce(F.try_divide(F.count_if(F.col("w").isNotNull() & F.col("k").isNull()).cast("double"), F.count("w").cast("double")), F.lit(0.0))
    return each.groupBy("doc_id").agg(r6(share).alias("penalty"))


@query("prompts", """SELECT conv_id, turn, 'Convert the following sentence to SUO-KIF: ' || trim(text) AS prompt, 'SUOKIF{ ' || text || ' }' AS wrapped FROM conversations""")
def _(t, spark):
    from lexiforge.sources.writers import wrapped

    return t("conversations").select("conv_id", "turn", X.translation_prompt(F.col("text")).alias("prompt"), wrapped(F.col("text")).alias("wrapped"))


@query("sentence_split", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, unnest(range(0, len(l)))::INT AS ord, unnest(l) AS sentence FROM l""")
def _(t, spark):
    return t("documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("ord", "sentence"))


@query("statement_parts", "SELECT p_partkey, to_json(list_value('(a (b ' || p_brand || '))', '(c ' || p_size || ') rest'))::VARCHAR AS parts FROM part")
def _(t, spark):
    text = F.format_string("(a (b %s)) (c %s) rest", "p_brand", F.col("p_size").cast("string"))
    return t("part").select("p_partkey", F.to_json(X.statement_parts(text)).alias("parts"))


_SIDE = WORDS_SQL.replace("text", "{}.text")


@query("rouge_l", rf"""WITH p AS (SELECT u.conv_id, u.turn, {_SIDE.format("u")} AS a, {_SIDE.format("v")} AS b FROM conversations u JOIN conversations v ON v.conv_id = u.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant'),
l AS (SELECT *, list_reduce(list_prepend(list_transform(b, lambda y: 0::BIGINT), list_transform(a, lambda x: list_transform(b, lambda y: (x = y)::BIGINT))),
  lambda r, m: list_transform(range(1, len(m) + 1), lambda j: greatest(r[j], coalesce(list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN m[k] = 1 THEN 1 + coalesce(r[k - 1], 0) ELSE 0 END)), 0))))[-1] AS n FROM p),
w AS (SELECT conv_id, turn, 1 AS k, a AS ref, b AS hyp FROM p UNION ALL SELECT conv_id, turn, 2, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]), list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) FROM p),
c AS (SELECT conv_id, turn, k, sum(least(nh, coalesce(nr, 0))) AS hit FROM (SELECT conv_id, turn, k, g, count(*) AS nh FROM (SELECT conv_id, turn, k, unnest(hyp) AS g FROM w) GROUP BY ALL)
  LEFT JOIN (SELECT conv_id, turn, k, g, count(*) AS nr FROM (SELECT conv_id, turn, k, unnest(ref) AS g FROM w) GROUP BY ALL) USING (conv_id, turn, k, g) GROUP BY ALL),
h AS (SELECT l.*, coalesce(c1.hit, 0) AS one, coalesce(c2.hit, 0) AS two, len(b) AS y, greatest(1, len(b) - 1) AS pairs FROM l LEFT JOIN c c1 ON c1.conv_id = l.conv_id AND c1.turn = l.turn AND c1.k = 1 LEFT JOIN c c2 ON c2.conv_id = l.conv_id AND c2.turn = l.turn AND c2.k = 2)
SELECT conv_id, turn, round(CASE WHEN n > 0 THEN 2 * n::DOUBLE / (len(a) + len(b)) ELSE 0 END, 6) AS rouge_l,
  round(CASE WHEN one = 0 THEN 0 ELSE CASE WHEN y > len(a) THEN 1 ELSE exp(1 - len(a)::DOUBLE / y) END * CASE WHEN two > 0 THEN two::DOUBLE / pairs WHEN y > 1 THEN ln(y) / 10 / pairs ELSE 0 END END, 6) AS bleu2 FROM h""")
def _(t, spark):
    a = t("conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = t("conversations").where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", r6(P.rouge_l(F.col("a"), F.col("b"))).alias("rouge_l"), r6(P.bleu2(F.col("a"), F.col("b"))).alias("bleu2"))


@query("normal_forms")
def _(t, spark):
    return t("documents").select("doc_id", F.md5(P.nfkc(F.col("text")).cast("binary")).alias("nfkc"), F.md5(P.without_marks(F.col("text")).cast("binary")).alias("plain"))


@query("word_frequency", r"""WITH w AS (SELECT doc_id, lower(regexp_replace(regexp_replace(unnest(string_split_regex(text, '\s+')), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')) AS word FROM documents),
k AS (SELECT DISTINCT lower(regexp_replace(regexp_replace(unnest(string_split_regex(text, '\s+')), '^[^\p{L}\p{N}]+', ''), '[^\p{L}\p{N}]+$', '')) AS word FROM benchmark), z AS (SELECT word, (length(word) % 7)::DOUBLE AS zipf FROM k)
SELECT doc_id, min(coalesce(zipf, 0)) AS least, round(avg(coalesce(zipf, 0)), 6) AS mean FROM w LEFT JOIN z USING (word) WHERE w.word <> '' GROUP BY doc_id""")
def _(t, spark):
    word = t("benchmark").select(F.explode(X.words(F.col("text"))).alias("w"))
    table = word.select(F.lower(F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("word")).distinct().select("word", (F.length("word") % 7).cast("double").alias("zipf"))
    return O.rarest_words(t("documents"), "doc_id", F.col("text"), table).select("doc_id", "least", r6(F.col("mean")).alias("mean"))


@query("complex_sentences", r"""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents) SELECT doc_id, n > 24 OR doc_id % 9 > 4 OR doc_id % 5 < 3 AS complex FROM w""")
def _(t, spark):
    n = X.lexical(F.col("text"))["sentence_length"]
    return t("documents").select("doc_id", N.complex_sentence(n, F.col("doc_id") % 9, F.col("doc_id") % 5).alias("complex"))


@query("reply_cleanup", r"""SELECT doc_id, md5(regexp_replace('12. ' || text, '(?m)^\d+\.\s*', '', 'g')) AS unnumbered, contains(lower(text), 'yes') AS yes, trim(lang) AS resolved FROM documents""")
def _(t, spark):
    plain = F.md5(X.unnumbered(F.concat(F.lit("12. "), F.col("text"))).cast("binary"))
    resolved = X.resolved_output(F.concat(F.col("text"), F.lit(" The resolved output is: "), F.col("lang"), F.lit(" ")))
    return t("documents").select("doc_id", plain.alias("unnumbered"), X.yes(F.col("text")).alias("yes"), resolved.alias("resolved"))


@query("pos_and_prompt", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'v' WHEN 2 THEN 'n' WHEN 3 THEN 'r' END AS pos,
'Convert to SUO-KIF. Sentence: "' || c_name || '" Only use terms from this list: [' || c_mktsegment || ', ' || c_name || '].' AS prompt FROM customer""")
def _(t, spark):
    tag = F.element_at(F.array(*[F.lit(x) for x in ("JJ", "VBD", "NNS", "RB", "DT")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return t("customer").select("c_custkey", X.wordnet_pos(tag).alias("pos"), X.candidate_prompt(F.col("c_name"), F.array("c_mktsegment", "c_name")).alias("prompt"))


@query("known_in_text", r"""WITH k AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', ' ', 'g'), '\??\b[a-zA-Z_][a-zA-Z_0-9]*\b'), lambda x: x[1] <> '?')) AS w FROM documents))
SELECT doc_id, count(*) AS n FROM d JOIN k USING (w) WHERE w <> '' GROUP BY doc_id""")
def _(t, spark):
    known = t("benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("term")).where("term <> ''")
    return X.known_in(t("documents").withColumn("text", X.ascii_only(F.col("text"))), "doc_id", "text", known).groupBy("doc_id").agg(F.count("*").alias("n"))
