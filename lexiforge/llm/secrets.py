"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regex is read once, on the driver, into a Boolean query of trigrams that every match must hold (in lower
case, so a case-blind keyword needs no variants).  The index has a posting (trigram, document) for each trigram that
some rule asks for.  Postings are intersected by document, the rules' queries pick candidates, and only candidates are
verified with the regex.  A rule without mandatory trigrams, such as a run of hex digits, scans every text.

Scale: postings and spans are narrow rows keyed by document, so one frequent trigram or word doesn't gather in a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import table


@dataclass(frozen=True)
class Rule:
    """A match of regex counts if group has at least so many characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The three base rules; `{24,}` and `{16,}` find what the open repeat with a length check finds.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of keys that the base rules don't name.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: A query is a list of clauses, all of which must hold; a clause lists sets of trigrams, one of which must be there whole.
Query = list[list[frozenset[str]]]


def trigram_query(regex: str, most: int = 64) -> Query:
    """The trigrams that a match of regex must hold, in lower case; [] if none are mandatory."""

    def clause(words: set[str]) -> Query:
        sets = [frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words]
        least = [s for s in set(sets) if not any(t < s for t in sets)]  # a set that holds another adds nothing to the choice
        return [sorted(least, key=sorted)] if all(sets) else []

    def walk(items) -> tuple[set[str] | None, Query]:
        """The exact words that items match, if few, or else None and a query."""
        exact: set[str] | None = {""}
        run, query = {""}, []

        def flush():
            nonlocal run, exact
            query.extend(clause(run))
            run, exact = {""}, None

        def join(words: set[str]):
            nonlocal run
            if len(run) * len(words) > most:
                flush()
            run = {a + b for a in run for b in words}

        for op, arg in items:
            if op is rc.LITERAL:
                join({chr(arg).lower()})
            elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= 6:
                join({chr(a).lower() for _, a in arg})
            elif op is rc.SUBPATTERN:
                words, more = walk(arg[3])
                if words is None:
                    flush()
                    query.extend(more)
                else:
                    join(words)
            elif op is rc.BRANCH:
                found = [walk(x) for x in arg[1]]
                if all(w is not None for w, _ in found):
                    join(set().union(*(w for w, _ in found)))
                else:
                    flush()
            elif op is rc.MAX_REPEAT and arg[0] == 0 and arg[1] == 1:
                words, _ = walk(arg[2])
                if words is None:
                    flush()
                else:
                    join(words | {""})
            elif op is rc.MAX_REPEAT and arg[0] >= 1:
                words, more = walk(arg[2])
                if words is not None:
                    join(words)
                flush()
                query.extend(more)
            elif op is not rc.AT:
                flush()
        if exact is None:
            query.extend(clause(run))
            return None, query
        return run, clause(run)

    return walk(rp.parse(regex))[1]


def trigrams(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({g for r in rules for c in trigram_query(r.regex) for s in c for g in s})


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, doc_id, key): which of the grams each document holds; gram is a place in the list."""
    asked = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("i")) for i, g in enumerate(grams)])
    # a lambda binds the lower-cased text once for all grams
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(asked, lambda x: F.contains(low, x["g"])))
    return docs.select("doc_id", "key", F.explode(F.get(held, F.lit(0))).alias("x")).select("doc_id", "key", F.col("x.i").alias("gram"))


def candidates(postings: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """(doc_id, key, rules): the indexed rules whose Boolean query the document's intersected postings satisfy."""
    number = {g: i for i, g in enumerate(grams)}

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for one in query:
            any_of = F.lit(False)
            for s in one:
                every = F.lit(True)
                for g in sorted(s):
                    every = every & F.array_contains("grams", number[g])
                any_of = any_of | every
            out = out & any_of
        return out

    picks = [F.when(holds(q), F.lit(i)) for i, r in enumerate(rules) if (q := trigram_query(r.regex))]
    by_doc = postings.groupBy("doc_id", "key").agg(F.collect_set("gram").alias("grams"))
    return by_doc.select("doc_id", "key", F.array_compact(F.array(*picks)).alias("rules")).where("size(rules) > 0")


def spans(text: Column, rule: Rule, number: int) -> Column:
    """The rule's leftmost non-overlapping matches as array<struct<start, rule, end>>, in code points."""
    p = F.lit(rule.regex)
    found = F.regexp_extract_all(text, p, F.lit(0))
    group = F.regexp_extract_all(text, p, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.regex, -1)
    rows = F.arrays_zip(found.alias("m"), group.alias("g"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("rule"), end.alias("end")))
        keep = F.length(x["g"]) >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walked).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, rule, end) by start, then rule's place.

    Offsets are code points, end exclusive.  A null text is empty; empty texts and an empty table have no spans;
    rows that repeat get equal results; null ids are matched like any other id.  Only doc_id and text are read.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    grams = trigrams(rules)
    everywhere = [(i, r) for i, r in enumerate(rules) if not trigram_query(r.regex)]
    indexed = [(i, r) for i, r in enumerate(rules) if trigram_query(r.regex)]
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    full = own.select("doc_id", "key", (F.concat(*[spans(F.col("text"), r, i) for i, r in everywhere]) if everywhere else none).alias("full"))
    if indexed:
        picked = candidates(index(own, grams), rules, grams).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "rules")
        same = own["doc_id"].eqNullSafe(F.col("__id")) & (own["key"] == F.col("__key"))
        tried = own.join(picked.hint("shuffle_hash"), same)
        checked = F.concat(*[F.when(F.array_contains("rules", i), spans(F.col("text"), r, i)).otherwise(none) for i, r in indexed])
        verified = tried.select("__id", "__key", checked.alias("more")).where("size(more) > 0")
        verified = verified.groupBy("__id", "__key").agg(F.first("more").alias("more"))
        same = full["doc_id"].eqNullSafe(verified["__id"]) & (full["key"] == verified["__key"])
        full = full.join(verified, same, "left")
    else:
        full = full.withColumn("more", none)
    return full.select("doc_id", F.array_sort(F.concat("full", F.coalesce("more", none))).alias("spans"))


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: counts of the base kinds, the digest of the base spans, and all spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rule"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    def one(i: int, r: Rule) -> str:
        p = r.regex.replace("'", "''")
        return f"""SELECT doc_id, text, {i} AS rule, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{p}') AS m,
          regexp_extract_all(text, '{p}', {r.group}) AS g, string_split_regex(text, '{p}') AS gap FROM d"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(one(i, r).replace("SELECT doc_id", "SELECT r, doc_id") for i, r in enumerate(RULES))}),
e AS (SELECT r, doc_id, rule, kind, least, m, g, gap, unnest(range(1, len(m) + 1)) AS k FROM f WHERE len(m) > 0),
s AS (SELECT r, rule, kind, length(g[k]) >= least AS keep,
        (list_sum(list_transform(gap[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::BIGINT AS a,
        length(m[k]) AS n FROM e),
j AS (SELECT r, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access, count(*) FILTER (WHERE rule = 2) AS n_hex,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rule) FILTER (WHERE rule < {len(BASE)}) AS base,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, rule) AS spans FROM s WHERE keep GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (r)
"""


ORACLE = _oracle()
