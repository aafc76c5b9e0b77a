"""Constrained decoding: which tokens may follow, given that the output must be a sequence of allowed terms.

Terms are arrays of token ids.  Their prefixes make a trie, kept as a table with a row for each prefix, so it grows with
the vocabulary on the executors and is joined, not broadcast.  A row's tokens so far may be cut into terms in several
ways; the tokens that may follow are those that any way allows, and the output may end where one way ends a term.

Scale: only a row's last few tokens can belong to an unfinished term, so each row asks for as many prefixes as the
longest term has tokens, and which cuts are possible is found in the row from the terms that were met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trie(terms: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(prefix, next, ends) of terms (an array column): the sorted tokens that continue a prefix, and whether it is a whole term itself.

    The empty prefix is the root.  Null and empty terms are left out; repeated ones count once; next is empty at a leaf.
    """
    t = F.col(tokens)
    own = terms.where(F.size(t) > 0).select(t.alias("t")).distinct()
    each = own.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("t")), lambda i: F.struct(F.slice("t", 1, i).alias("prefix"), F.get("t", i).alias("next"), (i == F.size("t")).alias("ends")))).alias("x"))
    return each.groupBy("x.prefix").agg(F.sort_array(F.collect_set("x.next")).alias("next"), F.max("x.ends").alias("ends"))


def longest(terms: DataFrame, tokens: str = "tokens") -> int:
    """Tokens of the longest term."""
    return terms.agg(F.max(F.size(tokens))).first()[0] or 0


def following(rows: DataFrame, key: str, tokens: str, nodes: DataFrame, depth: int) -> DataFrame:
    """rows with next (sorted array: the tokens that may follow) and ends (whether the output may stop); key tells rows apart.

    nodes is a trie and depth its longest term.  Tokens that can't be cut into terms and a prefix allow nothing and
    can't end; without tokens anything that begins a term may follow, and the output may end.  Null tokens give null.
    """
    n = F.size(tokens)
    starts = F.transform(F.sequence(F.lit(0), n), lambda e: F.transform(F.sequence(F.greatest(F.lit(0), e - depth), e), lambda s: F.struct(s.alias("s"), e.alias("e"))))
    spans = rows.where(F.col(tokens).isNotNull()).select(key, n.alias("__n"), tokens, F.explode(F.flatten(starts)).alias("x"))
    asked = spans.where("x.s < x.e or x.e = __n").select(key, "__n", "x.s", "x.e", F.slice(tokens, F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("prefix"))
    met = asked.join(nodes, "prefix").where("e = __n or ends").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("e", "s", "ends", F.when(F.col("e") == F.col("__n"), F.col("next")).alias("next")))).alias("met"), F.first("__n").alias("__n")
    )
    # places that whole terms reach from the start; spans come by end, so each start is settled before it is asked for
    reached = F.aggregate("met", F.array(F.lit(0)), lambda acc, m: F.when(m["ends"] & (m["s"] < m["e"]) & F.array_contains(acc, m["s"]) & ~F.array_contains(acc, m["e"]), F.concat(acc, F.array(m["e"]))).otherwise(acc))
    near = F.filter("__reached", lambda p: p >= F.col("__n") - depth)
    open_ = F.filter("met", lambda m: m["next"].isNotNull() & F.array_contains("__near", m["s"]))
    done = met.withColumn("__reached", reached).withColumn("__near", near).select(F.col(key).alias("__key"), F.array_sort(F.array_distinct(F.flatten(F.transform(open_, lambda m: m["next"])))).alias("next"), F.array_contains("__reached", F.col("__n")).alias("ends"))
    out = rows.drop("next", "ends").join(done, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
    none = F.col(tokens).isNull()
    empty = F.array().cast(nodes.schema["next"].dataType)
    return out.withColumns({"next": F.when(~none, F.coalesce("next", empty)), "ends": F.when(~none, F.coalesce("ends", n == 0))})


def masked(scores: Column, allowed: Column) -> Column:
    """Scores by token id with all but the allowed ids at minus infinity."""
    return F.transform(scores, lambda s, i: F.when(F.array_contains(allowed, i), s).otherwise(F.lit(float("-inf"))))
