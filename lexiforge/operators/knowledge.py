"""Knowledge-base statements: closure, probes, type check and coverage.  Statements are rows (file, relation, args)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.operators.pairs import ranked_within
from lexiforge.operators.stored import stored

DOWNWARD = ("subAttribute", "instance", "subrelation", "subclass")


def mentions(statements: DataFrame) -> DataFrame:
    """(term, relation, file, args): a row for each distinct argument that isn't a variable."""
    return statements.select(F.explode(F.array_distinct("args")).alias("term"), "relation", "file", "args").where("not startswith(term, '?')")


def with_term(statements: DataFrame, term: str, relation: str) -> DataFrame:
    """(file, args) of statements of a relation that mention a term."""
    return statements.where((F.col("relation") == relation) & F.array_contains("args", term)).select("file", "args")


def exists(statements: DataFrame, terms: DataFrame) -> DataFrame:
    """Which of the terms (term) some statement mentions."""
    return terms.join(mentions(statements).select("term").distinct(), "term", "left_semi")


def is_instance(statements: DataFrame, terms: DataFrame) -> DataFrame:
    """Which of the terms are the first argument of an instance statement."""
    return terms.join(statements.where("relation = 'instance'").select(F.col("args")[0].alias("term")).distinct(), "term", "left_semi")


def closure(edges: DataFrame, root: str, most_levels: int = 1000) -> DataFrame:
    """(term): the root and all below it, over edges (parent, child); cycles end where they began.

    Level-synchronous: each round joins the frontier only and leaves out what was reached before.
    """
    step = stored(edges.where("parent <> child and not startswith(child, '?')").select("parent", "child").distinct())
    reached = frontier = edges.sparkSession.createDataFrame([(root,)] if not root.startswith("?") else [], "term string")
    for level in range(most_levels):
        frontier = stored(step.join(frontier, step["parent"] == frontier["term"]).select(F.col("child").alias("term")).distinct().join(reached, "term", "left_anti"))
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier)
        if level % 8 == 7:
            reached = stored(reached)
    raise RuntimeError(f"the hierarchy below {root} is deeper than {most_levels} levels")


def downward_edges(statements: DataFrame) -> DataFrame:
    """(parent, child): the first argument of hierarchy statements is below every term that they mention."""
    kept = statements.where(F.col("relation").isin(*DOWNWARD))
    return kept.select(F.explode(F.array_distinct("args")).alias("parent"), F.col("args")[0].alias("child")).distinct()


def type_check(phrases: DataFrame, known: DataFrame, statement: str = "statement", key: str = "row_id") -> DataFrame:
    """(key, found, instance_only, missing) of statements against (word, file) of a knowledge base, as the check's texts."""
    first = known.groupBy("word").agg(F.min("file").alias("file"))
    each = phrases.select(key, statement, F.posexplode_outer(X.statement_words(F.col(statement))).alias("pos", "word")).join(first, "word", "left")
    note = F.when(F.col("file").isNull(), F.format_string("Word: '%s' not found in any .kif files.", "word")).otherwise(F.format_string("Word: '%s' found in %s", "word", "file"))
    missing = F.col("file").isNull() & F.col("word").isNotNull()
    gather = lambda keep, value, sep: F.array_join(F.array_sort(F.collect_list(F.when(keep, F.struct("pos", value.alias("v")))))["v"], sep)
    told = each.groupBy(key).agg(
        gather(F.col("word").isNotNull(), note, " | ").alias("found"), gather(missing & F.contains(F.col(statement), F.concat(F.lit("instance "), F.col("word"))), F.col("word"), ", ").alias("instance_only"),
        gather(missing, F.col("word"), ", ").alias("missing"),
    )
    none: list[Column] = [F.when(F.col(c) == "", "None").otherwise(F.col(c)).alias(c) for c in ("instance_only", "missing")]
    return told.select(key, "found", *none)


def coverage(rows: DataFrame, terms: Column, known: DataFrame, key: str = "row_id") -> DataFrame:
    """One row: distinct terms, the shares of distinct terms, of occurrences and of lines that the known terms (term) lack."""
    # the known terms, a table of bounded size by its role, go to all tasks: occurrences are counted where they are read
    each = rows.select(key, F.explode(terms).alias("term")).join(F.broadcast(known.select("term", F.lit(True).alias("known")).distinct()), "term", "left")
    each = each.select(key, "term", F.col("known").isNull().alias("miss"))
    # both groupings in one pass, as finding the terms of a text is most of the work
    both = each.groupingSets([["term"], [key]], "term", key).agg(F.grouping("term").alias("of_line"), F.count("*").alias("n"), F.count_if("miss").alias("missed"))
    pct = lambda a, b: F.round(F.coalesce(F.try_divide(100.0 * a, b), F.lit(0.0)), 2)
    term, line = F.col("of_line") == 0, (F.col("of_line") == 1) & F.col(key).isNotNull()
    words = both.agg(
        F.count_if(term).alias("unique_terms"), pct(F.count_if(term & (F.col("missed") > 0)), F.count_if(term)).alias("pct_unique_unknown"), F.coalesce(F.sum(F.when(term, F.col("n"))), F.lit(0)).alias("total_terms"),
        pct(F.coalesce(F.sum(F.when(term, F.col("missed"))), F.lit(0)), F.sum(F.when(term, F.col("n")))).alias("pct_all_unknown"), F.count_if(line & (F.col("missed") > 0)).alias("unknown_lines"),
    )
    done = words.crossJoin(rows.agg(F.count("*").alias("total_lines"))).withColumn("pct_lines_unknown", pct(F.col("unknown_lines"), F.col("total_lines")))
    return done.select("unique_terms", "pct_unique_unknown", "total_terms", "pct_all_unknown", "total_lines", "unknown_lines", "pct_lines_unknown")


def first_unknown(rows: DataFrame, terms: Column, known: DataFrame, n: int, key: str = "row_id") -> DataFrame:
    """The first n distinct unknown terms with the line that each was first seen on (a report)."""
    each = rows.select(key, F.posexplode(terms).alias("pos", "term")).join(known.select("term").distinct(), "term", "left_anti")
    return each.groupBy("term").agg(F.min(F.struct(key, "pos")).alias("first")).orderBy("first").limit(n).select("term", f"first.{key}")


def syntax_statistics(lines: DataFrame, errors: DataFrame) -> DataFrame:
    """Distinct lines with errors, all lines, and their share in percent; errors: (line_num)."""
    return lines.agg(F.count("*").alias("total_lines")).crossJoin(errors.agg(F.countDistinct("line_num").alias("lines_with_errors"))).withColumn(
        "pct_errors", F.round(F.coalesce(F.try_divide(100.0 * F.col("lines_with_errors"), F.col("total_lines")), F.lit(0.0)), 2)
    )


def new_term_formats(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """(term, phrase) that the existing ones lack."""
    return candidates.select("term", "phrase").distinct().join(existing.select("term", "phrase"), ["term", "phrase"], "left_anti")


#: Names that may clash (alike but for digits at their end) are numbered in one task up to so many rows, else in rounds.
FEW = 100_000


def numbered_names(rows: DataFrame, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """rows with unique: in order, each row gets its name, or the name with the first of 1, 2, ... that neither an earlier row nor a taken term (term) has."""
    stem = lambda c: F.regexp_replace(c, "[0-9]+$", "")
    keyed = stored(rows.withColumn("__row", F.struct(F.col(order).alias("o"), F.monotonically_increasing_id().alias("r"))).withColumn("__stem", stem(F.col(name))))
    many = keyed.groupBy("__stem").agg(F.count("*").alias("n")).where(f"n > {FEW}").select("__stem")
    large = keyed.join(many, "__stem", "left_semi")
    small = keyed.join(many, "__stem", "left_anti").select("__stem", "__row", F.col(name).alias("name"))
    if taken is not None:
        used = taken.select(stem(F.col("term")).alias("__stem"), F.col("term").alias("name")).distinct().join(small.select("__stem").distinct(), "__stem", "left_semi")
        small = small.unionByName(used, allowMissingColumns=True)

    def number(pdf):
        import pandas as pd

        own = pdf[pdf["__row"].notna()]
        given, following, out = set(pdf[pdf["__row"].isna()]["name"]), {}, []
        for i in sorted(own.index, key=lambda i: own.at[i, "at"]):
            base, k = own.at[i, "name"], following.get(own.at[i, "name"], 0)
            while (n := base if k == 0 else f"{base}{k}") in given:
                k += 1
            given.add(n)
            following[base] = k + 1
            out.append((own.at[i, "__row"], n))
        return pd.DataFrame(out, columns=["__row", "unique"])

    placed = small.where("name is not null").withColumn("at", F.rank().over(Window.partitionBy("__stem").orderBy(F.col("__row").asc_nulls_first()))).withColumn("__row", F.col("__row.r"))
    got = placed.groupBy("__stem").applyInPandas(number, "__row long, unique string")
    few = keyed.join(many, "__stem", "left_anti").join(got.withColumnRenamed("__row", "__r"), F.col("__row.r") == F.col("__r"), "left").select(*rows.columns, "unique")
    return few if large.isEmpty() else few.unionByName(_in_rounds(large.drop("__stem", "__row"), name, order, taken))


def _in_rounds(rows: DataFrame, name: str, order: str, taken: DataFrame | None) -> DataFrame:
    """numbered_names for any number of names that clash.

    Every row asks for a name, the earliest of those that ask for a free one holds it, the others count up and ask again.
    A later row gives way to an earlier one, so the end is that of going in order.  A row begins at its place among equal
    names, since the earlier ones hold as many numbers.
    """
    held = None if taken is None else stored(taken.select(F.col("term").alias("unique"), F.lit(True).alias("__taken")).distinct())
    each = ranked_within(rows.withColumn("__row", F.struct(F.col(order).alias("o"), F.monotonically_increasing_id().alias("r"))), name, "__row", "__n")
    each = each.withColumn("__n", F.col("__n") - 1)
    while True:
        each = stored(each.withColumn("unique", F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.col("__n").cast("string")))))
        first = each.groupBy("unique").agg(F.min("__row").alias("__first"))
        first = first.withColumn("__taken", F.lit(None).cast("boolean")) if held is None else first.join(held, "unique", "left")
        told = stored(each.join(first, "unique", "left").withColumn("__lost", F.col("unique").isNotNull() & (F.col("__taken").isNotNull() | (F.col("__row") > F.col("__first")))))
        if told.where("__lost").isEmpty():
            return told.select(*rows.columns, "unique")
        each = told.withColumn("__n", F.col("__n") + F.col("__lost").cast("int")).drop("unique", "__first", "__taken", "__lost")
