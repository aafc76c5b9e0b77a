"""Pairs, labels, term statistics and metrics: joins, dedupe and aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import sequences as N
from lexiforge.functions import text as X


def share(n: Column, of: Column) -> Column:
    """n / of, 0 for a zero denominator."""
    return F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))


# ---- dedupe and joins ----


def copy_number(rows: DataFrame, key: str = "input", order: str = "row_id") -> DataFrame:
    """rows with copy: 1 for the first of equal keys, 2, 3, ... for later ones."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def first_copies(rows: DataFrame, key: str = "input", order: str = "row_id") -> DataFrame:
    """The first of equal keys, by an aggregation that combines before the shuffle (a hot key is one row per task)."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("first"))
    return first.select(key, f"first.{order}", *[f"first.{c}" for c in rest]).select(*rows.columns)


def later_copies(rows: DataFrame, key: str = "input", order: str = "row_id") -> DataFrame:
    """All but the first of equal keys: the first is aggregated before the shuffle, and rows of a hot key can be split for the join."""
    first = rows.groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    return rows.join(first, F.col(key).eqNullSafe(F.col("__key"))).where(F.col(order) > F.col("__first")).drop("__key", "__first")


def zipped(left: DataFrame, right: DataFrame, by: str = "line_num") -> DataFrame:
    """Rows of equal number side by side: the shorter file sets the length."""
    return left.join(right, by)


def length_gap(left: DataFrame, right: DataFrame) -> int:
    """How many more rows left has (a caller warns unless 0)."""
    return left.count() - right.count()


def merged_fields(left: Column, right: Column, sep: str = "#") -> Column:
    return F.concat(left, F.lit(sep), right)


def split_fields(c: Column, sep: str = "#") -> tuple[Column, Column]:
    """The text before the first separator, and all after it."""
    parts = F.split(c, sep, 2)
    return parts[0], F.get(parts, F.lit(1))


def valid_pairs(pairs: DataFrame, valid: DataFrame, sentence: str = "input") -> DataFrame:
    """First pairs of each sentence that the valid ones have."""
    return first_copies(pairs.join(valid.select(F.col(valid.columns[0]).alias(sentence)).distinct(), sentence, "left_semi"), sentence).select(*pairs.columns)


def with_labels(rows: DataFrame, labels: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """rows with the label of the last equal key, as text, '' where there is none."""
    last = labels.groupBy(key).agg(F.max_by(label, order).cast("string").alias(label))
    return rows.join(last, key, "left").withColumn(label, F.coalesce(label, F.lit("")))


def remaining(rows: DataFrame, done: DataFrame, key: str = "line_num") -> DataFrame:
    """Rows that a checkpoint table doesn't have."""
    return rows.join(done.select(key), key, "left_anti")


# ---- term statistics ----


def term_rows(rows: DataFrame, terms: Column, order: str = "row_id") -> DataFrame:
    """(order, pos, term), one row per occurrence."""
    return rows.select(order, F.posexplode(terms).alias("pos", "term"))


def term_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("term").agg(F.count("*").alias("count"))


def place(occurrences: DataFrame, order: str = "row_id") -> Column:
    """What sorts as (order, pos) does, nulls first.

    Whole numbers become one decimal, whose minimum a hash aggregate can hold; for that of a struct a task would sort every occurrence.
    """
    kinds = dict(occurrences.dtypes)
    if kinds[order] not in ("tinyint", "smallint", "int", "bigint") or kinds["pos"] != "int":
        return F.struct(order, "pos")
    first = F.coalesce(F.col(order).cast("decimal(20,0)"), F.lit(str(-(2**63) - 1)).cast("decimal(20,0)"))  # a null is less than the least number
    return first * F.lit(10**10).cast("decimal(11,0)") + F.coalesce("pos", F.lit(-(2**31) - 1))


def term_ids(occurrences: DataFrame, order: str = "row_id") -> DataFrame:
    """(term, id, count): ids from 1 in order of first appearance.

    The global rank is a range sort and prefix sums over its partitions, not one task's window.
    """
    firsts = occurrences.groupBy("term").agg(F.count("*").alias("count"), F.min(place(occurrences, order)).alias("first"))
    return ranked(firsts, "first", "id").select("term", "id", "count")


def ranked(rows: DataFrame, by: str, name: str, buckets: int | None = None) -> DataFrame:
    """rows with a global 1-based rank by a column without ties.

    Rows fall into as many ordered ranges as the session has shuffle partitions; ranks within a range are added to the
    counts of those before it, so no task holds all rows.  The ranges are kept for both uses, since they are sampled.
    """
    buckets = buckets or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = rows.repartitionByRange(buckets, by).withColumn("__part", F.spark_partition_id()).persist()
    before = held.groupBy("__part").agg(F.count("*").alias("__n")).withColumn(
        "__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    within = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    return held.withColumn("__at", within).join(F.broadcast(before.drop("__n")), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")


def ranked_within(rows: DataFrame, group: str, by: str, name: str) -> DataFrame:
    """rows with a 1-based rank within each group: the global rank by group and column less the group's first, so a large group is no one's task."""
    placed = ranked(rows.withColumn("__o", F.struct(F.col(group).alias("g"), F.col(by).alias("b"))), "__o", "__r")
    first = placed.groupBy(F.col(group).alias("__g")).agg(F.min("__r").alias("__first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("__g"))).withColumn(name, F.col("__r") - F.col("__first") + 1).drop("__o", "__r", "__g", "__first")


def complexity_histogram(rows: DataFrame, terms: Column) -> DataFrame:
    """(bin, n) for all eight bins, zeros included."""
    bins = rows.sparkSession.range(8).select(F.col("id").cast("int").alias("bin"))
    counted = rows.groupBy(X.complexity_bin(terms).alias("bin")).agg(F.count("*").alias("n"))
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rarest_words(rows: DataFrame, key: str, c: Column, table: DataFrame, missing: float = 0.0) -> DataFrame:
    """(key, least, mean) of the frequencies (word, zipf) of a text's words without punctuation; unknown words count as missing."""
    bare = F.filter(F.transform(X.words(c), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))), lambda w: w != "")
    each = rows.select(key, F.explode(bare).alias("word")).join(table, "word", "left").withColumn("zipf", F.coalesce("zipf", F.lit(missing)))
    return each.groupBy(key).agg(F.min("zipf").alias("least"), F.avg("zipf").alias("mean"))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """(id, root, pos): distinct lemmas of known word types with an id that depends on them alone."""
    typed = tokens.select(F.lower("lemma").alias("root"), X.word_type(F.col("upos")).alias("pos")).where("pos is not null and root <> ''").distinct()
    return typed.select(F.md5(F.concat_ws("|", "root", "pos").cast("binary")).alias("id"), "root", "pos")


def phrase_vocabulary(tokens: DataFrame) -> DataFrame:
    """(root, pos) of corpus tokens (root, pos) tagged as noun phrases; empty roots are left out."""
    return tokens.where("startswith(pos, 'np') and root <> ''").select("root", F.lit("noun-phrase").alias("pos")).distinct()


def sorted_vocabulary(rows: DataFrame, c: Column) -> DataFrame:
    return rows.select(F.explode(X.words(c)).alias("token")).distinct().orderBy("token")


# ---- metrics ----


def confusion(rows: DataFrame, actual: Column, kept: Column, by: list[str] | None = None) -> DataFrame:
    """Counts tp, fp, tn, fn and ignored; actual is true, false or null (ignored), by group or over all."""
    said = F.coalesce(kept, F.lit(False))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy(*(by or [])).agg(
        count(actual & said).alias("tp"), count(~actual & said).alias("fp"), count(~actual & ~said).alias("tn"), count(actual & ~said).alias("fn"),
        F.count_if(actual.isNull()).alias("ignored"),
    )


def metrics(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, F1, accuracy, prevalence, coverage, the share of coherent ones kept, and leakage."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    return counts.withColumns(
        {
            "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn), "accuracy": share(tp + tn, n),
            "prevalence": share(tp + fn, n), "coverage": share(tp + fp, n), "coherent_kept_rate": share(tp, n), "leakage": share(fp, fp + tn),
            "precision_lcb": N.wilson(tp, tp + fp),
        }
    )


def exact_match(rows: DataFrame, prediction: Column, reference: Column, trimmed: bool = True) -> DataFrame:
    f = F.trim if trimmed else lambda c: c
    return rows.agg((F.avg(F.when(f(prediction) == f(reference), 100.0).otherwise(0.0))).alias("exact_match"))


def translation_quality(rows: DataFrame, prediction: Column, known: Column) -> DataFrame:
    """Shares of balanced predictions and of those with only known terms, and the mean share of unknown terms."""
    miss = N.unknown_share(X.logic_terms(prediction), known)
    return rows.agg(
        F.avg(F.when(X.balanced(prediction), 1.0).otherwise(0.0)).alias("syntax_validity"), F.avg(F.when(miss == 0, 1.0).otherwise(0.0)).alias("terms_valid"), F.avg(miss).alias("mean_penalty")
    )


def corpus_bleu(rows: DataFrame, prediction: Column, reference: Column, order: int = 4) -> DataFrame:
    """Corpus BLEU of one reference: clipped n-gram matches and lengths are summed over all rows before the ratio is taken.

    n-grams are counted by grouping, row by row of the input, so long texts cost no nested loops.
    """
    held = rows.select(F.monotonically_increasing_id().alias("i"), X.words(prediction).alias("p"), X.words(reference).alias("r"))
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - 1)
    sides = F.explode(F.array(*[F.struct(F.col(side).alias("w"), F.lit(side == "p").alias("of_p")) for side in ("p", "r")]))
    at = held.select("i", sides.alias("x")).where(F.size("x.w") > 0).select("i", "x.of_p", "x.w", F.explode(starts("x.w")).alias("at"))
    grams = at.select("i", "of_p", F.explode(F.sequence(F.lit(1), F.least(F.lit(order), F.size("w") - F.col("at")))).alias("n"), "w", "at")
    # both sides' grams are counted together, so that a gram that both have is shuffled once and needs no join
    each = grams.groupBy("i", "n", F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ").alias("g")).agg(F.count_if("of_p").alias("p"), F.count_if(~F.col("of_p")).alias("r")).where("p > 0")
    by_order = each.groupBy("n").agg(F.sum(F.least("p", "r")).alias("hit"), F.sum("p").alias("all"))
    sums = by_order.agg(F.count("*").alias("orders"), F.min("hit").alias("least"), F.sum(F.ln(F.try_divide(F.col("hit"), F.col("all")))).alias("logs"))
    lengths = held.agg(F.sum(F.size("p")).alias("c"), F.sum(F.size("r")).alias("r"))
    brevity = F.when(F.col("c") > F.col("r"), 1.0).otherwise(F.exp(1 - F.try_divide(F.col("r"), F.col("c"))))
    some = (F.col("orders") == order) & (F.col("least") > 0)
    return sums.crossJoin(lengths).select(F.when(some, brevity * F.exp(F.col("logs") / order)).otherwise(0.0).alias("bleu"))


def numeric_fractions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, fraction) of non-blank values that read as numbers."""
    aggs = []
    for c in columns:
        s = F.trim(F.col(c).cast("string"))
        there = s.isNotNull() & (s != "")
        aggs.append(share(F.count_if(there & s.try_cast("double").isNotNull()), F.count_if(there)).alias(c))
    one = rows.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("fraction")) for c in columns])).alias("x")).select("x.*")


def score_summary(rows: DataFrame, scores: list[str], label: str, detected: str) -> DataFrame:
    """One row: the mean of each score over its numeric values, and accuracy, precision and recall of a detector (0 or 1) against labels Y and N.

    Rows without a detection don't count for the last three; a label that is neither Y nor N raises nothing and counts for none of them.
    """
    said, true = F.col(detected).try_cast("int"), F.when(F.col(label) == "Y", 1).when(F.col(label) == "N", 0)
    both = said.isNotNull() & true.isNotNull()
    n = lambda c: F.count_if(F.coalesce(both & c, F.lit(False)))
    hit = n((said == 1) & (true == 1))
    means = [F.avg(F.when(~F.isnan(v), v)).alias(c) for c, v in ((c, F.col(c).try_cast("double")) for c in scores)]
    return rows.agg(*means, share(n(said == true), n(F.lit(True))).alias("accuracy"), share(hit, n(said == 1)).alias("precision"), share(hit, n(true == 1)).alias("recall"))


def totals(rows: DataFrame, c: Column, by: list[str] | None = None) -> DataFrame:
    """lines and characters of a text column, over all rows or by group (a file)."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long").alias("chars"))


def labelled_points(points: DataFrame, labels: DataFrame, values: list[str], source: str | None = None, order: str = "row_id") -> DataFrame:
    """(sentence, values, label): points whose trimmed sentence has a whole-number label; of several labels the last by order holds.

    source keeps the labels of one source_file only.
    """
    kept = labels if source is None else labels.where(F.trim("source_file") == source)
    number = F.trim(F.col("label").cast("string"))
    whole = kept.select(F.trim("sentence").alias("sentence"), F.when(number.rlike(r"^[+-]?\d+$"), number.try_cast("int")).alias("label"), F.col(order).alias("o")).where("label is not null")
    last = whole.groupBy("sentence").agg(F.max_by("label", "o").alias("label"))
    return points.select(F.trim("sentence").alias("sentence"), *[F.col(v).cast("double").alias(v) for v in values]).join(last, "sentence")


def usable_counts(rows: DataFrame, features: list[str], label: str, above: float = 2, below: float = -1) -> DataFrame:
    """One row: how many rows `usable` drops for a label that isn't a number, one between the bounds, or a missing feature, in this order, and how many it keeps."""
    graded = F.col(label).try_cast("double")
    number, clear, whole = graded.isNotNull() & ~F.isnan(graded), (graded >= above) | (graded <= below), F.lit(True)
    for f in features:
        v = F.col(f).try_cast("double")
        whole = whole & v.isNotNull() & ~F.isnan(v)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    number = F.coalesce(number, F.lit(False))
    return rows.agg(n(~number).alias("no_number"), n(number & ~clear).alias("borderline"), n(number & clear & ~whole).alias("missing_feature"), n(number & clear & whole).alias("kept"))


def usable(rows: DataFrame, features: list[str], label: str, above: float = 2, below: float = -1) -> DataFrame:
    """Rows with all features and a graded label of at least above (y = 1) or at most below (y = 0)."""
    graded = F.nullif(F.col(label).try_cast("double"), F.lit(float("nan")))
    cast = {f: F.col(f).try_cast("double") for f in features}
    out = rows.withColumns(cast | {"y": F.when(graded >= above, 1).when(graded <= below, 0)}).where("y is not null")
    for f in features:
        out = out.where(F.col(f).isNotNull() & ~F.isnan(f))
    return out


def signed(rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with finite features and a label other than 0: y is its sign."""
    return usable(rows, features, label, above=5e-324, below=-5e-324).where(F.abs(F.col(label).try_cast("double")) < float("inf"))


# ---- order-dependent ----


def scanned(rows: DataFrame, value: Column, order: str, by: list[str], how: str, name: str, before: bool = False, stretch: int = 100_000) -> DataFrame:
    """rows with what a state is at each row of its group (before: just before it): the last value that isn't null, their sum or their max.

    order is a whole number.  The state runs within stretches of order; only each stretch's end runs over a group, so a
    group of any size is many tasks'.  Rows of equal order share their state, unless `before` is set: it then takes them
    in any order.  Without values so far the state is null.
    """
    whole = {"last": lambda v: F.last(v, ignorenulls=True), "sum": F.sum, "max": F.max}[how]
    part = rows.withColumns({"__v": value, "__s": F.expr(f"`{order}` div {stretch}")})
    window = Window.partitionBy(*by, "__s").orderBy(order)
    inner = whole(F.col("__v")).over(window.rowsBetween(Window.unboundedPreceding, -1) if before else window)
    end = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order))) if how == "last" else whole("__v")
    ends = part.groupBy(*by, "__s").agg(end.alias("__e"))
    earlier = whole(F.col("__e")).over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__s").alias("__t"), earlier.alias("__e"))
    on = F.col("__s").eqNullSafe(F.col("__t"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    done = part.withColumn("__i", inner).join(ends, on)
    both = F.coalesce(F.col("__i") + F.col("__e"), "__i", "__e") if how == "sum" else F.greatest("__i", "__e") if how == "max" else F.coalesce("__i", "__e")
    return done.withColumn(name, both).drop("__v", "__s", "__t", "__e", "__i", *[f"__{c}" for c in by])


def carried(rows: DataFrame, value: Column, order: str, by: list[str], name: str = "carried", stretch: int = 100_000) -> DataFrame:
    """rows with the last non-null value at or before each row of its group."""
    return scanned(rows, value, order, by, "last", name, stretch=stretch)


def segments(rows: DataFrame, separator: Column, order: str, by: list[str], name: str = "segment", stretch: int = 100_000) -> DataFrame:
    """rows with the number of separators at or before each row of its group."""
    return scanned(rows, separator.cast("int"), order, by, "sum", name, stretch=stretch).withColumn(name, F.col(name).cast("long"))


def statement_groups(rows: DataFrame) -> DataFrame:
    """(file, segment, text): lines joined into statements; blank lines, ';' and '!!' end one."""
    sep = (F.trim("value") == "") | F.col("value").startswith(";") | F.col("value").startswith("!!")
    body = segments(rows.withColumn("sep", sep), F.col("sep"), "line_num", ["file"]).where("not sep")
    lines = F.array_sort(F.collect_list(F.struct("line_num", "value")))["value"]
    return body.groupBy("file", "segment").agg(F.array_join(lines, " ").alias("text"))


def corpus_sentences(tokens: DataFrame, stretch: int = 100_000) -> DataFrame:
    """Corpus tokens (line_num, word, ...) with sentence: it ends after . ! ? # <p> ... and ...."""
    end = F.col("word").isin(".", "!", "?", "#", "<p>", "...", "....")
    done = scanned(tokens, end.cast("int"), "line_num", ["file"], "sum", "sentence", before=True, stretch=stretch)
    return done.withColumn("sentence", F.coalesce("sentence", F.lit(0).cast("long")))


def after_marker(rows: DataFrame, marker: Column, order: str, by: list[str]) -> DataFrame:
    """The rows of each group that come after its first marker (in order; rows of the same place don't)."""
    first = rows.where(marker).groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(order).alias("__first"))
    on = F.col(order) > F.col("__first")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(first, on).drop("__first", *[f"__{c}" for c in by])
