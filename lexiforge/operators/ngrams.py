"""A word model for scoring texts: interpolated modified Kneser-Ney, counted and applied by joins.

The highest order counts grams as they occur, each lower one in how many different grams of the next order it is the end;
what the three discounts take from a context's grams goes to the lower order.  Every gram that was seen has its full
probability stored, and every context its weight for the lower order and the probability of its best next word, so that
scoring looks up the longest known context.  Texts begin with order - 1 empty words.  A gram is one text, its words
joined by a separator (escaped in words), which sorts and hashes faster than an array.

Scale: grams are counted before the shuffle; scoring joins the distinct grams of the texts once, and only then their
places, so no list grows but that of one text's own values.  Nothing but the discounts, three numbers an order, goes
to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.stored import saved

#: Between the words of a gram; what stands for it, and for the escape itself, in a word.
SEPARATOR, ESCAPE = "\u001f", "\u001e"
#: Discounts where the counts of counts give none (too few grams that occur once or twice).
PLAIN_DISCOUNTS = (0.5, 1.0, 1.5)


@dataclass(frozen=True)
class Model:
    """order; grams: for each order (gram, p); contexts: for each order from 2 (context, rest, top), context a gram of one word less.

    rest is the context's weight for the lower order, top its best word's probability; unknown is the probability of
    a word that was never seen (without any context), best that of the best word.
    """

    order: int
    grams: tuple[DataFrame, ...]
    contexts: tuple[DataFrame, ...]
    unknown: float
    best: float


def gram(words: Column) -> Column:
    """An array of words as one text."""
    return F.array_join(F.transform(words, lambda w: F.replace(F.replace(w, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(SEPARATOR), F.lit(ESCAPE + "1"))), SEPARATOR)


def _context(order: int) -> Column:
    """A gram but for its last word."""
    return F.substring_index("gram", SEPARATOR, order - 1) if order > 1 else F.lit("")


def _end(c: str, order: int) -> Column:
    """A gram of that order but for its first word."""
    return F.substring_index(c, SEPARATOR, 1 - order)


def grams_at(words: Column, order: int) -> Column:
    """For each word the gram of it and the order - 1 words before it, empty words before the first."""
    own = F.split(gram(words), SEPARATOR)
    out = own
    for k in range(1, order):  # the words k places before
        back = F.slice(F.concat(F.array_repeat(F.lit(""), k), own), F.lit(1), F.size(own))
        out = F.zip_with(back, out, lambda a, b: F.concat(a, F.lit(SEPARATOR), b))
    return out


def gram_counts(rows: DataFrame, words: Column, order: int) -> DataFrame:
    """(gram, n) of all rows; null and empty arrays have none."""
    each = rows.where(F.size(words) > 0).select(F.explode(grams_at(words, order)).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """What a gram that occurs once, twice and more often loses, from how many grams occur one to four times."""
    return discounts_of(counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())


def discounts_of(n: Sequence[int]) -> tuple[float, float, float]:
    """The same from how many grams occur one to four times."""
    if not (n[0] and n[1] and n[2]):
        return PLAIN_DISCOUNTS
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def _shares(counts: DataFrame, order: int) -> DataFrame:
    """(gram, context, own, rest): a gram's discounted share of its context, and what the context leaves for the lower order."""
    taken = discounts(counts)
    off = F.when(F.col("n") == 1, taken[0]).when(F.col("n") == 2, taken[1]).otherwise(taken[2])
    of = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 2)]
    lost = of[0] * F.lit(taken[0]) + of[1] * F.lit(taken[1]) + of[2] * F.lit(taken[2])
    if order == 1:  # one context, of every word: summed apart, so that no task has them all
        sums = counts.agg(F.sum("n").alias("total"), lost.alias("lost")).where("total is not null")
        split = counts.crossJoin(F.broadcast(sums)).withColumn("context", F.lit(""))
    else:
        within = lambda c: F.sum(c).over(Window.partitionBy("context"))
        ones = [within(F.when(x, 1).otherwise(0)) for x in (F.col("n") == 1, F.col("n") == 2, F.col("n") > 2)]
        split = counts.withColumn("context", _context(order)).withColumns({"total": within(F.col("n")), "lost": ones[0] * F.lit(taken[0]) + ones[1] * F.lit(taken[1]) + ones[2] * F.lit(taken[2])})
    return split.select("gram", "context", ((F.col("n") - off) / F.col("total")).alias("own"), (F.col("lost") / F.col("total")).alias("rest"))


def trained(rows: DataFrame, words: Column, order: int = 3) -> Model:
    """A model of the arrays of words in rows; the same words give the same model whatever their order of rows.

    An empty table gives a model whose every word is unknown, with probability 1.
    """
    if order < 1:
        raise ValueError("the order must be 1 at least")
    levels = [saved(gram_counts(rows, words, order))]
    for k in range(order - 1, 0, -1):  # a gram's count at a lower order: the different grams that end in it
        levels.insert(0, saved(levels[0].groupBy(_end("gram", k + 1).alias("gram")).agg(F.count("*").alias("n"))))
    own = _shares(levels[0], 1)
    left = own.select("rest").first()  # the same for every word: that of the empty context
    unknown = (left["rest"] if left else 1.0) / (levels[0].count() + 1)
    grams = [saved(own.select("gram", (F.col("own") + unknown).alias("p")))]
    best = grams[0].agg(F.max("p")).first()[0]
    best = unknown if best is None else max(best, unknown)
    contexts = []
    for k in range(2, order + 1):
        own = _shares(levels[k - 1], k)
        lower = grams[-1].select(F.col("gram").alias("end"), F.col("p").alias("low"))
        full = own.withColumn("end", _end("gram", k)).join(lower, "end").select("gram", "context", (F.col("own") + F.col("rest") * F.col("low")).alias("p"), "rest")
        full = saved(full)
        tops = full.groupBy("context").agg(F.max("p").alias("seen"), F.max("rest").alias("rest"))
        # a best word of the lower order that the context has seen has more here than its share of the rest
        if contexts:
            above = contexts[-1].select(F.col("context").alias("end"), F.col("top").alias("low"))
            tops = tops.withColumn("end", _end("context", k - 1)).join(above, "end", "left").withColumn("low", F.coalesce("low", F.lit(best))).drop("end")
        else:
            tops = tops.withColumn("low", F.lit(best))
        contexts.append(saved(tops.select("context", "rest", F.greatest("seen", F.col("rest") * F.col("low")).alias("top"))))
        grams.append(full.select("gram", "p"))
    return Model(order, tuple(grams), tuple(contexts), unknown, best)


def probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, p, top) of distinct grams of the model's order: the last word's probability after the others, and the best word's there."""

    def at(own: DataFrame, k: int) -> DataFrame:
        seen = model.grams[k - 1].select("gram", F.col("p").alias("seen"))
        if k == 1:
            return own.join(seen, "gram", "left").select("gram", F.coalesce("seen", F.lit(model.unknown)).alias("p"), F.lit(model.best).alias("top"))
        here = saved(own.withColumn("context", _context(k)).join(seen, "gram", "left").join(model.contexts[k - 2], "context", "left").select("gram", "seen", "rest", "top"))
        here = here.withColumn("end", _end("gram", k))
        fewer = here.where("seen is null or top is null").select(F.col("end").alias("gram")).distinct()  # only these need the lower order
        lower = at(fewer, k - 1).select(F.col("gram").alias("end"), F.col("p").alias("low"), F.col("top").alias("low_top"))
        done = here.join(lower, "end", "left")
        return done.select("gram", F.coalesce("seen", F.coalesce("rest", F.lit(1.0)) * F.col("low")).alias("p"), F.coalesce("top", "low_top").alias("top"))

    return at(grams, model.order)


def scored(rows: DataFrame, key: str, words: Column, model: Model, first: bool = False) -> DataFrame:
    """rows with nll and top, array<double>: each word's negative log probability after those before it, and the best word's probability there.

    The first word has no word before it and is left out unless `first` is set; rows with fewer than two words (and null
    ones) have null.  key tells rows apart; columns of rows with these names are replaced.
    """
    rows = rows.drop("nll", "top")
    at = rows.where(F.size(words) > 1).select(key, F.posexplode(grams_at(words, model.order)).alias("pos", "gram"))
    if not first:
        at = at.where("pos > 0")
    known = probabilities(at.select("gram").distinct(), model)
    values = at.join(known, "gram").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", (-F.log("p")).alias("nll"), "top"))).alias("__v"))
    done = rows.join(values.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return done.withColumns({"nll": F.col("__v.nll"), "top": F.col("__v.top")}).drop("__v", "__key")
