"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's words lie on a line in shuffled document order, passed through up to `cap` times.  The mix is a
sequence of equal-word blocks.  Slot n has the point n * 2654435769 mod 2**32 (the golden ratio in 32 bits, so any
stretch of slots follows the targets closely); the point falls into one source's share of the cumulative targets;
the slot's rank among its source's slots is the block of the line that it takes.  Blocks grow with the corpus; a source
whose target is few of them gets it to the word, the last blocks following the schedule's end.

Scale: all steps are joins, sums and windows over bounded parts.  Ranks and line positions are prefix sums in two
levels (within a chunk of slots or a hash bucket of documents, then over the chunk totals), so a source with a
third of all rows never meets in one task.  Blocks hold equal words, so block joins are even.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiforge.llm.common import cut, table

WORDS = r"[^\x20\x09-\x0D]+"
SLOTS, SLOTS_A_SOURCE, CHUNK, CELL_BITS, GOLDEN = 131072, 1024, 4096, 20, 2654435769
#: Hash buckets of a source hold about this many words of all in 256.
BUCKET_WORDS = 1 << 32
#: A table of at most so many rows is broadcast (its rows are counted first).
SMALL = 10_000
#: A source whose target has fewer blocks than this gets its words to the last one, since few slots hit a narrow share unevenly.
EXACT_BELOW = 100


def _joined(big: DataFrame, side: DataFrame, rows: int, on) -> DataFrame:
    return big.join(F.broadcast(side) if rows <= SMALL else side, on)


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """sizes (source, source_size) with src (code point order from 0, null last), weight 1, 2, 3, 1, ... and target.

    Targets share the sum of all sizes by weight; none is above cap times its size.  The capped sources are those
    with the least cap / weight, so one pass in that order finds the level that the others share.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("src", F.row_number().over(one) - 1).withColumns(
        {"weight": F.expr("src % 3 + 1"), "most": F.expr(f"source_size * {cap}")}
    )
    by = Window.orderBy(F.expr("most / weight"), "src")
    t = t.withColumns(
        {
            "total": F.sum("source_size").over(Window.partitionBy()),
            "before": F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "shared": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
            "place": F.row_number().over(by),
        }
    ).withColumn("level", F.expr("(total - before) / shared"))
    t = t.withColumn("open", F.expr("most > level * weight"))
    t = t.withColumn("final", F.min_by("level", F.when(F.col("open"), F.col("place"))).over(Window.partitionBy()))
    t = t.withColumn("target", F.expr("case when open then final * weight else cast(most as double) end"))
    upto = F.coalesce(F.sum(F.floor("target")).over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("lo", F.expr("0L") + upto).withColumn("hi", F.expr("lo + floor(target)"))
    whole = F.sum(F.floor("target")).over(Window.partitionBy())
    scaled = lambda c: F.floor(F.try_divide(F.col(c).cast("double"), whole.cast("double")) * 4294967296.0)
    return t.select("source", "src", "weight", "source_size", "target", "total", scaled("lo").alias("lo"), scaled("hi").alias("hi"))


def schedule(spark: SparkSession, goals: DataFrame, total: int, sources: int) -> tuple[DataFrame, int]:
    """The mix as rows (slot, src, rank), and the words of a block."""
    block = max(1, -(-total // (SLOTS + SLOTS_A_SOURCE * sources)))
    slots = -(-total // block)
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"id * {GOLDEN}L % 4294967296L").alias("point"))
    shares = goals.where("hi > lo").select(
        "src", "lo", "hi", F.explode(F.expr(f"sequence(lo >> {CELL_BITS}, (hi - 1) >> {CELL_BITS})")).alias("cell")
    )
    drawn = (
        points.withColumn("cell", F.shiftright("point", CELL_BITS)).join(shares, "cell").where("point >= lo and point < hi")
        .select("slot", "src", F.expr(f"slot div {CHUNK}").alias("chunk"))
    )
    upto = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n")).select("src", "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("at", within).join(offsets, ["src", "chunk"])
    return ranked.select("slot", "src", (F.col("offset") + F.col("at")).alias("rank")), block


def placed(sized: DataFrame, goals: DataFrame, sources: int, total: int, seed: int) -> DataFrame:
    """Documents on their source's line: sized with src, source_size, target and start, in shuffled order."""
    own = _joined(sized, goals.select(F.col("source").alias("__s"), "src", "source_size", "target"), sources, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    own = own.withColumn("shuffle", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("spread"), F.lit(""))).cast("binary")))
    digits = 2 + max(0, math.ceil(math.log(total / BUCKET_WORDS, 16)))
    own = own.withColumn("bucket", F.substring("shuffle", 1, digits))
    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = own.groupBy("src", "bucket").agg(F.sum("size").alias("n")).select("src", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    line = Window.partitionBy("src", "bucket").orderBy("shuffle", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    at = own.withColumn("upto", F.sum("size").over(line)).join(offsets, ["src", "bucket"])
    return at.withColumn("start", F.expr("offset + upto - size")).drop("offset", "upto", "bucket", "shuffle", "spread")


def mix(docs: DataFrame, cap: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, key (xxhash64 of the text).

    taken is the number of its words that the mix takes, repeats counted: at most cap * size.  Null texts have
    size 0; a null source is a source of its own, the last; rows that repeat are documents of their own; ids may
    be null; an empty table, or one without words, takes nothing.  Only doc_id, text and source are read.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    # narrow rows, kept where they were made and made again from the input if an executor is lost
    sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("key"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("spread")).persist()
    goals = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap))
    sources, total = goals.agg(F.count("*"), F.max("total")).first()
    if not total:
        none = _joined(sized, goals.select(F.col("source").alias("__s"), "source_size", "target"), sources, F.col("source").eqNullSafe(F.col("__s")))
        return none.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "key")
    slots, block = schedule(spark, goals, total, sources)
    lines = placed(sized, goals, sources, total, seed).persist()
    # a document's passes through the line, cut at block borders; the first slot ranks above its blocks can't match
    parts = lines.where("size > 0").withColumn("begin", F.explode(F.expr(f"transform(sequence(0, {cap - 1}), p -> p * source_size + start)")))
    parts = parts.where(f"begin <= target + {16 * block}").withColumn("rank", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    piece = F.expr(f"least(begin + size, (rank + 1) * {block}) - greatest(begin, rank * {block})")
    few = f"target < {EXACT_BELOW * block}"
    drawn = parts.where(f"not {few}").withColumn("piece", piece).join(slots.select("src", "rank", "slot"), ["src", "rank"])
    last = F.greatest(F.expr(f"least(begin + size, (rank + 1) * {block}, bigint(floor(target))) - greatest(begin, rank * {block})"), F.lit(0))
    got = drawn.select("src", "start", "piece").unionByName(parts.where(few).select("src", "start", last.alias("piece")))
    sums = got.groupBy("src", "start").agg(F.sum("piece").alias("taken"))
    named = lines.withColumn("on_line", F.when(F.col("size") > 0, F.col("start")))  # unique within a source
    full = named.join(sums.withColumnRenamed("start", "on_line"), ["src", "on_line"], "left")
    return full.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "key")


def mixed_documents(docs: DataFrame, cap: int = 3, seed: int = 42) -> DataFrame:
    """The mix as whole documents, with the columns of docs: a row taken n times over stays as n rows.

    A document that the mix cuts (at most the last of each source) is rounded to whole copies.
    """
    plan = mix(docs, cap, seed).where("size > 0 and taken > 0").select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("source").alias("__source"),
        F.expr("int(round(taken / size))").alias("__copies"),
    ).where("__copies > 0")
    # cut here, or the whole schedule stands twice in the plan of the texts' join and the driver holds it anew after each of its stages
    plan = cut(plan.groupBy("__id", "__key", "__source").agg(F.collect_list("__copies").alias("__copies")))
    keyed = docs.withColumn("__k", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(plan["__id"]) & (keyed["__k"] == plan["__key"]) & keyed["source"].eqNullSafe(plan["__source"])
    # rows that repeat are equal here, so any of them may carry any of the numbers
    rows = keyed.join(plan.hint("shuffle_hash"), same)  # the side of texts needs no sort
    rest = rows.where("size(__copies) = 1").withColumn("__n", F.element_at("__copies", 1))
    nth = F.row_number().over(Window.partitionBy("__id", "__key", "__source").orderBy("__k"))
    again = rows.where("size(__copies) > 1").withColumn("__i", nth).where("__i <= size(__copies)").withColumn("__n", F.expr("element_at(__copies, __i)")).drop("__i")
    return rest.unionByName(again).withColumn("__c", F.explode(F.expr("sequence(1, __n)"))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: doc_id, size, source_size, target, taken of every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Slots counted per source give the length of the line that the blocks cover; a document takes what lies on it.
ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS spread, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source),
t AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src, sum(z) OVER ()::BIGINT AS total FROM s),
w AS (SELECT *, src % 3 + 1 AS weight, z * 3 AS most FROM t),
l AS (SELECT *, row_number() OVER o AS place,
        (total - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY most / weight, src)),
g AS (SELECT *, min_by(level, place) FILTER (WHERE most > level * weight) OVER () AS final FROM l),
h AS (SELECT *, CASE WHEN most > level * weight THEN final * weight ELSE most::DOUBLE END AS target FROM g),
i AS (SELECT *, coalesce(sum(floor(target)::BIGINT) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto,
        sum(floor(target)::BIGINT) OVER ()::BIGINT AS whole FROM h),
j AS (SELECT *, floor(upto::DOUBLE / whole::DOUBLE * 4294967296.0)::BIGINT AS lo,
        floor((upto + floor(target)::BIGINT)::DOUBLE / whole::DOUBLE * 4294967296.0)::BIGINT AS hi,
        greatest(1, (total + {SLOTS} + {SLOTS_A_SOURCE} * count(*) OVER () - 1) // ({SLOTS} + {SLOTS_A_SOURCE} * count(*) OVER ())) AS block FROM i),
p AS (SELECT unnest(range((SELECT (max(total) + max(block) - 1) // max(block) FROM j)::BIGINT)) * {GOLDEN} % 4294967296 AS point),
c AS (SELECT src, count(*) AS n FROM p JOIN j ON point >= lo AND point < hi GROUP BY src),
e AS (SELECT j.*, CASE WHEN target < {EXACT_BELOW} * block THEN floor(target)::BIGINT ELSE least(coalesce(n, 0) * block, 3 * z) END AS line FROM j LEFT JOIN c USING (src)),
q AS (SELECT doc_id, size, z, target, line,
        (sum(size) OVER (PARTITION BY src ORDER BY md5('42:' || coalesce(doc_id::VARCHAR, spread)), size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, z AS source_size, target,
  (greatest(0, least(start + size, line) - start) + greatest(0, least(z + start + size, line) - z - start)
   + greatest(0, least(2 * z + start + size, line) - 2 * z - start))::BIGINT AS taken FROM q
"""
