"""Words outside the vocabulary: masking with ids per sentence, and unmasking with type axioms.

Tokens are rows (sentence_id, pos, text, lemma, upos), entities rows (sentence_id, pos, text, type), both from a tagger.
Ids need only one sentence at a time, so sentences are independent: no shared table, no global state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import python as P
from lexiforge.functions import text as X
from lexiforge.operators import pairs

MASK = r"UNK_(\w+)_([\d]+)"


def unknown_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """tokens with type: that of nouns and verbs whose lower-cased lemma the vocabulary (root, pos) lacks, else null.

    The vocabulary, a row a known word, goes to all tasks, so the tokens aren't shuffled by their words (of which few are very frequent).
    """
    typed = tokens.withColumn("type", X.word_type(F.col("upos")))
    known = F.broadcast(vocabulary.select(F.lower("root").alias("root"), F.col("pos").alias("kind")).distinct().withColumn("known", F.lit(True)))
    hit = typed.join(known, (F.lower("lemma") == F.col("root")) & (F.col("type") == F.col("kind")), "left")
    return hit.withColumn("type", F.when(F.col("known").isNull(), F.col("type"))).drop("root", "kind", "known")


def _dealt(tokens: DataFrame) -> DataFrame:
    return tokens.select("sentence_id", "pos", "type", "text").repartition("sentence_id")


def _numbered(tokens: DataFrame) -> DataFrame:
    """(sentence_id, pos, type, text, id): per sentence and type ids from 1 in order of first appearance; a repeated word keeps its id.

    Tokens are dealt by sentence once, and all that follows stays where it is; several uses share that one exchange.
    """
    first = _dealt(tokens).withColumn("first", F.min("pos").over(Window.partitionBy("sentence_id", "type", "text")))
    place = F.dense_rank().over(Window.partitionBy("sentence_id", "type").orderBy("first", "text"))  # one sentence's words
    return first.withColumn("id", F.when(F.col("type").isNotNull(), place)).drop("first")


def unknown_words(tokens: DataFrame) -> DataFrame:
    """(sentence_id, type, word, id): per sentence and type ids from 1 in order of first appearance; a repeated word keeps its id."""
    each = _dealt(tokens).groupBy("sentence_id", "type", "text").agg(F.min("pos").alias("first"))  # known words too: without them masked() would need an exchange of its own
    place = F.row_number().over(Window.partitionBy("sentence_id", "type").orderBy("first", "text"))
    numbered = each.withColumn("id", F.when(F.col("type").isNotNull(), place)).where("id is not null")
    return numbered.select("sentence_id", "type", F.col("text").alias("word"), "id")


def largest_id(words: DataFrame) -> DataFrame:
    """(sentence_id, type, max_id); a sentence without such words has no row (null after a left join)."""
    return words.groupBy("sentence_id", "type").agg(F.max("id").alias("max_id"))


def masked(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masked sentences (sentence_id, text), and their unknown words; tokens as unknown_tokens gives them (entity types too).

    Tokens without a sentence have no masks.
    """
    mask = F.when(F.col("sentence_id").isNotNull(), F.concat(F.lit("UNK_"), F.col("type"), F.lit("_"), F.col("id").cast("string")))
    named = _numbered(tokens).select("sentence_id", "pos", F.coalesce(mask, "text").alias("text"))
    line = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"], " ")
    return named.groupBy("sentence_id").agg(line.alias("text")), unknown_words(tokens)


def tagged_lines(sentences: DataFrame) -> DataFrame:
    """(sentence_id, ord, value): the text form, a SentenceId line before each sentence."""
    head = sentences.select("sentence_id", F.lit(0).alias("ord"), F.concat(F.lit("SentenceId:"), F.col("sentence_id").cast("string")).alias("value"))
    return head.unionByName(sentences.select("sentence_id", F.lit(1).alias("ord"), F.col("text").alias("value")))


def read_tagged(lines: DataFrame) -> DataFrame:
    """(sentence_id, line_num, text) of lines (file, line_num, value): ids are carried down to the lines after them."""
    found = F.nullif(F.regexp_extract("value", r"^SentenceId:(\d+)", 1), F.lit("")).cast("int")
    return pairs.carried(lines, found, "line_num", ["file"], "sentence_id").where(found.isNull()).select("sentence_id", "line_num", F.col("value").alias("text"))


def unmasked(lines: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (sentence_id, line_num, text) with masks replaced by their formatted words, and the words used (word, type).

    A mask without a word stays.  A sentence's lines meet its words in one row, so their masks aren't dealt out or sorted.
    """
    own = words.where("sentence_id is not null").select("sentence_id", F.concat(F.lit("UNK_"), "type", F.lit("_"), F.col("id").cast("int").cast("string")).alias("mask"), X.format_word(F.col("word")).alias("word"))
    own = own.where("mask is not null and word is not null").groupBy("sentence_id").agg(F.collect_list(F.struct("mask", "word")).alias("w"))
    apart = F.when(F.col("sentence_id").isNull(), F.col("line_num"))  # lines without a sentence have no words and needn't meet
    line = lines.groupBy("sentence_id", apart.alias("apart")).agg(F.collect_list(F.struct("line_num", "text")).alias("t"))
    both = line.join(own, "sentence_id", "left").select("sentence_id", F.col("t")["line_num"].alias("line_num"), P.unmasked(F.col("t")["text"], F.col("w")["mask"], F.col("w")["word"]).alias("text"))
    done = both.select("sentence_id", F.explode(F.arrays_zip("line_num", "text")).alias("x")).select("sentence_id", "x.line_num", "x.text")
    return done, _used(lines, words)


def _used(lines: DataFrame, words: DataFrame) -> DataFrame:
    """(word, type, first) of the words that masks in lines stand for; first is the place of the first mask."""
    each = lines.select("sentence_id", "line_num", F.posexplode(F.regexp_extract_all("text", F.lit(MASK), F.lit(0))).alias("at", "mask"))
    each = each.withColumns({"type": F.regexp_extract("mask", MASK, 1), "id": F.regexp_extract("mask", MASK, 2).cast("int")})
    found = each.join(words.select("sentence_id", "type", "id", X.format_word(F.col("word")).alias("word")), ["sentence_id", "type", "id"])
    return found.where("word is not null").groupBy("word", "type").agg(F.min(F.struct("line_num", "at")).alias("first"))


def axioms(used: DataFrame) -> DataFrame:
    """(word, type, value): one type axiom for each used word with a term, persons also with their name; first is their order."""
    term = X.entity_term(F.col("type"))
    human = F.format_string('( and ( instance %s Human ) (names "%s" %s ) )', "word", "word", "word")
    other = F.format_string("( instance %s %s )", F.col("word"), term)
    return used.withColumn("value", F.when(term == "Human", human).when(term.isNotNull(), other)).where("value is not null")


def snapped_join(words: DataFrame, hits: DataFrame, cell: int = 4096) -> DataFrame:
    """(sentence_id, start, word): words (sentence_id, start, word) that hits (sentence_id, at) fall into, without marks at their ends, once each.

    A range join: words and hits of a cell of characters are put in one order, in which each word looks for the next hit from its start on;
    so they aren't paired, and are dealt out once.  Null and empty words, null places and null sentences meet nothing.
    """
    trimmed: Column = F.regexp_replace("word", r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")
    own = words.where("length(word) > 0 and start is not null").select("sentence_id", F.col("start").cast("long").alias("start"), "word")
    places = hits.where("at is not null").select("sentence_id", F.col("at").cast("long").alias("start"), F.lit(None).cast("string").alias("word"))  # a hit has no word
    both = own.unionByName(places).where("sentence_id is not null").repartition("sentence_id")
    last = F.col("start") + F.coalesce(F.length("word"), F.lit(1)) - 1
    both = both.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(last / cell))))
    both = both.withColumns({"p": F.greatest("start", F.col("cell") * cell), "at": F.when(F.col("word").isNull(), F.col("start"))})
    down = Window.partitionBy("sentence_id", "cell").orderBy(F.desc("p"), F.col("word").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("next", F.last("at", ignorenulls=True).over(down)).where(F.col("word").isNotNull() & (F.col("next") <= last))
    return hit.select("sentence_id", "start", trimmed.alias("word")).distinct()
