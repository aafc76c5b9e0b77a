"""A hidden Markov tagger: counted from tagged tokens, applied as one best path a sentence.

Tags follow one another by counted transitions; a known word has the tags that it was counted with, an unknown one the tags of the
longest known ending of rare words, smoothed from ending to longer ending.  A word's roots come from the same tokens.

Scale: texts are packed into pieces, and a piece's distinct words are looked up once each by joins, so neither the lexicon nor the
endings are broadcast, and no token carries its options; only the table of transitions, whose size is the square of the number of
tags, goes to the tasks.  A path needs one sentence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.operators.pieces import pieces, words_of
from lexiforge.operators.stored import saved

#: Words counted up to RARE times teach endings of up to LONGEST letters; what is added to each count of transitions; most tags.
RARE, LONGEST, ADDED, MOST_TAGS = 10, 4, 0.1, 1000
#: To so many partitions a task deals out rows straight to files; for more, Spark holds and sorts them first.
DIRECT = 200


@dataclass(frozen=True)
class Tagger:
    """tags, sorted; moves: log probabilities of a tag after a tag, the first row those of a first tag; lexicon (word, options), endings (ending, options), roots (word, tag, root).

    options is array<struct<tag int, score double>>: a tag's number and the log probability of the word under it, for
    endings that up to a constant.
    """

    tags: tuple[str, ...]
    moves: np.ndarray
    lexicon: DataFrame
    endings: DataFrame
    roots: DataFrame


def transitions(tokens: DataFrame) -> DataFrame:
    """(before, tag, n) of tokens (sentence_id, pos, tag): before is null for a sentence's first token.

    Tokens go to their sentence as they are, as lists of them would fill a task before.  The window sorts them: up to DIRECT partitions
    make its tasks smaller than the session's would be.
    """
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(4 * parts, DIRECT))
    before = F.lag("tag").over(Window.partitionBy("sentence_id").orderBy("pos", "tag"))
    each = tokens.select("sentence_id", "pos", "tag").repartition(parts, "sentence_id").select(before.alias("before"), "tag")
    return each.groupBy("before", "tag").agg(F.count("*").alias("n"))


def emissions(tokens: DataFrame) -> DataFrame:
    """(word, tag, n, of_word, of_tag) of tokens (word, tag): how often together and apart."""
    both = tokens.groupBy("word", "tag").agg(F.count("*").alias("n"))
    word = both.groupBy("word").agg(F.sum("n").alias("of_word"))
    tag = both.groupBy("tag").agg(F.sum("n").alias("of_tag"))
    return both.join(word, "word").join(F.broadcast(tag), "tag").select("word", "tag", "n", "of_word", "of_tag")  # a row a tag


def text_transitions(rows: DataFrame, tags: Column) -> DataFrame:
    """transitions of arrays of tags, each a sentence; null tags are left out."""
    own = F.array_compact(tags)
    before = F.concat(F.array(F.lit(None).cast("string")), own)
    each = rows.where(F.size(own) > 0).select(F.explode(F.slice(F.arrays_zip(before.alias("before"), own.alias("tag")), F.lit(1), F.size(own))).alias("x"))
    return each.groupBy("x.before", "x.tag").agg(F.count("*").alias("n"))


def trained(tokens: DataFrame, links: DataFrame | None = None) -> Tagger:
    """A tagger from tokens (sentence_id, pos, word, tag; root if there is one); rows without word or tag are left out.

    links: the transitions of the same tokens, if they are counted already.
    """
    tokens = tokens.where("word is not null and tag is not null and sentence_id is not null")
    met = saved(emissions(tokens))
    tags = sorted(r.tag for r in met.select("tag").distinct().limit(MOST_TAGS + 1).collect())
    if len(tags) > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags")
    place = {t: i for i, t in enumerate(tags)}
    number = F.create_map(*[F.lit(x) for p in place.items() for x in p])[F.col("tag")] if tags else F.lit(None).cast("int")

    counted = np.full((len(tags) + 1, len(tags)), ADDED)
    for r in (transitions(tokens) if links is None else links).collect():  # the square of the number of tags at most
        counted[0 if r.before is None else place[r.before] + 1, place[r.tag]] += r.n
    moves = np.log(counted / counted.sum(axis=1, keepdims=True)) if tags else counted

    option = F.struct(number.alias("tag"), F.log(F.col("n") / F.col("of_tag")).alias("score"))
    lexicon = saved(met.groupBy("word").agg(F.array_sort(F.collect_list(option)).alias("options")))

    share = {r.tag: r.n for r in met.groupBy("tag").agg(F.sum("n").alias("n")).collect()}  # a row a tag
    whole = sum(share.values()) or 1
    prior = [share.get(t, 0) / whole for t in tags]
    theta = float(np.std(prior, ddof=1)) if len(tags) > 1 else 0.5
    rare = met.where(F.col("of_word") <= RARE).select(F.lower("word").alias("w"), number.alias("tag"), "n")
    each = rare.select("tag", "n", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("w"))), lambda k: F.right("w", k))).alias("ending"))
    counts = each.groupBy("ending", "tag").agg(F.sum("n").alias("n")).groupBy("ending").agg(F.collect_list(F.struct("tag", F.col("n").cast("double").alias("n"))).alias("own"))
    counts = saved(counts.withColumn("own", F.aggregate("own", F.array_repeat(F.lit(0.0), len(tags)), lambda a, x: F.transform(a, lambda v, i: F.when(i == x["tag"], x["n"]).otherwise(v)))))
    total = F.aggregate("own", F.lit(0.0), lambda a, x: a + x)
    level = counts.where("length(ending) = 0").select("ending", F.col("own").alias("p"))  # none: a typed empty table
    level = level.unionByName(counts.sparkSession.createDataFrame([("", prior)], level.schema))
    done = level
    for k in range(1, LONGEST + 1):  # an ending's shares lean on those of the ending one letter shorter
        shorter = level.select(F.col("ending").alias("less"), F.col("p").alias("low"))
        own = counts.where(F.length("ending") == k).withColumn("less", F.right("ending", F.lit(k - 1))).withColumn("total", total)
        level = own.join(shorter, "less").select("ending", F.zip_with("own", "low", lambda x, y: (x / F.col("total") + theta * y) / (1 + theta)).alias("p"))
        done = done.unionByName(level)
    before = F.array(*[F.lit(float(p)) for p in prior]) if tags else F.array().cast("array<double>")
    scores = F.zip_with("p", before, lambda x, y: F.log(x / y))
    endings = saved(done.select("ending", F.filter(F.transform(scores, lambda s, i: F.struct(i.alias("tag"), s.alias("score"))), lambda x: x["score"].isNotNull()).alias("options")))

    roots = tokens if "root" in tokens.columns else tokens.withColumn("root", F.lit(None).cast("string"))
    roots = roots.where("root is not null").groupBy("word", "tag", "root").agg(F.count("*").alias("n")).groupBy("word", "tag")
    return Tagger(tuple(tags), moves, lexicon, endings, roots.agg(F.max_by("root", F.struct("n", "root")).alias("root")))


def options(words: DataFrame, tagger: Tagger) -> DataFrame:
    """(word, known, options) of distinct words: those of the lexicon, else of the longest known ending (the empty one at least)."""
    found = words.join(tagger.lexicon, "word", "left")
    new = found.where("options is null").select("word", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LONGEST)), lambda k: F.right(F.lower("word"), k))).alias("ending")).distinct()
    best = new.join(tagger.endings, "ending").groupBy("word").agg(F.max_by("options", F.length("ending")).alias("__o"))
    return found.join(best, "word", "left").select("word", F.col("options").isNotNull().alias("known"), F.coalesce("options", "__o").alias("options"))


def best_path(moves: np.ndarray, steps: list[list[tuple[int, float]]]) -> tuple[list[int], float]:
    """The tags of greatest probability for a sentence's options, and its log; of equal ones the first tags from the end back."""
    size = np.array([len(s) for s in steps], np.int64)
    tags, scores = (np.array([o[i] for s in steps for o in s], kind) for i, kind in enumerate((np.int64, np.float64)))
    path, score = best_paths(moves, np.array([len(steps)]), np.arange(len(steps)), size, tags, scores)
    return path.tolist(), float(score[0])


def best_paths(moves: np.ndarray, sizes: np.ndarray, words: np.ndarray, size: np.ndarray, tags: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best_path of sentences of so many (sizes) words, one behind the other; a word has the next `size` tags and scores as options.

    Sentences go on word by word together, as many as memory allows.
    """
    path, best, begin, start = np.zeros(len(words), np.int64), np.zeros(len(sizes)), np.cumsum(sizes) - sizes, np.cumsum(size) - size
    wide = int(size.max(initial=1))
    part = (begin // max(1, (1 << 22) // wide)).astype(np.int64) * len(sizes) + np.arange(len(sizes)) // max(1, (1 << 23) // wide**2)
    for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(part)) + 1):
        own = own[np.argsort(-sizes[own], kind="stable")]
        steps, on, prev, score = [], np.searchsorted(-sizes[own], -np.arange(sizes[own].max(initial=0)), "left"), None, None
        for k, m in enumerate(on):  # the m longest have a word here
            w = words[begin[own[:m]] + k]
            count = size[w]
            place = np.arange(count.max())
            at = np.minimum(start[w][:, None] + place, len(tags) - 1)
            now, v = tags[at], np.where(place < count[:, None], scores[at], -np.inf)
            if k:
                all_ = score[:m, None, :] + moves[prev[:m, None, :] + 1, now[:, :, None]]
                back = all_.argmax(axis=2)
                score = np.take_along_axis(all_, back[:, :, None], 2)[:, :, 0] + v
            else:
                back, score = np.zeros(now.shape, np.int64), moves[0, now] + v
            prev, end = now, int(on[k + 1]) if k + 1 < len(on) else 0
            last = score[end:m].argmax(axis=1)  # of sentences that end here
            best[own[end:m]] = score[np.arange(end, m), last]
            steps.append((m, now.astype(np.int32), back.astype(np.int16), end, last))
        state = np.zeros(len(own), np.int64)
        for k in range(len(steps) - 1, -1, -1):
            m, now, back, end, last = steps[k]
            state[end:m] = last
            rows = np.arange(m)
            path[begin[own[:m]] + k] = now[rows, state[:m]]
            state[:m] = back[rows, state[:m]]
    return path, best


def tagged_sentences(tokens: DataFrame, tagger: Tagger) -> DataFrame:
    """(sentence_id, words, known, pos, tags, score) of tokens (sentence_id, pos, word): a sentence's best path and its log probability.

    Null words are left out; repeated places keep all their words, in order; an empty table gives no sentence.
    """
    line = tokens.where("word is not null").groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("t"))
    done = tagged_texts(line, F.struct("sentence_id", F.col("t")["pos"].alias("pos")), F.col("t")["word"], tagger)
    return done.select("key.sentence_id", "words", "known", "key.pos", "tags", "score")


def tagged_texts(rows: DataFrame, key: Column, words: Column, tagger: Tagger) -> DataFrame:
    """(key, words, known, tags, score) of the arrays of words in rows, each a sentence; null and empty ones are left out.

    Texts are packed into pieces, which meet the options of their distinct words.
    """
    return tagged_pieces(pieces(rows, key, words), tagger)


def tagged_pieces(made: DataFrame, tagger: Tagger) -> DataFrame:
    """tagged_texts of texts that are in pieces."""
    each = made.select("piece", F.posexplode("words").alias("place", "word"))
    looked = saved(options(each.select("word").distinct(), tagger))
    asked = each.join(looked, "word").select(F.col("piece").alias("of"), "place", "known", F.col("options")["tag"].alias("tags"), F.col("options")["score"].alias("scores"))
    moves, names = tagger.moves, pa.array(tagger.tags, pa.string())
    kind = made.schema["keys"].dataType.elementType.simpleString()

    def paths(found: pa.Table, own: pa.Table) -> pa.Table:
        found = found.take(pc.sort_indices(found["place"])).combine_chunks()
        size = pc.list_value_length(found["tags"]).to_numpy().astype(np.int64)
        tags, scores = (pc.list_flatten(found[c]).to_numpy() for c in ("tags", "scores"))
        sizes, at = words_of(own["sizes"][0], own["data"][0])
        path, best = best_paths(moves, sizes, at, size, tags.astype(np.int64), scores)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)
        known = pa.array(found["known"].to_numpy()[at])
        return pa.table({"key": own["keys"][0].values, "words": lists(own["words"][0].values.take(pa.array(at))), "known": lists(known), "tags": lists(names.take(pa.array(path))), "score": pa.array(best)})

    return asked.groupBy("of").cogroup(made.groupBy("piece")).applyInArrow(paths, f"key {kind}, words array<string>, known array<boolean>, tags array<string>, score double")


def tagged(tokens: DataFrame, tagger: Tagger) -> DataFrame:
    """(sentence_id, pos, text, lemma, upos) of tokens (sentence_id, pos, word); a lemma is the commonest root of the word with that tag, else the word in lower case."""
    each = tagged_sentences(tokens, tagger).select("sentence_id", F.explode(F.arrays_zip("pos", F.col("words").alias("text"), F.col("tags").alias("upos"))).alias("t")).select("sentence_id", "t.pos", "t.text", "t.upos")
    roots = tagger.roots.select(F.col("word").alias("text"), F.col("tag").alias("upos"), "root")
    return each.join(roots, ["text", "upos"], "left").select("sentence_id", "pos", "text", F.coalesce("root", F.lower("text")).alias("lemma"), "upos")
