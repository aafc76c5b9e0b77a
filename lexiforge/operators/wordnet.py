"""New terms from WordNet mapping lines: a term for each synset that is only subsumed, named after its word and its parent.

Rows are what readers.wordnet_lines gives.  Terms are made level by level, parents before children, so a level is one
join; names that clash get numbers in line order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import python as P
from lexiforge.operators.knowledge import numbered_names
from lexiforge.operators.stored import stored
from lexiforge.sources.writers import documentation, term_format

OWN_FILE = 100


def children(lines: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(root, pos, synset_id, ..., n_children): each line under each of its subsuming terms that isn't a relation (term)."""
    each = lines.withColumn("subsuming", F.array_distinct("subsuming")).select("*", F.posexplode("subsuming").alias("pos", "root"))
    if relations is not None:
        each = each.join(relations.select(F.col("term").alias("root")).distinct(), "root", "left_anti")
    return each.join(each.groupBy("root").agg(F.count("*").alias("n_children")), "root")


def new_terms(
    lines: DataFrame, taken: DataFrame | None = None, relations: DataFrame | None = None, attributes: DataFrame | None = None, instances: DataFrame | None = None, most_levels: int = 1000,
) -> DataFrame:
    """(synset_id, line_num, root, term, parent, words, gloss, n_children, level, links): a term for each synset.

    Of a synset's subsuming terms (without relations) the one that appears first of all is its root.  It hangs below the
    terms of its hypernyms under that root, which take the root's place, and below its other subsuming terms; the last
    hypernym, else the first subsuming term, gives the name.  links are array<struct<relation, parent>>: a term whose
    parents are all attributes (term) is one too; below an attribute it is its subAttribute if that is an instance (term),
    else its instance, and an attribute of it if it has other parents as well; all else are subclasses.  Names clash with
    taken terms and earlier ones, by level, root and line.  Hypernyms in a cycle, which no level reaches, are left out.
    """
    under = stored(children(lines, relations))
    first = under.groupBy("root").agg(F.min(F.struct("line_num", "pos")).alias("seen"))
    own = under.join(first, "root").groupBy("synset_id").agg(
        F.min(F.struct("seen", "root", "n_children")).alias("r"), F.array_sort(F.collect_list(F.struct("pos", "root")))["root"].alias("maps"),
        F.min(F.struct("line_num", "words", "hypernyms", "gloss")).alias("l"),
    ).select("synset_id", "l.*", F.col("r.root").alias("root"), F.col("r.n_children").alias("n_children"), "maps")
    inside = under.select("root", F.col("synset_id").alias("above")).distinct()
    ups = own.select("synset_id", "root", F.posexplode("hypernyms").alias("at", "above")).where("above <> synset_id").join(inside, ["root", "above"]).select("synset_id", "at", "above")
    wait = ups.groupBy("synset_id").agg(F.countDistinct("above").alias("wait"))
    todo = stored(own.join(wait, "synset_id", "left").withColumn("wait", F.coalesce("wait", F.lit(0))))
    ups = stored(ups)
    flag = lambda df, name: (lines.sparkSession.createDataFrame([], "term string") if df is None else df.select("term")).distinct().withColumn(name, F.lit(True))
    att, ins = flag(attributes, "att"), flag(instances, "ins")

    @F.pandas_udf("string")
    def name(word, parent_, grand):
        import pandas as pd

        return pd.Series([P.term_name(w, p or "", g or "") for w, p, g in zip(word, parent_, grand)])

    out, names = None, taken.select("term") if taken is not None else None
    for n in range(most_levels):
        if out is None:
            level = todo.where("wait = 0").withColumn("new", F.array().cast("array<struct<at:int,term:string,att:boolean,ins:boolean,grand:string>>"))
        else:
            made = out.select(F.col("synset_id").alias("above"), F.col("root").alias("r"), "term", "att", "ins", "parent")
            met = ups.join(made, "above").join(todo.select("synset_id", "root", "wait"), "synset_id").groupBy("synset_id").agg(
                F.countDistinct("above").alias("met"), F.max("wait").alias("w"),
                F.array_sort(F.collect_list(F.struct("at", "term", "att", "ins", F.when(F.col("r") == F.col("root"), F.col("parent")).otherwise("").alias("grand")))).alias("new"),
            )
            level = todo.join(met.where("met = w").drop("met", "w"), "synset_id").join(out.select("synset_id"), "synset_id", "left_anti")
        last = F.try_element_at("new", F.lit(-1))
        base = level.withColumn("base", name(F.col("words")[0], F.coalesce(last["term"], F.col("maps")[0]), F.coalesce(last["grand"], F.lit("")))).withColumn("at", F.struct("root", "line_num"))
        if base.isEmpty():
            break
        termed = numbered_names(base, "base", "at", names).withColumnRenamed("unique", "term").drop("base", "at")
        kept = F.when(F.size("new") > 0, F.array_remove("maps", F.col("root"))).otherwise(F.col("maps"))
        plain = termed.select("synset_id", F.posexplode(kept).alias("at", "up")).join(att.withColumnRenamed("term", "up"), "up", "left").join(ins.withColumnRenamed("term", "up"), "up", "left")
        plain = plain.groupBy("synset_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("up").alias("term"), F.coalesce("att", F.lit(False)).alias("att"), F.coalesce("ins", F.lit(False)).alias("ins")))).alias("plain"))
        short = lambda c: F.transform(c, lambda x: F.struct(x["term"].alias("term"), x["att"].alias("att"), x["ins"].alias("ins")))
        parents = F.concat(short(F.reverse("new")), F.coalesce(short("plain"), F.array().cast("array<struct<term:string,att:boolean,ins:boolean>>")))
        done = termed.join(plain, "synset_id", "left").withColumn("parents", parents).withColumn("att", F.forall("parents", lambda x: x["att"]))
        links = F.transform("parents", lambda x: F.struct(relation(F.col("att"), x["att"], x["ins"]).alias("relation"), x["term"].alias("parent")))
        done = done.withColumn("links", links).withColumn("ins", F.exists("links", lambda x: x["relation"] == "instance"))
        done = done.select("synset_id", "line_num", "root", "term", F.col("parents")[0]["term"].alias("parent"), "words", "gloss", "n_children", F.lit(n).alias("level"), "links", "att", "ins")
        out = stored(done if out is None else out.unionByName(done))
        names = out.select("term") if taken is None else taken.select("term").union(out.select("term"))
    else:
        raise RuntimeError(f"hypernyms are deeper than {most_levels} levels")
    if out is None:
        raise ValueError("no synset is subsumed by a term")
    return out.drop("att", "ins")


def relation(is_attribute, parent_is_attribute, parent_is_instance):
    """The relation of a new term to its parent."""
    return (
        F.when(~parent_is_attribute, "subclass").when(~is_attribute, "attribute").when(parent_is_instance, "subAttribute").otherwise("instance")
    )


def statements(terms: DataFrame) -> DataFrame:
    """(file, line_num, ord, value): documentation, relation and termFormat statements; roots of 100 children and more have their own file."""
    rel = F.transform("links", lambda x: F.format_string("(%s %s %s)", x["relation"], F.col("term"), x["parent"]))
    formats = F.transform("words", lambda w: term_format(F.col("term"), F.replace(w, F.lit("_"), F.lit(" "))))
    all_lines = F.concat(F.array(documentation(F.col("term"), F.col("gloss"))), rel, formats)
    file = F.when(F.col("n_children") >= OWN_FILE, F.concat("root", F.lit(".kif"))).otherwise("UNCATEGORIZED.kif")
    return terms.select(file.alias("file"), "line_num", F.posexplode(all_lines).alias("ord", "value"))


def updated_lines(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """(line_num, value): mapping lines whose subsuming term gives way to the new one, as equal."""
    new = terms.select("line_num", F.col("root").alias("old"), F.col("term").alias("new"))
    return lines.join(new, "line_num", "left").select("line_num", F.coalesce(F.replace("value", F.concat(F.lit("&%"), F.col("old"), F.lit("+")), F.concat(F.lit("&%"), F.col("new"), F.lit("="))), F.col("value")).alias("value"))
