"""Readers.  Each gives a DataFrame with an explicit order column where order matters; none looks at the driver's disk.

Line numbers come from monotonically_increasing_id: places within a partition, plus the counts of the file's partitions
before it.  Only those counts are summed over, so a file of any size is numbered without one task seeing it whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiforge.functions import text as X

#: Files of a knowledge base that readers leave out.
EXCLUDED = ("mondial.kif", "WN_Subsuming_Mappings.kif", "pictureList-ImageNet.kif", "pictureList.kif")
PAIR = "input string, output string"
FEATURES = (
    "n_tokens", "avg_nll", "p95", "p99", "max_surp", "spike_frac_35", "spike_frac_50", "run_norm_35", "uniq_token_ratio", "rep_1gram",
    "rep_2gram", "top1_prob_mean", "top1_minus_true_mean", "punct_ratio", "digit_ratio", "upper_ratio", "paren_imbalance_abs", "bracket_imbalance_abs",
)


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8", **options) -> DataFrame:
    """(file, line_num, value): lines of text files, numbered from 1 in each file."""
    raw = spark.read.options(encoding=encoding, **options).text(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()})
    raw = raw.withColumn("part", F.shiftright("at", 33))
    counts = raw.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    upto = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select("file", "part", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    number = F.col("before") + F.col("at") - F.col("first") + 1
    # a row for each file and split: lines stay where they are read
    return raw.join(F.broadcast(placed), ["file", "part"]).select("file", number.cast("int").alias("line_num"), "value")


def result_lines(spark: SparkSession, base: str, model: str = "*", method: str = "*") -> DataFrame:
    """(model, method, file, line_num, value): lines of the .txt files in base/model/method, all of them or one's; a folder without files gives no rows."""
    try:
        found = lines(spark, f"{base.rstrip('/')}/{model}/{method}/*.txt")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "model string, method string, file string, line_num int, value string")
    at = F.split("file", "/")
    return found.select(F.try_element_at(at, F.lit(-3)).alias("model"), F.try_element_at(at, F.lit(-2)).alias("method"), "file", "line_num", "value")


def sentence_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_num, sentence): lines that aren't blank, trimmed, under the numbers that they have in the file."""
    return lines(spark, path).select("line_num", F.trim("value").alias("sentence")).where("sentence <> ''")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, input, output) of a JSON array of pairs."""
    rows = spark.read.schema(PAIR).option("multiLine", True).json(path)
    return rows.withColumn("at", F.monotonically_increasing_id()).select(F.col("at").alias("row_id"), "input", "output")


def json_lines(spark: SparkSession, path: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines that have the field, and the lines that are malformed or lack it; no good row raises ValueError."""
    rows = spark.read.text(path).withColumn("row", F.from_json("value", f"`{field}` string, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = rows.where(F.col(f"row.{field}").isNotNull()).select(F.col(f"row.{field}").alias(field))
    bad = rows.where(F.col(f"row.{field}").isNull() & (F.trim("value") != "")).select("value")
    if good.isEmpty():
        raise ValueError(f"no line of {path} has {field}")
    return good, bad


def feature_csv(spark: SparkSession, path: str, features: tuple[str, ...] = FEATURES, label: str | None = None) -> DataFrame:
    """A CSV with a header: sentence, features as doubles, and the label as text if there is one."""
    fields = [T.StructField("sentence", T.StringType())] + [T.StructField(f, T.DoubleType()) for f in features] + ([T.StructField(label, T.StringType())] if label else [])
    return spark.read.schema(T.StructType(fields)).csv(path, header=True, escape='"', multiLine=True)


def after_preamble(rows: DataFrame) -> DataFrame:
    """(sentence, validity) from lines (line_num, value): rows after the header 'Sentence,Valid/Invalid...'; the last of equal sentences wins."""
    head = rows.where(F.col("value").rlike(r"^\s*Sentence\s*,\s*Valid/Invalid")).agg(F.min("line_num").alias("head"))
    cells = F.from_csv(F.col("value"), "sentence string, validity string", {"escape": '"'})
    kept = rows.crossJoin(F.broadcast(head)).where("line_num > head").select("line_num", cells.alias("c"))
    return kept.where("c.sentence is not null").groupBy("c.sentence").agg(F.max_by("c.validity", "line_num").alias("validity"))


def last_known(rows: DataFrame, value: str, name: str, stretch: int = 100_000) -> DataFrame:
    """rows (file, line_num, ...) with the last value that isn't null up to each line of its file.

    It is carried within stretches of lines; only each stretch's last value is carried over a file, so a large file is many tasks'.
    """
    part = rows.withColumn("__stretch", F.expr(f"line_num div {stretch}"))
    within = Window.partitionBy("file", "__stretch").orderBy("line_num")
    before = Window.partitionBy("file").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = part.groupBy("file", "__stretch").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line_num"))).alias("__end"))
    ends = ends.select(F.col("file").alias("__f"), F.col("__stretch").alias("__s"), F.last("__end", ignorenulls=True).over(before).alias("__before"))
    done = part.withColumn(name, F.last(value, ignorenulls=True).over(within)).join(ends, F.col("file").eqNullSafe(F.col("__f")) & (F.col("__stretch") == F.col("__s")))
    return done.withColumn(name, F.coalesce(name, "__before")).drop("__stretch", "__f", "__s", "__before")


def first_lines(rows: DataFrame, n: int) -> DataFrame:
    """The first n numbered lines of each file: a filter that the reader's numbers allow."""
    return rows.where(F.col("line_num") <= n)


def sectioned(rows: DataFrame, strict: bool = True) -> DataFrame:
    """(sentence, label, line_num) from lines (file, line_num, value) under section headers.

    strict: headers begin with '----', labels 1 and -1 are kept.  Else any line that names a section and 'sentence' is
    a header, 0 is kept too, and the last of equal sentences wins.
    """
    up = F.upper(F.trim("value"))
    has = lambda w: F.contains(up, F.lit(w))
    if strict:
        label = F.when(~up.startswith("----"), None).when(has("INVALID SENTENCES"), -1).when(has("VALID SENTENCES"), 1).when(has("UNCLASSIFIED"), 0)
    else:
        label = F.when(~has("SENTENCE"), None).when(has("INVALID"), -1).when(has("UNCLASSIFIED"), 0).when(has("VALID"), 1)
    filled = last_known(rows.where(F.trim("value") != "").withColumn("head", label), "head", "label")
    body = filled.where("head is null and label is not null").select("file", "line_num", F.trim("value").alias("sentence"), "label")
    if strict:
        return body.where("label <> 0").select("sentence", "label", "line_num")
    return body.groupBy("sentence").agg(F.max_by("label", F.struct("file", "line_num")).alias("label"), F.max("line_num").alias("line_num"))


def statements(rows: DataFrame) -> DataFrame:
    """(file, line_num, relation, args) from lines of knowledge files: one-line statements, comments stripped."""
    name = F.element_at(F.split("file", "/"), -1)
    bare = F.trim(F.substring_index("value", ";", 1))
    kept = rows.where(~name.isin(*EXCLUDED)).withColumn("s", bare).where(F.col("s").startswith("(") & F.col("s").endswith(")") & (F.length("s") > 1))
    terms = X.words(F.expr("substring(s, 2, length(s) - 2)"))
    return kept.withColumn("terms", terms).where("size(terms) > 0").select("file", "line_num", F.col("terms")[0].alias("relation"), F.expr("slice(terms, 2, size(terms))").alias("args"), "terms")


def knowledge_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path, recursiveFileLookup=True, pathGlobFilter="*.kif")


def knowledge_words(spark: SparkSession, path: str, variables: bool = False) -> DataFrame:
    """(word, file) of knowledge files without quoted text and comment lines; variables counts their names too (compat)."""
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.kif").text(path, wholetext=True).withColumn("file", F.input_file_name())
    whole = whole.where(~F.element_at(F.split("file", "/"), -1).isin(*EXCLUDED))
    unquoted = F.regexp_replace("value", r'(?s)"(?:[^"\\]|\\.)*+"|("(?:[^"\\]|\\.)*+\z)', "$1")  # possessive, see text.without_quotes
    each = whole.select("file", F.explode(F.split(unquoted, r"\n")).alias("line")).where("trim(line) <> '' and not startswith(trim(line), ';')")
    pattern = r"(?U)\b\w+\b" if variables else r"(?U)(?<!\?)\b\w+\b"
    return each.select("file", F.explode(F.regexp_extract_all(F.regexp_replace("line", r"(?U)[^\w\s?]", ""), F.lit(pattern), F.lit(0))).alias("word")).distinct()


def wordnet_lines(rows: DataFrame) -> DataFrame:
    """Parsed mapping lines: synset_id, words, hypernyms, gloss, subsuming, equal, line_num (those that end in + or = and aren't comments)."""
    kept = rows.where("not startswith(value, ';') and (endswith(trim(value), '+') or endswith(trim(value), '='))").withColumn("p", F.split(F.trim("value"), r"\s+")).where("size(p) > 3")
    kept = kept.withColumn("n", F.conv(F.col("p")[3], 16, 10).cast("int")).where("size(p) > 4 + 2 * n")
    kept = kept.withColumn("m", F.expr("try_cast(p[4 + 2 * n] as int)"))
    words = F.expr("transform(sequence(0, n - 1), i -> p[4 + 2 * i])")
    pointers = F.expr("filter(transform(sequence(0, m - 1), i -> struct(get(p, 5 + 2 * n + 4 * i) as s, concat(get(p, 6 + 2 * n + 4 * i), '-', get(p, 7 + 2 * n + 4 * i)) as id)), x -> x.s = '@')")
    gloss = F.translate(F.trim(F.substring_index(F.substring_index("value", "|", -1), "&%", 1)), '"', "'")
    named = lambda mark: F.transform(F.regexp_extract_all("value", F.lit(r"&%([^+=]+)" + mark), F.lit(1)), F.trim)
    return kept.select(
        "line_num", F.concat_ws("-", F.col("p")[0], F.col("p")[2]).alias("synset_id"), F.when(F.col("n") > 0, words).otherwise(F.array()).alias("words"),
        F.when(F.col("m") > 0, pointers["id"]).otherwise(F.array().cast("array<string>")).alias("hypernyms"), F.when(F.contains("value", F.lit("|")), gloss).alias("gloss"),
        named(r"\+").alias("subsuming"), named("=").alias("equal"), "value",
    )


def corpus_tokens(rows: DataFrame) -> DataFrame:
    """(line_num, word, root, pos) of tab-separated lines of 3 columns, or of 5 of which the last three count; others are left out."""
    cells = rows.withColumn("c", F.split("value", "\t")).where("size(c) in (3, 5)").withColumn("c", F.expr("slice(c, size(c) - 2, 3)"))
    return cells.select("line_num", F.col("c")[0].alias("word"), F.col("c")[1].alias("root"), F.col("c")[2].alias("pos"))


def documents(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """(file, text) of text or PDF files; extract(bytes) -> str reads PDFs (pluggable); other types raise.

    Line ends after a hyphen vanish, others become spaces.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    @F.pandas_udf("string")
    def read(names, contents):
        import pandas as pd

        def one(name: str, content: bytes) -> str:
            if name.endswith(".txt"):
                return content.decode("utf-8", "replace")
            if name.endswith(".pdf") and extract:
                return extract(content)
            raise ValueError(f"can't read {name}")

        return pd.Series([one(n, c) for n, c in zip(names, contents)])

    return raw.select(F.col("path").alias("file"), F.replace(F.replace(read("path", "content"), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" ")).alias("text"))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """An Excel sheet as strings, where pandas has an Excel engine (a test set that a driver holds)."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, dtype=str).where(lambda d: d.notna(), None))


def at_rows(rows: DataFrame, wanted: list[int], row_id: str = "row_id") -> DataFrame:
    """Rows by number: a pushed-down filter in place of a byte-offset index."""
    return rows.where(F.col(row_id).isin(wanted))
