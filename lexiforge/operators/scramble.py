"""Five-letter codes for tokens: a map without collisions, scrambling and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.operators.pairs import ranked

#: 26 ** 5; codes are a one-to-one step through all of them, so neighbours in rank look unlike.
CODES, STEP = 11881376, 7368787


def code_map(rows: DataFrame, c: str) -> DataFrame:
    """(token, code) of all tokens outside quotes, by rank in token order; over 26 ** 5 tokens raise."""
    tokens = rows.select(F.explode(F.regexp_extract_all(F.regexp_replace(c, '".*?"', " "), F.lit(r"(?U)\b\w+\b|\?"), F.lit(0))).alias("token")).distinct()
    n = F.col("rank") * F.lit(STEP) % CODES
    letters = [F.chr(F.lit(65) + F.floor(n / 26**k).cast("int") % 26) for k in range(4, -1, -1)]
    checked = F.when(F.col("rank") < CODES, F.concat(*letters)).otherwise(F.raise_error(F.lit("more tokens than codes")))
    return ranked(tokens, "token", "rank").select("token", checked.alias("code"))


def unscrambled_words(rows: DataFrame, key: str, c: str, codes: DataFrame) -> DataFrame:
    """(key, text): codes that stand alone as words replaced by their tokens, others kept; a join, so the map may be large."""
    pattern = r"\b[A-Z]{5}\b"
    parts = rows.select(key, F.split(c, pattern, -1).alias("gaps"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("found"))
    each = parts.select(key, F.posexplode("found").alias("at", "code")).join(codes, "code", "left")
    back = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("token", "code").alias("t"))))["t"].alias("new"))
    joined = parts.join(back, key, "left")
    pieces = F.arrays_zip("gaps", F.coalesce("new", F.array().cast("array<string>")).alias("new"))
    return joined.select(key, F.array_join(F.flatten(F.transform(pieces, lambda x: F.array(x["gaps"], F.coalesce(x["new"], F.lit(""))))), "").alias("text"))
