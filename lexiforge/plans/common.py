"""Registration of queries with the SQL that checks them, and what both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (t, spark), t(name) giving a table; oracle is the same in DuckDB's SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"), spark)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def r6(c: Column) -> Column:
    return F.round(c, 6)


#: Text of documents in ASCII for both engines, whose word boundaries differ beyond it; terms as identifiers without variables.
ASCII_SQL = r"regexp_replace(text, '[^\x00-\x7F]', ' ', 'g')"
TERMS_SQL = rf"list_filter(regexp_extract_all({ASCII_SQL}, '\??\b[a-zA-Z_][a-zA-Z_0-9]*\b'), lambda x: x[1] <> '?')"
WORDS_SQL = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
