"""Cutting the lineage of iterations, and the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine (tests) a temporary one where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiforge-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """df computed once, as Parquet in the shared folder: for large tables, of which a checkpoint computes the last step twice and writes rows uncompressed."""
    conf, cleaned = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(cleaned, None)
    conf.set(cleaned, "true")  # nothing else reads the shuffle files of this write
    try:
        df.write.parquet(path := f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}", compression="zstd")
    finally:
        conf.unset(cleaned) if before is None else conf.set(cleaned, before)
    return df.sparkSession.read.parquet(path)
