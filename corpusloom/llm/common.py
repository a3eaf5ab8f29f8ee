"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WS = " \t\n\x0b\x0c\r"  # the white space that separates words: [\x20\x09-\x0D]
WS_CLASS = "[ \\t-\\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Only a session that names
    none (tests in one process) gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="corpusloom-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back: later jobs neither
    compute it again nor depend on any executor."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is. `lower` means the same on pure ASCII
    and is much faster than `translate`."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(slow)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
