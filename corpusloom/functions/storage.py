"""Tables that outlive a query: written once to the folder all executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a local session that
    names none (tests in one process) gets a temporary one; elsewhere that would be a folder
    of one machine, of which the others see nothing."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpusloom-shared-")
        spark.sparkContext.setCheckpointDir(named)
        # further calls of this session find it again, below the folder Spark makes in it
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path, fs = _file_system(spark, path)
    return fs.exists(jvm_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it."""
    jvm_path, fs = _file_system(spark, path)
    fs.delete(jvm_path, True)


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, path: str, *parts: str) -> None:
    """Write a table so that it takes little disk: compressed well, and the shuffle files of
    this one write go with it instead of staying until the driver collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE, "false")
    conf.set(_FREE, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=list(parts) or None)
    finally:
        conf.set(_FREE, before)


_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("_passing", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Temporary tables that are written inside go where this ends: nothing reads them after."""
    outer = _passing.set([])
    try:
        yield
    finally:
        for path in _passing.get():
            remove(spark, path)
        _passing.reset(outer)


def temporary(df: DataFrame) -> DataFrame:
    """A narrow table that several later steps read: written once, so that they neither
    compute nor plan it again, nor depend on executors. The tables of an application go
    when its driver ends, those that only the writing of a kept table needs with that."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_forget, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    if (going := _passing.get()) is not None:
        going.append(path)
    save(df, path)
    return spark.read.schema(df.schema).parquet(path)


_folders: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        remove(spark, folder)


def version(table: DataFrame) -> str:
    """A name for the state of the files that a table is read from: their paths, sizes and
    times, as the scan itself tells them. No column is read."""
    files = table.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("f")).distinct()
    mark = files.agg(F.count("*").alias("n"), F.sum(F.col("f").cast("decimal(38,0)")).alias("s"), F.bit_xor("f").alias("x")).first()
    return uuid.uuid5(uuid.NAMESPACE_OID, f"{mark['n']} {mark['s']} {mark['x']}").hex


def kept(spark: SparkSession, name: str, write) -> str:
    """Path of what `write(path)` has written for this name. It is written once; a marker
    written last tells a whole one from one that a lost driver has left behind."""
    path = f"{shared_folder(spark)}/{name}"
    if not exists(spark, f"{path}/whole"):
        remove(spark, path)
        with passing(spark):
            write(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}/whole")
    return path
