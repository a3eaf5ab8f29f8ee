"""Keeping chunks and vectors current from a stream of note versions.

Every micro-batch writes the new state of the notes it changed under its own number;
the current table is, per path, what the last batch holding that path wrote. A batch
that is run again overwrites its own folder, so a lost executor or a restart leaves no
duplicates, and nothing that was written before is rewritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.scale import top_per_key
from corpusloom.operators import chunking, embedding, sync

NOTE_SCHEMA = "path string, content string, mtime bigint, hash string"


def _stored(spark: SparkSession, target: str, name: str) -> DataFrame | None:
    """A table of the index, None before its first batch; any other fault is raised."""
    try:
        return spark.read.parquet(f"{target}/{name}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def newest(batch: DataFrame) -> DataFrame:
    """The last version of every path of a batch. A null content deletes the note."""
    return top_per_key(batch, ["path"], [F.col("mtime").desc(), F.col("hash").desc()], 1, "_rn").drop("_rn")


def step(batch: DataFrame, notes: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after a batch of note versions: new and changed notes are cut and
    embedded again, deleted ones are taken out, all others keep their rows."""
    last = newest(batch)
    gone = last.where("content IS NULL").select("path")
    todo = sync.changed(last.where("content IS NOT NULL"), notes)
    touched = todo.select("path").unionByName(gone)
    fresh = chunking.chunk_by_heading(todo)
    swap = lambda old, new: old.join(touched, "path", "left_anti").unionByName(new.select(*old.columns))
    return swap(notes, todo), swap(chunks, fresh), swap(vectors, embedding.embed_chunks(fresh))


def current(spark: SparkSession, target: str, name: str, before: int | None = None) -> DataFrame | None:
    """Rows of `notes`, `chunks` or `vectors` as the last batch of each path left them."""
    notes, rows = _stored(spark, target, "notes"), _stored(spark, target, name)
    if notes is None or rows is None:
        return None
    if before is not None:
        notes = notes.where(F.col("batch") < before)
    last = notes.groupBy("path").agg(F.max("batch").alias("batch"), F.max_by(F.col("content").isNotNull(), "batch").alias("there"))
    return rows.join(last.where("there"), ["path", "batch"], "left_semi").drop("batch")


def process(batch: DataFrame, batch_id: int, target: str) -> None:
    """Chunk and embed the notes of one micro-batch that are new or changed."""
    spark = batch.sparkSession
    last = newest(batch)
    known = current(spark, target, "notes", before=batch_id)
    todo = last if known is None else sync.changed(last.where("content IS NOT NULL"), known).unionByName(last.where("content IS NULL"))
    tag = lambda df: df.withColumn("batch", F.lit(batch_id))

    def put(df: DataFrame, name: str) -> None:
        tag(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("batch").parquet(f"{target}/{name}")

    # chunks are written before notes: a path counts as current only once its note is there
    put(chunking.chunk_by_heading(todo.where("content IS NOT NULL")), "chunks")
    written = _stored(spark, target, "chunks")
    if written is not None:
        put(embedding.embed_chunks(written.where(F.col("batch") == batch_id).drop("batch")), "vectors")
    put(todo.select("path", "content", "mtime", "hash"), "notes")


def stream_reindex(drops: DataFrame, target: str, checkpoint: str):
    """Start the job on a stream of note versions; returns the streaming query."""
    return (
        drops.writeStream.foreachBatch(lambda df, i: process(df, i, target))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
