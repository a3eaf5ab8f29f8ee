"""Notes to chunks, and the chunk table kept per path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import cutting
from corpusloom.functions.batches import in_slices
from corpusloom.functions.hashing import base36, byte_hash

CHUNK_SCHEMA = (
    "path string, idx int, heading string, content string, start_offset int, end_offset int, "
    "hash string, mtime bigint"
)


def _run(notes: DataFrame, cutter) -> DataFrame:
    """Each note is cut on its own inside Arrow batches: no shuffle, and never more than a few
    notes and a bounded number of chunks in Python."""

    def rows(note):
        path = note["path"]
        name = path.rsplit("/", 1)[-1]
        name = name[:-3] if name.endswith(".md") else name
        for i, (heading, text, lo, hi) in enumerate(cutter(name, note["content"] or "")):
            yield path, i, heading, text, lo, hi, base36(byte_hash(text.encode("utf-8"))), note["mtime"]

    return in_slices(notes.select("path", "content", F.col("mtime").cast("bigint").alias("mtime")), lambda: rows, CHUNK_SCHEMA)


def chunk_by_heading(notes: DataFrame, keep_preamble: bool = False) -> DataFrame:
    return _run(notes, lambda name, text: cutting.chunk_by_heading(name, text, keep_preamble))


def chunk_by_paragraph(notes: DataFrame, size: int = K.PARAGRAPH_CHUNK) -> DataFrame:
    return _run(notes, lambda name, text: cutting.chunk_by_paragraph(name, text, size))


def path_bucket(buckets: int):
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")


def replace_by_path(target: DataFrame, updates: DataFrame) -> DataFrame:
    """All rows of a path are replaced together by its new rows."""
    return target.join(updates.select("path").distinct(), "path", "left_anti").unionByName(updates)


def reindex(notes: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Chunk table after these notes were cut again; other paths keep their chunks.
    A note that yields no chunk loses its old ones."""
    fresh = chunk_by_heading(notes)
    if chunks is None:
        return fresh
    return chunks.join(notes.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def write_chunks(chunks: DataFrame, target: str, buckets: int = 64) -> None:
    """Write by path bucket; only the buckets present in `chunks` are overwritten, so
    pass the whole content of every bucket touched (see `reindex`)."""
    (
        chunks.withColumn("path_bucket", path_bucket(buckets))
        .repartition("path_bucket", F.pmod(F.xxhash64("path", "idx"), F.lit(16)))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("path_bucket").parquet(target)
    )
