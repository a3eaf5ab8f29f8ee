"""The vector index: hashed n-gram vectors of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions.hashing import embed


def embed_queries(queries: DataFrame) -> DataFrame:
    """(query_id, vec) of queries with text in them."""
    return queries.where(F.length(F.trim("text")) > 0).select("query_id", embed("text").alias("vec"))


def embed_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "path", "idx", embed("content").alias("vec"), F.lit(K.VEC_DIM).alias("dim"), "hash", "mtime"
    )


def build_vectors(chunks: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Vector table for these chunks: unchanged (path, idx, hash) rows are taken over,
    only the others are embedded, and vectors whose chunk is gone are dropped."""
    if existing is None:
        return embed_chunks(chunks)
    keys = ["path", "idx", "hash"]
    kept = existing.join(chunks.select(*keys), keys, "left_semi")
    todo = chunks.join(existing.select(*keys), keys, "left_anti")
    return kept.select("path", "idx", "vec", "dim", "hash", "mtime").unionByName(embed_chunks(todo))


def index_status(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, vectors, and chunks whose current text has a vector."""
    keys = ["path", "idx", "hash"]
    c = chunks.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("v"))
    v = vectors.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("v"))
    per = c.unionByName(v).groupBy(*keys).agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    return per.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("v"), F.lit(0)).alias("vectors"),
        F.coalesce(F.sum(F.least("c", "v")), F.lit(0)).alias("indexed"),
    )
