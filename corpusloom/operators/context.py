"""Prompt contexts and citations. Result lists per query are already cut by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import small_side, top_per_key


def _joined(df: DataFrame, block, out: str) -> DataFrame:
    rows = df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("_rows"))
    return rows.select("query_id", F.array_join(F.col("_rows.b"), K.BLOCK_SEPARATOR).alias(out))


def rag_context(queries: DataFrame, kb: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """(query_id, n_kb, n_web, context): numbered note and web blocks per query; a query
    with neither gets the fixed "nothing found" text. Every row handed in is formatted: how
    many there are per query is set where the lists are made."""
    kb_block = F.concat(
        F.lit("[KB#"), F.col("rank").cast("string"), F.lit("] 笔记: "), "title", F.lit("\n路径: "), "path",
        F.lit("\n小节: "), "heading", F.lit("\n内容: "), X.cut(F.col("snippet"), K.CONTEXT_SNIPPET),
    )
    out = queries.select("query_id").join(_joined(kb, kb_block, "_kb"), "query_id", "left")
    out = out.join(kb.groupBy("query_id").agg(F.count("*").alias("n_kb")), "query_id", "left")
    if web is not None:
        web_block = F.concat(
            F.lit("[Web#"), F.col("rank").cast("string"), F.lit("] 标题: "), "title", F.lit("\nURL: "), "url",
            F.lit("\n摘要: "), X.cut(F.col("content"), K.CONTEXT_SNIPPET),
        )
        out = out.join(_joined(web, web_block, "_web"), "query_id", "left")
        out = out.join(web.groupBy("query_id").agg(F.count("*").alias("n_web")), "query_id", "left")
    else:
        out = out.withColumn("_web", F.lit(None).cast("string")).withColumn("n_web", F.lit(0).cast("bigint"))
    section = lambda head, body: F.when(F.col(body).isNotNull(), F.concat(F.lit(head + "\n\n"), F.col(body)))
    return out.select(
        "query_id", F.coalesce("n_kb", F.lit(0)).alias("n_kb"), F.coalesce("n_web", F.lit(0)).alias("n_web"),
        F.when(F.col("_kb").isNull() & F.col("_web").isNull(), K.NOTHING_FOUND)
        .otherwise(F.concat_ws("\n\n", section(K.KB_SECTION, "_kb"), section(K.WEB_SECTION, "_web")))
        .alias("context"),
    )


def pin_current(results: DataFrame, chunks: DataFrame, current: DataFrame) -> DataFrame:
    """Put the first chunks of the open note ahead of the results; `current` is (query_id, path)."""
    # the open notes are few, one a query: texts of the chunks stay where they are
    pinned = chunks.where(F.col("idx") >= 0).select("path", "idx", "heading", "content", "mtime").join(small_side(current), "path")
    pinned = top_per_key(pinned, ["query_id"], [F.col("idx")], K.PIN_CHUNKS).select(
        "query_id", "rank", "path", "idx", "heading", X.title_of(F.col("path")).alias("title"),
        F.col("content").alias("snippet"), F.lit(1.0).alias("score"), "mtime",
    )
    both = pinned.withColumn("_src", F.lit(0)).unionByName(results.withColumn("_src", F.lit(1)))
    ranked = top_per_key(both, ["query_id"], [F.col("_src"), F.col("rank")], K.PIN_TOTAL, "_rank")
    return ranked.withColumn("rank", F.col("_rank")).select(*results.columns)


def citations_used(answers: DataFrame, kb: DataFrame) -> DataFrame:
    """(query_id, pos, rank, path, idx): references in an answer, distinct, in order of
    first use, resolved to the ranked result; unresolved ones are dropped."""
    refs = F.array_distinct(
        F.transform(F.regexp_extract_all("text", F.lit(r"\[KB#(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    )
    named = answers.select("query_id", F.posexplode(refs).alias("pos", "rank"))
    return named.join(kb.select("query_id", "rank", "path", "idx"), ["query_id", "rank"]).select(
        "query_id", "pos", "rank", "path", "idx"
    )
