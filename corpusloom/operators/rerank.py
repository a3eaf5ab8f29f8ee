"""Second-stage ordering of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import top_per_key


def lexical_score(tokens, title, heading, snippet):
    """Hits of query tokens in title and heading, saturated counts in the snippet."""
    low_t, low_h, low_s = F.lower(title), F.lower(heading), F.lower(snippet)

    def one(acc, t):
        hits = (F.length(low_s) - F.length(F.replace(low_s, t, F.lit("")))) / F.length(t)
        return (
            acc
            + F.when(F.contains(low_t, t), K.TITLE_HIT).otherwise(0.0)
            + F.when(F.contains(low_h, t), K.HEADING_HIT).otherwise(0.0)
            + F.when(hits > 0, hits * (K.BM25_K1 + 1) / (hits + K.BM25_K1)).otherwise(0.0) * K.CONTENT_TF
        )

    phrase = F.array_join(tokens, "")
    raw = F.aggregate(tokens, F.lit(0.0), one) + F.when(
        (F.length(phrase) >= K.PHRASE_MIN) & F.contains(low_s, phrase), K.PHRASE_BONUS
    ).otherwise(0.0)
    short = F.when(F.length(snippet) < K.SHORT_CHUNK_CHARS, K.SHORT_CHUNK_PENALTY).otherwise(1.0)
    return F.when(F.size(tokens) > 0, raw * short).otherwise(0.0)


def rerank_lexical(queries: DataFrame, results: DataFrame, top_n: int | None = None) -> DataFrame:
    """Reorder results by lexical score; equal scores keep their earlier order.
    A blank query leaves its results as they are."""
    q = queries.select("query_id", X.tokenize_rerank(F.col("text")).alias("_tok"), (X.uni_trim(F.col("text")) == "").alias("_blank"))
    scored = results.join(q, "query_id").withColumn(
        "_new",
        F.when(F.col("_blank"), F.lit(None).cast("double")).otherwise(
            lexical_score(F.col("_tok"), F.col("title"), F.col("heading"), F.col("snippet"))
        ),
    )
    order = [F.round("_new", 9).desc(), F.col("rank")]
    ranked = top_per_key(scored, ["query_id"], order, top_n, "_rank").where(~F.col("_blank"))
    same = scored.where("_blank").withColumn("_rank", F.col("rank"))
    return (
        ranked.unionByName(same)
        .withColumn("score", F.coalesce("_new", "score"))
        .withColumn("rank", F.col("_rank"))
        .select(*results.columns)
    )


def rerank_scored(results: DataFrame, scores: DataFrame, top_n: int | None = None, normalize: bool = True) -> DataFrame:
    """Order by relevance computed elsewhere; `scores` is (query_id, path, idx, relevance).
    Results without a score are dropped, as a model returns only what it scored."""
    joined = results.join(scores, ["query_id", "path", "idx"])
    ranked = top_per_key(joined, ["query_id"], [F.col("relevance").desc(), F.col("rank")], top_n, "_rank")
    best = F.greatest(F.max("relevance").over(Window.partitionBy("query_id")), F.lit(1e-4))
    value = F.col("relevance") / best if normalize else F.col("relevance")
    return ranked.withColumn("score", value).withColumn("rank", F.col("_rank")).select(*results.columns)
