"""Lexical, vector and fused search for batches of queries.

`queries` is (query_id, text). `chunks` is (path, idx, heading, content, mtime).
Results are (query_id, rank, path, idx, heading, title, snippet, score, mtime).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import BROADCAST_ROWS, is_small, small_side, top_per_key
from corpusloom.operators import paths as P

RESULT_COLS = ["query_id", "rank", "path", "idx", "heading", "title", "snippet", "score", "mtime"]


def _by_score() -> list[Column]:
    """Best first. Rounding makes sums that differ only by order of addition tie, and
    ties follow the key order of the chunks."""
    return [F.round("score", 9).desc(), F.col("path"), F.col("idx")]


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, scope_id, token, times): query tokens keep their multiplicity."""
    return (
        queries.select("query_id", "scope_id", F.explode(X.tokenize(F.col("text"))).alias("token"))
        .groupBy("query_id", "scope_id", "token")
        .agg(F.count("*").alias("times"))
    )


def postings(chunks: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(scope_id, path, idx, doc_len, token, tf). With a vocabulary, tokens outside it
    are dropped before anything is shuffled; `doc_len` still counts all tokens. On a
    table bucketed by path the grouping needs no shuffle at all."""
    scoped = chunks if "scope_id" in chunks.columns else chunks.withColumn("scope_id", F.lit(0).cast("bigint"))
    keys = ["scope_id", "path", "idx"]
    tokens = scoped.select(*keys, X.tokenize(F.col("content")).alias("tokens"))
    # explode_outer: the plain form adds a filter that would tokenize once more
    exploded = tokens.select(*keys, F.size("tokens").alias("doc_len"), F.explode_outer("tokens").alias("token"))
    if vocabulary is not None:
        exploded = exploded.join(small_side(vocabulary.select("token").distinct()), "token", "left_semi")
    else:
        exploded = exploded.where(F.col("token").isNotNull())
    return exploded.groupBy(*keys, "doc_len", "token").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(scope_id, token, df). Counting `tf`, never null, keeps the column in the plan, so
    the shuffle of the postings is shared with the scoring branch instead of repeated."""
    return post.groupBy("scope_id", "token").agg(F.sum(F.signum("tf")).cast("bigint").alias("df"))


def corpus_sizes(chunks: DataFrame) -> DataFrame:
    """(scope_id, n): number of chunks each scope searches, tokens or not."""
    if "scope_id" in chunks.columns:
        return chunks.groupBy("scope_id").agg(F.count("*").alias("n"))
    return chunks.agg(F.count("*").alias("n")).select(F.lit(0).cast("bigint").alias("scope_id"), "n")


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, doc_len: Column) -> Column:
    k1, b = K.BM25_K1, K.BM25_B
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / K.BM25_AVG_LEN))


def bm25_scores(q_tokens: DataFrame, post: DataFrame, df: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, path, idx, score) of every chunk sharing a token with the query.

    `q_tokens` is (query_id, scope_id, token, times). Weights are one row per query
    token and are broadcast when counted small; scores are summed before the shuffle.
    """
    weights = (
        q_tokens.join(df, ["scope_id", "token"])
        .join(sizes, "scope_id")
        .select("scope_id", "token", "query_id", (F.col("times") * idf(F.col("n"), F.col("df"))).alias("w"))
    )
    if is_small(q_tokens):
        weights = F.broadcast(weights)
    return (
        post.join(weights, ["scope_id", "token"])
        .groupBy("query_id", "path", "idx")
        .agg(F.sum(F.col("w") * tf_norm(F.col("tf"), F.col("doc_len"))).alias("score"))
        .where(F.col("score") > 0)
    )


def bm25_top(q_tokens: DataFrame, post: DataFrame, df: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    return top_per_key(bm25_scores(q_tokens, post, df, sizes), ["query_id"], _by_score(), k)


def ranked(queries: DataFrame, index, k: int, scope=()) -> DataFrame:
    """(query_id, rank, doc, score) of the k best chunks, from a stored `LexicalIndex`."""
    from corpusloom.operators.lexical_index import top_docs

    if "scope" not in queries.columns:
        queries = queries.withColumn("scope", F.array(*[F.lit(p) for p in scope]).cast("array<string>"))
    elif scope:
        raise ValueError("a scope for all queries and one per query cannot be combined on an index")
    queries, scopes = _scope_ids(queries)
    return top_docs(query_tokens(queries), scopes, index, k)


def bm25(
    queries: DataFrame, chunks: DataFrame | None = None, k: int = K.DEFAULT_K, max_chars: int = K.DEFAULT_MAX_CHARS,
    scope=(), index=None,
) -> DataFrame:
    """BM25 with a constant average length. A per-query `scope` column (array of path
    prefixes, empty for all) in `queries` limits the corpus of each query, which also
    changes its document frequencies. With `index`, a stored `LexicalIndex`, the chunks are
    not read at all: postings, texts of the winners and sizes of scopes come from it."""
    reach = max(1, min(k, max_chars // K.RESULT_OVERHEAD))
    if index is not None:
        return P.char_budget(_found(queries, index, reach, scope), max_chars, k)
    corpus = P.scope_filter(chunks, scope)
    if "scope" in queries.columns:
        queries, scopes = _scope_ids(queries)
        corpus = P.scope_members(corpus, scopes)
    else:
        queries = queries.withColumn("scope_id", F.lit(0).cast("bigint"))
    q_tok = query_tokens(queries)
    post = postings(corpus, q_tok)
    top = bm25_top(q_tok, post, document_frequency(post), corpus_sizes(corpus), reach)
    return P.char_budget(with_snippets(top, queries, chunks), max_chars, k)


def _found(queries: DataFrame, index, k: int, scope=()) -> DataFrame:
    """The k best chunks of each query with heading, title and snippet."""
    from corpusloom.operators.lexical_index import with_docs

    few = is_small(queries, BROADCAST_ROWS // k)
    top = with_docs(ranked(queries, index, k, scope), index, "path", "idx", "heading", "content", "mtime", few=few)
    return _described(top, queries)


def bm25_places(queries: DataFrame, index, k: int, scope=()) -> DataFrame:
    """(query_id, rank, path, idx, score, mtime): the ranking alone, no text is read."""
    from corpusloom.operators.lexical_index import with_docs

    few = is_small(queries, BROADCAST_ROWS // k)
    return with_docs(ranked(queries, index, k, scope), index, "path", "idx", "mtime", few=few).select("query_id", "rank", "path", "idx", "score", "mtime")


def _scope_ids(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Give equal scopes one id; the empty scope is the prefix of every path."""
    prefixes = F.when(F.size("scope") > 0, F.array_sort(F.array_distinct("scope"))).otherwise(F.array(F.lit("")))
    q = queries.withColumn("scope", prefixes).withColumn("scope_id", F.xxhash64("scope"))
    return q, q.select("scope_id", F.explode("scope").alias("prefix")).distinct()


def with_snippets(top: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add heading, title, snippet and mtime to ranked (query, chunk) rows."""
    return _described(top.join(chunks.select("path", "idx", "heading", "content", "mtime"), ["path", "idx"]), queries)


def _described(found: DataFrame, queries: DataFrame) -> DataFrame:
    """Result rows of ranked chunks with their texts."""
    q = queries.select("query_id", X.tokenize(F.col("text")).alias("_tok"))
    return (
        found.join(q, "query_id")
        .withColumn("title", X.title_of(F.col("path"), any_case=True))
        .withColumn("snippet", X.snippet(F.col("content"), F.col("_tok")))
        .select(*RESULT_COLS)
    )


# --- vectors -----------------------------------------------------------------
QUERY_BLOCK, VECTOR_ROWS, BLOCK_RESULTS, PART_ROWS = 1024, 4096, 2_000_000, 65_536


def vector_top(query_vectors: DataFrame, vectors: DataFrame, k: int, query_block: int | None = None) -> DataFrame:
    """(query_id, rank, path, idx, score): exact top-k by dot product.

    Queries and vectors meet as blocks of rows: vectors are dealt over parts of about
    PART_ROWS (at least as many as a shuffle has), queries in blocks small enough that a
    block's results stay below BLOCK_RESULTS for any k, and every pair of blocks is one
    matrix product. A pair keeps its best k per query; the final ranking cuts what the parts
    give. `vector_index` keeps vectors so that most of them need not be read."""
    size = query_block or max(1, min(QUERY_BLOCK, BLOCK_RESULTS // max(1, k)))
    blocks = 1 + (query_vectors.count() - 1) // size
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // PART_ROWS))
    deal = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    q = query_vectors.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))).cast("int").alias("_q"), deal(parts).alias("_v"))
    v = vectors.select(
        "path", F.col("idx").cast("int").alias("idx"), "vec", deal(blocks).alias("_q"), F.pmod(F.xxhash64("path", "idx"), F.lit(parts)).cast("int").alias("_v")
    )

    def best(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(asked):
            return pd.DataFrame({"query_id": asked["query_id"].iloc[:0], "path": mine["path"].iloc[:0], "idx": mine["idx"].iloc[:0], "score": np.zeros(0)})
        matrix = np.stack(asked["vec"].to_list()).astype(np.float64).T
        rows, cols, scores = [], [], []
        for at in range(0, len(mine), VECTOR_ROWS):
            block = np.stack(mine["vec"].iloc[at : at + VECTOR_ROWS].to_list()).astype(np.float64) @ matrix
            # what could be among the best k once scores are rounded as in the final order
            least = np.partition(block, len(block) - k, axis=0)[len(block) - k] - 2e-9 if len(block) > k else -np.inf
            r, c = np.nonzero(block >= least)
            rows, cols, scores = [*rows, r + at], [*cols, c], [*scores, block[r, c]]
        out = pd.DataFrame({"r": np.concatenate(rows), "c": np.concatenate(cols), "score": np.concatenate(scores)})
        if len(rows) > 1:
            cut = out.groupby("c")["score"].nlargest(k).groupby("c").min()
            out = out[out["score"] >= out["c"].map(cut) - 2e-9]
        r, c = out["r"].to_numpy(), out["c"].to_numpy()
        return pd.DataFrame({
            "query_id": asked["query_id"].to_numpy()[c], "path": mine["path"].to_numpy()[r], "idx": mine["idx"].to_numpy()[r], "score": out["score"].to_numpy()
        })

    kind = query_vectors.schema["query_id"].dataType.simpleString()
    partial = v.groupBy("_q", "_v").cogroup(q.groupBy("_q", "_v")).applyInPandas(best, f"query_id {kind}, path string, idx int, score double")
    return top_per_key(partial, ["query_id"], _by_score(), k)


def vector_search(
    query_vectors: DataFrame, vectors, chunks: DataFrame | None = None, k: int = K.DEFAULT_K,
    max_chars: int = K.DEFAULT_MAX_CHARS, scope=(), index=None,
) -> DataFrame:
    """Cosine search on unit vectors, with no positive-score filter. A vector without
    its chunk is dropped after the top-k, as a gap in the ranks. `vectors` is a table or a
    stored `VectorIndex`; with `index`, a stored `LexicalIndex`, texts come from it."""
    from corpusloom.operators import lexical_index as LI, vector_index as VI

    cols = ["heading", "content", "mtime"]
    top = VI.search(query_vectors, vectors, k, scope) if isinstance(vectors, VI.VectorIndex) else vector_top(query_vectors, P.scope_filter(vectors, scope), k)
    if index is not None:
        few = is_small(query_vectors, BROADCAST_ROWS // k)
        placed = index.docs.select("path", "idx", "doc").join(F.broadcast(top) if few else top, ["path", "idx"])
        found = LI.with_docs(placed, index, *cols, few=few)
    else:
        found = top.join(chunks.select("path", "idx", *cols), ["path", "idx"])
    found = (
        found.withColumn("title", X.title_of(F.col("path"), any_case=True))
        .withColumn("snippet", X.cut(F.col("content"), K.VECTOR_SNIPPET))
        .select(*RESULT_COLS)
    )
    again = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return P.char_budget(again, max_chars, k, with_title=False)


# --- fusion ------------------------------------------------------------------
def rrf(list_a: DataFrame, list_b: DataFrame, c: int = K.RRF_C) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (rank from 1). The payload comes from
    list A where present; ties keep the order of A, then of what only B has."""
    payload = [x for x in list_a.columns if x not in ("query_id", "path", "idx", "rank", "score")]

    def tagged(df, src):
        return df.select(
            "query_id", "path", "idx", F.lit(src).alias("src"), "rank", F.struct(*payload).alias("payload")
        )

    both = tagged(list_a, 0).unionByName(tagged(list_b, 1))
    place = F.struct("src", "rank")
    fused = both.groupBy("query_id", "path", "idx").agg(
        F.sum(F.lit(1.0) / (c + F.col("rank"))).alias("score"),
        F.min(place).alias("_place"),
        F.min_by("payload", place).alias("payload"),
    )
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "_place")
    return fused.withColumn("rank", F.row_number().over(w)).select(
        "query_id", "rank", "path", "idx", *[F.col(f"payload.{p}").alias(p) for p in payload], "score"
    )


def hybrid(
    queries: DataFrame, chunks: DataFrame | None, vectors, k: int = K.DEFAULT_K,
    max_chars: int = K.DEFAULT_MAX_CHARS, scope=(), rerank_top: int | None = None, index=None,
) -> DataFrame:
    """BM25 and vector top lists fused. With no vectors the lexical list is fused alone."""
    from corpusloom.operators.embedding import embed_queries
    from corpusloom.operators.rerank import rerank_lexical

    lexical = bm25(queries, chunks, K.FUSE_TOP, max_chars * 2, scope, index)
    if vectors is None:
        near = lexical.limit(0)
    else:
        near = vector_search(embed_queries(queries), vectors, chunks, K.FUSE_TOP, max_chars * 2, scope, index)
    fused = rrf(lexical, near).select(*RESULT_COLS)
    out = P.char_budget(fused, max_chars, k)
    if rerank_top is not None:
        out = P.char_budget(rerank_lexical(queries, out, min(rerank_top, k)), max_chars)
    return out


def search(
    queries: DataFrame, chunks: DataFrame | None = None, vectors=None, mode: str = "hybrid",
    k: int = K.DEFAULT_K, max_chars: int = K.DEFAULT_MAX_CHARS, scope=(), include_local: bool = False,
    legacy_scope: bool = False, rerank_top: int | None = None, index=None,
) -> DataFrame:
    """Search in one of the modes bm25, vector, hybrid.

    Without `include_local`, local books are excluded by path. `legacy_scope` instead
    only drops book prefixes from the scope list, so an empty list still finds books.
    With a stored `index` (and a `VectorIndex` as `vectors`) no chunk is cut, tokenised or
    embedded again; stored indexes hold what a search may see, so local books are left out
    when they are written (`drop_local`)."""
    if not include_local:
        if legacy_scope:
            scope = P.drop_local_scopes(list(scope))
        else:
            chunks = None if chunks is None else P.drop_local(chunks)
            vectors = P.drop_local(vectors) if isinstance(vectors, DataFrame) else vectors
    if mode == "bm25" or (mode == "vector" and vectors is None):
        return bm25(queries, chunks, k, max_chars, scope, index)
    if mode == "vector":
        from corpusloom.operators.embedding import embed_queries

        return vector_search(embed_queries(queries), vectors, chunks, k, max_chars, scope, index)
    if mode != "hybrid":
        raise ValueError(f"unknown search mode: {mode}")
    return hybrid(queries, chunks, vectors, k, max_chars, scope, rerank_top, index)
