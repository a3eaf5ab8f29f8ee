"""Queries over chunking, embedding, search, reranking and contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom import constants as K
from corpusloom.functions.storage import kept, shared_folder, temporary, version
from corpusloom.operators import agent, chunking, context, embedding, lexical_index as LI, rerank as RR, retrieval as R, vector_index as VI
from corpusloom.plans import derive as D, sqltext as Q
from corpusloom.plans.registry import query
from corpusloom.streaming import reindex

C = F.col


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as one chunk each, headed by their source."""
    return D.derived(
        spark, d, "documents", f"{D.path_sql('doc_id')} AS path", "CAST(0 AS INT) AS idx", "source AS heading", "text AS content", "doc_id AS mtime"
    )


def _version(spark: SparkSession, d: str, table: str) -> str:
    return version(spark.read.parquet(f"{d.rstrip('/')}/{table}.parquet"))


def _doc_root(spark: SparkSession, d: str, name: str, chunks, mark: str) -> str:
    return kept(spark, f"docs-{name}-{LI.FORMAT}-{mark}", lambda root: LI.write_docs(chunks(spark, d), root))


def doc_index(spark: SparkSession, d: str, name: str = "documents", chunks=doc_chunks) -> LI.LexicalIndex:
    """The stored index of `chunks(spark, d)`, written when a version of the documents is
    first searched and read by every search after that."""
    mark = _version(spark, d, "documents")
    root = _doc_root(spark, d, name, chunks, mark)
    return LI.open_index(spark, root, kept(spark, f"postings-{name}-{LI.FORMAT}-{mark}", lambda to: LI.write_postings(LI.open_docs(spark, root).docs, to)))


def doc_table(spark: SparkSession, d: str, name: str = "documents", chunks=doc_chunks) -> LI.LexicalIndex:
    """The numbered chunks of that index alone, for searches that read no postings."""
    return LI.open_docs(spark, _doc_root(spark, d, name, chunks, _version(spark, d, "documents")))


def stored_vectors(spark: SparkSession, d: str, table: str, vectors, name: str | None = None) -> VI.VectorIndex:
    """The stored vector index of `vectors(spark, d)`, written once per version of the table."""
    path = f"vectors-{name or table}-{VI.FORMAT}-{_version(spark, d, table)}"
    return VI.open_vectors(spark, kept(spark, path, lambda root: VI.write_vectors(vectors(spark, d), root)))


def bench_queries(spark: SparkSession, d: str) -> DataFrame:
    return D.table(spark, d, "benchmark").selectExpr("item_id AS query_id", "text")


# --- the same in SQL -----------------------------------------------------------
_CHUNKS = f"chunks AS (SELECT {D.path_sql('doc_id')} AS path, 0 AS idx, source AS heading, text AS content, doc_id AS mtime FROM documents)"
_BM25 = (
    _CHUNKS + f", qt AS (SELECT item_id AS query_id, {Q.tokens('text')} AS toks FROM benchmark), "
    f"ct AS (SELECT path, idx, {Q.tokens('content')} AS toks FROM chunks), "
    "q AS (SELECT query_id, token, count(*) AS m FROM (SELECT query_id, unnest(toks) AS token FROM qt) GROUP BY ALL), "
    "tf AS (SELECT path, idx, dl, token, count(*) AS tf FROM (SELECT path, idx, length(toks) AS dl, unnest(toks) AS token FROM ct) "
    "WHERE token IN (SELECT token FROM q) GROUP BY ALL), "
    "df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), "
    "sc AS (SELECT query_id, path, idx, sum(m * ln(1 + ((SELECT count(*) FROM chunks) - df + 0.5) / (df + 0.5)) * tf * 2.5 "
    "/ (tf + 1.5 * (0.25 + 0.75 * dl / 300))) AS score FROM q JOIN df USING (token) JOIN tf USING (token) GROUP BY ALL), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, idx) AS rank FROM sc WHERE score > 0)"
)


def _budget_sql(src: str, max_chars: int, k: int, title: bool = True) -> str:
    cost = "length(snippet) + length(path) + length(heading) + 50" + (" + length(title)" if title else "")
    return (
        f"SELECT * FROM (SELECT *, sum({cost}) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM {src}) "
        f"WHERE rank <= {k} AND (rank = 1 OR spent <= {max_chars})"
    )


_RESULT = (
    f"res AS (SELECT rk.query_id, rk.rank, c.path, c.idx, c.heading, {Q.title_ci('c.path')} AS title, {Q.snippet('content', 'toks')} AS snippet, "
    "rk.score, c.mtime FROM rk JOIN chunks c USING (path, idx) JOIN qt USING (query_id))"
)
_OUT = "query_id, rank, path, CAST(idx AS BIGINT) AS idx, heading, title, snippet, round(score, 6) AS score, mtime"


def result_out(df: DataFrame) -> DataFrame:
    return df.select(
        "query_id", C("rank").cast("bigint").alias("rank"), "path", C("idx").cast("bigint").alias("idx"), "heading",
        "title", "snippet", F.round("score", 6).alias("score"), "mtime",
    )


@query("bm25_top10", "OP-041 OP-019 OP-012", f"WITH {_BM25}, {_RESULT} SELECT {_OUT} FROM ({_budget_sql('res', 30000, 10)})")
def bm25_top10(spark, d):
    """Flagship: the ten best documents of every benchmark text."""
    return result_out(R.bm25(bench_queries(spark, d), index=doc_index(spark, d), k=10))


@query("bm25_budget", "OP-041 OP-012", f"WITH {_BM25}, {_RESULT} SELECT {_OUT} FROM ({_budget_sql('res', 2000, 9999)})")
def _(spark, d):
    return result_out(R.bm25(bench_queries(spark, d), index=doc_index(spark, d), max_chars=2000))


_SCOPED = (
    f"WITH {_CHUNKS}, qs AS (SELECT item_id AS query_id, text, CASE item_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['inbox'] ELSE ['area1', 'area2/笔记'] END AS scope FROM benchmark), "
    "mem AS (SELECT query_id, path, idx, content FROM qs, chunks WHERE length(scope) = 0 OR list_bool_or(list_transform(scope, lambda s: path = s OR starts_with(path, s || '/')))), "
    f"tf AS (SELECT query_id, path, idx, dl, token, count(*) AS tf FROM (SELECT query_id, path, idx, length(toks) AS dl, unnest(toks) AS token FROM (SELECT *, {Q.tokens('content')} AS toks FROM mem)) GROUP BY ALL), "
    f"q AS (SELECT query_id, token, count(*) AS m FROM (SELECT query_id, unnest({Q.tokens('text')}) AS token FROM qs) GROUP BY ALL), "
    "df AS (SELECT query_id, token, count(*) AS df FROM tf GROUP BY ALL), nn AS (SELECT query_id, count(*) AS n FROM mem GROUP BY ALL), "
    "sc AS (SELECT query_id, path, idx, sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 300))) AS score "
    "FROM q JOIN tf USING (query_id, token) JOIN df USING (query_id, token) JOIN nn USING (query_id) GROUP BY ALL) "
    "SELECT query_id, rank, path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, idx) AS rank FROM sc WHERE score > 0) WHERE rank <= 5"
)


@query("bm25_scoped", "OP-041 OP-013", _SCOPED)
def _(spark, d):
    q = bench_queries(spark, d).withColumn(
        "scope", F.expr("CASE query_id % 3 WHEN 0 THEN CAST(array() AS array<string>) WHEN 1 THEN array('inbox') ELSE array('area1', 'area2/笔记') END")
    )
    top = R.bm25_places(q, doc_index(spark, d), 5)
    return top.select("query_id", C("rank").cast("bigint").alias("rank"), "path", F.round("score", 6).alias("score"))


# --- chunking ------------------------------------------------------------------
_WS = "e' \\t\\r\\n'"
_SECTIONS = (
    "ln AS (SELECT path, content, line, i, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY i) - length(line) - 1 AS off FROM "
    "(SELECT path, content, unnest(string_split(content, chr(10))) AS line, unnest(range(1, length(string_split(content, chr(10))) + 1)) AS i FROM notes)), "
    "hd AS (SELECT path, content, i, substr(line, 4) AS h, off, off + length(line) + 1 AS lo, lead(off) OVER (PARTITION BY path ORDER BY i) AS hi FROM ln WHERE line LIKE '## %'), "
    f"sec AS (SELECT path, i, trim(h, {_WS}) AS heading, trim(substr(content, CAST(lo AS BIGINT) + 1, CAST(coalesce(hi, length(content)) - lo AS BIGINT)), {_WS}) AS body FROM hd "
    f"UNION ALL SELECT path, 0, '', trim(content, {_WS}) FROM notes WHERE path NOT IN (SELECT path FROM hd))"
)


def _last(mark: str, width: int) -> str:
    s = f"substr(body, 1, pos + 800 + {width})"
    r = f"position({mark} in reverse({s}))"
    return f"CASE WHEN {r} = 0 THEN -1 ELSE length({s}) - {r} + 1 - {width} END"


_STEP = (
    "CASE WHEN pos + 800 >= length(body) THEN length(body) "
    f"WHEN {_last('chr(10) || chr(10)', 2)} > pos + 100 THEN {_last('chr(10) || chr(10)', 2)} "
    f"WHEN {_last('chr(10)', 1)} > pos + 100 THEN {_last('chr(10)', 1)} ELSE pos + 800 END"
)
_HEADING_SQL = (
    D.with_tables("notes").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + _SECTIONS
    + f", cut AS (SELECT path, i, heading, body, CAST(0 AS BIGINT) AS pos, CAST({_STEP} AS BIGINT) AS stop FROM (SELECT *, CAST(0 AS BIGINT) AS pos FROM sec) "
    f"UNION ALL SELECT path, i, heading, body, pos, CAST({_STEP} AS BIGINT) FROM (SELECT path, i, heading, body, greatest(stop - 100, pos + 1) AS pos FROM cut WHERE stop < length(body))), "
    f"pc AS (SELECT path, i, pos, CASE WHEN heading = '' THEN {Q.title('path')} ELSE heading END AS heading, trim(substr(body, pos + 1, stop - pos), {_WS}) AS content, length(body) AS n FROM cut) "
    "SELECT path, row_number() OVER (PARTITION BY path ORDER BY i, pos) - 1 AS idx, heading, content FROM pc WHERE content <> '' OR n <= 800"
)


@query("chunk_by_heading", "OP-035", _HEADING_SQL)
def _(spark, d):
    return chunking.chunk_by_heading(D.notes(spark, d)).select("path", C("idx").cast("bigint").alias("idx"), "heading", "content")


_AFTER = "CASE WHEN doc_id % 3 = 0 THEN content || chr(10) || '## Added' || chr(10) || 'more' ELSE content END"


_STREAMED = _HEADING_SQL.replace("notes AS (", "first AS (", 1).replace(
    ", ln AS (", f", notes AS (SELECT path, doc_id, mtime, {_AFTER} AS content FROM first WHERE doc_id % 11 <> 5), ln AS (", 1
)


def note_versions(spark, d):
    """Three batches of note versions: all notes, then a third with another section, then
    deletions and late copies of the first versions."""
    n = D.notes(spark, d).select("doc_id", "path", "content", "mtime", "hash")
    first = n.select("path", "content", "mtime", "hash")
    second = n.where("doc_id % 3 = 0").select("path", F.expr(_AFTER).alias("content"), (C("mtime") + 5).alias("mtime"), F.lit("second").alias("hash"))
    third = n.where("doc_id % 11 = 5").select("path", F.lit(None).cast("string").alias("content"), (C("mtime") + 9).alias("mtime"), F.lit("gone").alias("hash"))
    late = n.where("doc_id % 33 = 0").select("path", F.expr(_AFTER).alias("content"), "mtime", F.lit("second").alias("hash"))
    return first, second, third.unionByName(late)


@query("stream_steps", "OP-105", _STREAMED)
def _(spark, d):
    """One step of the tables per batch of versions."""
    first, second, third = note_versions(spark, d)
    none = chunking.chunk_by_heading(first.limit(0))
    tables = reindex.step(first, first.limit(0), none, embedding.embed_chunks(none))
    for batch in (second, third):
        tables = reindex.step(batch, *tables)
    return tables[1].select("path", C("idx").cast("bigint").alias("idx"), "heading", "content")


@query("stream_reindex", "OP-105", _STREAMED)
def _(spark, d):
    """The job itself: batches of versions arrive as files, each is taken in by a run of the
    streaming query from its checkpoint, and the last is processed a second time, as after
    a restart."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    batches = note_versions(spark, d)
    for batch in batches:
        batch.write.mode("append").parquet(f"{root}/versions")
        drops = spark.readStream.schema(reindex.NOTE_SCHEMA).parquet(f"{root}/versions")
        reindex.stream_reindex(drops, f"{root}/index", f"{root}/checkpoint").awaitTermination()
    reindex.process(batches[-1], len(batches) - 1, f"{root}/index")
    return reindex.current(spark, f"{root}/index", "chunks").select("path", C("idx").cast("bigint").alias("idx"), "heading", "content")


def _paragraph_sql(size: int) -> str:
    step = size - 100
    pieces = (
        f"list_transform(range(0, 1 + CAST(ceil((length(txt) - {size}) / {step}.0) AS BIGINT)), lambda j: substr(txt, j * {step} + 1, {size}))"
    )
    held_out = f"CASE WHEN trim(held, {_WS}) <> '' THEN [trim(held, {_WS})] ELSE [] END"
    joined = "CASE WHEN held = '' THEN txt ELSE held || chr(10) || chr(10) || txt END"
    long = f"length(txt) > {int(size * 1.5)}"
    return (
        D.with_tables("notes").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
        + f", raw AS (SELECT path, list_filter(list_transform(regexp_split_to_array(content, '\\n\\s*\\n'), lambda x: trim(x, {_WS})), lambda x: x <> '') AS ps FROM notes), "
        "para AS (SELECT path, unnest(ps) AS txt, unnest(range(1, length(ps) + 1)) AS i FROM raw UNION ALL SELECT path, NULL, length(ps) + 1 FROM raw), "
        "st AS (SELECT path, CAST(0 AS BIGINT) AS i, '' AS held, CAST([] AS VARCHAR[]) AS emit FROM raw UNION ALL "
        "SELECT s.path, p.i, "
        f"CASE WHEN txt IS NULL OR {long} THEN '' WHEN length({joined}) >= {size} THEN right({joined}, 100) ELSE {joined} END, "
        f"CASE WHEN txt IS NULL THEN {held_out} WHEN {long} THEN list_concat({held_out}, {pieces}) WHEN length({joined}) >= {size} THEN [trim({joined}, {_WS})] ELSE [] END "
        "FROM st s JOIN para p ON p.path = s.path AND p.i = s.i + 1), "
        "fl AS (SELECT path, i, unnest(emit) AS content, unnest(range(1, length(emit) + 1)) AS j FROM st) "
        f"SELECT path, row_number() OVER (PARTITION BY path ORDER BY i, j) - 1 AS idx, {Q.title('path')} || ' #' || CAST(row_number() OVER (PARTITION BY path ORDER BY i, j) AS STRING) AS heading, content FROM fl"
    )


@query("chunk_by_paragraph", "OP-036", _paragraph_sql(400))
def _(spark, d):
    return chunking.chunk_by_paragraph(D.notes(spark, d)).select("path", C("idx").cast("bigint").alias("idx"), "heading", "content")


_B36 = "".join(
    f"{' || ' if p < 6 else ''}substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // {36 ** p}) % 36 AS BIGINT) + 1, 1)" for p in range(6, -1, -1)
)


@query(
    "text_hash", "OP-024",
    "WITH b AS (SELECT conv_id, turn, CAST(hex(encode(text)) AS STRING) AS x FROM conversations), "
    "v AS (SELECT conv_id, turn, list_reduce(list_concat([CAST(5381 AS BIGINT)], list_transform(range(0, length(x) // 2), "
    "lambda i: CAST((position(substr(x, 2 * i + 1, 1) in '0123456789ABCDEF') - 1) * 16 + position(substr(x, 2 * i + 2, 1) in '0123456789ABCDEF') - 1 AS BIGINT))), "
    "lambda a, c: (a * 33 + c) % 4294967296) AS h FROM b) "
    f"SELECT conv_id, turn, CASE WHEN h = 0 THEN '0' ELSE ltrim({_B36}, '0') END AS hash FROM v",
)
def _(spark, d):
    from corpusloom.functions.hashing import text_hash

    return D.table(spark, d, "conversations").select("conv_id", "turn", text_hash("text").alias("hash"))


_EDITED = (
    f"WITH RECURSIVE notes0 AS ({D.NOTES_SQL}), notes AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN content || chr(10) || '## Added' || chr(10) || 'new text' ELSE content END AS content FROM notes0), "
)
_REINDEX_SQL = _EDITED + _HEADING_SQL[_HEADING_SQL.index("ln AS (") :]


@query("reindex", "OP-037", _REINDEX_SQL)
def _(spark, d):
    """Every seventh note has a new text; its chunks are replaced, the others stay."""
    n = D.notes(spark, d)
    old = chunking.chunk_by_heading(n)
    edited = n.where("doc_id % 7 = 0").withColumn("content", F.concat("content", F.lit("\n## Added\nnew text"))).withColumn("mtime", C("mtime") + 1)
    return chunking.reindex(edited, old).select("path", C("idx").cast("bigint").alias("idx"), "heading", "content")


# --- embedding -------------------------------------------------------------------
def _embed_sql(src: str, key: str, out: str) -> str:
    """CTEs giving (key, bucket, value) of unit vectors for a table with (key, text)."""
    grams = " UNION ALL ".join(
        f"SELECT {key}, CASE WHEN h % 4294967296 >= 2147483648 THEN h % 4294967296 - 4294967296 ELSE h % 4294967296 END AS h FROM (SELECT {key}, unnest(list_transform(range(1, length(c) - {n - 2}), "
        f"lambda i: CAST({5381 * 33 ** n} AS BIGINT) + " + " + ".join(f"c[i + {j}] * {33 ** (n - 1 - j)}" for j in range(n)) + f")) AS h FROM {out}_c)"
        for n in (2, 3, 4)
    )
    return (
        f"{out}_c AS (SELECT {key}, list_transform(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ''), lambda ch: CAST(unicode(ch) AS BIGINT)) AS c FROM {src}), "
        f"{out}_b AS (SELECT {key}, abs(h % 256) AS bucket, count(*) AS n FROM ({grams}) GROUP BY ALL), "
        f"{out} AS (SELECT {key}, bucket, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS FLOAT) AS v FROM {out}_b)"
    )


@query(
    "embed_documents", "OP-038",
    "WITH " + _embed_sql("documents", "doc_id", "dv") + " SELECT doc_id, bucket, round(CAST(v AS DOUBLE), 6) AS value FROM dv",
)
def _(spark, d):
    e = embedding.embed_chunks(doc_chunks(spark, d).withColumn("hash", F.md5("content")))
    ids = e.select(C("mtime").alias("doc_id"), F.posexplode_outer("vec").alias("bucket", "v")).where("v <> 0")
    return ids.select("doc_id", C("bucket").cast("bigint").alias("bucket"), F.round(C("v").cast("double"), 6).alias("value"))


def given_vectors(spark, d):
    return D.table(spark, d, "embeddings").selectExpr("'v/' || CAST(vec_id % 10 AS STRING) AS path", "CAST(vec_id AS INT) AS idx", "embedding AS vec", "label")


@query(
    "vector_top", "OP-042",
    "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
    "sc AS (SELECT q.vec_id AS query_id, 'v/' || CAST(e.vec_id % 10 AS STRING) AS path, e.vec_id AS idx, list_dot_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id % 20 = 0) "
    "SELECT CAST(query_id AS BIGINT) AS query_id, rank, path, CAST(idx AS BIGINT) AS idx, round(score, 6) AS score FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, idx) AS rank FROM sc) WHERE rank <= 25",
)
def _(spark, d):
    """All vectors whose id is divisible by 20 against all vectors."""
    asked = D.table(spark, d, "embeddings").where("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "embedding AS vec")
    t = VI.search(asked, stored_vectors(spark, d, "embeddings", given_vectors), 25)
    return t.select(C("query_id").cast("bigint").alias("query_id"), C("rank").cast("bigint").alias("rank"), "path", C("idx").cast("bigint").alias("idx"), F.round("score", 6).alias("score"))


_VEC_SQL = (
    _embed_sql("(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "qv") + ", " + _embed_sql("documents", "doc_id", "dv")
    + f", vs AS (SELECT query_id, {D.path_sql('doc_id')} AS path, 0 AS idx, sum(CAST(q.v AS DOUBLE) * CAST(d.v AS DOUBLE)) AS score FROM qv q JOIN dv d USING (bucket) GROUP BY ALL), "
    "vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, idx) AS rank FROM vs)"
)
_VRES = (
    f"vres AS (SELECT query_id, rank, c.path, c.idx, c.heading, {Q.title_ci('c.path')} AS title, {Q.cut('content', 300)} AS snippet, vr.score, c.mtime FROM vr JOIN chunks c USING (path, idx))"
)


def document_vectors(spark, d):
    return embedding.embed_chunks(doc_chunks(spark, d).withColumn("hash", F.md5("content"))).select("path", "idx", "vec")


@query("vector_search", "OP-042 OP-038 OP-012", f"WITH {_CHUNKS}, {_VEC_SQL}, {_VRES} SELECT {_OUT} FROM ({_budget_sql('vres', 3000, 12, False)})")
def _(spark, d):
    return result_out(R.search(
        bench_queries(spark, d), vectors=stored_vectors(spark, d, "documents", document_vectors), mode="vector", k=12, max_chars=3000, index=doc_table(spark, d)
    ))


_FUSED = (
    f"la AS ({_budget_sql('res', 60000, 50)}), lb AS ({_budget_sql('vres', 60000, 50, False)}), "
    "un AS (SELECT query_id, path, idx, 0 AS src, rank, heading, title, snippet, mtime FROM la UNION ALL SELECT query_id, path, idx, 1, rank, heading, title, snippet, mtime FROM lb), "
    "fu AS (SELECT query_id, path, idx, sum(1.0 / (60 + rank)) AS score, min(src * 1000 + rank) AS place, arg_min(heading, src) AS heading, arg_min(title, src) AS title, arg_min(snippet, src) AS snippet, arg_min(mtime, src) AS mtime FROM un GROUP BY ALL), "
    "fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, place) AS rank FROM fu)"
)
_HYBRID = f"WITH {_BM25}, {_RESULT}, {_VEC_SQL}, {_VRES}, {_FUSED}"


@query("hybrid_top10", "OP-044 OP-043 OP-045", f"{_HYBRID} SELECT {_OUT} FROM ({_budget_sql('fr', 30000, 10)})")
def _(spark, d):
    return result_out(R.search(
        bench_queries(spark, d), vectors=stored_vectors(spark, d, "documents", document_vectors), mode="hybrid", k=10, index=doc_index(spark, d)
    ))


def _rerank_score_sql(src: str) -> str:
    per = (
        "CASE WHEN contains(lower(title), t) THEN 3.0 ELSE 0 END + CASE WHEN contains(lower(heading), t) THEN 2.0 ELSE 0 END + "
        "CASE WHEN contains(lower(snippet), t) THEN tf * 2.5 / (tf + 1.5) ELSE 0 END"
    )
    return (
        f"qr AS (SELECT item_id AS query_id, {Q.rerank_tokens('text')} AS rt FROM benchmark), "
        "ex AS (SELECT r.query_id, r.path, r.idx, t, length(string_split(lower(snippet), t)) - 1 AS tf, title, heading, snippet "
        f"FROM (SELECT *, unnest(rt) AS t FROM {src} JOIN qr USING (query_id)) r), "
        f"su AS (SELECT query_id, path, idx, sum({per}) AS s FROM ex GROUP BY ALL), "
        "rs AS (SELECT x.query_id, x.path, x.idx, x.heading, x.title, x.snippet, x.mtime, x.rank AS old, "
        "(s + CASE WHEN length(array_to_string(rt, '')) >= 4 AND contains(lower(snippet), array_to_string(rt, '')) THEN 1.5 ELSE 0 END) "
        f"* CASE WHEN length(snippet) < 50 THEN 0.8 ELSE 1 END AS score FROM {src} x JOIN su USING (query_id, path, idx) JOIN qr USING (query_id))"
    )


@query(
    "rerank_lexical", "OP-046",
    f"WITH {_BM25}, {_RESULT}, top AS ({_budget_sql('res', 30000, 20)}), {_rerank_score_sql('top')} SELECT {_OUT} FROM "
    "(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, old) AS rank FROM rs) WHERE rank <= 8",
)
def _(spark, d):
    q = bench_queries(spark, d)
    return result_out(RR.rerank_lexical(q, R.bm25(q, index=doc_index(spark, d), k=20), 8))


@query(
    "rerank_scored", "OP-047",
    f"WITH {_BM25}, {_RESULT}, top AS ({_budget_sql('res', 30000, 20)}), "
    "sc2 AS (SELECT top.*, CAST(quality * 14 + toxic * 2 + mtime % 10 AS DOUBLE) AS rel FROM top JOIN labels ON doc_id = mtime), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS r2 FROM sc2), c AS (SELECT * FROM o WHERE r2 <= 5) "
    "SELECT query_id, r2 AS rank, path, round(rel / greatest(max(rel) OVER (PARTITION BY query_id), 0.0001), 6) AS score FROM c",
)
def _(spark, d):
    res = R.bm25(bench_queries(spark, d), index=doc_index(spark, d), k=20)
    lab = D.table(spark, d, "labels").selectExpr("doc_id AS mtime", "CAST(quality * 14 + toxic * 2 + doc_id % 10 AS DOUBLE) AS relevance")
    scores = res.join(lab, "mtime").select("query_id", "path", "idx", "relevance")
    return RR.rerank_scored(res, scores, 5).select("query_id", C("rank").cast("bigint").alias("rank"), "path", F.round("score", 6).alias("score"))


_WEB_SQL = (
    "web AS (SELECT page_id % 50 AS query_id, row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) AS rank, "
    "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url, regexp_replace(html, '<[^>]*>', ' ', 'g') AS content FROM pages)"
)


def web_rows(spark, d):
    from pyspark.sql import Window

    p = D.table(spark, d, "pages").selectExpr(
        "page_id % 50 AS query_id", "page_id", "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title", "url", "regexp_replace(html, '<[^>]*>', ' ') AS content"
    )
    return p.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("page_id"))).drop("page_id")


def _blocks(kind: str) -> str:
    if kind == "kb":
        return f"'[KB#' || CAST(rank AS STRING) || '] 笔记: ' || title || chr(10) || '路径: ' || path || chr(10) || '小节: ' || heading || chr(10) || '内容: ' || {Q.cut('snippet', 600)}"
    return f"'[Web#' || CAST(rank AS STRING) || '] 标题: ' || title || chr(10) || 'URL: ' || url || chr(10) || '摘要: ' || {Q.cut('content', 600)}"


_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(
    "rag_context", "OP-048",
    f"WITH {_BM25}, {_RESULT}, kb AS (SELECT * FROM ({_budget_sql('res', 30000, 5)}) WHERE query_id % 4 <> 3), {_WEB_SQL}, "
    f"k AS (SELECT query_id, count(*) AS n_kb, string_agg({_blocks('kb').replace(' ||', ' ||')}, {_SEP} ORDER BY rank) AS kt FROM kb GROUP BY ALL), "
    f"w AS (SELECT query_id, count(*) AS n_web, string_agg({_blocks('web')}, {_SEP} ORDER BY rank) AS wt FROM web WHERE query_id % 5 <> 3 GROUP BY ALL) "
    "SELECT item_id AS query_id, coalesce(n_kb, 0) AS n_kb, coalesce(n_web, 0) AS n_web, CASE WHEN kt IS NULL AND wt IS NULL THEN '(无 — 知识库内未找到相关内容)' ELSE "
    f"concat_ws(chr(10) || chr(10), '{K.KB_SECTION}' || chr(10) || chr(10) || kt, '{K.WEB_SECTION}' || chr(10) || chr(10) || wt) END AS context "
    "FROM benchmark LEFT JOIN k ON k.query_id = item_id LEFT JOIN w ON w.query_id = item_id",
)
def _(spark, d):
    q = bench_queries(spark, d)
    kb = R.bm25(q, index=doc_index(spark, d), k=5).where("query_id % 4 <> 3")
    return context.rag_context(q, kb, web_rows(spark, d).where("query_id % 5 <> 3"))


@query(
    "pin_current", "OP-049",
    f"WITH {_BM25}, lc AS (SELECT {D.path_sql('doc_id')} AS path, unnest(range(0, length(string_split(text, chr(10))))) AS idx, source AS heading, unnest(string_split(text, chr(10))) AS line, doc_id FROM documents), "
    f"pin AS (SELECT item_id AS query_id, 0 AS src, idx + 1 AS rank, lc.path, idx, {Q.title('lc.path')} AS title, line AS snippet, 1.0 AS score FROM benchmark JOIN lc ON doc_id = item_id WHERE idx < 5), "
    "al AS (SELECT query_id, src, rank, path, idx, score FROM pin UNION ALL SELECT query_id, 1, rank, path, idx, score FROM rk WHERE rank <= 40) "
    "SELECT query_id, r AS rank, path, CAST(idx AS BIGINT) AS idx, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, rank) AS r FROM al) WHERE r <= 30",
)
def _(spark, d):
    q, ch = bench_queries(spark, d), doc_chunks(spark, d)
    lines = ch.select("path", "heading", "mtime", F.posexplode(F.split("content", "\n")).alias("idx", "content"))
    current = D.table(spark, d, "benchmark").selectExpr("item_id AS query_id", f"{D.path_sql('item_id')} AS path")
    res = R.bm25(q, index=doc_index(spark, d), k=40, max_chars=1_000_000)
    return context.pin_current(res, lines, current).select(
        "query_id", C("rank").cast("bigint").alias("rank"), "path", C("idx").cast("bigint").alias("idx"), F.round("score", 6).alias("score")
    )


_ANSWERS = "item_id || ' see [KB#' || CAST(item_id % 4 + 1 AS STRING) || '] and [KB#2], again [KB#' || CAST(item_id % 4 + 1 AS STRING) || '] or [KB#99]'"


@query(
    "citations_used", "OP-050",
    f"WITH {_BM25}, a AS (SELECT item_id AS query_id, regexp_extract_all({_ANSWERS.replace('item_id ||', 'CAST(item_id AS STRING) ||', 1)}, '\\[KB#(\\d+)\\]', 1) AS r FROM benchmark), "
    "b AS (SELECT query_id, list_filter(r, lambda x, i: list_position(r, x) = i) AS r FROM a), "
    "c AS (SELECT query_id, unnest(range(0, length(r))) AS pos, CAST(unnest(r) AS BIGINT) AS rank FROM b) "
    "SELECT query_id, CAST(pos AS BIGINT) AS pos, rank, path, CAST(idx AS BIGINT) AS idx FROM c JOIN rk USING (query_id, rank) WHERE rank <= 10",
)
def _(spark, d):
    a = D.table(spark, d, "benchmark").selectExpr("item_id AS query_id", f"{_ANSWERS} AS text")
    kb = R.bm25_places(bench_queries(spark, d), doc_index(spark, d), 10)
    return context.citations_used(a, kb).select(
        "query_id", C("pos").cast("bigint").alias("pos"), C("rank").cast("bigint").alias("rank"), "path", C("idx").cast("bigint").alias("idx")
    )


_HEAD_CTES, _HEAD_ROWS = _HEADING_SQL.rsplit("SELECT path, row_number()", 1)
_CHUNK_KEY = "path || '#' || CAST(idx AS STRING)"
_SECTIONS_SQL = (
    f"{_HEAD_CTES.rstrip()}, hc AS (SELECT path, row_number(){_HEAD_ROWS}), chunks AS (SELECT path, idx, heading, hc.content, mtime FROM hc JOIN notes USING (path)), "
    + _BM25.replace(_CHUNKS + ", ", "") + f", {_RESULT}, " + _embed_sql("(SELECT item_id AS query_id, text FROM benchmark)", "query_id", "qv") + ", "
    + _embed_sql(f"(SELECT {_CHUNK_KEY} AS ck, content AS text FROM chunks)", "ck", "dv")
    + f", vs AS (SELECT query_id, path, idx, sum(CAST(q.v AS DOUBLE) * CAST(d.v AS DOUBLE)) AS score FROM qv q JOIN dv d USING (bucket) JOIN (SELECT path, idx, {_CHUNK_KEY} AS ck FROM chunks) USING (ck) GROUP BY ALL), "
    f"vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path, idx) AS rank FROM vs), {_VRES}, {_FUSED}, "
    f"fo AS ({_budget_sql('fr', 30000, 9999)}), {_rerank_score_sql('fo')}, "
    "rr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, old) AS rank FROM rs) WHERE rank <= 10) "
    f"SELECT query_id, rank, path, CAST(idx AS BIGINT) AS idx, heading, title, round(score, 6) AS score, substr(snippet, 1, 300) AS snippet FROM ({_budget_sql('rr', 30000, 9999)}) WHERE rank <= 5"
)


@query("search_sections", "OP-045 OP-092 OP-035 OP-039", _SECTIONS_SQL)
def _(spark, d):
    """The whole read path on real chunks: notes are cut, their chunks indexed and embedded
    once; searches both ways, reranks, and keeps five short snippets per query."""
    index = doc_index(spark, d, "sections", lambda spark, d: temporary(chunking.chunk_by_heading(D.notes(spark, d))))
    embedded = lambda *_: embedding.build_vectors(index.docs.withColumn("hash", F.md5("content"))).select("path", "idx", "vec")
    vectors = stored_vectors(spark, d, "documents", embedded, "sections")
    res = R.search(bench_queries(spark, d), vectors=vectors, mode="hybrid", rerank_top=10, index=index)
    return agent.kb_lookup(res).select(
        "query_id", C("rank").cast("bigint").alias("rank"), "path", C("idx").cast("bigint").alias("idx"), "heading", "title", F.round("score", 6).alias("score"), "snippet"
    )




@query(
    "index_status", "OP-040 OP-039",
    D.with_tables("notes") + "SELECT count(*) AS chunks, count(*) - count_if(doc_id % 8 = 0) AS vectors, count_if(doc_id % 8 <> 0 AND doc_id % 5 <> 0) AS indexed FROM notes",
)
def _(spark, d):
    n = D.notes(spark, d).select("doc_id", "path", F.lit(0).alias("idx"), "hash")
    have = n.where("doc_id % 8 <> 0").withColumn("hash", F.expr("CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE hash END"))
    return embedding.index_status(n, have)


@query(
    "refresh_vectors", "OP-039",
    D.with_tables("notes").rstrip() + ", todo AS (SELECT path AS ck, content AS text FROM notes WHERE doc_id % 8 = 0 OR doc_id % 5 = 0), " + _embed_sql("todo", "ck", "nv")
    + " SELECT ck AS path, CAST(bucket AS BIGINT) AS bucket, round(CAST(v AS DOUBLE), 6) AS value FROM nv"
    " UNION ALL SELECT path, 0, 9.0 FROM notes WHERE doc_id % 8 <> 0 AND doc_id % 5 <> 0",
)
def _(spark, d):
    """Vectors brought up to date: those of unchanged texts are taken over as they are (they
    are marked, so that embedding again would show), missing and outdated ones are embedded,
    those of notes that are gone are dropped."""
    n = D.notes(spark, d).select("doc_id", "path", F.lit(0).alias("idx"), "content", "hash", "mtime")
    mark = F.array(F.lit(9.0).cast("float")).alias("vec")
    have = n.where("doc_id % 8 <> 0").select("path", "idx", mark, F.lit(K.VEC_DIM).alias("dim"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE hash END AS hash"), "mtime")
    gone = n.where("doc_id % 7 = 0").select(F.concat(F.lit("gone/"), "path").alias("path"), "idx", mark, F.lit(K.VEC_DIM).alias("dim"), "hash", "mtime")
    out = embedding.build_vectors(n.drop("doc_id"), have.unionByName(gone)).select("path", F.posexplode("vec").alias("bucket", "v")).where("v <> 0")
    return out.select("path", C("bucket").cast("bigint").alias("bucket"), F.round(C("v").cast("double"), 6).alias("value"))
