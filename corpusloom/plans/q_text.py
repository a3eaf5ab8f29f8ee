"""Queries over text functions and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.operators import paths as P
from corpusloom.plans import derive as D, sqltext as Q
from corpusloom.plans.registry import query

C = F.col
_N = D.with_tables("notes")


def joined(c):
    return F.array_join(c, "|")


@query("tokenize", "OP-021", _N + f"SELECT path, array_to_string(t, '|') AS tokens, length(t) AS n_tokens FROM (SELECT path, {Q.tokens('content')} AS t FROM notes)")
def _(spark, d):
    t = D.notes(spark, d).select("path", X.tokenize(C("content")).alias("t"))
    return t.select("path", joined("t").alias("tokens"), F.size("t").cast("bigint").alias("n_tokens"))


@query("tokenize_rerank", "OP-022", _N + f"SELECT path, array_to_string({Q.rerank_tokens('content')}, '|') AS tokens FROM notes")
def _(spark, d):
    return D.notes(spark, d).select("path", joined(X.tokenize_rerank(C("content"))).alias("tokens"))


_T1 = Q.title("path")
_T2 = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t1, '(?i)\\.md$', ''), '^\\d{4}[-_]\\d{1,2}[-_]\\d{1,2}[-_ ]?', ''),"
    " '^\\d+[.\\-_\\s]+', ''), '^(公众号|读书|笔记|草稿|模板|归档)', '')"
)
_KW_CTE = (
    f"k1 AS (SELECT doc_id, path, {_T1} AS t1 FROM notes), k2 AS (SELECT doc_id, path, {_T2} AS t FROM k1), "
    "k3 AS (SELECT doc_id, path, list_concat(list_concat(list_filter(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda w: length(w) >= 3), "
    "flatten(list_transform(regexp_extract_all(t, '[一-鿿]+'), lambda r: list_concat(list_filter(list_transform(range(1, length(r)), "
    f"lambda i: substr(r, i, 2)), lambda p: p NOT IN {Q.quoted(K.TITLE_STOP_BIGRAMS)}), CASE WHEN length(r) BETWEEN 2 AND 6 THEN [r] ELSE [] END)))), "
    "list_filter(regexp_extract_all(t, '\\d+'), lambda w: length(w) >= 2)) AS raw FROM k2), "
    # distinct in order of first appearance
    "k4 AS (SELECT doc_id, path, list_filter(raw, lambda w, i: list_position(raw, w) = i) AS kws FROM k3)"
)
KEYWORDS_SQL = D.with_tables("notes").rstrip() + ", " + _KW_CTE


@query("title_keywords", "OP-023 OP-016", KEYWORDS_SQL + f" SELECT path, {Q.title_ci('path')} AS title, array_to_string(kws, '|') AS keywords FROM k4")
def _(spark, d):
    n = D.notes(spark, d)
    return n.select(
        "path", X.title_of(C("path"), any_case=True).alias("title"),
        joined(X.title_keywords(X.title_of(C("path")))).alias("keywords"),
    )


@query(
    "quick_tags", "OP-026",
    _N + f"SELECT path, array_to_string({Q.QUICK_TAGS}, '|') AS tags FROM notes",
)
def _(spark, d):
    return D.notes(spark, d).select("path", joined(X.quick_tags(C("content"))).alias("tags"))


@query(
    "wikilinks", "OP-030",
    _N + f"SELECT path, array_to_string(list_sort({Q.LINKS_RENDER}), '|') AS render, array_to_string(list_sort({Q.LINKS_WIKI}), '|') AS wiki,"
    f" array_to_string({Q.LINKS_GRAPH}, '|') AS graph FROM notes",
)
def _(spark, d):
    c = C("content")
    return D.notes(spark, d).select(
        "path", joined(F.array_sort(X.links_render(c))).alias("render"),
        joined(F.array_sort(X.links_wiki(c))).alias("wiki"), joined(X.links_graph(c)).alias("graph"),
    )


@query(
    "encode_path", "OP-032 OP-033",
    _N + "SELECT path, array_to_string(list_transform(string_split(path, '/'), lambda s: url_encode(s)), '/') AS encoded, "
    f"substr(regexp_replace({_T1}, '[<>:\"/\\\\|?*]', '_', 'g'), 1, 100) AS file_name FROM notes",
)
def _(spark, d):
    return D.notes(spark, d).select("path", X.encode_path(C("path")).alias("encoded"), X.safe_file_name(C("path")).alias("file_name"))


@query(
    "session_title", "OP-031",
    "SELECT conv_id, turn, substr(trim(regexp_extract(text, '^[^。\n!?？]*'), e' \\t\\r\\n'), 1, 12) AS title FROM conversations "
    "WHERE role = 'user' AND trim(regexp_extract(text, '^[^。\n!?？]*'), e' \\t\\r\\n') <> ''",
)
def _(spark, d):
    t = D.table(spark, d, "conversations").where("role = 'user'")
    return t.select("conv_id", "turn", X.session_title(C("text")).alias("title")).where("title IS NOT NULL")


@query(
    "json_payload", "OP-034",
    "WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Sure:\n```json\n{\"n\": ' || CAST(turn AS STRING) || '}\n``` ok' "
    "WHEN 1 THEN text || ' {\"n\": ' || CAST(turn AS STRING) || '} bye' ELSE text END AS reply FROM conversations) "
    "SELECT conv_id, turn, CASE WHEN contains(reply, '```json') THEN trim(split_part(split_part(reply, '```json', 2), '```', 1), e' \\n') "
    "WHEN contains(reply, '{') AND contains(reply, '}') THEN regexp_extract(reply, '(?s)(\\{.*\\})', 1) ELSE reply END AS payload FROM r",
)
def _(spark, d):
    t = D.table(spark, d, "conversations").withColumn(
        "reply",
        F.expr(
            "CASE turn % 3 WHEN 0 THEN 'Sure:\\n```json\\n{\"n\": ' || CAST(turn AS STRING) || '}\\n``` ok' "
            "WHEN 1 THEN text || ' {\"n\": ' || CAST(turn AS STRING) || '} bye' ELSE text END"
        ),
    )
    return t.select("conv_id", "turn", X.json_payload(C("reply")).alias("payload"))


@query(
    "gram_hash", "OP-025",
    "WITH g AS (SELECT doc_id, g, length(g) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]{2,4}')) AS g FROM documents)), "
    "v AS (SELECT doc_id, list_sum(list_transform(range(1, n + 1), lambda i: unicode(substr(g, i, 1)) * CAST(pow(33, n - i) AS BIGINT))) "
    "+ 5381 * CAST(pow(33, n) AS BIGINT) AS h FROM g) "
    "SELECT doc_id, count(*) AS grams, CAST(sum(CASE WHEN h % 4294967296 >= 2147483648 THEN h % 4294967296 - 4294967296 ELSE h % 4294967296 END) AS BIGINT) AS hash_sum FROM v GROUP BY doc_id",
)
def _(spark, d):
    t = D.table(spark, d, "documents")
    g = t.select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("[^ \n]{2,4}"), F.lit(0))).alias("g")).where("g IS NOT NULL")
    return g.groupBy("doc_id").agg(F.count("*").alias("grams"), F.sum(X.gram_hash(C("g"))).alias("hash_sum"))


_WORDS3 = "regexp_extract(text, '^\\S*\\s+\\S*\\s+\\S*', 0)"


@query(
    "highlight", "OP-020",
    f"WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_split_to_array(lower({_WORDS3}), '\\s+'), lambda t: length(t) >= 2) AS ws FROM conversations) "
    "SELECT conv_id, turn, CASE WHEN length(ws) = 0 THEN text ELSE regexp_replace(text, '(?i)(' || array_to_string(list_transform(ws, "
    "lambda x: regexp_replace(x, '([.*+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '|') || ')', '<mark>\\1</mark>', 'g') END AS text FROM w",
)
def _(spark, d):
    t = D.table(spark, d, "conversations")
    return t.select("conv_id", "turn", X.highlight(C("text"), F.regexp_extract("text", r"^\S*\s+\S*\s+\S*", 0)).alias("text"))


# --- paths -------------------------------------------------------------------
@query("folder_rollup", "OP-011", _N + f"SELECT folder, count(*) AS notes FROM (SELECT unnest({Q.FOLDERS}) AS folder FROM notes) GROUP BY folder")
def _(spark, d):
    return P.folder_rollup(D.notes(spark, d))


@query("top_folder_counts", "OP-011", _N + f"SELECT {Q.TOP} AS folder, count(*) AS notes FROM notes GROUP BY 1")
def _(spark, d):
    return P.top_folder_counts(D.notes(spark, d))


@query(
    "scope_filter", "OP-013",
    _N + "SELECT path, mtime FROM notes WHERE path LIKE 'inbox/%' OR path LIKE 'area1/%' OR path IN ('inbox', 'area1')",
)
def _(spark, d):
    return P.scope_filter(D.notes(spark, d), ["inbox", "area1"]).select("path", "mtime")


_BOOKS = "SELECT CASE WHEN doc_id % 5 = 0 THEN '📕 ' || path WHEN doc_id % 5 = 1 THEN '📘 ' || path ELSE path END AS path, mtime FROM notes"


@query("drop_local", "OP-014", _N + f"SELECT * FROM ({_BOOKS}) WHERE left(path, 1) NOT IN ('📕', '📘')")
def _(spark, d):
    n = D.notes(spark, d).selectExpr(_BOOKS.split("SELECT ")[1].split(" AS path")[0] + " AS path", "mtime")
    return P.drop_local(n)


@query("markdown_only", "OP-015", D.with_tables("manifest") + "SELECT path, size FROM manifest WHERE path ILIKE '%.md'")
def _(spark, d):
    return P.markdown_only(D.manifest(spark, d)).select("path", "size")


@query(
    "path_search", "OP-017",
    _N + f"SELECT 'hit' AS kind, path, CAST(1 AS BIGINT) AS n FROM notes WHERE lower(path) LIKE '%euxle%' UNION ALL "
    f"SELECT 'folder', f, count(*) FROM (SELECT DISTINCT unnest({Q.FOLDERS}) AS f FROM notes WHERE lower(path) LIKE '%euxle%') GROUP BY f",
)
def _(spark, d):
    n = D.notes(spark, d)
    hits = P.path_search(n, " EUXLE ").select(F.lit("hit").alias("kind"), "path", F.lit(1).cast("bigint").alias("n"))
    return hits.unionByName(
        P.path_search_folders(n, "euxle").select(F.lit("folder").alias("kind"), C("folder").alias("path"), F.lit(1).cast("bigint").alias("n"))
    )


_TREE = (
    f"t AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, {Q.base('path')} AS name, is_dir, length(string_split(path, '/')) AS depth, notes FROM "
    f"(SELECT path, false AS is_dir, 1 AS notes FROM notes UNION ALL SELECT f, true, count(*) FROM (SELECT unnest({Q.FOLDERS}) AS f FROM notes) GROUP BY f))"
)


@query("file_tree", "OP-018", D.with_tables("notes").rstrip() + ", " + _TREE + " SELECT parent, name, path, is_dir, CAST(depth AS BIGINT) AS depth, CAST(notes AS BIGINT) AS notes FROM t")
def _(spark, d):
    return P.file_tree(D.notes(spark, d)).withColumn("depth", C("depth").cast("bigint"))
