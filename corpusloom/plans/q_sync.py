"""Queries over listings, manifests and note tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.functions.storage import shared_folder
from corpusloom.operators import sync as S
from corpusloom.plans import derive as D
from corpusloom.plans.registry import query
from corpusloom.sources import listing as L

C = F.col
_NM = D.with_tables("notes", "manifest")
_N = D.with_tables("notes")

# listing lines derived from documents; every form of time, etag and key occurs
_STAMP = "'2024-0' || CAST(doc_id % 9 + 1 AS STRING) || '-1' || CAST(doc_id % 10 AS STRING) || ' 0' || CAST(doc_id % 10 AS STRING) || ':15:30'"
_ETAG = "CASE doc_id % 4 WHEN 0 THEN '\"' || upper(md5(text)) || '\"' WHEN 1 THEN md5(text) WHEN 2 THEN md5(text) || '-3' ELSE 'none' END"
_KEY = (
    f"CASE WHEN doc_id % 31 = 0 THEN 'welcome/pic ' || CAST(doc_id AS STRING) || '.PNG' WHEN doc_id % 31 = 1 THEN 'welcome/sub/pic.jpg' WHEN doc_id % 31 = 2 THEN 'base/manifest.json' "
    f"WHEN doc_id % 31 = 3 THEN 'base/a/' || CAST(doc_id AS STRING) || '.markdown' WHEN doc_id % 31 = 4 THEN 'other/x' || CAST(doc_id AS STRING) || '.md' WHEN doc_id % 31 = 5 THEN 'base/noext' ELSE 'base/' || {D.path_sql('doc_id')} END"
)
LINE = (
    f"(CASE WHEN doc_id % 37 = 6 THEN 'total objects 12' WHEN doc_id % 37 = 7 THEN '12 store://box/short' ELSE {_STAMP} || (CASE doc_id % 3 WHEN 0 THEN ' +0800 CST ' WHEN 1 THEN ' -0330 ' ELSE ' ' END) "
    f"|| CAST(n_chars AS STRING) || '   Standard   ' || {_ETAG} || '   store://box/' || {_KEY} END)"
)
_ZONE = "CASE doc_id % 3 WHEN 1 THEN -12600000 ELSE 28800000 END"
_MS = f"CAST(epoch_ms(strptime({_STAMP}, '%Y-%m-%d %H:%M:%S')) AS BIGINT) - ({_ZONE})"
_HASH = "CASE WHEN doc_id % 4 = 3 THEN 's' || CAST(n_chars AS STRING) || '-m' || CAST(ms AS STRING) WHEN doc_id % 4 = 2 THEN md5(text) || '-3' ELSE md5(text) END"
_LISTED = f"WITH lst AS (SELECT doc_id, text, n_chars, {_KEY} AS key, {_MS} AS ms, {_ETAG} AS etag FROM documents WHERE doc_id % 37 NOT IN (6, 7)) "


def lines(spark, d):
    # generated, so that filters on the line are not pushed into its long expression
    return D.derived(spark, d, "documents", f"explode_outer(array({LINE})) AS value")


def listing(spark, d):
    return L.parse_listing(lines(spark, d), "store://box")


@query("parse_listing", "OP-002", _LISTED + "SELECT key, n_chars AS size, ms AS mtime, etag FROM lst")
def _(spark, d):
    return listing(spark, d)


@query(
    "build_manifest", "OP-003",
    _LISTED + f"SELECT substr(key, 6) AS path, n_chars AS size, ms AS mtime, {_HASH} AS hash FROM lst WHERE key LIKE 'base/%' AND lower(key) LIKE '%.md'",
)
def _(spark, d):
    return L.build_manifest(listing(spark, d), "base")


@query(
    "image_manifest", "OP-004",
    _LISTED + f"SELECT substr(key, 9) AS name, n_chars AS size, {_HASH} AS hash FROM lst WHERE key LIKE 'welcome/pic%'",
)
def _(spark, d):
    return L.image_manifest(listing(spark, d), "welcome")


@query(
    "read_manifest", "OP-001",
    _NM + "SELECT path, size, mtime, hash FROM manifest",
)
def _(spark, d):
    """The manifest written as files with one JSON array each, of the notes of some minutes,
    and read back by ranges of bytes."""
    m = D.manifest(spark, d)
    docs = m.withColumn("part", F.floor(F.col("mtime") / 3_000_000)).groupBy("part").agg(
        F.to_json(F.collect_list(F.struct("path", "size", "mtime", "hash"))).alias("value")
    )
    path = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return L.read_manifest(spark, path)


@query(
    "changed_notes", "OP-051",
    _NM + "SELECT m.path, m.size, m.mtime, m.hash FROM manifest m LEFT JOIN notes n USING (path) WHERE n.path IS NULL OR n.hash <> m.hash OR n.mtime < m.mtime",
)
def _(spark, d):
    return S.changed(D.manifest(spark, d), D.notes(spark, d))


@query("stale_notes", "OP-052", _NM + "SELECT path, hash FROM notes WHERE path NOT IN (SELECT path FROM manifest)")
def _(spark, d):
    return S.stale(D.notes(spark, d), D.manifest(spark, d)).select("path", "hash")


@query(
    "upsert_notes", "OP-053",
    _N + ", up AS (SELECT CASE WHEN doc_id % 6 = 0 THEN 'new/' || path ELSE path END AS path, mtime + k * 10 AS mtime, hash || CAST(k AS STRING) AS hash FROM notes, range(1, 4) t(k) WHERE doc_id % 2 = 0) "
    "SELECT path, mtime, hash FROM (SELECT path, mtime, hash FROM notes WHERE path NOT IN (SELECT path FROM up) UNION ALL "
    "SELECT path, mtime, hash FROM up QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC) = 1)".replace("), up AS", "), up AS"),
)
def _(spark, d):
    n = D.notes(spark, d)
    up = n.where("doc_id % 2 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).selectExpr(
        "CASE WHEN doc_id % 6 = 0 THEN 'new/' || path ELSE path END AS path", "mtime + k * 10 AS mtime", "hash || CAST(k AS STRING) AS hash"
    )
    return S.upsert(n.select("path", "mtime", "hash"), up, ["path"], "mtime")


_BYTES = "CAST(hex(encode(text)) AS STRING)"
_DIGIT = "(position(substr(x, {p}, 1) in '0123456789ABCDEF') - 1)"
_DJB = (
    "list_reduce(list_concat([CAST(5381 AS BIGINT)], list_transform(range(0, length(x) // 2), lambda i: CAST("
    + _DIGIT.format(p="2 * i + 1") + " * 16 + " + _DIGIT.format(p="2 * i + 2") + " AS BIGINT))), lambda a, c: (a * 33 + c) % 4294967296)"
)
_BASE36 = "ltrim(" + " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // {36 ** p}) % 36 AS BIGINT) + 1, 1)" for p in range(6, -1, -1)) + ", '0')"


@query(
    "put_notes", "OP-054",
    _NM + ", e AS (SELECT path, mtime + 99 AS mtime, content || ' edited' AS text FROM notes WHERE doc_id % 3 = 0), "
    f"x AS (SELECT path, mtime, {_BYTES} AS x, octet_length(encode(text)) AS size FROM e), hh AS (SELECT path, mtime, size, {_DJB} AS h FROM x) "
    f"SELECT n.path, coalesce(hh.mtime, n.mtime) AS mtime, CASE WHEN hh.path IS NOT NULL THEN {_BASE36} ELSE n.hash END AS hash, CAST(coalesce(hh.size, m.size) AS BIGINT) AS size "
    "FROM notes n LEFT JOIN hh ON hh.path = n.path LEFT JOIN manifest m ON m.path = n.path",
)
def _(spark, d):
    n, m = D.notes(spark, d), D.manifest(spark, d)
    edits = n.where("doc_id % 3 = 0").select("path", F.concat("content", F.lit(" edited")).alias("content"), (C("mtime") + 99).alias("ts"))
    notes, manifest = S.put_notes(edits, n, m)
    return notes.select("path", "mtime", "hash").join(manifest.select("path", "size"), "path", "left")


@query(
    "sync_status", "OP-055",
    _NM + ", c AS (SELECT count(*) AS missing FROM manifest m LEFT JOIN notes n USING (path) WHERE n.path IS NULL OR n.hash <> m.hash OR n.mtime < m.mtime), t AS (SELECT count(*) AS total FROM manifest) "
    "SELECT total, total - missing AS synced, missing FROM t, c",
)
def _(spark, d):
    return S.sync_status(D.manifest(spark, d), D.notes(spark, d))


@query("sync_errors", "OP-055", _NM + "SELECT m.path, m.path || ': not cached' AS error FROM manifest m LEFT JOIN notes n USING (path) WHERE n.path IS NULL OR n.hash <> m.hash OR n.mtime < m.mtime")
def _(spark, d):
    return S.sync_errors(D.manifest(spark, d), D.notes(spark, d))


_NEWPATH = f"CASE doc_id % 6 WHEN 0 THEN 'moved/' || path WHEN 1 THEN path WHEN 2 THEN {D.path_sql('doc_id + 1')} WHEN 3 THEN '' WHEN 4 THEN 'moved/one.md' ELSE 'moved/' || path END"
_MOVES = f"SELECT CASE WHEN doc_id % 6 = 5 THEN 'gone/' || path ELSE path END AS old, {_NEWPATH} AS new, mtime + 7 AS ts FROM notes"
_MOVED = (
    ", mv AS (" + _MOVES + "), j AS (SELECT old, new, ts, CASE WHEN new = '' THEN 'empty target' WHEN old = new THEN 'same path' WHEN old NOT IN (SELECT path FROM notes) THEN 'missing source' "
    "WHEN new IN (SELECT path FROM notes) THEN 'target exists' WHEN row_number() OVER (PARTITION BY new ORDER BY CASE WHEN old IN (SELECT path FROM notes) AND old <> new THEN 0 ELSE 1 END, old) > 1 THEN 'conflicting move' END AS reason FROM mv) "
)


def moves(spark, d):
    n = D.notes(spark, d)
    return n.selectExpr("CASE WHEN doc_id % 6 = 5 THEN 'gone/' || path ELSE path END AS old", f"{_NEWPATH} AS new", "mtime + 7 AS ts")


@query("rename_checks", "OP-056", _N + _MOVED + "SELECT old, new, ts, reason FROM j")
def _(spark, d):
    return S.check_renames(moves(spark, d), D.notes(spark, d))


@query(
    "rename_notes", "OP-056",
    _N + _MOVED + "SELECT coalesce(new, path) AS path, hash, coalesce(ts, mtime) AS mtime FROM notes LEFT JOIN (SELECT * FROM j WHERE reason IS NULL) ON old = path",
)
def _(spark, d):
    n = D.notes(spark, d)
    return S.rename(n.select("path", "hash", "mtime"), S.check_renames(moves(spark, d), n))


@query(
    "delete_paths", "OP-057",
    _N + "SELECT path, hash FROM notes WHERE NOT (path LIKE 'inbox/%' OR path LIKE 'area1/笔记/%') AND path NOT IN (SELECT path FROM notes WHERE doc_id % 9 = 2)",
)
def _(spark, d):
    n = D.notes(spark, d)
    gone = n.where("doc_id % 9 = 2").select("path").unionByName(spark.createDataFrame([("inbox",), ("area1/笔记",)], "path string"))
    return S.delete_paths(n, gone).select("path", "hash")


@query(
    "corpus_census", "OP-058",
    _LISTED.rstrip() + ", " + "ins AS (SELECT * FROM lst WHERE key LIKE 'base/%'), md AS (SELECT * FROM ins WHERE lower(key) LIKE '%.md') "
    "SELECT 'extension' AS section, CASE WHEN regexp_matches(key, '\\.[^./]+$') THEN lower(regexp_extract(key, '\\.([^./]+)$', 1)) ELSE '(none)' END AS name, count(*) AS n FROM ins GROUP BY 1, 2 "
    "UNION ALL SELECT 'markdown', 'md', count(*) FROM md UNION ALL SELECT 'markdown', 'markdown', count(*) FROM ins WHERE key LIKE '%.markdown' "
    "UNION ALL SELECT 'markdown', 'odd case', count(*) FROM md WHERE key NOT LIKE '%.md' "
    "UNION ALL SELECT 'folder', CASE WHEN contains(substr(key, 6), '/') THEN split_part(substr(key, 6), '/', 1) ELSE '(root)' END, count(*) FROM md GROUP BY 1, 2 "
    "UNION ALL SELECT 'outside', split_part(key, '/', 1), count(*) FROM lst WHERE key NOT LIKE 'base/%' AND lower(key) LIKE '%.md' GROUP BY 1, 2 "
    "UNION ALL SELECT 'manifest', 'entries minus objects', (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) - (SELECT count(*) FROM md)",
)
def _(spark, d):
    return S.corpus_census(listing(spark, d), D.table(spark, d, "documents").where("doc_id % 10 <> 0"), "base")


_EDITS = "SELECT CASE WHEN doc_id % 5 = 1 THEN 'gone/' || path ELSE path END AS path, CASE WHEN doc_id % 5 = 2 THEN 'no such text #@' ELSE substr(content, 3, 6) END AS old_text, '<new>' AS new_text, mtime + 1 AS ts FROM notes"


@query(
    "edit_notes", "OP-059",
    _N + ", e AS (" + _EDITS + "), x AS (SELECT n.path, n.content, n.mtime, e.ts, position(old_text in n.content) AS p, length(old_text) AS l FROM notes n LEFT JOIN e USING (path)) "
    "SELECT path, md5(CASE WHEN p > 0 THEN substr(content, 1, p - 1) || '<new>' || substr(content, p + l) ELSE content END) AS digest, CASE WHEN p > 0 THEN ts ELSE mtime END AS mtime FROM x",
)
def _(spark, d):
    n = D.notes(spark, d)
    e = n.selectExpr(*[c for c in _split_cols(_EDITS)])
    return S.edit_notes(n, e)[0].select("path", F.md5("content").alias("digest"), "mtime")


@query(
    "edit_refusals", "OP-059",
    _N + ", e AS (" + _EDITS + ") SELECT e.path, CASE WHEN n.path IS NULL THEN 'note missing' ELSE 'text not found' END AS reason FROM e LEFT JOIN notes n USING (path) WHERE n.path IS NULL OR position(old_text in n.content) = 0",
)
def _(spark, d):
    n = D.notes(spark, d)
    return S.edit_notes(n, n.selectExpr(*_split_cols(_EDITS)))[1]


def _split_cols(select: str) -> list[str]:
    """Column expressions of the flat SELECT texts above."""
    body = select[len("SELECT ") : select.rindex(" FROM ")]
    out, depth, cur, quote = [], 0, "", False
    for ch in body:
        quote ^= ch == "'"
        depth += (ch == "(") - (ch == ")") if not quote else 0
        if ch == "," and depth == 0 and not quote:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]
