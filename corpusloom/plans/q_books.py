"""Queries over automatic links, books, HTML and saved web results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.operators import autolink as AL, books as B
from corpusloom.plans import derive as D, sqltext as Q
from corpusloom.plans.q_links import _TAGLIST, big
from corpusloom.plans.q_text import KEYWORDS_SQL
from corpusloom.plans.registry import query
from corpusloom.sources import books as SB, notes as SN, web as SW

C = F.col
_N = D.with_tables("notes").rstrip()

# --- automatic links -------------------------------------------------------------
_MASK = "regexp_replace(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]*)?\\]\\]', chr(1) || '\\0' || chr(1), 'g')"
_MASKED = (
    f"lower(array_to_string(list_transform(string_split({_MASK}, chr(1)), lambda p: CASE WHEN regexp_full_match(p, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]*)?\\]\\]') THEN repeat(chr(2), length(p)) ELSE p END), ''))"
)
_CAND = KEYWORDS_SQL + (
    f", tg AS (SELECT k4.path AS target, {Q.title('k4.path')} AS title, kws FROM k4 WHERE length({Q.title('k4.path')}) >= 3 AND length(kws) > 0), "
    f"sr AS (SELECT path AS source, content, {_MASKED} AS low, list_transform(regexp_extract_all(content, '\\[\\[([^\\]|]+?)(?:\\|[^\\]]*)?\\]\\]', 1), lambda x: lower(trim(x))) AS have FROM notes), "
    "kw AS (SELECT DISTINCT unnest(kws) AS w FROM tg), "
    "ht AS (SELECT source, w, position(w in low) - 1 AS ofs FROM sr, kw WHERE contains(low, w)), "
    "us AS (SELECT source, w, ofs FROM ht JOIN sr USING (source) WHERE NOT (ofs < 200 AND contains(substr(content, 1, ofs), '---'))), "
    "tw AS (SELECT target, lower(title) AS lt, unnest(kws) AS w, unnest(range(0, length(kws))) AS kpos FROM tg), "
    "pr AS (SELECT source, target, arg_min(w, kpos) AS keyword, arg_min(ofs, kpos) AS ofs FROM us JOIN tw USING (w) WHERE source <> target GROUP BY ALL), "
    "ex AS (SELECT source, target FROM (SELECT DISTINCT source, unnest(have) AS h FROM sr) JOIN tg ON lower(title) = h WHERE source <> target), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS r FROM pr ANTI JOIN ex USING (source, target)), "
    "cand AS (SELECT * FROM rk WHERE r <= 50) "
)


@query(
    "link_candidates", "OP-074 OP-073 OP-023",
    _CAND + "SELECT source, target, keyword, CAST(ofs AS BIGINT) AS \"offset\", substr(content, greatest(0, ofs - 30) + 1, least(length(content), ofs + length(keyword) + 30) - greatest(0, ofs - 30)) AS preview FROM cand JOIN sr USING (source)",
)
def _(spark, d):
    return AL.link_candidates(D.notes(spark, d)).select("source", "target", "keyword", *big("offset"), "preview")


@query(
    "skipped_targets", "OP-074",
    _CAND + ", en AS (SELECT source, count(*) AS n, max(target) AS last FROM cand GROUP BY source) SELECT source, count(*) AS skipped FROM ex LEFT JOIN en USING (source) WHERE coalesce(n < 50, true) OR target < last GROUP BY source",
)
def _(spark, d):
    n = D.notes(spark, d)
    return AL.skipped_targets(n, AL.link_candidates(n))


@query(
    "outside_links", "OP-073",
    _N + f", m AS (SELECT path, {_MASKED} AS low, lower({Q.title('path')}) AS kw FROM notes) SELECT path, CAST(position('知识' in low) - 1 AS BIGINT) AS han, CAST(position('next' in low) - 1 AS BIGINT) AS latin FROM m",
)
def _(spark, d):
    return D.notes(spark, d).select("path", *[AL.outside_links(C("content"), F.lit(w)).cast("bigint").alias(n) for w, n in (("知识", "han"), ("NEXT", "latin"))])


# of overlapping candidates the leftmost, then longest, stays; marks are numbered from the end
_APPLIED = _CAND.replace("WITH ", "WITH RECURSIVE ", 1) + (
    ", od AS (SELECT source, target, ofs, length(keyword) AS n, row_number() OVER (PARTITION BY source ORDER BY ofs, length(keyword) DESC, target) AS i FROM cand), "
    "wk AS (SELECT source, i, ofs, n, target, true AS kept, ofs + n AS till FROM od WHERE i = 1 UNION ALL "
    "SELECT o.source, o.i, o.ofs, o.n, o.target, o.ofs >= w.till, CASE WHEN o.ofs >= w.till THEN o.ofs + o.n ELSE w.till END FROM wk w JOIN od o ON o.source = w.source AND o.i = w.i + 1), "
    "kp AS (SELECT source, ofs, n, target, row_number() OVER (PARTITION BY source ORDER BY ofs DESC) - 1 AS no, lag(ofs + n, 1, 0) OVER (PARTITION BY source ORDER BY ofs) AS prev FROM wk WHERE kept), "
    "tx AS (SELECT source, count(*) AS links, max(ofs + n) AS last, string_agg(substr(content, prev + 1, ofs - prev) || '<!--@autolink:' || no || ':' || array_to_string(list_transform(string_split(target, '/'), lambda s: url_encode(s)), '/') "
    "|| '-->[[' || substr(content, ofs + 1, n) || ']]', '' ORDER BY ofs) AS head FROM kp JOIN notes ON path = source GROUP BY source) "
    "SELECT path, coalesce(links, 0) AS links, mtime + CASE WHEN links > 0 THEN 1 ELSE 0 END AS mtime, md5(CASE WHEN links > 0 THEN head || substr(content, last + 1) ELSE content END) AS digest FROM notes LEFT JOIN tx ON source = path"
)


@query("apply_links", "OP-075", _APPLIED)
def _(spark, d):
    """Candidates written into the notes."""
    n = D.notes(spark, d).select("path", "content", "mtime")
    done = AL.apply_links(n, AL.link_candidates(n), mtime=C("mtime") + 1)
    return done.select("path", F.regexp_count("content", F.lit(AL.MARKED)).cast("bigint").alias("links"), "mtime", F.md5("content").alias("digest"))


@query(
    "revert_links", "OP-076 OP-075",
    _N + " SELECT path, md5(content) AS digest FROM notes",
)
def _(spark, d):
    """Taking inserted links back gives every note its text again."""
    n = D.notes(spark, d).select("path", "content", "mtime")
    return AL.revert_links(AL.apply_links(n, AL.link_candidates(n))).select("path", F.md5("content").alias("digest"))


@query(
    "revert_counts", "OP-076",
    _N + " SELECT path, CAST(doc_id % 3 AS BIGINT) AS removed, md5(content || repeat('word', doc_id % 3) || ' [[kept]]') AS digest FROM notes",
)
def _(spark, d):
    n = D.notes(spark, d)
    marked = n.withColumn("content", F.expr("content || repeat('<!--@autolink:1:a%20b.md-->[[word]]', CAST(doc_id % 3 AS INT)) || ' [[kept]]'"))
    return AL.revert_links(marked).select("path", "removed", F.md5("content").alias("digest"))


# --- front matter ---------------------------------------------------------------------
_BODY = "regexp_replace(content, '^---\\r?\\n[\\s\\S]*?\\r?\\n---\\r?\\n?', '')"


@query(
    "front_matter", "OP-027",
    _N + f" SELECT path, md5({_BODY}) AS body, CASE WHEN content LIKE '---%' THEN CAST(doc_id AS STRING) END AS ordinal, "
    "CASE WHEN content NOT LIKE '---%' THEN NULL WHEN doc_id % 10 = 9 THEN '[open' END AS note FROM notes",
)
def _(spark, d):
    p = SN.parse_front_matter(D.notes(spark, d))
    return p.select("path", F.md5("body").alias("body"), C("fm")["order"].alias("ordinal"), C("fm")["note"].alias("note"))


_INLINE = f"list_transform(regexp_extract_all({_BODY}, '(?:^|\\s|[(\\[])#([a-zA-Z一-龥][a-zA-Z0-9_\\-/一-龥]*)', 1), lambda x: x)"
_GOOD = "content LIKE '---%' AND doc_id % 10 <> 9"


@query(
    "all_tags", "OP-028 OP-029 OP-027",
    _N + f" SELECT path, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN {_GOOD} THEN {_TAGLIST} ELSE [] END, "
    f"list_concat(CASE WHEN content LIKE '---%' AND doc_id % 4 = 0 THEN [CASE WHEN doc_id % 10 = 9 THEN '''#hot''' ELSE 'hot' END] ELSE [] END, {_INLINE})))), '|') AS tags, "
    f"array_to_string(CASE WHEN {_GOOD} THEN [lang, source, '#' || {D.topic_sql('doc_id')}] WHEN content LIKE '---%' THEN ['[' || lang, '\"' || source || '\"', '\"#' || {D.topic_sql('doc_id')} || '\"]'] ELSE [] END, '|') AS note_tags FROM notes JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)",
)
def _(spark, d):
    p = SN.parse_front_matter(D.notes(spark, d))
    return p.select(
        "path", F.array_join(F.array_sort(X.all_tags(C("body"), C("fm_tags"), C("fm_tag"))), "|").alias("tags"),
        F.array_join(X.note_tags(C("fm_tags"), C("fm_tags_text")), "|").alias("note_tags"),
    )


# --- web results ------------------------------------------------------------------------
_SERP = (
    "'<div><a rel=\"x\" class=\"result__a\" href=\"' || url || '\"><b>' || split_part(url, '/', 3) || '</b> one</a><td class=\"result__snippet\"> ' || html || '</td>' || "
    "'<a class=\"result__a\" href=\"/two\"> second <i>' || CAST(page_id AS STRING) || '</i></a>' || CASE WHEN page_id % 2 = 0 THEN '<td class=\"result__snippet\">plain</td>' ELSE '' END || '</div>'"
)
_STRIP_HTML = "trim(regexp_replace(html, '<[^>]*>', '', 'g'), e' \\t\\n')"


@query(
    "parse_serp", "OP-009",
    "WITH p AS (SELECT page_id, url, regexp_extract(html, '(?s)^(.*?)(</td>|$)', 1) AS html FROM pages) "
    f"SELECT page_id, CAST(0 AS BIGINT) AS pos, split_part(url, '/', 3) || ' one' AS title, url, substr({_STRIP_HTML}, 1, 800) AS content FROM p "
    "UNION ALL SELECT page_id, 1, 'second ' || CAST(page_id AS STRING), '/two', CASE WHEN page_id % 2 = 0 THEN 'plain' ELSE '' END FROM p",
)
def _(spark, d):
    p = D.table(spark, d, "pages").selectExpr("page_id", f"{_SERP} AS html")
    return SW.parse_serp(p, 5).select("page_id", *big("pos"), "title", "url", "content")


@query(
    "normalize_web_json", "OP-010",
    "SELECT page_id, CAST(0 AS BIGINT) AS pos, CASE WHEN page_id % 4 = 3 THEN '' ELSE 'p' || CAST(page_id AS STRING) END AS title, url, substr(html, 1, 800) AS content FROM pages "
    "UNION ALL SELECT page_id, 1, 'second', '', '' FROM pages",
)
def _(spark, d):
    body = "html"
    name = "'p' || CAST(page_id AS STRING)"
    j = D.table(spark, d, "pages").selectExpr(
        "page_id",
        f"CASE page_id % 4 WHEN 0 THEN to_json(named_struct('results', array(named_struct('title', {name}, 'url', url, 'content', {body}), named_struct('title', 'second', 'url', '', 'content', ''))))"
        f" WHEN 1 THEN to_json(named_struct('webPages', named_struct('value', array(named_struct('name', {name}, 'url', url, 'snippet', {body}), named_struct('name', 'second', 'url', '', 'snippet', '')))))"
        f" WHEN 2 THEN to_json(named_struct('data', array(named_struct('name', {name}, 'link', url, 'text', {body}), named_struct('name', 'second', 'link', '', 'text', ''))))"
        f" ELSE to_json(named_struct('results', array(named_struct('title', '', 'link', url, 'snippet', {body}), named_struct('title', 'second', 'link', '', 'snippet', '')))) END AS json",
    )
    return SW.normalize_web_json(j).select("page_id", *big("pos"), "title", "url", "content")


# --- books --------------------------------------------------------------------------------
_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")]


def _plain(e: str) -> str:
    for name, char in _ENTITIES:
        e = f"replace({e}, '{name}', '{char}')"
    return f"trim(regexp_replace({e}, '&amp;?', '&', 'g'), e' \\t\\r\\n')"


PAGE_TITLE = _plain("regexp_extract(html, '<title>([^<]*)</title>', 1)")
PAGE_TEXT = _plain("regexp_replace(regexp_replace(regexp_extract(html, '(?s)</head>(.*)$', 1), '<!--[\\s\\S]*?-->', '', 'g'), '<[^>]*(>|$)', '', 'g')")


@query("chapter_text", "OP-007", f"SELECT page_id, {PAGE_TITLE} AS title, {PAGE_TEXT} AS text, {PAGE_TEXT} = '' AS empty FROM pages")
def _(spark, d):
    return SB.chapter_text(D.table(spark, d, "pages")).select("page_id", "title", "text", "empty")


_CHAPS = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'big' ELSE source || '/' || lang END AS book, doc_id AS ord, 'Part ' || CAST(doc_id AS STRING) AS title, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS text FROM documents"


def chapters(spark, d):
    return D.derived(
        spark, d, "documents", "CASE WHEN doc_id % 3 = 0 THEN 'big' ELSE source || '/' || lang END AS book", "doc_id AS ord",
        "'Part ' || CAST(doc_id AS STRING) AS title", "CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE text END AS text",
    )


@query(
    "assemble_book", "OP-008",
    f"WITH c AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ord) AS pos, count(*) OVER (PARTITION BY book) AS n FROM ({_CHAPS}) WHERE trim(text) <> ''), "
    "p AS (SELECT book, pos, n, CASE WHEN pos > 1 THEN chr(10) || chr(10) ELSE '' END || '## ' || title || chr(10) || chr(10) || text AS x FROM c) "
    "SELECT book, pos, md5(CASE WHEN pos = n THEN rtrim(x, e' \\n') ELSE x END) AS digest FROM p",
)
def _(spark, d):
    return B.assemble_book(chapters(spark, d)).select("book", "pos", F.md5("text").alias("digest"))


@query(
    "book_report", "OP-008",
    f"SELECT book, count(*) AS chapters, count_if(trim(text) = '') AS empty, CAST(sum(length(text)) AS BIGINT) AS chars, count_if(trim(text) = '') > count(*) * 0.5 AS scanned FROM ({_CHAPS}) GROUP BY book",
)
def _(spark, d):
    return B.book_report(chapters(spark, d)).withColumn("empty", C("empty").cast("bigint"))


@query(
    "page_chapters", "OP-008",
    "SELECT conv_id AS book, turn AS ord, '第 ' || CAST(turn AS STRING) || ' 页' AS title, text FROM conversations",
)
def _(spark, d):
    return B.page_chapters(D.table(spark, d, "conversations").selectExpr("conv_id AS book", "turn AS page", "text"))


def _epub_bytes(pdf_iter):
    """Small archives built from page rows, as input for the reader."""
    import io
    import zipfile

    import pandas as pd

    for pdf in pdf_iter:
        out = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"]):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
                z.writestr(
                    "OEBPS/book.opf",
                    '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="b" href="two.html" media-type="text/html"/>'
                    '<item id="c" href="pic.png" media-type="image/png"/></manifest><spine><itemref idref="b"/><itemref idref="c"/><itemref idref="a"/></spine></package>',
                )
                z.writestr("OEBPS/one.xhtml", html)
                z.writestr("OEBPS/two.html", f"<html><body><h2>Link {page_id}</h2><p>{url}</p></body></html>")
            out.append((f"{page_id}.epub", buf.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query(
    "epub_chapters", "OP-006",
    "SELECT CAST(page_id AS STRING) || '.epub' AS book, CAST(0 AS BIGINT) AS ord, 'OEBPS/two.html' AS part, 'Link ' || CAST(page_id AS STRING) AS title, 'Link ' || CAST(page_id AS STRING) || url AS text, CAST(3 AS BIGINT) AS spine, CAST(4 AS BIGINT) AS files FROM pages "
    f"UNION ALL SELECT CAST(page_id AS STRING) || '.epub', 1, 'OEBPS/one.xhtml', {PAGE_TITLE}, {PAGE_TEXT}, 3, 4 FROM pages",
)
def _(spark, d):
    archives = D.table(spark, d, "pages").mapInPandas(_epub_bytes, "path string, content binary")
    return SB.parse_epub(archives).select("book", *big("ord"), "part", "title", "text", *big("spine", "files"))


_BOOK = (
    "CASE WHEN doc_id % 2 = 0 THEN '📕' ELSE '📘' END || ' Book ' || CAST(doc_id % 60 AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.epub' END "
    "|| CASE WHEN doc_id % 240 >= 180 THEN '.md' WHEN doc_id % 240 >= 120 THEN ' (1)' ELSE '' END"
)
_BCH = f"bc AS (SELECT CASE WHEN doc_id % 5 = 4 THEN 'notes/x.md' ELSE {_BOOK} END AS path, doc_id AS idx, CASE WHEN doc_id % 4 = 3 THEN '' ELSE source END AS heading, text AS content, doc_id * 10 AS mtime FROM documents)"
_SUM = (
    "sm0 AS (SELECT path, count(*) AS chunks, CAST(sum(length(content)) AS BIGINT) AS chars, max(mtime) AS indexed FROM bc WHERE left(path, 1) IN ('📕', '📘') GROUP BY path), "
    "hd AS (SELECT path, heading, row_number() OVER (PARTITION BY path ORDER BY min(idx), heading) AS n FROM bc WHERE heading <> '' GROUP BY path, heading), "
    "hs AS (SELECT path, string_agg(heading, '|' ORDER BY n) AS headings FROM hd WHERE n <= 3 GROUP BY path), "
    "sm AS (SELECT path, CASE WHEN left(path, 1) = '📕' THEN 'pdf' ELSE 'epub' END AS type, chunks, chars, indexed, coalesce(headings, '') AS headings FROM sm0 LEFT JOIN hs USING (path) "
    "WHERE NOT (path LIKE '%.md' AND regexp_replace(path, '\\.md$', '') IN (SELECT path FROM sm0)))"
)


def book_chunks(spark, d):
    return D.derived(
        spark, d, "documents", f"CASE WHEN doc_id % 5 = 4 THEN 'notes/x.md' ELSE {_BOOK} END AS path", "doc_id AS idx",
        "CASE WHEN doc_id % 4 = 3 THEN '' ELSE source END AS heading", "text AS content", "doc_id * 10 AS mtime",
    )


@query("book_summary", "OP-077", f"WITH {_BCH}, {_SUM} SELECT * FROM sm")
def _(spark, d):
    return B.book_summary(book_chunks(spark, d))


@query(
    "dedupe_books", "OP-078",
    f"WITH {_BCH}, {_SUM}, k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(substr(path, 2)), '\\.(md|pdf|epub)', '', 'g'), '\\(\\d+\\)', '', 'g'), '\\s+', '', 'g') AS key FROM sm), "
    "r AS (SELECT path, first_value(path) OVER (PARTITION BY key ORDER BY chunks DESC, path) AS keep FROM k) SELECT path, keep FROM r WHERE path <> keep",
)
def _(spark, d):
    return B.dedupe_books(B.book_summary(book_chunks(spark, d)))


_BN = "CASE WHEN doc_id % 3 = 0 THEN path || '.md' WHEN doc_id % 3 = 1 THEN 'old/' || upper(path) || '.md' ELSE 'unrelated/' || path END"


@query(
    "recover_text", "OP-079",
    f"WITH {_BCH}, bk AS (SELECT DISTINCT path FROM bc WHERE left(path, 1) IN ('📕', '📘')), "
    "bn AS (SELECT " + _BN.replace("doc_id", "length(path)") + " AS path, path || repeat(' text', length(path) % 13) AS content FROM bk), "
    "ch AS (SELECT bk.path, coalesce(n1.content, n2.content) AS content, CASE WHEN n1.path IS NULL THEN 'same name' ELSE 'note' END AS source FROM bk LEFT JOIN bn n1 ON n1.path = bk.path || '.md' "
    "LEFT JOIN (SELECT lower(regexp_extract(path, '([^/]*)$', 1)) AS base, arg_min(content, path) AS content FROM bn GROUP BY 1) n2 ON n2.base = lower(bk.path) || '.md'), "
    "ok AS (SELECT path, CAST(1 AS BIGINT) AS pos, source, content AS text FROM ch WHERE length(content) >= 50), "
    "rs AS (SELECT path FROM bc WHERE path IN (SELECT path FROM bk) AND path NOT IN (SELECT path FROM ok) GROUP BY path HAVING length(string_agg(content, chr(10) || chr(10))) >= 50), "
    "rn AS (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY idx) AS pos FROM bc WHERE path IN (SELECT path FROM rs)), "
    "rb AS (SELECT path, pos, 'chunks' AS source, CASE WHEN pos > 1 THEN chr(10) || chr(10) ELSE '' END || content AS text FROM rn) "
    "SELECT path, pos, source, md5(text) AS digest FROM (SELECT * FROM ok UNION ALL SELECT * FROM rb)",
)
def _(spark, d):
    ch = book_chunks(spark, d)
    bk = ch.where(X.starts_with_any(C("path"), K.LOCAL_MARKS)).select("path").distinct()
    notes = bk.selectExpr(_BN.replace("doc_id", "length(path)") + " AS path", "path || repeat(' text', length(path) % 13) AS content")
    return B.recover_text(bk, notes, ch).select("path", "pos", "source", F.md5("text").alias("digest"))


@query(
    "book_note", "OP-080",
    "WITH b AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'epub' END AS kind, CASE WHEN doc_id % 2 = 0 THEN '📕' ELSE '📘' END AS m, source || ' ' || CAST(doc_id AS STRING) AS name, text FROM documents) "
    "SELECT m || ' ' || name || '.md' AS path, md5('---' || chr(10) || 'local-file: ' || kind || chr(10) || 'original-name: ' || name || chr(10) || 'chunks: ' || CAST(doc_id AS STRING) || chr(10) || 'total-chars: ' || CAST(length(text) AS STRING) || chr(10) || '---' || chr(10) || chr(10) || '# ' || m || ' ' || name || chr(10) || chr(10) || text || chr(10)) AS digest FROM b",
)
def _(spark, d):
    b = D.table(spark, d, "documents").selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'pdf' ELSE 'epub' END AS kind", "source || ' ' || CAST(doc_id AS STRING) AS name", "doc_id AS chunks", "text")
    return B.book_note(b).select("path", F.md5("content").alias("digest"))
