"""Queries over links, graphs, tags and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import constants as K
from corpusloom.operators import links as LK, related as RL, stats as ST
from corpusloom.plans import derive as D, sqltext as Q
from corpusloom.plans.registry import query

C = F.col
_N = D.with_tables("notes").rstrip()


def big(*names):
    return [C(n).cast("bigint").alias(n) for n in names]


# --- names ---------------------------------------------------------------------------
_RN = (
    ", tg AS (SELECT DISTINCT target, regexp_replace(lower(trim(target)), '\\.md$', '') AS tn, lower(trim(target)) AS t FROM "
    f"(SELECT unnest({Q.LINKS_RENDER}) AS target FROM notes UNION ALL SELECT CASE WHEN doc_id % 2 = 0 THEN 'ea' || CAST(doc_id % 30 AS STRING) ELSE ' THAND ' || CAST(doc_id % 40 AS STRING) END FROM notes)), "
    f"mf AS (SELECT path, lower({Q.title('path')}) AS n FROM notes), "
    "pr AS (SELECT target, path, CASE WHEN n = tn THEN 100 WHEN regexp_replace(n, '\\s', '', 'g') = regexp_replace(tn, '\\s', '', 'g') THEN 95 "
    "WHEN lower(path) IN (t, t || '.md') THEN 90 WHEN contains(n, tn) OR contains(tn, n) THEN 80 "
    "WHEN contains(regexp_replace(n, '\\s', '', 'g'), regexp_replace(tn, '\\s', '', 'g')) OR contains(regexp_replace(tn, '\\s', '', 'g'), regexp_replace(n, '\\s', '', 'g')) THEN 70 END AS score FROM tg, mf) "
)


def link_targets(spark, d):
    from corpusloom.functions import text as X

    n = D.notes(spark, d)
    extra = n.selectExpr("CASE WHEN doc_id % 2 = 0 THEN 'ea' || CAST(doc_id % 30 AS STRING) ELSE ' THAND ' || CAST(doc_id % 40 AS STRING) END AS target")
    return n.select(F.explode_outer(X.links_render(C("content"))).alias("target")).where("target IS NOT NULL").unionByName(extra)


@query("resolve_names", "OP-060", _N + _RN + "SELECT target, path, CAST(score AS BIGINT) AS score FROM pr WHERE score IS NOT NULL")
def _(spark, d):
    """Every note that a target may mean."""
    return LK.resolve_names(link_targets(spark, d), D.notes(spark, d), listed=None).select("target", "path", *big("score"))


@query("resolved_targets", "OP-060", _N + _RN + "SELECT target, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(path) END AS path FROM pr WHERE score IS NOT NULL GROUP BY target")
def _(spark, d):
    return LK.resolved_target(LK.resolve_names(link_targets(spark, d), D.notes(spark, d)))


# --- graph ---------------------------------------------------------------------------
_EDGES = (
    f", gl AS (SELECT path AS source, lower(unnest({Q.LINKS_GRAPH})) AS t FROM notes), "
    "ge AS (SELECT source, coalesce((SELECT max(path) FROM notes x WHERE lower(x.path) = t), (SELECT min(path) FROM notes x WHERE lower(regexp_extract(x.path, '([^/]*)$', 1)) = regexp_extract(t, '([^/]*)$', 1))) AS target FROM gl), "
    "edges AS (SELECT source, target, count(*) AS times, least(count(*), 5) AS weight FROM ge WHERE target IS NOT NULL AND target <> source GROUP BY ALL) "
)
_NODES = (
    ", inc AS (SELECT target AS path, CAST(sum(times) AS BIGINT) AS incoming FROM edges GROUP BY 1), ends AS (SELECT source AS path FROM edges UNION SELECT target FROM edges), "
    "lk AS (SELECT path, coalesce(incoming, 0) AS i FROM ends LEFT JOIN inc USING (path)), "
    "fil AS (SELECT path, 0 AS i FROM notes WHERE path NOT IN (SELECT path FROM ends) ORDER BY path LIMIT greatest(0, 200 - (SELECT count(*) FROM ends))), "
    f"nodes AS (SELECT path, {Q.title('path')} AS label, split_part(path, '/', 1) AS folder, CASE WHEN i > 0 THEN i ELSE 1 END AS value FROM (SELECT * FROM lk UNION ALL SELECT * FROM fil) ORDER BY i DESC, path LIMIT 220) "
)


def edges(spark, d):
    return LK.graph_edges(D.notes(spark, d))


@query("graph_edges", "OP-061 OP-030", _N + _EDGES + "SELECT source, target, times, weight FROM edges")
def _(spark, d):
    return edges(spark, d).select("source", "target", *big("times", "weight"))


@query("graph_nodes", "OP-062", _N + _EDGES + _NODES + "SELECT * FROM nodes")
def _(spark, d):
    return LK.graph_nodes(edges(spark, d), D.notes(spark, d))


@query(
    "graph_prune", "OP-063",
    _N + _EDGES + _NODES + "SELECT * FROM (SELECT source, target, times, weight FROM edges ORDER BY weight DESC, source, target LIMIT 800) WHERE source IN (SELECT path FROM nodes) AND target IN (SELECT path FROM nodes)",
)
def _(spark, d):
    e = edges(spark, d)
    return LK.graph_prune(e, LK.graph_nodes(e, D.notes(spark, d))).select("source", "target", *big("times", "weight"))


@query(
    "relations", "OP-064",
    _N + _EDGES + ", inn AS (SELECT target AS path, count(*) AS n_in, array_to_string(list_sort(list(source))[1:12], '|') AS first_in FROM edges GROUP BY 1), "
    "outt AS (SELECT source AS path, count(*) AS n_out, array_to_string(list_sort(list(target))[1:12], '|') AS first_out FROM edges GROUP BY 1) "
    f"SELECT path, {Q.title('path')} AS label, {Q.TOP} AS folder, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) >= 3 AS hub, coalesce(first_in, '') AS first_in, coalesce(first_out, '') AS first_out "
    "FROM notes LEFT JOIN inn USING (path) LEFT JOIN outt USING (path) WHERE coalesce(n_in, 0) >= 1",
)
def _(spark, d):
    n = D.notes(spark, d).selectExpr("path", "regexp_replace(regexp_extract(path, '([^/]*)$', 1), r'\\.md$', '') AS label")
    return LK.relations(n, edges(spark, d), min_in=1)


_CTX = (
    "list_filter(string_split(content, chr(10)), lambda l: contains(l, '[[' || nm || ']]') OR contains(l, '[[' || bs || ']]') OR contains(l, '[[' || nm || '|') OR contains(l, '[[' || bs || '|'))[1]"
)


@query(
    "backlinks", "OP-065",
    _N + f", wl AS (SELECT path AS source, content, mtime, unnest({Q.LINKS_WIKI}) AS link FROM notes), "
    "tg AS (SELECT path AS target, regexp_replace(path, '\\.md$', '') AS nm, regexp_extract(regexp_replace(path, '\\.md$', ''), '([^/]*)$', 1) AS bs FROM notes), "
    f"pr AS (SELECT DISTINCT target, source, mtime, {_CTX} AS line FROM tg JOIN wl ON link = nm OR link = bs) "
    f"SELECT target, source, {Q.title('source')} AS title, substr(trim(regexp_replace(regexp_replace(line, '\\[\\[([^\\]|]+?)\\|([^\\]]+)\\]\\]', '\\2', 'g'), '\\[\\[([^\\]|]+?)\\]\\]', '\\1', 'g'), e' \\t\\r'), 1, 200) AS context, mtime FROM pr WHERE line IS NOT NULL",
)
def _(spark, d):
    n = D.notes(spark, d)
    return LK.backlinks(n, n)


_ORPH = (
    f", wl AS (SELECT path AS source, unnest({Q.LINKS_WIKI}) AS link FROM notes), "
    "tg AS (SELECT path, regexp_replace(path, '\\.md$', '') AS nm FROM notes) "
)


@query(
    "orphans", "OP-068",
    _N + _ORPH + "SELECT path FROM tg WHERE path NOT IN (SELECT source FROM wl) AND NOT EXISTS (SELECT 1 FROM wl WHERE source <> path AND link IN (nm, regexp_extract(nm, '([^/]*)$', 1)))",
)
def _(spark, d):
    return LK.orphans(D.notes(spark, d))


@query("orphans_observed", "OP-068", _N + _ORPH + "SELECT path FROM tg WHERE NOT EXISTS (SELECT 1 FROM wl WHERE source <> path AND link = nm)")
def _(spark, d):
    return LK.orphans(D.notes(spark, d), observed=True)


# --- related notes ------------------------------------------------------------------
_TAGLIST = Q.QUICK_TAGS.split(", [regexp_extract")[0].replace("list_filter(list_transform(list_concat(", "list_filter(list_transform(", 1) + f", lambda x: {Q._STRIP}), lambda x: x <> '')"
# a header that is no YAML (every tenth note) gives no tags
_YAML_TAGS = f"(CASE WHEN doc_id % 10 <> 9 THEN {_TAGLIST} ELSE [] END)"
_MOC = (
    ", b AS (SELECT path, regexp_replace(lower(path), '\\.md$', '') AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, "
    f"list_transform({Q.LINKS_RENDER.replace('regexp_extract_all(content', 'regexp_extract_all(body')}, lambda l: regexp_replace(lower(l), '\\.md$', '')) AS links, {_YAML_TAGS} AS tags "
    "FROM (SELECT *, regexp_replace(content, '(?s)^---\\r?\\n.*?\\r?\\n---\\r?\\n?', '') AS body FROM notes)), "
    "bl AS (SELECT DISTINCT s.path AS other, t.path FROM (SELECT path, unnest(links) AS l FROM b) s JOIN b t ON l = t.name WHERE s.path <> t.path), "
    "tl AS (SELECT DISTINCT path, unnest(tags) AS tag FROM b), ll AS (SELECT DISTINCT path, unnest(links) AS l FROM b), "
    "al AS (SELECT 'backlink' AS kind, path, other FROM bl UNION ALL SELECT 'mutual', x.path, x.other FROM bl x JOIN bl y ON x.path = y.other AND x.other = y.path "
    "UNION ALL SELECT DISTINCT 'same-tag', x.path, y.path FROM tl x JOIN tl y USING (tag) WHERE x.path <> y.path "
    "UNION ALL SELECT 'parent', x.path, y.path FROM b x JOIN b y USING (folder) WHERE x.path <> y.path AND folder <> '' "
    "UNION ALL SELECT DISTINCT 'co_link', x.path, y.path FROM ll x JOIN ll y USING (l) WHERE x.path <> y.path), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY kind, path ORDER BY other) AS rank, count(*) OVER (PARTITION BY kind, path) AS total FROM al) "
    f"SELECT r.path, kind, rank, other, {Q.title('other')} AS title, CASE WHEN kind = 'same-tag' THEN list_filter(y.tags, lambda t: list_contains(x.tags, t))[1] END AS tag, total "
    "FROM r JOIN b x ON x.path = r.path JOIN b y ON y.path = other WHERE rank <= 20"
)


@query("note_moc", "OP-072", _N + _MOC)
def _(spark, d):
    return RL.note_moc(D.notes(spark, d)).select("path", "kind", "other", "title", "tag", *big("rank", "total"))


# --- tags and statistics ----------------------------------------------------------------
_TAGROWS = f", tr AS (SELECT path, unnest({Q.QUICK_TAGS}) AS tag FROM notes) "


@query("tag_index", "OP-066 OP-090", _N + _TAGROWS + "SELECT tag, count(*) AS count, min(path) AS first_path FROM tr GROUP BY tag")
def _(spark, d):
    return ST.tag_index(D.notes(spark, d))


@query("tag_paths", "OP-066", _N + _TAGROWS + "SELECT tag, path FROM tr")
def _(spark, d):
    return ST.note_tag_rows(D.notes(spark, d))


@query("list_tags", "OP-090", _N + _TAGROWS + "SELECT tag, count(*) AS count FROM tr GROUP BY tag ORDER BY count(*) DESC, min(path), tag LIMIT 20")
def _(spark, d):
    return ST.list_tags_top(D.notes(spark, d), 20)


@query(
    "find_by_tag", "OP-090",
    _N + _TAGROWS + ", q AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN '#' || source WHEN doc_id % 3 = 1 THEN lang ELSE 'none' || CAST(doc_id % 5 AS STRING) END AS tag FROM documents), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY path) AS rank, count(*) OVER (PARTITION BY tag) AS n FROM tr) "
    "SELECT q.tag, coalesce(n, 0) AS count, rank, path FROM q LEFT JOIN (SELECT * FROM r WHERE rank <= 30) r ON r.tag = ltrim(q.tag, '#')",
)
def _(spark, d):
    q = D.table(spark, d, "documents").selectExpr("CASE WHEN doc_id % 3 = 0 THEN '#' || source WHEN doc_id % 3 = 1 THEN lang ELSE 'none' || CAST(doc_id % 5 AS STRING) END AS tag").distinct()
    return ST.find_by_tag(D.notes(spark, d), q).select("tag", "count", *big("rank"), "path")


@query(
    "vault_stats", "OP-067",
    _N + _TAGROWS + f", f AS (SELECT DISTINCT unnest({Q.FOLDERS}) AS x FROM notes) "
    f"SELECT count(*) AS notes, CAST(sum(length(content)) AS BIGINT) AS chars, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes, CAST(sum(length({Q.LINKS_WIKI})) AS BIGINT) AS links, "
    "CAST(floor(avg(length(content)) + 0.5) AS BIGINT) AS avg_chars, max(length(content)) AS largest_chars, (SELECT path FROM notes ORDER BY length(content) DESC, path LIMIT 1) AS largest, "
    "(SELECT count(DISTINCT tag) FROM tr) AS tags, (SELECT count(*) FROM f) AS folders, (SELECT CAST(sum(length(string_split(text, chr(10)))) AS BIGINT) FROM documents) AS chunks FROM notes",
)
def _(spark, d):
    lines = D.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return ST.vault_stats(D.notes(spark, d), lines)


@query("recent_notes", "OP-069", _N + f" SELECT path, {Q.title('path')} AS title, mtime, length(content) AS size FROM notes ORDER BY mtime DESC, path LIMIT 20")
def _(spark, d):
    return ST.recent(D.notes(spark, d))


_TITLE_TERMS = (
    f"list_concat(list_filter(regexp_extract_all(lower({Q.title('path')}), '[a-z0-9_]+'), lambda t: length(t) >= 2 AND t NOT IN {Q.quoted(K.CONCEPT_LATIN_STOP)}), "
    f"list_filter(regexp_extract_all({Q.title('path')}, '[一-鿿]'), lambda t: t NOT IN {Q.quoted(K.CONCEPT_HAN_STOP)}))"
)
_CONCEPTS = (
    f", tt AS (SELECT path, unnest({_YAML_TAGS}) AS term, 2 AS w, 0 AS src FROM notes UNION ALL SELECT path, unnest({_TITLE_TERMS}), 1, 1 FROM notes), "
    "ok AS (SELECT * FROM tt WHERE src = 1 OR length(term) >= 2), "
    "top AS (SELECT term, sum(w) AS raw, min(src) AS ms, arg_min(path, (src, path)) AS fp FROM ok GROUP BY term ORDER BY raw DESC, ms, fp, term LIMIT 10), "
    "pl AS (SELECT term, path, min(src) AS s FROM ok WHERE term IN (SELECT term FROM top) GROUP BY ALL), "
    "fs AS (SELECT term, string_agg(path, '|' ORDER BY s, path) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY s, path) AS n FROM pl) WHERE n <= 3 GROUP BY term) "
)


@query(
    "concepts", "OP-070",
    _N + _CONCEPTS + "SELECT row_number() OVER (ORDER BY raw DESC, ms, fp, term) AS rank, term, round(CAST(raw AS DOUBLE) / (SELECT max(raw) FROM top), 6) AS weight, paths FROM top JOIN fs USING (term)",
)
def _(spark, d):
    return ST.concepts(D.notes(spark, d)).select(*big("rank"), "term", F.round("weight", 6).alias("weight"), F.array_join("paths", "|").alias("paths"))


@query(
    "auto_wiki", "OP-071",
    _N + f", ins AS (SELECT * FROM notes WHERE path LIKE 'inbox/%'), tr AS (SELECT path, unnest({Q.QUICK_TAGS}) AS tag FROM ins), "
    "tp AS (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(path), tag) AS rank FROM tr GROUP BY tag), "
    "tg AS (SELECT rank, tag, n, path, row_number() OVER (PARTITION BY tag ORDER BY path) AS pos FROM tr JOIN tp USING (tag) WHERE rank <= 8)"
    f", fo AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest({Q.FOLDERS}) AS x FROM ins)), "
    "ov AS (SELECT count(*) AS a, CAST(sum(length(content)) AS BIGINT) AS b, CAST(floor(sum(length(content)) / count(*) + 0.5) AS BIGINT) AS c, (SELECT n FROM fo) AS e FROM ins), "
    + _CONCEPTS.lstrip(", ").replace("FROM notes", "FROM ins").rstrip() + " "
    "SELECT 'overview' AS section, unnest(range(4)) AS pos, unnest(['notes', 'chars', 'avg_chars', 'folders']) AS name, unnest([a, b, c, e]) AS n FROM ov "
    "UNION ALL SELECT 'concept', row_number() OVER (ORDER BY raw DESC, ms, fp, term), term || ' ' || paths, CAST(round(raw * 1000000.0 / (SELECT max(raw) FROM top)) AS BIGINT) FROM top JOIN fs USING (term) "
    "UNION ALL SELECT 'tag', rank * 100 + pos, tag || ' ' || path, n FROM tg WHERE pos <= 20 "
    "UNION ALL SELECT 'timeline', row_number() OVER (ORDER BY mtime DESC, path), path, mtime FROM (SELECT * FROM ins ORDER BY mtime DESC, path LIMIT 15)",
)
def _(spark, d):
    from pyspark.sql import Window

    w = ST.auto_wiki(D.notes(spark, d), "inbox")
    names = ["notes", "chars", "avg_chars", "folders"]
    values = F.posexplode(F.array(*[F.struct(F.lit(x).alias("name"), C(x).cast("bigint").alias("n")) for x in names])).alias("pos", "v")
    over = w["overview"].select(F.lit("overview").alias("section"), values).select("section", C("pos").cast("bigint").alias("pos"), "v.name", "v.n")
    terms = w["concepts"].select(
        F.lit("concept").alias("section"), C("rank").cast("bigint").alias("pos"), F.concat("term", F.lit(" "), F.array_join("paths", "|")).alias("name"), F.round(C("weight") * 1000000).cast("bigint").alias("n")
    )
    tags = w["tags"].select(F.lit("tag").alias("section"), (C("rank") * 100 + C("pos")).cast("bigint").alias("pos"), F.concat("tag", F.lit(" "), "path").alias("name"), C("count").alias("n"))
    line = w["timeline"].select(
        F.lit("timeline").alias("section"), F.row_number().over(Window.orderBy(C("mtime").desc(), "path")).cast("bigint").alias("pos"), C("path").alias("name"), C("mtime").alias("n")
    )
    return over.unionByName(terms).unionByName(tags).unionByName(line)
