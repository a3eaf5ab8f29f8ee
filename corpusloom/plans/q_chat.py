"""Queries over chat, memory, history, agent traces, exports and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import agent as AG, chat as CH, export as EX, monitor as MO, stats as ST
from corpusloom.plans import derive as D, sqltext as Q
from corpusloom.plans.q_links import _CONCEPTS, big
from corpusloom.plans.registry import query

C = F.col
_N = D.with_tables("notes").rstrip()

# --- chat: a third of all messages is in one session ------------------------------
_CHAT_COLS = (
    "conv_id * 1000 + turn AS id, CASE WHEN conv_id % 3 = 0 THEN 'hot' ELSE CAST(conv_id AS STRING) END AS session_id, role, text AS content, "
    "CASE WHEN turn % 3 = 0 THEN '[{\"path\": \"p' || CAST(turn AS STRING) || '.md\", \"idx\": ' || CAST(conv_id AS STRING) || ', \"title\": \"old\"}]' "
    "WHEN turn % 3 = 1 THEN '{\"kb\": [{\"path\": \"a.md\", \"idx\": 1, \"title\": \"A\"}, {\"path\": \"b.md\", \"idx\": ' || CAST(turn AS STRING) || ', \"title\": \"B\"}], \"web\": [{\"title\": \"W\", \"url\": \"http://w/' || CAST(conv_id AS STRING) || '\"}]}' "
    "WHEN turn % 7 = 2 THEN '{broken' END AS citations, turn * 1000 + conv_id AS ts"
)
_CHAT = f"WITH chat AS (SELECT {_CHAT_COLS} FROM conversations)"
_CHAT_SPARK = [
    "conv_id * 1000 + turn AS id", "CASE WHEN conv_id % 3 = 0 THEN 'hot' ELSE CAST(conv_id AS STRING) END AS session_id", "role", "text AS content",
    _CHAT_COLS[_CHAT_COLS.index("CASE WHEN turn % 3") : _CHAT_COLS.rindex(", turn * 1000")], "turn * 1000 + conv_id AS ts",
]


def chat(spark, d):
    return D.table(spark, d, "conversations").selectExpr(*_CHAT_SPARK)


def _last(n: int, extra: str = "") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, id DESC) AS back FROM chat {extra} QUALIFY back <= {n}"


@query("trim_sessions", "OP-081", f"{_CHAT} SELECT id, session_id, ts FROM ({_last(20)})")
def _(spark, d):
    return CH.trim_sessions(chat(spark, d), 20).select("id", "session_id", "ts")


_HIST = (
    "SELECT 'f' || CAST(user_id AS STRING) AS id, CASE WHEN event_type = 'view' THEN 'note' ELSE 'local' END AS type, event_type AS name, 'p/' || CAST(user_id AS STRING) AS path, "
    "'md' AS ext, CAST(floor(value * 20000) AS BIGINT) AS size, event_id AS opened_at, props AS body FROM events"
)


def history(spark, d):
    e = D.table(spark, d, "events").selectExpr(*_cols(_HIST))
    h = e.withColumn("bytes", F.encode("body", "UTF-8")).withColumn("mime_type", F.lit("text/markdown")).drop("body")
    return h.where("opened_at % 2 = 0"), h.where("opened_at % 2 = 1")


def _cols(select: str) -> list[str]:
    from corpusloom.plans.q_sync import _split_cols

    return _split_cols(select)


_MERGED = (
    f"WITH h AS ({_HIST}), m AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY opened_at % 2 DESC, opened_at DESC) = 1), "
    "t AS (SELECT *, CASE WHEN size <= 524288 THEN body END AS kept FROM m ORDER BY opened_at DESC, id LIMIT 30) "
)


@query("trim_history", "OP-082 OP-053", _MERGED + "SELECT id, type, name, size, opened_at, kept AS body FROM t")
def _(spark, d):
    h = CH.trim_history(*history(spark, d))
    return h.select("id", "type", "name", "size", "opened_at", F.decode("bytes", "UTF-8").alias("body"))


@query("recent_opens", "OP-091", _MERGED + "SELECT id, type, name, path, ext, size, opened_at FROM t ORDER BY opened_at DESC, id LIMIT 20")
def _(spark, d):
    return CH.recent_opens(CH.trim_history(*history(spark, d)))


_PW = f"w AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, id) AS pos FROM ({_last(16, chr(87) + 'HERE role <> ' + chr(39) + 'system' + chr(39))}))"


@query("prompt_window", "OP-083", f"{_CHAT}, {_PW} SELECT session_id, pos, role, content FROM w")
def _(spark, d):
    return CH.prompt_window(chat(spark, d)).select("session_id", *big("pos"), "role", "content")


@query(
    "memory_window", "OP-083",
    f"{_CHAT}, w AS ({_last(6, chr(87) + 'HERE role <> ' + chr(39) + 'system' + chr(39))}) SELECT session_id, string_agg(role || ': ' || substr(content, 1, 500), chr(10) || chr(10) ORDER BY ts, id) AS text FROM w GROUP BY 1 HAVING count(*) >= 2",
)
def _(spark, d):
    return CH.memory_window(chat(spark, d))


_TITLE = "substr(trim(regexp_extract(q, '^[^。\n!?？]*'), e' \\t\\r\\n'), 1, 12)"
_SESS = (
    ", s AS (SELECT session_id, count(*) AS messages, min(ts) AS created_at, max(ts) AS updated_at, arg_min(content, ts * 1000000 + id) FILTER (WHERE role = 'user') AS q FROM chat GROUP BY 1), "
    f"ss AS (SELECT session_id, CASE WHEN q IS NULL OR {_TITLE} = '' THEN '新对话' ELSE {_TITLE} END AS title, messages, created_at, updated_at FROM s)"
)


@query("session_summary", "OP-084 OP-031", f"{_CHAT}{_SESS} SELECT * FROM ss")
def _(spark, d):
    return CH.session_summary(chat(spark, d))


@query(
    "parse_citations", "OP-085",
    f"{_CHAT}, o AS (SELECT id, 'kb' AS kind, 0 AS pos, 'old' AS title, 'p' || CAST(id % 1000 AS STRING) || '.md' AS path, id // 1000 AS idx, NULL AS url FROM chat WHERE id % 1000 % 3 = 0), "
    "n AS (SELECT id FROM chat WHERE id % 1000 % 3 = 1) "
    "SELECT id, kind, CAST(pos AS BIGINT) AS pos, title, path, CAST(idx AS BIGINT) AS idx, CAST(url AS VARCHAR) AS url FROM (SELECT * FROM o UNION ALL SELECT id, 'kb', 0, 'A', 'a.md', 1, NULL FROM n UNION ALL SELECT id, 'kb', 1, 'B', 'b.md', id % 1000, NULL FROM n "
    "UNION ALL SELECT id, 'web', 0, 'W', NULL, NULL, 'http://w/' || CAST(id // 1000 AS STRING) FROM n)",
)
def _(spark, d):
    return CH.parse_citations(chat(spark, d)).select("id", "kind", *big("pos"), "title", "path", *big("idx"), "url")


# --- memory: replies derived from messages ----------------------------------------
_WORDS = "regexp_replace({c}, '[^a-zA-Z ]', ''{g})"
_ITEM = "'{{\"kind\": ' || CASE WHEN turn % 2 = 0 THEN '\"pref\"' ELSE 'null' END || ', \"content\": \"' || {w} || '\"}}'"


def _reply_sql(g: str) -> str:
    w = _WORDS.format(c="text", g=g)
    item = _ITEM.format(w=w)
    topic = (
        "'{\"title\": \"' || CASE WHEN turn % 5 = 4 THEN '' ELSE 'T ' || " + w + " END || '\", \"summary\": \"S' || CAST(conv_id AS STRING) || '\", \"items\": [' || "
        + item + " || ', {\"content\": \"\"}, ' || " + item + " || ']}'"
    )
    return (
        f"CASE WHEN turn % 4 = 3 THEN text ELSE 'ok ```json' || chr(10) || '{{\"topics\": [' || {topic} || ', {{\"title\": \"empty\", \"items\": []}}, ' || {topic} || ', ' || {topic} || ']}}' || chr(10) || '```' END"
    )


def _replies(spark, d):
    return D.table(spark, d, "conversations").selectExpr("CAST(conv_id AS STRING) AS session_id", "conv_id * 1000 + turn AS ts", f"{_reply_sql('')} AS reply")


_MEM = f"WITH c AS (SELECT CAST(conv_id AS STRING) AS session_id, conv_id, turn, conv_id * 1000 + turn AS ts, {_WORDS.format(c='text', g=chr(44) + ' ' + chr(39) + 'g' + chr(39))} AS w FROM conversations WHERE turn % 4 <> 3), k AS (SELECT unnest([0, 2]) AS n), "
_MEM += (
    "tp AS (SELECT sha1(session_id || '|' || CAST(ts AS STRING) || '|' || CAST(n AS STRING)) AS id, trim(substr('T ' || w, 1, 80)) AS title, 'S' || CAST(conv_id AS STRING) AS summary, ts, session_id, turn, w FROM c, k WHERE turn % 5 <> 4 AND w <> ''), "
    "it AS (SELECT id AS topic_id, p AS pos, CASE WHEN turn % 2 = 0 THEN 'pref' ELSE 'fact' END AS kind, substr(w, 1, 200) AS content, session_id AS source, ts FROM tp, (SELECT unnest([0, 1]) AS p)) "
)


@query("memory_topics", "OP-086 OP-034", _MEM + "SELECT id, title, summary, ts AS created_at, ts AS last_used, session_id, 'active' AS status FROM tp")
def _(spark, d):
    return CH.memory_from_replies(_replies(spark, d))[0]


@query("memory_items", "OP-086", _MEM + "SELECT topic_id, CAST(pos AS BIGINT) AS pos, kind, content, source, ts FROM it")
def _(spark, d):
    return CH.memory_from_replies(_replies(spark, d))[1].select("topic_id", *big("pos"), "kind", "content", "source", "ts")


def memory(spark, d):
    topics, items = CH.memory_from_replies(_replies(spark, d))
    topics = topics.withColumn("status", F.when(C("last_used") % 5 == 0, "archived").otherwise("active"))
    return topics, items.withColumn("id", C("pos").cast("bigint"))


@query(
    "memory_context", "OP-087",
    _MEM + ", t10 AS (SELECT * FROM tp WHERE ts % 5 <> 0 ORDER BY ts DESC, id LIMIT 10), "
    "l AS (SELECT t10.id, t10.ts, '### ' || title || chr(10) || summary || chr(10) || string_agg('- [' || kind || '] ' || content, chr(10) ORDER BY pos) || chr(10) AS b FROM t10 JOIN it ON topic_id = t10.id GROUP BY ALL, t10.title, t10.summary) "
    "SELECT '## 长期记忆' || chr(10) || string_agg(b, chr(10) ORDER BY ts DESC, id) AS text FROM l".replace("GROUP BY ALL, t10.title, t10.summary", "GROUP BY t10.id, t10.ts, title, summary"),
)
def _(spark, d):
    return CH.memory_context(*memory(spark, d))


@query(
    "export_memory", "OP-099",
    _MEM + "SELECT id AS topic_id, CAST(-1 AS BIGINT) AS ts, CAST(-1 AS BIGINT) AS id, '## ' || title || chr(10) || '*' || summary || '*' || chr(10) AS text FROM tp "
    "UNION ALL SELECT topic_id, ts, pos, '- **' || kind || '**: ' || content || ' _(source: ' || source || ')_' FROM it",
)
def _(spark, d):
    return EX.export_memory(*memory(spark, d))


# --- agent ---------------------------------------------------------------------------
@query("list_files", "OP-088", _N + " SELECT path FROM notes WHERE path LIKE 'inbox/%' ORDER BY path LIMIT 20")
def _(spark, d):
    return AG.list_files(D.notes(spark, d), "inbox")


_ASK = "CASE WHEN doc_id % 9 = 0 THEN 'none/' || path ELSE path END"


@query(
    "note_head", "OP-088",
    _N + f", a AS (SELECT DISTINCT {_ASK} AS path FROM notes) SELECT a.path, {Q.title('a.path')} AS title, length(content) AS size, substr(content, 1, 4000) AS content, length(content) > 4000 AS truncated, content IS NULL AS missing FROM a LEFT JOIN notes USING (path)",
)
def _(spark, d):
    n = D.notes(spark, d)
    return AG.note_head(n.selectExpr(f"{_ASK} AS path"), n)


_LINES = f"lc AS (SELECT {D.path_sql('doc_id')} AS path, unnest(range(0, length(string_split(text, chr(10))))) AS idx, source AS heading, unnest(string_split(text, chr(10))) AS content FROM documents)"


@query(
    "get_chunks", "OP-089",
    f"WITH {_LINES}, a AS (SELECT {D.path_sql('doc_id')} AS path, doc_id % 5 AS idx FROM documents) SELECT path, CAST(idx AS BIGINT) AS idx, heading, content, md5(content) AS hash, content IS NULL AS missing FROM a LEFT JOIN lc USING (path, idx)",
)
def _(spark, d):
    docs = D.derived(spark, d, "documents", f"{D.path_sql('doc_id')} AS path", "source AS heading", "text", "doc_id")
    lines = docs.select("path", "heading", F.posexplode(F.split("text", "\n")).alias("idx", "content")).withColumn("hash", F.md5("content"))
    return AG.get_chunks(docs.selectExpr("path", "CAST(doc_id % 5 AS INT) AS idx"), lines).select("path", *big("idx"), "heading", "content", "hash", "missing")


_TEXT = (
    "CASE turn % 5 WHEN 0 THEN role || ' <tool_call>{\"name\": \"kb_search\", \"args\": {\"query\": \"q' || CAST(conv_id AS STRING) || '\"}}</tool_call> tail' "
    "WHEN 1 THEN 'think' || chr(10) || '```tool_call' || chr(10) || '{\"tool\": \"note_open\", \"input\": {\"path\": \"p\"}}' || chr(10) || '```' "
    "WHEN 2 THEN '<tool_call>{\"function\": \"list_tags\"}</tool_call>' WHEN 3 THEN '<tool_call>{broken</tool_call>' ELSE text END"
)


@query(
    "parse_tool_calls", "OP-093",
    "SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN role WHEN 1 THEN 'think' ELSE '' END AS thought, CASE turn % 5 WHEN 0 THEN 'kb_search' WHEN 1 THEN 'note_open' ELSE 'list_tags' END AS tool, "
    "CASE turn % 5 WHEN 0 THEN '{\"query\":\"q' || CAST(conv_id AS STRING) || '\"}' WHEN 1 THEN '{\"path\":\"p\"}' ELSE '{}' END AS args FROM conversations WHERE turn % 5 < 3",
)
def _(spark, d):
    t = D.table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{_TEXT} AS text")
    return AG.parse_tool_calls(t)


# calls: one session per user; a third of all calls is one session
_CALLS = (
    "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY event_id) AS step, tool, args FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS STRING) END AS session_id, "
    "CASE event_type WHEN 'view' THEN 'note_open' WHEN 'click' THEN 'kb_search' WHEN 'error' THEN 'rm_rf' WHEN 'signup' THEN 'note_edit' ELSE 'web_search' END AS tool, CAST(CAST(floor(value / 5) AS BIGINT) % 3 AS STRING) AS args FROM {t})"
)


def calls(spark, d):
    return spark.sql(_CALLS.replace("{t}", "{events}"), events=D.table(spark, d, "events"))


_AUDIT = f"WITH c AS ({_CALLS.format(t='events')}), a AS (SELECT *, coalesce(tool = lag(tool) OVER w AND args = lag(args) OVER w, false) AS stuck FROM c WINDOW w AS (PARTITION BY session_id ORDER BY step)) "
_ENABLED = ["kb_search", "note_open", "web_search"]


@query(
    "trace_audit", "OP-094",
    _AUDIT + "SELECT session_id, step, tool, args, stuck, step > 18 AS over, tool <> 'rm_rf' AS known, tool IN ('kb_search', 'note_open', 'web_search') AS enabled FROM a",
)
def _(spark, d):
    return AG.trace_audit(calls(spark, d), _ENABLED).withColumn("step", C("step").cast("bigint"))


@query(
    "trace_outcomes", "OP-094",
    _AUDIT + ", e AS (SELECT session_id, min(CASE WHEN stuck THEN step END) AS s, max(step) AS m FROM a GROUP BY 1), "
    "o AS (SELECT session_id, CASE WHEN s <= 18 THEN s ELSE least(m, 18) END AS steps, CASE WHEN s <= 18 THEN 'stuck' WHEN m >= 18 THEN 'step limit' ELSE 'finished' END AS outcome FROM e) "
    "SELECT session_id, outcome, steps, (SELECT count(*) FROM a WHERE a.session_id = o.session_id AND a.step <= o.steps AND tool NOT IN ('kb_search', 'note_open', 'web_search')) AS refused FROM o",
)
def _(spark, d):
    return AG.trace_outcomes(AG.trace_audit(calls(spark, d), _ENABLED)).withColumn("steps", C("steps").cast("bigint"))


# --- exports ----------------------------------------------------------------------------
@query(
    "export_conversations", "OP-095",
    f"{_CHAT}{_SESS} SELECT session_id, CAST(-1 AS BIGINT) AS ts, CAST(-1 AS BIGINT) AS id, '# 💬 ' || title || chr(10) || chr(10) || '> ' || CAST(messages AS STRING) || ' 条消息' || chr(10) || chr(10) || '---' || chr(10) AS text FROM ss "
    "UNION ALL SELECT session_id, ts, id, '## ' || CASE role WHEN 'user' THEN '👤 User' WHEN 'assistant' THEN '🤖 Assistant' ELSE '⚙️ System' END || chr(10) || chr(10) || content || chr(10) FROM chat",
)
def _(spark, d):
    return EX.export_conversations(chat(spark, d))


def _kb(n: str) -> str:
    return f"printf('%.1f', floor({n} / 1024.0 * 10 + 0.5) / 10)"


@query(
    "export_book", "OP-096",
    _N + ", b AS (SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '(root)' END AS folder, path, content FROM notes) "
    "SELECT folder, path, md5(text) AS digest FROM (SELECT '' AS folder, '' AS path, '# 📖 小书:(whole vault)' || chr(10) || chr(10) || '> ' || CAST(count(*) AS STRING) || ' 篇笔记' || chr(10) || chr(10) || '---' || chr(10) AS text FROM b "
    "UNION ALL SELECT DISTINCT folder, '', '# 📁 ' || folder || chr(10) FROM b UNION ALL SELECT folder, path, "
    f"'## ' || {Q.title('path')} || chr(10) || chr(10) || '> 来源: [[' || path || ']] · ' || {_kb('length(content)')} || ' KB' || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10) FROM b)",
)
def _(spark, d):
    return EX.export_book(D.notes(spark, d)).select("folder", "path", F.md5("text").alias("digest"))


@query(
    "export_jsonld", "OP-098",
    _N + f", l AS (SELECT path, content, mtime, list_transform({Q.LINKS_GRAPH}, lambda x: 'vault:///' || x) AS r FROM notes) "
    f", j AS (SELECT path, CAST(json_object('@id', 'vault:///' || path, '@type', 'schema:Article', 'path', 'vault:///' || path, 'title', {Q.title('path')}, 'mtime', strftime(make_timestamp(mtime * 1000), '%Y-%m-%dT%H:%M:%S') || '.000Z', "
    "'references', list_filter(r, lambda x, i: list_position(r, x) = i), 'size', length(content)) AS VARCHAR) AS text FROM l) "
    "SELECT CAST(0 AS BIGINT) AS part, '' AS path, '{\"@context\": ' || " + "'" + EX.JSONLD_CONTEXT + "'" + " || ', \"@graph\": [' || chr(10) AS text "
    "UNION ALL SELECT 1, path, CASE WHEN path = (SELECT min(path) FROM j) THEN '' ELSE ',' || chr(10) END || text FROM j UNION ALL SELECT 2, '', chr(10) || ']}'",
)
def _(spark, d):
    return EX.export_jsonld(D.notes(spark, d)).select(*big("part"), "path", "text")


_BAR = "CAST(floor(raw * 10.0 / (SELECT max(raw) FROM top) + 0.5) AS BIGINT)"
_WIKI = (
    _N + _CONCEPTS.rstrip() + f", tr AS (SELECT path, unnest({Q.QUICK_TAGS}) AS tag FROM notes), "
    "tp AS (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(path), tag) AS rank FROM tr GROUP BY tag), "
    "tg AS (SELECT * FROM (SELECT rank, tag, n, path, row_number() OVER (PARTITION BY tag ORDER BY path) AS pos FROM tr JOIN tp USING (tag) WHERE rank <= 8) WHERE pos <= 20), "
    f"tl AS (SELECT path, {Q.title('path')} AS title, mtime FROM notes ORDER BY mtime DESC, path LIMIT 15), "
    f"fo AS (SELECT count(DISTINCT x) AS n FROM (SELECT unnest({Q.FOLDERS}) AS x FROM notes)), "
    "ov AS (SELECT '# (whole vault) Wiki' || chr(10) || chr(10) || '## 📌 概览' || chr(10) || chr(10) || '共 ' || count(*) || ' 篇笔记 · 总大小 ' || printf('%.1f', sum(length(content)) / 1024.0) "
    "|| ' KB · 平均 ' || CAST(floor(sum(length(content)) / count(*) + 0.5) AS BIGINT) || ' 字/篇 · 分布在 ' || (SELECT n FROM fo) || ' 个子目录' || chr(10) AS t FROM notes), "
    f"c AS (SELECT string_agg('- `' || term || '` ' || repeat('█', {_BAR}) || repeat('░', 10 - {_BAR}) || ' (' || length(string_split(paths, '|')) || ' 篇)', chr(10) ORDER BY raw DESC, ms, fp, term) AS t FROM top JOIN fs USING (term)), "
    "g AS (SELECT string_agg(CASE WHEN pos = 1 THEN '### #' || tag || ' (' || n || ')' || chr(10) ELSE '' END || '- [[' || path || ']]' || CASE WHEN pos = least(n, 20) THEN chr(10) || CASE WHEN n > 20 THEN '- ... +' || (n - 20) || ' 篇' || chr(10) ELSE '' END ELSE '' END, chr(10) ORDER BY rank, pos) AS t FROM tg), "
    "l AS (SELECT string_agg('- ' || strftime(make_timestamp(mtime * 1000), '%Y/%-m/%-d') || ' [[' || path || '|' || title || ']]', chr(10) ORDER BY mtime DESC, path) AS t FROM tl) "
    "SELECT array_to_string([ov.t, '## 🔑 关键概念' || chr(10) || chr(10) || c.t || chr(10), '## 🗂 MOC 索引' || chr(10) || chr(10) || g.t || chr(10), '## 📅 时间线' || chr(10) || chr(10) || l.t || chr(10)], chr(10)) AS text FROM ov, c, g, l"
)


@query("render_wiki", "OP-097 OP-071", _WIKI)
def _(spark, d):
    return EX.render_wiki(ST.auto_wiki(D.notes(spark, d)))


@query(
    "wiki_concept_lines", "OP-097 OP-070",
    _N + _CONCEPTS + "SELECT '- `' || term || '` ' || repeat('█', CAST(floor(raw * 10.0 / (SELECT max(raw) FROM top) + 0.5) AS BIGINT)) || repeat('░', 10 - CAST(floor(raw * 10.0 / (SELECT max(raw) FROM top) + 0.5) AS BIGINT)) "
    "|| ' (' || CAST(length(string_split(paths, '|')) AS STRING) || ' 篇)' AS line FROM top JOIN fs USING (term)",
)
def _(spark, d):
    text = EX.render_wiki(ST.auto_wiki(D.notes(spark, d)))
    return text.select(F.explode(F.split("text", "\n")).alias("line")).where(C("line").rlike("^- `"))


# --- monitoring: events as runs; user is the task, an error is a failed run ------------
_EXIT = "CASE WHEN event_type = 'error' OR user_id % 10 = 3 AND event_type <> 'view' THEN 1 + event_id % 2 ELSE 0 END"
MILLIS = "unix_millis(from_utc_timestamp(CAST(ts AS TIMESTAMP), current_timezone()))"  # times without zone, read as UTC
_LOG = (
    "CASE WHEN event_id % 4 = 3 THEN 'noise line' WHEN event_id % 4 = 2 THEN '[' || {s} || '] [' || CASE WHEN event_id % 3 = 0 THEN 'WARN' ELSE 'INFO' END || '] ' || event_type || ' seen' "
    "ELSE '[' || {s} || '] ===== end (exit=' || CAST(" + _EXIT + " AS STRING) || ') =====' END"
)


def log(spark, d):
    e = D.table(spark, d, "events").selectExpr("event_id AS line_no", _LOG.format(s="date_format(ts, 'yyyy/MM/dd HH:mm:ss')") + " AS value")
    return MO.parse_sync_log(e)


@query(
    "parse_sync_log", "OP-100",
    f"SELECT event_id AS line_no, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS ts_ms, CASE WHEN event_id % 4 = 2 THEN 'report' ELSE 'end' END AS kind, CASE WHEN event_id % 4 <> 2 THEN CAST({_EXIT} AS BIGINT) END AS exit, "
    "CASE WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 3 = 0 THEN 'WARN' ELSE 'INFO' END END AS level, CASE WHEN event_id % 4 = 2 THEN event_type || ' seen' END AS message FROM events WHERE event_id % 4 <> 3",
)
def _(spark, d):
    return log(spark, d).select("line_no", F.unix_millis(F.from_utc_timestamp("ts", F.current_timezone())).alias("ts_ms"), "kind", *big("exit"), "level", "message")


@query(
    "run_health", "OP-101",
    f"WITH r AS (SELECT {_EXIT} <> 0 AS bad FROM events WHERE event_id % 4 < 2 ORDER BY event_id DESC LIMIT 12), p AS (SELECT event_id % 3 = 0 AS bad FROM events WHERE event_id % 4 = 2 ORDER BY event_id DESC LIMIT 4) "
    "SELECT 'runs' AS \"check\", CASE WHEN count_if(bad) > 0 THEN 'FAIL' ELSE 'OK' END AS status, count(*) AS checked, count_if(bad) AS failed FROM r "
    "UNION ALL SELECT 'reports', CASE WHEN count_if(bad) > 0 THEN 'FAIL' ELSE 'OK' END, count(*), count_if(bad) FROM p",
)
def _(spark, d):
    return MO.run_health(log(spark, d))


@query(
    "manifest_health", "OP-102",
    "WITH m AS (SELECT source AS name, max(doc_id) * 60000 AS upd, count(*) AS n, count(*) - max(doc_id) % 7 + 1 AS o FROM documents GROUP BY source), w AS (SELECT max(doc_id) * 60000 AS now FROM documents), "
    "j AS (SELECT name, CAST(floor((now - upd) / 60000) AS BIGINT) AS age, n - o AS diff FROM m, w) "
    "SELECT name, age AS age_min, diff, CASE WHEN age > 30 THEN 'WARN' ELSE 'OK' END AS freshness, CASE WHEN diff = 0 THEN 'OK' WHEN abs(diff) <= 3 THEN 'WARN' ELSE 'FAIL' END AS completeness, "
    "CASE WHEN abs(diff) > 3 THEN 'FAIL' WHEN diff <> 0 OR age > 30 THEN 'WARN' ELSE 'OK' END AS overall FROM j",
)
def _(spark, d):
    docs = D.table(spark, d, "documents")
    m = docs.groupBy("source").agg(F.max("doc_id").alias("x"), F.count("*").alias("entries"))
    now = docs.agg((F.max("doc_id") * 60000).alias("now_ms")).withColumn("_one", F.lit(1))
    meta = m.selectExpr("source AS name", "x * 60000 AS updated_ms", "entries", "entries - x % 7 + 1 AS objects", "1 AS _one").join(now, "_one").drop("_one")
    return MO.manifest_health(meta)


@query(
    "idle_level", "OP-103",
    "WITH t AS (SELECT user_id, CASE WHEN user_id % 20 <> 7 THEN CAST(epoch_us(max(ts)) // 1000 AS BIGINT) END AS last FROM events GROUP BY 1) "
    "SELECT CAST(user_id AS STRING) AS task, round((1706745600000 - last) / 60000.0, 1) AS idle_min, CASE WHEN last IS NULL THEN 'WARN' WHEN (1706745600000 - last) / 60000.0 > 45 THEN 'ERROR' WHEN (1706745600000 - last) / 60000.0 > 20 THEN 'WARN' ELSE 'INFO' END AS level FROM t",
)
def _(spark, d):
    t = D.table(spark, d, "events").groupBy("user_id").agg(F.max(F.expr(MILLIS)).alias("last")).selectExpr(
        "CAST(user_id AS STRING) AS task", "CASE WHEN user_id % 20 <> 7 THEN last END AS last_run_ms"
    )
    return MO.idle_level(t, F.lit(1706745600000))


_RUNS = f"SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS STRING) END AS task, event_id AS run_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, {_EXIT} AS exit FROM events"


def runs(spark, d):
    return D.table(spark, d, "events").selectExpr(
        "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS STRING) END AS task", "event_id AS run_id", f"{MILLIS} AS ts_ms", f"CAST({_EXIT} AS INT) AS exit"
    )


@query(
    "failure_counts", "OP-104",
    f"WITH r AS ({_RUNS}), s AS (SELECT *, coalesce(sum(CASE WHEN exit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY ts_ms, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM r) "
    "SELECT task, run_id, CAST(streak AS BIGINT) AS streak, CAST(CASE WHEN exit = 0 THEN 0 ELSE row_number() OVER (PARTITION BY task, streak ORDER BY ts_ms, run_id) END AS BIGINT) AS fails FROM s",
)
def _(spark, d):
    return MO.failure_counts(runs(spark, d)).select("task", "run_id", "streak", "fails")


_ALERTS = (
    f"WITH RECURSIVE r AS ({_RUNS}), s AS (SELECT *, coalesce(sum(CASE WHEN exit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY task ORDER BY ts_ms, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS streak FROM r), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY task, streak ORDER BY ts_ms, run_id) AS pos FROM s), "
    "al AS (SELECT task, streak, run_id, ts_ms, pos, 'alert' AS event FROM n WHERE exit <> 0 AND pos = 3 UNION ALL "
    "SELECT task, streak, run_id, ts_ms, pos, 'repeat' FROM (SELECT x.task, x.streak, x.run_id, x.ts_ms, x.pos, row_number() OVER (PARTITION BY a.task, a.streak, a.run_id ORDER BY x.pos) AS k FROM al a JOIN n x "
    "ON x.task = a.task AND x.streak = a.streak AND x.exit <> 0 AND x.pos > a.pos AND x.ts_ms - a.ts_ms > 21600000) WHERE k = 1) "
    "SELECT task, run_id, ts_ms, event, pos AS fails FROM al UNION ALL SELECT task, run_id, ts_ms, 'recovery', pos - 1 FROM n WHERE exit = 0 AND pos > 3"
)


@query("alert_events", "OP-104", _ALERTS)
def _(spark, d):
    return MO.alert_events(runs(spark, d))
