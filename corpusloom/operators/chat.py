"""Chat sessions, opening history and long-term memory.

chat is (id, session_id, role, content, citations, ts); history is (id, type, name,
path, ext, size, opened_at, bytes, mime_type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import top_per_key
from corpusloom.operators.sync import upsert



def _newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("id").desc()]


def trim_sessions(chat: DataFrame, keep: int = K.CHAT_KEEP) -> DataFrame:
    return top_per_key(chat, ["session_id"], _newest(), keep, "_rn").drop("_rn")


def trim_history(history: DataFrame, opened: DataFrame, keep: int = K.HISTORY_KEEP) -> DataFrame:
    """History after these openings: one row per id, the newest kept; contents of large
    files are dropped, their row stays."""
    merged = upsert(history, opened, ["id"], "opened_at")
    small = F.when(F.col("size") <= K.SNAPSHOT_MAX_BYTES, F.col("bytes"))
    return merged.withColumn("bytes", small).orderBy(F.col("opened_at").desc(), "id").limit(keep)


def recent_opens(history: DataFrame, limit: int = 20) -> DataFrame:
    return history.orderBy(F.col("opened_at").desc(), "id").limit(limit).select("id", "type", "name", "path", "ext", "size", "opened_at")


def prompt_window(chat: DataFrame, n: int = K.PROMPT_TURNS) -> DataFrame:
    """(session_id, pos, role, content): the last n messages, system ones left out, oldest first."""
    talk = chat.where(F.col("role") != "system")
    last = top_per_key(talk, ["session_id"], _newest(), n, "_back")
    size = last.groupBy("session_id").agg(F.count("*").cast("int").alias("_n"))
    return last.join(size, "session_id").select("session_id", (F.col("_n") - F.col("_back") + 1).alias("pos"), "role", "content")


def memory_window(chat: DataFrame) -> DataFrame:
    """(session_id, text): the last messages as `role: text`, for sessions with at least two."""
    w = prompt_window(chat, K.MEMORY_TURNS)
    line = F.concat("role", F.lit(": "), F.substring("content", 1, K.MEMORY_TURN_CHARS))
    rows = w.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("r"))
    return rows.where(F.size("r") >= K.MEMORY_MIN_TURNS).select("session_id", F.array_join(F.col("r.l"), "\n\n").alias("text"))


def session_summary(chat: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, title, messages, created_at, updated_at), newest first. The title is the
    stored one or comes from the first question; messages without a session belong to
    `default`."""
    c = chat.withColumn("session_id", F.coalesce("session_id", F.lit("default")))
    first = F.struct("ts", "id")
    asked = F.when(F.col("role") == "user", first)
    out = c.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        X.session_title(F.min_by("content", asked)).alias("_title"),
    )
    fallback = F.when(F.col("session_id") == "default", "历史对话").otherwise("新对话")
    if sessions is not None:
        out = out.join(sessions.select("session_id", F.col("title").alias("_stored")), "session_id", "left")
    else:
        out = out.withColumn("_stored", F.lit(None).cast("string"))
    return out.select(
        "session_id", F.coalesce("_stored", "_title", fallback).alias("title"), "messages", "created_at", "updated_at"
    ).orderBy(F.col("updated_at").desc(), "session_id")


_HIT = "struct<path:string,idx:int,heading:string,title:string,snippet:string,score:double,mtime:bigint>"
_WEB = "struct<title:string,url:string,content:string>"


def parse_citations(chat: DataFrame) -> DataFrame:
    """(id, kind, pos, title, path, idx, url): citations of messages, from a bare array of
    notes (the older form) or from `{kb, web}`. Broken JSON gives no rows."""
    old = F.from_json("citations", f"array<{_HIT}>")
    new = F.from_json("citations", f"struct<kb:array<{_HIT}>,web:array<{_WEB}>>")
    is_array = F.ltrim("citations").startswith("[")
    j = chat.where(F.col("citations").isNotNull()).select("id", F.when(is_array, old).alias("o"), F.when(~is_array, new).alias("n"))
    kb = j.select("id", F.posexplode(F.coalesce("o", "n.kb")).alias("pos", "x")).select(
        "id", F.lit("kb").alias("kind"), "pos", "x.title", "x.path", "x.idx", F.lit(None).cast("string").alias("url")
    )
    web = j.select("id", F.posexplode("n.web").alias("pos", "x")).select(
        "id", F.lit("web").alias("kind"), "pos", "x.title", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("idx"), "x.url"
    )
    return kb.unionByName(web)


# --- memory -----------------------------------------------------------------------
_MEMORY = "struct<topics:array<struct<title:string,summary:string,items:array<struct<kind:string,content:string>>>>>"


def memory_from_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memory topics and items found in model replies (session_id, reply, ts). Of at most
    three topics those with a title and an item with content are kept, six items each."""
    j = replies.select("session_id", "ts", F.from_json(X.json_payload(F.col("reply")), _MEMORY).alias("j"))
    t = j.select("session_id", "ts", F.posexplode(F.slice("j.topics", 1, K.MEMORY_TOPICS)).alias("topic_no", "t"))
    items = F.slice(F.filter("t.items", lambda x: F.length(x["content"]) > 0), 1, K.MEMORY_ITEMS)
    t = t.where(F.length("t.title") > 0).withColumn("items", items).where(F.size("items") > 0)
    t = t.withColumn("topic_id", F.sha1(F.concat_ws("|", F.coalesce("session_id", F.lit("")), F.col("ts").cast("string"), F.col("topic_no").cast("string"))))
    cut = lambda c, n: X.uni_trim(F.substring(F.coalesce(c, F.lit("")), 1, n))
    topics = t.select(
        F.col("topic_id").alias("id"), cut(F.col("t.title"), K.TOPIC_TITLE).alias("title"), cut(F.col("t.summary"), K.TOPIC_SUMMARY).alias("summary"),
        F.col("ts").alias("created_at"), F.col("ts").alias("last_used"), "session_id", F.lit("active").alias("status"),
    )
    rows = t.select("topic_id", "ts", "session_id", F.posexplode("items").alias("pos", "x")).select(
        "topic_id", "pos", F.when(F.length("x.kind") > 0, F.col("x.kind")).otherwise("fact").alias("kind"),
        F.substring("x.content", 1, K.ITEM_CONTENT).alias("content"), F.col("session_id").alias("source"), "ts",
    )
    return topics, rows


def memory_context(topics: DataFrame, items: DataFrame) -> DataFrame:
    """One row: the latest active topics with their oldest items as Markdown. `items` is
    (id, topic_id, kind, content, source, ts). Forty items at most reach the last step."""
    top = topics.where(F.col("status") == "active").orderBy(F.col("last_used").desc(), "id").limit(K.CONTEXT_TOPICS)
    t = top.select(F.col("id").alias("topic_id"), "title", "summary", "last_used")
    few = top_per_key(items.join(F.broadcast(t.select("topic_id")), "topic_id"), ["topic_id"], [F.col("ts"), F.col("id")], K.CONTEXT_ITEMS)
    line = F.concat(F.lit("- ["), "kind", F.lit("] "), "content")
    lists = few.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("r"))
    block = F.concat(
        F.array(F.concat(F.lit("### "), "title"), F.col("summary")), F.coalesce(F.col("r.l"), X.no_strings()), F.array(F.lit(""))
    )
    blocks = t.join(lists, "topic_id", "left").select((-F.col("last_used")).alias("o"), "topic_id", block.alias("b"))
    return blocks.agg(F.array_sort(F.collect_list(F.struct("o", "topic_id", "b"))).alias("all")).select(
        F.when(F.size("all") > 0, F.concat(F.lit("## 长期记忆\n"), F.array_join(F.flatten(F.col("all.b")), "\n"))).otherwise("").alias("text")
    )
