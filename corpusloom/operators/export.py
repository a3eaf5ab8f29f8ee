"""Exports as rows of Markdown or JSON text in a fixed order.

A long export is never built as one string: every function gives pieces with ordering
columns, and `write_text` range-sorts them over many files that read in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.operators import paths as P
from corpusloom.operators.chat import session_summary


def write_text(pieces: DataFrame, order: list[str], target: str, column: str = "text") -> None:
    """Text files whose names sort in the order of the pieces."""
    pieces.orderBy(*order).select(F.col(column).alias("value")).write.mode("overwrite").text(target)


def export_conversations(chat: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """(session_id, ts, id, text): a heading piece per session, then one per message."""
    heads = session_summary(chat, sessions).select(
        "session_id", F.lit(-1).cast("bigint").alias("ts"), F.lit(-1).cast("bigint").alias("id"),
        F.concat(F.lit("# 💬 "), "title", F.lit("\n\n> "), F.col("messages").cast("string"), F.lit(" 条消息\n\n---\n")).alias("text"),
    )
    role = F.when(F.col("role") == "user", "👤 User").when(F.col("role") == "assistant", "🤖 Assistant").otherwise("⚙️ System")
    body = chat.select(
        F.coalesce("session_id", F.lit("default")).alias("session_id"), "ts", "id",
        F.concat(F.lit("## "), role, F.lit("\n\n"), "content", F.lit("\n")).alias("text"),
    )
    return heads.unionByName(body)


def kilobytes(chars: Column) -> Column:
    return F.format_string("%.1f", chars / F.lit(1024.0))


def export_book(notes: DataFrame, prefix: str = "") -> DataFrame:
    """(folder, path, text): notes grouped by folder as one book; a title piece, a piece
    per folder, a piece per note. Sorting by folder and path gives the book."""
    inside = P.scope_filter(notes, [prefix]) if prefix else notes
    folder = F.when(F.instr("path", "/") > 0, P.parent_folder(F.col("path"))).otherwise(K.ROOT_FOLDER)
    rows = inside.select(folder.alias("folder"), "path", "content")
    name = prefix or "(whole vault)"
    title = rows.agg(F.count("*").alias("n")).select(
        F.lit("").alias("folder"), F.lit("").alias("path"),
        F.concat(F.lit(f"# 📖 小书:{name}\n\n> "), F.col("n").cast("string"), F.lit(" 篇笔记\n\n---\n")).alias("text"),
    )
    folders = rows.select("folder").distinct().select("folder", F.lit("").alias("path"), F.concat(F.lit("# 📁 "), "folder", F.lit("\n")).alias("text"))
    pieces = rows.select(
        "folder", "path",
        F.concat(
            F.lit("## "), X.title_of(F.col("path")), F.lit("\n\n> 来源: [["), "path", F.lit("]] · "), kilobytes(F.length("content")),
            F.lit(" KB\n\n```\n"), "content", F.lit("\n```\n"),
        ).alias("text"),
    )
    return title.unionByName(folders).unionByName(pieces)


def iso_time(millis: Column) -> Column:
    utc = F.to_utc_timestamp(F.timestamp_millis(millis), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def export_jsonld(notes: DataFrame, prefix: str = "", base: str = "vault:///") -> DataFrame:
    """(part, path, text): the pieces of a JSON-LD document. Part 0 opens it with the context,
    part 1 has a graph node per note in path order, part 2 closes it; put together in the
    order of part and path, they are the document."""
    inside = P.scope_filter(notes, [prefix]) if prefix else notes
    uri = lambda c: F.concat(F.lit(base), c)
    refs = F.transform(F.array_distinct(X.links_graph(F.col("content"))), uri)
    node = F.struct(
        uri(F.col("path")).alias("@id"), F.lit("schema:Article").alias("@type"), uri(F.col("path")).alias("path"),
        X.title_of(F.col("path")).alias("title"), iso_time(F.col("mtime")).alias("mtime"), refs.alias("references"), F.length("content").alias("size"),
    )
    spark = notes.sparkSession
    edge = lambda part, text: spark.range(1).select(F.lit(part).alias("part"), F.lit("").alias("path"), F.lit(text).alias("text"))
    first = inside.agg(F.min("path").alias("_first"))  # one row
    nodes = inside.select("path", F.to_json(node).alias("text")).join(F.broadcast(first), F.lit(True))
    comma = F.when(F.col("path") == F.col("_first"), F.col("text")).otherwise(F.concat(F.lit(",\n"), F.col("text")))
    return (
        edge(0, f'{{"@context": {JSONLD_CONTEXT}, "@graph": [\n')
        .unionByName(nodes.select(F.lit(1).alias("part"), "path", comma.alias("text"))).unionByName(edge(2, "\n]}"))
    )


JSONLD_CONTEXT = (
    '{"schema": "http://schema.org/", "path": {"@id": "schema:url", "@type": "@id"}, "title": "schema:name", '
    '"tags": {"@id": "schema:keywords"}, "mtime": {"@id": "schema:dateModified", "@type": "schema:Date"}}'
)


def render_wiki(sections: dict[str, DataFrame], scope: str = "") -> DataFrame:
    """One row: the generated overview as Markdown. Every section is a short top list and
    is reduced to one text before the four are put together."""
    bar = F.floor(F.col("weight") * 10 + 0.5).cast("int")
    concept = F.concat(
        F.lit("- `"), "term", F.lit("` "), F.repeat(F.lit("█"), bar), F.repeat(F.lit("░"), 10 - bar), F.lit(" ("), F.size("paths").cast("string"), F.lit(" 篇)")
    )
    n = F.col("count").cast("string")
    tag_head = F.when(F.col("pos") == 1, F.concat(F.lit("### #"), "tag", F.lit(" ("), n, F.lit(")\n"))).otherwise("")
    more = F.when(F.col("count") > 20, F.concat(F.lit("- ... +"), (F.col("count") - 20).cast("string"), F.lit(" 篇\n"))).otherwise("")
    tag_end = F.when(F.col("pos") == F.least("count", F.lit(20)), F.concat(F.lit("\n"), more)).otherwise("")
    when = F.date_format(F.timestamp_millis("mtime"), "yyyy/M/d")
    parts = [
        ("concepts", "## 🔑 关键概念", [F.col("rank")], concept),
        ("tags", "## 🗂 MOC 索引", [F.col("rank"), F.col("pos")], F.concat(tag_head, F.lit("- [["), "path", F.lit("]]"), tag_end)),
        ("timeline", "## 📅 时间线", [-F.col("mtime"), F.col("path")], F.concat(F.lit("- "), when, F.lit(" [["), "path", F.lit("|"), "title", F.lit("]]"))),
    ]
    out = sections["overview"].select(F.lit(1).alias("_one"), F.concat(
        F.lit(f"# {scope or '(whole vault)'} Wiki\n\n## 📌 概览\n\n共 "), F.col("notes").cast("string"), F.lit(" 篇笔记 · 总大小 "), kilobytes(F.col("chars")),
        F.lit(" KB · 平均 "), F.col("avg_chars").cast("string"), F.lit(" 字/篇 · 分布在 "), F.col("folders").cast("string"), F.lit(" 个子目录\n"),
    ).alias("_overview"))
    for name, title, order, line in parts:
        rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("l"))))
        text = sections[name].agg(rows.alias("r")).select(
            F.lit(1).alias("_one"),
            F.when(F.size("r") > 0, F.concat(F.lit(title + "\n\n"), F.array_join(F.col("r.l"), "\n"), F.lit("\n"))).alias("_" + name),
        )
        out = out.join(text, "_one")
    return out.select(F.concat_ws("\n", "_overview", "_concepts", "_tags", "_timeline").alias("text"))


def export_memory(topics: DataFrame, items: DataFrame) -> DataFrame:
    """(topic_id, ts, id, text): a heading piece per topic, then one line per item."""
    heads = topics.select(
        F.col("id").alias("topic_id"), F.lit(-1).cast("bigint").alias("ts"), F.lit(-1).cast("bigint").alias("id"),
        F.concat(F.lit("## "), "title", F.lit("\n*"), "summary", F.lit("*\n")).alias("text"),
    )
    note = F.when(F.length("source") > 0, F.concat(F.lit(" _(source: "), "source", F.lit(")_"))).otherwise("")
    rows = items.join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_semi").select(
        "topic_id", "ts", "id", F.concat(F.lit("- **"), "kind", F.lit("**: "), "content", note).alias("text")
    )
    return heads.unionByName(rows)
