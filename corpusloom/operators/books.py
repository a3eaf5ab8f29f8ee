"""Book text, the table of local books, and recovery of their texts.

The text of a book is given as ordered pieces, one per chapter or chunk whatever the book's
length; put together without anything between them they are the text. No row and no task
grows with the longest book; a writer puts the pieces in order (as the exports do).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import is_small, running_sum, top_per_key

SALTS = 64

def _pieces(rows: DataFrame, keys: list[str], order: str, piece: Column, trim: bool = False) -> DataFrame:
    """(keys…, pos, text): ordered pieces with a blank line before all but the first; with
    `trim` the last one is trimmed at its end. Positions come from a running count that splits long keys."""
    numbered = running_sum(rows.withColumn("_piece", piece), keys, F.floor(F.col(order) / 1024), [order], F.lit(1), "_n")
    text = F.concat(F.when(F.col("_n") > 1, "\n\n").otherwise(""), "_piece")
    if not trim:
        return numbered.select(*keys, F.col("_n").cast("bigint").alias("pos"), text.alias("text"))
    last = rows.groupBy(*keys).agg(F.max(order).alias(order)).withColumn("_last", F.lit(True))
    return numbered.join(last, [*keys, order], "left").select(
        *keys, F.col("_n").cast("bigint").alias("pos"), F.when(F.col("_last"), F.regexp_replace(text, r"(?U)\s+$", "")).otherwise(text).alias("text")
    )


def assemble_book(chapters: DataFrame) -> DataFrame:
    """(book, pos, text) of chapters (book, ord, title, text): `## title`, a blank line and
    the text, chapters with no text left out."""
    full = chapters.where(F.length(X.uni_trim(F.col("text"))) > 0)
    return _pieces(full, ["book"], "ord", F.concat(F.lit("## "), "title", F.lit("\n\n"), "text"), trim=True)


def page_chapters(pages: DataFrame) -> DataFrame:
    """Pages (book, page, text) of a paged document as chapters titled by their number."""
    return pages.select("book", F.col("page").alias("ord"), F.concat(F.lit("第 "), F.col("page").cast("string"), F.lit(" 页")).alias("title"), "text")


def book_report(chapters: DataFrame) -> DataFrame:
    """(book, chapters, empty, chars, scanned): a book with more than half of its parts
    empty is probably scanned."""
    empty = F.when(F.length(X.uni_trim(F.coalesce("text", F.lit("")))) == 0, 1).otherwise(0)
    return (
        chapters.groupBy("book")
        .agg(F.count("*").alias("chapters"), F.sum(empty).alias("empty"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
        .withColumn("scanned", F.col("empty") > F.col("chapters") * K.SCANNED_SHARE)
    )


def book_summary(chunks: DataFrame) -> DataFrame:
    """(path, type, chunks, chars, indexed, headings): local books by their chunks, newest
    first. A `.md` twin is left out where the book itself is there, too."""
    local = chunks.where(X.starts_with_any(F.col("path"), K.LOCAL_MARKS))
    totals = local.groupBy("path").agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"),
        F.greatest(F.max("mtime"), F.lit(0)).alias("indexed"),
    )
    first = local.where(F.length("heading") > 0).groupBy("path", "heading").agg(F.min("idx").alias("idx"))
    heads = top_per_key(first, ["path"], [F.col("idx"), F.col("heading")], 3).groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "heading"))), lambda s: s["heading"]), "|").alias("headings")
    )
    twins = totals.select(F.concat("path", F.lit(".md")).alias("path"))
    return (
        totals.join(twins, "path", "left_anti").join(heads, "path", "left")
        .select(
            "path", F.when(F.col("path").startswith(K.PDF_MARK), "pdf").otherwise("epub").alias("type"),
            "chunks", "chars", "indexed", F.coalesce("headings", F.lit("")).alias("headings"),
        )
        .orderBy(F.col("indexed").desc(), "path")
    )


def book_key(path: Column) -> Column:
    """What stays the same between copies of a book."""
    c = F.lower(F.regexp_replace(path, rf"(?U)^[{K.PDF_MARK}{K.EPUB_MARK}]\s*", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\.(md|pdf|epub)", ""), r"\(\d+\)", ""), r"(?U)\s+", "")


def dedupe_books(summary: DataFrame) -> DataFrame:
    """(path, keep): copies of the same book; the one with the most chunks is kept. The
    best of each group is an aggregate, so a group of any size costs one row."""
    keyed = summary.withColumn("_key", book_key(F.col("path")))
    best = keyed.groupBy("_key").agg(F.min(F.struct((-F.col("chunks")).alias("n"), "path")).alias("b"), F.count("*").alias("copies"))
    many = best.where("copies > 1").select("_key", F.col("b.path").alias("keep"))
    return keyed.join(many, "_key").where(F.col("path") != F.col("keep")).select("path", "keep")


def _of_books(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Chunks of these paths, which are distinct. No task gets all texts of one path, be it a
    long book or a note that is none of them: few paths go to the texts, and where there are
    many, a path's texts are dealt over SALTS keys."""
    if is_small(paths):
        return chunks.join(F.broadcast(paths), "path", "left_semi")
    salted = chunks.withColumn("_salt", F.pmod(F.xxhash64("path", "idx"), F.lit(SALTS)))
    each = paths.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(each, ["path", "_salt"], "left_semi").select(*chunks.columns)


def recover_text(books: DataFrame, notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, pos, source, text): the text of each book, in pieces, from its note, else from a note
    with the same base name, else from its chunks; at least fifty characters are needed."""
    enough = F.length("content") >= K.BOOK_MIN_CHARS
    own = books.select("path", F.concat("path", F.lit(".md")).alias("_note"))
    by_path = own.join(notes.select(F.col("path").alias("_note"), F.col("content").alias("_c1"), F.lit(True).alias("_has1")), "_note", "left")
    by_base = notes.groupBy(F.lower(X.base_name(F.col("path"))).alias("_base")).agg(F.min("path").alias("_p2"))
    named = by_path.withColumn("_base", F.lower(F.concat(X.base_name(F.col("path")), F.lit(".md")))).join(by_base, "_base", "left")
    both = named.join(notes.select(F.col("path").alias("_p2"), F.col("content").alias("_c2")), "_p2", "left")
    text = F.when(F.col("_has1"), F.col("_c1")).otherwise(F.col("_c2"))
    chosen = both.select("path", text.alias("content"), F.when(F.col("_has1"), "note").otherwise("same name").alias("source"))
    good = chosen.where(enough).select("path", F.lit(1).cast("bigint").alias("pos"), "source", body_of_book_note(F.col("content")).alias("text"))
    rest = books.select("path").join(good.select("path"), "path", "left_anti")
    mine = _of_books(chunks, rest)
    sizes = mine.groupBy("path").agg((F.sum(F.length("content")) + 2 * (F.count("*") - 1)).alias("n")).where(F.col("n") >= K.BOOK_MIN_CHARS)
    rebuilt = _pieces(_of_books(chunks, sizes.select("path")), ["path"], "idx", F.col("content"))
    return good.unionByName(rebuilt.select("path", "pos", F.lit("chunks").alias("source"), "text"))


def book_note(books: DataFrame) -> DataFrame:
    """(path, content): the note kept for a book (path, kind, name, chunks, text)."""
    mark = F.when(F.col("kind") == "pdf", K.PDF_MARK).otherwise(K.EPUB_MARK)
    head = F.format_string(
        "---\nlocal-file: %s\noriginal-name: %s\nchunks: %s\ntotal-chars: %s\n---\n\n# %s %s\n\n",
        "kind", "name", F.col("chunks").cast("string"), F.length("text").cast("string"), mark, F.col("name"),
    )
    return books.select(F.concat(mark, F.lit(" "), "name", F.lit(".md")).alias("path"), F.concat(head, "text", F.lit("\n")).alias("content"))


def body_of_book_note(content: Column) -> Column:
    """The text of a book note without its header; any other text as it is."""
    return F.regexp_replace(content, rf"(?s)^---\nlocal-file: .*?\n---\n\n# [{K.PDF_MARK}{K.EPUB_MARK}] [^\n]*\n\n(?:> [^\n]*\n)*\n?", "")
