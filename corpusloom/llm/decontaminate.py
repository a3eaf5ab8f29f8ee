"""Benchmark decontamination by a prefix-filtered set join.

A window is `window` consecutive words of a benchmark item (a shorter item is one window).
A document contains a window when the words occur in it one after the other.

1. Every window is a set of shingles of `WIDTH` words. All its shingles have to occur, so
   one of them is a sufficient prefix: shingles are ordered by how often they occur in the
   corpus and each window joins on its rarest. A window with a shingle that the corpus does
   not have at all is dropped before the join.
2. Length and position bound a candidate: the window has to begin at or after the
   document's first word and end within its last.
3. A candidate is verified by comparing the words themselves over the window's length.

Only DataFrame functions are used. Documents are read twice (counts, then join) and their
texts are never shuffled: shingles are generated and looked up in the scan's stage and only
verified occurrences leave it.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item
has no windows; items sharing a window are all reported; occurrences of equal or
overlapping windows count each document word once; repeated document rows (same id and
text) give one result row, rows sharing an id but not a text one each; null item ids count
as an item named "null"; extra columns are ignored; empty tables give no rows, or rows
without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.llm.common import ascii_lower, fresh, stored

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"  # fixed by the contract: everything between words
WINDOW = 13
WIDTH = 3
BROADCAST_SHINGLES = 500_000
MARK = 4_611_686_018_427_387_904


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _hashes(ws: Column, width: int) -> Column:
    """Hash of the `width` words from each position on; [] where there are fewer words."""
    last = F.size(ws) - width + 1
    at = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)]))


def windows(benchmark: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item string, words array<string>, width int: the windows of all items, once per item."""
    items = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), words(F.col(text_col)).alias("w")
    ).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return (
        items.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, n))).alias("words"))
        .select("item", "words", F.least(F.col("n"), F.lit(WIDTH)).alias("width"))
        .distinct()
    )


def _shingles(docs: DataFrame, widths: list[int], mark: bool = False) -> DataFrame:
    """A row for every shingle of every document: width, position and hash, with the words.
    `mark` adds one row with the hash MARK to every document, whatever its words."""
    out = None
    for k in widths:
        h = _hashes(F.col("w"), k)
        h = F.concat(h, F.array(F.lit(MARK))) if mark and k == widths[0] else h
        part = docs.select("*", F.lit(k).alias("width"), F.posexplode(h).alias("pos", "h"))
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(side: DataFrame, blocks: int) -> list[DataFrame]:
    """The side in parts by hash, each broadcast to its own pass over the documents. The
    number of parts is counted so that one holds about BROADCAST_SHINGLES rows."""
    return [F.broadcast(side.where(F.pmod(F.xxhash64("h", "width"), F.lit(blocks)) == b)) for b in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence), items (sorted ids of the items
    that occur), one row per document. Cases: see the module's text."""
    wins = windows(benchmark, window, item_id_col, item_text_col)
    shingled = wins.select(
        "item", "words", "width",
        F.posexplode(F.when(F.col("width") == WIDTH, _hashes(F.col("words"), WIDTH)).otherwise(
            F.array(F.when(F.col("width") == 1, F.xxhash64(F.col("words")[0])).otherwise(
                F.xxhash64(F.col("words")[0], F.get(F.col("words"), F.lit(1))))))).alias("offset", "h"),
    )
    shingled = stored(shingled)
    wanted = shingled.select("width", "h").distinct()
    widths = sorted(r[0] for r in shingled.select("width").distinct().collect()) or [WIDTH]  # at most WIDTH rows
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), words(F.col(text_col)).alias("w")
    )
    counts = _union([
        _shingles(texts, widths).select("width", "h").join(part, ["width", "h"], "left_semi").groupBy("width", "h").count()
        for part in _blocks(wanted, 1 + wanted.count() // BROADCAST_SHINGLES)
    ])
    rare = (
        shingled.join(counts, ["width", "h"], "left")
        .groupBy("item", "words", "width")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "h", "offset")).alias("r"))
        .where("r.n > 0")
        .select("item", "words", "width", F.col("r.h").alias("h"), F.col("r.offset").alias("offset"), F.size("words").alias("len"))
    )
    marker = docs.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("item"), F.array().cast("array<string>").alias("words"), F.lit(widths[0]).alias("width"),
        F.lit(MARK).alias("h"), F.lit(0).alias("offset"), F.lit(0).alias("len"),
    )
    rare = stored(rare.unionByName(marker))
    first = F.col("pos") - F.col("offset")
    hits = _union([
        _shingles(texts.withColumn("n_words", F.size("w")), widths, mark=True)
        .join(part, ["width", "h"])
        .where((first >= 0) & (first + F.col("len") <= F.col("n_words")))
        .where(F.slice(F.col("w"), first + 1, F.col("len")) == F.col("words"))
        .select("doc_id", "text_hash", "n_words", "item", first.alias("first"), "len")
        for part in _blocks(rare, 1 + rare.count() // BROADCAST_SHINGLES)
    ])
    # groups are documents: what one collects is bounded by its own text
    found = hits.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.collect_set(F.when(F.col("item").isNotNull(), F.struct("first", "len"))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
    )
    inside = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["len"] - 1)))
    return found.select("doc_id", "n_words", F.size(F.array_distinct(inside)).cast("long").alias("n_hit"), "items")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The rule: at least one word in 20 lies inside an occurring window."""
    return (n_hit > 0) & (F.lit(20) * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents that the rule leaves, with all their columns. Rows that share an id go
    together when any of them is contaminated, rows with a null id likewise."""
    id_col = names.get("id_col", "doc_id")
    bad_id = fresh(docs, "_bad_id")
    bad = contamination(docs, benchmark, **names).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(
        F.col("doc_id").alias(bad_id)
    ).distinct()
    bad = stored(bad)
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(bad_id)), "left_anti")
