"""Keeping note tables in step with a listing, and batches of edits.

No table format with MERGE is assumed: every function returns the new content of a
table, to be written to a new place or by partition overwrite.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.hashing import text_hash
from corpusloom.functions.scale import top_per_key
from corpusloom.operators import paths as P

NOTE_COLS = ["path", "content", "mtime", "hash", "cached_at"]
MANIFEST_COLS = ["path", "size", "mtime", "hash"]


def changed(manifest: DataFrame, notes: DataFrame) -> DataFrame:
    """Manifest rows without a cached note, with another hash, or with a newer time."""
    have = notes.select("path", F.col("hash").alias("_h"), F.col("mtime").alias("_m"))
    fresh = F.col("_h").eqNullSafe(F.col("hash")) & (F.col("_m") >= F.col("mtime"))
    return manifest.join(have, "path", "left").where(~F.coalesce(fresh, F.lit(False))).select(*manifest.columns)


def stale(cached: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """Cached rows that are no longer wanted."""
    return cached.join(wanted.select(key).distinct(), key, "left_anti")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], recency: str) -> DataFrame:
    """Put by key: an update beats the stored row, the latest update beats the others."""
    # only the updates are ranked; stored rows, which are unique by key, just give way to them
    rest = [F.col(c).desc() for c in target.columns if c not in keys and c != recency]
    last = top_per_key(updates.select(*target.columns), keys, [F.col(recency).desc(), *rest], 1, "_rn").drop("_rn")
    return target.join(last.select(*keys), keys, "left_anti").select(*target.columns).unionByName(last)


def apply_sync(manifest: DataFrame, notes: DataFrame, fetched: DataFrame, prune: bool = False) -> DataFrame:
    """Note table after the changed notes were read again; `fetched` has the columns of
    notes. Notes gone from the manifest stay unless `prune` is set."""
    out = upsert(notes.select(*NOTE_COLS), fetched, ["path"], "mtime")
    return out.join(manifest.select("path"), "path", "left_semi") if prune else out


def put_notes(edits: DataFrame, notes: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New or edited notes (path, content, ts) stored in both tables."""
    rows = edits.withColumn("hash", text_hash("content"))
    as_note = rows.select("path", "content", F.col("ts").alias("mtime"), "hash", F.col("ts").alias("cached_at"))
    as_entry = rows.select("path", F.octet_length("content").cast("bigint").alias("size"), F.col("ts").alias("mtime"), "hash")
    return (
        upsert(notes.select(*NOTE_COLS), as_note, ["path"], "mtime"),
        upsert(manifest.select(*MANIFEST_COLS), as_entry, ["path"], "mtime"),
    )


def sync_status(manifest: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: entries in the manifest, and how many of them are cached and current."""
    total = manifest.agg(F.count("*").alias("total"))
    missing = changed(manifest, notes).agg(F.count("*").alias("missing"))
    one = F.lit(1).alias("_one")
    both = total.select("total", one).join(missing.select("missing", one), "_one")
    return both.select("total", (F.col("total") - F.col("missing")).alias("synced"), "missing")


def sync_errors(manifest: DataFrame, notes: DataFrame) -> DataFrame:
    return changed(manifest, notes).select("path", F.concat("path", F.lit(": not cached")).alias("error"))


def check_renames(moves: DataFrame, notes: DataFrame) -> DataFrame:
    """(old, new, ts, reason): why a move is refused, null where it is carried out.

    All moves are judged against the same state; of several moves of one note or to
    one target, the first by (old, new) is carried out."""
    state = notes.select("path").distinct()
    known = (
        moves.select("old", "new", "ts")
        .join(state.select(F.col("path").alias("old"), F.lit(True).alias("_src")), "old", "left")
        .join(state.select(F.col("path").alias("new"), F.lit(True).alias("_dst")), "new", "left")
    )
    reason = (
        F.when(F.coalesce(F.length("new"), F.lit(0)) == 0, "empty target")
        .when(F.col("old") == F.col("new"), "same path")
        .when(F.col("_src").isNull(), "missing source")
        .when(F.col("_dst"), "target exists")
    )
    judged = known.withColumn("reason", reason).select("old", "new", "ts", "reason")
    open_ = judged.where(F.col("reason").isNull())
    winners = top_per_key(open_, ["old"], [F.col("new"), F.col("ts")], 1, "_a")
    winners = top_per_key(winners, ["new"], [F.col("old")], 1, "_b").select("old", "new", F.lit(True).alias("_win"))
    return judged.join(winners, ["old", "new"], "left").select(
        "old", "new", "ts",
        F.when(F.col("reason").isNull() & F.col("_win").isNull(), "conflicting move").otherwise(F.col("reason")).alias("reason"),
    )


def rename(table: DataFrame, moves: DataFrame) -> DataFrame:
    """Apply accepted moves (old, new, ts) to any table with a path. Hashes are kept;
    `mtime` and `size`, where present, follow the move. Chunks and vectors move too."""
    m = moves.where(F.col("reason").isNull()) if "reason" in moves.columns else moves
    j = table.join(m.select(F.col("old").alias("path"), F.col("new").alias("_new"), F.col("ts").alias("_ts")), "path", "left")
    moved = F.col("_new").isNotNull()
    out = j.withColumn("path", F.coalesce("_new", "path"))
    for c in ("mtime", "cached_at"):
        if c in table.columns:
            out = out.withColumn(c, F.when(moved, F.col("_ts")).otherwise(F.col(c)))
    return out.select(*table.columns)


def doomed_paths(table: DataFrame, deletes: DataFrame) -> DataFrame:
    """Paths of the table that are on the delete list or lie below a listed folder."""
    keyed = table.select("path").distinct().select(
        "path", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("_key")
    )
    return keyed.join(deletes.select(F.col("path").alias("_key")).distinct(), "_key", "left_semi").select("path").distinct()


def delete_paths(table: DataFrame, deletes: DataFrame) -> DataFrame:
    return table.join(doomed_paths(table, deletes), "path", "left_anti")


def delete_books(deletes: DataFrame, notes: DataFrame, manifest: DataFrame, chunks: DataFrame, vectors: DataFrame):
    """Books are indexed under their own path; their note has `.md` added."""
    gone = deletes.select("path").distinct()
    as_note = gone.select(F.concat("path", F.lit(".md")).alias("path"))
    drop = lambda df, which: df.join(which, "path", "left_anti")
    return drop(notes, as_note), drop(manifest, as_note), drop(chunks, gone), drop(vectors, gone)


def edit_notes(notes: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace the first exact occurrence of a text. `edits` is (path, old_text,
    new_text, ts), one per path. Returns the note table and the refused edits."""
    j = edits.join(notes.select("path", "content"), "path", "left").withColumn("_at", F.instr("content", F.col("old_text")))
    reason = F.when(F.col("content").isNull(), "note missing").when(F.col("_at") == 0, "text not found")
    judged = j.withColumn("reason", reason)
    done = judged.where(F.col("reason").isNull())
    text = F.concat(
        F.substring("content", F.lit(1), F.col("_at") - 1), F.col("new_text"),
        F.substring("content", F.col("_at") + F.length("old_text"), F.length("content")),
    )
    rows = done.select("path", text.alias("content"), "ts").withColumn("hash", text_hash("content"))
    new = rows.select("path", "content", F.col("ts").alias("mtime"), "hash", F.col("ts").alias("cached_at"))
    return (
        upsert(notes.select(*NOTE_COLS), new, ["path"], "mtime"),
        judged.where(F.col("reason").isNotNull()).select("path", "reason"),
    )


def corpus_census(listing: DataFrame, manifest: DataFrame, prefix: str) -> DataFrame:
    """(section, name, n): objects below the prefix by extension, forms of `.md`, notes by
    top folder, manifest rows against listed notes, and notes in other root folders."""
    inside = F.col("key").startswith(prefix + "/")
    ext = F.lower(F.regexp_extract("key", r"\.([^./]+)$", 1))
    is_md = F.lower("key").endswith(".md")
    row = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.alias("name"), n.cast("bigint").alias("n"))
    one = F.lit(1)
    rel = F.substring("key", F.lit(len(prefix) + 2), F.length("key"))
    tagged = listing.select(
        F.array(
            row("extension", F.when(ext != "", ext).otherwise("(none)"), F.when(inside, one)),
            row("markdown", F.lit("md"), F.when(inside & is_md, one)),
            row("markdown", F.lit("markdown"), F.when(inside & F.lower("key").endswith(".markdown"), one)),
            row("markdown", F.lit("odd case"), F.when(inside & is_md & ~F.col("key").endswith(".md"), one)),
            row("folder", P.top_folder(rel), F.when(inside & is_md, one)),
            row("outside", P.top_folder(F.col("key")), F.when(~inside & is_md, one)),
            row("manifest", F.lit("entries minus objects"), F.when(inside & is_md, F.lit(-1))),
        ).alias("r")
    )
    counted = tagged.select(F.inline("r")).where(F.col("n").isNotNull())
    entries = manifest.agg(F.count("*").alias("n")).select(
        F.lit("manifest").alias("section"), F.lit("entries minus objects").alias("name"), "n"
    )
    return counted.unionByName(entries).groupBy("section", "name").agg(F.sum("n").alias("n"))
