"""Path algebra: folders, scopes, path search, tree listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X


def ancestors(path: Column) -> Column:
    """Every folder prefix of a path, outermost first."""
    parts = F.split(path, "/")
    prefix = lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    return F.when(
        F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), prefix)
    ).otherwise(X.no_strings())


def parent_folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def top_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(K.ROOT_FOLDER)


def folder_rollup(notes: DataFrame) -> DataFrame:
    """(folder, notes): number of notes at any depth below every folder."""
    return notes.select(F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(
        F.count("*").alias("notes")
    )


def top_folder_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy(top_folder(F.col("path")).alias("folder")).agg(F.count("*").alias("notes"))


def in_scope(path: Column, prefixes) -> Column:
    """Path is one of the prefixes or lies below one; no prefixes means everything."""
    if not prefixes:
        return F.lit(True)
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | (path == p) | path.startswith(p + "/")
    return cond


def scope_filter(df: DataFrame, prefixes) -> DataFrame:
    return df.where(in_scope(F.col("path"), prefixes))


def scope_members(df: DataFrame, scopes: DataFrame) -> DataFrame:
    """Rows of `df` once per scope they lie in; `scopes` is (scope_id, prefix), where the
    empty prefix means everything. Membership is decided per distinct path by an
    equi-join on its folders, so many scopes need no nested loop."""
    keys = F.concat(F.array(F.lit("")), ancestors(F.col("path")), F.array("path"))
    members = (
        df.select("path").distinct().select("path", F.explode(keys).alias("prefix"))
        .join(scopes.select("scope_id", "prefix").distinct(), "prefix")
        .select("scope_id", "path").distinct()
    )
    return df.join(members, "path")


def drop_local(df: DataFrame) -> DataFrame:
    """Rows that are not local books."""
    return df.where(~X.starts_with_any(F.col("path"), K.LOCAL_MARKS))


def drop_local_scopes(prefixes: list[str]) -> list[str]:
    """The older reading of the option: only the scope list is filtered, not the rows."""
    return [p for p in prefixes if not p.startswith(K.LOCAL_MARKS)]


def markdown_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("path").isNotNull() & F.lower("path").endswith(".md"))


def path_search(entries: DataFrame, term: str) -> DataFrame:
    """Entries whose path contains the term in any case."""
    t = term.strip().lower()
    return entries.where(F.contains(F.lower("path"), F.lit(t))) if t else entries


def path_search_folders(entries: DataFrame, term: str) -> DataFrame:
    """Folders to open so that every hit of a path search is visible."""
    return (
        path_search(entries, term).select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    )


def file_tree(entries: DataFrame) -> DataFrame:
    """One row per folder and file, in display order: siblings are sorted folders
    first, then by name in Chinese collation. A global sort ranges over tasks, so a
    folder with very many files is not one task's work."""
    leaves = entries.select(
        parent_folder(F.col("path")).alias("parent"), X.base_name(F.col("path")).alias("name"), "path",
        F.lit(False).alias("is_dir"), F.size(F.split("path", "/")).alias("depth"), F.lit(1).cast("bigint").alias("notes"),
    )
    dirs = folder_rollup(entries).select(
        parent_folder(F.col("folder")).alias("parent"), X.base_name(F.col("folder")).alias("name"),
        F.col("folder").alias("path"), F.lit(True).alias("is_dir"),
        F.size(F.split("folder", "/")).alias("depth"), "notes",
    )
    return dirs.unionByName(leaves).orderBy(
        "parent", F.col("is_dir").desc(), F.collate("name", "zh"), "path"
    )


def char_budget(results: DataFrame, max_chars: int, k: int = K.DEFAULT_K, with_title: bool = True) -> DataFrame:
    """Keep ranked results until k, or until their texts exceed `max_chars`; the first
    row always stays. Every row costs at least the fixed overhead, so ranks beyond
    max_chars/overhead cannot survive and are cut before the running sum."""
    cost = F.length("snippet") + F.length("path") + F.length("heading") + K.RESULT_OVERHEAD
    if with_title:
        cost = cost + F.length("title")
    reach = max(1, min(k, max_chars // K.RESULT_OVERHEAD))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("rank") == F.min("rank").over(Window.partitionBy("query_id"))
    return (
        results.where(F.col("rank") <= reach)
        .withColumn("_spent", F.sum(cost).over(w))
        .withColumn("_first", first)
        .where((F.col("_spent") <= max_chars) | F.col("_first"))
        .drop("_spent", "_first")
    )
