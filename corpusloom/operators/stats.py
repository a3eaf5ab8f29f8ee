"""Tags, statistics and the generated overview of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import top_per_key
from corpusloom.operators import paths as P
from corpusloom.sources.notes import list_tags


def note_tag_rows(notes: DataFrame) -> DataFrame:
    """(tag, path): one row per tag mention of a note."""
    return notes.select("path", F.explode_outer(X.quick_tags(F.col("content"))).alias("tag")).where("tag IS NOT NULL").select("tag", "path")


def tag_index(notes: DataFrame) -> DataFrame:
    """(tag, count, first_path): mentions of every tag, most frequent first. The paths of a
    tag are rows of `note_tag_rows`; a list per tag would grow with the collection."""
    return (
        note_tag_rows(notes).groupBy("tag").agg(F.count("*").alias("count"), F.min("path").alias("first_path"))
        .orderBy(F.col("count").desc(), "first_path", "tag")
    )


def list_tags_top(notes: DataFrame, limit: int = 50) -> DataFrame:
    return tag_index(notes).select("tag", "count").limit(limit)


def find_by_tag(notes: DataFrame, tags: DataFrame, limit: int = 30) -> DataFrame:
    """(tag, count, rank, path): first notes of each asked tag, and how many there are.
    A tag nobody uses gives one row with count 0."""
    asked = tags.select("tag", F.regexp_replace("tag", "^#", "").alias("_t")).distinct()
    rows = note_tag_rows(notes).withColumnRenamed("tag", "_t").join(asked.select("_t").distinct(), "_t", "left_semi")
    counts = rows.groupBy("_t").agg(F.count("*").alias("count"))
    head = top_per_key(rows, ["_t"], [F.col("path")], limit)
    return asked.join(counts, "_t", "left").join(head, "_t", "left").select(
        "tag", F.coalesce("count", F.lit(0)).alias("count"), "rank", "path"
    )


def vault_stats(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals. Sizes are given in characters and in bytes. Notes are read once:
    what is summed over notes is summed in the scan's task, under one name for all of them;
    only tags and folders move by name, each once per task."""
    named = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    a_note = F.array(F.struct(F.lit("note").alias("kind"), F.lit(None).cast("string").alias("name")))
    rows = notes.select(
        "path", F.length("content").alias("n_chars"), F.octet_length("content").alias("n_bytes"), F.size(X.links_wiki(F.col("content"))).alias("n_links"),
        F.explode(F.concat(a_note, named("tag", X.quick_tags(F.col("content"))), named("folder", P.ancestors(F.col("path"))))).alias("i"),
    )
    is_note = F.col("i.kind") == "note"
    of_notes = lambda f, c: f(F.when(is_note, c))
    names = rows.groupBy("i.kind", "i.name").agg(
        F.count_if(is_note).alias("notes"), *[of_notes(F.sum, F.col(c)).alias(c) for c in ("n_chars", "n_bytes", "n_links")],
        # the first note, in path order, among those of the largest size
        of_notes(F.min, F.struct((-F.col("n_chars")).alias("n"), "path")).alias("largest"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = names.agg(
        total("notes").alias("notes"), total("n_chars").alias("chars"), total("n_bytes").alias("bytes"), total("n_links").alias("links"),
        F.floor(F.coalesce(F.sum("n_chars") / F.sum("notes"), F.lit(0)) + 0.5).alias("avg_chars"), (-F.min("largest")["n"]).alias("largest_chars"),
        F.min("largest")["path"].alias("largest"), F.count_if(F.col("kind") == "tag").alias("tags"), F.count_if(F.col("kind") == "folder").alias("folders"),
    )
    one = F.lit(1)
    return totals.withColumn("_one", one).join(chunks.agg(F.count("*").alias("chunks")).withColumn("_one", one), "_one").drop("_one")


def recent(notes: DataFrame, n: int = 20) -> DataFrame:
    return (
        notes.orderBy(F.col("mtime").desc(), "path").limit(n)
        .select("path", X.title_of(F.col("path")).alias("title"), "mtime", F.length("content").cast("bigint").alias("size"))
    )


def concepts(notes: DataFrame, limit: int = K.MAX_CONCEPTS, tags: Column | None = None) -> DataFrame:
    """(rank, term, weight, paths): a front matter tag counts 2, a title term counts 1.
    Weights are relative to the best; paths are the first notes, tags before titles."""
    tag_list = list_tags(F.col("content")) if tags is None else tags
    tagged = notes.select("path", tag_list.alias("t"))
    by_tag = tagged.select("path", F.explode(F.filter("t", lambda t: F.length(t) >= 2)).alias("term"), F.lit(2.0).alias("w"), F.lit(0).alias("src"))
    by_title = notes.select("path", F.explode(X.title_tokens(X.title_of(F.col("path")))).alias("term"), F.lit(1.0).alias("w"), F.lit(1).alias("src"))
    terms = by_tag.unionByName(by_title)
    weights = terms.groupBy("term").agg(F.sum("w").alias("raw"), F.min(F.struct("src", "path", "term")).alias("_seen"))
    top = weights.orderBy(F.col("raw").desc(), "_seen").limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("raw").desc(), "_seen"))).withColumn(
        "weight", F.col("raw") / F.max("raw").over(Window.partitionBy())
    )
    # `top` has at most `limit` rows
    places = terms.join(F.broadcast(ranked.select("term")), "term").groupBy("term", "path").agg(F.min("src").alias("src"))
    first = top_per_key(places, ["term"], [F.col("src"), F.col("path")], K.CONCEPT_PATHS, "_n").groupBy("term").agg(
        F.array_sort(F.collect_list(F.struct("_n", "path"))).alias("_p")
    )
    return ranked.join(first, "term").select("rank", "term", "weight", F.col("_p.path").alias("paths"))


def overview(notes: DataFrame) -> DataFrame:
    """One row: notes, characters, average, and folders at any depth."""
    totals = notes.agg(F.count("*").alias("notes"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))
    folders = P.folder_rollup(notes).agg(F.count("*").alias("folders"))
    one = F.lit(1)
    return totals.withColumn("_one", one).join(folders.withColumn("_one", one), "_one").select(
        "notes", "chars",
        F.when(F.col("notes") > 0, F.floor(F.col("chars") / F.col("notes") + 0.5)).otherwise(0).alias("avg_chars"), "folders",
    )


def tag_groups(notes: DataFrame, limit: int = K.MAX_TAG_GROUPS, shown: int = 20) -> DataFrame:
    """(rank, tag, count, pos, path): the most used tags with their first notes."""
    top = tag_index(notes).limit(limit)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("count").desc(), "first_path", "tag")))
    rows = note_tag_rows(notes).join(F.broadcast(ranked.select("tag", "count", "rank")), "tag")  # `limit` rows
    return top_per_key(rows, ["tag"], [F.col("path")], shown, "pos").select("rank", "tag", "count", "pos", "path")


def auto_wiki(notes: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    """The generated overview of a folder, one frame per section. Notes are filtered
    before tags are counted and the timeline is cut."""
    inside = P.scope_filter(notes, [prefix]) if prefix else notes
    timeline = recent(inside, K.MAX_TIMELINE).select("path", "title", "mtime")
    return {"overview": overview(inside), "concepts": concepts(inside), "tags": tag_groups(inside), "timeline": timeline}
