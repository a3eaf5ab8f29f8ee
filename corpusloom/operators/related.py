"""Related notes for every note: links in both directions, shared tags, same folder.

Each kind gives the first notes in path order and the full count. Pairs of notes that
share a tag are never all listed: the first n notes sharing any of a note's items are
among the first n + 1 holders of each item, and the count of all of them follows from
inclusion and exclusion over the note's few much-used items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import lookup, materialize, top_per_key
from corpusloom.operators.paths import parent_folder
from corpusloom.sources.notes import list_tags

MAX_SUBSET_ITEMS = 10
COLD_HOLDERS = 50


def body_links(content: Column) -> Column:
    """Links of the text after the front matter, lower-cased, without `.md`."""
    body = F.regexp_replace(content, r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    return F.array_distinct(F.transform(X.links_render(body), lambda t: X.drop_md(F.lower(t))))


def _first(items: DataFrame, n: int) -> DataFrame:
    """(path, other): the first n other notes, by path, sharing an item with each note."""
    heads = top_per_key(items, ["item"], [F.col("path")], n + 1).select("item", F.col("path").alias("other"))
    pairs = items.join(heads, "item").where(F.col("path") != F.col("other")).select("path", "other").distinct()
    return top_per_key(pairs, ["path"], [F.col("other")], n).select("path", "other", "rank")


def shared_counts(items: DataFrame, max_items: int = MAX_SUBSET_ITEMS, cold_holders: int = COLD_HOLDERS) -> DataFrame:
    """(path, n): how many other notes share at least one item with each note.

    An item with more than `cold_holders` holders is hot. Sharing a hot item is counted by
    inclusion and exclusion: every note yields the subsets of its few hot items once, so
    the work is linear in the notes. Notes sharing only cold items are listed, which is at
    most `cold_holders` rows per note and item. A note with more than `max_items` hot items
    (more than that many hubs) is compared with the holders of its items one by one."""
    items = materialize(items.select("path", "item").distinct())
    hot_items = items.groupBy("item").count().where(F.col("count") > cold_holders).select("item")
    hot = items.join(hot_items, "item", "left_semi")
    cold = items.join(hot_items, "item", "left_anti")
    held = materialize(hot.groupBy("path").agg(F.array_sort(F.collect_set("item")).alias("s")))
    light = held.where(F.size("s") <= max_items)
    masks = F.expr("sequence(1, shiftleft(1, size(s)) - 1)")

    def subset(mask):
        return F.filter("s", lambda x, i: F.call_function("shiftrightunsigned", mask, i).bitwiseAND(F.lit(1)) == 1)

    subs = light.select("path", F.explode_outer(F.transform(masks, lambda m: F.struct(
        F.array_join(subset(m), "\u0001").alias("key"), (F.pmod(F.bit_count(m), F.lit(2)) * 2 - 1).alias("sign")
    ))).alias("x")).select("path", "x.key", "x.sign")
    holders = subs.groupBy("key").agg(F.count("*").alias("n"))
    among_light = lookup(subs, holders, "key").groupBy("path").agg((F.sum(F.col("sign") * F.col("n")) - 1).alias("n"))

    heavy = hot.join(held.where(F.size("s") > max_items).select("path"), "path", "left_semi")
    pairs = (
        heavy.join(hot.select("item", F.col("path").alias("other")), "item")
        .where(F.col("path") != F.col("other")).select("path", "other").distinct()
    )
    of_heavy = pairs.groupBy("path").agg(F.count("*").alias("n"))
    light_side = pairs.join(light.select(F.col("path").alias("other")), "other", "left_semi")
    with_heavy = light_side.groupBy(F.col("other").alias("path")).agg(F.count("*").alias("n"))

    near = (
        cold.join(cold.select("item", F.col("path").alias("other")), "item")
        .where(F.col("path") != F.col("other")).select("path", "other").distinct()
        .join(held, "path", "left").join(held.select(F.col("path").alias("other"), F.col("s").alias("s2")), "other", "left")
        .where(~F.coalesce(F.arrays_overlap("s", "s2"), F.lit(False)))
    )
    only_cold = near.groupBy("path").agg(F.count("*").alias("n"))
    parts = among_light.unionByName(with_heavy).unionByName(of_heavy).unionByName(only_cold)
    return parts.groupBy("path").agg(F.sum("n").alias("n"))


def note_moc(notes: DataFrame, tags: Column | None = None, limit: int = K.MOC_LIMIT) -> DataFrame:
    """(path, kind, rank, other, title, tag, total). Kinds: `backlink` links to the full
    path, `same-tag` with the first shared tag, `parent` for notes of the same folder,
    `co_link` for notes linking to something this note links to, `mutual` for notes that
    link to each other."""
    # the texts are read once; what follows works on names, links and tags alone
    base = materialize(notes.select(
        "path", X.drop_md(F.lower("path")).alias("name"), body_links(F.col("content")).alias("links"),
        F.array_distinct(list_tags(F.col("content")) if tags is None else tags).alias("tags"),
    ))
    links = base.select("path", F.explode("links").alias("item"))
    names = base.select(F.col("path").alias("target"), F.col("name").alias("item"))
    edges = materialize(
        links.join(names, "item").where(F.col("path") != F.col("target")).select(F.col("path").alias("other"), F.col("target").alias("path")).distinct()
    )
    back_edges = edges.select(F.col("path").alias("other"), F.col("other").alias("path"))
    mutual = edges.join(back_edges, ["path", "other"], "left_semi")

    tag_items = base.select("path", F.explode("tags").alias("item"))
    folder = base.select("path", parent_folder(F.col("path")).alias("item")).where(F.length("item") > 0)

    own = base.select("path", F.col("tags").alias("_mine"))
    others = base.select(F.col("path").alias("other"), F.col("tags").alias("_theirs"))
    shared = F.try_element_at(F.filter("_theirs", lambda t: F.array_contains("_mine", t)), F.lit(1))
    tagged = _first(tag_items, limit).join(own, "path").join(others, "other").select("path", "other", "rank", shared.alias("tag"))

    def direct(e: DataFrame, kind: str) -> DataFrame:
        total = e.groupBy("path").agg(F.count("*").alias("total"))
        return _row(top_per_key(e, ["path"], [F.col("other")], limit), total, kind)

    def _row(first: DataFrame, total: DataFrame, kind: str) -> DataFrame:
        tag = F.col("tag") if "tag" in first.columns else F.lit(None).cast("string").alias("tag")
        return first.join(total, "path").select("path", F.lit(kind).alias("kind"), "rank", "other", X.title_of(F.col("other")).alias("title"), tag, "total")

    sibling_counts = folder.groupBy("item").agg((F.count("*") - 1).alias("total"))
    siblings = lookup(folder, sibling_counts, "item").select("path", "total").where("total > 0")
    count = lambda items: shared_counts(items).withColumnRenamed("n", "total")
    return (
        direct(edges, "backlink")
        .unionByName(direct(mutual, "mutual"))
        .unionByName(_row(tagged, count(tag_items), "same-tag"))
        .unionByName(_row(_first(folder, limit), siblings, "parent"))
        .unionByName(_row(_first(links, limit), count(links), "co_link"))
    )
