"""Wikilinks between notes: name resolution, graph, backlinks, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom import constants as K
from corpusloom.functions import text as X
from corpusloom.functions.scale import HOT_ROWS, lookup, materialize, top_per_key
from corpusloom.functions.substrings import inside
from corpusloom.operators.paths import top_folder


# --- name resolution -----------------------------------------------------------
def _no_space(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


LISTED = 5  # notes shown for a target that may mean several


def resolve_names(targets: DataFrame, manifest: DataFrame, listed: int | None = LISTED) -> DataFrame:
    """(target, rank, path, score, matches): the `listed` best notes a link target may mean,
    ties by path, and how many there are in all. With `listed=None` (target, path, score) of
    every note it may mean, unranked: then the rows are as many as the matches.

    100 same base name, 95 the same without blanks, 90 same full path, 80 one name
    contains the other, 70 the same without blanks. All but the third look at names alone,
    so targets meet a dictionary of distinct names, each with its number of notes and its
    first paths; a target's matches are a sum over names, and its best notes are among the
    first paths of its best names. Equal names and paths are equi-joins, and so is
    containment: a filter of bits finds the substrings of a name that may be targets, and of
    a target that may be names. A blank target is contained in every name; it gets the total
    and the first paths without meeting the names."""
    t = targets.select("target").distinct()
    t = t.withColumn("_t", F.lower(X.uni_trim(F.col("target"))))
    t = materialize(t.withColumn("_tn", X.drop_md(F.col("_t"))).withColumn("_ts", _no_space(F.col("_tn"))))
    m = manifest.select("path").distinct()
    m = materialize(m.withColumn("_n", F.lower(X.title_of(F.col("path")))))
    named = t.where("_tn <> ''")
    pairs, by_path = _by_name(named, m)
    blank = t.where("_tn = ''")
    of_blank = F.when(F.col("_n") == "", 100).when(_no_space(F.col("_n")) == "", 95).when(F.lower("path").isin("", ".md"), 90).otherwise(80)
    if listed is None:
        by_name = pairs.select("target", "_n", "score").join(m, "_n")
        better = by_path.select("target", "path", F.lit(90).alias("score"))
        found = by_name.select("target", "path", "score").join(better.select("target", "path"), ["target", "path"], "left_anti").unionByName(better)
        # blank targets are few spellings; each may mean every note
        every = m.select("path", of_blank.alias("score")).crossJoin(blank.select("target"))
        return found.unionByName(every.select("target", "path", "score"))

    first_paths = top_per_key(m, ["_n"], [F.col("path")], listed, "_place")
    matches = pairs.select("target", "notes").unionByName(by_path.where("_by_name IS NULL").select("target", F.lit(1).cast("bigint").alias("notes")))
    matches = matches.groupBy("target").agg(F.sum("notes").alias("matches"))
    leading = top_per_key(pairs, ["target"], [F.col("score").desc(), F.col("first")], listed, "_place").select("target", "_n", "score")
    found = leading.join(first_paths.select("_n", "path"), "_n").select("target", "path", "score")
    found = found.unionByName(by_path.select("target", "path", F.lit(90).alias("score"))).groupBy("target", "path").agg(F.max("score").alias("score"))
    best = top_per_key(found, ["target"], [F.col("score").desc(), F.col("path")], listed).join(matches, "target")

    every = m.withColumn("score", of_blank).orderBy(F.col("score").desc(), "path").limit(listed)
    every = every.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "path")))  # of `listed` rows
    total = m.agg(F.count("*").alias("matches"))
    blank = blank.select("target", F.lit(1).alias("_k"))
    of_blank = blank.join(F.broadcast(every.withColumn("_k", F.lit(1))), "_k").join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    cols = ["target", "rank", "path", "score", "matches"]
    return best.select(*cols).unionByName(of_blank.select(*cols))


def _by_name(named: DataFrame, m: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of targets and names (target, _n, score, notes, first), and the notes that their
    full path makes a better match (target, path, _n, _by_name)."""
    names = materialize(m.groupBy("_n").agg(F.count("*").alias("notes"), F.min("path").alias("first")).withColumn("_ns", _no_space(F.col("_n"))))
    hit = lambda df, score: df.select("target", "_n", F.lit(score).alias("score"))
    near = _containing(named.select("target", F.col("_tn").alias("a")), names.select("_n", F.col("_n").alias("b")), 80)
    loose = _containing(named.select("target", F.col("_ts").alias("a")), names.select("_n", F.col("_ns").alias("b")), 70)
    pairs = materialize(
        hit(named.join(names, F.col("_tn") == F.col("_n")), 100).unionByName(hit(named.join(names, F.col("_ts") == F.col("_ns")), 95))
        .unionByName(near).unionByName(loose)
        .groupBy("target", "_n").agg(F.max("score").alias("score")).join(names.select("_n", "notes", "first"), "_n")
    )
    full = named.select("target", F.explode(F.array(F.concat("_t", F.lit(".md")), F.col("_t"))).alias("_p"))
    by_path = materialize(
        full.join(m, F.col("_p") == F.lower("path")).select("target", "path", "_n").distinct()
        .join(pairs.select("target", "_n", F.col("score").alias("_by_name")), ["target", "_n"], "left")
        .where("_by_name IS NULL OR _by_name < 90")
    )
    return pairs, by_path


def _containing(t: DataFrame, m: DataFrame, score: int) -> DataFrame:
    """Pairs where one text contains the other. Each text is looked through for the texts of
    the other side, so that it meets those it contains and no others."""
    ta, mb = t.select("a").distinct(), m.select("b").distinct()
    a_in_b = inside(mb.withColumnRenamed("b", "text"), ta.withColumnRenamed("a", "word")).select(F.col("word").alias("a"), F.col("text").alias("b"))
    b_in_a = inside(ta.withColumnRenamed("a", "text"), mb.withColumnRenamed("b", "word")).select(F.col("text").alias("a"), F.col("word").alias("b"))
    pairs = a_in_b.unionByName(b_in_a).distinct()
    return t.join(pairs, "a").join(m, "b").select("target", "_n", F.lit(score).alias("score"))


def resolved_target(candidates: DataFrame) -> DataFrame:
    """(target, matches, path): the note where there is exactly one, else null."""
    return candidates.where(F.col("rank") == 1).select("target", "matches", F.when(F.col("matches") == 1, F.col("path")).alias("path"))


# --- graph -----------------------------------------------------------------------
def graph_edges(notes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(source, target, times, weight) of resolved links. A link means the note with that
    path in any case, else the first note with that base name; links of a note to itself
    are dropped. Occurrences are counted before anything is joined, and a name that many
    notes link to is looked up by broadcast (see `lookup`)."""
    found = notes.select("path", F.explode_outer(X.links_graph(F.col("content"))).alias("t")).where(F.col("t").isNotNull())
    # texts are read once; the counted links are a narrow table
    found = materialize(
        found.select(F.col("path").alias("source"), F.lower("t").alias("t")).groupBy("source", "t").agg(F.count("*").alias("times"))
    )
    low = notes.select("path", F.lower("path").alias("_low"))
    by_path = low.groupBy(F.col("_low").alias("t")).agg(F.max("path").alias("_by_path"))
    by_base = low.groupBy(X.base_name(F.col("_low")).alias("_base")).agg(F.min("path").alias("_by_base"))
    names = found.select("t").distinct().withColumn("_base", X.base_name(F.col("t")))
    meaning = (
        names.join(by_path, "t", "left").join(by_base, "_base", "left")
        .select("t", F.coalesce("_by_path", "_by_base").alias("target")).where(F.col("target").isNotNull())
    )
    return (
        lookup(found, meaning, "t", hot_rows)
        .where(F.col("target").isNotNull() & (F.col("target") != F.col("source")))
        .groupBy("source", "target").agg(F.sum("times").alias("times"))
        .withColumn("weight", F.least(F.col("times"), F.lit(K.EDGE_WEIGHT_CAP)))
    )


def graph_nodes(edges: DataFrame, notes: DataFrame, fill: int = K.FILL_NODES, cap: int = K.MAX_NODES) -> DataFrame:
    """(path, label, folder, value): linked notes, filled up with unlinked ones to `fill`,
    cut to the `cap` most linked. At most `cap` rows reach the last step."""
    incoming = edges.groupBy(F.col("target").alias("path")).agg(F.sum("times").alias("incoming"))
    ends = edges.select(F.explode(F.array("source", "target")).alias("path")).distinct().withColumn("_end", F.lit(1))
    every = notes.select("path").join(ends, "path", "full").join(incoming, "path", "left")
    order = [F.coalesce("_end", F.lit(0)).desc(), F.coalesce("incoming", F.lit(0)).desc(), F.col("path")]
    head = every.orderBy(*order).limit(max(fill, cap))
    placed = head.withColumn("_rn", F.row_number().over(Window.orderBy(*order)))
    return placed.where((F.col("_rn") <= cap) & (F.col("_end").isNotNull() | (F.col("_rn") <= fill))).select(
        "path", X.title_of(F.col("path")).alias("label"), F.substring_index("path", "/", 1).alias("folder"),
        F.coalesce("incoming", F.lit(1)).alias("value"),
    )


def graph_prune(edges: DataFrame, nodes: DataFrame, max_edges: int = K.MAX_EDGES) -> DataFrame:
    """The heaviest edges, then those with both ends among the nodes."""
    top = edges.orderBy(F.col("weight").desc(), "source", "target").limit(max_edges)
    ids = nodes.select("path")
    for end in ("source", "target"):
        top = top.join(F.broadcast(ids.select(F.col("path").alias(end))), end, "left_semi")  # at most `cap` rows
    return top.select(*edges.columns)


def relations(nodes: DataFrame, edges: DataFrame, min_in: int = 0, shown: int = 12) -> DataFrame:
    """(path, label, folder, n_in, n_out, hub, first_in, first_out): neighbour counts and
    the first neighbours of every node. Neighbours beyond `shown` are in the edge table."""
    edges = materialize(edges.select("source", "target").distinct())

    def side(here: str, there: str, n: str, first: str) -> DataFrame:
        d = edges.select(F.col(here).alias("path"), F.col(there).alias("other"))
        counts = d.groupBy("path").agg(F.count("*").alias(n))
        heads = top_per_key(d, ["path"], [F.col("other")], shown).groupBy("path").agg(
            F.array_join(F.array_sort(F.collect_list("other")), "|").alias(first)
        )
        return counts.join(heads, "path")

    out = nodes.join(side("target", "source", "n_in", "first_in"), "path", "left")
    out = out.join(side("source", "target", "n_out", "first_out"), "path", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    none = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return out.select(
        "path", "label", top_folder(F.col("path")).alias("folder"), zero("n_in"), zero("n_out"),
        (F.coalesce("n_in", F.lit(0)) >= K.HUB_IN).alias("hub"), none("first_in"), none("first_out"),
    ).where(F.col("n_in") >= min_in)


# --- backlinks and orphans ---------------------------------------------------------
def _wiki_links(notes: DataFrame) -> DataFrame:
    return notes.select(
        F.col("path").alias("source"), F.explode_outer(X.links_wiki(F.col("content"))).alias("link")
    ).where(F.col("link").isNotNull())


def _names(notes: DataFrame) -> DataFrame:
    """(target, link): the two spellings that mean a note, its full name and base name."""
    name = X.drop_md(F.col("path"))
    return notes.select(
        F.col("path").alias("target"), F.explode(F.array_distinct(F.array(name, X.base_name(name)))).alias("link")
    )


def _shown(line: Column) -> Column:
    """A line with links replaced by their text, cut."""
    plain = F.regexp_replace(F.regexp_replace(line, r"\[\[([^\]|]+?)\|([^\]]+)\]\]", "$2"), r"\[\[([^\]|]+?)\]\]", "$1")
    return F.substring(X.uni_trim(plain), 1, K.BACKLINK_CONTEXT)


def _link_lines(notes: DataFrame) -> DataFrame:
    """(source, mtime, link, line_no, context): every link of a note with the first line that
    holds it literally. Lines are taken here, so no text leaves the scan."""
    numbered = F.transform(F.split("content", "\n"), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    d = notes.select(F.col("path").alias("source"), "mtime", X.links_wiki(F.col("content")).alias("links"), numbered.alias("lines"))

    def first(link: Column) -> Column:
        head = F.concat(F.lit("[["), link)
        holds = lambda x: F.contains(x["line"], F.concat(head, F.lit("]]"))) | F.contains(x["line"], F.concat(head, F.lit("|")))
        hit = F.get(F.filter("lines", holds), 0)
        return F.struct(link.alias("link"), hit["i"].alias("line_no"), _shown(hit["line"]).alias("context"))

    return d.select("source", "mtime", F.explode_outer(F.transform("links", first)).alias("f")).select("source", "mtime", "f.*").where(F.col("line_no").isNotNull())


def backlinks(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, source, title, context, mtime): notes linking to each target, with the
    first line that holds the link; without such a line there is no row."""
    return (
        _link_lines(notes).join(_names(targets), "link")
        .groupBy("target", "source").agg(F.min(F.struct("line_no", "context", "mtime")).alias("f"))
        .select("target", "source", X.title_of(F.col("source")).alias("title"), "f.context", "f.mtime")
    )


def orphans(notes: DataFrame, observed: bool = False) -> DataFrame:
    """Notes without outgoing and incoming links. As first observed (`observed`), outgoing
    links never counted and only links by full path were incoming."""
    links = _wiki_links(notes)
    names = notes.select(F.col("path").alias("target"), X.drop_md(F.col("path")).alias("link")) if observed else _names(notes)
    linked = links.join(names, "link").where(F.col("source") != F.col("target")).select(F.col("target").alias("path")).distinct()
    out = notes.select("path").join(linked, "path", "left_anti")
    if observed:
        return out
    return out.join(links.select(F.col("source").alias("path")).distinct(), "path", "left_anti")
