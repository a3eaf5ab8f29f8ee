"""Automatic links: find mentions of other notes' titles, insert them, take them back."""

from __future__ import annotations

import heapq
import re

import ahocorasick
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom import constants as K
from corpusloom.functions import substrings, text as X
from corpusloom.functions.batches import in_slices
from corpusloom.functions.scale import BROADCAST_ROWS, is_small, materialize, small_side, top_per_key

LINK = r"\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]"
_LINK = re.compile(LINK)
MARK = "@autolink"
MARKED = rf"<!--{MARK}:(\d+):([^>]+?)-->\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]"


# --- one text ------------------------------------------------------------------
def masked(content: Column) -> Column:
    """The text with the inside of every link blanked, position by position."""
    parts = F.split(F.regexp_replace(content, LINK, "\u0001$0\u0001"), "\u0001")
    return F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike(f"^{LINK}$"), F.rpad(F.lit(""), F.length(p), "\u0000")).otherwise(p)), ""
    )


def outside_links(content: Column, keyword: Column) -> Column:
    """Offset of the first occurrence, in any case, not inside a link; -1 without one."""
    return F.instr(F.lower(masked(content)), F.lower(keyword)) - 1


# --- keyword hits ------------------------------------------------------------------
_HITS = "path string, keyword string, offset int, usable boolean, preview string"


def _first_matches(text: str, automaton) -> dict[str, int]:
    """First offset of every keyword of an automaton in a masked, lower-cased text, in one pass."""
    first: dict[str, int] = {}
    for end, word in automaton.iter(text):
        first.setdefault(word, end - len(word) + 1)
    return first


def _scan(notes: DataFrame, finder) -> DataFrame:
    """Keyword hits per note, in one pass over each text. `finder()` gives, once per task, a
    function from a masked, lower-cased text to the first offsets of keywords."""

    def rows_of():
        find = finder()

        def rows(note):
            path, content = note["path"], note["content"]
            low = _LINK.sub(lambda m: "\0" * len(m.group()), content).lower()
            dashes = content.find("---")
            for word, at in find(low).items():
                front = at < K.FRONT_ZONE and 0 <= dashes <= at - 3
                yield path, word, at, not front, content[max(0, at - K.PREVIEW_RADIUS) : at + len(word) + K.PREVIEW_RADIUS]

        return rows

    return in_slices(notes.select("path", "content"), rows_of, _HITS)


def _possible_hits(notes: DataFrame, distinct: DataFrame, limit: int) -> DataFrame:
    """Keyword hits and, with a dictionary above `limit`, a few of other substrings."""
    if is_small(distinct, limit):
        words = sorted(r["keyword"] for r in distinct.collect())  # counted just above

        def finder():
            automaton = ahocorasick.Automaton()
            for w in words:
                automaton.add_word(w, w)
            automaton.make_automaton()
            return lambda text: _first_matches(text, automaton)

        return _scan(notes, finder if words else lambda: lambda text: {})
    known = substrings.build(distinct)
    return _scan(notes, lambda: lambda text: substrings.first_places(text, known))


def keyword_hits(notes: DataFrame, keywords: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(path, keyword, offset, usable, preview) of the first mention of every keyword outside
    links; the preview is the text around it.

    A dictionary counted within `limit` goes to the tasks, and each text is scanned once
    for all of it. Of a larger one the tasks get a filter of bits of bounded size; what of a
    text passes it is joined to the dictionary. A text gives rows for its own mentions only,
    so they grow with the texts, however large the dictionary is."""
    distinct = keywords.select("keyword").where("keyword IS NOT NULL").distinct()
    return _possible_hits(notes, distinct, limit).join(distinct, "keyword", "left_semi").select("path", "keyword", "offset", "usable", "preview")


# --- candidates ----------------------------------------------------------------------
def _targets(notes: DataFrame, min_title: int) -> DataFrame:
    title = X.title_of(F.col("path"))
    ok = ~X.starts_with_any(F.col("path"), K.LOCAL_MARKS) & (F.length(title) >= min_title)
    return notes.where(ok).select(F.col("path").alias("target"), title.alias("title"), X.title_keywords(title).alias("kws")).where(F.size("kws") > 0)


def _link_names(notes: DataFrame) -> DataFrame:
    """(source, low): what each note links to, in lower case."""
    raw = F.regexp_extract_all("content", F.lit(LINK), F.lit(1))
    return notes.select(
        F.col("path").alias("source"), F.explode_outer(F.array_distinct(F.transform(raw, lambda t: F.lower(X.uni_trim(t))))).alias("low")
    ).where(F.col("low").isNotNull())


def already_linked(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target): targets whose title the source links to already."""
    names = targets.select("target", F.lower("title").alias("low"))
    return _link_names(notes).join(names, "low").where(F.col("source") != F.col("target")).select("source", "target").distinct()


FEW_EXCLUDED = 16  # targets a source may exclude without lists of its own
_FOUND = "source string, target string, keyword string, offset int, preview string"


def link_candidates(
    notes: DataFrame, max_per_note: int = K.AUTOLINK_PER_NOTE, min_title: int = K.AUTOLINK_MIN_TITLE,
    dictionary_limit: int = BROADCAST_ROWS, hot_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(source, target, keyword, offset, preview): for each note the first targets, in path
    order, mentioned by a keyword of their title and not linked yet.

    A keyword shared by very many titles does not multiply: a target among the first m of
    a source is among the first m + excluded + 1 holders of every keyword it is found by,
    so only those leading holders of each keyword are looked at, and the result is whole.
    Sources with many excluded targets are grouped by their number, rounded up to a power of
    two, so that only they meet long lists.

    Pairs of a source and a holder are never rows. The lists of the keywords with the most
    holders, `hot_rows` holders in all, go to the tasks; each other keyword carries its list as
    one value. A source's mentions are brought together once, its lists are merged in place,
    and only its first targets leave the task."""
    targets = _targets(notes, min_title)
    sources = notes.where(~X.starts_with_any(F.col("path"), K.LOCAL_MARKS) & (F.length(X.title_of(F.col("path"))) >= min_title))
    words = materialize(targets.select("target", F.lower("title").alias("low"), F.posexplode("kws").alias("kpos", "keyword")))
    linked = materialize(_link_names(sources).distinct())
    titles = targets.groupBy(F.lower("title").alias("low")).agg(F.countDistinct("target").alias("n"))
    itself = (F.col("low") == F.lower(X.title_of(F.col("source")))).cast("int")
    excluded = linked.join(titles, "low").groupBy("source").agg(F.sum(F.col("n") - itself).alias("n")).where("n > 0")
    steps = materialize(excluded.select("source", F.ceil(F.log2("n")).cast("int").alias("step")))
    many = steps.where(F.pow(F.lit(2), F.col("step")) > FEW_EXCLUDED)
    reach = {-1: max_per_note + FEW_EXCLUDED + 1}
    reach |= {r["step"]: max_per_note + 2 ** r["step"] + 1 for r in many.select("step").distinct().collect()}  # at most one per power of two

    longest = max(reach.values())
    ranked = top_per_key(words, ["keyword"], [F.col("target")], longest, "_r")
    most = words.groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "keyword").limit(hot_rows // longest).select("keyword")
    hot: dict[str, list[tuple]] = {}
    for r in ranked.join(F.broadcast(most), "keyword", "left_semi").collect():  # at most hot_rows
        hot.setdefault(r["keyword"], []).append((r["target"], r["kpos"], r["low"]))
    for holders in hot.values():
        holders.sort()
    spark = notes.sparkSession
    is_hot = F.broadcast(spark.createDataFrame([(w, True) for w in hot], "keyword string, _hot boolean"))
    kinds = F.filter(F.array(*[F.when(F.col("_r") <= n, F.lit(s)) for s, n in reach.items()]), lambda s: s.isNotNull())
    lists = (
        ranked.join(is_hot, "keyword", "left_anti").withColumn("step", F.explode(kinds)).groupBy("keyword", "step")
        .agg(F.sort_array(F.collect_list(F.struct("target", "kpos", "low"))).alias("holders"))
        .select(F.col("keyword").alias("_key"), "step", "holders")
    )

    hits = _possible_hits(sources, words.select("keyword").distinct(), dictionary_limit).where("usable")
    hits = hits.select(F.col("path").alias("source"), "keyword", "offset", "preview")
    if len(reach) > 1:
        hits = hits.join(small_side(many), "source", "left").withColumn("step", F.coalesce("step", F.lit(-1)))
    else:
        hits = hits.withColumn("step", F.lit(-1))
    # a hot keyword needs no list; its mentions are dealt by source, for no task gets all of them
    key = F.when(F.col("_hot"), F.concat(F.lit("\0"), "source")).otherwise(F.col("keyword"))
    met = hits.join(is_hot, "keyword", "left").withColumn("_key", key).join(lists, ["_key", "step"], "left").where("_hot OR holders IS NOT NULL")
    # the mentions of one note, its links
    own = met.groupBy("source").agg(F.collect_list(F.struct("keyword", "offset", "preview", "holders")).alias("hits"))
    own = own.join(steps, "source", "left").join(linked.groupBy("source").agg(F.collect_set("low").alias("links")), "source", "left")

    def rows_of():
        def rows(note):
            source, links, step = note["source"], set(note["links"] or ()), note["step"]
            n = max_per_note + (0 if step is None else 2**step) + 1
            mentions: dict[str, list] = {}  # a path that several rows have is mentioned by each
            for h in note["hits"]:
                m = mentions.setdefault(h["keyword"], [h["offset"], [], h["holders"]])
                m[0] = min(m[0], h["offset"])
                m[1].append(h["preview"])
            found: dict[str, list] = {}
            for keyword, (_, _, holders) in mentions.items():
                some = hot[keyword][:n] if holders is None else [(h["target"], h["kpos"], h["low"]) for h in holders[:n]]
                for target, kpos, low in some:
                    if low in links or target == source:
                        continue
                    best = found.get(target)
                    if best is None or kpos < best[0]:
                        found[target] = [kpos, keyword, 1]
                    elif kpos == best[0]:
                        best[2] += 1
            for target in heapq.nsmallest(max_per_note, found):
                _, keyword, copies = found[target]
                offset, previews, _ = mentions[keyword]
                for preview in previews * copies:
                    yield source, target, keyword, offset, preview

        return rows

    return in_slices(own, rows_of, _FOUND)


def skipped_targets(notes: DataFrame, candidates: DataFrame, max_per_note: int = K.AUTOLINK_PER_NOTE, min_title: int = K.AUTOLINK_MIN_TITLE) -> DataFrame:
    """(source, skipped): already linked targets met before a source reached its limit."""
    targets = _targets(notes, min_title)
    sources = notes.where(~X.starts_with_any(F.col("path"), K.LOCAL_MARKS) & (F.length(X.title_of(F.col("path"))) >= min_title))
    ends = candidates.groupBy("source").agg(F.count("*").alias("n"), F.max("target").alias("last"))
    return (
        already_linked(sources, targets).join(ends, "source", "left")
        .where(F.coalesce(F.col("n") < max_per_note, F.lit(True)) | (F.col("target") < F.col("last")))
        .groupBy("source").agg(F.count("*").alias("skipped"))
    )


# --- insert and take back ---------------------------------------------------------------
def apply_links(notes: DataFrame, candidates: DataFrame, mtime: Column | None = None, link_text: str = "matched") -> DataFrame:
    """Notes with their candidates written in as a marker comment and a link.

    The matched text keeps its case (`link_text='title'` writes the target's title
    instead). Of overlapping candidates the leftmost, then longest, wins. A note has at
    most the per-note limit of candidates, so its list is small."""
    rows = candidates.groupBy(F.col("source").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("offset"), (-F.length("keyword")).alias("neg"), F.col("target"), F.col("keyword")))).alias("c")
    )
    start = F.struct(F.lit(0).alias("end"), F.expr("CAST(array() AS array<struct<offset:int,neg:int,target:string,keyword:string>>)").alias("kept"))
    keep = F.aggregate(
        "c", start,
        lambda acc, x: F.when(
            x["offset"] >= acc["end"],
            F.struct((x["offset"] - x["neg"]).alias("end"), F.concat(acc["kept"], F.array(x)).alias("kept")),
        ).otherwise(acc),
    )["kept"]
    n = F.size("_k")

    def write(acc, p):
        i, x = p["i"], p["x"]
        # positions count from the end of the list, so later text is written first
        word = F.substring(acc, x["offset"] + 1, -x["neg"])
        shown = word if link_text == "matched" else X.title_of(x["target"])
        mark = F.concat(F.lit(f"<!--{MARK}:"), i.cast("string"), F.lit(":"), X.encode_path(x["target"]), F.lit("-->[["), shown, F.lit("]]"))
        return F.concat(F.substring(acc, F.lit(1), x["offset"]), mark, F.substring(acc, x["offset"] - x["neg"] + 1, F.length(acc)))

    numbered = F.transform(F.reverse("_k"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    j = notes.join(rows, "path", "left").withColumn("_k", F.when(F.col("c").isNotNull(), keep))
    text = F.when(n > 0, F.aggregate(numbered, F.col("content"), write)).otherwise(F.col("content"))
    new_time = F.col("mtime") if mtime is None else F.when(n > 0, mtime).otherwise(F.col("mtime"))
    return j.withColumn("content", text).withColumn("mtime", new_time).select(*notes.columns)


def revert_links(notes: DataFrame) -> DataFrame:
    """Notes with inserted links replaced by their text; other links stay. `removed`
    counts the links taken out of each note."""
    return notes.withColumn("removed", F.regexp_count("content", F.lit(MARKED)).cast("bigint")).withColumn(
        "content", F.regexp_replace("content", MARKED, "$3")
    )
