"""Quality rules by distribution divergence.

A document is compared with a reference of its language in two histograms: character
classes, and common words. The references are sums over all documents of the language (or
over all documents, for rows without a language); MAX_LANGUAGES may limit them to the
largest languages and does not by default. The distance is the Jensen-Shannon distance, the root of the divergence in bits,
between 0 and 1. A histogram of too few characters or words is noise, so each distance
counts only from a minimum length on, and a document too short for both is kept.

Only DataFrame functions are used. The documents are scanned twice, once for the references
(counts, summed in each task before they move) and once for the rows; no text is shuffled.
The references are COMMON_WORDS words and the class shares of each language. Up to
BROADCAST_LANGUAGES of them are broadcast; more are joined by a shuffle of the documents in
which every language is dealt over SALTS tasks.

Defined cases: a null text is empty and has no words; without words `base_failed` holds
and `kept` does not; repeated rows are judged each; ties among common words are cut by the
word; a null language has the reference of all documents; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusloom.functions.scale import is_small, small_side
from corpusloom.llm.common import WS, WS_CLASS, stored

MAX_LANGUAGES: int | None = None  # of the largest languages; the others have the reference of all documents
BROADCAST_LANGUAGES, SALTS = 5_000, 32
LISTED_WORDS = 20_000  # common words that the plan may name
COMMON_WORDS = 50
# character classes in the order in which they are taken out of the text; the rest is "other"
CLASSES = (
    ("lower", "[\\p{Ll}\\p{Lo}\\p{Lm}]+"), ("space", f"{WS_CLASS}+"), ("upper", "[\\p{Lu}\\p{Lt}]+"),
    ("digit", "\\p{N}+"), ("symbol", "[#*$%&|<>!@^~=+_{}\\[\\]\\\\/]+"),
)
FAST = {"lower": "[a-z\\p{Ll}\\p{Lo}\\p{Lm}]+", "upper": "[A-Z\\p{Lu}\\p{Lt}]+"}  # the same classes, common letters asked first
CELLS = len(CLASSES) + 1
SPACE = [name for name, _ in CLASSES].index("space")
MIN_CHARS, MIN_WORDS = 300, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.33, 0.38
BASE_MIN_WORDS, BASE_REPEAT_SHARE, REPEAT_WINDOW = 10, 20, 5  # fixed by the contract


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{WS_CLASS}+"), "")


def _removed(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _beside(rows: Column, field: str) -> Column:
    """The elements of a sorted array that equal the one before or after them in `field`."""
    same = lambda x, k: F.coalesce(x[field] == F.get(rows, k)[field], F.lit(False))
    return F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1))


def _with_repeats(d: DataFrame) -> DataFrame:
    """`rep`: starts of the windows of five words that occur at least twice in `w`, ascending.
    A word is hashed once, and sorted hashes tell the windows that may be repeated; only those
    compare their words. Each array is a column of its own, as an expression inside a lambda
    runs per element."""
    n = F.size("w") - REPEAT_WINDOW + 1
    at = F.when(n > 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    w, wh = F.col("w"), F.col("wh")
    d = d.withColumn("at", at).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("hs", F.transform("at", lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(REPEAT_WINDOW)])))
    some = F.size(F.array_distinct("hs")) < F.size("hs")
    d = d.withColumn("placed", F.when(some, F.sort_array(F.arrays_zip("hs", "at"))).otherwise(F.array().cast("array<struct<hs:bigint,at:int>>")))
    d = d.withColumn("at", F.transform(_beside(F.col("placed"), "hs"), lambda x: x["at"]))
    windows = F.transform("at", lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + k) for k in range(REPEAT_WINDOW)]).alias("g"), i.alias("i")))
    d = d.withColumn("ordered", F.sort_array(windows))
    return d.withColumn("rep", F.sort_array(F.transform(_beside(F.col("ordered"), "g"), lambda x: x["i"]))).drop("at", "wh", "hs", "placed", "ordered")


def _covered(starts: Column) -> Column:
    """Words inside windows that begin at the given ascending positions."""
    steps = F.transform(starts, lambda x, k: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(starts, k + 1) - x, F.lit(REPEAT_WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def _with_classes(d: DataFrame) -> DataFrame:
    """`c`: characters per class of `t`, whose words are `w`. What the words lack is space; the
    words without it are one text, in which a class makes long runs. Each class is counted by
    taking it out of what the ones before left, so only the first pass goes over all of it.
    `n_symbols` counts the contract's symbols in what is left without letters."""
    d = d.withColumn("j", F.concat_ws("", "w"))
    before, cells = "j", []
    for i, (name, pattern) in enumerate(CLASSES):
        if i == SPACE:
            cells.append(F.length("t") - F.length("j"))
            continue
        d = d.withColumn(f"r{i}", F.regexp_replace(before, FAST.get(name, pattern), ""))
        cells.append(F.length(before) - F.length(f"r{i}"))
        before = f"r{i}"
    d = d.withColumn("c", F.array(*cells, F.length(before)))
    return d.withColumn("n_symbols", _removed(F.col("r0"), "[#*$%&|<>]+").cast("long")).drop("j", *[f"r{i}" for i in range(len(CLASSES))])


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang (null: all documents), classes array<double>, words map<string, double>: shares
    over all documents of the language, for every language and the whole."""
    base = docs.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    by_lang = (
        _with_classes(base.withColumn("w", split_words(F.col("t")))).select("lang", *[F.col("c")[i].alias(f"c{i}") for i in range(CELLS)])
        .groupBy("lang").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(CELLS)])
    )
    by_lang = stored(by_lang)
    chars = sum((F.col(f"c{i}") for i in range(1, CELLS)), F.col("c0"))
    top = by_lang.where(F.col("lang").isNotNull())
    if MAX_LANGUAGES is not None:
        top = top.orderBy(chars.desc(), "lang").limit(MAX_LANGUAGES)
    every = by_lang.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(CELLS)]).select(F.lit(None).cast("string").alias("lang"), "*")
    share = F.transform(F.array(*[F.col(f"c{i}") for i in range(CELLS)]), lambda x: x / F.greatest(chars, F.lit(1)))
    classes = top.select("lang", *every.columns[1:]).unionByName(every).select("lang", share.alias("classes"))

    counts = stored(
        base.select("lang", F.explode(split_words(F.col("t"))).alias("word")).groupBy("lang", "word").count()
    )
    kept = counts.where(F.col("lang").isNotNull())
    if MAX_LANGUAGES is not None:
        kept = kept.join(small_side(top.select("lang")), "lang")
    total = counts.groupBy("word").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("lang"), "word", "count")
    # most frequent words per language; each task keeps its own before anything is shuffled
    first = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    ranked = (
        kept.select("lang", "word", "count").unionByName(total)
        .withColumn("r", F.row_number().over(first)).where(F.col("r") <= COMMON_WORDS)
    )
    sums = kept.groupBy("lang").agg(F.sum("count").alias("n")).unionByName(total.groupBy("lang").agg(F.sum("count").alias("n")))
    words = (
        ranked.join(sums, ranked["lang"].eqNullSafe(sums["lang"])).select(ranked["lang"], "word", (F.col("count") / F.col("n")).alias("share"))
        .groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "share")))).alias("words"))
    )
    return (
        classes.join(words, classes["lang"].eqNullSafe(words["lang"]), "left")
        .select(classes["lang"], "classes", F.coalesce("words", F.create_map().cast("map<string,double>")).alias("words"))
    )


def _part(p: Column, q: Column) -> Column:
    """A cell's share of the divergence: p ln(2p/(p+q)) + q ln(2q/(p+q)), 0 ln 0 = 0."""
    m = p + q
    return F.when(p > 0, p * F.log(2 * p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(2 * q / m)).otherwise(0.0)


def _root(total: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), total / (2 * math.log(2))))


def judge(docs: DataFrame, refs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, the base counts, both distances and the verdict."""
    refs = stored(refs.withColumn("all_q", F.aggregate(F.map_values("words"), F.lit(0.0), lambda a, x: a + x)))
    # with few languages, a list of all their common words sorts most words out; with many, each
    # word is looked up in its own reference
    listed = [r[0] for r in refs.select(F.explode(F.map_keys("words"))).distinct().limit(LISTED_WORDS + 1).collect()]
    names = sorted(listed) if len(listed) <= LISTED_WORDS else None
    common = (lambda x: F.map_contains_key("words", x)) if names is None else (lambda x: x.isin(names) if names else F.lit(False))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text.alias("t"))
    everything = F.broadcast(refs.where("lang is null").select(F.col("classes").alias("all_classes"), F.col("words").alias("all_words"), F.col("all_q").alias("every_q"), F.lit(1).alias("one")))
    own = refs.where("lang is not null")
    if is_small(own, BROADCAST_LANGUAGES):
        d = d.join(F.broadcast(own), "lang", "left")
    else:  # a language with most of the documents is dealt over SALTS tasks
        own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("salt", F.pmod(F.xxhash64("doc_id", "t"), F.lit(SALTS)).cast("int")).join(own, ["lang", "salt"], "left").drop("salt")
    d = (
        d.withColumn("w", split_words(F.col("t"))).withColumn("one", F.lit(1))
        .join(everything, "one", "left")
        .withColumn("classes", F.coalesce("classes", "all_classes")).withColumn("all_q", F.coalesce("all_q", "every_q")).withColumn("words", F.coalesce("words", "all_words"))
        .drop("all_classes", "all_words", "every_q", "one", "lang")
        .withColumn("cw", F.sort_array(F.filter("w", common)))
    )
    d = _with_classes(_with_repeats(d))
    n_words, chars = F.size("w"), F.length("t")
    class_total = sum((_part(F.col("c")[i] / chars, F.col("classes")[i]) for i in range(CELLS)), F.lit(0.0))
    # runs of equal common words, then the cell of everything that is not common
    cw = F.col("cw")
    d = d.withColumn("at", F.when(F.size(cw) > 0, F.sequence(F.lit(0), F.size(cw) - 1)).otherwise(F.array().cast("array<int>")))
    d = d.withColumn("edges", F.filter("at", lambda k: ~F.get(cw, k).eqNullSafe(F.get(cw, k - 1)))).drop("at")
    runs = F.transform("edges", lambda k, i: F.struct(
        F.try_element_at(F.col("words"), F.get(cw, k)).alias("q"),
        (F.coalesce(F.get(F.col("edges"), i + 1), F.size(cw)) - k).alias("n"),
    ))
    d = d.withColumn("runs", F.filter(runs, lambda r: r["q"].isNotNull()))
    common_n = F.aggregate("runs", F.lit(0), lambda a, r: a + r["n"])
    seen_q = F.aggregate("runs", F.lit(0.0), lambda a, r: a + r["q"])
    all_q = F.col("all_q")
    word_total = (
        F.aggregate("runs", F.lit(0.0), lambda a, r: a + _part(r["n"] / n_words, r["q"]))
        + F.greatest(all_q - seen_q, F.lit(0.0)) * math.log(2)  # common words that the document lacks
        + _part((n_words - common_n) / n_words, F.greatest(F.lit(0.0), 1 - all_q))
    )
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(WS)) != ""))
    out = d.select(
        "doc_id", n_words.cast("long").alias("n_words"),
        (chars - F.col("c")[SPACE]).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("rep")).cast("long").alias("n_repeat_words"),
        F.when(chars >= MIN_CHARS, _root(class_total)).alias("class_distance"),
        F.when(n_words >= MIN_WORDS, _root(word_total)).alias("word_distance"),
    )
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_SHARE * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & near)


def quality_rules(docs: DataFrame, **names) -> DataFrame:
    refs = references(docs, **{k: v for k, v in names.items() if k != "id_col"})
    return judge(docs, refs, **names)
