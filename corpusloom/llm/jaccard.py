"""Near duplicates by word-shingle Jaccard: a T-occurrence search with DivideSkip.

Two documents link when 100 * |common| >= PERCENT * |all| over their sets of SHINGLE-word
shingles. A document of n shingles then shares at least T = ceil(PERCENT * n / 100) of its
own with any partner. Shingles are 64-bit hashes; equal sets are one class from the start.

1. A class is out as soon as more than n - T of its shingles are known to be its alone.
   Three eighths of the hash space are counted for that, which costs that share of the rows
   and never drops a class that has a partner.
2. Shingles of the classes left are ordered by how many classes hold them. The first
   n - T + 1 in this order lead a class to its partners: two that link share one of them.
   Lists of the same least member are one bundle, so near copies, whose lists are nearly
   the same, meet once and not once per shingle.
3. A bundle is dealt in blocks of bounded size, each with the bundle's least member. In a
   block every class asks an inverted index of the block: its longest lists are set aside
   (DivideSkip's choice of their number), the short ones are merged by a heap, classes on
   enough of them are looked up in the long lists by binary search, and those reaching the
   overlap that the pair needs are linked. Classes already connected are not looked up, and
   a class stops asking when all that it could find is connected to it.
4. Blocks of one bundle meet only as far as needed: classes that step 3 has connected to the
   least member are one component, so only the others visit the other blocks.

No pairs are emitted: a block returns a forest of links, components follow by star
contraction. A text is hashed twice, and a third time where step 1 leaves it.

Defined cases: with fewer words than a shingle has, the whole sequence is one; a null or
wordless text has no shingles and is its own component; equal rows are one class; rows that
share an id but not a text are classes of their own; a row with a null id gets the component
of its class and never names it, and a class of such rows alone forms no links and has a
null component; very long texts are hashed whole and a block holds at least one class;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from corpusloom.llm.common import stored
from corpusloom.llm.graph import components

SHINGLE, PERCENT = 5, 80
MEMBERS, HASHES = 512, 2_000_000  # classes and shingles of a block
MU = 0.01  # weight of a binary search against a step of the merge, in DivideSkip's formula
CHUNK_CHARS = 2_000_000  # of text whose shingles are held at once, beyond one text
COUNTED = 3  # of 8 parts of the hash space, in which a class's own shingles are counted
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, ascending."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z only; at [\x20\x09-\x0D]
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws))
    k = min(width, len(ws))
    n = len(ws) - k + 1
    out, high = np.full(n, k, np.uint64), np.empty(n, np.uint64)
    for i in range(k):  # a polynomial of the word hashes, stirred after every word
        out += h[i:i + n]
        out *= _MIX[i % len(_MIX)]
        out ^= np.right_shift(out, np.uint64(29), out=high)
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def needed(n: Column, percent: int) -> Column:
    """Shingles that a set of n shares with any partner, at least."""
    return F.ceil(n * percent / F.lit(100))


def _signature(h: np.ndarray) -> tuple[int, int]:
    both = xxh3_128_intdigest(h.tobytes())
    return (both >> 64) - (1 << 63), (both & (1 << 64) - 1) - (1 << 63)


def _hashed(texts: DataFrame, width: int, schema: str, out: Callable[[pd.DataFrame, list[np.ndarray]], pd.DataFrame]) -> DataFrame:
    """`out` of every batch and the shingles of its texts t."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = b["t"].str.len().cumsum().to_numpy() // CHUNK_CHARS
            for _, some in b.groupby(part, sort=False):
                yield out(some, [shingles(t, width) for t in some["t"]])

    return texts.mapInPandas(run, schema)


def divide_skip(
    postings: list[int], spans: list[tuple[int, int]], need: int, enough: Callable[[int], int], wanted: Callable[[int], bool]
) -> Iterator[tuple[int, int]]:
    """(member, occurrences) of the wanted members that are on at least enough(member), and
    never under `need`, of the lists. A list is a span of `postings`, ascending; the spans
    come by length."""
    if len(spans) < need:
        return
    longest = spans[-1][1] - spans[-1][0]
    n_long = min(need - 1, int(need / (MU * log2(longest) + 1)))
    short, long = spans[:len(spans) - n_long], spans[len(spans) - n_long:]
    long.reverse()
    least = need - n_long
    for member, run in groupby(merge(*(postings[lo:hi] for lo, hi in short))):
        times = sum(1 for _ in run)
        if times < least or not wanted(member):
            continue
        goal = enough(member)
        left = len(long)
        for lo, hi in long:
            if times + left < goal:
                break
            at = bisect_left(postings, member, lo, hi)
            times += at < hi and postings[at] == member
            left -= 1
        if times >= goal:
            yield member, times


def _root(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = int(up[i])
    return i


def connect(sets: list[np.ndarray], label: np.ndarray, guest: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """For each set the smallest label it reaches over links. Sets of one label are connected
    already. Pairs of two guests, and of two others where there are guests, are left out."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    order = np.argsort(-size, kind="stable")  # a set asks for those after it, which are not larger
    sets, size, label, guest = [sets[i] for i in order], size[order], label[order], guest[order]
    visited = bool(guest.any())
    _, up = np.unique(label, return_index=True)
    up = up[np.searchsorted(label[up], label)]
    flat, who = np.concatenate(sets), np.repeat(np.arange(n), size)
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[token] > 1  # what one set alone has is on no list
    token, who = token[shared], who[shared]
    by_token = np.argsort(token, kind="stable")
    postings = who[by_token].tolist()
    place = np.empty(len(token), np.int64)  # of every set's token in its list
    place[by_token] = np.arange(len(token))
    stop_at = np.cumsum(np.where(times > 1, times, 0))[token]  # where that list ends
    ends = np.searchsorted(who, np.arange(n), side="right")
    del flat, by_token
    for q in range(n - 1):
        need = -(-percent * int(size[q]) // 100)
        begin = ends[q - 1] if q else 0
        if ends[q] - begin < need:
            continue
        stop = int(np.searchsorted(-size, -need, side="right"))  # from here on they are too small
        if stop <= q + 1:
            continue
        mine = _root(up, q)
        up[q + 1:stop] = up[up[q + 1:stop]]
        if all(_root(up, int(x)) == mine for x in np.unique(up[q + 1:stop])):
            continue
        lo, hi = place[begin:ends[q]] + 1, stop_at[begin:ends[q]]
        order_q = np.argsort(hi - lo, kind="stable")
        order_q = order_q[np.searchsorted((hi - lo)[order_q], 1):]  # lists with sets after this one
        spans = list(zip(lo[order_q].tolist(), hi[order_q].tolist()))
        enough = lambda c: -(-percent * int(size[q] + size[c]) // (100 + percent))  # noqa: E731, B023
        wanted = lambda c: c < stop and (not visited or guest[c] != guest[q]) and _root(up, c) != _root(up, q)  # noqa: E731, B023
        for c, _ in divide_skip(postings, spans, need, enough, wanted):
            up[_root(up, c)] = _root(up, q)
    root = np.fromiter((_root(up, i) for i in range(n)), np.int64, n)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, root, label)
    out = np.empty(n, np.int64)
    out[order] = least[root]
    return out


def _forest(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["a", "guest"])
        label = group["label"].to_numpy()
        root = connect([np.asarray(x, np.int64) for x in group["hashes"]], label, group["guest"].to_numpy(), percent)
        moved = root != label
        return pd.DataFrame({"a": label[moved], "b": root[moved]}).drop_duplicates()

    return run


def links(sets: DataFrame, percent: int = PERCENT, members: int = MEMBERS, hashes: int = HASHES) -> DataFrame:
    """Edges (a, b) that connect what links, from classes (a, n, hashes)."""
    held = sets.select("a", "n", F.explode("hashes").alias("h"))
    counts = held.groupBy("h").agg(F.count("*").alias("df"), F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi").select("h", "df")
    own = held.join(counts, "h").groupBy("a", "n").agg(F.array_sort(F.collect_set(F.struct("df", "h"))).alias("s"))  # bounded by one text
    leading = F.size("s") - needed(F.col("n"), percent) + 1  # of n - T + 1, those that others hold too
    short = stored(own.where(leading > 0).select("a", "n", F.explode(F.slice("s", F.lit(1), leading.cast("int"))).alias("s")).select("a", "n", "s.h"))
    least = short.groupBy("h").agg(F.min("a").alias("p"))
    member = stored(short.join(least, "h").where("a <> p").select("p", "a", "n").distinct())
    blocks = member.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / hashes)).alias("k"))
    member = stored(member.join(blocks, "p").withColumn("block", F.pmod(F.xxhash64("a", "p"), F.col("k"))))
    pivots = blocks.select("p", F.col("p").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("block"))
    schema = "a long, b long"

    def meet(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(sets.select("a", "hashes"), "a").groupBy(*keys).applyInPandas(_forest(percent), schema)

    inside = stored(meet(member.select("p", "block", "a").unionByName(pivots).withColumns({"label": F.col("a"), "guest": F.lit(False)}), ["p", "block"]))
    # classes that are not connected to their bundle's least member visit its other blocks
    roots = stored(components(inside))
    named = lambda df, key, out: df.join(roots.select(F.col("node").alias(key), F.col("root").alias(out)), key, "left").withColumn(out, F.coalesce(out, key))
    many = stored(named(named(member.where("k > 1"), "a", "label"), "p", "core"))
    guests = many.where("label <> core")
    parts = guests.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / members), F.ceil(F.sum("n") / hashes)).alias("g"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    visits = guests.join(parts, "p").select("p", "a", "label", "block", F.pmod(F.xxhash64("p", "a"), F.col("g")).alias("part"), each(F.col("k")).alias("to"))
    visits = visits.where("to <> block").select("p", F.col("to").alias("block"), "part", "a", "label", F.lit(True).alias("guest"))
    homes = many.join(parts, "p").select("p", "block", each(F.col("g")).alias("part"), "a", "label", F.lit(False).alias("guest"))
    across = meet(visits.unionByName(homes), ["p", "block", "part"])
    return inside.unionByName(across)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row. Cases: see the module's text."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def described(b: pd.DataFrame, found: list[np.ndarray]) -> pd.DataFrame:
        sig = [_signature(h) for h in found]
        return pd.DataFrame({"doc_id": b["doc_id"], "n": list(map(len, found)), "a": [s[0] for s in sig], "b": [s[1] for s in sig]})

    def counted(b: pd.DataFrame, found: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"a": [_signature(h)[0] for h in found], "hs": [h[h % np.uint64(8) < np.uint64(COUNTED)].view(np.int64) for h in found]})

    def checked(b: pd.DataFrame, found: list[np.ndarray]) -> pd.DataFrame:
        same = [_signature(h) == (x, y) for h, x, y in zip(found, b["a"], b["b"])]
        return pd.DataFrame({"a": b["a"], "n": b["n"], "hashes": [h.view(np.int64) for h in found]})[same]

    info = stored(_hashed(texts, width, f"doc_id {kind}, n long, a long, b long", described))
    classes = stored(info.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("first")))
    alone = (
        _hashed(texts, width, "a long, hs array<long>", counted).select("a", F.explode("hs").alias("h"))
        .groupBy("h").agg(F.min("a").alias("a"), F.max("a").alias("other")).where("a = other")
        .groupBy("a").agg(F.count("*").alias("alone"))
    )
    left = stored(
        classes.where("first is not null").join(alone, "a", "left")
        .where(F.coalesce("alone", F.lit(0)) <= F.col("n") - needed(F.col("n"), percent)).select("a", "b", "n", F.col("first").alias("doc_id"))
    )
    # always the same join: texts move once, whatever share of them is left
    sets = stored(_hashed(texts.join(left.hint("merge"), "doc_id"), width, "a long, n long, hashes array<long>", checked))
    roots = stored(components(links(sets, percent)))
    named = stored(classes.join(roots, F.col("a") == F.col("node"), "left").withColumn("root", F.coalesce("root", "a")).select("a", "b", "root", "first"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = stored(named.join(least, "root").select("a", "b", "component_id"))
    return info.join(known, ["a", "b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
