"""A stored inverted index with block bounds, and exact top-k that skips blocks.

Chunks are numbered in the order of (path, idx): a folder, a note and hence every scope is
an interval of numbers. The index has three tables.

`docs`     doc, path, idx, heading, content, mtime, partitioned by range of numbers
`folders`  prefix, lo, hi, n: the interval of every folder and path, and the chunks in it
`blocks`   token, stripe, n, best, first, last, at, impact: a token's postings in STRIPE successive
           numbers (place in the stripe, impact), with the highest impact among them, in one
           row or a few of disjoint places first..last; in files of successive stripes, written
           where the chunks are read and never shuffled

A search reads the narrow columns of `blocks` first. They give document frequencies (of a
scope, too: only blocks that a scope's border cuts are opened) and a bound for every query
and stripe: the sum of the tokens' weights times the block's highest impact. The stripes
with the highest bounds are opened first; their k-th score is what any other stripe's bound
has to reach to be opened at all. An open stripe is a matrix of tokens by places, a group of
queries one of queries by tokens, and their product is the scores. Texts are read for the
winners alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.functions import text as X
from corpusloom.functions.scale import small_side, top_per_key
from corpusloom.functions.storage import save, temporary
from corpusloom.operators import paths as P
from corpusloom.operators.retrieval import idf, tf_norm

FORMAT = 4  # of the tables; a kept index of another format is not opened
STRIPE = 512
SEEDS = 8  # stripes of a query that are opened first
QUERY_GROUP, TOKEN_GROUP = 256, 4096  # of one product: queries, and tokens at once
FRAGMENT_TOKENS, FRAGMENT_ROWS = 2_000_000, 64  # of a stripe that are put together at once, at most; rows taken at a time
FRAGMENT = "token string, stripe long, n long, best double, first int, last int, at array<int>, impact array<double>"
DOCS = "path string, idx int, heading string, content string, mtime long, doc long, part long"
PART_BITS = 33  # numbers are (part, place in part)
SLACK = 1e-6  # sums that differ by the order of addition never drop a block
TIE = 2e-9  # scores are ranked after rounding to nine digits


class LexicalIndex(NamedTuple):
    docs: DataFrame
    folders: DataFrame | None
    blocks: DataFrame | None


def write_index(chunks: DataFrame, root: str) -> None:
    """Write the index of (path, idx, heading, content, mtime) below `root`."""
    write_docs(chunks, root)
    write_postings(_docs(chunks.sparkSession, root), root)


def write_docs(chunks: DataFrame, root: str) -> None:
    """Number the chunks: the table `docs`, all that a search by vectors reads."""
    rows = chunks.select("path", F.col("idx").cast("int").alias("idx"), "heading", "content", F.col("mtime").cast("long").alias("mtime")).repartitionByRange("path", "idx").sortWithinPartitions("path", "idx")
    rows = rows.withColumn("doc", F.monotonically_increasing_id())
    save(rows.withColumn("part", F.shiftright("doc", PART_BITS)), f"{root}/docs", "part")


def write_postings(docs: DataFrame, root: str) -> None:
    """The tables `folders` and `blocks` of numbered chunks."""
    one = F.array(F.struct(F.col("path").alias("prefix"), F.lit(True).alias("is_path")))
    above = F.transform(F.concat(F.array(F.lit("")), P.ancestors(F.col("path"))), lambda f: F.struct(f.alias("prefix"), F.lit(False).alias("is_path")))
    per_path = docs.groupBy("path").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count("*").alias("n"))
    folders = per_path.select(F.explode(F.concat(one, above)).alias("f"), "lo", "hi", "n").groupBy("f.prefix", "f.is_path")
    save(folders.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")), f"{root}/folders")
    # files hold chunks by number: a row per token and stripe, and one more where a task or a run ends inside a stripe
    save(_fragments(docs.select("doc", X.tokenize(F.col("content")).alias("t"))), f"{root}/blocks")


def _fragments(tokens: DataFrame) -> DataFrame:
    """Postings of (doc, t), a row per token and run of chunks of one stripe that follow each
    other in a task. A run ends after FRAGMENT_TOKENS tokens, so memory is bounded."""
    stripe, most = STRIPE, FRAGMENT_TOKENS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at = [], 0, None
        for batch in batches:
            of = batch.column("doc").to_numpy() // stripe
            ends = np.append(np.flatnonzero(np.diff(of)) + 1, len(of))
            for lo, hi in zip(np.append(0, ends[:-1]), ends):
                for start in range(lo, hi, FRAGMENT_ROWS):
                    part = batch.slice(start, min(FRAGMENT_ROWS, hi - start))
                    if held and (of[lo] != at or size >= most):
                        yield _fragment(held, stripe)
                        held, size = [], 0
                    held, size, at = [*held, part], size + len(part.column("t").flatten()), of[lo]
        if held:
            yield _fragment(held, stripe)

    return tokens.mapInArrow(run, FRAGMENT)


def _fragment(held: list[pa.RecordBatch], stripe: int) -> pa.RecordBatch:
    """The postings of some chunks of one stripe."""
    doc = np.concatenate([b.column("doc").to_numpy() for b in held])
    length = np.concatenate([pc.fill_null(pc.list_value_length(b.column("t")), 0).to_numpy(zero_copy_only=False) for b in held])
    words = pa.chunked_array([b.column("t").flatten() for b in held]).combine_chunks().dictionary_encode()
    sort = pc.sort_indices(words.dictionary).to_numpy()  # tokens ascend: they take less space
    of_token = np.empty(len(sort), np.int64)
    of_token[sort] = np.arange(len(sort))
    row = np.repeat(np.arange(len(doc)), length)
    order = np.argsort(doc, kind="stable")  # places ascend within a token
    place = np.empty(len(doc), np.int64)
    place[order] = np.arange(len(doc))
    key, tf = np.unique(of_token[words.indices.to_numpy()] * len(doc) + place[row], return_counts=True)
    code, row = key // max(1, len(doc)), order[key % max(1, len(doc))]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    impact = tf_norm(tf.astype(np.float64), length[row])
    ends = np.append(first, len(key)).astype(np.int32)
    n = np.diff(ends).astype(np.int64)
    at = (doc[row] % stripe).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (at, impact)]
    best = np.maximum.reduceat(impact, first) if len(key) else impact
    return pa.RecordBatch.from_arrays(
        [words.dictionary.take(pa.array(sort[code[first]])), pa.array(np.full(len(first), doc[0] // stripe)), pa.array(n), pa.array(best), pa.array(at[first]), pa.array(at[ends[1:] - 1]), *lists],
        ["token", "stripe", "n", "best", "first", "last", "at", "impact"],
    )


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DOCS).parquet(f"{root}/docs")


def open_index(spark: SparkSession, root: str, postings: str | None = None) -> LexicalIndex:
    """`postings` is where `write_postings` wrote, if that is another place."""
    postings = postings or root
    blocks = spark.read.schema(FRAGMENT).parquet(f"{postings}/blocks")
    numbers = {to: F.col("stripe") * STRIPE + F.col(place) for to, place in (("lo", "first"), ("hi", "last"))}
    return LexicalIndex(_docs(spark, root), spark.read.parquet(f"{postings}/folders"), blocks.withColumns(numbers))


def open_docs(spark: SparkSession, root: str) -> LexicalIndex:
    """What `write_docs` wrote, for searches that need no postings."""
    return LexicalIndex(_docs(spark, root), None, None)


def scope_ranges(scopes: DataFrame, folders: DataFrame) -> DataFrame:
    """(scope_id, from, to, n): the disjoint intervals of (scope_id, prefix) rows. Intervals of
    folders are nested or apart, so those inside another of the same scope go."""
    found = scopes.join(folders, "prefix").select("scope_id", F.col("lo").alias("from"), F.col("hi").alias("to"), "n").distinct()
    a, b = found.alias("a"), found.alias("b")
    inside = (
        (F.col("a.scope_id") == F.col("b.scope_id")) & (F.col("a.from") >= F.col("b.from")) & (F.col("a.to") <= F.col("b.to"))
        & ((F.col("a.from") > F.col("b.from")) | (F.col("a.to") < F.col("b.to")))
    )
    return a.join(b, inside, "left_anti")


def _overlap() -> Column:
    return (F.col("lo") <= F.col("to")) & (F.col("hi") >= F.col("from"))


def top_docs(q_tokens: DataFrame, scopes: DataFrame, index: LexicalIndex, k: int, seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, doc, score) of the k best chunks of each query. `q_tokens` is
    (query_id, scope_id, token, times), `scopes` is (scope_id, prefix), where the empty
    prefix means everything."""
    kind = q_tokens.schema["query_id"].dataType.simpleString()
    q_tokens = temporary(q_tokens)
    ranges = temporary(scope_ranges(scopes, index.folders))
    vocabulary = small_side(q_tokens.select("scope_id", "token").distinct())
    met = index.blocks.select("token", "stripe", "n", "best", "lo", "hi").join(vocabulary, "token").join(ranges.drop("n"), "scope_id").where(_overlap())
    whole = (F.col("lo") >= F.col("from")) & (F.col("hi") <= F.col("to"))
    # only stripes with an end of an interval have blocks that a border cuts
    ends = F.explode(F.expr(f"array(`from` div {STRIPE}, `to` div {STRIPE})"))
    ends = small_side(ranges.select(ends.alias("stripe")).distinct())
    cut = (
        met.where(~whole).select("scope_id", "token", "stripe", "lo", "best", "from", "to").join(ends, "stripe", "left_semi")
        .join(index.blocks.select("token", "stripe", "lo", "at").join(ends, "stripe", "left_semi"), ["token", "stripe", "lo"])
        .withColumn("n", F.size(F.expr(f"filter(at, a -> stripe * {STRIPE} + a between from and to)")).cast("long"))
    )
    cols = ["scope_id", "token", "stripe", "lo", "n", "best"]
    hits = temporary(met.where(whole).select(*cols).unionByName(cut.select(*cols)).where("n > 0"))
    df = hits.groupBy("scope_id", "token").agg(F.sum("n").alias("df"))
    sizes = ranges.groupBy("scope_id").agg(F.sum("n").alias("size"), F.collect_list("from").alias("froms"), F.collect_list("to").alias("tos"))  # of one query's scope
    weights = q_tokens.join(df, ["scope_id", "token"]).join(sizes.select("scope_id", "size"), "scope_id").select(
        "query_id", "scope_id", "token", (F.col("times") * idf(F.col("size"), F.col("df"))).alias("w")
    )
    asked = weights.groupBy("query_id", "scope_id").agg(F.collect_list(F.struct("token", "w")).alias("t"))  # of one query's text
    asked = temporary(asked.join(sizes, "scope_id").select("query_id", "scope_id", F.col("t.token").alias("tokens"), F.col("t.w").alias("ws"), "froms", "tos"))
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    # one group goes to every task; else a query's tokens would move once for each of its stripes
    texts = asked.where("query_id is not null").toPandas() if groups == 1 else None
    weighed = asked.select("query_id", "scope_id", F.explode(F.arrays_zip("tokens", "ws")).alias("t")).select("query_id", "scope_id", F.col("t.tokens").alias("token"), F.col("t.ws").alias("w"))
    bound = temporary(
        hits.select("scope_id", "token", "stripe", "lo", "best").distinct().join(weighed, ["scope_id", "token"])
        .groupBy("query_id", "stripe").agg(F.sum(F.col("w") * F.col("best")).alias("bound"))
        .withColumn("g", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
    )

    def best(blocks: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        """The k best of one stripe for a group of queries."""
        if texts is not None and len(asking):
            asking = asking.merge(texts, on="query_id")
        if not len(asking):
            return pd.DataFrame({"query_id": asking["query_id"], "doc": np.zeros(0, np.int64), "score": np.zeros(0)})
        rows_of = blocks.groupby("token").indices  # a few rows where a task ended inside the stripe
        found = np.zeros((len(asking), STRIPE))
        who, token, w = [], [], []
        for i, (tokens, ws) in enumerate(zip(asking["tokens"], asking["ws"])):
            for t, x in zip(tokens, ws):
                for r in rows_of.get(t, ()):
                    who.append(i), token.append(r), w.append(x)
        who, token, w = np.array(who, int), np.array(token, int), np.array(w)
        for start in range(0, len(blocks), TOKEN_GROUP):
            some = blocks.iloc[start:start + TOKEN_GROUP]
            impact = np.zeros((len(some), STRIPE))
            impact[np.repeat(np.arange(len(some)), some["at"].map(len)), np.concatenate(some["at"].to_list())] = np.concatenate(some["impact"].to_list())
            here = (token >= start) & (token < start + len(some))
            of_query = np.zeros((len(asking), len(some)))
            of_query[who[here], token[here] - start] = w[here]
            found += of_query @ impact
        doc = int(asking["stripe"].iloc[0]) * STRIPE + np.arange(STRIPE)
        least = asking["least"].fillna(-np.inf).to_numpy() - TIE
        rows, places = [], []
        for i, (froms, tos) in enumerate(zip(asking["froms"], asking["tos"])):
            inside = np.zeros(STRIPE, bool)
            for lo, hi in zip(froms, tos):
                inside |= (doc >= lo) & (doc <= hi)
            at = np.nonzero(inside & (found[i] > 0) & (found[i] >= least[i]))[0]
            if len(at) > k:
                at = at[found[i, at] >= np.partition(found[i, at], len(at) - k)[len(at) - k] - TIE]
            rows.append(np.full(len(at), i)), places.append(at)
        r, c = np.concatenate(rows), np.concatenate(places)
        return pd.DataFrame({"query_id": asking["query_id"].to_numpy()[r], "doc": doc[c], "score": found[r, c]})

    def opened(stripes: DataFrame) -> DataFrame:
        """(query_id, doc, score) of the best chunks in these stripes (query_id, g, stripe, least)."""
        stripes = temporary(stripes.select("query_id", "g", "stripe", "least").where("query_id is not null"))
        needed = index.blocks.select("token", "stripe", "at", "impact").join(vocabulary.select("token").distinct(), "token", "left_semi")
        pairs = small_side(stripes.select(F.col("stripe").alias("_s"), F.col("g").alias("_g")).distinct())
        needed = needed.join(pairs, F.col("stripe") == F.col("_s")).drop("stripe")
        asking = stripes if texts is not None else stripes.join(asked, "query_id")
        return needed.groupBy("_s", "_g").cogroup(asking.groupBy("stripe", "g")).applyInPandas(best, f"query_id {kind}, doc long, score double")

    best_first = [F.round("score", 9).desc(), F.col("doc")]
    first = temporary(top_per_key(bound, ["query_id"], [F.col("bound").desc(), F.col("stripe")], seeds, "_place").drop("_place"))
    seen = temporary(top_per_key(opened(first.withColumn("least", F.lit(None).cast("double"))), ["query_id"], best_first, k))
    least = seen.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = (
        bound.join(first.select("query_id", "stripe"), ["query_id", "stripe"], "left_anti").join(least, "query_id", "left")
        .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))
    )
    return top_per_key(seen.drop("rank").unionByName(opened(rest)), ["query_id"], best_first, k)


def with_docs(top: DataFrame, index: LexicalIndex, *cols: str, few: bool = False) -> DataFrame:
    """The columns of ranked chunks. Only the parts with winners are read where there are
    `few`, that is where their number is bounded and small."""
    t = top.withColumn("part", F.shiftright("doc", PART_BITS))
    return index.docs.select("part", "doc", *cols).join(F.broadcast(t) if few else t, ["part", "doc"]).drop("part")
