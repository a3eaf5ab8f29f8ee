"""A stored vector index with bounds, and exact top-k that skips blocks.

Vectors are dealt to the nearest of a few centroids, fitted on a bounded sample, and within
a cell to blocks of about BLOCK_ROWS. A block is one row: its own centre (the mean of its
vectors), its radius (the distance of the farthest) and the vectors. No vector x of a block
scores more than q.centre + |q| * radius against a query q.

A search reads centres and radii first. The blocks with the highest bounds of a query are
opened, their k-th score is what the bound of any other block has to reach, and only those
are opened then. The sample decides how many blocks are skipped, never what is found.

Up to QUERY_GROUP queries go to every task and blocks are read where they lie. More queries
meet centres in groups of bounded size, and blocks by the shelf, many blocks to a task: a query
goes once to a shelf of which it wants any block, not once to each block. Memory depends
neither on the number of rows nor on the number of shuffle partitions.

Hashed n-gram vectors are small whole numbers divided by their norm. A vector of floats that
is found to be that, number by number, is kept and moved as those numbers, one or two bytes
each, and reads back as the very same floats; any other is kept as given.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.functions.scale import materialize, top_per_key
from corpusloom.functions.storage import remove, save

FORMAT = 3  # of the tables; a kept index of another format is not opened
SAMPLE = 20_000  # vectors that centroids are fitted on, drawn at random
MAX_CELLS, ROUNDS = 1024, 8
BLOCK_ROWS = 1024
QUERY_GROUP, CENTRE_GROUP = 2048, 1024
WHOLE_ROWS, WHOLE_MOST = 1024, 65_535  # vectors that are tried as whole numbers at once, and the highest of these
SHELF_BLOCKS, SHELVES = 64, 48  # blocks that a task opens, and how many tasks there are at least
OPEN_GROUP, OPEN_RESULTS = 65_536, 2_000_000  # queries, and results of theirs, that a task holds
SEEDS = 4  # blocks of a query that are opened first
TIE = 2e-9  # scores are ranked after rounding to nine digits


class VectorIndex(NamedTuple):
    blocks: DataFrame  # block, n, centre, radius, members array<struct<path, idx, vec>>, whole, width: a member without vec is a row of `whole`
    n_blocks: int


def centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of the sample."""
    at = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        near = _nearest(sample, at)
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=len(at))
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at


def _nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    half = (at * at).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[lo:lo + CENTRE_GROUP] @ at.T - half, axis=1) for lo in range(0, max(1, len(x)), CENTRE_GROUP)])


def _matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.to_list()).astype(np.float64)


def _unit(whole: np.ndarray) -> np.ndarray:
    """Unit vectors of floats, calculated as `hashing.ngram_vector` does; sums are exact."""
    n = whole.astype(np.float64)
    norm = np.sqrt((n * n).sum(axis=1, keepdims=True))
    return (n / np.where(norm > 0, norm, 1)).astype(np.float32)


def _whole(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers behind rows of floats, and which rows they give back exactly. Two of
    the numbers of a vector mostly differ by one, and the least step between floats is that."""
    rows = np.sort(vecs.astype(np.float64), axis=1)
    with np.errstate(all="ignore"):
        step = np.diff(rows, axis=1, prepend=0.0)
        most = np.rint(rows[:, -1] / np.where(step > 0, step, np.inf).min(axis=1))
        n = np.rint(vecs * np.where(rows[:, -1] > 0, most / rows[:, -1], 0)[:, None])
    fits = ((n >= 0) & (n <= WHOLE_MOST)).all(axis=1)
    n = np.where(fits[:, None], n, 0)
    return n, fits & (_unit(n) == vecs).all(axis=1)


def _lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, idx, vec) as (path, idx, vec, whole, width): one of vec and whole is null,
    width is the bytes of a whole number or 0. Rows without a vector go."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("vec")))
        for lo in range(0, batch.num_rows, WHOLE_ROWS):
            some = batch.slice(lo, WHOLE_ROWS)
            vec, n = some.column("vec"), some.num_rows
            flat, whole, width = vec.flatten(), [None] * n, np.zeros(n, np.int32)
            if pa.types.is_float32(flat.type) and len(flat) and pc.count_distinct(pc.list_value_length(vec)).as_py() == 1:
                numbers, fits = _whole(flat.to_numpy(zero_copy_only=False).reshape(n, -1))
                width[fits] = np.where(numbers[fits].max(axis=1) < 256, 1, 2)
                for i in np.flatnonzero(fits):
                    whole[i] = numbers[i].astype(f"<u{width[i]}").tobytes()
            given = vec.take(pa.array(np.arange(n), mask=width > 0))
            yield pa.RecordBatch.from_arrays([some.column("path"), some.column("idx"), given, pa.array(whole, pa.binary()), pa.array(width)], ["path", "idx", "vec", "whole", "width"])


def _vectors(vecs, whole, width) -> np.ndarray:
    """The vectors of rows that `_lean` made, in 64 bits."""
    width, parts = np.asarray(width), []
    for w in (0, 1, 2):
        at = np.flatnonzero(width == w)
        if len(at):
            parts.append((at, np.stack([vecs[i] for i in at]) if w == 0 else _unit(np.frombuffer(b"".join(whole[i] for i in at), f"<u{w}").reshape(len(at), -1))))
    out = np.empty((len(width), parts[0][1].shape[1]))
    for at, part in parts:
        out[at] = part
    return out


def write_vectors(vectors: DataFrame, root: str, block_rows: int = BLOCK_ROWS) -> None:
    """Write the index of (path, idx, vec) below `root`. All vectors have the same length; they
    are read once, and two copies of the stored rows exist at a time."""
    spark, kind = vectors.sparkSession, vectors.schema["vec"].dataType.simpleString()
    lean = f"path string, idx int, vec {kind}, whole binary, width int"
    save(vectors.select("path", F.col("idx").cast("int").alias("idx"), "vec").mapInArrow(_lean, lean), f"{root}/rows")
    rows = spark.read.schema(lean).parquet(f"{root}/rows")
    n, bits = rows.count(), np.float32 if kind == "array<float>" else np.float64

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"n": [len(b)], "x": [_vectors(b["vec"], b["whole"], b["width"]).astype(bits).tobytes()]})

    # drawn where the rows are: ordering by a hash would send SAMPLE rows of every task to the driver
    drawn = rows.select("vec", "whole", "width").sample(min(1.0, 1.1 * SAMPLE / max(1, n)), seed=1).limit(SAMPLE).mapInPandas(plain, "n int, x binary").collect()
    drawn = [np.frombuffer(r["x"], bits).reshape(r["n"], -1) for r in drawn]
    sample = np.concatenate(drawn) if drawn else None
    del drawn  # one copy in the driver is enough
    at = centroids(sample, max(1, min(MAX_CELLS, -(-n // block_rows)))) if sample is not None else np.zeros((1, 1))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=_nearest(_vectors(b["vec"], b["whole"], b["width"]).astype(bits), at)) if len(b) else b.assign(cell=0)

    save(rows.mapInPandas(dealt, f"{lean}, cell long"), f"{root}/cells")
    remove(spark, f"{root}/rows")
    celled = spark.read.schema(f"{lean}, cell long").parquet(f"{root}/cells")
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).alias("parts"))
    placed = celled.join(F.broadcast(parts), "cell")  # at most MAX_CELLS rows
    placed = placed.withColumn("block", F.xxhash64("cell", F.pmod(F.xxhash64("path", "idx"), F.col("parts"))))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        m = _vectors(group["vec"], group["whole"], group["width"])
        centre = m.mean(axis=0)
        radius = float(np.sqrt(((m - centre) ** 2).sum(axis=1).max()))
        width = int(group["width"].max())
        return pd.DataFrame([{
            "block": group["block"].iloc[0], "n": len(group), "centre": centre, "radius": radius,
            "members": [{"path": p, "idx": i, "vec": v} for p, i, v in zip(group["path"], group["idx"], group["vec"])],
            "whole": b"".join(np.frombuffer(x, f"<u{w}").astype(f"<u{width}").tobytes() for x, w in zip(group["whole"], group["width"]) if w), "width": width,
        }])

    schema = f"block long, n int, centre array<double>, radius double, members array<struct<path:string,idx:int,vec:{kind}>>, whole binary, width int"
    save(placed.groupBy("block").applyInPandas(packed, schema), f"{root}/blocks")
    remove(spark, f"{root}/cells")


def open_vectors(spark: SparkSession, root: str) -> VectorIndex:
    blocks = spark.read.parquet(f"{root}/blocks")
    return VectorIndex(blocks, blocks.count())


def _bounds(centres: pd.DataFrame, asked: pd.DataFrame) -> np.ndarray:
    """[query, block]"""
    q = _matrix(asked["vec"])
    return q @ _matrix(centres["centre"]).T + np.sqrt((q * q).sum(axis=1))[:, None] * centres["radius"].to_numpy()


def _best_k(r: np.ndarray, score: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Which results (row r, score) are among the best k of their row, ties included; `least` of
    a row with k results rises to the last of them."""
    order = np.lexsort((-score, r))
    rows, begin, n = np.unique(r[order], return_index=True, return_counts=True)
    full = n >= k
    least[rows[full]] = np.maximum(least[rows[full]], score[order][begin[full] + k - 1] - TIE)
    return score >= least[r]


def _members(vecs, whole: bytes | None, width: int) -> np.ndarray:
    """The vectors of a block's members."""
    bare = np.array([v is None for v in vecs])
    out = np.empty((len(bare), len(next(v for v in vecs if v is not None)) if not bare.all() else len(whole) // width // len(bare)))
    if not bare.all():
        out[~bare] = np.stack([v for v in vecs if v is not None])
    if bare.any():
        out[bare] = _unit(np.frombuffer(whole, f"<u{width}").reshape(int(bare.sum()), -1))
    return out


def search(query_vectors: DataFrame, index: VectorIndex, k: int, scope=(), seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, path, idx, score): exact top-k by dot product, ties by (path, idx)."""
    kind = query_vectors.schema["query_id"].dataType.simpleString()
    n_queries = query_vectors.count()
    groups, shelves = max(1, -(-n_queries // QUERY_GROUP)), max(1, -(-index.n_blocks // CENTRE_GROUP))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = query_vectors.select("query_id", F.col("vec").cast("array<double>").alias("vec")).withColumn(
        "g", F.pmod(F.xxhash64("query_id"), F.lit(groups))
    )
    slots = max(1, -(-index.n_blocks // SHELF_BLOCKS), min(index.n_blocks, SHELVES))
    crowds = max(1, -(-n_queries // max(1, min(OPEN_GROUP, OPEN_RESULTS // k))))
    shelf_of = F.pmod(F.col("block"), F.lit(slots).cast("long"))
    held = index.blocks.select("block", "centre", "radius", F.col("members.path").alias("paths"), F.col("members.idx").alias("idxs"), F.col("members.vec").alias("vecs"), "whole", "width")
    # all centres of a shelf are in one group
    centres = index.blocks.select("block", "centre", "radius").withColumn("c", F.pmod(shelf_of, F.lit(shelves))).withColumn("g", each(groups))

    def likely(mine: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        """The `seeds` blocks with the highest bounds."""
        if not len(mine) or not len(asking):
            return pd.DataFrame({"query_id": asking["query_id"].iloc[:0], "g": [], "block": [], "bound": []})
        bound = _bounds(mine, asking)
        best = np.argsort(-bound, axis=1, kind="stable")[:, :seeds]
        rows = np.repeat(np.arange(len(asking)), best.shape[1])
        return pd.DataFrame({
            "query_id": asking["query_id"].to_numpy()[rows], "g": asking["g"].to_numpy()[rows], "block": mine["block"].to_numpy()[best.ravel()],
            "bound": np.take_along_axis(bound, best, axis=1).ravel(),
        })

    def unopened(mine: pd.DataFrame, asking: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) of the blocks not yet opened whose bound reaches the k-th score."""
        r, c = np.nonzero(_bounds(mine, asking) >= asking["least"].fillna(-np.inf).to_numpy()[:, None] - 1e-9)
        block = mine["block"].to_numpy()[c]
        new = np.fromiter((b not in o for b, o in zip(block, asking["opened"].to_numpy()[r])), bool, len(block))
        return r[new], block[new]

    def reaching(mine: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        """The shelves of those blocks."""
        if not len(mine) or not len(asking):
            return pd.DataFrame({"query_id": asking["query_id"].iloc[:0], "shelf": []})
        r, block = unopened(mine, asking)
        r, shelf = np.divmod(np.unique(r * slots + block % slots), slots)
        return pd.DataFrame({"query_id": asking["query_id"].to_numpy()[r], "shelf": shelf})

    def reached(mine: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        """Those blocks alone."""
        return pd.DataFrame({"block": np.unique(unopened(mine, asking)[1]) if len(mine) and len(asking) else []})

    def best(shelf: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        """The best k of some blocks for a group of queries: of the blocks a query names, or else
        of those that reach its k-th score and were not opened before."""
        none = pd.DataFrame({"query_id": asking["query_id"].iloc[:0], "path": np.array([], object), "idx": np.array([], np.int32), "score": np.zeros(0)})
        if not len(shelf) or not len(asking):
            return none
        q, known = _matrix(asking["vec"]), asking["least"].astype(float).fillna(-np.inf).to_numpy()
        norm, least = np.sqrt((q * q).sum(axis=1)), known - TIE
        first = asking["wanted"].notna().iloc[0]
        named = asking["wanted" if first else "opened"].to_list()
        owner, block = np.repeat(np.arange(len(asking)), [len(x) for x in named]), np.concatenate([np.asarray(x, np.int64) for x in named])
        r, path, idx, score, late = np.array([], np.int64), np.array([], object), np.array([], np.int32), np.zeros(0), []

        def gathered():
            nonlocal r, path, idx, score
            r, path, idx, score = (np.concatenate(x) for x in zip((r, path, idx, score), *late))
            late.clear()
            kept = _best_k(r, score, least, k)
            r, path, idx, score = r[kept], path[kept], idx[kept], score[kept]

        for b, centre, radius, paths, idxs, vecs, whole, width in shelf[["block", "centre", "radius", "paths", "idxs", "vecs", "whole", "width"]].itertuples(index=False):
            wants = owner[block == b]
            if not first:
                reach = q @ centre + norm * radius >= np.maximum(known, least) - 1e-9
                reach[wants] = False
                wants = np.nonzero(reach)[0]
            if not len(wants):
                continue
            inside = np.array([any(x == p or x.startswith(p + "/") for p in scope) for x in paths]) if scope else np.ones(len(paths), bool)
            if not inside.any():
                continue
            paths, idxs = np.asarray(paths, object)[inside], np.asarray(idxs, np.int32)[inside]
            matrix = _members(vecs, whole, width)[inside].T
            for at in range(0, len(wants), QUERY_GROUP):
                some = wants[at:at + QUERY_GROUP]
                found = q[some] @ matrix
                cut = least[some, None]
                if len(paths) > k and np.isneginf(cut).any():
                    cut = np.maximum(cut, np.partition(found, len(paths) - k, axis=1)[:, [len(paths) - k]] - TIE)
                i, j = np.nonzero(found >= cut)
                late.append((some[i], paths[j], idxs[j], found[i, j]))
                if sum(len(x[0]) for x in late) > OPEN_RESULTS:
                    gathered()
            gathered()
        return pd.DataFrame({"query_id": asking["query_id"].to_numpy()[r], "path": path, "idx": idx, "score": score}) if len(r) else none

    out = f"query_id {kind}, path string, idx int, score double"

    def opened(asking: DataFrame) -> DataFrame:
        """Scores of the rows (query_id, vec, shelf, least, wanted, opened)."""
        crowd = asking.withColumn("w", F.pmod(F.xxhash64("query_id"), F.lit(crowds)))
        shelved = held.withColumn("shelf", shelf_of).withColumn("w", each(crowds))
        return shelved.groupBy("shelf", "w").cogroup(crowd.groupBy("shelf", "w")).applyInPandas(best, out)

    def opened_in_place(ids: DataFrame, asking: DataFrame) -> DataFrame:
        """Scores of the same rows without shelf, few enough for every task, in blocks that no shuffle moves."""
        few = asking.toPandas()
        few["vec"] = [np.asarray(v) for v in few["vec"]]
        return held.join(F.broadcast(ids), "block", "left_semi").mapInPandas(lambda batches: (best(b, few) for b in batches), out)

    met = lambda a, fn, schema: centres.groupBy("c", "g").cogroup(a.withColumn("c", each(shelves)).groupBy("c", "g")).applyInPandas(fn, schema)
    first = materialize(top_per_key(met(asked, likely, f"query_id {kind}, g long, block long, bound double"), ["query_id"], [F.col("bound").desc(), F.col("block")], seeds, "_place"))
    order = [F.round("score", 9).desc(), F.col("path"), F.col("idx")]
    vecs, none = asked.select("query_id", "vec"), F.lit(None).cast("array<long>")
    unknown = {"least": F.lit(None).cast("double"), "opened": none}
    in_place = n_queries <= QUERY_GROUP
    if in_place:
        named = first.groupBy("query_id").agg(F.collect_list("block").alias("wanted"))  # `seeds` of a query
        found = opened_in_place(first.select("block").distinct(), named.join(vecs, "query_id").withColumns(unknown))
    else:
        named = first.groupBy("query_id", shelf_of.alias("shelf")).agg(F.collect_list("block").alias("wanted"))
        found = opened(named.join(vecs, "query_id").withColumns(unknown))
    seen = materialize(top_per_key(found, ["query_id"], order, k))
    known = asked.join(seen.where(F.col("rank") == k).select("query_id", F.col("score").alias("least")), "query_id", "left").join(
        first.groupBy("query_id").agg(F.collect_list("block").alias("opened")), "query_id"
    )
    if in_place:
        late = opened_in_place(met(known, reached, "block long").distinct(), known.drop("g").withColumn("wanted", none))
    else:
        rest = met(known, reaching, f"query_id {kind}, shelf long").join(known.drop("g"), "query_id")
        late = opened(rest.withColumn("wanted", none))
    return top_per_key(seen.drop("rank").unionByName(late), ["query_id"], order, k).select("query_id", "rank", "path", "idx", "score")
