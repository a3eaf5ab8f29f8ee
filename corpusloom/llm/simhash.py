"""Near duplicates by SimHash with bit-sliced comparison.

Fingerprints: 64 bits over the XXH64 (seed 42) of all three-word shingles of a text. Two
fingerprints link when they differ in RADIUS bits or fewer.

Documents with equal fingerprints are one class from the start, represented by the smallest
doc_id; only distinct fingerprints are compared. The 64 bits are cut into BLOCKS parts. Two
fingerprints within RADIUS agree in at least BLOCKS - RADIUS parts, so every fingerprint
goes once to each choice of that many parts, and those that agree there meet in a bucket.
In a bucket only RADIUS parts vary: it holds at most 2^(RADIUS * 64 / BLOCKS) = 65,536
distinct fingerprints, half a megabyte, whatever the data are.

Inside a bucket the comparison is bit-sliced. 64 fingerprints form a block that is stored
as bit planes: word b holds bit b of all 64. A query is compared with a whole block at
once: its difference planes are added to vertical counters with carry-save steps (ones,
twos, and a sticky plane for more), and a block is abandoned as soon as all of its counters
exceed the radius. Planes that are the same for the whole bucket are skipped.

A bucket returns no pairs but a forest: each member with the smallest representative it
reaches there. Components over all buckets follow by star contraction.

Defined cases: a text of fewer than three words is one shingle of all its words; a null or
wordless text has fingerprint zero, which links like any other; equal rows are one class;
rows with a null id get the component of their fingerprint, are never its name, and a
fingerprint that only such rows have forms no links and has a null component; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import fresh, stored
from corpusloom.llm.graph import components

SHINGLE, SEED = 3, 42
RADIUS, BLOCKS = 2, 8
CHUNK_SHINGLES = 1 << 18  # hashes held at once, of however long a text
CHUNK_PAIRS = 1 << 19  # (query, block) pairs compared at once
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE_AT = (np.arange(8) * 256).astype(np.int64)
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(SHINGLE, len(ws))
    n = len(ws) - width + 1
    starts, ends = starts[:n].tolist(), ends[width - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK_SHINGLES):
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[i:i + CHUNK_SHINGLES], ends[i:i + CHUNK_SHINGLES])), np.uint64)
        cells = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
        ones += (cells @ _BITS).ravel()
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))[ones * 2 > n]).sum(dtype=np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed 64 bits)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.fromiter(map(fingerprint, b["t"]), np.int64, len(b))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(
        run, f"doc_id {kind}, fp long"
    )


def _planes(lanes: np.ndarray) -> np.ndarray:
    """Bit planes of blocks of 64 fingerprints: [64 planes, blocks]."""
    out = np.empty((64, lanes.size // 64), np.uint64)
    for b in range(64):
        bit = ((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[b] = np.packbits(bit, bitorder="little").view(np.uint64)
    return out


def near(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, of one group whose fingerprints differ in at most `radius`
    (up to 2) bits. `group` is ascending."""
    sizes = np.bincount(group) if group.size else np.zeros(0, np.int64)
    sizes = sizes[sizes > 0]
    blocks = -(-sizes // 64)
    first_block = np.cumsum(blocks) - blocks
    dense = np.repeat(np.arange(sizes.size), sizes)
    rank = np.arange(fps.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = first_block[dense] * 64 + rank
    lanes = np.zeros(int(blocks.sum()) * 64, np.uint64)
    lanes[slot] = fps
    index = np.full(lanes.size, -1, np.int64)
    index[slot] = np.arange(fps.size)
    valid = np.packbits((index >= 0).astype(np.uint8), bitorder="little").view(np.uint64)
    planes = _planes(lanes)
    # a query meets the blocks of its group from its own block on: the other half is the same pairs
    own = first_block[dense] + rank // 64
    todo = first_block[dense] + blocks[dense] - own
    starts = np.concatenate([[0], np.cumsum(todo)])
    left, right = [], []
    i = 0
    while i < fps.size:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + CHUNK_PAIRS, side="right")) - 1)
        n = todo[i:j]
        q = np.repeat(np.arange(i, j), n)
        blk = np.repeat(own[i:j], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        one = np.zeros(q.size, np.uint64)
        two, more = one.copy(), ~valid[blk]
        for b in range(64):
            want = np.where((fps[q] >> np.uint64(b)) & np.uint64(1), ALL, np.uint64(0))
            diff = planes[b][blk] ^ want
            carry = one & diff
            one ^= diff
            more |= two & carry  # four or more
            two ^= carry
            if b % 4 == 3:
                alive = (more | (two & one if radius == 2 else two | (one if radius == 0 else np.uint64(0)))) != ALL
                if not alive.all():
                    q, blk, one, two, more = q[alive], blk[alive], one[alive], two[alive], more[alive]
                    if not q.size:
                        break
        if q.size:
            over = more | (two & one if radius == 2 else two | (one if radius == 0 else np.uint64(0)))
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            a, b2 = q[row], index[blk[row] * 64 + lane]
            keep = a < b2
            left.append(a[keep])
            right.append(b2[keep])
        i = j
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, a: np.ndarray, b: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each of n members the smallest name reachable over the links (a, b)."""
    label = name.copy()
    order = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        # follow the member that carries the label, so that chains halve
        where = pd.Series(order, index=name)
        low = np.minimum(low, low[where.loc[low].to_numpy()])
        if (low == label).all():
            return low
        label = low


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between representatives that connect what links at `radius`, from a
    table (fp, rep) of distinct fingerprints."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    buckets = (
        distinct.where("rep is not null").select("fp", "rep", F.explode(keys).alias("k"))
        .groupBy("k.choice", "k.key")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("m"))  # at most 2^16 members, see above
        .where(F.size("m") > 1)
        .select(F.col("m.fp").alias("fp"), F.col("m.rep").alias("rep"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            start = 0
            sizes = batch["fp"].map(len).to_numpy()
            while start < len(batch):  # some whole buckets at a time
                total = np.cumsum(sizes[start:])
                stop = start + max(1, int(np.searchsorted(total, 1 << 16, side="right")))
                fp = np.concatenate(batch["fp"].iloc[start:stop].to_list()).astype(np.int64).view(np.uint64)
                rep = np.concatenate(batch["rep"].iloc[start:stop].to_list()).astype(np.int64)
                group = np.repeat(np.arange(stop - start), sizes[start:stop])
                a, b = near(fp, group, radius)
                # a representative may be in several buckets: one forest over all of them is still right
                names, at = np.unique(rep, return_inverse=True)
                root = forest(names.size, at[a], at[b], names)
                moved = root != names
                yield pd.DataFrame({"a": names[moved], "b": root[moved]})
                start = stop

    return buckets.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row."""
    fps = stored(fingerprints(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")))
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(distinct, radius))
    classes = stored(
        distinct.join(roots, distinct["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    )
    return fps.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id, with all its columns. Rows
    that repeat this id stay (all of them, when any stands for its group); rows with a null
    id stay, as no id tells them apart."""
    found = near_duplicates(docs, radius, id_col, text_col)
    lost = fresh(docs, "_gone")
    gone = stored(
        found.where("doc_id is not null").groupBy(F.col("doc_id").alias(lost))
        .agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stands")).where("not stands").select(lost)
    )
    return docs.join(gone, F.col(id_col).cast("long") == F.col(lost), "left_anti")
