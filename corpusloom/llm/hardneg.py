"""Hard-negative mining with Four-Russians scoring.

Vectors become integers, floor(SCALE * x). A row's score against an anchor is their integer
inner product, always whole and exact:

1. A row is packed as bit planes: plane b holds bit b of all its components in two's
   complement, eight dimensions to a byte.
2. For every group of eight dimensions an anchor has a table of its 256 subset sums, each
   the sum of a smaller subset and one component.
3. A score starts with the lookups of the sign plane, negated; plane after plane it is
   shifted left by one and the lookups of that plane's bytes are added.

Anchors and rows meet in blocks: ANCHORS anchors with their tables, ROWS rows with their
bytes, so a task holds a few megabytes at any size of the table. A first pass keeps the best
positives (rows of the anchor's label) of every block, a second the best negatives inside
the window that each positive sets; the last rankings get that many rows per block.
Anchors are a stated part of the table, so the work is anchors times rows.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take
no part; shorter vectors count as ended by zeros; ties go to the smaller id; rows that repeat
an id count each, except that no row of the anchor's id is its partner; equal anchor rows
are one anchor; anchors without positives, and positives without a negative in the window
(all with a negative score) have no rows; extra columns are ignored; an empty table gives no
rows. Components too large for exact 64-bit scores raise a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions.scale import top_per_key
from corpusloom.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
ANCHORS, ROWS = 512, 2048  # of a block
STEP = 256  # rows scored at once, so that sums stay in the processor's cache
GROUP = 8


def pack(q: np.ndarray, planes: int) -> np.ndarray:
    """Rows of integers as bytes [row, plane, group], the lowest plane first."""
    bits = ((q[:, None, :] >> np.arange(planes)[:, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def subset_sums(q: np.ndarray, kind=np.int64) -> np.ndarray:
    """[group, byte, anchor]: what the components of a byte's set bits add up to."""
    groups = q.shape[1] // GROUP
    out = np.zeros((groups, 1 << GROUP, q.shape[0]), kind)
    for g in range(groups):
        for i in range(GROUP):
            out[g, 1 << i:2 << i] = out[g, :1 << i] + q[:, g * GROUP + i]
    return out


def score(tables: np.ndarray, code: np.ndarray) -> np.ndarray:
    """[row, anchor]: inner products, from subset sums and packed rows."""
    rows, planes, groups = code.shape
    out = np.zeros((rows, tables.shape[2]), tables.dtype)
    part = np.empty((STEP, tables.shape[2]), tables.dtype)
    for at in range(0, rows, STEP):
        sums = out[at:at + STEP]
        looked = part[:len(sums)]
        for b in reversed(range(planes)):
            sums <<= 1
            for g in range(groups):
                np.take(tables[g], code[at:at + STEP, b, g], axis=0, out=looked)
                if b == planes - 1:
                    sums -= looked
                else:
                    sums += looked
    return out


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, is_anchor, q: the rows that take part, their vectors as integers."""
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return rows.where("id is not null and label is not null and vector is not null").where(
        F.forall("vector", lambda x: _finite(x.cast("double")))
    ).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), whole.alias("q"))


def _stack(q: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(q), width), np.int64)
    for i, x in enumerate(q):
        out[i, :len(x)] = x
    return out


def hard_negatives(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    anchors_in_block: int = ANCHORS, rows_in_block: int = ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from rows
    (id, label, vector array, is_anchor boolean). A negative's score lies between `low` and
    `high` percent of the positive's. Cases: see the module's text."""
    spark = rows.sparkSession
    whole = stored(integers(rows, scale))
    size = whole.agg(
        F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("q")).alias("dims"),
        F.min(F.array_min("q")).alias("least"), F.max(F.array_max("q")).alias("most"),
    ).first()
    width = -(-max(1, size["dims"] or 0) // GROUP) * GROUP
    least, most = size["least"] or 0, size["most"] or 0
    planes = 1 + max(most.bit_length(), (-least - 1).bit_length() if least < 0 else 0)
    largest = width * max(most, -least) ** 2
    if largest >= 1 << 55 or planes > 40:  # room for the percentages
        raise ValueError(f"components between {least} and {most} are too large for exact scores")
    kind = np.int32 if largest < 1 << 30 else np.int64
    groups = width // GROUP
    a_blocks, v_blocks = max(1, -(-size["anchors"] // anchors_in_block)), max(1, -(-size["n"] // rows_in_block))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            code = pack(_stack(b["q"], width), planes)
            yield pd.DataFrame({"id": b["id"], "label": b["label"], "code": [x.tobytes() for x in code]})

    codes = stored(whole.mapInPandas(packed, "id long, label long, code binary"))
    anchors = whole.where("is_anchor").select("id", "label", "q").distinct().withColumn("anchor", F.xxhash64("id", "label", "q"))
    deal = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # rows go to every block of anchors; there is one per `anchors_in_block` anchors
    dealt = codes.withColumn("v", F.pmod(F.xxhash64("id", "code"), F.lit(v_blocks))).withColumn("a", deal(a_blocks))

    def met(asked: DataFrame, best, schema: str) -> DataFrame:
        """What `best` takes from every pair of blocks."""
        asked = asked.withColumn("a", F.pmod(F.col("anchor"), F.lit(a_blocks))).withColumn("v", deal(v_blocks))
        return dealt.groupBy("a", "v").cogroup(asked.groupBy("a", "v")).applyInPandas(best, schema)

    def prepared(mine: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mine = mine.sort_values("id", kind="stable")
        code = np.frombuffer(b"".join(mine["code"]), np.uint8).reshape(len(mine), planes, groups)
        return mine["id"].to_numpy(), mine["label"].to_numpy(), code

    def of_label(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids, labels, code = prepared(mine)
        out = []
        for label, same in asked.groupby("label"):
            at = np.nonzero(labels == label)[0]
            got = score(subset_sums(_stack(same["q"], width), kind), code[at])
            order = np.argsort(-got, axis=0, kind="stable")
            for j, (anchor, own) in enumerate(zip(same["anchor"], same["id"])):
                first = order[:, j]
                first = first[ids[at[first]] != own][:positives]
                out.append(pd.DataFrame({"anchor": anchor, "positive_id": ids[at[first]], "score": got[first, j].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "positive_id": [], "score": []})

    def other_labels(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        ids, labels, code = prepared(mine)
        out = []
        if len(asked):
            got = score(subset_sums(_stack(asked["q"], width), kind), code)
            order = np.argsort(-got, axis=0, kind="stable")
        for j, (anchor, own, label, pos) in enumerate(zip(asked["anchor"], asked["id"], asked["label"], asked["positives"])):
            ranked = order[:, j]
            ranked = ranked[(labels[ranked] != label) & (ids[ranked] != own)]
            falling = -got[ranked, j].astype(np.int64) * 100
            for place, p in enumerate(pos):
                start, stop = np.searchsorted(falling, -high * p, "left"), np.searchsorted(falling, -low * p, "right")
                taken = ranked[start:min(stop, start + negatives)]
                if len(taken):
                    out.append(pd.DataFrame({"anchor": anchor, "place": place, "negative_id": ids[taken], "score": got[taken, j].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"anchor": [], "place": [], "negative_id": [], "score": []})

    best_first = [F.col("score").desc()]
    near = top_per_key(met(anchors, of_label, "anchor long, positive_id long, score long"), ["anchor"], [*best_first, F.col("positive_id")], positives)
    near = stored(near.select("anchor", (F.col("rank") - 1).alias("place"), "positive_id", F.col("score").alias("positive_score")))
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # `positives` of them
    asked = anchors.join(windows, "anchor").withColumn("positives", F.col("p.positive_score")).drop("p")
    far = top_per_key(
        met(asked, other_labels, "anchor long, place int, negative_id long, score long"), ["anchor", "place"],
        [*best_first, F.col("negative_id")], negatives,
    )
    return far.join(near, ["anchor", "place"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")
    )
