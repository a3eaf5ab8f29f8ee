"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    score(x) = sigmoid(b + <w, x> + 1/2 * sum_f ((sum_i V[i,f] x_i)^2 - sum_i V[i,f]^2 x_i^2))

The pairwise interactions of all features cost one pass over them, by the sum-of-squares
identity on the right.

Features of a text: its words, hashed to BUCKETS cells, with their share of the words; a
fixed number of structure statistics (character classes, word and line shapes, repetition);
as metadata, its length classes. Language, source and id are never inputs.

The model is fitted on the driver from at most MAX_ROWS labelled documents (the smallest
hashes of their ids, so the choice is the same everywhere); their features are computed on
the executors and only these are collected. Held-out documents (`held_out`) are never
fitted on. Scoring is one pass over all documents without a shuffle; the model has a fixed
size and is broadcast.

Defined cases: a null or wordless text is scored by its statistics alone; documents whose
labels disagree, and null labels, are not learnt from; without any labels, or with one class
only, the score is the share of good labels (1 without labels); repeated rows are scored
each; a null id is not held out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS, RANK = 1 << 15, 8
MAX_ROWS = 8_000
EPOCHS, BATCH, RATE, DECAY, SEED = 12, 128, 0.05, 1e-5, 7
ACCEPT = 0.7
BLOCK_WORDS = 500_000
_CACHE_WORDS = 300_000
STATS = 18
LENGTH_CLASSES = 8
WIDTH = BUCKETS + STATS + LENGTH_CLASSES

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 symbol, 6 end of sentence, 7 other punctuation, 8 not ASCII
_CLASS = np.zeros(256, np.int64)
for _chars, _k in (
    (b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\n\r\x0b\x0c", 4),
    (b"#*$%&|<>@^~=+_{}[]\\/", 5), (b"!?", 6), (b".,;:'\"()-", 7),
):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8


def held_out(doc_id: Column) -> Column:
    """The contract's fold: rows that are never learnt from. A null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        k = self[word] = zlib.crc32(word) % BUCKETS
        return k


_WORDS = _Words()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers, ascending, and their values."""
    data = (text or "").encode("utf-8", "surrogatepass")
    low = data.lower()
    ws = low.split()
    n = len(ws)
    codes = np.fromiter(map(_WORDS.__getitem__, ws), np.int64, n)
    idx, count = np.unique(codes, return_counts=True)
    size = max(1, len(data))
    classes = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9) / size if data else np.zeros(9)
    lines = low.split(b"\n")
    stats = np.zeros(STATS)
    stats[0:9] = classes
    stats[9] = idx.size / max(1, n)
    stats[10] = (codes[1:] == codes[:-1]).mean() if n > 1 else 0.0
    stats[11] = (codes[2:] == codes[:-2]).mean() if n > 2 else 0.0
    stats[12] = min(3.0, (size - n) / max(1, n) / 6)
    stats[13] = 1 - len(set(lines)) / len(lines)
    stats[14] = count.max() / n if n else 0.0
    stats[15] = min(1.0, len(lines) / max(1, n) * 4)
    stats[16] = min(1.0, sum(len(w) == 1 for w in ws) / max(1, n))
    stats[17] = float(n == 0)
    length = np.zeros(LENGTH_CLASSES)
    length[min(LENGTH_CLASSES - 1, int(np.log2(n + 1) / 2))] = 1.0
    dense = np.concatenate([3 * stats, 0.3 * length])
    return np.concatenate([idx, BUCKETS + np.arange(dense.size)]), np.concatenate([4 * count / max(1, n), dense])


class Machine:
    """Weights of a factorisation machine; `fit` learns them by AdaGrad on the log loss."""

    def __init__(self, prior: float = 1.0):
        self.b, self.constant = 0.0, prior
        self.w = np.zeros(WIDTH)
        self.V = np.zeros((WIDTH, RANK))
        self.fitted = False

    def _forward(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray):
        part = self.V[idx] * val[:, None]
        total = np.add.reduceat(part, starts, axis=0)
        squares = np.add.reduceat(part * part, starts, axis=0)
        linear = np.add.reduceat(self.w[idx] * val, starts)
        return self.b + linear + 0.5 * (total * total - squares).sum(axis=1), total

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows or not self.fitted:
            return np.full(len(rows), self.constant)
        sizes = np.array([i.size for i, _ in rows])
        z, _ = self._forward(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
        self.constant = float(y.mean()) if y.size else 1.0
        if np.unique(y).size < 2:
            return self
        rng = np.random.default_rng(SEED)
        self.V = rng.normal(0, 0.05, (WIDTH, RANK))
        self.fitted = True
        gb, gw, gV = 1e-6, np.full(WIDTH, 1e-6), np.full((WIDTH, RANK), 1e-6)
        # both classes weigh the same
        weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                take = order[at:at + BATCH]
                sizes = np.array([rows[i][0].size for i in take])
                idx = np.concatenate([rows[i][0] for i in take])
                val = np.concatenate([rows[i][1] for i in take])
                z, total = self._forward(idx, val, np.cumsum(sizes) - sizes)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[take]) * weight[take] / take.size
                e = np.repeat(err, sizes)
                ids, place = np.unique(idx, return_inverse=True)
                dw = np.bincount(place, e * val, ids.size) + DECAY * self.w[ids]
                one = (e * val)[:, None] * (np.repeat(total, sizes, axis=0) - self.V[idx] * val[:, None])
                dV = np.stack([np.bincount(place, one[:, f], ids.size) for f in range(RANK)], axis=1) + DECAY * self.V[ids]
                db = err.sum()
                gb += db * db
                gw[ids] += dw * dw
                gV[ids] += dV * dV
                self.b -= RATE * db / np.sqrt(gb)
                self.w[ids] -= RATE * dw / np.sqrt(gw[ids])
                self.V[ids] -= RATE * dV / np.sqrt(gV[ids])
        self.w, self.V = self.w.astype(np.float32), self.V.astype(np.float32)
        return self


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Machine:
    one = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("lo"), F.max(label_col).alias("hi"))
        .where("lo = hi and lo in (0, 1)").select("_id", F.col("lo").cast("int").alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    known = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(one), "_id")  # max_rows rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fs = [features(t) for t in b["t"]]
            yield pd.DataFrame({
                "id": b["_id"].astype(str), "y": b["y"], "idx": [i.astype("<i4").tobytes() for i, _ in fs],
                "val": [v.astype("<f4").tobytes() for _, v in fs],
            })

    # a document table with repeated ids could hold more rows than labels: the bound holds for rows
    got = known.mapInPandas(run, "id string, y int, idx binary, val binary").orderBy(F.xxhash64("id"), "id", "idx", "val").limit(max_rows).collect()
    rows = [(np.frombuffer(r["idx"], "<i4").astype(np.int64), np.frombuffer(r["val"], "<f4").astype(float)) for r in got]
    return Machine().fit(rows, np.array([r["y"] for r in got], float))


def scores(docs: DataFrame, model: Machine, text_col: str = "text", out: str = "score") -> DataFrame:
    """The documents with all their columns and the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            found, block, size = [], [], 0
            for t in s:
                f = features(t)
                block.append(f)
                size += f[0].size
                if size > BLOCK_WORDS:
                    found.append(shared.value.score(block))
                    block, size = [], 0
            found.append(shared.value.score(block))
            yield pd.Series(np.concatenate(found).astype(float))

    udf = F.pandas_udf(run, "double")
    return docs.withColumn(out, udf(F.coalesce(F.col(text_col), F.lit(""))))


def accepted(score: Column) -> Column:
    return score >= ACCEPT
