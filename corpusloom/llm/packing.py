"""Packing of tokenised documents into as few sequences as possible.

Documents are cut into pieces of at most `capacity` tokens; only longer documents are cut.
The packing is decided on the counts of pieces per length, at most `capacity` numbers
however many documents there are:

1. Large pieces (over a fixed share of the capacity) are sorted by length and cut into
   GROUPS groups of equal cardinality; every length is rounded up to the longest of its
   group (linear grouping).
2. The rounded instance has few sizes. Its configurations (how many of each size a
   sequence holds) are optimised by column generation: a linear programme over the
   configurations found so far, and an integer knapsack that finds a better one. The whole
   parts of the solution are used, what is left is filled greedily.
3. The actual pieces take the places of the rounded ones of their group, long ones first,
   which leaves room.
4. Small pieces go, longest first, where they leave the least room; further ones open
   sequences of their own. Sequences that the rounding has left with more room than a small
   share of the capacity are dissolved, and their pieces placed anew by best fit.

The result is a table of runs: pieces of one length, ranks from..to, take the same place in
consecutive sequences. Its size depends on the capacity alone, not on the documents. Every
piece finds its run by its length and its rank among the pieces of that length; ranks are
counted in blocks, so a length that a third of all pieces have is not one task.

Tokens: the ids of a document are those of its words (split at ASCII white space, which the
tokenizer drops), each tokenised once per worker and kept as bytes; a word's ids do not
depend on its neighbours. The ids of all documents never leave their task: only length and
checksum of each piece do.

Defined cases: a null or empty text is the end token alone; equal rows are packed each;
rows with equal ids likewise, in any order; null ids are packed and keep their null; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.llm.common import stored

CAPACITY = 2048
END_ID = 0
SMALL_SHARE = 0.1  # pieces up to this share of the capacity are small
GROUPS = 24
ROUNDS = 400  # of column generation, at most
LOOSE = (1.0, 0.02, 0.005)  # room, as shares of the capacity, above which sequences are dissolved; the best is taken
RANK_BLOCK = 50_000  # pieces ranked in one task
CACHE_WORDS = 500_000  # words a worker keeps, unless one block of documents has more
BLOCK_WORDS = 300_000  # words of a block of documents, unless a single document has more
END_MARKS = b".,;:!?"
# byte-level vocabularies write a byte as its Latin-1 character where that is printable, and
# the others, in order, as the characters from 256 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
LATIN_END = "\u0250"  # below it, letters are letters in every version of Unicode


class WordIds:
    """Ids of single words as little-endian bytes, kept for the worker's next documents.

    A word in ASCII is looked up in lower case, which the tokenizer makes of it anyway. One
    that is letters and then end punctuation is put together from both parts, as a change
    from letters to punctuation always ends a token; so only distinct stems are tokenised."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def words(text: str) -> list[bytes]:
        data = text.encode("utf-8", "surrogatepass")
        return (data.lower() if data.isascii() else data).split()

    @staticmethod
    def plain(word: bytes) -> str | None:
        """The word as the merge model takes it (lower case, a character per byte), if it is
        letters throughout and thus one token group; else None."""
        if word.isascii():
            return word.lower().decode() if word.isalpha() else None
        low = word.decode("utf-8", "replace").lower()
        return low.encode().decode("latin-1").translate(BYTE_CHARS) if low.isalpha() and max(low) < LATIN_END else None

    def learn(self, words: set[bytes]) -> None:
        """Fill in the ids of the words that are not known."""
        known = self.known
        new = words - known.keys()
        if len(known) + len(new) > CACHE_WORDS:
            known = self.known = {w: known[w] for w in words & known.keys()}
        merge, plain, other = self.tokenizer.model.tokenize, self.plain, []
        for w in new:
            stem = w.rstrip(END_MARKS)
            text = plain(stem) if stem else None
            if text is None:
                other.append(w)
                continue
            ids = known.get(stem)
            if ids is None:
                ids = known[stem] = array("I", [t.id for t in merge(text)]).tobytes()
            if len(stem) < len(w):
                tail = w[len(stem):]
                if tail not in known:
                    known[tail] = array("I", self.tokenizer.encode(tail.decode(), add_special_tokens=False).ids).tobytes()
                known[w] = ids + known[tail]
        for i in range(0, len(other), 20_000):
            part = other[i:i + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()

    def of(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


@cache
def word_ids(path: str) -> WordIds:
    """One per worker: a function of this module is not copied with each task."""
    return WordIds(path)


def _cut(doc_id, data: bytes, step: int) -> Iterator[tuple]:
    for k, at in enumerate(range(0, len(data), step)):
        part = data[at:at + step]
        yield doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = word_ids(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * capacity
        for b in batches:
            rows, block, size = [], [], 0
            last = len(b) - 1
            for i, (d, t) in enumerate(zip(b["doc_id"], b["t"])):
                block.append((d, ids.words(t)))
                size += len(block[-1][1])
                if size >= BLOCK_WORDS or i == last:
                    ids.learn({w for _, ws in block for w in ws})
                    rows += [row for d, ws in block for row in _cut(d, ids.of(ws) + end, step)]
                    block, size = [], 0
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


# ---- the plan: works on counts per length only -------------------------------------------


def grouped(counts: dict[int, int], groups: int = GROUPS) -> list[dict[int, int]]:
    """Linear grouping: the lengths, longest first, in groups of equal cardinality. A length
    may be in two groups, with a part of its pieces in each."""
    total = sum(counts.values())
    out: list[dict[int, int]] = []
    size = max(1, -(-total // groups))
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if room == 0:
                out.append({})
                room = size
            n = min(left, room)
            out[-1][length] = n
            left -= n
            room -= n
    return out


def _best_pattern(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, tuple[int, ...]]:
    """Unbounded knapsack: the configuration of the highest value."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    smallest = min(sizes)
    order = [i for i in range(len(sizes)) if value[i] > 1e-12]
    for c in range(smallest, capacity + 1):
        best[c], pick[c] = best[c - 1], -1
        for i in order:
            s = sizes[i]
            if s <= c and best[c - s] + value[i] > best[c] + 1e-12:
                best[c], pick[c] = best[c - s] + value[i], i
    pattern, c = [0] * len(sizes), capacity
    while c >= smallest:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[capacity]), tuple(pattern)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, number of sequences) covering the demand of few sizes exactly."""
    m = len(sizes)
    basis = [tuple(capacity // s if i == k else 0 for i in range(m)) for k, s in enumerate(sizes)]
    d = np.array(demand, float)
    for _ in range(rounds):
        B = np.array(basis, float).T
        x = np.linalg.solve(B, d)
        value, pattern = _best_pattern(sizes, np.linalg.solve(B.T, np.ones(m)), capacity)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(B, np.array(pattern, float))
        ratio = np.where(step > 1e-12, np.maximum(x, 0) / np.where(step > 1e-12, step, 1), np.inf)
        basis[int(ratio.argmin())] = pattern
    x = np.linalg.solve(np.array(basis, float).T, d)
    left = Counter(dict(enumerate(demand)))
    out: Counter = Counter()

    def use(pattern: tuple[int, ...], n: int) -> None:
        n = min([n, *(left[i] // k for i, k in enumerate(pattern) if k)])
        if n > 0:
            out[pattern] += n
            for i, k in enumerate(pattern):
                left[i] -= n * k

    for pattern, n in sorted(zip(basis, x), key=lambda p: -p[1]):
        use(pattern, int(n + 1e-9))
    for pattern in sorted(basis, key=lambda p: -sum(s * k for s, k in zip(sizes, p))):
        use(pattern, 1)
    while any(left.values()):  # the fractional rest: longest first, as many as fit
        room, pattern = capacity, [0] * m
        for i in sorted(range(m), key=lambda i: -sizes[i]):
            k = min(left[i], room // sizes[i])
            pattern[i], room = k, room - k * sizes[i]
        use(tuple(pattern), max(1, min(left[i] // k for i, k in enumerate(pattern) if k)))
    return sorted(out.items(), key=lambda p: p[0], reverse=True)


def _substituted(patterns: list[tuple[tuple[int, ...], int]], groups: list[dict[int, int]]) -> list[tuple[tuple[int, ...], int]]:
    """Runs (actual lengths, sequences): each group's pieces, longest first, take its places."""
    queues = [[[length, n] for length, n in sorted(g.items(), reverse=True)] for g in groups]
    runs = []
    for pattern, n in patterns:
        slots = [i for i, k in enumerate(pattern) for _ in range(k)]
        while n:
            # the places of one group in a sequence take equal pieces as long as there are enough
            take, lengths = n, []
            for i, k in enumerate(pattern):
                if k:
                    take = max(1, min(take, queues[i][0][1] // k)) if queues[i][0][1] >= k else 1
            for i in slots:
                length = queues[i][0][0]
                lengths.append(length)
                queues[i][0][1] -= take
                if queues[i][0][1] == 0:
                    queues[i].pop(0)
            runs.append((tuple(lengths), take))
            n -= take
    return runs


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Runs (lengths in order, number of sequences) that hold all pieces."""
    if not counts:
        return []
    small_to = int(capacity * SMALL_SHARE)
    large = {k: n for k, n in counts.items() if small_to < k < capacity}
    runs = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    if large:
        groups = grouped(large)
        sizes = [max(g) for g in groups]
        distinct = sorted(set(sizes), reverse=True)
        # groups of one rounded size are one group
        merged = [Counter() for _ in distinct]
        for s, g in zip(sizes, groups):
            merged[distinct.index(s)].update(g)
        runs += _substituted(configurations(distinct, [sum(g.values()) for g in merged], capacity), merged)
    open_runs: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for lengths, n in runs:
        open_runs.setdefault(capacity - sum(lengths), []).append((lengths, n))
    small = {k: n for k, n in counts.items() if k <= small_to}
    tried = [filled(open_runs, small, share, capacity) for share in LOOSE]
    best = min(tried, key=lambda runs: sum(n for same in runs.values() for _, n in same))
    return [run for room in sorted(best) for run in best[room]]


def best_fit(open_runs: dict[int, list[tuple[tuple[int, ...], int]]], counts: dict[int, int], capacity: int) -> None:
    """Put pieces, longest first, where they leave the least room; `open_runs` has the runs
    of sequences by their room left. What fits nowhere opens sequences."""
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [r for r in open_runs if r >= length]
            if not fits:
                per = min(left, capacity // length)
                n = left // per
                open_runs.setdefault(capacity - per * length, []).append(((length,) * per, n))
                left -= n * per
                continue
            room = min(fits)
            lengths, n = open_runs[room].pop()
            if not open_runs[room]:
                del open_runs[room]
            take = min(n, left)
            # as many as fit while all sequences of the run get the same number
            per = max(1, min(room // length, left // take)) if take == n else 1
            if take < n:
                open_runs.setdefault(room, []).append((lengths, n - take))
            open_runs.setdefault(room - per * length, []).append((lengths + (length,) * per, take))
            left -= per * take


def filled(
    open_runs: dict[int, list[tuple[tuple[int, ...], int]]], small: dict[int, int], share: float, capacity: int
) -> dict[int, list[tuple[tuple[int, ...], int]]]:
    """The runs with the small pieces in them. Sequences that rounding has left with more
    room than `share` of the capacity are dissolved, and their pieces placed anew with the
    small ones."""
    kept = {room: list(same) for room, same in open_runs.items() if room <= share * capacity}
    pieces_left = Counter(small)
    for room, same in open_runs.items():
        if room > share * capacity:
            for lengths, n in same:
                for length in lengths:
                    pieces_left[length] += n
    best_fit(kept, pieces_left, capacity)
    return kept


def runs_table(plan_runs: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """length, rank (first of the run), n, sequence (of the first), offset; one row for each
    place of each run, sorted by length and rank."""
    rows, used, first = [], Counter(), 0
    for lengths, n in plan_runs:
        at = 0
        for length in lengths:
            rows.append((length, used[length], n, first, at))
            used[length] += n
            at += length
        first += n
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


# ---- on Spark ----------------------------------------------------------------------------


def ranked(parts: DataFrame) -> DataFrame:
    """`rank` from 0 among the pieces of one length, counted in blocks of about RANK_BLOCK."""
    totals = parts.groupBy("length").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / RANK_BLOCK)).cast("int").alias("blocks"))
    blocked = parts.join(F.broadcast(totals), "length").withColumn(  # at most `capacity` rows
        "block", F.pmod(F.xxhash64("doc_id", "piece"), F.col("blocks")).cast("int")
    )
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocked.groupBy("length", "block").count().select(
        "length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead")
    )
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    return (
        blocked.withColumn("r", F.row_number().over(inside) - 1)
        .join(offsets, ["length", "block"]).withColumn("rank", F.col("r") + F.col("ahead")).drop("r", "ahead", "block", "blocks")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece."""
    parts = stored(pieces(docs, tokenizer_path, capacity, id_col, text_col))
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    runs = runs_table(plan(counts, capacity))
    by_length = {int(k): g[["rank", "sequence", "offset"]].to_numpy() for k, g in runs.groupby("length")}
    shared = docs.sparkSession.sparkContext.broadcast(by_length)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b.assign(sequence_id=0, offset=0)
            for length, rows in b.groupby("length").indices.items():
                table = shared.value[int(length)]
                rank = b["rank"].to_numpy()[rows]
                at = np.searchsorted(table[:, 0], rank, side="right") - 1
                out.iloc[rows, out.columns.get_loc("sequence_id")] = table[at, 1] + rank - table[at, 0]
                out.iloc[rows, out.columns.get_loc("offset")] = table[at, 2]
            yield out.drop(columns="rank")

    found = ranked(parts)
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInPandas(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
