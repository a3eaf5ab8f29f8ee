"""A filter of bits that tells which substrings of a text may be keywords of a large dictionary.

Every keyword sets bits for itself and for its leading 1, 2, 4, 8 ... characters. A text is
looked at for all its places at once, by rolling hashes: a place where no keyword's first
characters stand is dropped before longer substrings are tried. What passes is a keyword or,
rarely, a chance match, so an exact join has to follow. The filter has a bounded size and the
work grows with the text, not with the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.batches import SLICE_ROWS

MIN_BITS, MAX_BITS, BITS_PER_WORD = 16, 28, 32  # as powers of two, and per keyword
_PAGE = 15  # a page of the filter has 2^15 bits, the size of Spark's bitmaps
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_PREFIX = 0xD1B54A32D192ED03  # tells the hash of leading characters from that of a whole keyword
_powers = {_MULT: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}


class Filter(NamedTuple):
    table: np.ndarray  # bytes
    bits: int  # log2 of its size in bits
    lengths: list[int]  # of keywords, ascending


def _power(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept for later texts."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    mask = np.uint64((1 << bits) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def places_of(words: list[str], bits: int) -> np.ndarray:
    """The bits that these keywords set."""
    hashes = set()
    for w in words:
        h, p = 0, 1
        for i, c in enumerate(w):
            h = (h + (ord(c) + 1) * pow(_MULT, i, 1 << 64)) & _MASK
            if i + 1 == p:
                hashes.add(h ^ _PREFIX)
                p *= 2
        hashes.add(h)
    return np.unique(np.concatenate(_places(np.fromiter(hashes, np.uint64, len(hashes)), bits)))


def build(words: DataFrame, column: str = "keyword") -> Filter:
    """The filter of a table's distinct keywords. The driver gets its pages, at most 2^MAX_BITS bits."""
    sizes = words.groupBy(F.length(column).alias("n")).agg(F.count("*").alias("words")).where("n > 0").collect()
    bits = min(MAX_BITS, max(MIN_BITS, int(sum(r["words"] for r in sizes) * BITS_PER_WORD).bit_length()))

    def job(batches):
        for pdf in batches:
            yield pd.DataFrame({"place": places_of([w for w in pdf[column] if w], bits).astype(np.int64)})

    set_bits = words.select(column).mapInPandas(job, "place long")
    page = F.shiftright("place", _PAGE)
    pages = set_bits.groupBy(page.alias("page")).agg(F.bitmap_construct_agg(F.col("place") % (1 << _PAGE)).alias("bits")).collect()
    table = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_PAGE - 3)
    for r in pages:
        table[r["page"] * size : (r["page"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Filter(table, bits, sorted(r["n"] for r in sizes))


def _passing(text: str, known: Filter) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of all substrings that may be keywords."""
    n = len(text)
    if not n or not known.lengths:
        return
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_codes(text) * _power(_MULT, n), out=sums[1:])
    back = _power(_INVERSE, n)

    def is_set(place: np.ndarray) -> np.ndarray:
        return known.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1

    def passing(at: np.ndarray, length: int, salt: int) -> np.ndarray:
        one, two = _places(((sums[at + length] - sums[at]) * back[at]) ^ np.uint64(salt), known.bits)
        yes = is_set(one)
        at, two = at[yes], two[yes]
        return at[is_set(two)]

    at, p = np.arange(n), 1
    while p <= known.lengths[-1] and len(at):
        at = passing(at[at + p <= n], p, _PREFIX)
        for length in known.lengths:
            if p <= length < 2 * p:
                yield length, passing(at[at + length <= n], length, 0)
        p *= 2


def first_places(text: str, known: Filter) -> dict[str, int]:
    """First offset of every substring that may be a keyword."""
    found: dict[str, int] = {}
    for length, at in _passing(text, known):
        for i in at.tolist():
            found.setdefault(text[i : i + length], i)
    return found


def _parts(texts: list[str], known: Filter) -> Iterator[tuple[str, str]]:
    """(text, part) of short texts, looked at together."""
    ends = np.cumsum([len(t) for t in texts])
    whole = "".join(texts)
    for length, at in _passing(whole, known):
        of = np.searchsorted(ends, at, side="right")
        inside = at + length <= ends[of]
        yield from {(texts[k], whole[i : i + length]) for k, i in zip(of[inside].tolist(), at[inside].tolist())}


def inside(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(text, word): the words that stand in each of the short texts, both distinct. A text
    meets the words in it and hardly any other; an empty word is in every text."""
    words = words.where("word IS NOT NULL")
    known = build(words, "word")

    def job(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                rows = [*_parts([t for t in batch.column(0).slice(lo, SLICE_ROWS).to_pylist() if t is not None], known)]
                yield pa.RecordBatch.from_pydict({"text": pa.array([t for t, _ in rows], pa.string()), "word": pa.array([w for _, w in rows], pa.string())})

    possible = texts.select("text").mapInArrow(job, "text string, word string")
    empty = words.where("word = ''")  # one row at most
    return possible.join(words, "word", "left_semi").select("text", "word").unionByName(texts.where("text IS NOT NULL").crossJoin(F.broadcast(empty)).select("text", "word"))
