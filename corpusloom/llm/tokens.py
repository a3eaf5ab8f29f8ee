"""Token counts by distinct pre-tokens.

The tokenizer is byte-level BPE: a text is cut into pre-tokens and each is merged on its
own, so a text's count is the sum over its distinct pre-tokens of frequency times pieces.

Each task works on blocks of documents. A block's distinct units are looked up in the
worker's table of piece counts; the missing ones are counted by the tokenizer, once, and
the counts are joined back to the documents' units and summed by position. The ids of a
document are never formed. Nothing is shuffled: a corpus-wide join would move a row for
every (document, distinct pre-token), more than the text itself, to save repeated counting
of the same pre-token in different tasks, which is a small part of the work.

A unit is one pre-token with the punctuation that follows up to the next space: a space
between two characters that are not white space always begins a pre-token, so cutting there
is exact. Special strings are cut out first and count one token each, as the library does.

Defined cases: a null text is empty and has no tokens; repeated rows are counted each;
extra columns are ignored; an empty table gives no rows; long words are counted but not
kept in the table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

LIMIT = 512
TABLE_UNITS = 300_000  # units a worker keeps
KEEP_CHARS = 40  # longest unit that is kept
BLOCK_UNITS = 1_000_000  # units of a block of documents, but for a single longer document
_ODD = re.compile(r"  |[^\S ] [^\S ]| \Z")  # where a cut at every space could be wrong
_CUT = re.compile(r"(?<=\S)(?= \S)")


class PieceCounts:
    """Pieces per unit, for one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def units(self, text: str) -> tuple[list[str], int]:
        """Units of a text, with their leading space, and the special tokens beside them."""
        if not text:
            return [], 0
        parts, extra = [text], 0
        if self.special is not None and self.special.search(text):
            extra = len(self.special.findall(text))
            parts = [p for p in self.special.split(text) if p]
        out: list[str] = []
        for part in parts:
            if _ODD.search(part):
                out += _CUT.split(part)
            else:
                first, *rest = part.split(" ")
                if first:
                    out.append(first)
                out += [" " + w for w in rest]
        return out, extra

    def pieces(self, distinct: list[str]) -> np.ndarray:
        known = self.known
        new = [u for u in distinct if u not in known]
        found: dict[str, int] = {}
        for i in range(0, len(new), 10_000):
            part = new[i:i + 10_000]
            found.update(zip(part, map(len, self.tokenizer.encode_batch(part, add_special_tokens=False))))
        out = np.fromiter((found[u] if u in found else known[u] for u in distinct), np.int64, len(distinct))
        if len(known) + len(found) > TABLE_UNITS:
            known.clear()
        for u, n in found.items():
            if len(u) <= KEEP_CHARS and len(known) < TABLE_UNITS:
                known[u] = n
        return out

    def count(self, texts: list[str]) -> list[int]:
        units, extra = zip(*map(self.units, texts)) if texts else ((), ())
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        code: dict[str, int] = {}
        at = np.fromiter((code.setdefault(u, len(code)) for u in chain.from_iterable(units)), np.int64, int(sizes.sum()))
        summed = np.concatenate([[0], np.cumsum(self.pieces(list(code))[at])]) if at.size else np.zeros(1, np.int64)
        ends = np.cumsum(sizes)
        return (summed[ends] - summed[ends - sizes] + np.array(extra, np.int64)).tolist() if texts else []


_WORKER: dict[str, PieceCounts] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counts = _WORKER.get(tokenizer_path) or PieceCounts(tokenizer_path)
        _WORKER[tokenizer_path] = counts
        for b in batches:
            texts, n = b.pop("t").tolist(), []
            size, block = 0, []
            for t in texts:
                if block and size + len(t) // 5 > BLOCK_UNITS:
                    n += counts.count(block)
                    size, block = 0, []
                block.append(t)
                size += len(t) // 5
            n += counts.count(block)
            yield b.assign(n_tokens=np.array(n, np.int64))

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
        .mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
