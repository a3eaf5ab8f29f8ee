"""Language identification with a linear-chain conditional random field over words.

    p(y | x) ~ exp( sum_t W[features(x_t)] . y_t + sum_t A[y_t-1, y_t] )

Features of a word: prefixes and suffixes of one to three bytes, all pairs and triples of
neighbouring bytes, and the word itself (the lexicon), each hashed to BUCKETS cells. A run of
letters over 2 x EDGE bytes, as text without spaces has, is cut at character borders into
pieces that overlap by OVERLAP characters, each a word of the chain, so all of it counts. The
transitions A are learnt with them. Training sequences are spans of words of several
documents put one after the other, so that the chain sees texts that switch language.
Words are labelled by forward-backward; a document's language is the label with the largest
sum of word posteriors, its score their mean.

Learning uses at most DOCS_PER_LANGUAGE documents of each language (smallest hashes of the
id, held-out ids excluded) and SPAN consecutive words of each, from a place given by the
hash, cut to SPAN_CHARS characters where words are very long; only these spans are collected. Labelling is one pass over all documents without a
shuffle: words are scored once per block of documents, chains run side by side, and the
memory of a block is bounded by BLOCK_WORDS words or a single longer document.

Defined cases: a null text and one without a letter is `und` with score 0; words without a
letter carry no features and follow their neighbours; without any learnable language every
text is `und`; with one language it is that one; repeated rows are labelled each; a null id
is not held out; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.functions.scale import top_per_key
from corpusloom.llm.common import WS_CLASS
from corpusloom.llm.classifier import held_out

BUCKETS = 1 << 16
DOCS_PER_LANGUAGE, SPAN, SPAN_CHARS = 400, 60, 1920
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.25, 11
BLOCK_WORDS = 400_000
EDGE = 16  # half the bytes of the longest word; `tokens` gives none that is longer
OVERLAP = 2  # characters, so that every three neighbouring bytes are in one piece
_LETTER = re.compile(r"[^\W\d_]")
_NOT_WORD = re.compile(r"[\W\d_]+")


def _pieces(run: str) -> Iterator[bytes]:
    """A run of letters in pieces of at most 2 x EDGE bytes, which are eight characters or more."""
    at = 0
    while True:
        piece = run[at:at + 2 * EDGE].encode("utf-8", "replace")[:2 * EDGE].decode("utf-8", "ignore")
        yield piece.encode("utf-8")
        if at + len(piece) >= len(run):
            return
        at += len(piece) - OVERLAP


def tokens(text: str) -> list[bytes]:
    """Lower-case words of letters, long runs in overlapping pieces."""
    words = _NOT_WORD.sub(" ", text.lower()).split()
    out = [w.encode("utf-8", "replace") for w in words]
    if max(map(len, out), default=0) <= 2 * EDGE:
        return out
    return [p for w, b in zip(words, out) for p in ((b,) if len(b) <= 2 * EDGE else _pieces(w))]


def cells(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature cells of the words, one row of the same width for each; 0 is no feature."""
    short = [w if len(w) <= 2 * EDGE else w[:EDGE] + w[-EDGE:] for w in words]
    width = max(map(len, short), default=1)
    n = np.fromiter(map(len, short), np.int64, len(short))
    raw = np.array([b"\x01" + w + b"\x01" for w in short], dtype=f"S{width + 2}") if short else np.zeros(0, f"S{width + 2}")
    x = raw.view(np.uint8).reshape(len(short), width + 2).astype(np.int64)
    size = n + 2
    at = np.arange(width + 2)

    def cell(tag: int, key: np.ndarray, there: np.ndarray) -> np.ndarray:
        h = (key * 0x9E3779B1 + tag * 0x85EBCA6B) & 0xFFFFFFFF
        return np.where(there, 1 + ((h ^ (h >> 15)) * 0x2C1B3C6D & 0xFFFFFFFF) % (BUCKETS - 1), 0)

    out = []
    if width + 2 >= 2:
        two = x[:, :-1] << 8 | x[:, 1:]
        out.append(cell(1, two, at[None, :-1] + 1 < size[:, None]))
        three = two[:, :-1] << 8 | x[:, 2:]
        out.append(cell(2, three, at[None, :-2] + 2 < size[:, None]))
    whole = np.zeros(len(short), np.int64)
    for k in range(width):
        whole = np.where(k < n, (whole * 1_000_003 + x[:, k + 1]) & 0xFFFFFFFFFFFF, whole)
    affixes = []
    head, tail = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64)
    rows = np.arange(len(short))
    for k in range(1, 4):
        head = head << 8 | x[:, min(k, width + 1)]
        tail = tail << 8 | x[rows, np.maximum(n - k + 1, 0)]
        affixes += [cell(10 + k, head, n >= k), cell(20 + k, tail, n >= k)]
    out.append(np.stack([*affixes, cell(30, whole & 0xFFFFFFFF, n > 0)], axis=1))
    return np.concatenate(out, axis=1), n


class Chain:
    """Weights of the field; row 0 of W stands for no feature and stays zero."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.W, self.A = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32)

    def emissions(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        for i in range(0, len(words), 20_000):
            c, _ = cells(words[i:i + 20_000])
            out[i:i + 20_000] = self.W[c].sum(axis=1)
        return out

    def posteriors(self, emit: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward over chains that lie one after the other in `emit`. Chains run
        side by side, longest first, so a step touches those that are long enough."""
        order = np.argsort(-sizes, kind="stable")
        long = sizes[order]
        starts = (np.cumsum(sizes) - sizes)[order]
        e = np.exp(emit - emit.max(axis=1, keepdims=True)) if emit.size else emit
        move = np.exp(self.A - self.A.max())
        fore, back = np.zeros_like(e), np.ones_like(e)
        longest = int(long[0]) if long.size else 0
        alive = np.searchsorted(-long, -np.arange(longest), side="left")
        state = None
        for t in range(longest):
            at = starts[:alive[t]] + t
            state = e[at] if t == 0 else (state[:alive[t]] @ move) * e[at]
            state /= state.sum(axis=1, keepdims=True)
            fore[at] = state
        state = np.ones((0, e.shape[1]), e.dtype)
        for t in range(longest - 2, -1, -1):
            now, nxt = alive[t + 1], starts[:alive[t + 1]] + t + 1
            state = np.concatenate([state, np.ones((now - len(state), e.shape[1]), e.dtype)])
            state = (state * e[nxt]) @ move.T
            state /= state.sum(axis=1, keepdims=True)
            back[nxt - 1] = state
        both = fore * back
        return both / both.sum(axis=1, keepdims=True) if both.size else both

    def fit(self, spans: list[tuple[str, list[bytes]]]) -> Chain:
        """AdaGrad on the log likelihood of sequences of one to three spans."""
        rng = np.random.default_rng(SEED)
        label = {x: i for i, x in enumerate(self.langs)}
        made = [(cells(ws)[0], label[x]) for x, ws in spans if ws]
        if len(self.langs) < 2 or not made:
            return self
        gW, gA = np.full(self.W.shape, 1e-4, np.float32), np.full(self.A.shape, 1e-4, np.float32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(made)).tolist()
            while order:
                chains = []
                while order and len(chains) < BATCH:
                    n = int(rng.integers(1, 4))
                    chains.append([made[i] for i in order[:n]])
                    order = order[n:]
                parts = [p for c in chains for p in c]
                sizes = np.array([sum(len(p[0]) for p in c) for c in chains])
                y = np.concatenate([np.full(len(p[0]), p[1]) for p in parts])
                emit = np.concatenate([self.W[p[0]].sum(axis=1) for p in parts])
                post = self.posteriors(emit, sizes)
                total = float(sizes.sum())
                err = post.copy()
                err[np.arange(y.size), y] -= 1
                # expected and seen transitions inside chains
                inside = np.ones(y.size, bool)
                inside[np.cumsum(sizes) - sizes] = False
                to = np.nonzero(inside)[0]
                seen = np.zeros_like(self.A)
                np.add.at(seen, (y[to - 1], y[to]), 1)
                pair = self._pairs(emit, sizes, to)
                dA = (pair - seen) / total
                gA += dA * dA
                self.A -= RATE * dA / np.sqrt(gA)
                dW = np.zeros_like(self.W)
                at = 0
                for c, _ in parts:
                    flat = c.ravel()
                    e = np.repeat(err[at:at + len(c)], c.shape[1], axis=0)
                    for k in range(len(self.langs)):
                        dW[:, k] += np.bincount(flat, e[:, k], BUCKETS)
                    at += len(c)
                dW[0] = 0
                dW /= total
                gW += dW * dW
                self.W -= RATE * dW / np.sqrt(gW)
        return self

    def _pairs(self, emit: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Expected transitions, from the posteriors of neighbouring words."""
        k = len(self.langs)
        post = self.posteriors(emit, sizes)
        # p(y_t-1, y_t) ~ fore_t-1 A e_t back_t; fore and back are recovered from one pass each
        e = np.exp(emit - emit.max(axis=1, keepdims=True))
        move = np.exp(self.A - self.A.max())
        fore = np.zeros_like(e)
        first = set((np.cumsum(sizes) - sizes).tolist())
        state = None
        for t in range(len(e)):
            state = e[t] if t in first else (state @ move) * e[t]
            state = state / state.sum()
            fore[t] = state
        rest = post / np.maximum(fore, 1e-30)  # back, up to a factor
        joint = fore[to - 1][:, :, None] * move[None] * (e[to] * rest[to])[:, None, :]
        joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-30)
        return joint.sum(axis=0).reshape(k, k)

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = []
        block: list[list[bytes]] = []

        def flush() -> None:
            code: dict[bytes, int] = {}
            at = np.array([code.setdefault(w, len(code)) for ws in block for w in ws], np.int64)
            sizes = np.array([len(ws) for ws in block], np.int64)
            post = self.posteriors(self.emissions(list(code))[at], sizes)
            ends = np.cumsum(sizes)
            for n, end in zip(sizes, ends):
                mean = post[end - n:end].mean(axis=0, dtype=np.float64)
                best = int(mean.argmax())
                out.append((self.langs[best], float(min(1.0, mean[best]))))
            block.clear()

        where, size, result = [], 0, [("und", 0.0)] * len(texts)
        for i, t in enumerate(texts):
            if not self.langs or not t or not _LETTER.search(t):
                continue
            ws = tokens(t) or [b"\x02"]  # letters that lower case turns into none
            if block and size + len(ws) > BLOCK_WORDS:
                flush()
                size = 0
            where.append(i)
            block.append(ws)
            size += len(ws)
        if block:
            flush()
        for i, r in zip(where, out):
            result[i] = r
        return result

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, posterior) of one code-switched text; long runs in their pieces."""
        ws = tokens(text)
        if not ws or not self.langs:
            return []
        post = self.posteriors(self.emissions(ws), np.array([len(ws)]))
        return [(w.decode(), self.langs[int(p.argmax())], float(p.max())) for w, p in zip(ws, post)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> Chain:
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    ws = F.split("t", f"{WS_CLASS}+")
    # the words are cut out before the ranking, so no whole text is shuffled
    spans = (
        known.select(F.col(lang_col).cast("string").alias("lang"), key.alias("key"), F.col(text_col).alias("t"))
        .withColumn("ws", ws)
        .withColumn("at", F.pmod(F.col("key"), F.greatest(F.lit(1), F.size("ws") - SPAN)).cast("int"))
        .withColumn("words", F.concat_ws(" ", F.slice("ws", F.col("at") + 1, SPAN)))
        .withColumn("from", F.pmod(F.col("key"), F.greatest(F.lit(1), F.length("words") - SPAN_CHARS)).cast("int") + 1)
        .select("lang", "key", F.when(F.length("words") > SPAN_CHARS, F.substring("words", F.col("from"), F.lit(SPAN_CHARS))).otherwise(F.col("words")).alias("span"))
    )
    spans = top_per_key(spans, ["lang"], [F.col("key"), F.col("span")], per_language).orderBy("lang", "key", "span").collect()
    return Chain(sorted({r["lang"] for r in spans})).fit([(r["lang"], tokens(r["span"])) for r in spans])


def predict(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score; one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = shared.value.documents(b.pop("t").tolist())
            yield b.assign(lang_pred=[x for x, _ in found], score=np.array([s for _, s in found], float))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInPandas(
        run, f"doc_id {kind}, lang_pred string, score double"
    )


def label_words(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, words array<struct<word, lang, p>>: the language of every word."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: [{"word": w, "lang": x, "p": p} for w, x, p in shared.value.label_words(t)])

    udf = F.pandas_udf(run, "array<struct<word string, lang string, p double>>")
    return docs.select(F.col(id_col).alias("doc_id"), udf(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
