"""The T-occurrence search against all pairs."""

import random
from collections import Counter
from time import process_time

import numpy as np
import pytest

from corpusloom.llm import jaccard as J


def plain(text, width=5):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    return {tuple(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def slow(docs, percent=80, width=5):
    """One row per document; classes are equal sets, named by their least id."""
    sets = [frozenset(plain(t, width)) for _, t in docs]
    first = {}
    for (d, _), s in zip(docs, sets):
        if s:
            first[s] = min((x for x in (first.get(s), d) if x is not None), default=None)
    named = [s for s, d in first.items() if d is not None]
    up = {s: s for s in named}
    def root(s):
        while up[s] is not s:
            s = up[s]
        return s
    for i, a in enumerate(named):
        for b in named[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                up[root(a)] = root(b)
    least = {}
    for s in named:
        r = root(s)
        least[r] = min(least.get(r, first[s]), first[s])
    return Counter((d, len(s), d if not s else least[root(s)] if first[s] is not None else None) for (d, _), s in zip(docs, sets))


def run(spark, docs, **settings):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as a", "2 as n", "'x' as h", "3 as p", "4 as component_id", "5 as t")
    out = J.near_duplicates(df, **settings)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(tuple(r) for r in out.collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    def edited(ws, times):
        ws = list(ws)
        for _ in range(times):
            i = rng.randrange(max(1, len(ws)))
            ws[i:i + rng.choice([0, 1])] = [word()] * rng.choice([0, 1])
        return ws
    docs = []
    for _ in range(8):  # families of near copies, some chained
        base = [word() for _ in range(rng.choice([5, 6, 30, 80, 200]))]
        for _ in range(8):
            docs.append(base)
            base = edited(base, rng.randint(0, 3))
    shared = [word() for _ in range(60)]
    docs += [shared + [word() for _ in range(rng.randint(5, 40))] for _ in range(25)]  # a common passage
    rng.shuffle(docs)
    texts = [(i, rng.choice([" ", "\n", " \t "]).join(d)) for i, d in enumerate(docs)]
    texts += [(500, None), (501, ""), (502, " \n "), (503, "a b"), (504, "A  B"), (505, "a b c"), (None, texts[3][1]), (None, "of no other"), (None, "of no other"), (506, texts[7][1].upper())]
    texts += [texts[5], texts[5], (5, texts[6][1]), (5, "another text of the same id")]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    docs = corpus(seed)
    want = slow(docs)
    assert len({r[2] for r in want}) < len(want) - 20  # there is something to find
    assert run(spark, docs) == want


def test_other_parameters(spark):
    docs = corpus(4)
    assert run(spark, docs, percent=60, width=2) == slow(docs, 60, 2)


def test_large_bundles_are_dealt_in_blocks(spark):
    """Near copies of one text and many with the same passage, in blocks of a few."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(80):
        ws = list(base)
        for _ in range(rng.randint(1, 6)):
            ws[rng.randrange(len(ws))] = f"e{rng.randint(0, 30)}"
        docs.append((i, " ".join(ws)))
    texts = dict(docs)
    sets = [(i, sorted({hash(x) for x in plain(t)})) for i, t in texts.items()]
    df = spark.createDataFrame([(i, len(s), s) for i, s in sets], "a long, n long, hashes array<long>")
    edges = [tuple(r) for r in J.links(df, members=5, hashes=10**9).collect()]
    assert len(edges) < 20 * len(docs)  # a forest per block, not pairs
    up = {i: i for i in texts}
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    held = dict((i, set(s)) for i, s in sets)
    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = Counter(root(i) for i in texts)
    up = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == Counter(root(i) for i in texts) and 1 < len(got) < 80


def test_empty_table_and_long_text(spark):
    assert run(spark, []) == Counter()
    long = " ".join(f"w{i % 9973} x{i % 31}" for i in range(300_000))
    docs = [(1, long), (2, long + " end"), (3, "short text of five words"), (4, "Short text of five words")]
    assert run(spark, docs) == slow(docs)


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(3)
    for _ in range(50):
        lists = [np.unique(rng.integers(0, 40, rng.integers(1, 40))) for _ in range(rng.integers(1, 30))]
        need = int(rng.integers(1, 12))
        times = Counter(int(x) for one in lists for x in one)
        lists.sort(key=len)
        ends = np.cumsum([len(one) for one in lists]).tolist()
        spans = list(zip([0, *ends[:-1]], ends))
        got = dict(J.divide_skip(np.concatenate(lists).tolist(), spans, need, lambda c: need + c % 3, lambda c: c != 7))
        assert got == {c: n for c, n in times.items() if n >= need + c % 3 and c != 7}


def test_shingles_of_a_large_vocabulary_cost_a_bounded_time_per_word():
    """Words that hardly recur: a cache of word hashes that is cleared again and again made
    a word several times dearer than one of a small vocabulary."""
    def seconds(words):
        text, best = " ".join(words), 1e9
        for _ in range(3):
            begin = process_time()
            found = J.shingles(text, 5)
            best = min(best, process_time() - begin)
        assert len(found) == len({tuple(words[i:i + 5]) for i in range(len(words) - 4)}) and (found[1:] > found[:-1]).all()
        return best

    rng = random.Random(5)
    few, many = [f"w{rng.randint(0, 999)}x" for _ in range(300_000)], [f"w{i}x" for i in range(300_000)]
    assert seconds(many) < 2.5 * seconds(few)
