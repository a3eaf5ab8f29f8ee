"""SimHash near duplicates against brute force."""

import random

import numpy as np
import pandas as pd
from xxhash import xxh64_intdigest

from corpusloom.llm import graph, simhash
from corpusloom.llm.queries import QUERIES


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    ws = [w for w in low.split(" ") if w]
    grams = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else ([" ".join(ws)] if ws else [])
    hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(rows, radius=2):
    """rows: (doc_id, fingerprint); the smallest id reachable, by comparing everything."""
    fps = sorted({f for _, f in rows})
    x = np.array(fps, dtype=np.uint64)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            root[f] = root[root[f]]
            f = root[f]
        return f

    for i, f in enumerate(fps):
        for j in np.nonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= radius)[0]:
            root[find(f)] = find(fps[i + 1 + int(j)])
    low = {}
    for d, f in rows:
        if d is not None:
            r = find(f)
            low[r] = min(low.get(r, d), d)
    return {(d, f): low.get(find(f)) for d, f in rows}


def test_fingerprint_matches_its_definition():
    texts = ["", None, "One", "two words", "a b c", "A B\tc\x0bD É é  x\n\nX Y z", "la la la la la la", "ü " * 50, " \t\n"]
    rng = random.Random(1)
    texts += [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 300))) for _ in range(30)]
    for t in texts:
        assert simhash.fingerprint(t) % (1 << 64) == slow_print(t)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(2000))
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 64)
    assert simhash.fingerprint(text) % (1 << 64) == slow_print(text)


def test_near_finds_every_pair(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_PAIRS", 50)
    rng = np.random.default_rng(3)
    for radius in (0, 1, 2):
        groups = [1, 2, 63, 64, 65, 300]
        fps = np.concatenate([
            np.uint64(rng.integers(0, 1 << 62)) ^ (np.uint64(1) << rng.integers(0, 8, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(8, 16, n).astype(np.uint64))
            for n in groups
        ])
        group = np.repeat(np.arange(len(groups)), groups)
        a, b = simhash.near(fps, group, radius)
        got = set(zip(a.tolist(), b.tolist()))
        want = {
            (i, j) for i in range(fps.size) for j in range(i + 1, fps.size)
            if group[i] == group[j] and bin(int(fps[i] ^ fps[j])).count("1") <= radius
        }
        assert got == want and len(a) == len(got)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 400), (400, 450), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(200)} | {500: 400, 400: 400, 450: 400}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    base = [[rng.choice(["ka", "lo", "mi", "ne", "pu", "ra"]) + str(rng.randint(0, 40)) for _ in range(400)] for _ in range(6)]
    texts = []
    for ws in base:
        for _ in range(25):
            w = list(ws)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 9))
            texts.append(" ".join(w))
    texts += ["", None, "  ", "one", "one", "Two Words", "two words"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "only here"), (3, texts[3]), (900, texts[3])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "'x' as component_id", "2 as rep")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    prints = [(r["doc_id"], r["fp"] % (1 << 64)) for r in got]
    assert sorted(prints, key=str) == sorted([(d, slow_print(t)) for d, t in rows], key=str)
    want = slow_components(prints)
    assert all(r["component_id"] == want[(r["doc_id"], r["fp"] % (1 << 64))] for r in got)
    assert sum(1 for d, c in {(r["doc_id"], r["component_id"]) for r in got} if d != c) > 50
    kept = [r["doc_id"] for r in simhash.keep_one(df).collect()]
    assert sorted({d for d in kept if d is not None}) == sorted({c for c in want.values() if c is not None})


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_given_table(spark, sf_dir):
    got = QUERIES["op2_simhash"](spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    prints = [(d, slow_print(t)) for d, t in zip(docs["doc_id"], docs["text"])]
    assert dict(zip(got["doc_id"], got["fingerprint"])) == {d: f"{f:016x}" for d, f in prints}
    want = slow_components(prints)
    assert dict(zip(got["doc_id"], got["component_id"])) == {d: want[(d, f)] for d, f in prints}
