"""The filter audit against a simulation of all 120 orders, document by document."""

import random
import re
from itertools import permutations

from corpusloom.llm import audit as A


def fails(docs):
    out = []
    for d, t, _ in docs:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({
            "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs),
        })
    return out


def slow(docs, labels):
    failed = fails(docs)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = {}
    for part in {lang or "" for _, _, lang in docs}:
        mine = [(d, f) for (d, _, lang), f in zip(docs, failed) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        own = []
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                out = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                shapley[x] += len(out)
                own.append((part, "".join(order), step, x, len(left), len(out), sum(f[x] for _, f in mine) - len(out),
                            sum(f[x] and sum(f.values()) == 1 for _, f in mine), sum(d in good for d, _ in out), sum(d in toxic for d, _ in out)))
        for r in own:
            rows[r[:3]] = (*r[4:], shapley[r[3]])
    return rows


def run(spark, docs, labels):
    a = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as mask", "'x' as part", "2 as id", "3 as h1")
    b = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' as text", "5 as n")
    got = A.audit(a, b).collect()
    out = {tuple(r[:3]): tuple(r[3:]) for r in got}
    assert len(out) == len(got)
    return out


def test_against_simulation(spark):
    rng = random.Random(3)
    words = ["ab", "CD", "é", "É", "x#", "of", "the", "A" * 9, "|"]
    def text():
        few = rng.random() < 0.5
        pool = words if few else [f"{rng.choice(words)}{i}" for i in range(300)]
        return rng.choice([" ", "\n", "\t "]).join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 199, 200, 250])))
    docs = [(i, text(), rng.choice(["en", "fr", None, ""])) for i in range(60)]
    docs += [(100 + i, docs[i][1], rng.choice(["en", "de"])) for i in range(20)] + [docs[4], (4, docs[5][1], "en"), (200, None, "en"), (201, "", None)]
    docs += [(None, docs[0][1], "en"), (None, "only here", "en"), (300, "only here", "en"), (400, "long " * 100_000, "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(120)] + [(3, 1, 1), (3, 1, 0), (None, 1, 1), (9999, 1, 1)]
    assert run(spark, docs, labels) == slow(docs, labels)


def test_a_part_without_failures_and_empty_tables(spark):
    clean = " ".join(f"w{i}" for i in range(250))
    docs, labels = [(1, clean, "en"), (2, clean + " more", "en")], [(1, 1, 0)]
    got = run(spark, docs, labels)
    assert len(got) == 600 and got == slow(docs, labels) and set(got.values()) == {(2, 0, 0, 0, 0, 0, 0)}
    assert run(spark, [], labels) == {}
    assert run(spark, docs, []) == slow(docs, [])


def test_the_recursion_has_every_prefix_of_every_mask(spark):
    rows = spark.sql(A.PREFIXES).collect()
    want = ["".join(p) for n in range(1, 6) for p in permutations("ABCDE", n)]
    assert sorted((r["mask"], r["prefix"]) for r in rows) == sorted((m, p) for m in range(32) for p in want)
