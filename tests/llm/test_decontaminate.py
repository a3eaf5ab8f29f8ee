"""Decontamination against a plain search for every window."""

import random
import re

import pytest

from corpusloom.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def slow(docs, items, window=13):
    out = set()
    for d, t in docs:
        ws, hit, found = words(t), set(), set()
        for item, it in items:
            iw = words(it)
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1) if n else ():
                for i in range(len(ws) - n + 1):
                    if ws[i:i + n] == iw[s:s + n]:
                        hit.update(range(i, i + n))
                        found.add("null" if item is None else str(item))
        out.add((d, len(ws), len(hit), tuple(sorted(found))))
    return out


def frames(spark, docs, items):
    extra = ["*", "1 as pos", "'x' as words", "2 as width", "3 as n_words", "4 as h"]
    return (
        spark.createDataFrame(docs, "doc_id long, text string").selectExpr(*extra),
        spark.createDataFrame(items, "item_id long, text string").selectExpr(*extra),
    )


def both(spark, docs, items, window):
    a, b = frames(spark, docs, items)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in dc.contamination(a, b, window).collect()]
    assert len(got) == len(set(got)) and set(got) == slow(docs, items, window)


@pytest.mark.parametrize("window,shingles", [(13, 500_000), (4, 7)])
def test_against_plain_search(spark, monkeypatch, window, shingles):
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", shingles)  # the small one takes several passes
    rng = random.Random(window)
    text = lambda n: " ".join(rng.choice(["ab", "Cd", "é", "É", "x1", "of", "the", "the"]) + rng.choice(["", ",", " -", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(12)] + [(50, ""), (51, None), (52, "..."), (None, "lonely item"), (3, "Twin words here")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{text(5)} {t} {text(5)}") for i, (_, t) in enumerate(items)] + [(200, None), (201, ""), (None, "a lonely ITEM"), (100, docs[3][1])]
    docs += docs[:3] + [(300, "the " * 5000 + "lonely item")]
    both(spark, docs, items, window)


def test_empty_tables_and_no_windows(spark):
    docs, items = [(1, "a b"), (2, None)], [(1, None), (2, "!!")]
    both(spark, docs, items, 13)
    a, b = frames(spark, docs, items)
    assert dc.contamination(a.limit(0), b).count() == 0
    assert dc.contamination(a, b.limit(0)).count() == 2
    assert dc.decontaminate(a, b).count() == 2


def test_rule_and_filter(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = [(1, item), (2, item + " x" * 247), (3, item + " x" * 248), (4, "clean"), (None, item)]
    a, b = frames(spark, docs, [(9, item)])
    assert {r["doc_id"] for r in dc.decontaminate(a, b).collect()} == {3, 4}
    assert dc.decontaminate(a, b).columns == a.columns
