"""Every note that a link target may mean, against brute force."""

import random
import re

from corpusloom.functions.substrings import inside
from corpusloom.operators import links as LK


def brute(asked, paths):
    squeeze = lambda s: re.sub(r"\s+", "", s)
    out = set()
    for x in asked:
        t = x.strip().lower()
        tn = re.sub(r"\.md$", "", t)
        for p in paths:
            n = re.sub(r"\.md$", "", p.rsplit("/", 1)[-1]).lower()
            a, b = squeeze(n), squeeze(tn)
            score = 100 if n == tn else 95 if a == b else 90 if p.lower() in (t, t + ".md") else 80 if tn in n or n in tn else 70 if b in a or a in b else 0
            if score:
                out.add((x, p, score))
    return out


def test_every_match_is_listed(spark):
    rng = random.Random(5)
    base = ["ab", "a b", "AB", "x", "", "long name", "longname", "Long  Name two", "b", "note", "c.md", "知识 图谱", "知识图谱12"]
    paths = {f"{rng.choice(['', 'd/', 'F/'])}{rng.choice(base)}{rng.choice(['.md', '.MD', ''])}" for _ in range(60)} - {""}
    paths |= {f"hot/{i}/ab.md" for i in range(20)} | {f"n/word-{i}.md" for i in range(130)}
    asked = ["ab", "a b", " AB ", "b", "", "   ", "long", "longnametwo", "d/ab", "F/X.MD", "hot/3/ab", "zzz", "c", ".md", "word-1", "word-12", "1", "知识", "图谱1"]
    m = spark.createDataFrame([(p,) for p in sorted(paths)] + [("hot/1/ab.md",)], "path string")
    t = spark.createDataFrame([(x,) for x in asked] * 2, "target string")
    got = [tuple(r) for r in LK.resolve_names(t, m, listed=None).select("target", "path", "score").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(asked, paths)
    assert LK.resolve_names(t.limit(0), m, listed=None).count() == 0 and LK.resolve_names(t, m.limit(0), listed=None).count() == 0


def test_names_meet_only_what_they_contain(spark):
    """Before, a target met every name with its rarest piece: here 300 of them."""
    words = spark.createDataFrame([(f"abc{i:03d}",) for i in range(300)] + [("",), ("知",)], "word string")
    texts = spark.createDataFrame([(f"x abc{i:03d} abc 知",) for i in range(30)] + [("",), ("abc00",), ("1abc",)], "text string")
    got = [tuple(r) for r in inside(texts, words).collect()]
    want = {(f"x abc{i:03d} abc 知", w) for i in range(30) for w in (f"abc{i:03d}", "知", "")} | {(t, "") for t in ("", "abc00", "1abc")}
    assert len(got) == len(want) and set(got) == want
