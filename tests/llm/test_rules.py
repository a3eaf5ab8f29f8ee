"""Quality rules against plain Python, from the references to the verdict."""

import math
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
import unicodedata

from corpusloom.llm import rules
from corpusloom.llm.queries import QUERIES

WS = " \t\n\x0b\x0c\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def cells(t):
    out = [0] * 6
    for c in t:
        k = unicodedata.category(c)
        if k in ("Ll", "Lo", "Lm"):
            out[0] += 1
        elif c in WS:
            out[1] += 1
        elif k in ("Lu", "Lt"):
            out[2] += 1
        elif k[0] == "N":
            out[3] += 1
        elif c in "#*$%&|<>!@^~=+_{}[]\\/":
            out[4] += 1
        else:
            out[5] += 1
    return out


def base(t):
    ws = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {i + k for i in range(len(ws) - 4) if grams[tuple(ws[i:i + 5])] > 1 for k in range(5)}
    failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def distance(p, q):
    total = 0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(0, total))


def slow(rows):
    chars, counts = defaultdict(lambda: [0] * 6), defaultdict(Counter)
    for _, lang, t in rows:
        for key in {lang, None}:
            chars[key] = [a + b for a, b in zip(chars[key], cells(t or ""))]
            counts[key].update(words(t or ""))
    out = []
    for d, lang, t in rows:
        t = t or ""
        n, wc, sy, dl, rw, failed = base(t)
        cd = wd = None
        if len(t) >= rules.MIN_CHARS:
            q = [x / max(1, sum(chars[lang])) for x in chars[lang]]
            cd = distance([x / len(t) for x in cells(t)], q)
        if n >= rules.MIN_WORDS:
            all_n = sum(counts[lang].values())
            top = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:rules.COMMON_WORDS]
            mine = Counter(words(t))
            p, q = [mine[w] / n for w, _ in top], [c / all_n for _, c in top]
            wd = distance([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        kept = not failed and (cd or 0) <= rules.MAX_CLASS_DISTANCE and (wd or 0) <= rules.MAX_WORD_DISTANCE
        out.append((d, n, wc, sy, dl, rw, cd, wd, failed, kept))
    return out


def check(got, want, near=1e-9):
    key = lambda r: tuple(str(x) for x in (r[0], *r[1:6]))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:6] == b[:6] and a[8:] == b[8:], (a, b)
        for x, y in zip(a[6:8], b[6:8]):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < near)


def test_against_plain_python(spark):
    en = "The quick brown fox jumps over the lazy dog and the old man of the sea looks at it with some joy. "
    rows = [(i, "en" if i % 3 else "fr", "".join(en[k % len(en):] for k in range(i, i + 8))) for i in range(25)]
    rows += [
        (100, "en", "*** ### $$$ " * 60), (101, "en", "BUY IT NOW!! " * 40), (102, "en", None), (103, "en", ""), (104, None, en * 5),
        (105, "xx", "same line here\nsame line here\n same line here\n\n\t\n"), (106, "en", "a b c d e " * 3 + "f g h i j k l m n o p q r"),
        (107, "en", "one two three four five six seven eight nine"), (None, "en", "Ünïcode \U0001f600 中文 ǅ ½ Ⅷ 12 " * 30), (3, "en", en), (3, "en", en),
        (108, "fr", " ".join(f"w{i}" for i in range(20_000))),
    ]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 as w", "'a' as words", "2 as c", "3 as one", "4 as t")
    check(rules.quality_rules(df).collect(), slow(rows))
    assert rules.quality_rules(df.limit(0)).count() == 0


def test_languages_beyond_the_largest_have_the_common_reference(spark, monkeypatch):
    monkeypatch.setattr(rules, "MAX_LANGUAGES", 1)
    text = "some words of a text that goes on and on " * 40
    df = spark.createDataFrame([(1, "en", text * 2), (2, "fr", text.upper())], "doc_id long, lang string, text string")
    refs = {r["lang"] for r in rules.references(df).collect()}
    assert refs == {"en", None} and rules.quality_rules(df).count() == 2


def many_languages():
    text = lambda i, n: " ".join(f"w{i}x{k % (7 + i % 5)}" for k in range(n))
    rows = [(2 * i + k, f"l{i:03d}", text(i, 110 + i + k)) for i in range(130) for k in range(2)]
    return [*rows, (900, None, text(3, 150)), (901, "l000", None), (902, "L", "Ж" * 400)]


@pytest.mark.parametrize("broadcast,listed", [(5_000, 20_000), (10, 20_000), (5_000, 40), (10, 40)])
def test_every_language_has_its_reference(spark, monkeypatch, broadcast, listed):
    monkeypatch.setattr(rules, "BROADCAST_LANGUAGES", broadcast)
    monkeypatch.setattr(rules, "LISTED_WORDS", listed)
    rows = many_languages()
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "'s' as salt")
    check(rules.quality_rules(df).collect(), slow(rows))


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_given_table(spark, sf_dir, sf):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    check(QUERIES["op7_quality_rules"](spark, sf_dir).collect(), slow(list(zip(docs["doc_id"], docs["lang"], docs["text"]))), 1e-6)
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    j = QUERIES["op7_quality_rules"](spark, sf_dir).toPandas().merge(labels, on="doc_id")
    good = j[(j["quality"] == 1) & ~j["base_failed"]]
    assert good["kept"].mean() > 0.98


def test_arrays_are_sorted_without_a_comparator(spark):
    """array_sort evaluates an expression per comparison; the words of a text were sorted so."""
    df = spark.createDataFrame([(1, "en", "a b c d e " * 30)], "doc_id long, lang string, text string")
    plan = rules.judge(df, rules.references(df))._jdf.queryExecution().executedPlan().toString()
    assert "sort_array(" in plan and "array_sort(" not in plan
