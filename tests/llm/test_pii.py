"""Personal data: base spans by plain pattern search, terms by counting everything."""

import hashlib
import math
import re
import time

import pandas as pd
from hypothesis import given, settings, strategies as st

from corpusloom.llm import pii
from corpusloom.llm.queries import QUERIES


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def slow_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return [(a, b, k) for a, _, k, b in sorted(out)]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="aZ9.@-_ +%()0é４中", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_base(text)


def test_base_spans_of_cases():
    for t in [
        "", "a@b.c", "x a@b.c.d@e.f y", "@a.b", "a@@b.c", "a@b", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.1.1.01", "4111 1111 1111 1111",
        "4111-1111-1111-1112", "+1 (555) 010-9999 x", "+1 5", "é+44 20 7946 0958.", "1" * 5000, "1." * 3000 + "2", "a" * 50_000 + "@x.yz",
    ]:
        assert pii.base_spans(t) == slow_base(t)


def slow_terms(texts, near=5, support=3, threshold=0.8):
    """Disclosing (entity, term) pairs over distinct texts."""
    term = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    both, ent, has = {}, {}, {}
    for t in set(texts):
        spans = slow_base(t)
        words = [m for m in term.finditer(t)]
        for w in {low(m.group()) for m in words if len(m.group()) >= 3}:
            has[w] = has.get(w, 0) + 1
        masked = list(t)
        for a, b, _ in spans:
            masked[a:b] = " " * (b - a)
        free = [(m.start(), m.end()) for m in term.finditer("".join(masked))]
        pairs, ents = set(), set()
        for a, b, k in spans:
            before = [w for w in free if w[0] < a][-near:]
            after = [w for w in free if w[0] >= a][:near]
            for s, e in before + after:
                if e - s >= 3:
                    pairs.add((f"{k}:{low(t[a:b])}", low(t[s:e])))
                    ents.add(f"{k}:{low(t[a:b])}")
        for p in pairs:
            both[p] = both.get(p, 0) + 1
        for e in ents:
            ent[e] = ent.get(e, 0) + 1
    n = len(set(texts))
    return {
        (e, w) for (e, w), c in both.items()
        if c >= support and ent[e] < n and math.log2(n * c / (has[w] * ent[e])) / math.log2(n / ent[e]) >= threshold
    }


def corpus():
    texts = [f"the note {i} about harbour work and weather, nothing else" for i in range(40)]
    texts += [f"Please ask Wendeline{'' if i else ' Marsh'} at w.marsh@mail.example.com about the harbour, case {i}" for i in range(6)]
    texts += ["call +44 20 7946 0958 now the harbour"] * 5 + ["", None, "Wendeline alone", "中文 card 4111 1111 1111 1111 中文字符 end"]
    return texts


def test_terms(spark):
    texts = corpus()
    rows = [*enumerate(texts), (None, texts[42]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "1 as text_hash", "'t' as term", "2 as t")
    seen = [t or "" for _, t in rows]
    want = slow_terms(seen)
    found = pii.found(df)
    got = {(r["entity"], r["term"]) for r in pii.disclosing(df, found).collect()}
    assert got == want and ("email:w.marsh@mail.example.com", "wendeline") in want
    assert not any(w in ("the", "harbour") for _, w in want)
    out = pii.detect(df).collect()
    assert len(out) == len(rows)
    assert sorted([[tuple(s) for s in r["base"]] for r in out]) == sorted([slow_base(t) for t in seen])
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "marsh@" not in clean[42] and "Wendeline" not in clean[42] and "[EMAIL]" in clean[42] and "[NAME]" in clean[42]
    assert clean[0] == texts[0] and clean[52] is None and clean[51] == ""
    assert pii.detect(df.limit(0)).count() == 0


def filler(n):
    return [f"plain text number {i} of the day with the usual words about the harbour" for i in range(n)]


def test_terms_of_entities_that_occur_once(spark):
    texts = filler(400) + ["today Wendeline wrote from w.marsh@mail.example.com about the harbour"]  # one text with the address
    texts += [f"contact mobile now +1 (555) 010-{9000 + i} about the harbour" for i in range(20)]  # another number each
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {(r["entity"], r["term"]) for r in pii.disclosing(df, pii.found(df)).collect()}
    assert ("email:w.marsh@mail.example.com", "wendeline") in got
    assert {e for e, w in got if w == "mobile"} == {f"phone:+1 (555) 010-{9000 + i}" for i in range(20)}
    assert not any(w in ("the", "about", "harbour") for _, w in got)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[400] == "[WORD] [NAME] [WORD] [WORD] [EMAIL] about the harbour" and clean[0] == texts[0]


def test_terms_far_from_their_entity(spark):
    gap = "of the day with the usual words about the harbour"
    texts = filler(400) + [f"Wendeline heads it, {gap}, then {gap}: Wendeline at w.marsh@mail.example.com"]
    texts += [f"Oberon {gap} {gap} o.pike@post.example.org {gap} {i}" for i in range(8)]  # never within five words
    texts += [f"Oberon {gap} without an address"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {(r["entity"], r["term"]) for r in pii.disclosing(df, pii.found(df)).collect()}
    assert ("email:o.pike@post.example.org", "oberon") in got and not any(w in ("the", "harbour", "usual") for _, w in got)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert clean[400].count("[NAME]") == 2 and "Wendeline" not in clean[400] and clean[401].startswith("[NAME] of the day")
    assert clean[409] == texts[409]  # no entity in the text


def test_query_on_given_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op5_personal_data"](spark, sf_dir).toPandas().set_index("doc_id")
    want_terms = slow_terms(docs["text"].fillna("").tolist())
    assert len(got) == len(docs)
    for d, t in zip(docs["doc_id"], docs["text"]):
        base = slow_base(t)
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert got.loc[d, "base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got.loc[d, f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]
        spans = [s for s in got.loc[d, "spans"].split(",") if s]
        assert [s for s in spans if not s.startswith("term:")] == [s for s in text.split(",") if s]
        near = {(a, b) for e, w, a, b in pii.near_terms(t, base) if (e, w) in want_terms}
        assert {tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith("term:")} == near


def test_long_runs_take_time_in_proportion():
    start = time.process_time()
    for text in ("7" * 1_000_000, "1." * 500_000, "1.2.3" + "9" * 1_000_000, "a" * 1_000_000 + "@", "+1" + " " * 1_000_000, "1 2-" * 250_000):
        pii.base_spans(text)
    assert time.process_time() - start < 20
    assert pii.base_spans("9" * 1000 + ".1.1.1 x 1.2.3.4.5.6.7.8") == [(1009, 1016, "ip"), (1017, 1024, "ip")]


@given(st.text("0129. x", max_size=60))
@settings(max_examples=300, deadline=None)
def test_addresses_as_the_plain_pattern_has_them(text):
    plain = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    want = [m.span() for m in plain if all(int(p) <= 255 for p in m.group().split("."))]
    assert [(a, b) for a, b, kind in pii.base_spans(text) if kind == "ip"] == want
