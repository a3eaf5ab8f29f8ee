"""The pipeline stage by stage against plain Python on the smallest given table."""

import hashlib
import re
from collections import defaultdict

import pandas as pd
import pytest
from test_packing import check
from test_simhash import slow_components, slow_print

import corpus_pipeline as cp
from corpusloom.llm import classifier
from corpusloom.llm.common import stored, table


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def slow_lines(docs, min_docs=3):
    holders = defaultdict(set)
    keys = {d: [low(x).strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for d, t in docs}
    for d, ks in keys.items():
        for k in ks:
            if len(k) >= 20:
                holders[k].add(d)
    gone = {k: max(ds) for k, ds in holders.items() if len(ds) >= min_docs}
    return {d: "\n".join(x for x, k in zip((t or "").split("\n"), keys[d]) if k not in gone or gone[k] == d) for d, t in docs}


def slow_contaminated(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    ws, hit = word.findall(low(text)), set()
    for item in items:
        iw = word.findall(low(item or ""))
        n = min(13, len(iw))
        for win in {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else ():
            for i in range(len(ws) - n + 1):
                if ws[i] == win[0] and tuple(ws[i:i + n]) == win:
                    hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(ws)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [table(spark, sf_dir, "documents")]
    for _, f in cp.STAGES:
        out.append(stored(f(spark, out[-1], sf_dir)))
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_classifier_stage(spark, sf_dir, stages):
    model = classifier.train(stages[0], table(spark, sf_dir, "labels"))
    want = {d for d, t in rows(stages[0]) if model.score([classifier.features(t)])[0] >= 0.7}
    assert {d for d, _ in rows(stages[1])} == want


def test_line_stage(stages):
    assert dict(rows(stages[2])) == slow_lines(rows(stages[1]))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_copy_stage(stages):
    prints = [(d, slow_print(t)) for d, t in rows(stages[2])]
    root = slow_components(prints)
    assert {d for d, _ in rows(stages[3])} == {c for c in root.values()}


def test_contamination_stage(stages, sf_dir):
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")["text"].tolist()
    want = {d for d, t in rows(stages[3]) if not slow_contaminated(t, items)}
    assert {d for d, _ in rows(stages[4])} == want and len(want) < stages[3].count()


def test_packing_stage(spark, sf_dir, stages):
    check(stages[5].toPandas(), rows(stages[4]))
    whole = cp.run(spark, sf_dir).drop("sequence_id", "offset")
    digest = lambda df: hashlib.sha256(str(sorted(map(tuple, df.collect()))).encode()).hexdigest()
    assert digest(whole) == digest(stages[5].drop("sequence_id", "offset"))
