"""The factorisation machine: its identity, its folds, and held-out accuracy."""

import zlib

import numpy as np
import pandas as pd

from corpusloom.llm import classifier as fm
from corpusloom.llm.queries import QUERIES


def test_score_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = fm.Machine()
    m.fitted, m.b = True, 0.3
    m.w, m.V = rng.normal(0, 1, fm.WIDTH), rng.normal(0, 0.3, (fm.WIDTH, fm.RANK))
    rows = [fm.features("A small text, with a small word!!"), fm.features(""), fm.features(None)]
    for (idx, val), got in zip(rows, m.score(rows)):
        z = m.b + (m.w[idx] * val).sum()
        z += sum(m.V[i] @ m.V[j] * x * y for k, (i, x) in enumerate(zip(idx, val)) for j, y in list(zip(idx, val))[:k])
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_cases(spark):
    junk, good = "BUY!! $$$ NOW!! *** ", "the quiet river runs past the old mill and the road "
    docs = [(i, (junk if i % 2 else good) * (3 + i % 5)) for i in range(200)] + [(None, good), (500, None), (501, ""), (1, junk * 4), (502, "x " * 200_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "'a' as _id", "2 as y", "3 as t")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)] + [(None, 1), (7, 1), (9, None), (0, 5)], "doc_id long, quality int")
    model = fm.train(df, labels)
    out = fm.scores(df.drop("score"), model).toPandas()
    assert len(out) == len(docs) and out["score"].between(0, 1).all()
    body = out[out["doc_id"] < 200]
    assert ((body["score"] >= 0.7) == (body["doc_id"] % 2 == 0)).all()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fm.scores(empty, model).count() == 0
    none = fm.train(df, labels.limit(0))
    assert fm.scores(df.drop("score"), none).toPandas()["score"].eq(1.0).all()
    one = fm.train(df, labels.where("quality = 1"))
    assert fm.scores(df.drop("score"), one).toPandas()["score"].eq(1.0).all()
    assert fm.train(empty, labels).constant == 1.0


def test_held_out_labels_are_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 4 == 2 else i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = fm.train(docs, labels), fm.train(docs, turned)
    assert np.array_equal(a.V, b.V) and a.b == b.b


def test_query_on_given_table(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    out = QUERIES["op10_quality_classifier"](spark, sf).toPandas()
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    j = out.merge(labels, on="doc_id")
    assert (out["held_out"] == out["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert (out["predicted"] == (out["score"] >= 0.7)).all()
    j = j[j["held_out"]]
    assert (j["predicted"] == j["quality"]).mean() > 0.95
    assert j[j["quality"] == 1]["predicted"].mean() > 0.97
