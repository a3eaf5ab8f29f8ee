"""The chain against enumeration of all labellings, and its accuracy on held-out rows."""

import itertools
import zlib

import numpy as np
import pandas as pd

from corpusloom.llm import langid
from corpusloom.llm.queries import QUERIES


def test_posteriors_by_enumeration():
    rng = np.random.default_rng(2)
    m = langid.Chain(["a", "b", "c"])
    m.A = rng.normal(0, 1, (3, 3)).astype(np.float32)
    sizes = np.array([4, 1, 6, 2])
    emit = rng.normal(0, 2, (13, 3)).astype(np.float32)
    got, at = m.posteriors(emit, sizes), 0
    for n in sizes:
        want = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(emit[at + t, y[t]] for t in range(n)) + sum(m.A[y[t - 1], y[t]] for t in range(1, n)))
            for t in range(n):
                want[t, y[t]] += p
        want /= want.sum(axis=1, keepdims=True)
        assert np.abs(got[at:at + n] - want).max() < 1e-5
        at += n


def test_expected_transitions_by_enumeration():
    rng = np.random.default_rng(5)
    m = langid.Chain(["a", "b"])
    m.A = rng.normal(0, 1, (2, 2)).astype(np.float32)
    emit, n = rng.normal(0, 1, (5, 2)).astype(np.float32), 5
    got = m._pairs(emit, np.array([n]), np.arange(1, n))
    want, z = np.zeros((2, 2)), 0
    for y in itertools.product(range(2), repeat=n):
        p = np.exp(sum(emit[t, y[t]] for t in range(n)) + sum(m.A[y[t - 1], y[t]] for t in range(1, n)))
        z += p
        for t in range(1, n):
            want[y[t - 1], y[t]] += p
    assert np.abs(got - want / z).max() < 1e-4


def test_features_of_words():
    words = [b"a", b"ab", b"abc", "é".encode(), b"x" * 500, b"x" * 499]
    c, n = langid.cells(words)
    assert c.shape[0] == 6 and n.tolist() == [1, 2, 3, 2, 32, 32]
    alone = [set(langid.cells([w])[0].ravel()) for w in words]
    assert [set(row) - {0} for row in c] == [s - {0} for s in alone]  # the padding of a batch adds nothing
    assert langid.cells([])[0].shape[0] == 0


def test_long_runs_are_read_whole():
    for run in ["abcdefghij" * 30, "漢字仮名交文章" * 40, "é漢a𐐨" * 50, "x" * 32, "x" * 33, "漢" * 11]:
        ws, data = langid.tokens(run), run.lower().encode()
        assert all(0 < len(w) <= 2 * langid.EDGE and w.decode() in run.lower() for w in ws)
        assert {data[i:i + 3] for i in range(len(data) - 2)} == {w[i:i + 3] for w in ws for i in range(len(w) - 2)}
    assert langid.tokens("ein " + "y" * 32) == [b"ein", b"y" * 32]
    m = langid.Chain(["de", "fr"]).fit([(x, langid.tokens(t)) for _, t, x in corpus()])
    middle = "lamaisonetlejardinavec" * 20
    assert m.documents([f"derdiedasundnicht{middle}unddergartenmitderhaus"])[0][0] == "fr"
    found = [x for _, x, _ in m.label_words("nichtundderdiegartenmithaus" * 10 + middle)]
    assert found[0] == "de" and found[-1] == "fr"


def test_training_spans_without_spaces_are_bounded(spark):
    rows = [(i, ("gartenhausundnicht" if i % 2 else "maisonjardinavecles") * 5000, "de" if i % 2 else "fr") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert all((r["doc_id"] % 2 == 1) == (r["lang_pred"] == "de") for r in langid.predict(df, model).collect())


def corpus():
    de, fr = "der die das und nicht ein Haus mit Garten", "le la les et pas une maison avec jardin"
    return [(i, (de if i % 2 else fr) + f" {i}", "de" if i % 2 else "fr") for i in range(160)]


def test_cases(spark):
    rows = corpus() + [(900, None, "de"), (901, "", "fr"), (902, "12 34 !!", "de"), (None, "der Garten", "de"), (903, "das Haus " * 20_000, None), (1, "le jardin", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'x' as t", "2 as key")
    model = langid.train(df)
    assert model.langs == ["de", "fr"]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict(df, model).collect()}
    assert len(langid.predict(df, model).collect()) == len(rows)
    assert got[(900, "und")] == got[(901, "und")] == got[(902, "und")] == 0.0
    assert (903, "de") in got and (1, "fr") in got and (None, "de") in got and all(0 <= s <= 1 for s in got.values())
    words = {r["doc_id"]: [(w["word"], w["lang"]) for w in r["words"]] for r in langid.label_words(
        spark.createDataFrame([(1, "das Haus und der Garten avec la maison et le jardin"), (2, None)], "doc_id long, text string"), model).collect()}
    assert [x for _, x in words[1]] == ["de"] * 5 + ["fr"] * 6 and words[2] == []
    assert langid.predict(df.limit(0), model).count() == 0
    none = langid.train(df.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
    one = langid.train(df.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.predict(df, one).collect()} == {"und", "de"}


def test_held_out_rows_are_not_learnt_from(spark):
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    turned = [(i, t, ("de" if x == "fr" else "fr") if held(i) else x) for i, t, x in corpus()]
    a, b = (langid.train(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (corpus(), turned))
    assert np.array_equal(a.W, b.W) and np.array_equal(a.A, b.A)


def test_query_on_given_table(spark, sf_dir):
    out = QUERIES["op6_language_id"](spark, sf_dir).toPandas()
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    j = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and j["score"].between(0, 1).all()
    j = j[j["held_out"]]
    assert (j["lang_pred"] == j["lang"]).mean() > 0.97
