"""Search, fusion, reranking and contexts on small frames, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.hashing import ngram_vector
from corpusloom.operators import context, embedding, lexical_index as LI, paths as P, rerank, retrieval as R, vector_index as VI

CHUNKS = [
    ("a/one.md", 0, "H1", "cat dog cat bird", 1),
    ("a/one.md", 1, "H2", "dog", 1),
    ("b/two.md", 0, "cat things", "cat 图谱 检索", 2),
    ("📕 book.pdf", 0, "p", "cat cat cat", 3),
    ("c/empty.md", 0, "x", "", 4),
]
COLS = "path string, idx int, heading string, content string, mtime bigint"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, COLS)


def q(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id bigint, text string")


def brute_bm25(query, rows):
    docs = [(p, i, c.split()) for p, i, _, c, _ in rows]
    out = {}
    for p, i, toks in docs:
        s = 0.0
        for t in query:
            df = sum(t in d for _, _, d in docs)
            f = toks.count(t)
            if f:
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(toks) / 300))
        if s > 0:
            out[(p, i)] = s
    return out


def test_bm25_counts_repeated_query_tokens(spark, chunks):
    latin = [c for c in CHUNKS if "图" not in c[3]]
    df = spark.createDataFrame(latin, COLS)
    got = {(r["path"], r["idx"]): r["score"] for r in R.bm25(q(spark, "cat cat dog"), df).collect()}
    want = brute_bm25(["cat", "cat", "dog"], latin)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_bm25_without_hits(spark, chunks):
    assert R.bm25(q(spark, "the of", "zebra", ""), chunks).count() == 0
    assert [r["path"] for r in R.bm25(q(spark, "图谱"), chunks).collect()] == ["b/two.md"]


def test_scope_changes_frequencies(spark, chunks):
    one = R.bm25(q(spark, "cat"), chunks, scope=["a"]).collect()
    assert [r["path"] for r in one] == ["a/one.md"]
    per = spark.createDataFrame([(1, "cat", ["a"]), (2, "cat", [])], "query_id bigint, text string, scope array<string>")
    rows = R.bm25(per, chunks).collect()
    scoped = [r for r in rows if r["query_id"] == 1]
    assert len(scoped) == 1 and abs(scoped[0]["score"] - one[0]["score"]) < 1e-9
    assert len([r for r in rows if r["query_id"] == 2]) == 3


def test_local_books(spark, chunks):
    paths = lambda **kw: {r["path"] for r in R.search(q(spark, "cat"), chunks, mode="bm25", **kw).collect()}
    assert "📕 book.pdf" not in paths()
    assert "📕 book.pdf" in paths(include_local=True)
    assert "📕 book.pdf" in paths(legacy_scope=True)


def test_stored_index_gives_the_same(spark, chunks, tmp_path):
    LI.write_index(chunks, f"{tmp_path}/index")
    index = LI.open_index(spark, f"{tmp_path}/index")
    asked = q(spark, "cat dog", "图谱 cat", "zebra", "", "the of")
    rows = lambda df: sorted(map(str, df.withColumn("score", F.round("score", 9)).select(*R.RESULT_COLS).collect()))
    assert rows(R.bm25(asked, chunks)) == rows(R.bm25(asked, index=index))
    a, b = (rows(R.bm25(q(spark, "cat"), chunks, scope=["a", "b/two.md"], **i)) for i in ({}, {"index": index}))
    assert len(a) == 2 and a == b


def test_budget_keeps_first_and_is_a_prefix(spark):
    rows = [(1, i, "p", "h", "t", "x" * 100) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "query_id int, rank int, path string, heading string, title string, snippet string")
    ranks = lambda m, **kw: sorted(r["rank"] for r in P.char_budget(df, m, **kw).collect())
    assert ranks(10) == [1]
    assert ranks(153 * 2) == [1, 2]
    assert ranks(153 * 2 - 1) == [1]
    assert ranks(10_000, k=3) == [1, 2, 3]
    assert ranks(152 * 2, with_title=False) == [1, 2]


VECTORS = [("v", 0, [1.0, 0.0]), ("v", 1, [0.0, 1.0]), ("v", 2, [1.0, 0.0]), ("v", 3, [-1.0, 0.0]), ("v", 4, [0.0, 0.0])]


def test_vector_top_ties_and_negatives(spark):
    v = spark.createDataFrame(VECTORS, "path string, idx int, vec array<double>").repartition(3)
    qv = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vec array<double>")
    rows = R.vector_top(qv, v, 5).orderBy("rank").collect()
    assert [r["idx"] for r in rows] == [0, 2, 1, 4, 3]
    assert rows[-1]["score"] == -1.0
    assert [r["idx"] for r in R.vector_top(qv, v, 1).collect()] == [0]


def test_vector_top_in_query_groups(spark):
    v = spark.createDataFrame(VECTORS, "path string, idx int, vec array<double>")
    qv = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(7)], "query_id int, vec array<double>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["idx"]) for r in df.collect())
    assert key(R.vector_top(qv, v, 2)) == key(R.vector_top(qv, v, 2, query_block=3))


def test_vector_top_in_blocks_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "VECTOR_ROWS", 7)
    monkeypatch.setattr(R, "BLOCK_RESULTS", 3000)
    # few distinct values, so that many scores tie
    vectors = [(f"p{i % 40}", i, [float(i % 3), float(i % 7), 1.0 / (1 + i % 5)]) for i in range(1500)]
    asked = [(i, [float(i % 2), 1.0, 0.5 * i]) for i in range(5)]
    v = spark.createDataFrame(vectors, "path string, idx int, vec array<double>")
    qv = spark.createDataFrame(asked, "query_id int, vec array<double>")
    for k in (3, 1200):
        want = set()
        for q_id, q_vec in asked:
            best = sorted((-round(sum(a * b for a, b in zip(q_vec, x)), 9), p, i) for p, i, x in vectors)[:k]
            want |= {(q_id, n + 1, p, i) for n, (_, p, i) in enumerate(best)}
        assert {(r["query_id"], r["rank"], r["path"], r["idx"]) for r in R.vector_top(qv, v, k).collect()} == want


def test_vector_without_chunk_is_dropped(spark, chunks):
    v = spark.createDataFrame([("a/one.md", 0, [1.0]), ("gone", 0, [2.0])], "path string, idx int, vec array<double>")
    qv = spark.createDataFrame([(1, [1.0])], "query_id bigint, vec array<double>")
    rows = R.vector_search(qv, v, chunks, k=2).collect()
    assert [(r["path"], r["rank"]) for r in rows] == [("a/one.md", 1)]
    assert R.vector_search(qv, v, chunks, k=1).count() == 0


def test_rrf(spark):
    cols = "query_id int, rank int, path string, idx int, title string, score double"
    a = spark.createDataFrame([(1, 1, "x", 0, "A", 9.0), (1, 2, "y", 0, "A", 8.0)], cols)
    b = spark.createDataFrame([(1, 1, "y", 0, "B", 0.9), (1, 2, "z", 0, "B", 0.8)], cols)
    rows = {r["path"]: r for r in R.rrf(a, b).collect()}
    assert rows["y"]["rank"] == 1 and rows["y"]["title"] == "A"
    assert abs(rows["y"]["score"] - (1 / 62 + 1 / 61)) < 1e-12
    assert rows["x"]["rank"] == 2 and rows["z"]["rank"] == 3
    swapped = {r["path"]: r["score"] for r in R.rrf(b, a).collect()}
    assert all(abs(swapped[p] - rows[p]["score"]) < 1e-12 for p in rows)


def test_hybrid_without_vectors_fuses_once(spark, chunks):
    rows = R.hybrid(q(spark, "cat"), chunks, None).orderBy("rank").collect()
    assert abs(rows[0]["score"] - 1 / 61) < 1e-12


def test_incremental_vectors(spark, chunks):
    c = chunks.withColumn("hash", F.md5("content"))
    first = embedding.build_vectors(c)
    marked = first.withColumn("vec", F.array(F.lit(9.0).cast("float")))
    changed = c.withColumn("content", F.when(F.col("idx") == 1, "new text").otherwise(F.col("content"))).withColumn("hash", F.md5("content"))
    rows = {(r["path"], r["idx"]): r["vec"] for r in embedding.build_vectors(changed.where("path <> 'c/empty.md'"), marked).collect()}
    assert rows[("a/one.md", 0)] == [9.0]  # taken over, not embedded again
    assert rows[("a/one.md", 1)] == pytest.approx(list(map(float, ngram_vector("new text"))))
    assert ("c/empty.md", 0) not in rows


RES = "query_id bigint, rank int, path string, idx int, heading string, title string, snippet string, score double, mtime bigint"


def test_rerank_lexical(spark):
    res = spark.createDataFrame(
        [(0, 1, "p", 0, "none", "none", "nothing here " * 10, 5.0, 1), (0, 2, "q", 0, "graph", "Graph notes", "graph graph " + "x" * 60, 4.0, 1),
         (0, 3, "r", 0, "h", "t", "graph", 3.0, 1)], RES)
    rows = rerank.rerank_lexical(q(spark, "graph"), res).orderBy("rank").collect()
    assert [r["path"] for r in rows] == ["q", "r", "p"]
    # title 3, heading 2, two hits in the snippet, the whole query as a phrase
    assert rows[0]["score"] == pytest.approx(3 + 2 + 2 * 2.5 / 3.5 + 1.5)
    assert rows[1]["score"] == pytest.approx((1 * 2.5 / 2.5 + 1.5) * 0.8)
    same = rerank.rerank_lexical(q(spark, "  "), res).orderBy("rank").collect()
    assert [r["score"] for r in same] == [5.0, 4.0, 3.0]


def test_context_keeps_empty_queries(spark, chunks):
    queries = q(spark, "cat", "zebra")
    rows = {r["query_id"]: r for r in context.rag_context(queries, R.bm25(queries, chunks)).collect()}
    assert rows[0]["context"].startswith("## ") and "[KB#1] " in rows[0]["context"]
    assert rows[1]["n_kb"] == 0 and rows[1]["context"].startswith("(")


def test_citations(spark):
    kb = spark.createDataFrame([(1, i, f"p{i}", 0) for i in (1, 2, 3)], "query_id int, rank int, path string, idx int")
    a = spark.createDataFrame([(1, "x [KB#3] y [KB#1] [KB#3] [KB#9]")], "query_id int, text string")
    rows = context.citations_used(a, kb).orderBy("pos").collect()
    assert [(r["pos"], r["path"]) for r in rows] == [(0, "p3"), (1, "p1")]


def brute_top(vectors, asked, k):
    want = set()
    for q_id, q_vec in asked:
        best = sorted((-round(float(sum(a * b for a, b in zip(q_vec, x))), 9), p, i) for p, i, x in vectors)[:k]
        want |= {(q_id, n + 1, p, i) for n, (_, p, i) in enumerate(best)}
    return want


def test_stored_vectors_give_the_exact_top(spark, tmp_path):
    rng = random.Random(2)
    middle = [[rng.uniform(-3, 3) for _ in range(6)] for _ in range(12)]
    # tight clusters, a tie of many equal vectors, and few distinct values
    vectors = [(f"p{i % 7}/x{i % 40}", i, [m + rng.uniform(-0.1, 0.1) for m in middle[i % 12]]) for i in range(900)]
    vectors += [("same", i, [1.0, 2.0, 0.0, 1.0, 0.0, 0.5]) for i in range(150)]
    asked = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(9)] + [(50, [0.0] * 6), (51, [1.0, 2.0, 0.0, 1.0, 0.0, 0.5])]
    v = spark.createDataFrame(vectors, "path string, idx int, vec array<double>")
    VI.write_vectors(v, f"{tmp_path}/v", block_rows=32)
    index = VI.open_vectors(spark, f"{tmp_path}/v")
    assert index.n_blocks > 20
    qv = spark.createDataFrame(asked, "query_id int, vec array<double>")
    for k in (1, 200, 2000):
        assert {(r["query_id"], r["rank"], r["path"], r["idx"]) for r in VI.search(qv, index, k).collect()} == brute_top(vectors, asked, k)
    some = {(r["query_id"], r["rank"], r["path"], r["idx"]) for r in VI.search(qv, index, 7, scope=["p3", "same"]).collect()}
    assert some == brute_top([x for x in vectors if x[0].startswith("p3/") or x[0] == "same"], asked, 7)
    assert VI.search(qv.limit(0), index, 3).count() == 0


def test_blocks_out_of_reach_stay_closed(spark, tmp_path):
    far = [("v", i, [math.cos(i / 200), math.sin(i / 200), 0.0]) for i in range(1200)]
    v = spark.createDataFrame(far, "path string, idx int, vec array<double>")
    VI.write_vectors(v, f"{tmp_path}/v", block_rows=20)
    blocks = spark.read.parquet(f"{tmp_path}/v/blocks")
    # what is in blocks that cannot reach the best is not read: spoilt vectors there do no harm
    spoilt = blocks.withColumn("members", F.expr("CASE WHEN centre[0] < 0.5 THEN transform(members, m -> named_struct('path', m.path, 'idx', m.idx, 'vec', array(9D, 9D, 9D))) ELSE members END"))
    index = VI.VectorIndex(spoilt, blocks.count())
    rows = VI.search(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, vec array<double>"), index, 5).orderBy("rank").collect()
    assert [r["idx"] for r in rows] == [0, 1, 2, 3, 4]


def test_empty_stored_indexes(spark, chunks, tmp_path):
    VI.write_vectors(spark.createDataFrame([], "path string, idx int, vec array<double>"), f"{tmp_path}/v")
    qv = spark.createDataFrame([(1, [1.0])], "query_id int, vec array<double>")
    assert VI.search(qv, VI.open_vectors(spark, f"{tmp_path}/v"), 3).count() == 0
    LI.write_index(chunks.limit(0), f"{tmp_path}/l")
    assert R.bm25(q(spark, "cat"), index=LI.open_index(spark, f"{tmp_path}/l")).count() == 0


def test_index_skips_stripes_and_keeps_every_hit(spark, tmp_path, monkeypatch):
    """Many chunks in small stripes, scopes whose borders cut them, against the plain search."""
    monkeypatch.setattr(LI, "STRIPE", 4)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(25)]
    rows = [(f"{rng.choice(['a', 'a/b', 'a!', 'c'])}/n{i % 60}.md", i, "h", " ".join(rng.choice(words[:rng.randint(1, 25)]) for _ in range(rng.randint(0, 30))), i) for i in range(300)]
    df = spark.createDataFrame(rows, COLS)
    LI.write_index(df, f"{tmp_path}/l")
    index = LI.open_index(spark, f"{tmp_path}/l")
    asked = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), s) for i, s in enumerate([[], ["a"], ["a", "a/b"], ["c", "a/b"], ["nowhere"], [rows[3][0]], []])]
    queries = spark.createDataFrame(asked, "query_id bigint, text string, scope array<string>")
    for k in (3, 40):
        want = R.bm25(queries, df, k=k, max_chars=10**6).select("query_id", "rank", "path", "idx", F.round("score", 6)).collect()
        got = R.bm25_places(queries, index, k).select("query_id", "rank", "path", "idx", F.round("score", 6)).collect()
        assert sorted(got) == sorted(want) and got


def test_vectors_find_texts_without_postings(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(VI, "SAMPLE", 2)
    LI.write_docs(chunks, f"{tmp_path}/l")
    VI.write_vectors(embedding.embed_chunks(chunks.withColumn("hash", F.lit(""))).repartition(3), f"{tmp_path}/v", block_rows=1)
    asked = embedding.embed_queries(q(spark, "cat", "zebra quux"))
    cols = ["query_id", "rank", "path", "idx", "snippet"]
    stored = R.vector_search(asked, VI.open_vectors(spark, f"{tmp_path}/v"), k=3, index=LI.open_docs(spark, f"{tmp_path}/l"))
    plain = R.vector_search(asked, embedding.embed_chunks(chunks.withColumn("hash", F.lit(""))), chunks, 3)
    assert sorted(stored.select(*cols).collect()) == sorted(plain.select(*cols).collect())
    assert not (tmp_path / "l" / "blocks").exists()


def test_stripes_in_several_rows_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LI, "FRAGMENT_TOKENS", 5), monkeypatch.setattr(LI, "FRAGMENT_ROWS", 1)
    rows = [(f"a{i % 3}/n{i}.md", 0, "h", " ".join(["cat", "dog"][: 1 + i % 2] * (1 + i % 4) + [f"w{i}"]), i) for i in range(40)] + [("b/none.md", 0, "h", None, 1)]
    df = spark.createDataFrame(rows, "path string, idx int, heading string, content string, mtime long")
    LI.write_index(df, f"{tmp_path}/l")
    index = LI.open_index(spark, f"{tmp_path}/l")
    assert index.blocks.where("token = 'cat'").count() > 5 and index.blocks.where("token = 'cat'").agg(F.sum("n")).first()[0] == 40
    asked = q(spark, "cat cat", "dog w7", "cat dog")
    places = lambda d: sorted((r["query_id"], r["rank"], r["path"], round(r["score"], 9)) for r in d.collect())
    for scope in ([], ["a1"], ["a0", "a2/n5.md"]):
        assert places(R.bm25_places(asked, index, 7, scope)) == places(R.bm25(asked, df, 7, scope=scope))


def test_vector_index_opens_blocks_by_the_shelf(spark, tmp_path, monkeypatch):
    """Several blocks a task, groups of two queries, results merged while blocks are opened."""
    for name, value in {"SHELF_BLOCKS": 3, "SHELVES": 2, "QUERY_GROUP": 2, "OPEN_GROUP": 4, "OPEN_RESULTS": 30, "SEEDS": 1}.items():
        monkeypatch.setattr(VI, name, value)
    vectors = [(f"p{i % 40}", i, [float(i % 3), float(i % 7), 1.0 / (1 + i % 5)]) for i in range(300)]
    asked = [(i, [float(i % 2), 1.0 - i % 3, 0.5 * i]) for i in range(9)]
    v = spark.createDataFrame(vectors, "path string, idx int, vec array<double>")
    VI.write_vectors(v, f"{tmp_path}/v", block_rows=20)
    qv = spark.createDataFrame(asked, "query_id int, vec array<double>")
    got = {(r["query_id"], r["rank"], r["path"], r["idx"]) for r in VI.search(qv, VI.open_vectors(spark, f"{tmp_path}/v"), 7).collect()}
    assert got == brute_top(vectors, asked, 7)
