"""What stored indexes take and move, on rows made here."""

import pathlib
import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import storage
from corpusloom.functions.hashing import ngram_vector
from corpusloom.operators import embedding, lexical_index as LI, retrieval as R, vector_index as VI

COLS = "path string, idx int, heading string, content string, mtime bigint"


def chunk_rows(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    return [(f"p{i % 9}/n{i}.md", i, "h", " ".join(word() for _ in range(100)), i) for i in range(n)]


def test_hashed_vectors_are_kept_as_whole_numbers(spark, tmp_path):
    odd = ["", " ", "a" * 800, "ab" * 30_000, "x", "知识 图谱", "one two " * 9000 + "three"]
    rows = chunk_rows(600) + [("odd.md", i, "h", t, 0) for i, t in enumerate(odd)]
    given = {("given.md", 0): [0.1, -0.2] * 128, ("given.md", 1): [0.3] + [0.0] * 255, ("given.md", 2): [1e30, 1e-30] * 128}
    hashed = embedding.embed_chunks(spark.createDataFrame(rows, COLS).withColumn("hash", F.lit(""))).select("path", "idx", "vec")
    more = spark.createDataFrame([(*k, v) for k, v in given.items()] + [("none.md", 0, None)], "path string, idx int, vec array<float>")
    VI.write_vectors(hashed.unionByName(more), f"{tmp_path}/v", block_rows=100)
    want = {(p, i): ngram_vector(t) for p, i, _, t, _ in rows} | {k: np.array(v, np.float32) for k, v in given.items()}
    got, bare = {}, 0
    for b in VI.open_vectors(spark, f"{tmp_path}/v").blocks.collect():
        vecs = [m["vec"] for m in b["members"]]
        bare += sum(v is None for v in vecs)
        got |= {(m["path"], m["idx"]): x.astype(np.float32) for m, x in zip(b["members"], VI._members(vecs, b["whole"], b["width"]))}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)
    assert bare >= 600  # of texts like words; very regular long ones may stay as they are
    # a fifth of the floats' size, and the steps before the blocks are gone
    assert sum(f.stat().st_size for f in tmp_path.rglob("v/blocks/*.parquet")) < len(rows) * 1024 / 3
    assert not (tmp_path / "v/rows").exists() and not (tmp_path / "v/cells").exists()


def shuffled(df):
    """The exchanges of the plan with the columns that they move."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = plan.split("\n\n")
    return [p for p in parts if "Exchange\n" in p and "Broadcast" not in p.split("\n")[0]]


def test_few_queries_leave_the_blocks_where_they_lie(spark, tmp_path, monkeypatch):
    rows = chunk_rows(300)
    df = spark.createDataFrame(rows, COLS)
    VI.write_vectors(embedding.embed_chunks(df.withColumn("hash", F.lit(""))), f"{tmp_path}/v", block_rows=40)
    index = VI.open_vectors(spark, f"{tmp_path}/v")
    asked = spark.createDataFrame([(i, rows[i * 7][3][:200]) for i in range(5)], "query_id bigint, text string")
    vecs = embedding.embed_queries(asked)
    few = VI.search(vecs, index, 6)
    moved = shuffled(few)
    assert moved and not any("vecs" in m or "whole" in m for m in moved)
    key = lambda d: sorted((r["query_id"], r["rank"], r["path"], r["idx"], round(r["score"], 9)) for r in d.collect())
    plain = key(R.vector_top(vecs, embedding.embed_chunks(df.withColumn("hash", F.lit(""))), 6))
    assert key(few) == plain
    monkeypatch.setattr(VI, "QUERY_GROUP", 2)
    assert key(VI.search(vecs, index, 6)) == plain


def test_groups_of_queries_find_the_same_chunks(spark, tmp_path, monkeypatch):
    """One group has its tokens in every task, several are joined; a null id finds nothing."""
    rows = chunk_rows(60)
    df = spark.createDataFrame(rows, COLS)
    LI.write_index(df, f"{tmp_path}/l")
    index = LI.open_index(spark, f"{tmp_path}/l")
    asked = spark.createDataFrame([(i, rows[i * 7][3][:90]) for i in range(5)] + [(None, rows[3][3])], "query_id bigint, text string")
    key = lambda d: sorted((r["query_id"], r["rank"], r["path"], round(r["score"], 9)) for r in d.collect())
    one = key(R.bm25_places(asked, index, 4))
    assert one == key(R.bm25(asked.where("query_id is not null"), df, 4)) and len(one) >= 5
    monkeypatch.setattr(LI, "QUERY_GROUP", 2)
    assert key(R.bm25_places(asked, index, 4)) == one


def test_tables_for_a_kept_write_go_with_it(spark, tmp_path):
    made = []

    def write(root):
        made.append(storage.temporary(spark.range(10)))
        storage.save(made[0], f"{root}/t")

    root = storage.kept(spark, "test-" + tmp_path.name, write)
    outside = storage.temporary(spark.range(3))
    assert spark.read.parquet(f"{root}/t").count() == 10 and outside.count() == 3
    (gone,) = {pathlib.PurePosixPath(f).parent for f in made[0].inputFiles()}
    assert not storage.exists(spark, str(gone))
    storage.remove(spark, root)
