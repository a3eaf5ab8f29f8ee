"""Python over Arrow batches holds a few rows and a bounded output at a time."""

import pyarrow as pa

from corpusloom.functions import batches, hashing
from corpusloom.operators import chunking


def test_output_is_given_back_in_bounded_parts():
    whole = pa.RecordBatch.from_pydict({"id": pa.array(range(300), pa.int64())})
    kinds = pa.schema([("id", pa.int64()), ("i", pa.int32())])
    parts = list(batches.slices(iter([whole, whole]), lambda row: ((row["id"], i) for i in range(100)), kinds))
    assert [p.num_rows for p in parts] == [batches.OUT_ROWS] * 3
    assert sum(sum(p.column(0).to_pylist()) for p in parts) == 2 * 100 * sum(range(300))


def test_hash_and_vector_take_texts_from_arrow(spark):
    """Before, every text of a batch became a Python string in a pandas column."""
    texts = ["", "a", "知识 图谱", "😀" * 3000, None, "x" * 5000]
    assert hashing.text_hash.evalType == hashing.embed.evalType == 250  # PythonEvalType.SQL_SCALAR_ARROW_UDF
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(1)
    got = {r["i"]: (r["h"], r["v"]) for r in df.select("i", hashing.text_hash("t").alias("h"), hashing.embed("t").alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == (None if t is None else hashing.base36(hashing.byte_hash(t.encode())))
        assert got[i][1] == [float(x) for x in hashing.ngram_vector(t or "")]
    assert df.limit(0).select(hashing.text_hash("t"), hashing.embed("t")).count() == 0


def test_chunks_of_notes_without_text_or_time(spark):
    rows = [("a/one.md", "## H\nbody", 5), ("two.md", None, None), ("three.md", "", 2**60 + 1)]
    got = {(r["path"], r["idx"], r["heading"], r["content"], r["mtime"]) for r in chunking.chunk_by_heading(spark.createDataFrame(rows, "path string, content string, mtime bigint")).collect()}
    assert ("a/one.md", 0, "H", "body", 5) in got and all(r[4] == 2**60 + 1 for r in got if r[0] == "three.md")
