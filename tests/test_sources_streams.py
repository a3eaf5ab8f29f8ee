"""Reading files, and the streaming jobs against their batch forms."""

import io
import json
import os
import zipfile

from pyspark.sql import functions as F

from corpusloom.operators import chunking, export as EX, monitor as MO
from corpusloom.sources import books as SB, listing as L, notes as SN, web as SW
from corpusloom.streaming import alerts, reindex


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_notes(spark, tmp_path):
    write(str(tmp_path / "a" / "笔记 one.md"), "# 你好\n")
    write(str(tmp_path / "b+c.md"), "x")
    write(str(tmp_path / "pic.png"), "no")
    rows = {r["path"]: r for r in SN.read_notes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/笔记 one.md", "b+c.md"}
    assert rows["a/笔记 one.md"]["content"] == "# 你好\n" and rows["b+c.md"]["size"] == 1
    assert rows["b+c.md"]["mtime"] > 1_600_000_000_000


def test_one_large_array_is_read_by_ranges(spark, tmp_path):
    rows = [{"path": f"d/{i} [x] {{y}}.md", "size": i, "mtime": 1_700_000_000_000 + i, "hash": None if i % 5 == 0 else f"h{i}"} for i in range(3000)]
    want = sorted(tuple(r.values()) for r in rows if r["hash"]) + sorted((r["path"], r["size"], r["mtime"], None) for r in rows if not r["hash"])
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name, text in (("one", json.dumps(rows)), ("pretty", "\ufeff\n" + json.dumps(rows, indent=2) + "\n"), ("dense", json.dumps(rows, separators=(",", ":")))):
            (tmp_path / name).write_text(text)
            got = L.read_manifest(spark, str(tmp_path / name))
            assert sorted(tuple(r) for r in got.where("hash IS NOT NULL").collect()) + sorted(tuple(r) for r in got.where("hash IS NULL").collect()) == want
            assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 5
        # a name that holds the separator: the array is read as a whole
        odd = [{"path": 'a"},{"b.md', "size": 1, "mtime": 2, "hash": "h"}, {"path": "c},d.md", "size": 3, "mtime": 4, "hash": "k"}]
        (tmp_path / "odd").write_text(json.dumps(odd))
        assert sorted(tuple(r) for r in L.read_manifest(spark, str(tmp_path / "odd")).collect()) == sorted(tuple(r.values()) for r in odd)
        for text in ("[]", "", " [ ] "):
            (tmp_path / "none").write_text(text)
            assert L.read_manifest(spark, str(tmp_path / "none")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)


def test_manifest_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("b", 1, 2, "h"), ("a", 3, 4, "g")], L.MANIFEST_SCHEMA)
    L.write_manifest(m.coalesce(1), str(tmp_path / "m"))
    assert [r["path"] for r in spark.read.schema(L.MANIFEST_SCHEMA).json(str(tmp_path / "m")).collect()] == ["a", "b"]
    write(str(tmp_path / "array.json"), json.dumps([{"path": "x", "size": 1, "mtime": 2, "hash": "h"}, {"path": "y"}], indent=1))
    assert {r["path"] for r in L.read_manifest(spark, str(tmp_path / "array.json")).collect()} == {"x", "y"}


def test_listing_edge_lines(spark):
    lines = [
        '2024-01-02 10:00:00 +0800 CST 12 Standard "ABCDEF0123456789ABCDEF0123456789" box://b/base/a b.md',
        "2024-01-02 10:00:00 12 Standard tag box://b/base/c.MD", "too short box://b/x.md", "no bucket here",
        "2024-01-02T10:00:00 -0100 bad Standard tag box://b/base/manifest.json",
    ]
    rows = L.parse_listing(spark.createDataFrame([(x,) for x in lines], "value string"), "box://b")
    got = {r["key"]: (r["size"], r["mtime"]) for r in rows.collect()}
    ms = 1704160800000
    assert got == {"base/a b.md": (12, ms), "base/c.MD": (12, ms), "base/manifest.json": (0, ms + 9 * 3_600_000)}
    m = {r["path"]: r["hash"] for r in L.build_manifest(rows, "base").collect()}
    assert m == {"a b.md": "abcdef0123456789abcdef0123456789", "c.MD": f"s12-m{ms}"}


def test_front_matter():
    assert SN.front_matter("---\na: 1\ntags: [x, y]\n---\nbody") == ({"a": 1, "tags": ["x", "y"]}, "body")
    data, body = SN.front_matter("---\ntitle: [open\n  sub: no\nk: v: w\n---\nbody")
    assert data == {"title": "[open", "k": "v: w"} and body == "body"
    assert SN.front_matter("no --- block") == ({}, "no --- block")


def archive(files):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return buf.getvalue()


CONTAINER = '<container><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>'


def opf(*hrefs):
    items = "".join(f'<item id="i{i}" href="{h}" media-type="application/xhtml+xml"/>' for i, h in enumerate(hrefs))
    refs = "".join(f'<itemref idref="i{i}"/>' for i in range(len(hrefs)))
    return f"<package><manifest>{items}</manifest><spine>{refs}</spine></package>"


def page(title, text):
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body><p>{text}</p></body></html>"


def test_read_epub(spark, tmp_path):
    good = archive({"META-INF/container.xml": CONTAINER, "OEBPS/b.opf": opf("2.xhtml", "1.xhtml"), "OEBPS/1.xhtml": page("One", "a &amp; b"), "OEBPS/2.xhtml": page("", "second")})
    poor = archive({
        "META-INF/container.xml": CONTAINER, "OEBPS/b.opf": opf("1.xhtml", "2.xhtml", "3.xhtml"), "OEBPS/1.xhtml": page("T", "text"), "OEBPS/2.xhtml": page("E", " "),
        "OEBPS/3.xhtml": page("E", ""), "OEBPS/extra.html": page("Extra", "e" * 60), "OEBPS/nav.html": page("N", "n" * 60), "OEBPS/short.html": page("S", "s"),
    })
    for name, data in (("good.epub", good), ("poor.epub", poor), ("bad.epub", b"not a zip")):
        (tmp_path / name).write_bytes(data)
    rows = SB.read_epub(spark, str(tmp_path)).orderBy("book", "ord").collect()
    assert [(r["title"], r["text"]) for r in rows if r["book"] == "good.epub"] == [("2", "second"), ("One", "a & b")]
    # under half of the reading order has text: pages outside it follow, used ones do not come twice
    assert [r["title"] for r in rows if r["book"] == "poor.epub"] == ["T", "E", "E", "Extra (fallback)"]
    assert not [r for r in rows if r["book"] == "bad.epub"]


def test_saved_results(spark):
    html = '<a class="result__a" href="u1">One <b>x</b></a><td class="result__snippet">' + "s" * 900 + '</td><a class="result__a" href="u2">Two</a>'
    rows = SW.parse_serp(spark.createDataFrame([(1, html)], "q int, html string")).orderBy("pos").collect()
    assert [(r["title"], r["url"], len(r["content"])) for r in rows] == [("One x", "u1", 800), ("Two", "u2", 0)]
    assert SW.parse_serp(spark.createDataFrame([(1, html)], "q int, html string"), 1).count() == 1
    bad = spark.createDataFrame([(1, "{broken"), (2, None), (3, '{"results": []}')], "q int, json string")
    assert SW.normalize_web_json(bad).count() == 0


def test_write_chunks_replaces_touched_buckets(spark, tmp_path):
    schema = chunking.CHUNK_SCHEMA
    row = lambda p, i, c: (p, i, "h", c, 0, 1, "x", 1)
    target = str(tmp_path / "chunks")
    chunking.write_chunks(spark.createDataFrame([row(f"p{i}", 0, "old") for i in range(20)], schema), target, buckets=8)
    stored = spark.read.parquet(target)
    b = stored.where("path = 'p3'").first()["path_bucket"]
    fresh = stored.where(F.col("path_bucket") == b).drop("path_bucket").withColumn("content", F.lit("new"))
    rows = [tuple(r) for r in fresh.select("path", "idx", "heading", "content", "start_offset", "end_offset", "hash", "mtime").collect()]
    chunking.write_chunks(spark.createDataFrame(rows, schema), target, buckets=8)
    after = spark.read.parquet(target)
    assert after.count() == 20
    assert {r["content"] for r in after.where(F.col("path_bucket") == b).collect()} == {"new"}
    assert {r["content"] for r in after.where(F.col("path_bucket") != b).collect()} == {"old"}


def test_export_files_read_in_order(spark, tmp_path):
    c = spark.createDataFrame([(i, f"s{i % 3}", "user", f"m{i}", None, i) for i in range(30)], "id bigint, session_id string, role string, content string, citations string, ts bigint")
    target = str(tmp_path / "out")
    EX.write_text(EX.export_conversations(c), ["session_id", "ts", "id"], target)
    text = "".join(open(os.path.join(target, f), encoding="utf-8").read() for f in sorted(os.listdir(target)) if f.startswith("part-"))
    heads = [line for line in text.split("\n") if line.startswith("# ")]
    assert heads == ["# 💬 m0", "# 💬 m1", "# 💬 m2"]
    assert [line for line in text.split("\n") if line.startswith("m")][:3] == ["m0", "m3", "m6"]


# --- streams ------------------------------------------------------------------------
def test_alert_stream_equals_batch(spark, tmp_path):
    from test_tables import RUNS, run_rows

    rows = sorted(run_rows(), key=lambda r: r[2])
    src = str(tmp_path / "runs")
    for i in range(0, len(rows), 13):  # files in time order, one per micro-batch
        spark.createDataFrame(rows[i : i + 13], RUNS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(src)
    q = alerts.alert_stream(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(str, spark.table("alerts").collect()))
    want = sorted(map(str, MO.alert_events(spark.createDataFrame(rows, RUNS)).collect()))
    assert got == want and got


def test_stream_reindex_equals_batch(spark, tmp_path):
    from corpusloom.operators import embedding

    src, target = str(tmp_path / "drops"), str(tmp_path / "index")
    versions = [
        [("a.md", "## One\nfirst", 1, "h1"), ("b.md", "plain", 1, "h2")],
        [("a.md", "## One\nsecond\n## Two\nmore", 2, "h3"), ("b.md", "plain", 1, "h2")],
        [("c.md", "new", 3, "h4"), ("c.md", "newer", 4, "h5"), ("a.md", "## One\nstale", 1, "h0")],
    ]
    for v in versions:
        spark.createDataFrame(v, reindex.NOTE_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        drops = spark.readStream.schema(reindex.NOTE_SCHEMA).parquet(src)
        reindex.stream_reindex(drops, target, str(tmp_path / "ck")).awaitTermination(120)
    # a note whose hash differs counts as changed even when its time is older
    last = spark.createDataFrame([versions[2][2], versions[0][1], versions[2][1]], reindex.NOTE_SCHEMA)
    want = chunking.chunk_by_heading(last)
    cols = ["path", "idx", "heading", "content", "hash", "mtime"]
    got = reindex.current(spark, target, "chunks")
    before = sorted(map(str, got.select(cols).collect()))
    assert before == sorted(map(str, want.select(cols).collect()))
    vec = ["path", "idx", "vec", "hash"]
    assert sorted(map(str, reindex.current(spark, target, "vectors").select(vec).collect())) == sorted(map(str, embedding.embed_chunks(want).select(vec).collect()))
    # running a batch again changes nothing
    batch = spark.createDataFrame(versions[2], reindex.NOTE_SCHEMA)
    n = max(r["batch"] for r in spark.read.parquet(target + "/notes").select("batch").collect())
    reindex.process(batch, n, target)
    assert sorted(map(str, reindex.current(spark, target, "chunks").select(cols).collect())) == before


def test_state_of_paths_needs_no_texts(spark, tmp_path):
    reindex.process(spark.createDataFrame([("a.md", "## h\ntext", 1, "1"), ("b.md", "## h\nmore", 1, "2")], reindex.NOTE_SCHEMA), 0, str(tmp_path))
    reindex.process(spark.createDataFrame([("a.md", None, 2, "3")], reindex.NOTE_SCHEMA), 1, str(tmp_path))
    notes = reindex.current(spark, str(tmp_path), "notes").select("path", "hash")
    assert [r["path"] for r in notes.collect()] == ["b.md"]
    assert "max_by(content" not in notes._jdf.queryExecution().optimizedPlan().toString()
