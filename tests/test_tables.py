"""Table upkeep, links, books and monitoring on small frames."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scale
from corpusloom.functions.scale import lookup, running_sum
from corpusloom.operators import agent, autolink as AL, books as B, chat as CH, links as LK, monitor as MO, related as RL, stats as ST, sync as S
from corpusloom.sources.notes import list_tags

NOTE = "path string, content string, mtime bigint, hash string, cached_at bigint"


def notes_of(spark, **contents):
    return spark.createDataFrame([(k, v, i, "h", 0) for i, (k, v) in enumerate(contents.items())], NOTE)


# --- building blocks --------------------------------------------------------------
def test_lookup_hot_keys_give_the_same(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3), ("none", 4)], "k string, v int")
    index = spark.createDataFrame([("hot", "H"), ("a", "A"), ("b", "B"), ("c", "C")], "k string, x string")
    want = sorted(map(str, left.join(index, "k", "left").select("k", "v", "x").collect()))
    for limit in (1, 10, 1000):
        got = sorted(map(str, lookup(left, index, "k", limit).select("k", "v", "x").collect()))
        assert got == want


def test_running_sum_over_blocks(spark):
    rows = [(random.Random(i).choice("ab"), i, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    got = {(r["k"], r["t"]): r["s"] for r in running_sum(df, ["k"], F.floor(F.col("t") / 7), ["t"], F.col("v"), "s").collect()}
    total = {}
    for k, t, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[(k, t)] == total[k]


# --- sync -------------------------------------------------------------------------
def test_changed_and_stale(spark):
    m = spark.createDataFrame([("new", 1, 5, "x"), ("hash", 1, 5, "x"), ("older", 1, 5, "x"), ("newer", 1, 5, "x"), ("same", 1, 5, "x")], "path string, size bigint, mtime bigint, hash string")
    n = spark.createDataFrame([("hash", "c", 5, "y", 0), ("older", "c", 4, "x", 0), ("newer", "c", 6, "x", 0), ("same", "c", 5, "x", 0), ("gone", "c", 1, "x", 0)], NOTE)
    assert {r["path"] for r in S.changed(m, n).collect()} == {"new", "hash", "older"}
    assert [r["path"] for r in S.stale(n, m).collect()] == ["gone"]
    r = S.sync_status(m, n).first()
    assert (r["total"], r["synced"], r["missing"]) == (5, 2, 3)
    fetched = spark.createDataFrame([("new", "n", 5, "x", 9)], NOTE)
    assert S.apply_sync(m, n, fetched).count() == 6
    assert "gone" not in {r["path"] for r in S.apply_sync(m, n, fetched, prune=True).collect()}


def test_put_and_edit(spark):
    n = notes_of(spark, a="one two one", b="x")
    m = spark.createDataFrame([("a", 11, 0, "h")], "path string, size bigint, mtime bigint, hash string")
    notes, manifest = S.put_notes(spark.createDataFrame([("a", "é", 7), ("a", "later", 8), ("c", "é", 7)], "path string, content string, ts bigint"), n, m)
    rows = {r["path"]: r for r in notes.collect()}
    assert rows["a"]["content"] == "later" and rows["a"]["mtime"] == 8 and rows["b"]["content"] == "x"
    assert {r["path"]: r["size"] for r in manifest.collect()} == {"a": 5, "c": 2}
    edits = spark.createDataFrame([("a", "one", "1", 9), ("b", "zz", "1", 9), ("q", "x", "1", 9)], "path string, old_text string, new_text string, ts bigint")
    done, refused = S.edit_notes(n, edits)
    assert {r["path"]: r["content"] for r in done.collect()}["a"] == "1 two one"
    assert {(r["path"], r["reason"]) for r in refused.collect()} == {("b", "text not found"), ("q", "note missing")}


def test_rename_conflicts(spark):
    n = notes_of(spark, a="1", b="2", c="3")
    moves = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("c", "c", 1), ("q", "y", 1), ("c", "a", 1), ("c", "", 1)], "old string, new string, ts bigint")
    reasons = {(r["old"], r["new"]): r["reason"] for r in S.check_renames(moves, n).collect()}
    assert reasons == {("a", "x"): None, ("b", "x"): "conflicting move", ("c", "c"): "same path", ("q", "y"): "missing source", ("c", "a"): "target exists", ("c", ""): "empty target"}
    after = S.rename(n, S.check_renames(moves, n))
    assert {r["path"] for r in after.collect()} == {"x", "b", "c"}


def test_delete_books(spark):
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    out = S.delete_books(one("📕 a.pdf"), one("📕 a.pdf.md", "n.md"), one("📕 a.pdf.md"), one("📕 a.pdf", "n.md"), one("📕 a.pdf"))
    assert [[r["path"] for r in df.collect()] for df in out] == [["n.md"], [], ["n.md"], []]


# --- links ------------------------------------------------------------------------
def test_graph_resolution(spark):
    n = notes_of(spark, **{
        "x/A.md": "[[b]] [[b]] [[y/B]] [[a]] [[none]]", "y/B.md": "[[X/a|alias]]", "z/b.md": "[[!a]]", "z/C.md": "no links",
    })
    e = {(r["source"], r["target"]): r["times"] for r in LK.graph_edges(n).collect()}
    # a base name means the first note by path; links to itself are dropped
    assert e == {("x/A.md", "y/B.md"): 3, ("y/B.md", "x/A.md"): 1}
    assert {(r["source"], r["target"]): r["times"] for r in LK.graph_edges(n, hot_rows=1).collect()} == e
    nodes = {r["path"]: r["value"] for r in LK.graph_nodes(LK.graph_edges(n), n, fill=3).collect()}
    assert nodes == {"x/A.md": 1, "y/B.md": 3, "z/C.md": 1}


def test_backlink_context_needs_a_literal_line(spark):
    n = notes_of(spark, **{"d/T.md": "", "s1.md": "x\n see [[T|the note]] and [[other]] \n[[T]]", "s2.md": "[[ T ]]"})
    rows = LK.backlinks(n.where("path = 'd/T.md'"), n).collect()
    assert [(r["source"], r["context"]) for r in rows] == [("s1.md", "see the note and other")]


def test_orphans(spark):
    n = notes_of(spark, **{"a.md": "[[b]]", "d/b.md": "", "c.md": "", "e.md": "[[e]]"})
    assert {r["path"] for r in LK.orphans(n).collect()} == {"c.md"}
    assert {r["path"] for r in LK.orphans(n, observed=True).collect()} == {"a.md", "d/b.md", "c.md", "e.md"}


def test_resolve_names_tiers(spark):
    m = spark.createDataFrame([("d/My Note.md",), ("d/mynote2.md",), ("x/ab.md",), ("full/path.md",)], "path string")
    t = spark.createDataFrame([("my note",), ("mynote",), ("full/path",), ("b",), ("zzz",)], "target string")
    got = {(r["target"], r["path"]): r["score"] for r in LK.resolve_names(t, m).collect()}
    assert got == {
        ("my note", "d/My Note.md"): 100, ("my note", "d/mynote2.md"): 70, ("mynote", "d/My Note.md"): 95, ("mynote", "d/mynote2.md"): 80,
        ("full/path", "full/path.md"): 90, ("b", "x/ab.md"): 80,
    }


def test_resolve_names_by_brute_force(spark):
    """Counts and the best five over names that many notes share, blanks, short names and cases."""
    rng = random.Random(8)
    base = ["ab", "a b", "AB", "x", "", "long name", "longname", "Long  Name two", "b", "note", "c.md"]
    paths = {f"{rng.choice(['', 'd/', 'd/e/', 'F/'])}{rng.choice(base)}{rng.choice(['.md', '.MD', ''])}" for _ in range(60)}
    paths |= {f"hot/{i}/ab.md" for i in range(20)}
    paths = sorted(paths - {""})
    asked = ["ab", "a b", " AB ", "b", "", "   ", "long", "longnametwo", "d/ab", "F/X.MD", "hot/3/ab", "zzz", "name two", "c", ".md"]
    squeeze = lambda s: re.sub(r"\s+", "", s)
    want = {}
    for x in asked:
        t = x.strip().lower()
        tn = re.sub(r"\.md$", "", t)
        found = []
        for p in paths:
            n = re.sub(r"\.md$", "", p.rsplit("/", 1)[-1]).lower()
            a, b = squeeze(n), squeeze(tn)
            score = 100 if n == tn else 95 if a == b else 90 if p.lower() in (t, t + ".md") else 80 if tn in n or n in tn else 70 if b in a or a in b else 0
            if score:
                found.append((-score, p))
        for rank, (score, p) in enumerate(sorted(found)[:5], 1):
            want[x, rank] = (p, -score, len(found))
    m = spark.createDataFrame([(p,) for p in paths] + [(paths[0],)], "path string")
    t = spark.createDataFrame([(x,) for x in asked] * 2, "target string")
    got = LK.resolve_names(t, m)
    assert {(r["target"], r["rank"]): (r["path"], r["score"], r["matches"]) for r in got.collect()} == want
    one = {r["target"]: (r["matches"], r["path"]) for r in LK.resolved_target(got).collect()}
    assert one == {x: (n, p if n == 1 else None) for (x, rank), (p, _, n) in want.items() if rank == 1}
    assert LK.resolve_names(t.limit(0), m).count() == 0 and LK.resolve_names(t, m.limit(0)).count() == 0


def test_shared_counts_light_and_heavy(spark):
    rng = random.Random(5)
    sets = {f"n{i}": set(rng.sample("abcdefghijk", rng.randint(1, 9))) | ({"hot"} if i % 3 == 0 else set()) for i in range(40)}
    items = spark.createDataFrame([(p, x) for p, s in sets.items() for x in s], "path string, item string")
    want = {p: sum(bool(s & o) for q, o in sets.items() if q != p) for p, s in sets.items()}
    for limit, cold in ((2, 0), (12, 0), (3, 8), (12, 14), (1, 1000)):
        got = {r["path"]: r["n"] for r in RL.shared_counts(items, limit, cold).collect()}
        assert {p: got.get(p, 0) for p in want} == want


def test_related_first_notes(spark):
    sets = {f"n{i:02d}": {"hot", f"t{i % 4}"} for i in range(60)}
    items = spark.createDataFrame([(p, x) for p, s in sets.items() for x in s], "path string, item string")
    got = {}
    for r in RL._first(items, 5).collect():
        got.setdefault(r["path"], []).append((r["rank"], r["other"]))
    for p in sets:
        assert [o for _, o in sorted(got[p])] == [q for q in sorted(sets) if q != p][:5]


# --- automatic links -----------------------------------------------------------------
AUTO = {
    "d/Alpha beta.md": "About gamma and [[gamma ray]] and delta.", "d/gamma ray.md": "Alpha comes first; ALPHA again; delta",
    "d/delta.md": "---\nalpha\n" + "x" * 250 + " gamma here", "d/zz.md": "alpha gamma delta", "📕 gamma.pdf.md": "alpha",
}


def brute_candidates(notes, limit):
    import re

    def kws(title):
        return [w for w in re.findall("[a-z0-9]+", title.lower()) if len(w) >= 3]

    title = lambda p: p.rsplit("/", 1)[-1][:-3]
    ok = [p for p in sorted(notes) if len(title(p)) >= 3 and not p.startswith(("📕", "📘"))]
    out = []
    for s in ok:
        text = re.sub(r"\[\[[^\]|]+?(\|[^\]]*)?\]\]", lambda m: "\0" * len(m[0]), notes[s]).lower()
        have = {x.strip().lower() for x in re.findall(r"\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]", notes[s])}
        n = 0
        for t in ok:
            if t == s or title(t).lower() in have or n >= limit:
                continue
            for k in kws(title(t)):
                at = text.find(k)
                if at >= 0 and not (at < 200 and "---" in notes[s][:at]):
                    out.append((s, t, k, at))
                    n += 1
                    break
    return sorted(out)


@pytest.mark.parametrize("limit", [1, 2, 50])
@pytest.mark.parametrize("dictionary", [1, 1000])
def test_candidates_against_brute_force(spark, limit, dictionary):
    df = notes_of(spark, **AUTO)
    got = sorted((r["source"], r["target"], r["keyword"], r["offset"]) for r in AL.link_candidates(df, limit, dictionary_limit=dictionary).collect())
    assert got == brute_candidates(AUTO, limit)


def test_candidates_with_many_shared_titles(spark):
    notes = {f"d/{i:03d} topic{i % 7} common.md": f"common words topic{(i * 3) % 7} [[{i + 1:03d} topic{(i + 1) % 7} common]]" for i in range(80)}
    got = sorted((r["source"], r["target"], r["keyword"], r["offset"]) for r in AL.link_candidates(notes_of(spark, **notes), 10).collect())
    import re

    # ordinals at the start of a title are no keywords
    strip = {p: re.sub(r"^d/\d+ ", "d/", p) for p in notes}
    want = [w for w in brute_candidates(notes, 10)]
    assert [(s, t) for s, t, *_ in got] == [(s, t) for s, t, *_ in want]
    assert strip


def test_apply_and_revert(spark):
    n = notes_of(spark, **AUTO)
    c = AL.link_candidates(n)
    done = AL.apply_links(n, c)
    text = {r["path"]: r["content"] for r in done.collect()}
    assert "<!--@autolink:0:" in text["d/gamma ray.md"] and "[[Alpha]] comes first; ALPHA again" in text["d/gamma ray.md"]
    back = {r["path"]: r["content"] for r in AL.revert_links(done).collect()}
    assert back == AUTO
    overlap = spark.createDataFrame([("p", "t1", "abc", 0, ""), ("p", "t2", "bcd", 1, ""), ("p", "t3", "ef", 4, "")], "source string, target string, keyword string, offset int, preview string")
    one = AL.apply_links(notes_of(spark, p="abcdef"), overlap).first()["content"]
    assert one == "<!--@autolink:1:t1-->[[abc]]d<!--@autolink:0:t3-->[[ef]]"


# --- books ---------------------------------------------------------------------------
def test_assembled_pieces_put_together(spark):
    ch = spark.createDataFrame([("b", i, f"T{i}", " " if i == 2 else f"x{i}\n") for i in range(7)] + [("e", 0, "T", "")], "book string, ord int, title string, text string")
    rows = B.assemble_book(ch).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert "".join(r["text"] for r in rows) == "\n\n".join(f"## T{i}\n\nx{i}\n" for i in (0, 1, 3, 4, 5, 6)).strip()
    rep = {r["book"]: r["scanned"] for r in B.book_report(ch).collect()}
    assert rep == {"b": False, "e": True}


def test_list_tags_come_from_yaml(spark):
    n = notes_of(spark, **{
        "one.md": "---\ntags:\n  - red\n  - '#blue'\n---\nx", "two.md": "---\ntags: [red, red, 7]\n---\nx",
        "bad.md": "---\ntags: [red]\nx: [open\n---\nx", "text.md": "---\ntags: red, blue\n---\nx", "none.md": "x",
    })
    got = {r["path"]: r["t"] for r in n.select("path", list_tags(F.col("content")).alias("t")).collect()}
    assert got == {"one.md": ["red", "blue"], "two.md": ["red", "red", "7"], "bad.md": [], "text.md": [], "none.md": []}
    best = {r["term"]: (r["weight"], r["paths"]) for r in ST.concepts(n).collect()}
    assert best["red"] == (1.0, ["one.md", "two.md"]) and best["blue"] == (2 / 6, ["one.md"]) and "7" not in best
    moc = {(r["path"], r["other"], r["tag"]) for r in RL.note_moc(n).where("kind = 'same-tag'").collect()}
    assert moc == {("one.md", "two.md", "red"), ("two.md", "one.md", "red")}


def test_top_per_key_in_two_stages(spark, monkeypatch):
    rows = [("hot", i % 50, i) for i in range(400)] + [("cold", 1, 1), ("cold", 2, 2)]
    df = spark.createDataFrame(rows, "k string, a int, b int")
    order = [F.col("a"), F.col("b").desc()]
    want = {tuple(r) for r in scale.top_per_key(df, ["k"], order, 120).collect()}
    monkeypatch.setattr(scale, "WINDOW_LIMIT", 10)
    assert {tuple(r) for r in scale.top_per_key(df, ["k"], order, 120).collect()} == want
    assert scale.top_per_key(df, ["k"], order, None).count() == len(rows)


def test_book_note_header_is_taken_off(spark):
    b = spark.createDataFrame([("pdf", "n.pdf", 3, "body text")], "kind string, name string, chunks int, text string")
    note = B.book_note(b)
    assert note.first()["path"] == "📕 n.pdf.md"
    assert note.select(B.body_of_book_note(F.col("content")).alias("t")).first()["t"].strip() == "body text"


# --- chat, monitoring -------------------------------------------------------------------
def test_session_defaults(spark):
    c = spark.createDataFrame([(1, None, "user", "!", None, 1), (2, "s", "assistant", "x", None, 1)], "id bigint, session_id string, role string, content string, citations string, ts bigint")
    assert {r["session_id"]: r["title"] for r in CH.session_summary(c).collect()} == {"default": "历史对话", "s": "新对话"}


def test_memory_limits(spark):
    import json

    item = {"content": "c" * 300}
    topics = [{"title": "t" * 100, "items": [item] * 9}, {"title": "", "items": [item]}, {"title": "n", "items": [{"content": ""}]}, {"title": "fourth", "items": [item]}]
    df = spark.createDataFrame([("s", json.dumps({"topics": topics}), 5), ("s", "no json", 6)], "session_id string, reply string, ts bigint")
    t, i = CH.memory_from_replies(df)
    assert [len(r["title"]) for r in t.collect()] == [80]
    rows = i.collect()
    assert len(rows) == 6 and all(len(r["content"]) == 200 and r["kind"] == "fact" for r in rows)
    assert CH.memory_context(t.limit(0), i.withColumn("id", F.col("pos"))).first()["text"] == ""


def test_tool_call_aliases(spark):
    texts = ['a <tool_call>{"tool": "x", "parameters": {"k": 1}}</tool_call>', "```tool_call\n{\"name\": \"y\"}\n```", "<tool_call>{}</tool_call>", "none", '<tool_call>{"name": "z"} and more</tool_call>', '<tool_call>{"name": "z"}{"name": "z"}</tool_call>']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    assert [(r["i"], r["thought"], r["tool"], r["args"]) for r in agent.parse_tool_calls(df).orderBy("i").collect()] == [(0, "a", "x", '{"k":1}'), (1, "", "y", "{}")]


RUNS = "task string, run_id bigint, ts_ms bigint, exit int"
HOUR = 3_600_000


def run_rows():
    codes = [1, 1, 0, 1, 2, 1, 1, 1, 1, 0, 1, 0]
    hours = [0, 1, 2, 3, 4, 5, 6, 11, 12, 13, 14, 15]
    return [("t", i, h * HOUR, c) for i, (h, c) in enumerate(zip(hours, codes))] + [("u", 100 + i, i * HOUR, 1) for i in range(40)]


def test_alerts(spark):
    rows = MO.alert_events(spark.createDataFrame(run_rows(), RUNS)).orderBy("task", "ts_ms").collect()
    t = [(r["run_id"], r["event"], r["fails"]) for r in rows if r["task"] == "t"]
    # exactly six hours after the alert is too early, later is not
    assert t == [(5, "alert", 3), (8, "repeat", 6), (9, "recovery", 6)]
    assert [r["ts_ms"] // HOUR for r in rows if r["task"] == "u"] == [2, 9, 16, 23, 30, 37]


def test_health_without_runs(spark):
    log = MO.parse_sync_log(spark.createDataFrame([("noise", 1)], "value string, line_no int"))
    assert {r["check"]: r["status"] for r in MO.run_health(log).collect()} == {"runs": "WARN", "reports": "WARN"}


def test_concepts_and_stats_on_nothing(spark):
    n = notes_of(spark, **{"a.md": ""}).where("path = 'none'")
    assert ST.concepts(n).count() == 0
    r = ST.vault_stats(n, n).first()
    assert (r["notes"], r["links"], r["avg_chars"]) == (0, 0, 0)


def test_recover_text_spreads_long_paths(spark, monkeypatch):
    books = spark.createDataFrame([("📕 a.pdf",), ("📕 b.pdf",)], "path string")
    notes = spark.createDataFrame([("📕 b.pdf.md", "x" * 60)], "path string, content string")
    rows = [("📕 a.pdf", i, f"part {i} of the book") for i in range(30)] + [("notes/x.md", i, "other") for i in range(30)] + [("📕 b.pdf", 0, "y" * 60)]
    chunks = spark.createDataFrame(rows, "path string, idx long, content string")
    want = [("📕 a.pdf", i + 1, "chunks", ("\n\n" if i else "") + f"part {i} of the book") for i in range(30)] + [("📕 b.pdf", 1, "note", "x" * 60)]
    got = lambda: sorted(map(tuple, B.recover_text(books, notes, chunks).select("path", "pos", "source", "text").collect()))
    assert got() == want
    monkeypatch.setattr(B, "is_small", lambda df: False)
    assert got() == want
    # texts of one path meet their book in many tasks
    plan = B._of_books(chunks, books)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
