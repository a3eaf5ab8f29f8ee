"""Hand-worked cases of the text functions."""

from pyspark.sql import functions as F

from corpusloom.functions import cutting, hashing, text as X


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_tokens_mixed_scripts(spark):
    t = value(spark, X.tokenize(F.lit("The Quick a_b x 12 知识的图谱")))
    # the stop character breaks the pairs on both sides of it
    assert t == ["quick", "a_b", "12", "知", "识", "图", "谱", "知识", "图谱"]


def test_tokens_keep_multiplicity_and_empty(spark):
    assert value(spark, X.tokenize(F.lit("cat cat of"))) == ["cat", "cat"]
    assert value(spark, X.tokenize(F.lit(None).cast("string"))) == []
    assert value(spark, X.tokenize(F.lit("the of a"))) == []


def test_rerank_list_is_larger(spark):
    assert value(spark, X.tokenize_rerank(F.lit("she wins 这本书"))) == ["wins", "本", "书", "本书"]


def test_title_keywords_order(spark):
    got = value(spark, X.title_keywords(F.lit("a/2024-01-05 03. 读书知识图谱是我们 Deep learning 42.md")))
    assert got == ["deep", "learning", "知识", "识图", "图谱", "谱是", "是我", "42"]


def test_snippet(spark):
    text = "a" * 150 + " needle " + "b" * 150
    s = value(spark, X.snippet(F.lit(text), F.array(F.lit("absent"), F.lit("needle"))))
    assert s == "..." + "a" * 99 + " needle " + "b" * 99 + "..."
    assert value(spark, X.snippet(F.lit("x  y\nz"), F.array(F.lit("q")))) == "x y z"
    assert value(spark, X.snippet(F.lit("c" * 300), F.array(F.lit("q")))) == "c" * 200 + "..."


def test_highlight(spark):
    assert value(spark, X.highlight(F.lit("Use C++ and c++"), F.lit("c++ x"))) == "Use <mark>C++</mark> and <mark>c++</mark>"
    assert value(spark, X.highlight(F.lit("abc"), F.lit("a"))) == "abc"


def test_tags(spark):
    c = "---\ntags: [a, 'b', \"#c\"]\ntag: '#hot'\n---\n#x/y (#知识) mid#no"
    assert value(spark, X.quick_tags(F.lit(c))) == ["a", "b", "c", "hot"]
    body = "#x/y (#知识) mid#no"
    got = value(spark, X.all_tags(F.lit(body), F.array(F.lit("#a"), F.lit("x/y")), F.lit("#t")))
    assert got == ["a", "x/y", "t", "知识"]
    none = F.lit(None).cast("array<string>")
    assert value(spark, X.note_tags(none, F.lit("a, b  c"))) == ["a", "b", "c"]


def test_link_dialects(spark):
    c = F.lit("[[a|b]] [[ c ]] [[d|]] [[!e]] [[f]] [[f]] [[q.MD]]")
    assert value(spark, X.links_render(c)) == ["a", "c", "d", "!e", "f", "q.MD"]
    assert value(spark, X.links_wiki(c)) == ["a", "c", "!e", "f", "q.MD"]
    assert value(spark, X.links_graph(c)) == ["a.md", "c.md", "d.md", "f.md", "f.md", "q.MD"]


def test_names_and_encoding(spark):
    assert value(spark, X.title_of(F.lit("a/b.MD"))) == "b.MD"
    assert value(spark, X.title_of(F.lit("a/b.MD"), any_case=True)) == "b"
    assert value(spark, X.encode_path(F.lit("a b/(c)!~'*.md"))) == "a%20b/(c)!~'*.md"
    assert value(spark, X.safe_file_name(F.lit('x/a:b?"c.md'))) == "a_b__c"
    assert value(spark, X.session_title(F.lit("  How are you? fine"))) == "How are you"
    assert value(spark, X.session_title(F.lit("。x"))) is None


def test_json_payload(spark):
    assert value(spark, X.json_payload(F.lit('x ```json\n{"a": 1}\n``` y'))) == '{"a": 1}'
    assert value(spark, X.json_payload(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    assert value(spark, X.json_payload(F.lit("none"))) == "none"


def slow_hash(units) -> int:
    h = 5381
    for u in units:
        h = (h * 33 + u) & 0xFFFFFFFF
    return h


def test_hashes(spark):
    for t in ("", "a", "知识" * 3000, "x" * 9000):
        assert hashing.byte_hash(t.encode()) == slow_hash(t.encode())
    for g in ("ab", "abc", "知识图谱", "zzzz"):
        h = slow_hash(map(ord, g))
        assert value(spark, X.gram_hash(F.lit(g))) == (h - (1 << 32) if h >= 1 << 31 else h)
    assert hashing.base36(35) == "z" and hashing.base36(36) == "10"


def test_vector_norm_and_buckets():
    v = hashing.ngram_vector("Hello  World")
    assert abs(float((v * v).sum()) - 1) < 1e-6
    assert not hashing.ngram_vector(" \n ").any()
    assert not hashing.ngram_vector("x").any()
    assert (hashing.ngram_vector("A b") == hashing.ngram_vector(" a   B ")).all()


# --- cutting ----------------------------------------------------------------------
def heads(text, **kw):
    return list(cutting.chunk_by_heading("n", text, **kw))


def test_heading_sections():
    text = "intro\n## One\nbody one\n\n## Two\n\n  body two  \n### sub\n"
    got = heads(text)
    assert [(h, c) for h, c, _, _ in got] == [("One", "body one"), ("Two", "body two  \n### sub")]
    assert all(text[s:e] == c for _, c, s, e in got)
    assert [h for h, *_ in heads(text, keep_preamble=True)] == ["n", "One", "Two"]
    assert [(h, c) for h, c, _, _ in heads("plain")] == [("n", "plain")]
    assert [(h, c) for h, c, _, _ in heads("")] == [("n", "")]


def test_heading_cut_lengths():
    assert len(heads("x" * 800)) == 1
    two = heads("x" * 801)
    assert [(s, e) for _, _, s, e in two] == [(0, 800), (700, 801)]
    # a break exactly at the minimum is not used, one character later it is
    at = heads("x" * 100 + "\n" + "y" * 900)
    assert at[0][3] == 800
    later = heads("x" * 101 + "\n" + "y" * 900)
    assert later[0][3] == 101
    blank = heads("x" * 300 + "\n\n" + "y" * 300 + "\n" + "z" * 400)
    assert blank[0][1] == "x" * 300


def test_heading_invariants(spark, sf_dir):
    from corpusloom.operators import chunking
    from corpusloom.plans import derive

    notes = derive.notes(spark, sf_dir)
    ch = chunking.chunk_by_heading(notes)
    j = ch.join(notes.select("path", F.col("content").alias("full")), "path")
    bad = j.where(
        (F.length("content") > 800)
        | (F.substring("full", F.col("start_offset") + 1, F.col("end_offset") - F.col("start_offset")) != F.col("content"))
    )
    assert bad.count() == 0


def paras(text, size=400):
    return [(h, c) for h, c, _, _ in cutting.chunk_by_paragraph("n", text, size)]


def test_paragraph_mode():
    assert paras("") == []
    assert paras("a\n\nb") == [("n #1", "a\n\nb")]
    # a flush leaves its tail, which becomes a chunk of its own at the end
    assert paras("x" * 400) == [("n #1", "x" * 400), ("n #2", "x" * 100)]
    assert paras("x" * 600)[0] == ("n #1", "x" * 600)
    long = paras("x" * 601)
    assert [len(c) for _, c in long] == [400, 301]
    mixed = paras("a" * 10 + "\n\n" + "b" * 601)
    assert [c[0] for _, c in mixed] == ["a", "b", "b"]
