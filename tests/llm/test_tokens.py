"""Token counts against the library on whole texts."""

import pandas as pd
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import tokens
from corpusloom.llm.queries import QUERIES, tokenizer

PATH = tokenizer("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n \nb", " \n \n b", "\n\n", "a\n b", "tab\t b", "it's 's don't",
    "<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b<|endoftext|><|endoftext|>", "<|endoftext", "é ́ 中文 \U0001f600   x   y",
    "12 3.5 x_y --- ... !!", "w" * 5000, "ab " * 3000, "a\x1c \x1cb", "\u0085 \u0085x", "tie", "tie",
]


LIBRARY = Tokenizer.from_file(PATH)


def slow(t):
    return len(LIBRARY.encode(t or "", add_special_tokens=False).ids)


def test_counts(spark, monkeypatch):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as t", "3 as n_bytes")
    got = tokens.token_counts(df, PATH, limit=3).collect()
    want = [(d, len((t or "").encode()), slow(t), slow(t) > 3) for d, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.token_counts(df.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t'saé1.<| 　中x", max_size=40))
def test_any_white_space(text):
    pc = test_any_white_space.__dict__.setdefault("pc", tokens.PieceCounts(PATH))
    assert pc.count([text]) == [len(pc.tokenizer.encode(text, add_special_tokens=False).ids)]


def test_table_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_UNITS", 10)
    pc = tokens.PieceCounts(PATH)
    texts = [" ".join(f"word{i * k}" for i in range(30)) for k in range(5)]
    assert pc.count(texts) == [slow(t) for t in texts] and pc.count(texts) == [slow(t) for t in texts]
    assert len(pc.known) <= 10 and pc.count([]) == []


def test_query_on_given_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op9_token_counts"](spark, sf_dir).toPandas().set_index("doc_id")
    for d, t in zip(docs["doc_id"], docs["text"]):
        assert got.loc[d, "n_tokens"] == slow(t)
        assert got.loc[d, "n_bytes"] == len(t.encode())
    assert len(got) == len(docs)
