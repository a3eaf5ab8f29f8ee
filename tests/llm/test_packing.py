"""Packing: every piece has one place, no place is shared, and few sequences are used."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from corpusloom.llm import packing
from corpusloom.llm.queries import QUERIES, tokenizer


def test_plan_places_every_piece():
    rng = random.Random(2)
    cases = [{}, {2048: 3}, {5: 1}, {1: 5000}, {2048: 1, 1025: 7, 1023: 7}, {700: 10, 400: 9, 300: 11, 20: 50}]
    cases += [dict(Counter(min(2048, int(rng.paretovariate(0.8) * 40)) for _ in range(n))) for n in (10, 500, 20_000)]
    cases += [dict(Counter(rng.randint(150, 1400) for _ in range(3000)))]
    for counts in cases:
        runs = packing.plan(counts)
        used = Counter()
        for lengths, n in runs:
            assert n > 0 and sum(lengths) <= 2048
            for k in lengths:
                used[k] += n
        assert used == Counter(counts)
        tokens, bins = sum(k * n for k, n in counts.items()), sum(n for _, n in runs)
        assert bins >= -(-tokens // 2048)
        if len(counts) > 300:
            assert bins <= 1.02 * tokens / 2048 + 25
        assert len(runs) < 20_000  # bounded by the capacity, not by the pieces


def test_plan_size_does_not_grow_with_the_pieces():
    rng = random.Random(4)
    counts = Counter(min(2048, int(rng.paretovariate(0.8) * 40)) for _ in range(20_000))
    small = len(packing.plan(dict(counts)))
    large = packing.plan({k: n * 100_000 for k, n in counts.items()})
    assert len(large) < 3 * small + 2000
    assert sum(n * len(k) for k, n in large) == sum(counts.values()) * 100_000


def check(out: pd.DataFrame, docs: list[tuple[int | None, str | None]]):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    want = []
    for d, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want.append((d, k, at, len(part), zlib.crc32(part.tobytes())))
    got = list(out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    got = [(None if pd.isna(d) else d, *r) for d, *r in got]
    assert sorted(got, key=str) == sorted(want, key=str)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    return out["sequence_id"].nunique(), -(-out["length"].sum() // 2048)


TEXTS = [
    "", None, "Hello WORLD", "a  b\t\tc　d e\x1cf", "don't it's 'S 12 3.5 x_y", "<|endoftext|> in <|startoftext|>text",
    "é ́ café Straße İI", "中文 \U0001f600\U0001f600 !!??", "x" * 5000, "word " * 9000, "\n\n", "tie tie", "tie tie",
]


def test_pack(spark):
    rows = [*enumerate(TEXTS), (None, "no id"), (3, "tie tie"), (11, "tie tie")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank", "'a' as piece")
    check(packing.pack(df, tokenizer("word_bpe_49k.json")).toPandas(), rows)


def test_words_are_what_the_library_makes_of_them(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    ids = packing.WordIds(tokenizer("word_bpe_49k.json"))
    texts = [" ".join(f"w{i % 90}" for i in range(500)), *(t or "" for t in TEXTS)]
    texts += ["Thed, thed. Thed... the!? x'S. 12. é, É! Ü?ü ß. İ, ŉ. ﬁ, a.b, .a, ,,, ª. straße: σς. ʼn, Ⅷ. ½, \u0301."]
    for t in texts * 2:
        words = ids.words(t)
        ids.learn(set(words))
        assert ids.of(words) == np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(ids.known) < 400


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_BLOCK", 7)
    rows = [(i, "same text" if i % 3 else f"w{i} " * (i % 40)) for i in range(600)]
    n, least = check(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer("word_bpe_49k.json")).toPandas(), rows)
    assert n <= least + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer("word_bpe_49k.json")).count() == 0


def test_query_on_given_table(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    n, least = check(QUERIES["op3_packing"](spark, sf_dir).toPandas(), list(zip(docs["doc_id"], docs["text"])))
    assert n <= 1.05 * least + 2


@pytest.mark.parametrize("sizes,demand", [([1024, 683, 512], [10, 30, 7]), ([1500, 548, 300], [5, 5, 100])])
def test_configurations_cover_the_demand(sizes, demand):
    out = packing.configurations(sizes, demand, 2048)
    assert [sum(p[i] * n for p, n in out) for i in range(3)] == demand
    assert all(sum(s * k for s, k in zip(sizes, p)) <= 2048 for p, _ in out)


def best_fit_decreasing(counts, capacity):
    """Number of sequences, piece by piece."""
    room = Counter()
    used = 0
    for length in sorted(Counter(counts).elements(), reverse=True):
        fits = [r for r, n in room.items() if n and r >= length]
        if fits:
            left = min(fits)
            room[left] -= 1
        else:
            left, used = capacity, used + 1
        room[left - length] += 1
    return used


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_few_sequences_as_plain_best_fit(seed):
    rng = random.Random(seed)
    shapes = [lambda: int(rng.lognormvariate(6, 1)), lambda: rng.randint(1, 2048), lambda: rng.choice([300, 341, 700, 1024])]
    lengths = [min(2048, max(1, shapes[seed - 1]() if rng.random() < 0.9 else rng.randint(1, 60))) for _ in range(4000)]
    counts = dict(Counter(lengths))
    runs = packing.plan(counts, 2048)
    assert Counter(x for one, n in runs for x in one for _ in range(n)) == Counter(lengths)
    assert all(sum(one) <= 2048 for one, _ in runs)
    used, bound = sum(n for _, n in runs), -(-sum(lengths) // 2048)
    assert used <= max(best_fit_decreasing(counts, 2048), 1.002 * bound) + 1


def test_the_plan_does_not_grow_with_the_documents():
    rng = random.Random(7)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6, 1)))) for _ in range(3000))
    small, large = packing.plan(counts, 2048), packing.plan({k: n * 100_000 for k, n in counts.items()}, 2048)
    bound = -(-sum(k * n for k, n in counts.items()) * 100_000 // 2048)
    assert len(large) < 4 * len(small) and sum(n for _, n in large) <= 1.002 * bound
