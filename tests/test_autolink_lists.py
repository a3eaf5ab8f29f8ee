"""Automatic links with a large dictionary and with lists beside the broadcast ones."""

import random

import numpy as np
import pytest
from test_tables import AUTO, brute_candidates, notes_of

from corpusloom.functions import substrings
from corpusloom.operators import autolink as AL


def test_filter_passes_every_keyword_and_little_else(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc12知😀") for _ in range(rng.choice([1, 2, 3, 4, 7, 8, 9, 17]))) for _ in range(500)})
    known = substrings.build(spark.createDataFrame([(w,) for w in words], "keyword string"))
    assert known.table.nbytes * 8 == 1 << known.bits and int(np.unpackbits(known.table).sum()) > 500
    other = 0
    for _ in range(50):
        text = "".join(rng.choice("abc12知😀 ") for _ in range(200)) + rng.choice(words)
        got = substrings.first_places(text, known)
        want = {w: text.find(w) for w in words if w in text}
        assert {w: got[w] for w in want} == want
        other += len(got) - len(want)
    assert other < 500
    assert substrings.first_places("", known) == {}


def test_large_dictionary_gives_rows_for_mentions_only(spark):
    """Before, a text met every keyword whose rarest piece it holds: here all 400 of them."""
    words = spark.createDataFrame([(f"abc{i:03d}",) for i in range(400)], "keyword string")
    notes = notes_of(spark, **{f"{i}.md": f"abc {i:03d} abc{i:03d}" for i in range(40)})
    possible = AL._possible_hits(notes, words, 1)
    assert 40 <= possible.count() <= 60
    assert sorted((r["path"], r["keyword"], r["offset"]) for r in AL.keyword_hits(notes, words, 1).collect()) == sorted((f"{i}.md", f"abc{i:03d}", 8) for i in range(40))


@pytest.mark.parametrize("hot_rows", [0, 70, 10_000])
def test_candidates_from_broadcast_and_joined_lists(spark, hot_rows):
    many = {f"t/{i:02d} x/word{i % 3} n{100 + i}.md": f"word{i % 3} n{100 + (i * 7) % 30} [[word{(i + 1) % 3} n{100 + (i + 1) % 30}]]" for i in range(30)}
    many["t/links.md"] = "word0 word1 word2 n101 " + " ".join(f"[[word{i % 3} n{100 + i}]]" for i in range(25))
    for notes in (AUTO, many):
        got = sorted((r["source"], r["target"], r["keyword"], r["offset"]) for r in AL.link_candidates(notes_of(spark, **notes), 3, dictionary_limit=1, hot_rows=hot_rows).collect())
        assert got == brute_candidates(notes, 3)


def test_candidates_of_repeated_rows(spark):
    """Every copy of a source and of a target gives the row once more, with the copy's preview."""
    rows = [("d/alpha one.md", "nothing"), ("d/beta two.md", "see alpha"), ("d/beta two.md", "see alpha")]
    n = notes_of(spark, **dict(rows)).limit(0).unionByName(spark.createDataFrame(rows, "path string, content string"), allowMissingColumns=True)
    got = [(r["source"], r["target"], r["offset"], r["preview"]) for r in AL.link_candidates(n).collect()]
    assert got == [("d/beta two.md", "d/alpha one.md", 4, "see alpha")] * 2
