"""Line deduplication against counting all lines."""

import random

from corpusloom.llm import lines


def slow(rows, min_docs=3):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    holders = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 20:
                    holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        keep = [x for x in ls if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append((d, "\n".join(keep), len(ls), len(ls) - len(keep)))
    return sorted(out, key=str)


def test_against_counting(spark):
    rng = random.Random(6)
    pool = [f"A common line number {i} of some length" for i in range(12)] + ["short", "", "   ", "exactly twenty chars", "nineteen characters", "Éa line with accents öüß éé"]
    line = lambda: rng.choice(["", " ", "\t"]) + (x if rng.random() < 0.7 else x.upper() if (x := rng.choice(pool)).isascii() else x) + rng.choice(["", " ", "\r"]) if (x := rng.choice(pool)) is not None else ""
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, pool[0] + "\n" + pool[1]), (502, "\n\n"), (7, pool[0] * 2 + "\n" + pool[0]), (503, "\n".join(pool * 500)), (-4, pool[2])]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_lines", "'x' as pos", "2 as a", "3 as _doc", "4 as _left_", "5 as keeper")
    for batches, fan_in in ((4, 2), (1, 2), (7, 3)):
        out = lines.dedup_lines(df, batches=batches, fan_in=fan_in)
        assert out.columns == [*df.columns, "n_lines_", "n_dropped"]
        got = sorted([(r["doc_id"], r["text"], r["n_lines_"], r["n_dropped"]) for r in out.collect()], key=str)
        assert got == slow(rows)
    assert lines.dedup_lines(df.limit(0)).count() == 0
    assert lines.dedup_lines(df.where("doc_id is null")).count() == 1


def test_runs_are_levelled_and_settled_keys_stay_out(spark):
    runs = lines.LineRuns(min_docs=2, fan_in=3)
    batch = lambda docs: spark.createDataFrame([(k, k, d) for d in docs for k in (1, 10 + d)], "a long, b long, doc long")
    for i in range(8):
        runs.add(batch([100 - 2 * i, 99 - 2 * i]))
    assert [len(level) for level in runs.levels] == [2, 2]
    # key 1 was settled in the first batch and was never written again
    assert sum(r.where("a = 1").count() for r in runs.runs()) == 1
    one = {r["a"]: (r["n_docs"], r["max_doc"]) for r in runs.compacted().collect()}
    assert one[1] == (2, 100) and len(one) == 17 and len(runs.runs()) == 1
