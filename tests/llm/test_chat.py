"""Chat formatting against a plain prefix comparison."""

import random

from corpusloom.llm import chat


def slow(rows):
    convs = {}
    for c, t, r, x in {r for r in rows if r[0] is not None}:
        convs.setdefault(c, set()).add((-1 if t is None else t, "user" if r is None else r, x or ""))
    seqs = {c: tuple((r, x) for _, r, x in sorted(ts)) for c, ts in convs.items()}
    kept = {}
    for c in sorted(seqs):
        s = seqs[c]
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()) or s in kept.values():
            continue
        kept[c] = s
    return sorted(
        (c, i + 1, len(s), r, f"<|im_start|>{r}\n{x}<|im_end|>\n", r == "assistant") for c, s in kept.items() for i, (r, x) in enumerate(s)
    )


def test_against_prefix_comparison(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = random.Random(3)
    rows, base = [], [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(40)]
    for c in range(60):
        n = rng.randint(1, 40)
        s = list(base[:n])
        if rng.random() < 0.4:
            s[rng.randrange(n)] = ("user", f"other {rng.randint(0, 2)}")
        rows += [(c, 3 * i, r, x) for i, (r, x) in enumerate(s)]
    rows += [(100, None, None, None), (100, 0, "assistant", "x"), (101, 0, "user", ""), (None, 0, "user", "lost"), (102, 1, "a", "tie"), (102, 1, "b", "tie")]
    rows += rows[:30]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as h1", "3 as n_turns")
    assert sorted(map(tuple, chat.format_chats(df).collect())) == slow(rows)
    assert chat.format_chats(df.limit(0)).count() == 0
