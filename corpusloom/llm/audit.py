"""Filter interaction audit by recursive enumeration of filter orders.

Five filters, one letter each, mark documents that fail them:

A  under MIN_WORDS words            D  holds one of the SYMBOLS
B  under half of the words distinct E  same text as a document with a smaller id, table-wide
C  over 3 % capital letters A-Z

1. Every document becomes a mask of the filters it fails; documents are counted per part
   (language), mask and label. These cells, at most 32 per part, are all that follows.
2. A recursive query starts with the empty prefix of each mask and extends it by every
   letter that its applied bits do not hold yet; every level emits what the new letter does
   to the mask: whether it fails it, and whether an earlier letter has removed it. That is
   32 x 326 rows whatever the data are.
3. The levels meet the cells on the mask and are summed per part and prefix; each of the 120
   orders takes the five sums of its own prefixes.

Same texts are found by a 128-bit hash; the least id of each is found in the tasks before it
moves, and meets its document again on hash and id, so a very common text is no hot key.

Defined cases: a null text is empty; a null language is the part ""; documents without labels
are neither good nor toxic, repeated label rows count once; rows that repeat an id count as
documents each, and do not fail E because of one another; a null id never fails E and makes
no other document fail; very long texts are read whole, one at a time; extra columns are
ignored; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import stored

LETTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = "#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def own_mask(text: str) -> tuple[int, int, int]:
    """Bits of the filters A to D that a text fails (A is bit 0), and its 128-bit hash."""
    from xxhash import xxh3_128_intdigest

    raw = text.encode("utf-8", "surrogatepass")
    ws = raw.split()  # at [\x20\x09-\x0D]
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    mask = (
        (len(ws) < MIN_WORDS) | (100 * len(set(ws)) < 50 * len(ws)) << 1 | (100 * capitals > 3 * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS.encode())) < len(raw)) << 3
    )
    h = xxh3_128_intdigest(raw)
    return mask, (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part, mask: the filters every document fails."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [own_mask(t) for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "part": b["part"], **{c: [f[i] for f in found] for i, c in enumerate(("mask", "h1", "h2"))}})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    ).mapInPandas(run, f"id {kind}, part string, mask int, h1 long, h2 long"))
    # joined on the id besides the hash, so that a text that very many documents have is not one key
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["id", "h1", "h2"], "left").select("id", "part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents, and those labelled good and toxic, per cell."""
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return (
        masks(docs, id_col, text_col, part_col).join(marked, "id", "left")
        .groupBy("part", "mask").agg(F.count("*").alias("n"), total("good"), total("toxic"))
    )


# every prefix of every order, for each of the 32 masks; `gone` says that an applied letter has removed the mask
PREFIXES = f"""
WITH RECURSIVE
letters AS (SELECT explode(sequence(0, {len(LETTERS) - 1})) AS l),
step(mask, prefix, letter, bit, applied, n) AS (
  SELECT explode(sequence(0, {(1 << len(LETTERS)) - 1})), '', '', 0, 0, 0
  UNION ALL
  SELECT mask, concat(prefix, substr('{LETTERS}', l + 1, 1)), substr('{LETTERS}', l + 1, 1), shiftleft(1, l), applied | shiftleft(1, l), n + 1
  FROM step JOIN letters ON applied & shiftleft(1, l) = 0
)
SELECT mask, prefix, letter, n AS step,
  (mask & bit) <> 0 AND (mask & (applied - bit)) = 0 AS removed,
  (mask & bit) <> 0 AND (mask & (applied - bit)) <> 0 AS redundant,
  mask = bit AS alone,
  (mask & applied) = 0 AS kept
FROM step WHERE n > 0"""


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step. Cases: see the module's text."""
    spark = docs.sparkSession
    found = cells(docs, labels, id_col, text_col, part_col)
    levels = stored(spark.sql(PREFIXES))
    def when(flag: str, of: str = "n"):
        return F.sum(F.when(F.col(flag), F.col(of)).otherwise(0)).cast("long")

    # every mask meets the cells it is in, so a part has all of its prefixes whatever its masks are
    steps = (
        found.join(levels, "mask")
        .groupBy("part", "prefix", "letter", "step")
        .agg(
            when("kept").alias("kept"), when("removed").alias("removed"), when("redundant").alias("redundant"),
            when("alone").alias("unique_fails"), when("removed", "good").alias("good_lost"), when("removed", "toxic").alias("toxic_lost"),
        )
    )
    orders = levels.where(f"mask = 0 and step = {len(LETTERS)}").select(
        F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")
    ).withColumn("prefix", F.expr("substr(filter_order, 1, step)"))
    out = steps.join(orders, ["prefix", "step"])
    shapley = out.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return out.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
