"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import stored

SALTS = 16


def _to_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Join of pairs (x, y) with the least (x, m). A node with very many neighbours is dealt
    over SALTS parts, which costs SALTS rows per node on the narrow side."""
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("int")).join(salted, ["x", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node reachable.

    Large-star connects every larger neighbour of a node to the smallest one, small-star
    the smaller ones; the graph shrinks to stars in O(log^2 n) rounds. Every round is
    written to the shared folder, so that no round depends on executors of an earlier one.
    Loops and nulls are ignored; without edges there are no rows."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = stored(edges.where("a is not null and b is not null and a <> b").select(u, v).distinct())
    sign = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"))
    before = None
    while True:
        mark = now.select(sign.alias("s")).first()["s"]
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = _to_least(both, least).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = _to_least(large, least).where("y <> m").select(F.col("y").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
