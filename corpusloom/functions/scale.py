"""Building blocks that stay correct and balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F


WINDOW_LIMIT = 100  # largest n for which n rows per task and key may meet in one task
RANK_SALTS = 32


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int | None, rank: str = "rank") -> DataFrame:
    """First n rows of every key, all of them where n is None.

    Spark cuts to n per task before the shuffle (window group limit, up to n = 1,000), so a
    hot key never sends more than n rows per task. Beyond WINDOW_LIMIT the rows of a key are
    first cut in RANK_SALTS parts, each of which is a task of its own, so that the last
    ranking of a key gets RANK_SALTS x n rows however many tasks there were."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if n is None:
        return df.withColumn(rank, F.row_number().over(w))
    if n > WINDOW_LIMIT:
        plain = [c for c, kind in df.dtypes if "map" not in kind and "variant" not in kind]
        df = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(RANK_SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_in", F.row_number().over(part)).where(F.col("_in") <= n).drop("_salt", "_in")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def running_sum(
    df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, out: str
) -> DataFrame:
    """Running total of `value` within `keys` in `order`, without one task per key.

    `block` must grow with `order` (a number or time divided into steps). Totals per
    block are summed first; each row then needs only its own block and one offset.
    """
    d = df.withColumn("_blk", block).withColumn("_val", value)
    ahead = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_blk")
        .agg(F.sum("_val").alias("_tot"))
        .withColumn("_off", F.coalesce(F.sum("_tot").over(ahead), F.lit(0)))
        .drop("_tot")
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        d.withColumn("_loc", F.sum("_val").over(inside))
        .join(offsets, [*keys, "_blk"])
        .withColumn(out, F.col("_loc") + F.col("_off"))
        .drop("_blk", "_val", "_loc", "_off")
    )


HOT_ROWS = 1_000_000


def lookup(left: DataFrame, index: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join to an index that is unique on `key`, with hot keys taken out of the shuffle.

    A key with more than `hot_rows` rows is hot; there are at most rows/hot_rows of
    them, so their index rows have a proven bound and are broadcast. Everything else
    takes the shuffled join. Rows without a match survive with nulls.
    """
    hot = left.groupBy(key).count().where((F.col("count") > hot_rows) & F.col(key).isNotNull()).select(key)
    if hot.isEmpty():
        return left.join(index, key, "left")
    hot_index = index.join(F.broadcast(hot), key, "left_semi")
    marked = left.join(F.broadcast(hot.withColumn("_is_hot", F.lit(True))), key, "left")
    cold = marked.where(F.col("_is_hot").isNull()).drop("_is_hot").join(index, key, "left")
    warm = marked.where(F.col("_is_hot")).drop("_is_hot").join(F.broadcast(hot_index), key, "left")
    return cold.unionByName(warm)


def materialize(df: DataFrame) -> DataFrame:
    """A narrow table that several branches need: computed when first used and kept in
    memory or, where that is short, on the executors' disks; a lost part is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


BROADCAST_ROWS = 200_000


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Counted, stopping just above the limit."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when the frame is counted and found within `limit` rows;
    otherwise the frame is returned as it is and the join shuffles."""
    return F.broadcast(df) if is_small(df, limit) else df
