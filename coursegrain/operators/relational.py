"""Windows, set operations and joins of the lesson pipeline that are no plain one-liners in DataFrame terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursegrain.sources.tables import cut


def windows(df: DataFrame, keys: list[str], tokens: Column, size: int, overlap: int) -> DataFrame:
    """(keys, chunk_no, first, last, chunk): consecutive windows of ``size`` tokens, each ``overlap`` into the one before."""
    step = size - overlap
    t = df.select(*keys, tokens.alias("_t")).where("size(_t) > 0")
    starts = F.filter(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(step)), lambda s: (s == 0) | (s + overlap < F.size("_t")))
    e = t.select(*keys, "_t", F.posexplode(starts).alias("_p", "_s"))
    return e.select(*keys, (F.col("_p") + 1).cast("bigint").alias("chunk_no"), F.col("_s").cast("bigint").alias("first"), F.least(F.col("_s") + size, F.size("_t")).cast("bigint").alias("last"), F.array_join(F.slice("_t", F.col("_s") + 1, size), " ").alias("chunk"))


def coverage_sample(df: DataFrame, group: list[str], bucket: str, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows a group, taken in turns from its buckets in the order in which they first appear."""
    in_bucket = W.partitionBy(*group, bucket)
    # later turns than the limit can't be taken, so a hot bucket is cut before it is shuffled; its first row is among those left
    turn = df.withColumn("_r", F.row_number().over(in_bucket.orderBy(order))).where(F.col("_r") <= limit).withColumn("_b", F.min(order).over(in_bucket))
    picked = turn.withColumn("pick", F.row_number().over(W.partitionBy(*group).orderBy("_r", "_b")))
    return picked.where(F.col("pick") <= limit).drop("_r", "_b")


def recent_within_budget(df: DataFrame, group: list[str], text: str, order: str, rows: int, budget: int) -> DataFrame:
    """The latest rows of a group while they are at most ``rows`` and their lengths (+1 each) sum to at most ``budget``."""
    back = W.partitionBy(*group).orderBy(F.desc(order))
    x = df.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= rows)
    x = x.withColumn("_s", F.sum(F.length(text) + 1).over(back.rowsBetween(W.unboundedPreceding, 0)))
    return x.where((F.col("_s") <= budget) | (F.col("_n") == 1)).drop("_n", "_s")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node name of each connected component, by alternating star contraction.

    Each round links the neighbours of a node to the smallest of them, so the number of rounds grows with the logarithm of the
    longest path; every round ends in a reliable checkpoint.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    now = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while now.take(1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        following = cut(small)
        changed = following.exceptAll(now).limit(1).count()
        now = following
        if not changed:
            break
    return nodes.join(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def forward_filled(df: DataFrame, group: list[str], order: str, marks: dict[str, Column]) -> DataFrame:
    """Each column of ``marks`` as its last value that is not null, up to the row."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in marks.items()])
