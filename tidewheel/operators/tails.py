"""The mean of a group's largest values by refining a histogram around the cut: no value is ranked, and equal values are one bucket that is added up, not rows that meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets to a doubling in the first histogram, buckets of each refinement, and refinements: afterwards a bucket holds some ten thousand neighbouring doubles at most.
DOUBLING, FINER, ROUNDS = 64, 1 << 16, 2
_STATE = "struct<left:bigint,above:double,lo:double,hi:double>"


def _meet(rows: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(state, by) if by else rows.join(F.broadcast(state))  # without groups the state is one row


def _cut(buckets: str) -> Column:
    """The bucket that holds the last of `left` largest values, from (d, n, s, lo, hi) in falling order: how many of it count, and the sum above it."""
    start = F.struct(F.col("left").alias("left"), F.col("above").alias("above"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")).cast(_STATE)
    over = lambda a, b: F.struct((a["left"] - b["n"]).alias("left"), (a["above"] + b["s"]).alias("above"), a["lo"].alias("lo"), a["hi"].alias("hi")).cast(_STATE)
    here = lambda a, b: F.struct(a["left"].alias("left"), a["above"].alias("above"), b["lo"].alias("lo"), b["hi"].alias("hi")).cast(_STATE)
    return F.aggregate(buckets, start, lambda a, b: F.when(a["hi"].isNotNull(), a).when(b["n"] >= a["left"], here(a, b)).otherwise(over(a, b)))


def tail_means(rows: DataFrame, by: list[str], column: str, share: float = 0.1) -> DataFrame:
    """(by..., tail_mean): mean of the max(1, ceil(share * n)) largest non-negative values of each group. Null values don't count; a group of nulls alone has no row; without
    `by` there is always one row, null where nothing counts.

    `rows` are read ROUNDS + 3 times, so they should be a kept table.
    """
    values = rows.filter(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("_v"))
    state = values.groupBy(*by).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).cast("long").alias("left"), F.lit(0.0).alias("above")).withColumn("tail", F.col("left"))
    inside = values
    for k in range(ROUNDS + 1):
        digit = F.coalesce(F.floor(F.log2(F.when(F.col("_v") > 0, F.col("_v"))) * DOUBLING), F.lit(-(1 << 30))) if k == 0 else F.when(F.col("hi") > F.col("lo"), F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * FINER)).otherwise(0)
        parts = inside.groupBy(*by, digit.cast("long").alias("d")).agg(F.count("*").alias("n"), F.sum("_v").alias("s"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        hist = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("d", "n", "s", "lo", "hi")), asc=False).alias("_b"))  # FINER buckets of a group at most, or those of the doublings
        state = _meet(hist, state, by).select(*by, "tail", _cut("_b").alias("_c")).select(*by, "tail", "_c.*")
        inside = _meet(values, state.select(*by, "lo", "hi"), by).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
    equal = inside.groupBy(*by, "_v").agg(F.count("*").alias("n"))
    last = equal.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_v", "n")), asc=False).alias("_b"))  # neighbouring doubles
    taken = F.aggregate("_b", F.struct(F.col("left").alias("left"), F.col("above").alias("above")), lambda a, b: F.struct((a["left"] - F.least(a["left"], b["n"])).alias("left"), (a["above"] + F.least(a["left"], b["n"]) * b["_v"]).alias("above")))
    return _meet(last, state.select(*by, "tail", "left", "above"), by).select(*by, F.when(F.size("_b") > 0, taken["above"] / F.col("tail")).alias("tail_mean"))
