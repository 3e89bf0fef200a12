"""Aggregates of cohorts: shares, entropy, concentration, life tables, curves, modes, profiles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(k: Column, n: Column) -> Column:
    """Percentage; null where there is nothing to share."""
    return F.when(n != 0, 100.0 * k / n)


def entropy(counts: DataFrame, by: list[str], n: str) -> DataFrame:
    """(by, entropy, herfindahl): normalised Shannon entropy, 0 for one class, and the sum of squared shares."""
    w = Window.partitionBy(*by)
    p = F.col(n) / F.sum(n).over(w)
    g = counts.withColumn("_p", p).groupBy(*by).agg(F.sum(-F.col("_p") * F.log("_p")).alias("_h"), F.count("*").alias("_k"), F.sum(F.col("_p") * F.col("_p")).alias("herfindahl"))
    return g.select(*by, F.when(F.col("_k") > 1, F.col("_h") / F.log(F.col("_k").cast("double"))).otherwise(0.0).alias("entropy"), "herfindahl")


def life_table(df: DataFrame, at: Column, width: int = 10) -> DataFrame:
    """(bin, exits, at_risk) over bins of a share of the duration, from exits alone: the rest by a running sum."""
    g = df.filter(at.isNotNull()).select((F.floor(F.least(at, F.lit(99.999)) / width) * width).cast("int").alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("exits"))
    return g.withColumn("at_risk", F.sum("exits").over(Window.orderBy(F.desc("bin"))))  # at most 100 / width rows


def survival_curve(df: DataFrame, by: list[str], day: str, last: int) -> DataFrame:
    """(by, day, share) of those whose exit is at ``day`` or later, for every day of a spine of 1 to ``last``."""
    n = df.filter(F.col(day).isNotNull()).groupBy(*by, day).agg(F.count("*").alias("n"))
    spine = n.select(*by).distinct().withColumn(day, F.explode(F.sequence(F.lit(1), F.lit(last))))
    full = spine.join(n, [*by, day], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    after = n.filter(F.col(day) > last).groupBy(*by).agg(F.sum("n").alias("more"))
    w = Window.partitionBy(*by).orderBy(F.desc(day))
    x = full.join(after, by, "left").withColumn("still", F.sum("n").over(w) + F.coalesce("more", F.lit(0)))
    return x.select(*by, F.col(day).alias("day"), "still", share(F.col("still"), F.max("still").over(Window.partitionBy(*by))).alias("share"))


def mode_smallest(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, mode, n): the commonest value, of ties the smallest."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.max_by(F.struct(F.col(value).alias("mode"), "n"), F.struct(F.col("n"), (-F.col(value)).alias("v"))).alias("b")).select(*by, "b.*")


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, missing, different) in one pass; different values are counted exactly."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("champ"), F.col("n").alias("n"), F.col(f"m_{c}").alias("missing"), F.col(f"d_{c}").alias("different")) for c in columns])))


def histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n) with a zero for every value up to the largest that nobody has."""
    c = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("int").alias("v")).agg(F.count("*").alias("n"))
    spine = c.agg(F.max("v").alias("m")).filter("m >= 0").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("v"))
    return spine.join(c, "v", "left").select(F.col("v").alias(value), F.coalesce("n", F.lit(0)).alias("n"))


def top_of_each(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group under a total order, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def leaderboard(df: DataFrame, key: str, value: str, support: str, least: int, k: int, ascending: bool = False) -> DataFrame:
    """The ``k`` best by ``value`` among those with enough support; ties by key. TakeOrdered, not a global sort."""
    v = F.col(value).asc() if ascending else F.col(value).desc()
    return df.filter((F.col(support) >= least) & F.col(value).isNotNull()).orderBy(v, F.col(key).asc()).limit(k)


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def longest_run(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, longest, repeats): length of the longest run of equal values and the number of equal neighbours."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = df.withColumn("_same", F.coalesce((F.lag(value).over(w) == F.col(value)).cast("int"), F.lit(0)))
    x = x.withColumn("_run", F.sum(1 - F.col("_same")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = x.groupBy(*by, "_run").agg(F.count("*").alias("_n"))
    return r.groupBy(*by).agg(F.max("_n").alias("longest"), F.sum(F.col("_n") - 1).alias("repeats"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def global_rank(df: DataFrame, order: list[Column], name: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with its place under a total order, from a sort by ranges: no task holds all rows.

    ``cut`` materialises the sorted rows, so that a partition is the same when it is counted and when it is
    numbered; one count a partition comes to the driver.
    """
    part = F.spark_partition_id()
    rows = cut(df.orderBy(*order).withColumn("_p", part).withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    counts = sorted((r["_p"], r["n"]) for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for p, n in counts:
        starts.append((p, before))
        before += n
    start = df.sparkSession.createDataFrame(starts, "_p int, _s bigint")
    return rows.join(F.broadcast(start), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")  # a row a partition
