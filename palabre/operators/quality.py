"""Data contracts: rules give violations with a level, and a report by rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rule: str, level: str, key: Column, bad: Column, message: str) -> DataFrame:
    """(level, rule, key, message) of the rows for which ``bad`` is true."""
    return df.filter(F.coalesce(bad, F.lit(False))).select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), key.cast("string").alias("key"), F.lit(message).alias("message"))


def unique_key(df: DataFrame, key: list[str], rule: str, level: str = "error") -> DataFrame:
    d = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return d.select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key"), F.lit("key repeats").alias("message"))


def foreign_key(df: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str], rule: str, level: str = "error") -> DataFrame:
    """Keys of ``df`` that ``parent`` lacks, each once. Nulls refer to nothing."""
    d = df.select(*columns).dropna().distinct()
    p = parent.select(*[F.col(b).alias(a) for a, b in zip(columns, parent_columns)]).distinct()
    return d.join(p, columns, "left_anti").select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in columns]).alias("key"), F.lit("no such parent").alias("message"))


def report(found: list[DataFrame]) -> DataFrame:
    every = reduce(lambda a, b: a.unionByName(b), found)
    return every.groupBy("level", "rule").agg(F.count("*").alias("n"), F.min("key").alias("example"))
