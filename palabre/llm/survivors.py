"""One surviving value per field from each group of duplicate records.

The best value of a field is the one with the most trusted provenance, then the latest. Where rows
of equal trust carry no time, their order is inferred: transitions between values seen in rows with
times give a precedence (a value usually followed by another is older). The precedences of a field,
the surest first, make up one order without cycles; every group takes from it the partial order of
its values, and a value that nothing follows, directly or over others, is the latest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import cut

PREFERENCES_MAX = 10_000  # rows of the preference list; a longer list is refused


@dataclass(frozen=True)
class Field:
    name: str
    value: Column  # as a string; null where the value is not usable


def trust(preferences: DataFrame, fields: list[str]) -> Column:
    """Rank of a freely written provenance ``source``, folded, for the field ``champ``: that of the longest listed source whose words it holds.

    Null where it holds none. The list is read on the driver; more than ``PREFERENCES_MAX`` rows raise.
    """
    rows = preferences.select("champ", "rang", words(F.col("source")).alias("s")).filter(F.col("champ").isin(fields) & (F.col("s") != "") & F.col("rang").isNotNull()).limit(PREFERENCES_MAX + 1).collect()
    if len(rows) > PREFERENCES_MAX:
        raise ValueError(f"more than {PREFERENCES_MAX} preferences")
    text = F.concat(F.lit(" "), F.col("source"), F.lit(" "))
    out = F.lit(None).cast("int")
    for f in fields:
        mine = F.lit(None).cast("int")
        for r in sorted((r for r in rows if r["champ"] == f), key=lambda r: (len(r["s"]), r["s"], -r["rang"])):  # the longest is asked first
            mine = F.when(F.contains(text, F.lit(f" {r['s']} ")), F.lit(int(r["rang"]))).otherwise(mine)
        out = F.when(F.col("champ") == f, mine).otherwise(out)
    return out


def _long(rows: DataFrame, key: list[str], line: str, time: str, sources: str, fields: list[Field], preferences: DataFrame) -> DataFrame:
    parts = [F.struct(F.lit(f.name).alias("champ"), f.value.cast("string").alias("v"), words(F.col(sources).getItem(f.name)).alias("source")) for f in fields]
    k = [F.col(c).alias(f"k{i}") for i, c in enumerate(key)]
    long = rows.select(*k, F.col(line).alias("line"), F.col(time).alias("t"), F.inline(F.array(*parts))).filter(F.col("v").isNotNull())
    return long.withColumn("rang", trust(preferences, [f.name for f in fields])).drop("source")


def precedence(values: DataFrame, keys: list[str]) -> DataFrame:
    """(champ, older, newer, net): how much oftener ``newer`` follows ``older`` than the reverse.

    Learned from consecutive different values of a group, each at its ``first`` time, so a group weighs by its
    values, not rows.
    """
    w = Window.partitionBy(*keys, "champ").orderBy("first", "v")
    steps = values.filter(F.col("first").isNotNull()).select("champ", F.lag("v").over(w).alias("older"), F.col("v").alias("newer")).filter(F.col("older").isNotNull())
    n = steps.groupBy("champ", "older", "newer").agg(F.count("*").alias("n"))
    # both directions of a pair meet in one row
    pair = n.groupBy("champ", F.least("older", "newer").alias("a"), F.greatest("older", "newer").alias("b")).agg(F.sum(F.when(F.col("older") < F.col("newer"), F.col("n")).otherwise(-F.col("n"))).alias("net"))
    up = F.col("net") > 0
    return pair.filter("net <> 0").select("champ", F.when(up, F.col("a")).otherwise(F.col("b")).alias("older"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("newer"), F.abs("net").alias("net"))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (older, newer) of one field's order: precedences are taken up by weight unless a surer one says the contrary."""
    edges = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (-r["net"], r["older"], r["newer"]))
    at = {v: i for i, v in enumerate(sorted({x for r in edges for x in (r["older"], r["newer"])}))}
    after, before = [0] * len(at), [0] * len(at)  # sets of values, as bits
    for r in edges:
        a, b = at[r["older"]], at[r["newer"]]
        if after[b] >> a & 1 or after[a] >> b & 1:
            continue
        low, high = before[a] | 1 << a, after[b] | 1 << b
        for i in range(len(at)):
            if low >> i & 1:
                after[i] |= high
            if high >> i & 1:
                before[i] |= low
    names = list(at)
    out = [(edges[0]["champ"], names[i], names[j]) for i in range(len(at)) for j in range(len(at)) if after[i] >> j & 1]
    yield pa.RecordBatch.from_pylist([dict(zip(("champ", "older", "newer"), x)) for x in out], pa.schema([("champ", pa.string()), ("older", pa.string()), ("newer", pa.string())]))


def order_of_values(precedences: DataFrame) -> DataFrame:
    """(champ, older, newer): the transitive order of each field's values. A field's values are one task's, so a field has a domain, as ages, days and codes have."""
    return precedences.select("champ", "older", "newer", "net").groupBy("champ").applyInArrow(_ordered, "champ string, older string, newer string")


def _followed(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, champ, v, followed): values of the highest trust that another one of their group follows, where that trust has a row without time.

    ``values`` has the highest trust ``top_r`` of its group, that of its own timed and untimed rows and the
    latest time of each trust. Of the timed values of the highest trust the latest alone is a rival of the untimed ones.
    """
    w = Window.partitionBy(*keys, "champ")
    v = values.withColumn("untimed", F.coalesce(F.col("untimed_r") == F.col("top_r"), F.lit(False))).filter(F.col("best.r") == F.col("top_r"))
    v = v.withColumn("latest", F.max(F.when(F.col("best.timed"), F.col("best.t"))).over(w)).withColumn("unsure", F.max("untimed").over(w)).filter("unsure")
    rivals = v.filter(F.col("untimed") | (F.col("best.t") == F.col("latest"))).select(*keys, "champ", "v")
    later = rivals.join(order_of_values(precedence(values, keys)).withColumnRenamed("older", "v"), ["champ", "v"])
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "champ"]] + [F.col("l.newer") == F.col("r.v")]
    return later.alias("l").join(rivals.alias("r"), on, "left_semi").select(*keys, "champ", "v").distinct().withColumn("followed", F.lit(True))


def best_values(rows: DataFrame, preferences: DataFrame, key: list[str], line: str, time: str, sources: str, fields: list[Field], at_least: int = 2) -> DataFrame:
    """(key..., champ, ligne) for each group of ``at_least`` rows and each field with a usable value.

    ``ligne`` is the smallest ``line`` of the group's rows that hold the best value. Best: rank of the
    provenance (no listed provenance comes last), then the latest ``time``. Where rows of the best rank
    have no time, a value of theirs or the latest timed one wins if the learned order places no rival after
    it; of several such a timed one wins. Ties left go to the smallest line. Rows with a null in the key form a group
    with each other, as in a GROUP BY. Repeated rows, null maps and empty tables need no care of the
    caller; other columns of ``rows`` are not read.
    """
    keys = [f"k{i}" for i in range(len(key))]
    long = _long(rows, key, line, time, sources, fields, preferences)
    # one row for each value: map-side partial aggregation collapses a hot group to its domain
    rank = F.coalesce(F.col("rang"), F.lit(2**31 - 1))
    values = long.groupBy(*keys, "champ", "v").agg(
        F.max(F.struct((-rank).alias("r"), F.col("t").isNotNull().alias("timed"), F.col("t").alias("t"))).alias("best"), F.min("line").alias("line"),
        F.max(F.when(F.col("t").isNull(), -rank)).alias("untimed_r"), F.min("t").alias("first"),
    )
    values = cut(values.withColumn("top_r", F.max("best.r").over(Window.partitionBy(*keys, "champ"))))
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, "champ", "v"]]
    scored = values.alias("x").join(_followed(values, keys).alias("s"), on, "left").select("x.*", F.coalesce("s.followed", F.lit(False)).alias("followed"))
    order = F.struct(F.col("best.r"), ~F.col("followed"), F.col("best.timed"), F.col("best.t"), (-F.col("line")).alias("l"))
    best = scored.groupBy(*keys, "champ").agg(F.max_by("line", order).alias("ligne"))
    size = rows.groupBy(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)]).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
    on = [F.col(f"g.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = best.alias("b").join(size.alias("g"), on, "left_semi")
    return out.select(*[F.col(f"b.{k}").alias(c) for k, c in zip(keys, key)], "champ", "ligne")
