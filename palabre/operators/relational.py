"""Joins and lookups over ordered sessions: as-of with a barrier, pairs, reciprocity, exposure, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(sessions: DataFrame, group: str, seq: str, complete: str) -> DataFrame:
    """``sessions`` with ``seg``: the running number of incomplete sessions of the group, which break every chain."""
    w = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return sessions.withColumn("seg", F.sum(F.when(F.col(complete), 0).otherwise(1)).over(w))


def asof_barrier(presence: DataFrame, group: str, person: str, seq: str, value: str, strict: bool = True, depth: int = 1) -> DataFrame:
    """``presence`` with ``prev``: the value at the person's last (or ``depth``-th last) attended session.

    ``presence`` holds a row a person and session with ``seg`` and ``complete``. Strict: a session that wasn't read
    whole breaks the chain for everybody, present or not. Relaxed: it is skipped. Nothing before: null.
    """
    keys = [group, person] + (["seg"] if strict else [])
    w = Window.partitionBy(*keys).orderBy(seq)
    return presence.filter(F.col("complete")).withColumn("prev", F.lag(value, depth).over(w))


def present_people(ballots: DataFrame, sessions: DataFrame) -> DataFrame:
    """(saison, numero, id): people named in a session as voter, target or eliminated, each once."""
    a = ballots.filter("votant_ok").select("saison", "numero", F.col("votant").alias("id"))
    b = ballots.filter("cible_ok").select("saison", "numero", F.col("cible").alias("id"))
    c = sessions.filter(F.coalesce("elimine_rattache", F.lit(False))).select("saison", "numero", F.col("elimine").alias("id"))
    return a.union(b).union(c).filter(F.col("id").isNotNull()).distinct()


def pairs(df: DataFrame, keys: list[str], member: str, carry: list[str] = ()) -> DataFrame:
    """Unordered pairs of members of a session: (keys, a, b), carried columns with suffixes."""
    a = df.select(*keys, F.col(member).alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = df.select(*keys, F.col(member).alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, keys).filter(F.col("a") < F.col("b"))


def merge_by_preference(left: DataFrame, right: DataFrame, key: list[str], prefer: dict[str, str]) -> DataFrame:
    """Full outer merge of two sources with provenance: for each field of ``prefer`` the preferred side ('a' or 'b'), else the other."""
    fields = list(prefer)
    x = left.select(*key, *[F.col(f).alias(f"{f}_a") for f in fields]).join(right.select(*key, *[F.col(f).alias(f"{f}_b") for f in fields]), key, "full_outer")
    out = [F.col(k) for k in key]
    for f in fields:
        first, second = (f"{f}_a", f"{f}_b") if prefer[f] == "a" else (f"{f}_b", f"{f}_a")
        out += [F.coalesce(first, second).alias(f), F.when(F.col(first).isNotNull(), F.lit(first[-1])).when(F.col(second).isNotNull(), F.lit(second[-1])).alias(f"{f}_from"), (F.col(first).isNotNull() & F.col(second).isNotNull() & (F.col(first) != F.col(second))).alias(f"{f}_differs")]
    return x.select(*out)


def nearest_backfill(df: DataFrame, person: str, at: str, value: str, shift: bool) -> DataFrame:
    """``df`` with ``filled``: a missing value taken from the person's row nearest in ``at``, shifted by the distance if asked.

    The nearest before and after are the last and next known of a window, so a person of many rows makes no pairs.
    """
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    w = Window.partitionBy(person).orderBy(at)
    before = F.last(known, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    d = df.withColumn("_b", before).withColumn("_a", after)
    first = F.when(F.col("_a").isNull() | ((F.col(at) - F.col("_b.t")) <= (F.col("_a.t") - F.col(at))), F.col("_b")).otherwise(F.col("_a"))
    d = d.withColumn("_n", first)
    move = (F.col(at) - F.col("_n.t")) if shift else F.lit(0)
    return d.withColumn("filled", F.coalesce(F.col(value), F.col("_n.v") + move)).drop("_b", "_a", "_n")


def set_key(members: Column) -> Column:
    """One value for a set of members, whatever their order and repeats."""
    return F.concat_ws("|", F.array_sort(F.collect_set(members)))


def wilson(k: Column, n: Column, side: int) -> Column:
    """Bound of the 95 % Wilson interval in percent: ``side`` -1 lower, 1 upper; null without trials."""
    z, k, n = 1.959963985, k.cast("double"), n.cast("double")
    p = k / n
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (mid + side * half) / (1 + z * z / n))))
