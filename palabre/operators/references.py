"""Orphan references: which rows point at keys that are missing, withdrawn or not yet there.

Both sides are split by range of a 64-bit hash of the key. A range holds its parents as arrays in
hash order; references come in batches of bounded size and are looked up by binary search. A range
that many references hit is served by several copies of its parents, one for each batch, so one key
with a third of all references costs no task more than a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_PARENTS = 50_000  # parents of a range, about
BATCH_REFERENCES = 50_000  # references of a batch, about


def _key(cols: list[Column]) -> Column:
    """One string for a composite key; null parts differ from every string."""
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in cols])


def _range(h: Column, ranges: int) -> Column:
    """The range of a hash: equal widths over the whole of the 64 bits."""
    return F.floor((h.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(ranges)).cast("int")


def _probe(key: tuple, parents: pa.Table, refs: pa.Table) -> pa.Table:
    """Status of a batch: binary search of the hashes, then the keys are compared."""
    p = parents.sort_by([("h", "ascending"), ("k", "ascending")])
    ph, pk = p["h"].to_numpy(), p["k"].to_numpy(zero_copy_only=False)
    known = p["live_from"].is_valid().to_numpy(zero_copy_only=False) if p.num_rows else np.zeros(0, bool)
    live = p["live_from"].cast(pa.int64()).fill_null(0).to_numpy()
    any_live = p["any_live"].to_numpy(zero_copy_only=False).astype(bool) if p.num_rows else np.zeros(0, bool)
    rh, rk = refs["h"].to_numpy(), refs["k"].to_numpy(zero_copy_only=False)
    at = np.searchsorted(ph, rh, side="left")
    end = np.searchsorted(ph, rh, side="right")
    found = np.full(len(rh), -1, dtype="int64")
    open_ = at < end
    while open_.any():  # more than one step only where different keys share a hash
        i = np.flatnonzero(open_)
        hit = pk[at[i]] == rk[i]
        found[i[hit]] = at[i[hit]]
        at[i[~hit]] += 1
        open_[i] = ~hit & (at[i] < end[i])
    timed = refs["maj"].is_valid().to_numpy(zero_copy_only=False)
    maj = refs["maj"].cast(pa.int64()).fill_null(0).to_numpy()
    status = np.full(len(rh), "absent", dtype=object)
    i = np.flatnonzero(found >= 0)
    f = found[i]
    late = known[f] & timed[i] & (live[f] > maj[i])
    status[i] = np.where(~any_live[f], "retire", np.where(late, "tardif", ""))
    out = refs.select(["ref_id"]).append_column("motif", pa.array(status, pa.string()))
    return out.filter(pa.compute.not_equal(out["motif"], ""))


def orphan_references(
    refs: DataFrame, parents: DataFrame, ref_key: list[str], parent_key: list[str], ref_id: str, ref_time: str, parent_time: str, withdrawn: str,
    range_parents: int = RANGE_PARENTS, batch_references: int = BATCH_REFERENCES,
) -> DataFrame:
    """(``ref_id``, ``motif``) of each reference row without a parent that was there at ``ref_time``.

    ``absent``: no parent row has the key. ``retire``: there are rows, all with ``withdrawn`` set.
    ``tardif``: the earliest ``parent_time`` of those not withdrawn is later than ``ref_time``.
    A null in a key part of a reference matches nothing, so it is ``absent``; parents with a null in
    their key are no parents. Null times are never late. Repeated rows come out once for each.
    Empty tables give an empty result, or all references as ``absent``.
    """
    spark = refs.sparkSession
    p = (
        parents.dropna(subset=parent_key)
        .select(_key([F.col(c) for c in parent_key]).alias("k"), F.col(withdrawn).isNull().alias("l"), F.col(parent_time).alias("t"))
        .groupBy("k")
        .agg(F.min(F.when(F.col("l"), F.col("t"))).alias("live_from"), F.max("l").alias("any_live"))
        .withColumn("h", F.xxhash64("k"))
    )
    n = parents.count()
    ranges = max(1, -(-n // range_parents))
    p = p.withColumn("r", _range(F.col("h"), ranges))
    r = refs.select(F.col(ref_id).alias("ref_id"), F.col(ref_time).cast("timestamp").alias("maj"), _key([F.col(c) for c in ref_key]).alias("k"))
    r = r.withColumn("h", F.xxhash64("k")).withColumn("r", _range(F.col("h"), ranges))
    sizes = r.groupBy("r").count().select("r", F.ceil(F.col("count") / F.lit(batch_references)).cast("int").alias("batches"))
    p = p.join(sizes, "r").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    r = r.join(sizes, "r").withColumn("b", F.pmod(F.xxhash64("ref_id", "k", "maj"), F.col("batches").cast("long")).cast("int"))
    id_type = refs.schema[ref_id].dataType.simpleString()
    found = (
        p.select("r", "b", "h", "k", "live_from", "any_live").groupBy("r", "b")
        .cogroup(r.select("r", "b", "ref_id", "maj", "h", "k").groupBy("r", "b"))
        .applyInArrow(_probe_args, f"ref_id {id_type}, motif string")
    )
    return found.withColumnRenamed("ref_id", ref_id)


def _probe_args(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    if right.num_rows == 0:
        return pa.table({"ref_id": right["ref_id"], "motif": pa.array([], pa.string())})
    return _probe(key, left, right)


def orphan_report(found: DataFrame, refs: DataFrame, ref_id: str, by: list[Column], name: str) -> DataFrame:
    """Counts of orphans by table and period, beside the number of references of that period."""
    keyed = refs.select(F.col(ref_id).alias("_ref"), *by)
    names = keyed.columns[1:]
    total = keyed.groupBy(*names).agg(F.count("*").alias("n_references"))
    bad = keyed.join(found.select(F.col(ref_id).alias("_ref"), "motif"), "_ref").groupBy(*names, "motif").agg(F.count("*").alias("n"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"t.{c}")) for c in names]
    joined = bad.alias("b").join(total.alias("t"), same)
    return joined.select(F.lit(name).alias("table_name"), *[F.col(f"b.{c}").alias(c) for c in names], "b.motif", "b.n", "t.n_references")
