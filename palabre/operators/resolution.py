"""Labels resolved to members by evidence, and the accounting of what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def cascade(labels: DataFrame, members: DataFrame, group: str, label: str, member: str, names: list[str]) -> DataFrame:
    """``labels`` with ``resolved`` and ``how``: exact name first, then the first word of it, each only if one member has it.

    ``names`` are columns of ``members`` in falling trust. A label that several members of its group bear at the
    first level where any does stays open as a homonym; one that nobody bears is unknown.
    """
    forms = [F.struct(F.lit(2 * i).alias("level"), words(F.col(n)).alias("w")) for i, n in enumerate(names)]
    forms += [F.struct(F.lit(2 * i + 1).alias("level"), F.element_at(F.split(words(F.col(n)), " "), 1).alias("w")) for i, n in enumerate(names)]
    keys = members.select(F.col(group).alias("_g"), F.col(member).alias("_m"), F.inline(F.array(*forms))).filter(F.col("w").isNotNull() & (F.col("w") != "")).distinct()
    # people are counted for each name before the join: a label meets one row a level
    keys = keys.groupBy("_g", "w", "level").agg(F.count("*").alias("k"), F.min("_m").alias("_m"))
    l = labels.withColumn("_w", words(F.col(label)))
    x = l.select(F.col(group).alias("_g"), F.col("_w").alias("w")).distinct().join(keys, ["_g", "w"])
    best = x.groupBy("_g", "w").agg(F.min_by(F.struct("level", "k", "_m"), "level").alias("b"))
    j = l.join(best, (l[group] == best["_g"]) & (l["_w"] == best["w"]), "left")
    how = F.when(F.col("b").isNull(), "inconnu").when(F.col("b.k") > 1, "homonyme").when(F.col("b.level") % 2 == 0, "nom").otherwise("prenom")
    return j.select(*[labels[c] for c in labels.columns], F.when(F.col("b.k") == 1, F.col("b._m")).alias("resolved"), how.alias("how"))


def fill_if_unanimous(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: a missing value taken from rows of the same ``by`` if all of them that have one agree."""
    known = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).filter("_lo = _hi")
    return df.join(known.select(by, "_lo"), by, "left").withColumn(name, F.coalesce(value, "_lo")).drop("_lo")
