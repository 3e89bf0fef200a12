"""Queries on orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .references import orphan_references, orphan_report


def _references(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conseils").select("ligne", "saison", "elimine", "elimine_rattache", "maj")
    return c.filter(F.col("elimine_rattache") & (F.col("elimine") != ""))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "participations").select("saison", "id", "maj", "retire_le")
    return orphan_references(_references(spark, d), parents, ["saison", "elimine"], ["saison", "id"], "ligne", "maj", "maj", "retire_le")


def p6_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    by = [F.col("saison"), F.year("maj").alias("annee")]
    return orphan_report(p6_found(spark, d), _references(spark, d), "ligne", by, "conseils.elimine")


FOUND_SQL = """
with p as (select saison, id, min(case when retire_le is null then maj end) as live_from, bool_or(retire_le is null) as any_live
           from participations where saison is not null and id is not null group by saison, id)
select c.ligne, case when p.id is null then 'absent' when not p.any_live then 'retire' else 'tardif' end as motif
from conseils c left join p on p.saison = c.saison and p.id = c.elimine
where c.elimine_rattache and c.elimine <> '' and (p.id is null or not p.any_live or p.live_from > c.maj)
"""

QUERIES = {"p6_found": p6_found, "p6_orphans_by_period": p6_orphans_by_period}
SQL = {
    "p6_found": FOUND_SQL,
    "p6_orphans_by_period": f"""
with f as ({FOUND_SQL}),
r as (select ligne, saison, cast(year(maj at time zone 'UTC') as integer) as annee from conseils where elimine_rattache and elimine <> ''),
t as (select saison, annee, count(*) as n_references from r group by saison, annee),
b as (select saison, annee, motif, count(*) as n from r join f using (ligne) group by saison, annee, motif)
select 'conseils.elimine' as table_name, b.saison, b.annee, b.motif, b.n, t.n_references
from b join t on b.saison is not distinct from t.saison and b.annee is not distinct from t.annee
""",
}
