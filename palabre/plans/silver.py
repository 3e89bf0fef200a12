"""Clean views that the queries start from: one row a key, values in their domains, ballots in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

# Outcome codes.
OUTCOMES = "elimine_conseil abandon_medical elimine_orientation vainqueur elimine_epreuve finaliste elimine_poteaux elimine_ambassadeurs abandon_volontaire elimine_destins_lies elimine_duel disqualifie elimine_exil".split()


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``. Aggregates before the shuffle, so a hot key costs a row a task."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, "r.*")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """One row a (saison, id): the latest row not withdrawn, with its season's columns."""
    cols = ["nom", "genre", "age", "tribu", "couleur", "profession", "jour_sortie", "sort", "votes_recus", "classement", "victoires_individuelles", "victoires_collectives"]
    p = table(spark, d, "participations").filter(F.col("retire_le").isNull()).select("saison", "id", *cols, "maj", "ligne")
    p = latest(p, ["saison", "id"], ["maj", "ligne"])
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"), "annee", "numero", "duree_jours", F.coalesce("speciale", F.lit(False)).alias("speciale"), F.coalesce("annulee", F.lit(False)).alias("annulee"), F.coalesce("en_cours", F.lit(False)).alias("en_cours"))
    p = p.join(s, "saison", "left")
    return p.select(
        "saison", "id", "nom", "genre", F.when(F.col("age").between(16, 80), F.col("age")).alias("age"), "tribu", "couleur", "profession",
        F.when(F.col("jour_sortie").between(1, F.col("duree_jours")), F.col("jour_sortie")).alias("jour"), F.when(F.col("sort").isin(OUTCOMES), F.col("sort")).alias("sort"),
        "votes_recus", "classement", F.col("victoires_individuelles").alias("vi"), F.col("victoires_collectives").alias("vc"), "annee", "numero", "duree_jours", "speciale", "annulee", "en_cours",
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """One row a (saison, numero): the latest extraction of a session; ``ep`` is the episode where it is a number."""
    c = table(spark, d, "conseils").select("saison", "numero", "type", "episode", "complet", "elimine", "elimine_rattache", "votes_contre", "votes_exprimes", "annulation", "votes", "maj", "ligne")
    c = latest(c, ["saison", "numero"], ["maj", "ligne"])
    return c.withColumn("ep", F.col("episode").try_cast("int")).withColumn("type", F.coalesce("type", F.lit("elimination"))).withColumn("complet", F.coalesce("complet", F.lit(False)))


def ballots(spark: SparkSession, d: str) -> DataFrame:
    """One row a ballot read, with its place in the session; annulled ballots are left out."""
    s = sessions(spark, d).select("saison", "numero", "type", "complet", "elimine", F.posexplode("votes").alias("pos", "v"))
    b = s.select("saison", "numero", "type", "complet", "elimine", "pos", F.col("v.votant").alias("votant"), F.col("v.cible").alias("cible"), F.coalesce("v.votant_rattache", F.lit(False)).alias("votant_ok"), F.coalesce("v.cible_rattachee", F.lit(False)).alias("cible_ok"), F.coalesce("v.annule", F.lit(False)).alias("annule"))
    return b.filter(~F.col("annule")).drop("annule")


def regular(p: DataFrame, specials: bool = False) -> DataFrame:
    """Seasons that are over; without the special ones unless asked for."""
    p = p.filter(~F.col("annulee") & ~F.col("en_cours"))
    return p if specials else p.filter(~F.col("speciale"))


_CODES = ", ".join(f"'{x}'" for x in OUTCOMES)
PARTS_SQL = f"""
parts as (select p.saison, p.id, p.nom, p.genre, case when p.age between 16 and 80 then p.age end as age, p.tribu, p.couleur, p.profession,
  case when p.jour_sortie between 1 and s.duree_jours then p.jour_sortie end as jour, case when p.sort in ({_CODES}) then p.sort end as sort,
  p.votes_recus, p.classement, p.victoires_individuelles as vi, p.victoires_collectives as vc, s.annee, s.numero, s.duree_jours,
  coalesce(s.speciale, false) as speciale, coalesce(s.annulee, false) as annulee, coalesce(s.en_cours, false) as en_cours
  from (select *, row_number() over (partition by saison, id order by maj desc, ligne desc) as rn from participations where retire_le is null) p
  left join saisons s on s.id = p.saison where rn = 1),
reg as (select * from parts where not speciale and not annulee and not en_cours)"""
SESSIONS_SQL = """
sess as (select saison, numero, coalesce(type, 'elimination') as type, episode, try_cast(episode as integer) as ep, coalesce(complet, false) as complet,
  elimine, elimine_rattache, votes_contre, votes_exprimes, annulation, votes
  from (select *, row_number() over (partition by saison, numero order by maj desc, ligne desc) as rn from conseils) where rn = 1),
ballots as (select saison, numero, type, complet, elimine, pos, v.votant as votant, v.cible as cible, coalesce(v.votant_rattache, false) as votant_ok, coalesce(v.cible_rattachee, false) as cible_ok
  from (select saison, numero, type, complet, elimine, unnest(votes) as v, generate_subscripts(votes, 1) - 1 as pos from sess) where not coalesce(v.annule, false))"""
