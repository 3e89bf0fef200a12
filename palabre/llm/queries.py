"""Queries on training data, with SQL where SQL can express them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table, uncompiled
from .bpe import encode_corpus
from .canonical import learn_forms, map_column, map_values, reference
from .glyphs import consistent_text, suspect
from .identities import entities, link_people, spelling_links
from .linkage import link_sources
from .mixing import mixture, shares
from .spam_pages import score_documents, spam_pages
from .survivors import Field, best_values

# The outcome codes of a participation.
OUTCOMES = "elimine_conseil abandon_medical elimine_orientation vainqueur elimine_epreuve finaliste elimine_poteaux elimine_ambassadeurs abandon_volontaire elimine_destins_lies elimine_duel disqualifie elimine_exil".split()


# Abbreviations in the names of places.
PLACE_ABBREVIATIONS = {"st": "saint", "ste": "sainte", "hte": "haute", "ht": "haut", "bsse": "basse", "bse": "basse", "vx": "vieux", "dep": "departement", "mts": "monts"}

def _jobs_and_places(spark: SparkSession, d: str) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    return reference(table(spark, d, "ref_metiers"), "code", "libelle"), reference(table(spark, d, "ref_lieux"), "code", "libelle")


def _job_forms(spark: SparkSession, d: str, jobs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """What people of `participations` call the occupations: learned from their other rows."""
    p = table(spark, d, "participations").select("id", "profession").dropna().distinct()
    first = cut(map_values(p.select(F.col("profession").alias("v")), jobs, genders=True))
    return learn_forms(p, ["id"], "profession", first, jobs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    jobs, places = _jobs_and_places(spark, d)
    p = table(spark, d, "participations")
    job = map_column(p, "ligne", "profession", jobs, synonyms=_job_forms(spark, d, jobs), genders=True)
    return job.unionByName(map_column(p, "ligne", "localisation", places, abbreviations=PLACE_ABBREVIATIONS))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The typed values that no list has, with their rows."""
    long = table(spark, d, "participations").select("ligne", F.inline(F.array(*[F.struct(F.lit(c).alias("champ"), F.col(c).alias("valeur")) for c in ("profession", "localisation")])))
    return p1_found(spark, d).filter(F.col("code") == "").join(long, ["ligne", "champ"]).groupBy("champ", "valeur").agg(F.count("*").alias("n"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "participations").select("ligne", "saison", "id", "nom", "nom_complet")
    councils = table(spark, d, "conseils").select("ligne", "saison", "elimine", "elimine_rattache")
    return spelling_links(part, councils, table(spark, d, "personnes").select("id", "nom", "prenom"))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """The person of every participation, listed or not: spellings of an unlisted person in a season share an entity."""
    part = table(spark, d, "participations").select("saison", "id", "nom", "nom_complet")
    people, _, targets, nicks = link_people(part, table(spark, d, "personnes").select("id", "nom", "prenom"))
    return entities(people, targets.select("g").distinct(), nicks).groupBy("saison", "id").agg(F.min("ent").alias("entite"), F.max("pid").isNotNull().alias("connu"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """Each link with its confidence."""
    with uncompiled(spark):
        jobs, places = _jobs_and_places(spark, d)
        t = lambda name, *cols: table(spark, d, name).select(*cols)
        return link_sources(
            t("participations", "saison", "id", "nom", "nom_complet", "age", "profession", "localisation", "genre"), t("fiches_wiki", "fiche", "edition", "libelle", "age", "metier", "ville", "genre"),
            t("personnes", "id", "nom", "prenom"), t("saisons", "id", "numero", "titre", "annee"),
            partial(map_values, entries=jobs, synonyms=_job_forms(spark, d, jobs), genders=True), partial(map_values, entries=places, abbreviations=PLACE_ABBREVIATIONS),
        )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_links(spark, d).select("saison", "id", "fiche")


def _survivors(spark: SparkSession, d: str, hidden: Column | None = None) -> DataFrame:
    """Best age, jour_sortie and sort of each (saison, id); rows where ``hidden`` holds count as without time."""
    p = table(spark, d, "participations").filter(F.col("retire_le").isNull()).select("ligne", "saison", "id", "age", "jour_sortie", "sort", "sources", "maj")
    days = table(spark, d, "saisons").select(F.col("id").alias("saison"), "duree_jours", "speciale")
    rows = p.join(days, "saison", "left")
    if hidden is not None:
        rows = rows.withColumn("maj", F.when(~F.coalesce(hidden, F.lit(False)), F.col("maj")))
    fields = [
        Field("age", F.when(F.col("age").between(16, 80), F.col("age"))),
        Field("jour_sortie", F.when(F.col("jour_sortie").between(1, F.col("duree_jours")), F.col("jour_sortie"))),
        Field("sort", F.when(F.col("sort").isin(OUTCOMES), F.col("sort"))),
    ]
    return best_values(rows, table(spark, d, "preference_sources"), ["saison", "id"], "ligne", "maj", "sources", fields)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


def p4_untimed(spark: SparkSession, d: str) -> DataFrame:
    """The same where the rows of special seasons have lost their times: their values are put in the order learned from the others."""
    return _survivors(spark, d, F.col("speciale"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "participations").select("ligne", "nom", "nom_complet")
    long = p.select("ligne", F.inline(F.array(*[F.struct(F.lit(c).alias("champ"), F.col(c).alias("v")) for c in ("nom", "nom_complet")])))
    return long.filter(suspect(F.col("v"))).withColumn("w", consistent_text(F.col("v"))).filter(F.col("w") != F.col("v")).select("ligne", "champ")


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "participations")
    return p.select("ligne", consistent_text(F.col("nom")).alias("nom"), consistent_text(F.col("nom_complet")).alias("nom_complet"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a stated language are twice as likely to be drawn as others."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.when(F.col("lang").isNull(), 0.5).otherwise(1.0).alias("poids"))
    return mixture(docs, table(spark, d, "mix_cibles"), weight="poids")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p8_mix(spark, d), table(spark, d, "mix_cibles"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(table(spark, d, "documents"), "doc_id", "text")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return score_documents(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {
    "p1_found": p1_found, "p1_unmatched": p1_unmatched,
    "p2_found": p2_found, "p2_entities": p2_entities, "p3_found": p3_found, "p3_links": p3_links, "p4_found": p4_found, "p4_untimed": p4_untimed, "p5_found": p5_found, "p5_consistent": p5_consistent, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_scores": p9_scores,
}

_USABLE = f"""
    utile as (
        select p.ligne, p.saison, p.id, p.maj, c.champ, c.v,
            ' ' || trim(regexp_replace(strip_accents(lower(c.source)), '[^a-z0-9]+', ' ', 'g')) || ' ' as source
        from participations p left join saisons s on s.id = p.saison,
        lateral (values
            ('age', case when p.age between 16 and 80 then cast(p.age as varchar) end, p.sources['age']),
            ('jour_sortie', case when p.jour_sortie between 1 and s.duree_jours then cast(p.jour_sortie as varchar) end, p.sources['jour_sortie']),
            ('sort', case when p.sort in ({", ".join(repr(x) for x in OUTCOMES)}) then p.sort end, p.sources['sort'])
        ) c(champ, v, source)
        where p.retire_le is null and c.v is not null
    )"""

SQL: dict[str, str] = {
    "p4_found": f"""
        with {_USABLE},
        liste as (select champ, ' ' || trim(regexp_replace(strip_accents(lower(source)), '[^a-z0-9]+', ' ', 'g')) || ' ' as s, rang from preference_sources),
        note as (select u.ligne, u.champ, arg_max(l.rang, length(l.s)) as rang from utile u join liste l on l.champ = u.champ and contains(u.source, l.s) group by all),
        rangs as (select u.*, coalesce(n.rang, 2147483647) as rang from utile u left join note n using (ligne, champ)),
        premiers as (select *, rank() over (partition by saison, id, champ order by rang, maj desc) as r from rangs),
        mieux as (select *, rank() over (partition by saison, id, champ order by ligne) as q from premiers where r = 1),
        tenue as (
            select m.saison, m.id, m.champ, min(r.ligne) as ligne
            from mieux m join rangs r on r.saison = m.saison and r.id = m.id and r.champ = m.champ and r.v = m.v group by all
        ),
        groupes as (select saison, id from participations where retire_le is null group by all having count(*) >= 2)
        select t.saison, t.id, t.champ, t.ligne from tenue t join groupes g using (saison, id)""",
    "p5_consistent": "",
}
del SQL["p5_consistent"]
