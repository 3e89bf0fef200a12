"""Descriptive measures, models from counts and quality rules, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.silver import OUTCOMES, PARTS_SQL, SESSIONS_SQL, ballots, parts, regular, sessions
from ..session import table
from . import aggregates as A
from . import relational as R

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


R6 = lambda c, name: F.round(c.cast("double"), 6).alias(name)
P = f"with {PARTS_SQL}"
S = f"with {SESSIONS_SQL}"
PS = f"with {PARTS_SQL}, {SESSIONS_SQL}"
YES = lambda c: F.coalesce(c, F.lit(False))


# ---- measures ----------------------------------------------------------------------------------------


@query(f"""{P} select saison, case when count(age) > 0 then round(100.0 * count(*) filter (where age >= 40) / count(age), 6) end as part from parts group by saison""")
def a01_share_or_null(spark, d):
    """A share in percent, null where there is nothing to share."""
    return parts(spark, d).groupBy("saison").agg(R6(A.share(F.count_if(YES(F.col("age") >= 40)), F.count("age")), "part"))


@query(f"""{S} select coalesce(saison, '_TOTAL') as saison, count(*) as annulations, count(*) filter (where voix > 0) as efficaces, round(100.0 * count(*) filter (where voix > 0) / count(*), 6) as sur_toutes, case when count(voix) > 0 then round(100.0 * count(*) filter (where voix > 0) / count(voix), 6) end as sur_connues
 from (select s.saison, c.voix_annulees as voix from sess s join (select saison, numero, max_by(voix_annulees, (maj, ligne)) as voix_annulees from conseils group by all) c using (saison, numero) where s.annulation is not null) group by grouping sets ((saison), ())""")
def a14_two_denominators(spark, d):
    """Annulments that took votes away, over all of them and over those with a known number, by season and in total."""
    c = table(spark, d, "conseils").groupBy("saison", "numero").agg(F.max_by(F.struct("annulation"), F.struct("maj", "ligne")).alias("a"), F.max_by(F.struct("voix_annulees"), F.struct("maj", "ligne")).alias("v"))
    x = c.filter("a.annulation is not null").select("saison", F.col("v.voix_annulees").alias("voix"))
    hit = F.count_if(YES(F.col("voix") > 0))
    g = x.groupingSets([["saison"], []], "saison").agg(F.count("*").alias("annulations"), hit.alias("efficaces"), R6(A.share(hit, F.count("*")), "sur_toutes"), R6(A.share(hit, F.count("voix")), "sur_connues"))
    return g.select(F.coalesce("saison", F.lit("_TOTAL")).alias("saison"), "annulations", "efficaces", "sur_toutes", "sur_connues")


@query(f"""{S}, v as (select distinct saison, numero, votant, cible from ballots where type = 'elimination' and complet and votant_ok), x as (select a.saison, a.votant as a, b.votant as b, a.cible = b.cible as meme from v a join v b on a.saison = b.saison and a.numero = b.numero and a.votant < b.votant)
 select saison, a, b, count(*) as ensemble, count(*) filter (where meme) as d_accord from x group by all having count(*) >= 6""")
def a17_aligned_pairs(spark, d):
    """How often two voters who met in six sessions or more named the same."""
    v = ballots(spark, d).filter("type = 'elimination' and complet and votant_ok").select("saison", "numero", "votant", "cible").distinct()
    x = R.pairs(v, ["saison", "numero"], "votant", ["cible"])
    return x.groupBy("saison", "a", "b").agg(F.count("*").alias("ensemble"), F.count_if(F.col("cible_a") == F.col("cible_b")).alias("d_accord")).filter("ensemble >= 6")


@query(f"""{P}, m as (select id as saison, unnest(mecaniques) as nature from saisons) select nature, sum(p.vi) as victoires, round(sum(p.vi * (p.genre = 'f')::int) / cast(sum(p.vi) as double), 6) as femmes, round(sum(p.vi * p.age) / cast(sum(case when p.age is not null then p.vi end) as double), 6) as age
 from m join parts p using (saison) where p.vi > 0 and p.genre is not null group by nature""")
def a18_weighted_natures(spark, d):
    """Women's part and mean age of those who won contests, by the season's mechanics, weighted by their victories."""
    m = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.explode("mecaniques").alias("nature"))
    x = m.join(parts(spark, d).filter("vi > 0 and genre is not null").select("saison", "vi", "genre", "age"), "saison")
    w = F.sum("vi")
    return x.groupBy("nature").agg(w.alias("victoires"), R6(F.sum(F.when(F.col("genre") == "f", F.col("vi")).otherwise(0)) / w, "femmes"), R6(F.sum(F.col("vi") * F.col("age")) / F.sum(F.when(F.col("age").isNotNull(), F.col("vi"))), "age"))


@query(f"""{P}, f as (select saison, id, sort, row_number() over (partition by saison order by votes_recus, id) as arrivee, count(*) over (partition by saison) as k from reg where sort in ('vainqueur', 'finaliste') and votes_recus is not null),
 g as (select arrivee, count(*) as n, count(*) filter (where sort = 'vainqueur') as v, avg(1.0::double / k) as c from f group by arrivee), w as (select *, cast(v as double) / n as p, cast(1.959963985 as double) as z from g)
 select arrivee, n, v as gagnes, round(100 * c, 6) as hasard, round(greatest(0, 100 * (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) as low, round(least(100, 100 * (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) as high from w""")
def a19_final_by_arrival(spark, d):
    """Finals won by the order of votes received, with Wilson's interval and what chance gives."""
    w = Window.partitionBy("saison")
    f = regular(parts(spark, d)).filter("sort in ('vainqueur', 'finaliste') and votes_recus is not null")
    f = f.withColumn("arrivee", F.row_number().over(w.orderBy("votes_recus", "id"))).withColumn("k", F.count("*").over(w))
    g = f.groupBy("arrivee").agg(F.count("*").alias("n"), F.count_if(F.col("sort") == "vainqueur").alias("gagnes"), F.avg(1.0 / F.col("k")).alias("c"))
    return g.select("arrivee", "n", "gagnes", R6(100 * F.col("c"), "hasard"), R6(R.wilson(F.col("gagnes"), F.col("n"), -1), "low"), R6(R.wilson(F.col("gagnes"), F.col("n"), 1), "high"))


_FILLED = ["age", "genre", "tribu", "couleur", "profession", "jour", "sort", "votes_recus", "classement"]


@query(f"""{PS}, c as (select saison, count(*) as n, {", ".join(f"100.0 * count({c}) / count(*) as {c}" for c in _FILLED)} from parts group by saison), k as (select saison, 100.0 * count(*) filter (where complet) / count(*) as conseils from sess group by saison),
 j as (select saison, count(*) as t from sess where type = 'jury' group by saison), x as (select s.id as saison, {", ".join(f"c.{c}" for c in _FILLED)}, k.conseils, case when j.t > 0 then 100.0 end as jury from saisons s left join c on c.saison = s.id left join k on k.saison = s.id left join j on j.saison = s.id),
 u as ({" union all ".join(f"select saison, '{c}' as donnee, {c} as part from x" for c in [*_FILLED, "conseils", "jury"])})
 select saison, donnee, case when part is null then 'sans_objet' when part >= 99.9 then 'complet' when part >= 80 then 'presque' when part >= 50 then 'partiel' when part > 0 then 'rare' else 'absent' end as niveau from u""")
def a20_completeness_matrix(spark, d):
    """Season by kind of data: how complete it is, in five levels, or that the season has none of it."""
    c = parts(spark, d).groupBy("saison").agg(*[(100.0 * F.count(x) / F.count("*")).alias(x) for x in _FILLED])
    k = sessions(spark, d).groupBy("saison").agg((100.0 * F.count_if("complet") / F.count("*")).alias("conseils"), F.when(F.count_if(F.col("type") == "jury") > 0, 100.0).alias("jury"))
    x = table(spark, d, "saisons").select(F.col("id").alias("saison")).join(c, "saison", "left").join(k, "saison", "left")
    u = x.unpivot(["saison"], [*_FILLED, "conseils", "jury"], "donnee", "part")
    level = F.when(F.col("part").isNull(), "sans_objet")
    for least, name in ((99.9, "complet"), (80, "presque"), (50, "partiel")):
        level = level.when(F.col("part") >= least, name)
    return u.select("saison", "donnee", level.when(F.col("part") > 0, "rare").otherwise("absent").alias("niveau"))


@query(f"""{P}, c as (select saison, couleur, count(*) as n from parts where couleur is not null group by all) select saison, round(sum(n * n) / cast(sum(n) * sum(n) as double), 6) as concentration from c group by saison""")
def a24_concentration(spark, d):
    c = parts(spark, d).filter("couleur is not null").groupBy("saison", "couleur").agg(F.count("*").alias("n"))
    return A.entropy(c, ["saison"], "n").select("saison", R6(F.col("herfindahl"), "concentration"))


@query(f"""{P}, c as (select saison, 100.0::double * jour / duree_jours as s from reg where jour is not null) select c.saison, cast(x.p as integer) as p, round(100.0 * count(*) filter (where c.s >= x.p) / count(*), 6) as part from c, (select unnest(range(0, 101, 5)) as p) x group by all""")
def a32_survival_by_season(spark, d):
    """Part of a season's people still there at 0, 5, ... 100 % of it: one pass over counts of each step, then a running sum."""
    c = regular(parts(spark, d)).filter("jour is not null").select("saison", F.least(F.lit(20), F.floor(100.0 * F.col("jour") / F.col("duree_jours") / 5)).cast("int").alias("k"))
    n = c.groupBy("saison", "k").agg(F.count("*").alias("n"))
    spine = n.select("saison").distinct().select("saison", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("k"))
    w = Window.partitionBy("saison")
    x = spine.join(n, ["saison", "k"], "left").withColumn("still", F.coalesce(F.sum("n").over(w.orderBy(F.desc("k"))), F.lit(0)))
    return x.select("saison", (F.col("k") * 5).alias("p"), R6(A.share(F.col("still"), F.max("still").over(w)), "part"))


@query(f"""{P} select saison, min(age) as plus_jeune, max(age) as plus_age, max(age) - min(age) as etendue, count(distinct (annee - age) // 10 * 10) as decennies from reg where age is not null group by saison""")
def a33_age_range(spark, d):
    p = regular(parts(spark, d)).filter("age is not null")
    return p.groupBy("saison").agg(F.min("age").alias("plus_jeune"), F.max("age").alias("plus_age"), (F.max("age") - F.min("age")).alias("etendue"), F.count_distinct(F.floor((F.col("annee") - F.col("age")) / 10) * 10).alias("decennies"))


@query("""select presentateur, count(*) as saisons, min(annee) as premiere, max(annee) as derniere from saisons where presentateur is not null group by presentateur""")
def a34_presenters(spark, d):
    return table(spark, d, "saisons").filter("presentateur is not null").groupBy("presentateur").agg(F.count("*").alias("saisons"), F.min("annee").alias("premiere"), F.max("annee").alias("derniere"))


@query(f"""{PS}, e as (select saison, elimine as id, rank() over (partition by saison order by numero) as r from sess where type = 'elimination' and elimine_rattache) select e.saison, e.id, round(100.0 * p.jour / p.duree_jours, 6) as survie from e join parts p using (saison, id) where r = 1""")
def a36_first_out(spark, d):
    """Whoever a season's first session sent home and the share that they lasted; sessions that tie for the first count each."""
    e = sessions(spark, d).filter("type = 'elimination' and elimine_rattache").select("saison", F.col("elimine").alias("id"), F.rank().over(Window.partitionBy("saison").orderBy("numero")).alias("r")).filter("r = 1")
    return e.join(parts(spark, d), ["saison", "id"]).select("saison", "id", R6(100.0 * F.col("jour") / F.col("duree_jours"), "survie"))


@query(f"""{S}, v as (select distinct saison, numero, votant, cible from ballots where type = 'elimination' and complet and votant_ok), al as (select a.saison, a.votant as a, b.votant as b, min(a.numero) as depuis from v a join v b on a.saison = b.saison and a.numero = b.numero and a.cible = b.cible and a.votant <> b.votant group by all)
 select v.saison, v.votant as id, count(*) as bulletins, count(al.a) as trahisons from v left join al on al.saison = v.saison and al.a = v.votant and al.b = v.cible and al.depuis < v.numero group by all having count(*) >= 4""")
def a40_betrayals(spark, d):
    """Ballots against somebody with whom the voter named the same in an earlier session, of at least four."""
    v = ballots(spark, d).filter("type = 'elimination' and complet and votant_ok").select("saison", "numero", "votant", "cible").distinct()
    p = R.pairs(v, ["saison", "numero", "cible"], "votant").groupBy("saison", "a", "b").agg(F.min("numero").alias("depuis"))
    allies = p.select("saison", F.col("a").alias("votant"), F.col("b").alias("cible"), "depuis").unionByName(p.select("saison", F.col("b").alias("votant"), F.col("a").alias("cible"), "depuis"))
    x = v.join(allies, ["saison", "votant", "cible"], "left")
    return x.groupBy("saison", F.col("votant").alias("id")).agg(F.count("*").alias("bulletins"), F.count_if(YES(F.col("depuis") < F.col("numero"))).alias("trahisons")).filter("bulletins >= 4")


@query(f"""{S}, c as (select saison, numero, cible, count(*) as n, max((cible = elimine)::int) as out from ballots where type = 'elimination' and complet group by all), k as (select *, count(*) over (partition by saison, numero) as m from c),
 g as (select case when n = 1 then '1' when n = 2 then '2' when n <= 4 then '3-4' else '5+' end as voix, count(*) as n, count(*) filter (where out = 1) as sortis, avg(cast(1 as double) / m) as c from k group by 1), w as (select *, cast(sortis as double) / n as p, cast(1.959963985 as double) as z from g)
 select voix, n, sortis, round(100 * p, 6) as taux, round(100 * c, 6) as hasard, round(greatest(0, 100 * (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) as low from w""")
def a41_exit_by_votes(spark, d):
    """Chance to leave by the votes received, beside one over those named that evening."""
    c = ballots(spark, d).filter("type = 'elimination' and complet").groupBy("saison", "numero", "cible").agg(F.count("*").alias("n"), F.max((F.col("cible") == F.col("elimine")).cast("int")).alias("out"))
    c = c.withColumn("m", F.count("*").over(Window.partitionBy("saison", "numero")))
    b = F.when(F.col("n") == 1, "1").when(F.col("n") == 2, "2").when(F.col("n") <= 4, "3-4").otherwise("5+")
    g = c.groupBy(b.alias("voix")).agg(F.count("*").alias("k"), F.count_if(F.col("out") == 1).alias("sortis"), F.avg(1.0 / F.col("m")).alias("c"))
    return g.select("voix", F.col("k").alias("n"), "sortis", R6(100.0 * F.col("sortis") / F.col("k"), "taux"), R6(100 * F.col("c"), "hasard"), R6(R.wilson(F.col("sortis"), F.col("k"), -1), "low"))


@query(f"""{S} select annee // 5 * 5 as periode, count(*) as conseils, count(*) filter (where complet) as lus, round(100.0 * count(*) filter (where complet) / count(*), 6) as part from sess join saisons on saisons.id = sess.saison where annee is not null group by 1""")
def a42_read_by_period(spark, d):
    s = table(spark, d, "saisons").filter("annee is not null").select(F.col("id").alias("saison"), (F.floor(F.col("annee") / 5) * 5).cast("int").alias("periode"))
    g = sessions(spark, d).join(s, "saison").groupBy("periode").agg(F.count("*").alias("conseils"), F.count_if("complet").alias("lus"))
    return g.select("periode", "conseils", "lus", R6(A.share(F.col("lus"), F.col("conseils")), "part"))


@query(f"""{PS}, v as (select count(*) as saisons, count(*) filter (where len(vainqueurs) > 0) as avec_vainqueur from saisons), c as (select count(*) as conseils, count(*) filter (where ep is null) as sans_episode, count(*) filter (where votes is null or len(votes) = 0) as sans_bulletins, count(distinct saison) as saisons_vues from sess) select * from v, c""")
def a43_coverage_counters(spark, d):
    v = table(spark, d, "saisons").agg(F.count("*").alias("saisons"), F.count_if(F.size("vainqueurs") > 0).alias("avec_vainqueur"))
    c = sessions(spark, d).agg(F.count("*").alias("conseils"), F.count_if(F.col("ep").isNull()).alias("sans_episode"), F.count_if(F.col("votes").isNull() | (F.size("votes") == 0)).alias("sans_bulletins"), F.count_distinct("saison").alias("saisons_vues"))
    return v.crossJoin(c)  # one row each


@query(f"""{S} select saison, count(distinct votant) as votants, count(distinct cible) as cibles from ballots group by saison""")
def a45_distinct_people(spark, d):
    """Exact counts of different voters and targets."""
    return ballots(spark, d).groupBy("saison").agg(F.count_distinct("votant").alias("votants"), F.count_distinct("cible").alias("cibles"))


@query(f"""{PS}, j as (select saison, cible, count(*) as lues from ballots where type = 'jury' group by all), t as (select saison, sum(lues) as lues from j group by saison), a as (select saison, sum(votes_exprimes) as annoncees from sess where type = 'jury' group by saison)
 select a.saison, a.annoncees, t.lues, a.annoncees is distinct from t.lues as desaccord from a left join t using (saison)""")
def a12_announced_and_read(spark, d):
    """Jury votes announced beside those read."""
    t = ballots(spark, d).filter("type = 'jury'").groupBy("saison").agg(F.count("*").alias("lues"))
    a = sessions(spark, d).filter("type = 'jury'").groupBy("saison").agg(F.sum("votes_exprimes").alias("annoncees"))
    return a.join(t, "saison", "left").select("saison", "annoncees", "lues", (~F.col("annoncees").eqNullSafe(F.col("lues"))).alias("desaccord"))


@query(f"""{PS}, e as (select saison, count(distinct numero) filter (where ep is not null) as conseils from sess where type = 'elimination' group by saison), s as (select saison, elimine as id, max(numero) as fin from sess where elimine_rattache group by all),
 x as (select p.saison, p.id, p.vi, greatest(p.vi, (select count(*) from sess k where k.saison = p.saison and k.type = 'elimination' and k.ep is not null and (s.fin is null or k.numero <= s.fin))) as exposes from reg p left join s using (saison, id) where p.vi is not null)
 select saison, id, vi, exposes, round(100.0 * vi / exposes, 6) as part from x where exposes >= 8""")
def a13_exposed_share(spark, d):
    """Contests won over the sessions a person was there for, never less than those won; eight at least."""
    s = sessions(spark, d)
    held = s.filter("type = 'elimination' and ep is not null").select("saison", "numero")
    run = held.withColumn("k", F.row_number().over(Window.partitionBy("saison").orderBy("numero"))).select("saison", F.col("numero").alias("fin"), "k")
    out = s.filter("elimine_rattache").groupBy("saison", F.col("elimine").alias("id")).agg(F.max("numero").alias("fin"))
    # sessions up to an exit: those counted at the last one not after it
    marks = out.select("saison", "fin").distinct().withColumn("k", F.lit(None).cast("int")).unionByName(run).groupBy("saison", "fin").agg(F.max("k").alias("k"))
    marks = marks.withColumn("k", F.coalesce(F.max("k").over(Window.partitionBy("saison").orderBy("fin")), F.lit(0)))
    every = run.groupBy("saison").agg(F.max("k").alias("tous"))
    p = regular(parts(spark, d)).filter("vi is not null").join(out, ["saison", "id"], "left").join(marks, ["saison", "fin"], "left").join(every, "saison", "left")
    seen = F.when(F.col("fin").isNull(), F.coalesce("tous", F.lit(0))).otherwise(F.coalesce("k", F.lit(0)))
    x = p.withColumn("exposes", F.greatest(F.col("vi"), seen).cast("bigint")).filter("exposes >= 8")
    return x.select("saison", "id", "vi", "exposes", R6(100.0 * F.col("vi") / F.col("exposes"), "part"))


@query(f"""{P}, o as (select id, count(distinct saison) as vues from participations where id is not null group by id), e as (select abs(q.nb_participations - coalesce(o.vues, 0)) as ecart from personnes q left join o using (id) where q.nb_participations is not null),
 g as (select ecart, count(*) as n from e group by ecart) select ecart, n, round(100.0 * sum(n) over (order by ecart) / sum(n) over (), 6) as cumul from g""")
def a22_cumulative_agreement(spark, d):
    """Part of people whose declared number of seasons is off by so much or less."""
    o = table(spark, d, "participations").select("id", "saison").dropna().distinct().groupBy("id").agg(F.count("*").alias("vues"))
    q = table(spark, d, "personnes").filter("nb_participations is not null").join(o, "id", "left")
    g = q.groupBy(F.abs(F.col("nb_participations") - F.coalesce("vues", F.lit(0))).alias("ecart")).agg(F.count("*").alias("n"))
    return g.select("ecart", "n", R6(100.0 * F.sum("n").over(Window.orderBy("ecart")) / F.sum("n").over(Window.partitionBy()), "cumul"))  # a row a difference


# ---- models from counts ------------------------------------------------------------------------------


@query(f"""{P}, t as (select genre, couleur, count(*) as n from reg where genre is not null and couleur is not null group by all), x as (select *, 100.0::double * n / sum(n) over (partition by couleur) - 100.0::double * sum(n) over (partition by genre) / sum(n) over () as ecart from t)
 select couleur, arg_max(genre, ecart) as nom, round(max(ecart), 6) as ecart from x group by couleur having max(ecart) > 5""")
def m03_named_by_excess(spark, d):
    """Groups named by the class that stands out in them most, by more than five points."""
    t = regular(parts(spark, d)).filter("genre is not null and couleur is not null").groupBy("genre", "couleur").agg(F.count("*").alias("n"))
    own = lambda *c: F.sum("n").over(Window.partitionBy(*c))
    x = t.withColumn("ecart", 100.0 * F.col("n") / own("couleur") - 100.0 * own("genre") / own())
    return x.groupBy("couleur").agg(F.max_by("genre", "ecart").alias("nom"), F.max("ecart").alias("e")).filter("e > 5").select("couleur", "nom", R6(F.col("e"), "ecart"))


@query(f"""{P}, k as (select id, saison, 100.0::double * jour / duree_jours as survie, lead(saison) over (partition by id order by annee, saison) is not null as rappel from parts where annee is not null and jour is not null), q as (select *, (row_number() over (partition by rappel_groupe order by survie, saison, id) - 1) * 5 // count(*) over (partition by rappel_groupe) as quintile from (select *, saison as rappel_groupe from k))
 select cast(quintile as bigint) as quintile, count(*) as n, round(100.0 * count(*) filter (where rappel) / count(*), 6) as taux from q group by quintile""")
def m13_recall_by_quintile(spark, d):
    """How often people play again, by the fifth of their season's order of survival."""
    w = Window.partitionBy("id").orderBy("annee", "saison")
    k = parts(spark, d).filter("annee is not null and jour is not null").select("id", "saison", (100.0 * F.col("jour") / F.col("duree_jours")).alias("s"), F.lead("saison").over(w).isNotNull().alias("r"))
    g = Window.partitionBy("saison")
    q = k.withColumn("quintile", F.floor((F.row_number().over(g.orderBy("s", "id")) - 1) * 5 / F.count("*").over(g)))
    return q.groupBy("quintile").agg(F.count("*").alias("n"), R6(A.share(F.count_if("r"), F.count("*")), "taux"))


@query("""with t as (select saison, id, len(parcours) as pas, parcours[1].jour_fin as fin from participations where retire_le is null and len(parcours) >= 2) select saison, mode_fin as fusion, n from (select saison, fin as mode_fin, count(*) as n, row_number() over (partition by saison order by count(*) desc, fin) as r from t where fin is not null group by saison, fin) where r = 1 and mode_fin between 2 and 100""")
def m16_day_of_merger(spark, d):
    """The day on which most first tribes of a season end, within bounds."""
    t = table(spark, d, "participations").filter("retire_le is null").filter(F.size("parcours") >= 2).select("saison", F.col("parcours")[0]["jour_fin"].alias("fin"))
    return A.mode_smallest(t, ["saison"], "fin").select("saison", F.col("mode").alias("fusion"), "n").filter("fusion between 2 and 100")


@query(f"""{PS}, v as (select distinct saison, numero, complet, votant as id from ballots where type = 'elimination' and votant_ok), n as (select saison, numero, count(*) as votants from v where complet group by all), x as (select saison, elimine as id, max(numero) as fin from sess where elimine_rattache group by all),
 e as (select s.saison, s.numero, count(*) as presents from sess s join parts p on p.saison = s.saison left join x on x.saison = p.saison and x.id = p.id where s.type = 'elimination' and not s.complet and (x.fin is null or x.fin >= s.numero) group by all)
 select s.saison, s.numero, case when s.complet then 'votants' else 'encore_la' end as source, coalesce(case when s.complet then n.votants else e.presents end, 0) as camp from sess s left join n using (saison, numero) left join e using (saison, numero) where s.type = 'elimination'""")
def m17_camp_size(spark, d):
    """The size of the camp at a session: its voters if it was read whole, else those not gone yet, by counts of exits."""
    s = sessions(spark, d)
    e = s.filter("type = 'elimination'").select("saison", "numero", "complet")
    v = ballots(spark, d).filter("type = 'elimination' and votant_ok and complet").select("saison", "numero", "votant").distinct().groupBy("saison", "numero").agg(F.count("*").alias("votants"))
    p = parts(spark, d).select("saison", "id")
    out = s.filter("elimine_rattache").groupBy("saison", F.col("elimine").alias("id")).agg(F.max("numero").alias("fin")).join(p, ["saison", "id"], "left_semi")
    gone = out.groupBy("saison", "fin").agg(F.count("*").alias("k"))
    # exits before a session: a running sum over exits and sessions in one order
    line = e.select("saison", F.col("numero").alias("at"), F.lit(0).alias("k"), F.lit(0).alias("o")).unionByName(gone.select("saison", F.col("fin").alias("at"), "k", F.lit(1).alias("o")))
    w = Window.partitionBy("saison").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    before = line.withColumn("partis", F.sum("k").over(w)).filter("o = 0").select("saison", F.col("at").alias("numero"), "partis")
    all_ = p.groupBy("saison").agg(F.count("*").alias("tous"))
    x = e.join(v, ["saison", "numero"], "left").join(before, ["saison", "numero"], "left").join(all_, "saison", "left")
    n = F.when(F.col("complet"), F.col("votants")).otherwise(F.col("tous") - F.col("partis"))
    return x.select("saison", "numero", F.when(F.col("complet"), "votants").otherwise("encore_la").alias("source"), F.coalesce(n, F.lit(0)).alias("camp"))


@query(f"""{PS}, b as (select b.saison, b.numero, v.genre as g, c.genre = v.genre as meme from ballots b join parts v on v.saison = b.saison and v.id = b.votant join parts c on c.saison = b.saison and c.id = b.cible where b.type = 'elimination' and b.complet and v.genre is not null and c.genre is not null),
 n as (select b.saison, b.numero, p.genre as g, count(distinct b.votant) as k from ballots b join parts p on p.saison = b.saison and p.id = b.votant where b.type = 'elimination' and b.complet and p.genre is not null group by all), t as (select saison, numero, sum(k) as t from n group by all)
 select count(*) as bulletins, round(avg(b.meme::int), 6) as observe, round(avg((n.k - 1) / cast(t.t - 1 as double)), 6) as attendu from b join n using (saison, numero, g) join t using (saison, numero) where t.t > 1""")
def m20_expected_by_ballot(spark, d):
    """Ballots for one's own gender beside what each ballot's company gives by chance."""
    b = ballots(spark, d).filter("type = 'elimination' and complet")
    g = parts(spark, d).filter("genre is not null").select("saison", "id", "genre")
    voter = g.withColumnsRenamed({"id": "votant", "genre": "g"})
    x = b.join(voter, ["saison", "votant"])
    n = x.select("saison", "numero", "votant", "g").distinct().groupBy("saison", "numero", "g").agg(F.count("*").alias("k")).withColumn("t", F.sum("k").over(Window.partitionBy("saison", "numero"))).filter("t > 1")
    y = x.join(g.withColumnsRenamed({"id": "cible", "genre": "gc"}), ["saison", "cible"]).join(n, ["saison", "numero", "g"])
    return y.agg(F.count("*").alias("bulletins"), R6(F.avg((F.col("g") == F.col("gc")).cast("int")), "observe"), R6(F.avg((F.col("k") - 1) / (F.col("t") - 1).cast("double")), "attendu"))


@query(f"""{P}, x as (select saison, id, vi, jour, rank() over (partition by saison order by jour) as r from reg where jour is not null and vi is not null) select a.saison, a.id, a.vi, count(*) as voisins, round(avg(b.vi), 6) as moyenne from x a join x b on b.saison = a.saison and b.r between a.r - 3 and a.r + 3 and b.id <> a.id group by all""")
def m21_matched_by_exposure(spark, d):
    """A person's contests beside the mean of those who left within three ranks of them, by a window of ranks."""
    w = Window.partitionBy("saison").orderBy("r")
    x = regular(parts(spark, d)).filter("jour is not null and vi is not null").select("saison", "id", "vi", F.rank().over(Window.partitionBy("saison").orderBy("jour")).alias("r"))
    band = w.rangeBetween(-3, 3)
    x = x.withColumn("n", F.count("*").over(band) - 1).withColumn("s", F.sum("vi").over(band) - F.col("vi")).filter("n > 0")
    return x.select("saison", "id", "vi", F.col("n").alias("voisins"), R6(F.col("s") / F.col("n"), "moyenne"))


# ---- quality -----------------------------------------------------------------------------------------


@query("""select 'cle_repetee' as regle, count(*) as n from (select saison, id from participations where retire_le is null group by all having count(*) > 1) union all select 'sans_id', count(*) from participations where id is null or id = '' union all select 'annee_hors', count(*) from saisons where annee not between 2001 and 2030
 union all select 'couleur_inconnue', count(*) from participations where couleur not in ('bleu','jaune','rouge','vert','violet','orange','noir') union all select 'dates_inverses', count(*) from saisons where diffusion.fin < diffusion.debut""")
def q01_keys_and_domains(spark, d):
    p, s = table(spark, d, "participations"), table(spark, d, "saisons")
    twice = p.filter("retire_le is null").groupBy("saison", "id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("cle_repetee"))
    a = p.agg(F.count_if(YES(F.col("id").isNull() | (F.col("id") == ""))).alias("sans_id"), F.count_if(YES(~F.col("couleur").isin("bleu", "jaune", "rouge", "vert", "violet", "orange", "noir"))).alias("couleur_inconnue"))
    b = s.agg(F.count_if(YES(~F.col("annee").between(2001, 2030))).alias("annee_hors"), F.count_if(YES(F.col("diffusion.fin") < F.col("diffusion.debut"))).alias("dates_inverses"))
    return A.union_all([x.unpivot([], x.columns, "regle", "n") for x in (twice, a, b)])


@query(f"""select 'saison_inconnue' as regle, count(*) as n from participations p where not exists (select 1 from saisons s where s.id = p.saison) union all select 'sort_inconnu', count(*) from participations where sort is not null and sort not in ({", ".join(repr(x) for x in OUTCOMES)})
 union all select 'age_hors', count(*) from participations where age not between 16 and 80 union all select 'effectif_declare', count(*) from (select s.id from saisons s join (select saison, count(distinct id) as n from participations where retire_le is null group by saison) p on p.saison = s.id where s.nb_candidats is not null and s.nb_candidats <> p.n)
 union all select 'personne_double', count(*) from (select nom from personnes group by nom having count(*) > 1)""")
def q02_references_and_ranges(spark, d):
    p, s = table(spark, d, "participations"), table(spark, d, "saisons")
    ids = s.select(F.col("id").alias("saison"), "nb_candidats")
    orphans = p.join(ids, "saison", "left_anti").agg(F.count("*").alias("saison_inconnue"))
    ranges = p.agg(F.count_if(YES(~F.col("sort").isin(OUTCOMES))).alias("sort_inconnu"), F.count_if(YES(~F.col("age").between(16, 80))).alias("age_hors"))
    n = p.filter("retire_le is null").groupBy("saison").agg(F.count_distinct("id").alias("k"))
    declared = ids.join(n, "saison").agg(F.count_if(YES(F.col("nb_candidats") != F.col("k"))).alias("effectif_declare"))
    double = table(spark, d, "personnes").groupBy("nom").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("personne_double"))
    return A.union_all([x.unpivot([], x.columns, "regle", "n") for x in (orphans, ranges, declared, double)])


@query(f"""{P} select saison, max(vi) as plus, sum(vi) as total, bool_or(vi < 0 or vc < 0) as negatif, count(*) filter (where vi is null) as manquants from parts group by saison""")
def q03_contests_of_a_season(spark, d):
    """Contest totals of a season, and whether any is negative or missing."""
    return parts(spark, d).groupBy("saison").agg(F.max("vi").alias("plus"), F.sum("vi").alias("total"), F.bool_or((F.col("vi") < 0) | (F.col("vc") < 0)).alias("negatif"), F.count_if(F.col("vi").isNull()).alias("manquants"))


@query(f"""{S} select saison, numero, elimine from (select saison, numero, elimine, max_by(p, (maj, ligne)) as proteges from (select saison, numero, elimine, proteges as p, maj, ligne from conseils) group by all) where list_contains(proteges, elimine)""")
def q05_protected_but_out(spark, d):
    """Sessions whose protected person is the one who left."""
    c = table(spark, d, "conseils").groupBy("saison", "numero", "elimine").agg(F.max_by(F.struct("proteges"), F.struct("maj", "ligne")).alias("x"))
    return c.filter(F.array_contains("x.proteges", F.col("elimine"))).select("saison", "numero", "elimine")


@query(f"""{P}, k as (select saison, count(*) filter (where sort = 'vainqueur') as v, count(*) filter (where sort = 'finaliste') as f from reg group by saison) select saison, v as vainqueurs, f as finalistes, case when v = 0 then 'sans_vainqueur' when v > 2 then 'trop_de_vainqueurs' when f > 4 then 'trop_de_finalistes' end as violation from k where v = 0 or v > 2 or f > 4""")
def q06_final_invariants(spark, d):
    k = regular(parts(spark, d)).groupBy("saison").agg(F.count_if(YES(F.col("sort") == "vainqueur")).alias("vainqueurs"), F.count_if(YES(F.col("sort") == "finaliste")).alias("finalistes"))
    why = F.when(F.col("vainqueurs") == 0, "sans_vainqueur").when(F.col("vainqueurs") > 2, "trop_de_vainqueurs").when(F.col("finalistes") > 4, "trop_de_finalistes")
    return k.withColumn("violation", why).filter("violation is not null")


@query(f"""{S}, b as (select saison, numero, count(*) as lus, count(*) filter (where cible = elimine) as contre, count(*) - count(distinct votant) as repetes from ballots group by all)
 select s.saison, s.numero, case when s.complet and s.votes_exprimes is distinct from b.lus then 'complet_sans_egalite' when s.complet and s.type = 'elimination' and s.votes_contre is distinct from b.contre then 'contre_different' when b.repetes > 0 then 'vote_repete' end as violation from sess s left join b using (saison, numero)
 where case when s.complet and s.votes_exprimes is distinct from b.lus then 1 when s.complet and s.type = 'elimination' and s.votes_contre is distinct from b.contre then 1 when b.repetes > 0 then 1 else 0 end = 1""")
def q07_session_rules(spark, d):
    """A session read whole has as many ballots as votes cast, and nobody votes twice."""
    b = ballots(spark, d).groupBy("saison", "numero").agg(F.count("*").alias("lus"), F.count_if(YES(F.col("cible") == F.col("elimine"))).alias("contre"), (F.count("*") - F.count_distinct("votant")).alias("repetes"))
    x = sessions(spark, d).join(b, ["saison", "numero"], "left")
    differs = lambda a, c: ~F.col(a).eqNullSafe(F.col(c))
    why = F.when(F.col("complet") & differs("votes_exprimes", "lus"), "complet_sans_egalite").when(F.col("complet") & (F.col("type") == "elimination") & differs("votes_contre", "contre"), "contre_different").when(F.col("repetes") > 0, "vote_repete")
    return x.select("saison", "numero", why.alias("violation")).filter("violation is not null")


@query("""with n as (select saison, count(*) as now, sum(ligne) as a from participations group by saison), w as (select saison, count(*) as before, sum(ligne) as b from participations where maj < timestamp '2015-01-01' group by saison) select n.saison, n.now as lignes, coalesce(w.before, 0) as avant from n left join w using (saison) where a is distinct from b""")
def q10_stale_since(spark, d):
    """Seasons whose rows are others than those loaded before a date: what was derived from them is stale."""
    g = table(spark, d, "participations").groupBy("saison").agg(F.count("*").alias("lignes"), F.count_if(YES(F.col("maj") < F.lit("2015-01-01").cast("timestamp"))).alias("avant"), F.sum("ligne").alias("a"), F.sum(F.when(F.col("maj") < F.lit("2015-01-01").cast("timestamp"), F.col("ligne"))).alias("b"))
    return g.filter(~F.col("a").eqNullSafe(F.col("b"))).select("saison", "lignes", "avant")


@query("""select champ, ligne from (select ligne, nom, nom_complet, profession, localisation from participations) unpivot (v for champ in (nom, nom_complet, profession, localisation)) where regexp_matches(v, '<[a-zA-Z/][^>]*>|\\[\\[|\\{\\{|https?://')""")
def q14_markup_in_text(spark, d):
    """Fields typed by others that hold markup or links."""
    u = table(spark, d, "participations").unpivot(["ligne"], ["nom", "nom_complet", "profession", "localisation"], "champ", "v")
    return u.filter(F.col("v").rlike(r"<[a-zA-Z/][^>]*>|\[\[|\{\{|https?://")).select("champ", "ligne")


@query(f"""{P} select champ, count(*) as manquants, min(saison) as premiere from (select saison, 'age' as champ from parts where age is null union all select saison, 'genre' from parts where genre is null union all select saison, 'sort' from parts where sort is null union all select saison, 'jour' from parts where jour is null) group by champ""")
def q15_gap_report(spark, d):
    p = parts(spark, d)
    gaps = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("age", "genre", "sort", "jour")]), lambda x: x.isNotNull())
    return p.select("saison", F.explode(gaps).alias("champ")).groupBy("champ").agg(F.count("*").alias("manquants"), F.min("saison").alias("premiere"))


QUERIES = Q
