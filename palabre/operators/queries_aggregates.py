"""Descriptive queries on cohorts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, parts, regular, sessions
from ..session import table
from . import aggregates as A

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


@query(f"""{P} select axe, valeur, n, round(age_moyen, 6) as age_moyen, age_min, age_max from (
 select 'genre' as axe, genre as valeur, count(*) as n, avg(age) as age_moyen, min(age) as age_min, max(age) as age_max from reg where sort = 'vainqueur' group by genre
 union all select 'couleur', couleur, count(*), avg(age), min(age), max(age) from reg where sort = 'vainqueur' group by couleur
 union all select 'tout', null, count(*), avg(age), min(age), max(age) from reg where sort = 'vainqueur')""")
def a02_winners_by_axis(spark, d):
    """Several groupings of the winners in one pass, by grouping sets."""
    v = regular(parts(spark, d)).filter("sort = 'vainqueur'").select("genre", "couleur", "age")
    g, c = F.col("genre"), F.col("couleur")
    g = v.groupingSets([[g], [c], []], g, c).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.avg("age").alias("m"), F.min("age").alias("age_min"), F.max("age").alias("age_max"))
    axis = F.when(F.col("g") == 1, "genre").when(F.col("g") == 2, "couleur").otherwise("tout")
    return g.select(axis.alias("axe"), F.when(F.col("g") == 1, F.col("genre")).when(F.col("g") == 2, F.col("couleur")).alias("valeur"), "n", R6(F.col("m"), "age_moyen"), "age_min", "age_max")


@query(f"""{P} select couleur, count(*) as n, round(avg(100.0 * jour / duree_jours), 6) as survie, count(*) filter (where sort = 'vainqueur') as victoires, count(*) filter (where sort in ('vainqueur', 'finaliste')) as finales,
 round(100.0 * count(*) filter (where sort in ('vainqueur', 'finaliste')) / count(*), 6) as taux from reg group by couleur""")
def a03_by_colour(spark, d):
    fin = F.count_if(F.coalesce(F.col("sort").isin("vainqueur", "finaliste"), F.lit(False)))
    g = regular(parts(spark, d)).groupBy("couleur")
    return g.agg(F.count("*").alias("n"), R6(F.avg(100.0 * F.col("jour") / F.col("duree_jours")), "survie"), F.count_if(F.col("sort") == "vainqueur").alias("victoires"), fin.alias("finales"), R6(A.share(fin, F.count("*")), "taux"))


@query(f"""{P} select profession, count(*) as n, round(100.0 * count(*) / (select count(*) from reg where profession is not null), 6) as part from reg where profession is not null group by profession having count(*) >= 5""")
def a04_by_job(spark, d):
    g = regular(parts(spark, d)).filter("profession is not null").groupBy("profession").agg(F.count("*").alias("n"))
    kept = g.filter("n >= 5")
    total = g.agg(F.sum("n").alias("t"))
    return kept.crossJoin(F.broadcast(total)).select("profession", "n", R6(100.0 * F.col("n") / F.col("t"), "part"))  # one row


@query(f"""{P} select annee // 10 * 10 as decennie, count(*) filter (where genre = 'f') as f, count(*) filter (where genre = 'h') as h, count(*) filter (where genre is null) as inconnu from reg where annee is not null group by 1""")
def a05_gender_by_decade(spark, d):
    p = regular(parts(spark, d)).filter("annee is not null").select((F.floor(F.col("annee") / 10) * 10).cast("int").alias("decennie"), F.coalesce("genre", F.lit("inconnu")).alias("g"))
    return p.groupBy("decennie").pivot("g", ["f", "h", "inconnu"]).agg(F.count(F.lit(1))).na.fill(0)


@query(f"""{P} select sort, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as part, count(*) filter (where annee >= 2010) as recents from reg group by sort""")
def a06_outcomes(spark, d):
    g = regular(parts(spark, d)).groupBy("sort").agg(F.count("*").alias("n"), F.count_if(F.col("annee") >= 2010).alias("recents"))
    return g.select("sort", "n", R6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), "part"), "recents")  # at most the domain's codes


@query(f"""{P} select case when age < 25 then '16-24' when age < 35 then '25-34' when age < 45 then '35-44' when age < 55 then '45-54' else '55+' end as tranche, count(*) as n, round(avg(votes_recus), 6) as votes from reg where age is not null group by 1""")
def a07_age_bands(spark, d):
    b = F.when(F.col("age") < 25, "16-24").when(F.col("age") < 35, "25-34").when(F.col("age") < 45, "35-44").when(F.col("age") < 55, "45-54").otherwise("55+")
    return regular(parts(spark, d)).filter("age is not null").groupBy(b.alias("tranche")).agg(F.count("*").alias("n"), R6(F.avg("votes_recus"), "votes"))


@query(f"""{PS} select s.id as saison, s.titre, s.annee, coalesce(p.n, 0) as participants, coalesce(c.n, 0) as conseils, p.age_moyen from saisons s
 left join (select saison, count(*) as n, round(avg(age), 6) as age_moyen from parts group by saison) p on p.saison = s.id left join (select saison, count(*) as n from sess group by saison) c on c.saison = s.id""")
def a08_season_rows(spark, d):
    p = parts(spark, d).groupBy("saison").agg(F.count("*").alias("pn"), R6(F.avg("age"), "age_moyen"))
    c = sessions(spark, d).groupBy("saison").agg(F.count("*").alias("cn"))
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"), "titre", "annee")
    return s.join(p, "saison", "left").join(c, "saison", "left").select("saison", "titre", "annee", F.coalesce("pn", F.lit(0)).alias("participants"), F.coalesce("cn", F.lit(0)).alias("conseils"), "age_moyen")


@query(f"""{P}, g as (select id, count(*) as n from parts group by id) select 'plus_jeune' as record, min_by(id, (age, saison, id)) as id, cast(min(age) as bigint) as valeur from reg where age is not null
 union all select 'plus_age', max_by(id, (age, saison, id)), cast(max(age) as bigint) from reg where age is not null union all select 'plus_de_participations', max_by(id, (n, id)), max(n) from g""")
def a09_records(spark, d):
    p = parts(spark, d)
    r = regular(p).filter("age is not null")
    o = F.struct("age", "saison", "id")
    many = p.groupBy("id").agg(F.count("*").alias("n")).agg(F.lit("plus_de_participations").alias("record"), F.max_by("id", F.struct("n", "id")).alias("id"), F.max("n").alias("valeur"))
    young = r.agg(F.lit("plus_jeune").alias("record"), F.min_by("id", o).alias("id"), F.min("age").cast("bigint").alias("valeur"))
    old = r.agg(F.lit("plus_age").alias("record"), F.max_by("id", o).alias("id"), F.max("age").cast("bigint").alias("valeur"))
    return A.union_all([young, old, many])


@query(f"""{S} select saison, max(n) as most from (select saison, episode, count(distinct case when type = 'jury' then 'jury' else cast(numero as varchar) end) as n from sess where episode is not null group by saison, episode) group by saison""")
def a10_sessions_an_evening(spark, d):
    k = F.when(F.col("type") == "jury", "jury").otherwise(F.col("numero").cast("string"))
    g = sessions(spark, d).filter("episode is not null").select("saison", "episode", k.alias("k")).distinct().groupBy("saison", "episode").agg(F.count("*").alias("n"))
    return g.groupBy("saison").agg(F.max("n").alias("most"))


_COUNCIL = f"""u as (select saison, numero, bool_and(cible = elimine) filter (where votant is distinct from elimine) as una from ballots where type = 'elimination' and complet group by all)"""


@query(f"""{S}, {_COUNCIL} select saison, count(*) as conseils, count(*) filter (where complet) as complets, count(*) filter (where annulation is not null) as annules, count(*) filter (where votes_contre <= votes_exprimes / cast(2 as double) + 0.5) as serres,
 count(*) filter (where una) as unanimes, round(avg(cast(votes_contre as double) / nullif(votes_exprimes, 0)), 6) as part_moyenne from sess left join u using (saison, numero) where type = 'elimination' group by saison""")
def a11_council_block(spark, d):
    s = sessions(spark, d).filter("type = 'elimination'")
    u = ballots(spark, d).filter("type = 'elimination' and complet and not (votant <=> elimine)").groupBy("saison", "numero").agg(F.every(F.col("cible") == F.col("elimine")).alias("una"))
    g = s.join(u, ["saison", "numero"], "left").groupBy("saison")
    return g.agg(
        F.count("*").alias("conseils"), F.count_if("complet").alias("complets"), F.count_if(F.col("annulation").isNotNull()).alias("annules"), F.count_if(F.col("votes_contre") <= F.col("votes_exprimes") / 2 + 0.5).alias("serres"),
        F.count_if("una").alias("unanimes"), R6(F.avg(F.col("votes_contre").cast("double") / F.nullif(F.col("votes_exprimes"), F.lit(0))), "part_moyenne"),
    )


@query(f"""{S} select b.saison, cible, count(*) as voix, round(100.0 * count(*) / sum(count(*)) over (partition by b.saison), 6) as part from ballots b where type = 'jury' group by b.saison, cible""")
def a12_jury(spark, d):
    g = ballots(spark, d).filter("type = 'jury'").groupBy("saison", "cible").agg(F.count("*").alias("voix"))
    return g.withColumn("part", R6(100.0 * F.col("voix") / F.sum("voix").over(Window.partitionBy("saison")), "part"))


@query(f"""{P}, m as (select saison, max(vi) as most from reg group by saison) select p.saison, p.id, p.vi, round(cast(p.vi as double) / greatest(p.vi, m.most), 6) as part from reg p join m using (saison) where p.vi > 0 and m.most >= 3""")
def a13_contest_share(spark, d):
    p = regular(parts(spark, d)).withColumn("most", F.max("vi").over(Window.partitionBy("saison"))).filter("vi > 0 and most >= 3")
    return p.select("saison", "id", "vi", R6(F.col("vi").cast("double") / F.greatest("vi", "most"), "part"))


@query(f"""{P}, h as (select votes_recus as v, count(*) as n from reg where sort = 'vainqueur' and votes_recus is not null group by 1) select cast(s.v as integer) as votes_recus, coalesce(h.n, 0) as n from (select unnest(range(0, (select max(v) + 1 from h))) as v) s left join h on h.v = s.v""")
def a15_winners_votes(spark, d):
    return A.histogram(regular(parts(spark, d)).filter("sort = 'vainqueur'"), "votes_recus")


@query(f"""{P} select annee // 5 * 5 as periode, count(*) as n, count(distinct saison) as saisons, round(avg(age), 6) as age, round(avg(votes_recus), 6) as votes from reg where annee is not null group by 1""")
def a16_five_years(spark, d):
    g = regular(parts(spark, d)).filter("annee is not null").groupBy((F.floor(F.col("annee") / 5) * 5).cast("int").alias("periode"))
    return g.agg(F.count("*").alias("n"), F.count_distinct("saison").alias("saisons"), R6(F.avg("age"), "age"), R6(F.avg("votes_recus"), "votes"))


@query("""select champ, n, missing, different from (select 'age' as champ, count(*) as n, count(*) - count(age) as missing, count(distinct age) as different from participations union all select 'profession', count(*), count(*) - count(profession), count(distinct profession) from participations
 union all select 'localisation', count(*), count(*) - count(localisation), count(distinct localisation) from participations union all select 'sort', count(*), count(*) - count(sort), count(distinct sort) from participations union all select 'tribu', count(*), count(*) - count(tribu), count(distinct tribu) from participations)""")
def a21_field_profile(spark, d):
    return A.null_profile(table(spark, d, "participations"), ["age", "profession", "localisation", "sort", "tribu"])


@query("""select champ, source, count(*) as n from (select unnest(map_keys(sources)) as champ, unnest(map_values(sources)) as source from participations) group by all""")
def a21_provenance(spark, d):
    return table(spark, d, "participations").select(F.explode("sources").alias("champ", "source")).groupBy("champ", "source").agg(F.count("*").alias("n"))


@query(f"""{P}, o as (select id, count(distinct saison) as vues from participations where id is not null group by id) select q.id, q.nb_participations as annoncees, coalesce(o.vues, 0) as vues from personnes q left join o on o.id = q.id where q.nb_participations is distinct from coalesce(o.vues, 0)""")
def a22_declared_and_seen(spark, d):
    o = table(spark, d, "participations").select("id", "saison").dropna().distinct().groupBy("id").agg(F.count("*").alias("vues"))
    q = table(spark, d, "personnes").select("id", F.col("nb_participations").alias("annoncees"))
    return q.join(o, "id", "left").withColumn("vues", F.coalesce("vues", F.lit(0))).filter(~F.col("annoncees").eqNullSafe(F.col("vues")))


@query(f"""{S}, c as (select saison, numero, cible, count(*) as n from ballots where type = 'elimination' group by all), t as (select *, n / sum(n) over (partition by saison, numero) as p from c)
select saison, numero, round(case when count(*) > 1 then sum(-p * ln(p)) / ln(count(*)) else 0 end, 6) as entropy, round(sum(p * p), 6) as herfindahl from t group by saison, numero""")
def a23_entropy_of_votes(spark, d):
    c = ballots(spark, d).filter("type = 'elimination'").groupBy("saison", "numero", "cible").agg(F.count("*").alias("n"))
    return A.entropy(c, ["saison", "numero"], "n").select("saison", "numero", R6(F.col("entropy"), "entropy"), R6(F.col("herfindahl"), "herfindahl"))


_PERSON = """v as (select saison, votant as id, count(*) as bulletins, count(*) filter (where cible = elimine) as justes from ballots where type = 'elimination' and votant_ok and votant is distinct from elimine group by all),
r as (select saison, cible as id, count(*) as recus, count(distinct numero) as menaces from ballots where type = 'elimination' and cible_ok group by all)"""


@query(f"""{PS}, {_PERSON} select p.saison, p.id, coalesce(v.bulletins, 0) as bulletins, coalesce(v.justes, 0) as justes, case when v.bulletins >= 4 then round(100.0 * v.justes / v.bulletins, 6) end as precision_pct, coalesce(r.recus, 0) as recus, coalesce(r.menaces, 0) as menaces
 from parts p left join v using (saison, id) left join r using (saison, id)""")
def a25_person_indicators(spark, d):
    b = ballots(spark, d).filter("type = 'elimination'")
    v = b.filter("votant_ok and not (votant <=> elimine)").groupBy("saison", F.col("votant").alias("id")).agg(F.count("*").alias("bulletins"), F.count_if(F.col("cible") == F.col("elimine")).alias("justes"))
    r = b.filter("cible_ok").groupBy("saison", F.col("cible").alias("id"), "numero").agg(F.count("*").alias("k")).groupBy("saison", "id").agg(F.sum("k").alias("recus"), F.count("*").alias("menaces"))
    p = parts(spark, d).select("saison", "id").join(v, ["saison", "id"], "left").join(r, ["saison", "id"], "left")
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.select("saison", "id", z("bulletins"), z("justes"), F.when(F.col("bulletins") >= 4, F.round(100.0 * F.col("justes") / F.col("bulletins"), 6)).alias("precision_pct"), z("recus"), z("menaces"))


@query(f"""{S}, c as (select saison, numero, cible, count(*) as n from ballots where type = 'elimination' and complet group by all), t as (select saison, numero, max(n) as top, sum(n) as total, count(*) as cibles from c group by all)
select saison, count(*) as n, round(avg(cast(top as double) / total), 6) as tension, round(avg(cibles), 6) as dispersion from t group by saison having count(*) >= 3""")
def a26_season_indicators(spark, d):
    c = ballots(spark, d).filter("type = 'elimination' and complet").groupBy("saison", "numero", "cible").agg(F.count("*").alias("n"))
    t = c.groupBy("saison", "numero").agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.count("*").alias("cibles"))
    return t.groupBy("saison").agg(F.count("*").alias("n"), R6(F.avg(F.col("top").cast("double") / F.col("total")), "tension"), R6(F.avg("cibles"), "dispersion")).filter("n >= 3")


@query(f"""{PS}, pres as (select distinct saison, numero, votant as id from ballots where votant_ok and type = 'elimination'), n as (select saison, id, count(*) as conseils from pres group by all)
select p.saison, p.id, n.conseils from parts p join n using (saison, id) where p.votes_recus = 0 and n.conseils >= 5""")
def a27_ghosts(spark, d):
    n = ballots(spark, d).filter("votant_ok and type = 'elimination'").select("saison", "numero", F.col("votant").alias("id")).distinct().groupBy("saison", "id").agg(F.count("*").alias("conseils"))
    return parts(spark, d).filter("votes_recus = 0").select("saison", "id").join(n.filter("conseils >= 5"), ["saison", "id"])


@query(f"""{PS}, r as (select saison, cible as id, count(*) as n from ballots where cible_ok and type = 'elimination' group by all) select p.saison, p.id, case when p.en_cours then null else greatest(p.votes_recus, r.n) end as total from parts p left join r using (saison, id)""")
def a28_vote_totals(spark, d):
    r = ballots(spark, d).filter("cible_ok and type = 'elimination'").groupBy("saison", F.col("cible").alias("id")).agg(F.count("*").alias("n"))
    return parts(spark, d).join(r, ["saison", "id"], "left").select("saison", "id", F.when(~F.col("en_cours"), F.greatest(F.col("votes_recus").cast("bigint"), "n")).alias("total"))


@query(f"""{PS}, e as (select saison, elimine as id, max_by(ep, numero) as ep from sess where elimine_rattache and type = 'elimination' and ep is not null group by all), m as (select saison, max(ep) as last from sess group by saison)
select p.saison, p.id, case when p.sort in ('vainqueur', 'finaliste') then m.last else e.ep end as sortie from parts p left join e using (saison, id) left join m using (saison)""")
def a29_exit_episode(spark, d):
    s = sessions(spark, d)
    e = s.filter("elimine_rattache and type = 'elimination' and ep is not null").groupBy("saison", F.col("elimine").alias("id")).agg(F.max_by("ep", "numero").alias("ep"))
    m = s.groupBy("saison").agg(F.max("ep").alias("last"))
    p = parts(spark, d).select("saison", "id", "sort").join(e, ["saison", "id"], "left").join(m, "saison", "left")
    return p.select("saison", "id", F.when(F.col("sort").isin("vainqueur", "finaliste"), F.col("last")).otherwise(F.col("ep")).alias("sortie"))


@query(f"""{P}, b as (select cast(floor(least(cast(100 as double) * jour / duree_jours, 99.999) / 10) * 10 as integer) as bin, count(*) as exits from reg where jour is not null group by 1)
select bin, exits, cast(sum(exits) over (order by bin desc) as bigint) as at_risk from b""")
def a30_life_table(spark, d):
    return A.life_table(regular(parts(spark, d)), 100.0 * F.col("jour") / F.col("duree_jours"))


@query(f"""{P}, c as (select couleur, jour from reg where jour is not null and couleur is not null), k as (select distinct couleur from c), t as (select couleur, count(*) as n from c group by couleur)
select k.couleur, cast(s.day as integer) as day, count(c.jour) as still, round(100.0 * count(c.jour) / t.n, 6) as share from k cross join (select unnest(range(1, 41)) as day) s join t on t.couleur = k.couleur left join c on c.couleur = k.couleur and c.jour >= s.day group by k.couleur, s.day, t.n""")
def a31_survival_by_colour(spark, d):
    p = regular(parts(spark, d)).filter("couleur is not null").select("couleur", "jour")
    return A.survival_curve(p, ["couleur"], "jour", 40).select("couleur", "day", "still", R6(F.col("share"), "share"))


@query("""select dayofweek(diffusion.debut) as jour, count(*) as saisons, min(annee) as premiere, max(annee) as derniere from saisons where diffusion.debut is not null group by 1""")
def a34_weekday_of_premiere(spark, d):
    s = table(spark, d, "saisons").filter("diffusion.debut is not null")
    return s.groupBy((F.dayofweek("diffusion.debut") - 1).cast("bigint").alias("jour")).agg(F.count("*").alias("saisons"), F.min("annee").alias("premiere"), F.max("annee").alias("derniere"))


@query("""select m as mecanique, min(annee) as premiere, max(annee) as derniere, count(*) as saisons from (select annee, unnest(mecaniques) as m from saisons) group by m""")
def a34_mechanics(spark, d):
    return table(spark, d, "saisons").select("annee", F.explode("mecaniques").alias("mecanique")).groupBy("mecanique").agg(F.min("annee").alias("premiere"), F.max("annee").alias("derniere"), F.count("*").alias("saisons"))


@query(f"""{S}, c as (select saison, votes_contre as v, count(*) as n from sess where votes_contre is not null group by all), r as (select *, row_number() over (partition by saison order by n desc, v) as r from c) select saison, v as mode, n from r where r = 1""")
def a35_mode_of_votes(spark, d):
    return A.mode_smallest(sessions(spark, d), ["saison"], "votes_contre")


@query(f"""{P}, k as (select id, saison, jour, duree_jours, count(*) over (partition by id) as n, row_number() over (partition by id order by annee, saison) as r from parts where annee is not null)
select case when n = 1 then 'jamais' when r = 1 then 'premiere' else 'suivante' end as rang, count(*) as n, round(avg(100.0 * jour / duree_jours), 6) as survie from k group by 1""")
def a37_returners(spark, d):
    p = parts(spark, d).filter("annee is not null")
    w = Window.partitionBy("id")
    p = p.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("annee", "saison")))
    return p.groupBy(F.when(F.col("n") == 1, "jamais").when(F.col("r") == 1, "premiere").otherwise("suivante").alias("rang")).agg(F.count("*").alias("n"), R6(F.avg(100.0 * F.col("jour") / F.col("duree_jours")), "survie"))


@query(f"""{S}, c as (select saison, numero, cible, elimine, count(*) as n from ballots where type = 'elimination' and complet group by all), t as (select saison, numero, min(elimine) as elimine, max(n) as top, max(n) filter (where cible = elimine) as mine, count(*) as k from c group by all),
u as (select *, (select count(*) from c where c.saison = t.saison and c.numero = t.numero and c.n = t.top) as ties from t) select case when ties > 1 then 'egalite' when mine = top then 'ordinaire' else 'renversement' end as issue, count(*) as n from u group by 1""")
def a38_session_issues(spark, d):
    c = ballots(spark, d).filter("type = 'elimination' and complet").groupBy("saison", "numero", "cible", "elimine").agg(F.count("*").alias("n"))
    t = c.groupBy("saison", "numero").agg(F.max(F.struct("n")).alias("m"), F.max(F.when(F.col("cible") == F.col("elimine"), F.col("n"))).alias("mine"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    ties = F.size(F.filter("ns", lambda x: x == F.element_at("ns", 1)))
    return t.groupBy(F.when(ties > 1, "egalite").when(F.col("mine") == F.col("m.n"), "ordinaire").otherwise("renversement").alias("issue")).agg(F.count("*").alias("n"))


@query(f"""{S}, c as (select saison, numero, cible, count(*) as n from ballots where type = 'elimination' and complet group by all), m as (select *, rank() over (partition by saison, numero order by n desc) as r from c), x as (select b.saison, b.votant, m.r = 1 as maj from ballots b join m using (saison, numero, cible) where b.votant_ok and type = 'elimination' and complet)
select saison, votant as id, count(*) as n, round(100.0 * count(*) filter (where maj) / count(*), 6) as part from x group by saison, votant having count(*) >= 4""")
def a39_majority_side(spark, d):
    b = ballots(spark, d).filter("type = 'elimination' and complet")
    c = b.groupBy("saison", "numero", "cible").agg(F.count("*").alias("n")).withColumn("r", F.rank().over(Window.partitionBy("saison", "numero").orderBy(F.desc("n"))))
    x = b.filter("votant_ok").join(c.select("saison", "numero", "cible", "r"), ["saison", "numero", "cible"])
    g = x.groupBy("saison", F.col("votant").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("r") == 1).alias("k")).filter("n >= 4")
    return g.select("saison", "id", "n", R6(A.share(F.col("k"), F.col("n")), "part"))


@query(f"""{P} select id, count(*) as n, string_agg(saison, ',' order by annee, saison) as saisons from parts where annee is not null group by id having count(*) > 1""")
def a44_careers(spark, d):
    g = parts(spark, d).filter("annee is not null").groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("annee", "saison"))).alias("s")).filter("n > 1")
    return g.select("id", "n", F.array_join(F.transform("s", lambda x: x["saison"]), ",").alias("saisons"))


@query(f"""{P} select profession, count(*) as n from parts where profession is not null group by profession order by n desc, profession limit 15""")
def a46_commonest_jobs(spark, d):
    g = parts(spark, d).filter("profession is not null").groupBy("profession").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "profession").limit(15)


@query(f"""{P} select saison, id, votes_recus, round(rank() over (partition by saison order by votes_recus) + (count(*) over (partition by saison, votes_recus) - 1) / cast(2 as double), 6) as rang from reg where votes_recus is not null""")
def w02_average_ranks(spark, d):
    return regular(parts(spark, d)).filter("votes_recus is not null").select("saison", "id", "votes_recus", R6(A.average_rank("votes_recus", ["saison"]), "rang"))


@query(f"""{P}, g as (select *, annee // 5 * 5 as per from reg where votes_recus is not null and annee is not null), m as (select per, avg(votes_recus) as a, stddev_pop(votes_recus) as s, count(*) as n from g group by per)
select saison, id, case when n >= 12 and s > 1e-12 then round((votes_recus - a) / s, 6) end as z from g join m using (per)""")
def w05_z_within_period(spark, d):
    g = regular(parts(spark, d)).filter("votes_recus is not null and annee is not null").withColumn("per", F.floor(F.col("annee") / 5))
    # moments are aggregated first; a window would bring a whole period into one task
    m = g.groupBy("per").agg(F.avg("votes_recus").alias("a"), F.stddev_pop("votes_recus").alias("s"), F.count("*").alias("n"))
    return g.join(m, "per").select("saison", "id", F.when((F.col("n") >= 12) & (F.col("s") > 1e-12), F.round((F.col("votes_recus") - F.col("a")) / F.col("s"), 6)).alias("z"))


@query(f"""{P}, a as (select annee, count(*) as n from reg where annee is not null group by annee) select annee, n, lead(n) over (order by annee) as suivante, round(100.0 * n / first_value(n) over (order by annee), 6) as indice from a""")
def w08_years_lead_and_index(spark, d):
    a = regular(parts(spark, d)).filter("annee is not null").groupBy("annee").agg(F.count("*").alias("n"))
    w = Window.orderBy("annee")  # a row a year
    return a.select("annee", "n", F.lead("n").over(w).alias("suivante"), R6(100.0 * F.col("n") / F.first("n").over(w), "indice"))


@query(f"""{P}, x as (select saison, id, couleur, coalesce(cast(couleur = lag(couleur) over w as integer), 0) as same from reg where jour is not null window w as (partition by saison order by jour, id)),
y as (select *, (select 0) + sum(1 - same) over (partition by saison order by rn rows unbounded preceding) as run from (select x.*, r.rn from x join (select saison, id, row_number() over (partition by saison order by jour, id) as rn from reg where jour is not null) r using (saison, id))), z as (select saison, run, count(*) as n from y group by all)
select saison, max(n) as longest, cast(sum(n - 1) as bigint) as repeats from z group by saison""")
def w09_longest_run_of_colour(spark, d):
    return A.longest_run(regular(parts(spark, d)).filter("jour is not null").select("saison", "jour", "id", "couleur"), ["saison"], ["jour", "id"], "couleur")


@query(f"""{P}, r as (select saison, id, jour, row_number() over (partition by saison order by jour, id) as r, count(*) over (partition by saison) as n from reg where jour is not null) select saison, id, cast((r - 1) * 5 // n as integer) as quintile from r""")
def w11_quintiles(spark, d):
    w = Window.partitionBy("saison")
    p = regular(parts(spark, d)).filter("jour is not null")
    return p.select("saison", "id", F.floor((F.row_number().over(w.orderBy("jour", "id")) - 1) * 5 / F.count("*").over(w)).cast("int").alias("quintile"))


@query(f"""{P}, m as (select saison, quantile_cont(votes_recus, 0.5) as med from reg group by saison) select saison, count(*) filter (where votes_recus > 2 * med) as au_dessus from reg join m using (saison) group by saison""")
def w12_above_twice_the_median(spark, d):
    p = regular(parts(spark, d)).select("saison", "votes_recus")
    m = p.groupBy("saison").agg(F.percentile("votes_recus", 0.5).alias("med"))
    return p.join(m, "saison").groupBy("saison").agg(F.count_if(F.col("votes_recus") > 2 * F.col("med")).alias("au_dessus"))


@query(f"""{P}, c as (select saison, genre, count(*) as n from parts where genre is not null group by all), r as (select saison, min_by(genre, n) as g, min(n) as lo, max(n) as hi, count(*) as k from c group by saison) select saison, case when k = 2 and lo < hi then g end as minoritaire from r""")
def w13_minority_gender(spark, d):
    c = parts(spark, d).filter("genre is not null").groupBy("saison", "genre").agg(F.count("*").alias("n"))
    g = c.groupBy("saison").agg(F.min_by("genre", "n").alias("g"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("k"))
    return g.select("saison", F.when((F.col("k") == 2) & (F.col("lo") < F.col("hi")), F.col("g")).alias("minoritaire"))


@query("""select id, numero, coalesce(presentateur, last_value(presentateur ignore nulls) over (order by numero, id rows unbounded preceding)) as presentateur from saisons""")
def w18_presenter_filled_forward(spark, d):
    w = Window.orderBy("numero", "id").rowsBetween(Window.unboundedPreceding, 0)  # a row a season
    return table(spark, d, "saisons").select("id", "numero", F.last("presentateur", ignorenulls=True).over(w).alias("presentateur"))


@query(f"""{P}, r as (select saison, id, couleur, vi, row_number() over (partition by couleur order by vi desc, saison, id) as rank from reg where vi is not null and couleur is not null) select * from r where rank <= 10""")
def o03_top_ten_by_colour(spark, d):
    p = regular(parts(spark, d)).filter("vi is not null and couleur is not null").select("saison", "id", "couleur", "vi")
    return A.top_of_each(p, ["couleur"], [F.desc("vi"), F.asc("saison"), F.asc("id")], 10)


@query(f"""{PS}, {_PERSON} select concat(saison, '/', id) as cle, bulletins, round(100.0 * justes / bulletins, 6) as taux from v where bulletins >= 5 order by taux desc, cle limit 20""")
def o04_leaderboard(spark, d):
    v = ballots(spark, d).filter("type = 'elimination' and votant_ok and not (votant <=> elimine)").groupBy("saison", F.col("votant").alias("id")).agg(F.count("*").alias("bulletins"), F.count_if(F.col("cible") == F.col("elimine")).alias("k"))
    v = v.select(F.concat("saison", F.lit("/"), "id").alias("cle"), "bulletins", R6(A.share(F.col("k"), F.col("bulletins")), "taux"))
    return A.leaderboard(v, "cle", "taux", "bulletins", 5, 20)


@query(f"""{S} select saison, count(*) as n from (select saison, numero, votant as id from ballots where votant_ok union select saison, numero, cible from ballots where cible_ok union select saison, numero, elimine from sess where elimine_rattache) where id is not null group by saison""")
def u01_named_people(spark, d):
    from .relational import present_people

    return present_people(ballots(spark, d), sessions(spark, d)).groupBy("saison").agg(F.count("*").alias("n"))


@query(f"""{S} select id from saisons except select saison from sess""")
def u03_seasons_without_sessions(spark, d):
    return table(spark, d, "saisons").select("id").exceptAll(sessions(spark, d).select(F.col("saison").alias("id")).distinct())


@query(f"""{P}, a as (select saison, id from reg where vi is not null order by vi desc, saison, id limit 25), b as (select saison, id from reg where votes_recus is not null order by votes_recus desc, saison, id limit 25)
select coalesce(a.saison, b.saison) as saison, coalesce(a.id, b.id) as id, case when b.id is null then 'sortant' when a.id is null then 'entrant' else 'commun' end as etat from a full join b on a.saison = b.saison and a.id = b.id""")
def u04_two_rankings(spark, d):
    p = regular(parts(spark, d))
    top = lambda c: p.filter(F.col(c).isNotNull()).orderBy(F.desc(c), "saison", "id").limit(25).select("saison", "id", F.lit(1).alias(c))
    x = top("vi").join(top("votes_recus"), ["saison", "id"], "full_outer")
    return x.select("saison", "id", F.when(F.col("votes_recus").isNull(), "sortant").when(F.col("vi").isNull(), "entrant").otherwise("commun").alias("etat"))


QUERIES = Q
