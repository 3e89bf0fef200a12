"""Queries on sessions and ballots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, parts, regular, sessions
from ..session import table
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

PRESENCE_SQL = """
pres as (select saison, numero, id from (select saison, numero, votant as id from ballots where votant_ok union select saison, numero, cible from ballots where cible_ok
  union select saison, numero, elimine from sess where elimine_rattache) where id is not null),
seg as (select saison, numero, complet, elimine, elimine_rattache, sum(case when complet then 0 else 1 end) over (partition by saison order by numero rows unbounded preceding) as seg from sess where type = 'elimination'),
chain as (select p.saison, p.numero, p.id, g.seg, g.complet, g.elimine, g.elimine_rattache, coalesce(v.n, 0) as votes
  from pres p join seg g using (saison, numero) left join (select saison, numero, cible as id, count(*) as n from ballots where cible_ok group by all) v using (saison, numero, id))"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    s, b = sessions(spark, d), ballots(spark, d)
    seg = R.segments(s.filter(F.col("type") == "elimination").select("saison", "numero", "complet", "elimine", "elimine_rattache"), "saison", "numero", "complet")
    votes = b.filter("cible_ok").groupBy("saison", "numero", F.col("cible").alias("id")).agg(F.count("*").alias("n"))
    c = R.present_people(b, s).join(seg, ["saison", "numero"]).join(votes, ["saison", "numero", "id"], "left")
    return c.withColumn("votes", F.coalesce("n", F.lit(0))).withColumnRenamed("complet", "complete").drop("n")


def _exit_by_previous(spark: SparkSession, d: str, strict: bool, depth: int) -> DataFrame:
    c = R.asof_barrier(_chain(spark, d), "saison", "id", "numero", "votes", strict, depth).filter(F.col("prev").isNotNull())
    out = F.coalesce((F.col("id") == F.col("elimine")) & F.coalesce("elimine_rattache", F.lit(False)), F.lit(False))
    w = Window.partitionBy("saison", "numero")
    c = c.withColumn("out", out.cast("int")).withColumn("risk", F.count("*").over(w)).withColumn("has", F.max("out").over(w)).filter((F.col("risk") >= 3) & (F.col("has") == 1))
    g = c.groupBy(F.when(F.col("prev") >= 2, "2+").otherwise(F.col("prev").cast("string")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("out").cast("bigint").alias("k"), F.avg(1.0 / F.col("risk")).alias("c"))
    return g.select("bucket", "n", "k", R6(100.0 * F.col("k") / F.col("n"), "rate"), R6(100 * F.col("c"), "chance"), R6(R.wilson(F.col("k"), F.col("n"), -1), "low"), R6(R.wilson(F.col("k"), F.col("n"), 1), "high"))


def _exit_sql(seg: str, depth: int) -> str:
    return f"""
with {SESSIONS_SQL}, {PRESENCE_SQL},
a as (select *, lag(votes, {depth}) over (partition by saison, id{seg} order by numero) as prev from chain where complet),
b as (select *, case when elimine_rattache and id = elimine then 1 else 0 end as out from a where prev is not null),
c as (select *, count(*) over (partition by saison, numero) as risk, max(out) over (partition by saison, numero) as has from b),
g as (select case when prev >= 2 then '2+' else cast(prev as varchar) end as bucket, count(*) as n, cast(sum(out) as bigint) as k, avg(cast(1 as double) / risk) as c from c where risk >= 3 and has = 1 group by 1),
w as (select *, cast(k as double) / n as p, 1.959963985 as z from g)
select bucket, n, k, round(100 * p, 6) as rate, round(100 * c, 6) as chance,
  round(greatest(0, 100 * (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) as low, round(least(100, 100 * (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) as high
from (select bucket, n, k, c, p, cast(z as double) as z from w)"""


@query(_exit_sql(", seg", 1))
def j07_exit_by_previous_votes_strict(spark, d):
    return _exit_by_previous(spark, d, True, 1)


@query(_exit_sql("", 1))
def j07_exit_by_previous_votes_relaxed(spark, d):
    return _exit_by_previous(spark, d, False, 1)


@query(_exit_sql(", seg", 2))
def j08_exit_by_votes_two_back(spark, d):
    return _exit_by_previous(spark, d, True, 2)


@query(f"""with {SESSIONS_SQL}, {PARTS_SQL}
select v.genre as genre_votant, c.genre as genre_cible, count(*) as n from ballots b join parts v on v.saison = b.saison and v.id = b.votant join parts c on c.saison = b.saison and c.id = b.cible
where b.type = 'elimination' and votant_ok and cible_ok group by all""")
def j02_ballots_by_gender(spark, d):
    b = ballots(spark, d).filter("type = 'elimination' and votant_ok and cible_ok").groupBy("saison", "votant", "cible").agg(F.count("*").alias("n"))
    p = parts(spark, d).select("saison", "id", "genre")
    v = p.select("saison", F.col("id").alias("votant"), F.col("genre").alias("genre_votant"))
    c = p.select("saison", F.col("id").alias("cible"), F.col("genre").alias("genre_cible"))
    return b.join(v, ["saison", "votant"]).join(c, ["saison", "cible"]).groupBy("genre_votant", "genre_cible").agg(F.sum("n").alias("n"))


@query(f"""with {PARTS_SQL}
select v.saison, v.id as vainqueur, f.id as finaliste, v.age - f.age as ecart from parts v join parts f on v.saison = f.saison where v.sort = 'vainqueur' and f.sort = 'finaliste' and not v.speciale""")
def j04_winner_and_finalist(spark, d):
    p = parts(spark, d).filter("not speciale").select("saison", "id", "age", "sort")
    v = p.filter("sort = 'vainqueur'").select("saison", F.col("id").alias("vainqueur"), F.col("age").alias("va"))
    f = p.filter("sort = 'finaliste'").select("saison", F.col("id").alias("finaliste"), F.col("age").alias("fa"))
    return v.join(f, "saison").select("saison", "vainqueur", "finaliste", (F.col("va") - F.col("fa")).alias("ecart"))


_AL = f"""{SESSIONS_SQL},
b as (select saison, numero, votant, min(cible) as cible from ballots where type = 'elimination' and complet and votant_ok group by all),
pr as (select x.saison, x.numero, x.votant as a, y.votant as b, x.cible = y.cible as same from b x join b y on x.saison = y.saison and x.numero = y.numero and x.votant < y.votant)"""


def _alignment(spark: SparkSession, d: str) -> DataFrame:
    b = ballots(spark, d).filter("type = 'elimination' and complet and votant_ok").groupBy("saison", "numero", "votant").agg(F.min("cible").alias("cible"))
    p = R.pairs(b, ["saison", "numero"], "votant", ["cible"])
    return p.select("saison", "numero", "a", "b", (F.col("cible_a") == F.col("cible_b")).alias("same"))


@query(f"with {_AL} select saison, a, b, count(*) as n, count(*) filter (where same) as together from pr group by saison, a, b having count(*) >= 4")
def j05_pair_alignment(spark, d):
    return _alignment(spark, d).groupBy("saison", "a", "b").agg(F.count("*").alias("n"), F.count_if("same").alias("together")).filter("n >= 4")


@query(f"""with {_AL}, i as (select saison, numero, dense_rank() over (partition by saison order by numero) as i from (select distinct saison, numero from pr)),
t as (select saison, i, a, b from pr join i using (saison, numero) where same)
select x.saison, count(*) as pairs, count(y.a) as kept from t x left join t y on x.saison = y.saison and x.a = y.a and x.b = y.b and y.i = x.i + 1 group by x.saison""")
def j06_pair_persistence(spark, d):
    p = _alignment(spark, d)
    i = p.select("saison", "numero").distinct().withColumn("i", F.dense_rank().over(Window.partitionBy("saison").orderBy("numero")))
    t = p.filter("same").join(i, ["saison", "numero"])
    w = Window.partitionBy("saison", "a", "b").orderBy("i")
    return t.withColumn("next", F.lead("i").over(w)).groupBy("saison").agg(F.count("*").alias("pairs"), F.count_if(F.col("next") == F.col("i") + 1).alias("kept"))


@query(f"""with {SESSIONS_SQL}
select saison, numero, elimine, lag(elimine) over (partition by saison order by numero) as precedent, numero - lag(numero) over (partition by saison order by numero) as ecart from sess where type = 'elimination'""")
def j09_previous_session(spark, d):
    w = Window.partitionBy("saison").orderBy("numero")
    return sessions(spark, d).filter("type = 'elimination'").select("saison", "numero", "elimine", F.lag("elimine").over(w).alias("precedent"), (F.col("numero") - F.lag("numero").over(w)).alias("ecart"))


@query(f"""with {PARTS_SQL}, e as (select distinct saison, jour from reg where jour is not null)
select e.saison, e.jour, count(*) as still from e join reg p on p.saison = e.saison and p.jour >= e.jour group by e.saison, e.jour""")
def j10_still_in(spark, d):
    # a theta join as a running count over the days of exit: no row is paired
    p = regular(parts(spark, d)).filter("jour is not null").groupBy("saison", "jour").agg(F.count("*").alias("n"))
    w = Window.partitionBy("saison").orderBy(F.desc("jour"))
    return p.select("saison", "jour", F.sum("n").over(w).alias("still"))


@query(f"with {SESSIONS_SQL} select saison, ep, min(numero) as numero, min(elimine) as elimine from sess where ep is not null and type = 'elimination' group by saison, ep having count(*) = 1")
def j11_single_session_episodes(spark, d):
    g = sessions(spark, d).filter("ep is not null and type = 'elimination'").groupBy("saison", "ep").agg(F.count("*").alias("k"), F.min("numero").alias("numero"), F.min("elimine").alias("elimine"))
    return g.filter("k = 1").drop("k")


@query("select distinct p.id from participations p where p.id is not null and not exists (select 1 from personnes q where q.id = p.id)")
def j12_outside_the_list(spark, d):
    return table(spark, d, "participations").select("id").dropna().distinct().join(table(spark, d, "personnes").select("id"), "id", "left_anti")


@query(f"""with {PARTS_SQL}, ok as (select saison from parts group by saison having avg(case when jour is not null then 1.0 else 0 end) >= 0.8)
select saison, count(*) as n from parts where saison in (select saison from ok) group by saison""")
def j13_covered_seasons(spark, d):
    p = parts(spark, d)
    ok = p.groupBy("saison").agg(F.avg(F.when(F.col("jour").isNotNull(), 1.0).otherwise(0.0)).alias("c")).filter("c >= 0.8").select("saison")
    return p.join(ok, "saison", "left_semi").groupBy("saison").agg(F.count("*").alias("n"))


@query(f"""with {SESSIONS_SQL}, e as (select distinct saison, votant as a, cible as b from ballots where type = 'elimination' and votant_ok and cible_ok)
select x.saison, count(*) as edges, count(y.a) as returned from e x left join e y on x.saison = y.saison and x.a = y.b and x.b = y.a group by x.saison""")
def j14_reciprocity(spark, d):
    e = ballots(spark, d).filter("type = 'elimination' and votant_ok and cible_ok").select("saison", F.col("votant").alias("a"), F.col("cible").alias("b")).distinct()
    # both directions of a pair meet under its sorted members: one shuffle, no join
    k = e.select("saison", "a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    g = k.groupBy("saison", "x", "y").agg(F.count("*").alias("k"), F.max((F.col("a") == F.col("b")).cast("int")).alias("self"))
    return g.groupBy("saison").agg(F.sum("k").alias("edges"), F.sum(F.when((F.col("k") == 2) | (F.col("self") == 1), F.col("k")).otherwise(0)).alias("returned"))


@query(f"""with {SESSIONS_SQL}, v as (select distinct saison, numero, votant, cible from ballots where type = 'elimination' and votant_ok and cible_ok),
i as (select saison, numero, row_number() over (partition by saison order by numero) as i from (select distinct saison, numero from v)), w as (select v.*, i.i from v join i using (saison, numero))
select a.saison, count(*) as named, count(b.votant) as returned from w a left join w b on b.saison = a.saison and b.i = a.i + 1 and b.votant = a.cible and b.cible = a.votant group by a.saison""")
def j15_returned_names(spark, d):
    v = ballots(spark, d).filter("type = 'elimination' and votant_ok and cible_ok").select("saison", "numero", "votant", "cible").distinct()
    i = v.select("saison", "numero").distinct().withColumn("i", F.row_number().over(Window.partitionBy("saison").orderBy("numero")))
    w = v.join(i, ["saison", "numero"])
    back = w.select("saison", (F.col("i") - 1).alias("i"), F.col("votant").alias("cible"), F.col("cible").alias("votant"), F.lit(1).alias("hit"))
    return w.join(back, ["saison", "i", "votant", "cible"], "left").groupBy("saison").agg(F.count("*").alias("named"), F.count("hit").alias("returned"))


@query(f"""with {SESSIONS_SQL}, k as (select saison, numero, string_agg(distinct votant, '|' order by votant) as voters from ballots where votant_ok group by all),
u as (select saison, voters, count(*) as n, min(numero) as first, max(numero) as last from k group by all) select saison, first, last, n from u where n >= 2""")
def j16_same_voters(spark, d):
    k = ballots(spark, d).filter("votant_ok").groupBy("saison", "numero").agg(R.set_key(F.col("votant")).alias("voters"))
    return k.groupBy("saison", "voters").agg(F.count("*").alias("n"), F.min("numero").alias("first"), F.max("numero").alias("last")).filter("n >= 2").select("saison", "first", "last", "n")


_SIDE = "select saison, id, max_by(age, struct_pack(m := maj, l := ligne)) as age, max_by(jour_sortie, struct_pack(m := maj, l := ligne)) as jour from participations where retire_le is null and sources['age'] = '{}' group by saison, id"


@query(f"""with a as ({_SIDE.format("wikipedia-fr")}), b as ({_SIDE.format("fandom")})
select coalesce(a.saison, b.saison) as saison, coalesce(a.id, b.id) as id, coalesce(a.age, b.age) as age, case when a.age is not null then 'a' when b.age is not null then 'b' end as age_from,
 coalesce(a.age <> b.age, false) as age_differs, coalesce(b.jour, a.jour) as jour, case when b.jour is not null then 'b' when a.jour is not null then 'a' end as jour_from, coalesce(a.jour <> b.jour, false) as jour_differs
from a full outer join b on a.saison = b.saison and a.id = b.id""")
def j17_two_sources(spark, d):
    p = table(spark, d, "participations").filter("retire_le is null").select("saison", "id", "age", F.col("jour_sortie").alias("jour"), F.col("sources").getItem("age").alias("src"), "maj", "ligne")

    def side(s):
        o = F.struct("maj", "ligne")
        # max_by skips rows without a value, as the fields are merged one by one
        return p.filter(F.col("src") == s).groupBy("saison", "id").agg(F.max_by("age", F.when(F.col("age").isNotNull(), o)).alias("age"), F.max_by("jour", F.when(F.col("jour").isNotNull(), o)).alias("jour"))

    return R.merge_by_preference(side("wikipedia-fr"), side("fandom"), ["saison", "id"], {"age": "a", "jour": "b"})


@query(f"""with {PARTS_SQL}, k as (select p.saison, p.id, p.annee, p.age, q.age + p.annee - q.annee as alt, row_number() over (partition by p.saison, p.id order by abs(p.annee - q.annee), q.annee, q.saison) as r
  from parts p left join parts q on q.id = p.id and q.age is not null where p.annee is not null)
select saison, id, coalesce(age, alt) as filled from k where r = 1 and age is null and alt is not null""")
def j20_age_from_another_season(spark, d):
    p = parts(spark, d).filter("annee is not null").select("saison", "id", "annee", "age")
    f = R.nearest_backfill(p, "id", "annee", "age", True)
    return f.filter("age is null and filled is not null").select("saison", "id", "filled")


@query(f"""with {PARTS_SQL} select id, saison, row_number() over (partition by id order by annee, saison) > 1 as deja from parts where annee is not null""")
def j22_already_played(spark, d):
    w = Window.partitionBy("id").orderBy("annee", "saison")
    return parts(spark, d).filter("annee is not null").select("id", "saison", (F.row_number().over(w) > 1).alias("deja"))


@query(f"""with {SESSIONS_SQL}, f as (select saison, numero, cible as choix from ballots where type = 'jury' group by all), b as (select saison, numero, votant, cible from ballots where type = 'jury')
select b.saison, b.numero, b.votant, f.choix, b.cible = f.choix as pris from b join f on b.saison = f.saison and b.numero = f.numero""")
def j24_jury_choice_sets(spark, d):
    b = ballots(spark, d).filter("type = 'jury'").select("saison", "numero", "votant", "cible")
    f = b.select("saison", "numero", F.col("cible").alias("choix")).distinct()
    return b.join(f, ["saison", "numero"]).select("saison", "numero", "votant", "choix", (F.col("cible") == F.col("choix")).alias("pris"))


@query(f"""with {PARTS_SQL}, s as (select saison, count(*) as n, sum(jour) as j, count(jour) as m from reg group by saison), t as (select sum(j) as j, sum(m) as m from s)
select saison, round(cast(t.j - coalesce(s.j, 0) as double) / nullif(t.m - s.m, 0), 6) as sans from s, t""")
def j25_leave_one_season_out(spark, d):
    # the mean without a season is the total less the season's sums: no season is repeated for each other
    s = regular(parts(spark, d)).groupBy("saison").agg(F.sum("jour").alias("j"), F.count("jour").alias("m"))
    t = s.agg(F.sum("j").alias("tj"), F.sum("m").alias("tm"))
    return s.crossJoin(F.broadcast(t)).select("saison", R6((F.col("tj") - F.coalesce("j", F.lit(0))).cast("double") / F.nullif(F.col("tm") - F.col("m"), F.lit(0)), "sans"))  # one row


_ACC = f"""with {SESSIONS_SQL}, {PRESENCE_SQL}"""


@query(f"""{_ACC}, x as (select saison, id, seg, numero, votes, sum(votes) over (partition by saison, id, seg order by numero rows between unbounded preceding and 1 preceding) as avant from chain where complet)
select saison, id, numero, cast(coalesce(avant, 0) as bigint) as avant from x""")
def w06_votes_so_far(spark, d):
    w = Window.partitionBy("saison", "id", "seg").orderBy("numero").rowsBetween(Window.unboundedPreceding, -1)
    return _chain(spark, d).filter("complete").select("saison", "id", "numero", F.coalesce(F.sum("votes").over(w), F.lit(0)).cast("bigint").alias("avant"))


@query(f"""with {_AL}, f as (select saison, a, b, min(numero) filter (where same) as m from pr group by all), s as (select distinct saison, numero from pr)
select s.saison, s.numero, count(f.a) as allied from s left join f on f.saison = s.saison and f.m < s.numero group by s.saison, s.numero""")
def w07_alliances_before(spark, d):
    p = _alignment(spark, d)
    first = p.filter("same").groupBy("saison", "a", "b").agg(F.min("numero").alias("numero")).groupBy("saison", "numero").agg(F.count("*").alias("fresh"))
    s = p.select("saison", "numero").distinct().join(first, ["saison", "numero"], "left")
    w = Window.partitionBy("saison").orderBy("numero").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("saison", "numero", F.coalesce(F.sum("fresh").over(w), F.lit(0)).alias("allied"))


@query(f"""{_ACC} select saison, id, numero, round(100.0 * (rank() over w - 1 + (count(*) over p - 1) / cast(2 as double)) / nullif(count(*) over s - 1, 0), 6) as centile from chain where complet
window w as (partition by saison, numero order by votes), p as (partition by saison, numero, votes), s as (partition by saison, numero)""")
def w04_midrank_percentile(spark, d):
    w, p, s = Window.partitionBy("saison", "numero").orderBy("votes"), Window.partitionBy("saison", "numero", "votes"), Window.partitionBy("saison", "numero")
    below = F.rank().over(w) - 1 + (F.count("*").over(p) - 1) / F.lit(2.0)
    return _chain(spark, d).filter("complete").select("saison", "id", "numero", R6(100.0 * below / F.nullif(F.count("*").over(s) - 1, F.lit(0)), "centile"))


QUERIES = Q
