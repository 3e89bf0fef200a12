"""Queries on scans, selections, joins, ordered rows, sorts and sets, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, parts, regular, sessions
from ..session import table
from ..sources.files import optional_table
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


# ---- scans -------------------------------------------------------------------------------------------


@query(f"{P} select saison, id, annee, numero, duree_jours, speciale, annulee, en_cours, round(100.0 * jour / duree_jours, 6) as survie from parts")
def s02_loaded_participations(spark, d):
    """Participations with the columns of their season and the share of it that they lasted."""
    return parts(spark, d).select("saison", "id", "annee", "numero", "duree_jours", "speciale", "annulee", "en_cours", R6(100.0 * F.col("jour") / F.col("duree_jours"), "survie"))


@query("select id as saison, 0 as epreuves from saisons")
def s03_optional_table(spark, d):
    """Seasons beside a table that may not be there: a missing one counts as empty."""
    e = optional_table(spark, f"{d}/epreuves.parquet", "saison string, episode int").groupBy("saison").agg(F.count("*").alias("k"))
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"))
    return s.join(e, "saison", "left").select("saison", F.coalesce("k", F.lit(0)).cast("int").alias("epreuves"))


@query("""select saison, doc_id, source from (select saison, doc_id, source, row_number() over (partition by saison order by strlen(text) desc, doc_id) as r from documents where saison is not null and text is not null and source is not null) where r = 1""")
def s04_richest_page(spark, d):
    """Of the pages of a season the richest, by bytes, whatever its source."""
    t = table(spark, d, "documents").filter("saison is not null and text is not null and source is not null")
    return t.groupBy("saison").agg(F.max_by(F.struct("doc_id", "source"), F.struct(F.octet_length("text").alias("n"), (-F.col("doc_id")).alias("k"))).alias("b")).select("saison", "b.*")


@query(f"""{P} select coalesce(couleur, '_TOTAL') as couleur, n, gagnants from (select couleur, count(*) as n, count(*) filter (where sort = 'vainqueur') as gagnants from parts where couleur is not null group by grouping sets ((couleur), ()))""")
def s10_extract_with_totals(spark, d):
    """An extract with a marker row of totals, by grouping sets."""
    p = parts(spark, d).filter("couleur is not null")
    g = p.groupingSets([["couleur"], []], "couleur").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("sort") == "vainqueur", F.lit(False))).alias("gagnants"))
    return g.select(F.coalesce("couleur", F.lit("_TOTAL")).alias("couleur"), "n", "gagnants")


@query("""select doc_id, substr(sha256(text), 1, 12) as empreinte from documents where text is not null""")
def s13_fingerprints(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("empreinte"))


@query("""select event_type, count(*) as n, max(cast(json_extract_string(props, '$.k') as bigint)) as most from events group by event_type""")
def s14_json_categories(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("p.k").alias("most"))


# ---- selections --------------------------------------------------------------------------------------


@query(f"""{P} select saison, count(*) as tous, count(*) filter (where not annulee and not en_cours) as finis, count(*) filter (where not annulee and not en_cours and not speciale) as reguliers from parts group by saison""")
def pr01_perimeter(spark, d):
    """Participations of a season in the perimeter with and without the specials."""
    p = parts(spark, d)
    over = ~F.col("annulee") & ~F.col("en_cours")
    return p.groupBy("saison").agg(F.count("*").alias("tous"), F.count_if(over).alias("finis"), F.count_if(over & ~F.col("speciale")).alias("reguliers"))


@query("""select id as saison, annee from saisons where not coalesce(speciale, false) and not coalesce(annulee, false) and not coalesce(en_cours, false)""")
def pr02_classic_seasons(spark, d):
    s = table(spark, d, "saisons").withColumnsRenamed({"id": "saison"}).na.fill(False, ["speciale", "annulee", "en_cours"])
    return regular(s).select("saison", "annee")


@query(f"""{S} select saison, numero, elimine from sess where type = 'elimination'""")
def pr03_eliminations(spark, d):
    return sessions(spark, d).filter("type = 'elimination'").select("saison", "numero", "elimine")


@query(f"""{S} select saison, numero, votant, cible, pos from ballots where type = 'jury'""")
def pr04_jury_votes(spark, d):
    return ballots(spark, d).filter("type = 'jury'").select("saison", "numero", "votant", "cible", "pos")


@query(f"""{S} select saison, numero, len(votes) as lus from sess where complet and votes is not null""")
def pr05_sessions_read_whole(spark, d):
    return sessions(spark, d).filter("complet and votes is not null").select("saison", "numero", F.size("votes").cast("bigint").alias("lus"))


@query(f"""{S} select saison, numero, pos from ballots where votant_ok and cible_ok""")
def pr06_attached_ballots(spark, d):
    """Ballots whose voter and target are both known participants."""
    return ballots(spark, d).filter("votant_ok and cible_ok").select("saison", "numero", "pos")


@query("""select champ, n from (select count(*) filter (where age is not null and age <> 0) as age, count(*) filter (where nom <> '') as nom, count(*) filter (where votes_recus is not null and votes_recus <> 0) as votes_recus, count(*) filter (where len(parcours) > 0) as parcours from participations) unpivot (n for champ in (age, nom, votes_recus, parcours))""")
def pr07_truthy_values(spark, d):
    """Values that hold something: neither null nor zero, empty text or an empty list."""
    t = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    one = table(spark, d, "participations").agg(t(F.col("age") != 0).alias("age"), t(F.col("nom") != "").alias("nom"), t(F.col("votes_recus") != 0).alias("votes_recus"), t(F.size("parcours") > 0).alias("parcours"))
    return one.unpivot([], one.columns, "champ", "n")


@query("""select ligne, try_cast(episode as integer) as ep from conseils where try_cast(episode as integer) is not null""")
def pr08_numeric_episodes(spark, d):
    """Episodes that are numbers; the others are skipped."""
    return table(spark, d, "conseils").select("ligne", F.col("episode").try_cast("int").alias("ep")).filter("ep is not null")


@query(f"""{S} select saison, votant, count(*) as bulletins from ballots where votant_ok and type = 'elimination' group by all having count(*) >= 8""")
def pr09_enough_support(spark, d):
    return ballots(spark, d).filter("votant_ok and type = 'elimination'").groupBy("saison", "votant").agg(F.count("*").alias("bulletins")).filter("bulletins >= 8")


@query(f"""{S} select saison, round(100.0 * count(*) filter (where complet) / count(*), 6) as part from sess group by saison having count(*) filter (where complet) >= 0.8 * count(*)""")
def pr10_covered_seasons(spark, d):
    g = sessions(spark, d).groupBy("saison").agg(F.count_if("complet").alias("k"), F.count("*").alias("n"))
    return g.filter("k >= 0.8 * n").select("saison", R6(100.0 * F.col("k") / F.col("n"), "part"))


@query(f"""{S} select saison, numero, count(distinct cible) = 1 as avec_elimine, count(distinct cible) filter (where votant is distinct from elimine) = 1 as sans_elimine from ballots where type = 'elimination' and complet group by all""")
def pr11_unanimous(spark, d):
    """Sessions of one target, with the ballot of whoever left and without it."""
    b = ballots(spark, d).filter("type = 'elimination' and complet")
    other = F.when(~F.col("votant").eqNullSafe(F.col("elimine")), F.col("cible"))
    return b.groupBy("saison", "numero").agg((F.count_distinct("cible") == 1).alias("avec_elimine"), (F.count_distinct(other) == 1).alias("sans_elimine"))


@query(f"""{S} select saison, numero, votes_contre - (votes_exprimes - votes_contre) as ecart from sess where type = 'elimination' and votes_exprimes > 0 and abs(votes_contre - (votes_exprimes - votes_contre)) <= 1""")
def pr12_close_votes(spark, d):
    x = F.col("votes_contre") - (F.col("votes_exprimes") - F.col("votes_contre"))
    return sessions(spark, d).filter("type = 'elimination' and votes_exprimes > 0").select("saison", "numero", x.alias("ecart")).filter("abs(ecart) <= 1")


@query(f"""{P} select id, saison, genre, age, sort from parts""")
def pr13_kept_columns(spark, d):
    """A publication keeps the columns asked for, in their order, of those that are there."""
    p = parts(spark, d)
    return p.select(*[c for c in ["id", "saison", "surnom", "genre", "age", "sort"] if c in p.columns])


@query(f"""{P} select saison, id, round(least(100, 100.0 * jour / duree_jours), 6) as survie from reg where jour is not null""")
def pr14_survival_share(spark, d):
    p = regular(parts(spark, d)).filter("jour is not null")
    return p.select("saison", "id", R6(F.least(F.lit(100.0), 100.0 * F.col("jour") / F.col("duree_jours")), "survie"))


# ---- joins -------------------------------------------------------------------------------------------


@query("""select p.ligne, s.titre, s.annee, s.pays from participations p left join saisons s on s.id = p.saison""")
def j01_season_of_each_row(spark, d):
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"), "titre", "annee", "pays")
    return table(spark, d, "participations").select("ligne", "saison").join(s, "saison", "left").drop("saison")


@query(f"""{P} select s.id as saison, p.id, p.age, p.genre from (select id, unnest(vainqueurs) as v from saisons) s join parts p on p.saison = s.id and p.nom = s.v""")
def j03_winners_found(spark, d):
    """Declared winners with their participation; names that dangle are dropped."""
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.explode("vainqueurs").alias("nom"))
    return s.join(parts(spark, d).select("saison", "nom", "id", "age", "genre"), ["saison", "nom"]).drop("nom")


@query("""with p as (select distinct saison, nom, age, jour_sortie as jour, id from participations where nom is not null and age is not null),
 n as (select saison, id, split_part(nom, ' ', 1) as mot, min(age) as age, min(jour) as jour from p group by all),
 x as (select a.saison, a.mot, a.id as gauche, b.id as droite, (abs(a.age - b.age) <= 1)::int * 2 + (a.jour = b.jour)::int as note from n a join n b on a.saison = b.saison and a.mot = b.mot and a.id <> b.id ),
 r as (select *, rank() over (partition by saison, gauche order by note desc) as r from x where note > 0),
 k as (select *, count(*) over (partition by saison, gauche) as k from r where r = 1) select saison, gauche, droite, note from k where k = 1""")
def j18_homonyms_scored(spark, d):
    """Homonyms of a season matched by age and day of exit; a tie at the top is no match. They meet where they agree, not in all pairs."""
    p = table(spark, d, "participations").filter("nom is not null and age is not null")
    n = p.groupBy("saison", "id", F.split_part("nom", F.lit(" "), F.lit(1)).alias("mot")).agg(F.min("age").alias("age"), F.min("jour_sortie").alias("jour"))
    key = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    day = key("j", F.col("jour"))
    a = n.select("saison", "mot", F.col("id").alias("gauche"), F.col("age").alias("age1"), F.col("jour").alias("jour1"), F.explode(F.array(*[key("a", F.col("age") + k) for k in (-1, 0, 1)], day)).alias("k")).filter("k is not null")
    b = n.select("saison", "mot", F.col("id").alias("droite"), F.col("age").alias("age2"), F.col("jour").alias("jour2"), F.explode(F.array(key("a", F.col("age")), day)).alias("k")).filter("k is not null")
    note = (F.abs(F.col("age1") - F.col("age2")) <= 1).cast("int") * 2 + (F.col("jour1") == F.col("jour2")).cast("int")
    x = a.join(b, ["saison", "mot", "k"]).filter("gauche <> droite").select("saison", "gauche", "droite", note.alias("note")).filter("note > 0").distinct()
    w = Window.partitionBy("saison", "gauche")
    x = x.withColumn("r", F.rank().over(w.orderBy(F.desc("note")))).filter("r = 1").withColumn("k", F.count("*").over(w))
    return x.filter("k = 1").select("saison", "gauche", "droite", "note")


@query("""with c as (select saison, numero, ligne, episode, votes, row_number() over (partition by saison, numero order by maj desc, ligne desc) as r from conseils where episode is not null),
 a as (select *, count(*) over (partition by saison, episode) as k from c where r = 1), b as (select *, count(*) over (partition by saison, episode) as k from c where r = 2),
 bv as (select saison, episode, unnest(votes) as v from b where k = 1), av as (select saison, episode, unnest(votes) as v from a where k = 1)
 select a.saison, a.episode, (select count(distinct v.votant) from (select saison, episode, v from bv) q(saison, episode, v) where q.saison = a.saison and q.episode = a.episode and v.votant is not null and v.votant not in (select w.v.votant from av w where w.saison = a.saison and w.episode = a.episode and w.v.votant is not null)) as ajoutes
 from a join b using (saison, episode) where a.k = 1 and b.k = 1""")
def j19_ballots_completed(spark, d):
    """How many ballots an earlier extraction adds to the latest, where both have one session that evening."""
    w = Window.partitionBy("saison", "numero").orderBy(F.desc("maj"), F.desc("ligne"))
    c = table(spark, d, "conseils").filter("episode is not null").select("saison", "numero", "episode", "votes", F.row_number().over(w).alias("r"))
    k = F.count("*").over(Window.partitionBy("saison", "episode", "r"))
    c = c.filter("r <= 2").withColumn("k", k).filter("k = 1")
    v = c.select("saison", "episode", "r", F.explode("votes").alias("v")).select("saison", "episode", "r", F.col("v.votant").alias("votant"), F.col("v.cible").alias("cible")).filter("votant is not null")
    both = c.filter("r = 1").select("saison", "episode").join(c.filter("r = 2").select("saison", "episode"), ["saison", "episode"])
    new = v.filter("r = 2").join(v.filter("r = 1").select("saison", "episode", "votant"), ["saison", "episode", "votant"], "left_anti").groupBy("saison", "episode").agg(F.count_distinct("votant").alias("k"))
    return both.join(new, ["saison", "episode"], "left").select("saison", "episode", F.coalesce("k", F.lit(0)).alias("ajoutes"))


@query(f"""{P}, n as (select genre, prenom, count(*) as n from personnes where genre is not null and prenom is not null group by all), t as (select genre, sum(n) as t from n group by genre), p as (select genre, count(*) as k from parts where genre is not null group by genre)
 select n.prenom, round(sum(n.n * p.k / t.t), 6) as attendu from n join t using (genre) join p using (genre) group by n.prenom""")
def j21_expected_first_names(spark, d):
    """Expected bearers of a first name: its share of each gender's population times that gender's participants."""
    n = table(spark, d, "personnes").filter("genre is not null and prenom is not null").groupBy("genre", "prenom").agg(F.count("*").alias("n"))
    n = n.withColumn("t", F.sum("n").over(Window.partitionBy("genre")))
    p = parts(spark, d).filter("genre is not null").groupBy("genre").agg(F.count("*").alias("k"))
    return n.join(p, "genre").groupBy("prenom").agg(R6(F.sum(F.col("n") * F.col("k") / F.col("t")), "attendu"))


@query(f"""{PS}, a as (select id as saison, vainqueurs[1] as v from saisons where len(vainqueurs) > 0), b as (select saison, min(id) as v from parts where sort = 'vainqueur' group by saison having count(*) = 1),
 j as (select saison, arg_max(cible, (n, cible)) as v from (select saison, cible, count(*) as n from ballots where type = 'jury' and cible is not null group by all) group by saison)
 select s.id as saison, coalesce(a.v, b.v, j.v) as vainqueur, case when a.v is not null then 'declare' when b.v is not null then 'sort' when j.v is not null then 'jury' end as source from saisons s left join a on a.saison = s.id left join b on b.saison = s.id left join j on j.saison = s.id""")
def j23_winner_from_three_sources(spark, d):
    """The winner declared, else the only one with that outcome, else the jury's choice, with the source that told."""
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.when(F.size("vainqueurs") > 0, F.element_at("vainqueurs", 1)).alias("a"))
    b = parts(spark, d).filter("sort = 'vainqueur'").groupBy("saison").agg(F.count("*").alias("k"), F.min("id").alias("b")).filter("k = 1").drop("k")
    n = ballots(spark, d).filter("type = 'jury' and cible is not null").groupBy("saison", "cible").agg(F.count("*").alias("n"))
    j = n.groupBy("saison").agg(F.max_by("cible", F.struct("n", "cible")).alias("j"))
    x = s.join(b, "saison", "left").join(j, "saison", "left")
    return x.select("saison", F.coalesce("a", "b", "j").alias("vainqueur"), F.when(F.col("a").isNotNull(), "declare").when(F.col("b").isNotNull(), "sort").when(F.col("j").isNotNull(), "jury").alias("source"))


# ---- ordered rows ------------------------------------------------------------------------------------


@query(f"""{P} select saison, id, row_number() over (partition by saison order by coalesce(votes_recus, -1) desc, id) as rang from parts""")
def w01_rank_by_votes(spark, d):
    w = Window.partitionBy("saison").orderBy(F.coalesce("votes_recus", F.lit(-1)).desc(), "id")
    return parts(spark, d).select("saison", "id", F.row_number().over(w).alias("rang"))


@query("""select ligne, row_number() over (partition by saison order by age, ligne) as rang from participations where age is not null""")
def w03_ordinal_ranks(spark, d):
    """Ranks of ages in the order of the rows where they tie."""
    w = Window.partitionBy("saison").orderBy("age", "ligne")
    return table(spark, d, "participations").filter("age is not null").select("ligne", F.row_number().over(w).alias("rang"))


@query("""with w as (select id, numero, pays, isodow(diffusion.debut) as jour, lag(isodow(diffusion.debut)) over (partition by pays order by numero) as avant from saisons where diffusion.debut is not null and pays is not null)
 select pays, arg_max(id, numero) as saison, arg_max(jour, numero) as jour from w where avant is not null and avant <> jour group by pays""")
def w10_last_change_of_weekday(spark, d):
    """The last season of a country that began on another weekday than the one before."""
    w = Window.partitionBy("pays").orderBy("numero")
    s = table(spark, d, "saisons").filter("diffusion.debut is not null and pays is not null").select("id", "numero", "pays", (F.weekday("diffusion.debut") + 1).cast("bigint").alias("jour"))
    x = s.withColumn("avant", F.lag("jour").over(w)).filter("avant <> jour")
    return x.groupBy("pays").agg(F.max_by("id", "numero").alias("saison"), F.max_by("jour", "numero").alias("jour"))


@query(f"""{P}, y as (select annee, avg(age) as m from reg where annee is not null and age is not null group by annee) select annee, round(100 * m / first_value(m) over (order by annee), 6) as indice from y""")
def w14_index_of_ages(spark, d):
    y = regular(parts(spark, d)).filter("annee is not null and age is not null").groupBy("annee").agg(F.avg("age").alias("m"))
    return y.select("annee", R6(100 * F.col("m") / F.first("m").over(Window.orderBy("annee")), "indice"))  # a row a year


@query(f"""{P}, e as (select id, count(*) as n, sum(vi) as vi from parts group by id), c as (select id, count(*) as n, sum(vi) as vi from reg group by id)
 select id, rank() over (order by coalesce(c.vi, 0) desc) as classique, rank() over (order by coalesce(e.vi, 0) desc) as general from e left join c using (id) where e.vi > 0""")
def w16_ranks_recomputed(spark, d):
    """Ranks by contests won over all seasons and over the regular ones alone: of a value, one more than those above it."""
    both = parts(spark, d).groupBy("id").agg(F.sum("vi").alias("g"), F.coalesce(F.sum(F.when(~F.col("speciale") & ~F.col("annulee") & ~F.col("en_cours"), F.col("vi"))), F.lit(0)).alias("c")).filter("g > 0")

    def ranked(df: DataFrame, v: str, name: str) -> DataFrame:  # over the different values, which are few, not over all people
        n = df.groupBy(v).agg(F.count("*").alias("n"))
        n = n.withColumn(name, F.coalesce(F.sum("n").over(Window.orderBy(F.desc(v)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1)
        return df.join(n.select(v, name), v)

    return ranked(ranked(both, "c", "classique"), "g", "general").select("id", "classique", "general")


@query(f"""{P}, x as (select saison, id, classement, jour, count(*) over (partition by saison, jour) as k, count(*) over (partition by saison) as n, count(*) filter (where jour > p.jour0) over () as z from (select *, jour as jour0 from reg) p where jour is not null),
 r as (select saison, id, classement, jour, k, n, rank() over (partition by saison order by jour desc) as r from x)
 select saison, id, case when classement is not null then classement when k = 1 then r end as rang from r""")
def w17_rank_filled_by_exit(spark, d):
    """A missing rank by the order of exits where nobody else left that day."""
    w = Window.partitionBy("saison")
    x = regular(parts(spark, d)).filter("jour is not null").withColumn("k", F.count("*").over(Window.partitionBy("saison", "jour"))).withColumn("r", F.rank().over(w.orderBy(F.desc("jour"))))
    return x.select("saison", "id", F.coalesce("classement", F.when(F.col("k") == 1, F.col("r"))).alias("rang"))


@query("""with x as (select saison, numero, ligne, episode, len(votes) as n, lag(episode) over (partition by saison order by numero, ligne) as avant from conseils where episode is not null),
 i as (select *, sum(case when avant is not distinct from episode then 0 else 1 end) over (partition by saison order by numero, ligne) as ilot from x)
 select saison, ilot, arg_max(ligne, (coalesce(n, -1), -ligne)) as ligne, count(*) as colonnes from i group by saison, ilot""")
def w19_consecutive_columns_folded(spark, d):
    """Neighbouring sessions of one episode folded into the one of most ballots."""
    w = Window.partitionBy("saison").orderBy("numero", "ligne")
    x = table(spark, d, "conseils").filter("episode is not null").select("saison", "numero", "ligne", "episode", F.when(F.col("votes").isNotNull(), F.size("votes")).alias("n"))
    x = x.withColumn("new", (~F.lag("episode").over(w).eqNullSafe(F.col("episode"))).cast("int"))
    x = x.withColumn("ilot", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("saison", "ilot").agg(F.max_by("ligne", F.struct(F.coalesce("n", F.lit(-1)).alias("n"), (-F.col("ligne")).alias("l"))).alias("ligne"), F.count("*").alias("colonnes"))


# ---- sorts, limits, sets -----------------------------------------------------------------------------


@query(f"""{P} select couleur, count(*) as n from parts where couleur is not null group by couleur order by n desc, couleur""")
def o01_mixed_order(spark, d):
    return parts(spark, d).filter("couleur is not null").groupBy("couleur").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "couleur")


@query(f"""{P} select id, sum(coalesce(votes_recus, 0)) as voix from parts group by id order by voix desc, id limit 12""")
def o02_top_twelve(spark, d):
    g = parts(spark, d).groupBy("id").agg(F.sum(F.coalesce("votes_recus", F.lit(0))).alias("voix"))
    return g.orderBy(F.desc("voix"), "id").limit(12)


@query("""select id, rang from (select id, row_number() over (order by strip_accents(lower(nom)), nom, id) as rang from personnes where prenom = 'Élodie') """)
def o05_accents_in_order(spark, d):
    """The bearers of one first name in an order that puts accents beside their letters."""
    from ..functions.text import fold

    p = table(spark, d, "personnes").filter(F.col("prenom") == "Élodie")
    return p.select("id", F.row_number().over(Window.orderBy(fold(F.col("nom")), "nom", "id")).alias("rang"))  # one first name


@query(f"""{P} select couleur, count(*) as taille, min_by(id, (jour, id)) as premier, max_by(id, (jour, id)) as dernier from reg where couleur is not null and jour is not null group by couleur""")
def o07_first_last_size(spark, d):
    o = F.struct("jour", "id")
    return regular(parts(spark, d)).filter("couleur is not null and jour is not null").groupBy("couleur").agg(F.count("*").alias("taille"), F.min_by("id", o).alias("premier"), F.max_by("id", o).alias("dernier"))


@query(f"""{S}, n as (select saison, numero, row_number() over (partition by saison order by numero) as i from sess), v as (select distinct b.saison, n.i, b.votant from ballots b join n using (saison, numero) where b.votant_ok)
 select a.saison, a.i, count(*) as communs from v a join v b on b.saison = a.saison and b.votant = a.votant and b.i = a.i + 1 group by a.saison, a.i""")
def u02_voters_of_two_sessions(spark, d):
    """Voters that a session has in common with the next one."""
    n = sessions(spark, d).select("saison", "numero", F.row_number().over(Window.partitionBy("saison").orderBy("numero")).alias("i"))
    v = ballots(spark, d).filter("votant_ok").select("saison", "numero", "votant").distinct().join(n, ["saison", "numero"]).select("saison", "i", "votant")
    nxt = v.select("saison", (F.col("i") - 1).alias("i"), "votant")
    return v.join(nxt, ["saison", "i", "votant"], "left_semi").groupBy("saison", "i").agg(F.count("*").alias("communs"))


@query("""select 'participations' as origine, saison, nom as texte, age from participations union all select 'fiches' as origine, edition, libelle, age from fiches_wiki""")
def u05_sources_in_one(spark, d):
    a = table(spark, d, "participations").select(F.lit("participations").alias("origine"), "saison", F.col("nom").alias("texte"), "age")
    b = table(spark, d, "fiches_wiki").select(F.lit("fiches").alias("origine"), F.col("edition").alias("saison"), F.col("libelle").alias("texte"), "age")
    return A.union_all([a, b])


@query(f"""{P}, t as (select id as saison, list_transform(tribus, lambda x: x.nom) as noms from saisons), g as (select saison, list_sort(list_distinct(list(tribu))) as vues from parts where tribu is not null group by saison)
 select g.saison, len(list_filter(g.vues, lambda x: not list_contains(t.noms, x))) = 0 as inclus from g join t using (saison) where t.noms is not null""")
def u06_tribes_declared(spark, d):
    """Whether every tribe met in a season is one of those declared."""
    t = table(spark, d, "saisons").filter("tribus is not null").select(F.col("id").alias("saison"), F.col("tribus.nom").alias("noms"))
    g = parts(spark, d).filter("tribu is not null").groupBy("saison").agg(F.collect_set("tribu").alias("vues"))  # the tribes of a season
    return g.join(t, "saison").select("saison", (F.size(F.array_except("vues", "noms")) == 0).alias("inclus"))


QUERIES = Q
