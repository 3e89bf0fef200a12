"""Wide measures of sessions, persons and seasons, sources read and written, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, parts, regular, sessions
from ..session import checkpoint_folder, spread, table
from ..sources import files
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


def _folder(spark, name: str) -> str:
    """A new folder in the shared one, for a file that a query writes and reads again."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks -------------------------------------------------------------------------------


@query("""select id, numero, titre, annee from saisons where numero is not null and titre is not null""")
def s01_records_of_yaml(spark, d):
    """Seasons written as YAML records and read back by their schema."""
    path = _folder(spark, "yaml")
    quoted = F.concat(F.lit('"'), F.regexp_replace("titre", r'(["\\])', r"\\$1"), F.lit('"'))
    line = F.concat(F.lit("- id: "), "id", F.lit("\n  numero: "), F.col("numero").cast("string"), F.lit("\n  titre: "), quoted, F.coalesce(F.concat(F.lit("\n  annee: "), F.col("annee").cast("string")), F.lit("")))
    table(spark, d, "saisons").filter("numero is not null and titre is not null").select(line.alias("value")).write.text(path)
    return files.yaml_records(spark, path, "id string, numero int, titre string, annee int")


@query("""with a as (select coalesce(genre, '?') as genre, count(*) as total, count(*) filter (where prenom in ('Julie', 'Thomas')) as mine from personnes where prenom is not null group by 1) select genre, cast(total as bigint) as total, case when mine > 0 then cast(mine as bigint) end as miens from a""")
def s07_separated_with_totals(spark, d):
    """A ';' file of counts by gender and first name: totals over all rows beside those of the names wanted."""
    path = _folder(spark, "csv")
    g = table(spark, d, "personnes").filter("prenom is not null").groupBy(F.coalesce("genre", F.lit("?")).alias("genre"), "prenom").agg(F.count("*").alias("n"))
    g.write.csv(path, sep=";", header=True)
    wanted = spark.createDataFrame([("Julie",), ("Thomas",)], "prenom string")
    t = files.separated_with_totals(spark, path, ["genre"], "n", wanted, "prenom")
    return t.select("genre", "total", F.col("mine").alias("miens"))


@query(f"""{P}, g as (select couleur, count(*) as n, round(avg(age), 1) as age from parts where couleur is not null group by couleur) select couleur, cast(n as varchar) as n, case when age = floor(age) then cast(cast(age as bigint) as varchar) else replace(cast(age as varchar), '.', ',') end as age from g""")
def s09_display_file(spark, d):
    """A table written for display, decimals with a comma, and read back as text."""
    path = _folder(spark, "display")
    files.write_display(parts(spark, d).filter("couleur is not null").groupBy("couleur").agg(F.count("*").alias("n"), F.avg("age").alias("age")), path)
    return spark.read.csv(path, sep=";", header=True)


@query("""select format('{}.json', saison) as fichier, n from (select saison, count(*) as n from participations group by saison)""")
def s11_a_file_a_card(spark, d):
    """One file of JSON cards a season, read back with the season that its name tells."""
    path, n = _folder(spark, "cards"), 4 * spread(spark, 0, 1)
    files.write_cards(table(spark, d, "participations").select("saison", "id", "nom", "age"), "saison", path, n)
    g = files.read_cards(spark, "saison", path, "id string, nom string, age int", n).groupBy("saison").agg(F.count("*").alias("n"))
    return g.select(F.concat("saison", F.lit(".json")).alias("fichier"), "n")


# ---- sessions ----------------------------------------------------------------------------------------


@query(f"""{PS}, b as (select b.*, v.genre as gv, c.genre as gc from ballots b left join parts v on v.saison = b.saison and v.id = b.votant left join parts c on c.saison = b.saison and c.id = b.cible where b.type = 'elimination'),
 a as (select saison, count(*) as bulletins, count(distinct votant) as votants, count(distinct cible) as cibles, count(*) filter (where cible = elimine) as contre_sortant, count(*) filter (where votant = cible) as contre_soi, count(*) filter (where gv = 'f' and gc = 'f') as ff, count(*) filter (where gv = 'f' and gc = 'h') as fh, count(*) filter (where gv = 'h' and gc = 'f') as hf, count(*) filter (where gv = 'h' and gc = 'h') as hh from b group by saison),
 s as (select saison, count(*) as conseils, count(*) filter (where complet) as complets, count(*) filter (where elimine is null) as sans_elimine, count(*) filter (where annulation is not null) as annules, sum(votes_contre) as voix_contre, sum(votes_exprimes) as voix, max(votes_contre) as plus_de_voix, round(avg(cast(votes_contre as double)), 6) as voix_moyennes from sess where type = 'elimination' group by saison) select * from s left join a using (saison)""")
def a11_council_measures(spark, d):
    """Counts of a season's sessions and ballots in two aggregations: totals, targets, genders of voter and target."""
    g = parts(spark, d).select("saison", "id", "genre")
    b = ballots(spark, d).filter("type = 'elimination'").join(g.withColumnsRenamed({"id": "votant", "genre": "gv"}), ["saison", "votant"], "left").join(g.withColumnsRenamed({"id": "cible", "genre": "gc"}), ["saison", "cible"], "left")
    two = lambda v, c: F.count_if(YES((F.col("gv") == v) & (F.col("gc") == c))).alias(v + c)
    a = b.groupBy("saison").agg(F.count("*").alias("bulletins"), F.count_distinct("votant").alias("votants"), F.count_distinct("cible").alias("cibles"), F.count_if(YES(F.col("cible") == F.col("elimine"))).alias("contre_sortant"), F.count_if(YES(F.col("votant") == F.col("cible"))).alias("contre_soi"), *[two(v, c) for v in "fh" for c in "fh"])
    s = sessions(spark, d).filter("type = 'elimination'").groupBy("saison").agg(
        F.count("*").alias("conseils"), F.count_if("complet").alias("complets"), F.count_if(F.col("elimine").isNull()).alias("sans_elimine"), F.count_if(F.col("annulation").isNotNull()).alias("annules"), F.sum("votes_contre").alias("voix_contre"),
        F.sum("votes_exprimes").alias("voix"), F.max("votes_contre").alias("plus_de_voix"), R6(F.avg(F.col("votes_contre").cast("double")), "voix_moyennes"),
    )
    return s.join(a, "saison", "left")


_TOP = "t0 as (select saison, numero, cible, elimine, count(*) as n from ballots where type = 'elimination' and complet group by all), t as (select *, rank() over (partition by saison, numero order by n desc) as r from t0), m as (select saison, numero, count(*) filter (where r = 1) as tete, max(case when r = 1 and cible = elimine then 1 else 0 end) as juste from t group by all)"


@query(f"""{S}, {_TOP}, o as (select s.saison, s.numero, lag(s.numero) over (partition by s.saison, s.episode order by s.numero) as avant from sess s where type = 'elimination' and complet) select m.saison, m.numero, case when m.tete > 1 and m.juste = 1 then 'egalite_tranchee' when m.tete > 1 then 'egalite' when m.juste = 1 then 'ordinaire' else 'renversement' end as issue, o.avant is not null as second_du_soir from m join o using (saison, numero)""")
def a38_issue_of_each_session(spark, d):
    """How each session ended: the most named left, a tie was broken or not, somebody else left; and whether it was the evening's second."""
    t = ballots(spark, d).filter("type = 'elimination' and complet").groupBy("saison", "numero", "cible", "elimine").agg(F.count("*").alias("n"))
    t = t.withColumn("r", F.rank().over(Window.partitionBy("saison", "numero").orderBy(F.desc("n"))))
    m = t.groupBy("saison", "numero").agg(F.count_if(F.col("r") == 1).alias("tete"), F.max(YES((F.col("r") == 1) & (F.col("cible") == F.col("elimine"))).cast("int")).alias("juste"))
    o = sessions(spark, d).filter("type = 'elimination' and complet").select("saison", "numero", F.lag("numero").over(Window.partitionBy("saison", "episode").orderBy("numero")).alias("avant"))
    issue = F.when((F.col("tete") > 1) & (F.col("juste") == 1), "egalite_tranchee").when(F.col("tete") > 1, "egalite").when(F.col("juste") == 1, "ordinaire").otherwise("renversement")
    return m.join(o, ["saison", "numero"]).select("saison", "numero", issue.alias("issue"), F.col("avant").isNotNull().alias("second_du_soir"))


@query(f"""{PS}, v as (select saison, numero, votant as id, max(case when cible = elimine then 1 else 0 end) as juste from ballots where type = 'elimination' and complet and votant_ok group by all), r as (select saison, numero, cible as id, count(*) as n from ballots where type = 'elimination' and complet and cible_ok group by all),
 x as (select v.saison, v.id, count(*) as conseils, sum(v.juste) as justes, count(r.n) as menaces, sum(coalesce(r.n, 0)) as voix, count(*) filter (where r.n is not null and not exists (select 1 from sess s where s.saison = v.saison and s.numero = v.numero and s.elimine = v.id)) as echappees from v left join r using (saison, numero, id) group by all)
 select p.saison, p.id, coalesce(conseils, 0) as conseils, case when conseils >= 4 then round(100.0 * justes / conseils, 6) end as precision_pct, case when conseils >= 4 then round(100.0 * menaces / conseils, 6) end as menace, case when menaces > 0 then round(100.0 * echappees / menaces, 6) end as evasion, round(voix / cast(conseils as double), 6) as voix_par_conseil from parts p left join x using (saison, id)""")
def a25_survival_threat_evasion(spark, d):
    """Of each person: sessions attended, right ballots, sessions in which they were named, those that they got away from."""
    b = ballots(spark, d).filter("type = 'elimination' and complet")
    v = b.filter("votant_ok").groupBy("saison", "numero", F.col("votant").alias("id")).agg(F.max(YES(F.col("cible") == F.col("elimine")).cast("int")).alias("juste"), F.first("elimine").alias("e"))
    r = b.filter("cible_ok").groupBy("saison", "numero", F.col("cible").alias("id")).agg(F.count("*").alias("n"))
    x = v.join(r, ["saison", "numero", "id"], "left").groupBy("saison", "id").agg(F.count("*").alias("conseils"), F.sum("juste").alias("justes"), F.count("n").alias("menaces"), F.sum(F.coalesce("n", F.lit(0))).alias("voix"), F.count_if(F.col("n").isNotNull() & ~YES(F.col("e") == F.col("id"))).alias("echappees"))
    y = parts(spark, d).select("saison", "id").join(x, ["saison", "id"], "left")
    enough = F.col("conseils") >= 4
    return y.select("saison", "id", F.coalesce("conseils", F.lit(0)).alias("conseils"), F.when(enough, F.round(100.0 * F.col("justes") / F.col("conseils"), 6)).alias("precision_pct"), F.when(enough, F.round(100.0 * F.col("menaces") / F.col("conseils"), 6)).alias("menace"), F.when(F.col("menaces") > 0, F.round(100.0 * F.col("echappees") / F.col("menaces"), 6)).alias("evasion"), R6(F.col("voix") / F.col("conseils"), "voix_par_conseil"))


@query(f"""{PS}, c as (select saison, numero, cible, count(*) as n from ballots where type = 'elimination' and complet group by all), t as (select saison, numero, max(n) as top, sum(n) as total, count(*) as k, sum(cast(n * n as double)) / (sum(n) * sum(n)) as h from c group by all),
 i as (select saison, count(*) as conseils, avg(cast(top as double) / total) as tension, avg(k) as dispersion, avg(h) as concentration, count(*) filter (where 2 * top > total) as majorites, count(*) filter (where k = 1) as unanimes from t group by saison), w as (select saison, max(vi) as mv, sum(vi) as tv from parts group by saison)
 select i.saison, conseils, round(tension, 6) as tension, round(dispersion, 6) as dispersion, round(concentration, 6) as concentration, majorites, unanimes, case when tv > 0 then round(mv / cast(tv as double), 6) end as domination from i left join w using (saison)""")
def a26_season_profile(spark, d):
    """Of each season: how tense, spread and concentrated its votes were, and how far one person dominated the contests."""
    c = ballots(spark, d).filter("type = 'elimination' and complet").groupBy("saison", "numero", "cible").agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    t = c.groupBy("saison", "numero").agg(F.max("n").alias("top"), F.sum("n").alias("total"), F.count("*").alias("k"), (F.sum(n * n) / (F.sum(n) * F.sum(n))).alias("h"))
    i = t.groupBy("saison").agg(F.count("*").alias("conseils"), R6(F.avg(F.col("top") / F.col("total")), "tension"), R6(F.avg("k"), "dispersion"), R6(F.avg("h"), "concentration"), F.count_if(2 * F.col("top") > F.col("total")).alias("majorites"), F.count_if(F.col("k") == 1).alias("unanimes"))
    w = parts(spark, d).groupBy("saison").agg(F.max("vi").alias("mv"), F.sum("vi").alias("tv"))
    return i.join(w, "saison", "left").select(*i.columns, F.when(F.col("tv") > 0, F.round(F.col("mv") / F.col("tv"), 6)).alias("domination"))


@query(f"""{P}, k as (select id, saison, annee, sort, row_number() over (partition by id order by annee, saison) as r from parts where annee is not null), g as (select id, count(*) as editions, min(annee) as premiere, max(annee) as derniere, count(*) filter (where sort = 'vainqueur') as titres from k group by id having count(*) > 1) select editions, count(*) as personnes, round(avg(derniere - premiere), 6) as ecart, count(*) filter (where titres > 1) as plusieurs_titres from g group by editions""")
def a37_careers_by_length(spark, d):
    g = parts(spark, d).filter("annee is not null").groupBy("id").agg(F.count("*").alias("editions"), (F.max("annee") - F.min("annee")).alias("e"), F.count_if(YES(F.col("sort") == "vainqueur")).alias("t")).filter("editions > 1")
    return g.groupBy("editions").agg(F.count("*").alias("personnes"), R6(F.avg("e"), "ecart"), F.count_if(F.col("t") > 1).alias("plusieurs_titres"))


@query(f"""{P}, k as (select p.id, count(distinct q.id) as compagnons from (select distinct id, saison from parts where not speciale) p join (select distinct id, saison from parts where not speciale) q on q.saison = p.saison and q.id <> p.id group by p.id) select compagnons, count(*) as n from k group by compagnons""")
def a37_companions(spark, d):
    """With how many others people of regular seasons played: a season's size for those of one season, the union of casts for the others."""
    p = parts(spark, d).filter("not speciale").select("saison", "id").distinct()
    n = p.groupBy("saison").agg(F.count("*").alias("taille"))
    k = p.groupBy("id").agg(F.count("*").alias("k"))
    one = p.join(k.filter("k = 1"), "id").join(n, "saison").select("id", (F.col("taille") - 1).alias("compagnons"))
    more = p.join(k.filter("k > 1").select("id"), "id", "left_semi")
    q = p.select("saison", F.col("id").alias("autre"))
    many = more.join(q, "saison").filter("autre <> id").groupBy("id").agg(F.count_distinct("autre").alias("compagnons"))
    return one.unionByName(many).filter("compagnons > 0").groupBy("compagnons").agg(F.count("*").alias("n"))


@query(f"""{P}, f as (select saison, id, age, genre, profession, tribu, couleur, jour, sort from parts), g as (select id as pid, genre as g2 from personnes), x as (select f.saison, f.id, coalesce(f.genre, g.g2) as genre, case when f.genre is not null then 'table' when g.g2 is not null then 'personne' end as genre_de, f.age, f.sort, f.jour from f left join g on g.pid = f.id),
 y as (select x.*, s.duree_jours, s.id as sid from x left join saisons s on s.id = x.saison) select saison, id, genre, genre_de, age, sort, case when sort in ('vainqueur', 'finaliste') then coalesce(jour, duree_jours) else jour end as jour from y""")
def x19_cleaning_in_order(spark, d):
    """Passes in their fixed order over participations: gender filled with its provenance, then the last day of those in the final."""
    def gender(p):
        q = table(spark, d, "personnes").select("id", F.col("genre").alias("g"))
        p = p.join(q, "id", "left")
        return p.withColumn("genre_de", F.when(F.col("genre").isNotNull(), "table").when(F.col("g").isNotNull(), "personne")).withColumn("genre", F.coalesce("genre", "g")).drop("g")

    def last_day(p):
        return p.withColumn("jour", F.when(F.col("sort").isin("vainqueur", "finaliste"), F.coalesce("jour", "duree_jours")).otherwise(F.col("jour")))

    p = parts(spark, d)
    for step in (gender, last_day):
        p = step(p)
    return p.select("saison", "id", "genre", "genre_de", "age", "sort", "jour")


@query(f"""{PS}, c as (select saison, numero, annulation, elimine, max_by(voix_annulees, (maj, ligne)) as v from (select c.* from conseils c) group by saison, numero, annulation, elimine) select s.saison, s.numero, case when s.annulation is null then 'sans' when c.v > 0 and s.elimine is not null then 'annulation_efficace' when c.v > 0 then 'sans_sortie' else 'joue_pour_rien' end as issue from sess s left join c on c.saison = s.saison and c.numero = s.numero and c.annulation is not distinct from s.annulation and c.elimine is not distinct from s.elimine where s.type = 'elimination'""")
def x20_outcome_of_annulments(spark, d):
    """What an annulment did, from the votes that it took away and whether somebody left."""
    c = table(spark, d, "conseils").groupBy("saison", "numero", "annulation", "elimine").agg(F.max_by("voix_annulees", F.struct("maj", "ligne")).alias("v"))
    s = sessions(spark, d).filter("type = 'elimination'").select("saison", "numero", "annulation", "elimine").alias("s")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("saison", "numero", "annulation", "elimine")]
    x = s.join(c.alias("c"), on, "left")
    issue = F.when(F.col("s.annulation").isNull(), "sans").when((F.col("v") > 0) & F.col("s.elimine").isNotNull(), "annulation_efficace").when(F.col("v") > 0, "sans_sortie").otherwise("joue_pour_rien")
    return x.select("s.saison", "s.numero", issue.alias("issue"))


@query("""with n as (select saison, source, count(*) as pages, count(distinct date_trunc('day', publie_le)) as jours from documents where saison is not null and source is not null group by all), s as (select id as saison, duree_jours from saisons) select saison, source from (select n.saison, n.source, row_number() over (partition by n.saison order by abs(n.jours - coalesce(s.duree_jours, 0)), n.pages desc, n.source) as r from n left join s using (saison)) where r = 1""")
def x22_best_source(spark, d):
    """The source whose number of days agrees best with the season's, then the one of most pages."""
    n = table(spark, d, "documents").filter("saison is not null and source is not null").groupBy("saison", "source").agg(F.count("*").alias("pages"), F.count_distinct(F.date_trunc("day", "publie_le")).alias("jours"))
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"), "duree_jours")
    x = n.join(s, "saison", "left")
    order = F.struct(F.abs(F.col("jours") - F.coalesce("duree_jours", F.lit(0))).alias("e"), (-F.col("pages")).alias("p"), "source")
    return x.groupBy("saison").agg(F.min_by("source", order).alias("source"))


@query(f"""{P}, a as (select saison, id, case when vi > 3 then vi end as vi from parts), b as (select saison, id, vi as autre from parts) select b.saison, b.id, coalesce(a.vi, b.autre) as vi, a.vi is null and b.autre is not null as complete from b left join a using (saison, id)""")
def n22_completed_without_overwriting(spark, d):
    """A catalogue completed from another table: what it has is never overwritten."""
    p = parts(spark, d).select("saison", "id", "vi")
    a = p.filter("vi > 3").select("saison", "id", F.col("vi").alias("a"))
    x = p.join(a, ["saison", "id"], "left")
    return x.select("saison", "id", F.coalesce("a", "vi").alias("vi"), (F.col("a").isNull() & F.col("vi").isNotNull()).alias("complete"))


@query(f"""{P}, s as (select id as saison, tribus[1].couleur as c from saisons) select p.saison, p.id, coalesce(p.couleur, case when p.tribu is not null then t.couleur end, s.c) as couleur from parts p left join (select id as saison, unnest(tribus).nom as tribu, unnest(tribus).couleur as couleur from saisons) t using (saison, tribu) left join s using (saison)""")
def n23_colour_by_falling_trust(spark, d):
    """A colour from the row, else from its declared tribe, else from the season's first tribe."""
    t = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.explode("tribus").alias("t")).select("saison", F.col("t.nom").alias("tribu"), F.col("t.couleur").alias("ct"))
    s = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.when(F.size("tribus") > 0, F.col("tribus")[0]["couleur"]).alias("cs"))
    x = parts(spark, d).select("saison", "id", "tribu", "couleur").join(t, ["saison", "tribu"], "left").join(s, "saison", "left")
    return x.select("saison", "id", F.coalesce("couleur", "ct", "cs").alias("couleur"))


@query("""select ligne, parcours[-1].tribu as tribu, len(parcours) as pas from participations where len(parcours) > 0""")
def n24_last_step_of_the_path(spark, d):
    return table(spark, d, "participations").filter(F.size("parcours") > 0).select("ligne", F.element_at("parcours", -1)["tribu"].alias("tribu"), F.size("parcours").cast("bigint").alias("pas"))


@query("""select doc_id, regexp_extract(text, '([0-9]+) (voix|votes|votos|Stimmen)', 1) as voix from documents where regexp_matches(text, '[0-9]+ (voix|votes|votos|Stimmen)')""")
def n32_numbers_in_text(spark, d):
    m = r"([0-9]+) (voix|votes|votos|Stimmen)"
    return table(spark, d, "documents").filter(F.col("text").rlike(m)).select("doc_id", F.regexp_extract("text", m, 1).alias("voix"))


@query(f"""{P}, t as (select unnest(['part_femmes', 'age_moyen']) as test), g as (select distinct saison from reg), v as (select g.saison as exclue, 'part_femmes' as test, avg((genre = 'f')::int) filter (where genre is not null) as x from g join reg r on r.saison <> g.saison group by g.saison union all select g.saison, 'age_moyen', avg(age) from g join reg r on r.saison <> g.saison group by g.saison)
 select test, count(*) as n, round(avg(x), 6) as moyenne, round(sqrt((count(*) - 1) * var_pop(x)), 6) as erreur from v group by test""")
def n37_jackknife_of_a_family(spark, d):
    """Several estimates with each season left out, from one pass of sums a season: totals less a season's part."""
    r = regular(parts(spark, d))
    s = r.groupBy("saison").agg(F.count_if(YES(F.col("genre") == "f")).alias("a1"), F.count("genre").alias("n1"), F.coalesce(F.sum("age"), F.lit(0)).alias("a2"), F.count("age").alias("n2"))
    w = Window.partitionBy()  # a row a season
    left = lambda k: (F.sum(f"a{k}").over(w) - F.col(f"a{k}")) / (F.sum(f"n{k}").over(w) - F.col(f"n{k}"))
    s = s.select(left(1).alias("part_femmes"), left(2).alias("age_moyen"))
    x = s.select(F.inline(F.array(*[F.struct(F.lit(c).alias("test"), F.col(c).alias("x")) for c in s.columns])))
    return x.groupBy("test").agg(F.count("*").alias("n"), R6(F.avg("x"), "moyenne"), R6(F.sqrt((F.count("*") - 1) * F.var_pop("x")), "erreur"))


@query(f"""{S}, c as (select 'majorite' as phrase, 50 as seuil, (select 100.0 * count(*) filter (where 2 * votes_contre > votes_exprimes) / count(*) from sess where type = 'elimination' and votes_exprimes > 0 and votes_contre is not null) as valeur union all select 'complets', 90, (select 100.0 * count(*) filter (where complet) / count(*) from sess)) select phrase, seuil, round(valeur, 6) as valeur, valeur >= seuil as tient from c""")
def q13_claims_and_data(spark, d):
    """Written claims, each with the value that it rests on and whether it still holds."""
    s = sessions(spark, d)
    known = (F.col("type") == "elimination") & (F.col("votes_exprimes") > 0) & F.col("votes_contre").isNotNull()
    v = s.agg((100.0 * F.count_if(YES(known & (2 * F.col("votes_contre") > F.col("votes_exprimes")))) / F.count_if(YES(known))).alias("a"), (100.0 * F.count_if("complet") / F.count("*")).alias("b"))
    claims = F.array(F.struct(F.lit("majorite").alias("phrase"), F.lit(50).alias("seuil"), F.col("a").alias("v")), F.struct(F.lit("complets").alias("phrase"), F.lit(90).alias("seuil"), F.col("b").alias("v")))
    return v.select(F.inline(claims)).select("phrase", "seuil", R6(F.col("v"), "valeur"), (F.col("v") >= F.col("seuil")).alias("tient"))


@query(f"""{P}, x as (select couleur, avg(age) as m from reg where couleur is not null and age is not null group by couleur) select 'par_couleur' as nul, round(stddev_samp(m), 6) as sd, stddev_samp(m) is null or not isfinite(stddev_samp(m)) or stddev_samp(m) < 1e-12 or count(distinct round(m, 9)) = 1 as degenere from x union all select 'constant', 0.0, true""")
def q12_degenerate_nulls(spark, d):
    """A null model whose values have no spread, or all fall together, is an error."""
    x = regular(parts(spark, d)).filter("couleur is not null and age is not null").groupBy("couleur").agg(F.avg("age").alias("m"))
    check = lambda df, name: df.agg(F.stddev_samp("m").alias("sd"), F.count_distinct(F.round("m", 9)).alias("k")).select(F.lit(name).alias("nul"), R6(F.col("sd"), "sd"), (F.col("sd").isNull() | F.isnan("sd") | (F.col("sd") < 1e-12) | (F.col("k") == 1)).alias("degenere"))
    return check(x, "par_couleur").unionByName(check(x.withColumn("m", F.lit(1.0)), "constant"))


@query(f"""{P}, y as (select annee, count(*) as n, round(avg(age), 6) as age from reg where annee is not null group by annee) select 'barres' as figure, cast(annee as varchar) as x, cast(n as double) as y from y union all select 'courbe', cast(annee as varchar), age from y where age is not null""")
def v06_figure_series(spark, d):
    """The series of figures in one long form."""
    y = regular(parts(spark, d)).filter("annee is not null").groupBy("annee").agg(F.count("*").cast("double").alias("barres"), R6(F.avg("age"), "courbe"))
    return y.unpivot(["annee"], ["barres", "courbe"], "figure", "y").filter("y is not null").select("figure", F.col("annee").cast("string").alias("x"), "y")


@query("""select id, lag(id) over (order by numero) as avant, lead(id) over (order by numero) as apres from saisons where numero is not null""")
def v08_previous_and_next_page(spark, d):
    w = Window.orderBy("numero")  # a row a season
    return table(spark, d, "saisons").filter("numero is not null").select("id", F.lag("id").over(w).alias("avant"), F.lead("id").over(w).alias("apres"))


@query(f"""{P} select saison, 'Qui a gagné ?' as question, coalesce(string_agg(nom, ' et ' order by id), 'Personne') as reponse from parts where sort = 'vainqueur' or sort is null group by saison having count(*) filter (where sort = 'vainqueur') > 0""".replace("string_agg(nom, ' et ' order by id)", "string_agg(nom, ' et ' order by id) filter (where sort = 'vainqueur')"))
def v05_questions_and_answers(spark, d):
    """A question and its answer for each season that has a winner."""
    w = parts(spark, d).filter("sort = 'vainqueur'").groupBy("saison").agg(F.array_sort(F.collect_list(F.struct("id", "nom"))).alias("l"))
    names = F.filter(F.transform("l", lambda x: x["nom"]), lambda x: x.isNotNull())
    return w.select("saison", F.lit("Qui a gagné ?").alias("question"), F.coalesce(F.nullif(F.array_join(names, " et "), F.lit("")), F.lit("Personne")).alias("reponse"))


QUERIES = Q
