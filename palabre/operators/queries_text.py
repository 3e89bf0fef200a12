"""Queries on text, extraction, resolution, quality, cards and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import grid as G
from ..functions.text import slug, words
from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, parts, regular, sessions
from ..session import cut, table
from . import aggregates as A
from . import quality as V
from .resolution import cascade, fill_if_unanimous

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


P = f"with {PARTS_SQL}"
PS = f"with {PARTS_SQL}, {SESSIONS_SQL}"
FOLD = "trim(regexp_replace(regexp_replace(replace(replace(replace(strip_accents(lower({})), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"

@query(f"""select id, replace({FOLD.format("nom")}, ' ', '-') as slug from personnes""")
def f01_slugs(spark, d):
    return table(spark, d, "personnes").select("id", slug(F.col("nom")).alias("slug"))


_ASCII = "regexp_replace({}, '[^[:ascii:]À-ÿŒœ]', ' ', 'g')"


@query(f"""with v as (select distinct profession, {FOLD.format(_ASCII.format("profession"))} as t from participations where profession is not null), r as (select code, poste, {FOLD.format(_ASCII.format("libelle"))} as mot from ref_metiers), f as (select v.profession, arg_min(r.poste, r.code) as poste from v join r on contains(v.t, r.mot) group by v.profession)
select p.ligne, case when p.profession is not null then coalesce(f.poste, 'autre') end as famille from participations p left join f using (profession)""")
def f03_job_families(spark, d):
    """The family of an occupation: that of the list's first entry that the typed text holds."""
    clean = lambda c: words(F.regexp_replace(c, r"[^\x00-\x7FÀ-ÿŒœ]", " "))
    p = table(spark, d, "participations").select("ligne", "profession")
    v = p.filter("profession is not null").select("profession").distinct()
    return p.join(D.family_of(v, "profession", clean, table(spark, d, "ref_metiers"), "libelle", "code", "poste"), "profession", "left").select("ligne", F.when(F.col("profession").isNotNull(), F.coalesce("poste", F.lit("autre"))).alias("famille"))


@query(f"""{P} select saison, id, case when sort = 'vainqueur' and genre = 'f' then 'Gagnante' when sort = 'vainqueur' then 'Gagnant' when sort = 'finaliste' then 'Finaliste' else sort end as libelle from parts""")
def f09_outcome_labels(spark, d):
    return parts(spark, d).select("saison", "id", D.label(F.col("sort"), F.col("genre"), {"vainqueur": ("Gagnant", "Gagnante"), "finaliste": ("Finaliste", "Finaliste")}).alias("libelle"))


@query("""select id, case when len(vainqueurs) = 0 then '' when len(vainqueurs) = 1 then vainqueurs[1] else array_to_string(vainqueurs[:-2], ', ') || ' et ' || vainqueurs[-1] end as liste from saisons where vainqueurs is not null""")
def f12_winners_in_words(spark, d):
    return table(spark, d, "saisons").filter("vainqueurs is not null").select("id", D.enumerate_words(F.col("vainqueurs")).alias("liste"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events""")
def f30_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""select a.saison, b.nom as tribu from (select id as saison, unnest(tribus) as b from saisons) a where b.nom is not null""")
def f31_tribes(spark, d):
    return table(spark, d, "saisons").select(F.col("id").alias("saison"), F.explode("tribus").alias("b")).select("saison", F.col("b.nom").alias("tribu")).filter("tribu is not null")


@query(f"""{PS}, v as (select saison, numero, votant, string_agg(cible, ' + ' order by pos) as cibles from ballots group by all) select saison, numero, votant, cibles from v""")
def x05_matrix_unpivoted(spark, d):
    """Votes written as a wiki table with a member in each row, and read back from its grid."""
    b = ballots(spark, d).groupBy("saison", "numero", F.coalesce("votant", F.lit("\u0001")).alias("votant")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cible"))), lambda x: x["cible"]), " + ").alias("c"))
    row = F.concat(F.lit("|-\n! "), F.col("votant"), F.lit("\n| {{v|a||b}}"), F.coalesce(F.concat(F.lit("<!>"), F.nullif("c", F.lit(""))), F.lit("")))
    wiki = b.groupBy("saison", "numero").agg(F.concat(F.lit("{|\n! nom !! votes\n"), F.array_join(F.sort_array(F.collect_list(row)), "\n"), F.lit("\n|}")).alias("texte"))
    m = G.unpivot_matrix(G.cells(wiki, ["saison", "numero"], "texte"), ["saison", "numero"])
    text = F.regexp_extract("value", r"<!>(.*)$", 1)
    return m.select("saison", "numero", F.nullif("member", F.lit("\u0001")).alias("votant"), F.nullif(text, F.lit("")).alias("cibles"))


_WORDS = f"""m as (select distinct saison, id, {FOLD.format("coalesce(regexp_replace(nom, '[^[:ascii:]À-ÿŒœ]', ' ', 'g'), '')")} as w from parts)"""


@query(f"""{PS}, {_WORDS}, k as (select distinct saison, id, 0 as level, w from m where w <> '' union select distinct saison, id, 1, split_part(w, ' ', 1) from m where w <> ''), c as (select saison, w, level, count(*) as k, min(id) as id from k group by all),
l as (select saison, numero, elimine, {FOLD.format("regexp_replace(elimine, '[^[:ascii:]À-ÿŒœ]', ' ', 'g')")} as w from sess where elimine_rattache is false and elimine is not null), b as (select l.saison, l.numero, min_by(struct_pack(level := level, k := k, id := id), level) as b from l join c using (saison, w) group by all)
select l.saison, l.numero, case when b.b.k = 1 then b.b.id end as resolved, case when b.b is null then 'inconnu' when b.b.k > 1 then 'homonyme' when b.b.level = 0 then 'nom' else 'prenom' end as how from l left join b using (saison, numero)""")
def x12_cascade(spark, d):
    clean = lambda c: F.regexp_replace(c, r"[^\x00-\x7FÀ-ÿŒœ]", " ")
    m = parts(spark, d).select("saison", "id", clean("nom").alias("nom"))
    l = sessions(spark, d).filter("not elimine_rattache and elimine is not null").select("saison", "numero", clean("elimine").alias("elimine"))
    return cascade(l, m, "saison", "elimine", "id", ["nom"]).select("saison", "numero", "resolved", "how")


@query("""with k as (select prenom, min(genre) as lo, max(genre) as hi from personnes where prenom is not null and genre is not null group by prenom having min(genre) = max(genre)) select q.id, coalesce(q.genre, k.lo) as genre from personnes q left join k using (prenom)""")
def n03_gender_by_first_name(spark, d):
    return fill_if_unanimous(table(spark, d, "personnes").select("id", "prenom", "genre"), "prenom", "genre", "g").select("id", F.col("g").alias("genre"))


@query("""with g as (select edition, count(*) as n, count(age) as avec_age, count(metier) as avec_metier from fiches_wiki group by edition) select * from g""")
def x25_coverage_by_edition(spark, d):
    return table(spark, d, "fiches_wiki").groupBy("edition").agg(F.count("*").alias("n"), F.count("age").alias("avec_age"), F.count("metier").alias("avec_metier"))


@query("""select md5(text) as h, count(*) as n, min(doc_id) as premier from documents where text is not null and text <> '' group by md5(text) having count(*) > 1""")
def q08_repeated_texts(spark, d):
    g = table(spark, d, "documents").filter("text is not null and text <> ''").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("premier"))
    return g.filter("n > 1")


@query("""select level, rule, count(*) as n, min(key) as example from (
 select 'error' as level, 'cle_saison_numero' as rule, saison || '/' || numero as key from conseils group by saison, numero having count(*) > 1
 union all select 'error', 'age_hors_domaine', cast(ligne as varchar) from participations where age < 16 or age > 80
 union all select 'warn', 'numero_episode', cast(ligne as varchar) from conseils where episode is not null and try_cast(episode as integer) is null
 union all select 'error', 'votes_contre', cast(ligne as varchar) from conseils where votes_contre > votes_exprimes
 union all select 'error', 'saison_inconnue', saison from (select distinct saison from participations where saison is not null) x where not exists (select 1 from saisons s where s.id = x.saison)
 union all select 'warn', 'dates_diffusion', id from saisons where diffusion.debut > diffusion.fin) group by level, rule""")
def q09_violations(spark, d):
    p, c, s = table(spark, d, "participations"), table(spark, d, "conseils"), table(spark, d, "saisons")
    line = F.col("ligne")
    return V.report([
        V.unique_key(c, ["saison", "numero"], "cle_saison_numero"),
        V.violations(p, "age_hors_domaine", "error", line, (F.col("age") < 16) | (F.col("age") > 80), "age"),
        V.violations(c, "numero_episode", "warn", line, F.col("episode").isNotNull() & F.col("episode").try_cast("int").isNull(), "not a number"),
        V.violations(c, "votes_contre", "error", line, F.col("votes_contre") > F.col("votes_exprimes"), "more votes than ballots"),
        V.foreign_key(p, ["saison"], s, ["id"], "saison_inconnue"),
        V.violations(s, "dates_diffusion", "warn", F.col("id"), F.col("diffusion.debut") > F.col("diffusion.fin"), "ends before it starts"),
    ])


@query(f"""{PS} select b.saison, b.numero, b.votant from ballots b join parts p on p.saison = b.saison and p.id = b.votant join sess s on s.saison = b.saison and s.numero = b.numero where b.votant_ok and b.type = 'elimination' and p.sort in ('vainqueur', 'finaliste') and s.elimine_rattache and s.elimine = b.votant""")
def q04_finalists_voted_out(spark, d):
    p = parts(spark, d).filter("sort in ('vainqueur', 'finaliste')").select("saison", F.col("id").alias("votant"))
    s = sessions(spark, d).filter("elimine_rattache").select("saison", "numero", F.col("elimine").alias("votant"))
    return ballots(spark, d).filter("votant_ok and type = 'elimination'").select("saison", "numero", "votant").join(s, ["saison", "numero", "votant"], "left_semi").join(p, ["saison", "votant"], "left_semi")


@query(f"""{P}, c as (select id, count(*) as editions, sum(vi) as victoires, max(annee) as derniere, string_agg(saison || ':' || coalesce(sort, '?'), ' ' order by annee, saison) as parcours from parts where annee is not null group by id)
select id, editions, cast(victoires as bigint) as victoires, derniere, parcours, rank() over (order by coalesce(victoires, 0) desc, id) as rang from c""")
def v01_person_cards(spark, d):
    p = parts(spark, d).filter("annee is not null")
    g = p.groupBy("id").agg(F.count("*").alias("editions"), F.sum("vi").cast("bigint").alias("victoires"), F.max("annee").alias("derniere"), F.array_sort(F.collect_list(F.struct("annee", "saison", "sort"))).alias("l"))
    path = F.array_join(F.transform("l", lambda x: F.concat(x["saison"], F.lit(":"), F.coalesce(x["sort"], F.lit("?")))), " ")
    g = g.select("id", "editions", "victoires", "derniere", path.alias("parcours"))
    return A.global_rank(g, [F.coalesce("victoires", F.lit(0)).desc(), F.col("id").asc()], "rang", cut)


@query(f"""{P} select saison, string_agg(id, ',' order by coalesce(jour, 9999) desc, id) filter (where sort in ('vainqueur', 'finaliste')) as finalistes, count(*) as n, cast(sum(vi) as bigint) as victoires from parts group by saison""")
def v02_season_cards(spark, d):
    last = F.array_sort(F.collect_list(F.when(F.col("sort").isin("vainqueur", "finaliste"), F.struct((-F.coalesce("jour", F.lit(9999))).alias("j"), "id"))))
    return parts(spark, d).groupBy("saison").agg(F.nullif(F.array_join(F.transform(last, lambda x: x["id"]), ","), F.lit("")).alias("finalistes"), F.count("*").alias("n"), F.sum("vi").cast("bigint").alias("victoires"))


@query(f"""with {SESSIONS_SQL}, c as (select saison, count(*) as n from sess where complet group by saison), best as (select saison from c order by n desc, saison limit 1)
select b.saison, votant, cible, count(*) as n from ballots b where b.type = 'elimination' and votant_ok and cible_ok and b.saison in (select saison from best) group by all""")
def v04_vote_arcs(spark, d):
    best = sessions(spark, d).filter("complet").groupBy("saison").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "saison").limit(1).select("saison")
    b = ballots(spark, d).filter("type = 'elimination' and votant_ok and cible_ok").join(F.broadcast(best), "saison", "left_semi")  # one row
    return b.groupBy("saison", "votant", "cible").agg(F.count("*").alias("n"))


@query(f"""select id, nom from personnes where contains({FOLD.format("nom")}, 'lo') and genre = 'f' order by nom, id limit 50""")
def o06_filtered_list(spark, d):
    """Text filter without accents and a facet, in order, as a page of a list."""
    return table(spark, d, "personnes").filter(F.contains(words(F.col("nom")), F.lit("lo")) & (F.col("genre") == "f")).select("id", "nom").orderBy("nom", "id").limit(50)


@query("""select strftime(date_trunc('day', ts), '%Y-%m-%d') as jour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def e01_stream_windows(spark, d):
    """The event table read as a stream, in daily windows under a watermark."""
    import os
    import uuid

    from ..session import checkpoint_folder
    from ..streaming.sessions import counts_by_window, run_to_table

    schema = table(spark, d, "events").schema
    path = os.path.join(d, "events.parquet")
    s = spark.readStream.schema(schema).parquet(path if os.path.isdir(path) else f"{d}/event[s].parquet")
    s = s.withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"e01_{uuid.uuid4().hex}"
    run_to_table(counts_by_window(s), name, f"{checkpoint_folder(spark)}/{name}", "complete")
    return spark.table(name).select(F.date_format("start", "yyyy-MM-dd").alias("jour"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = Q
