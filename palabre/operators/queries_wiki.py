"""Queries on source pages and typed text: tables, infoboxes, sentences, resolution with its checks, cleaning passes.

Pages are stored fixtures of invented people; what must come out of them is written down as SQL values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import domain as D
from ..functions import grid as G
from ..functions import wiki as K
from ..functions.text import fold, words
from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, parts, sessions
from ..session import table

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
S = f"with {SESSIONS_SQL}"
PS = f"with {PARTS_SQL}, {SESSIONS_SQL}"
R6 = lambda c, name: F.round(c.cast("double"), 6).alias(name)
FOLDED = "trim(regexp_replace(regexp_replace(replace(replace(replace(strip_accents(lower({})), 'œ', 'oe'), 'æ', 'ae'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"

PAGES = [
    ("Ada Morvan", "{{Infobox candidat\n| nom = Ada Morvan\n| âge = 31\n| métier = {{lien|potière}} d'art\n| Tribu1 = Rive Rouge\n| Tribu2 = Grand Camp\n| jours = 28\n| vide =\n}}\n'''Ada Morvan''' est éliminée au 7e conseil.\n== Parcours ==\nElle gagne deux épreuves.\n== Votes ==\n{| class=wikitable\n! Conseil !! Voix\n|-\n| 1 || [[Bilal Rey|Bilal]]\n|-\n| 2 || ''personne''\n|}\n"),
    ("Saison 9", "== Candidats ==\n{|\n! Candidat !! Âge !! Sortie\n|-\n| [[Ada Morvan]] || 31 || Éliminée au conseil\n|-\n| '''Bilal Rey''' || 44<ref>voir</ref> || Vainqueur\n|-\n| Chan Ly || || rowspan=2 | Abandon médical\n|-\n| Dora Vent || 27\n|}\n== Épreuves ==\n{|\n! Épisode\n! Confort\n! Immunité\n|-\n| 1 || Rive Rouge || Rive Jaune\n|-\n| colspan=2 Ada Morvan || Bilal Rey\n|}\n== Audiences ==\n{|\n! Diffusion !! Téléspectateurs !! Part de marché\n|-\n| 3 mars || 5 120 000<ref name=a/> || 21,4 %\n|-\n| 10 mars || 4.870.000 || 20 %\n|-\n| Moyenne || 4 995 000 || 20,7 %\n|}\n"),
    ("Vide", ""),
    (None, None),
]
CELLS = [("a", "{|\n! x !! {{v|a||b}} !! z\n|-\n| rowspan=2 | 1 || 2 || 3\n|-\n| colspan=\"2\" style=\"c\" 4\n|}\ntexte\n{|\n| seul\n|}"), ("b", "<table><tr><td>h</td></tr></table><table><tr><th>i</th></tr></table>"), ("c", "rien")]
TALES = [
    (1, "Ce soir, Ada Morvan et Bilal Rey sont désignés ambassadeurs et éliminent Chan Ly."),
    (2, "Ce soir, Dora Vent et Inconnu Total sont désignés ambassadeurs et éliminent Chan Ly."),
    (3, "Personne n'est désigné."),
    (4, None),
]
OUTCOMES = [("vainqueur", r"\bvainqueur|\bgagn"), ("abandon_medical", r"abandon medical|raison medicale"), ("abandon_volontaire", r"abandon"), ("elimine_conseil", r"elimine\w* au .*conseil|elimine\w* au conseil"), ("elimine", r"elimine")]


def _pages(spark, rows, names) -> DataFrame:
    return spark.createDataFrame(rows, names)


def _values(names: str, rows: list[tuple]) -> str:
    lit = lambda x: "null" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


# ---- tables and pages --------------------------------------------------------------------------------


@query(_values("page, \"table\", \"row\", col, texte", [("a", 0, 0, 0, "x"), ("a", 0, 0, 1, "{{v|a||b}}"), ("a", 0, 0, 2, "z"), ("a", 0, 1, 0, "1"), ("a", 0, 1, 1, "2"), ("a", 0, 1, 2, "3"), ("a", 0, 2, 0, "1"), ("a", 0, 2, 1, "4"), ("a", 0, 2, 2, "4"), ("a", 1, 0, 0, "seul"), ("b", 0, 0, 0, "h"), ("b", 1, 0, 0, "i")]))
def x01_cells_of_tables(spark, d):
    """Cells of every table of a text; a separator inside a template is text."""
    return G.table_cells(_pages(spark, CELLS, "page string, text string"), ["page"], "text").select("page", "table", "row", "col", F.col("text").alias("texte"))


@query(_values("page, n, titres", [("a", 10, 3), ("b", 2, 1)]))
def x02_attributes_apart(spark, d):
    """Positions and header cells a page, where attributes stand before a bar or lack it."""
    c = G.table_cells(_pages(spark, CELLS, "page string, text string"), ["page"], "text")
    return c.filter(~F.col("text").contains("=")).groupBy("page").agg(F.count("*").alias("n"), F.count_if("header").alias("titres"))


@query(_values("page, \"row\", col, texte", [("a", 2, 0, "1"), ("a", 2, 2, "4")]))
def x03_expanded_spans(spark, d):
    """Positions that a span covers beside its origin."""
    c = G.table_cells(_pages(spark, CELLS, "page string, text string"), ["page"], "text")
    return c.filter("not origin").select("page", "row", "col", F.col("text").alias("texte"))


ROLES = {"nom": ["candidat", "nom"], "age": ["age"], "sortie": ["sortie", "statut"]}


@query(_values("page, nom, age, sortie", [("Saison 9", "Ada Morvan", "31", "Éliminée au conseil"), ("Saison 9", "Bilal Rey", "44", "Vainqueur"), ("Saison 9", "Chan Ly", "", "Abandon médical"), ("Saison 9", "Dora Vent", "27", "Abandon médical")]))
def x04_roles_by_label(spark, d):
    """Columns found by the labels of their headers."""
    return K.by_header(_pages(spark, PAGES, "page string, text string"), ["page"], "text", ROLES).filter("nom is not null").select("page", "nom", "age", "sortie")


@query(_values("page, cle, rang, valeur", [("Ada Morvan", "nom", 1, "Ada Morvan"), ("Ada Morvan", "age", 1, "31"), ("Ada Morvan", "metier", 1, "{{lien|potière}} d'art"), ("Ada Morvan", "tribu", 1, "Rive Rouge"), ("Ada Morvan", "tribu", 2, "Grand Camp"), ("Ada Morvan", "jours", 1, "28")]))
def x06_infobox_in_long_form(spark, d):
    i = K.infobox(_pages(spark, PAGES, "page string, text string"), ["page"], "text")
    return i.select("page", F.col("key").alias("cle"), F.col("rank").alias("rang"), F.col("value").alias("valeur"))


@query(_values("page, titre, tables", [("Ada Morvan", "Parcours", 0), ("Ada Morvan", "Votes", 1), ("Saison 9", "Candidats", 1), ("Saison 9", "Épreuves", 1), ("Saison 9", "Audiences", 1)]))
def x07_sections_by_title(spark, d):
    s = K.sections(_pages(spark, PAGES, "page string, text string"), ["page"], "text")
    return s.select("page", F.col("title").alias("titre"), F.size(F.regexp_extract_all("body", F.lit(r"(?m)^(\{\|)"), F.lit(1))).alias("tables"))


@query(_values("page, nom, age, sort", [("Saison 9", "Ada Morvan", 31, "elimine_conseil"), ("Saison 9", "Bilal Rey", 44, "vainqueur"), ("Saison 9", "Chan Ly", None, "abandon_medical"), ("Saison 9", "Dora Vent", 27, "abandon_medical")]))
def x08_candidate_rows(spark, d):
    """Candidates of a season's table as typed rows."""
    s = K.sections(_pages(spark, PAGES, "page string, text string"), ["page"], "text").filter("title = 'Candidats'")
    return K.by_header(s, ["page"], "body", ROLES).select("page", "nom", F.col("age").try_cast("int").alias("age"), K.outcome(F.col("sortie"), OUTCOMES).alias("sort"))


@query(_values("page, episode, type, vainqueur", [("Saison 9", 1, "confort", "Rive Rouge"), ("Saison 9", 1, "immunite", "Rive Jaune"), ("Saison 9", None, "confort", "Ada Morvan"), ("Saison 9", None, "immunite", "Bilal Rey")]))
def x09_contests_in_one_shape(spark, d):
    """A table of contests of one row an episode as one row a contest."""
    s = K.sections(_pages(spark, PAGES, "page string, text string"), ["page"], "text").filter("title = 'Épreuves'")
    t = K.by_header(s, ["page"], "body", {"episode": ["episode"], "confort": ["confort"], "immunite": ["immunite"]})
    return t.unpivot(["page", "episode"], ["confort", "immunite"], "type", "vainqueur").select("page", F.col("episode").try_cast("int").alias("episode"), "type", "vainqueur")


@query(_values("episode, ambassadeurs, elimine, connus", [(1, "Ada Morvan, Bilal Rey", "Chan Ly", True), (2, "Dora Vent, Inconnu Total", "Chan Ly", False)]))
def x10_facts_of_sentences(spark, d):
    """A fact told in a sentence, accepted only if everybody whom it names is known."""
    known = K.by_header(_pages(spark, PAGES, "page string, text string"), ["page"], "text", ROLES).filter("nom is not null").agg(F.collect_set("nom").alias("noms"))  # the season's cast
    name = r"(\p{Lu}\p{L}+ \p{Lu}\p{L}+)"
    pattern = f"{name} et {name} sont désignés ambassadeurs et éliminent {name}"
    t = _pages(spark, TALES, "episode int, phrase string").filter(F.col("phrase").rlike(pattern))
    who = [F.regexp_extract("phrase", pattern, i) for i in (1, 2, 3)]
    t = t.select("episode", F.array(who[0], who[1]).alias("a"), who[2].alias("elimine")).crossJoin(F.broadcast(known))  # one row
    return t.select("episode", F.array_join("a", ", ").alias("ambassadeurs"), "elimine", (F.size(F.array_except(F.concat("a", F.array("elimine")), "noms")) == 0).alias("connus"))


@query(_values("diffusion, telespectateurs, pdm", [("3 mars", 5120000, 21.4), ("10 mars", 4870000, 20.0)]))
def x11_audience_numbers(spark, d):
    """Numbers of a table with notes taken off; rows that are aggregates are left out."""
    s = K.sections(_pages(spark, PAGES, "page string, text string"), ["page"], "text").filter("title = 'Audiences'")
    t = K.by_header(s, ["page"], "body", {"diffusion": ["diffusion"], "vu": ["telespectateurs"], "pdm": ["part"]}).filter(~words(F.col("diffusion")).rlike("^(moyenne|total)"))
    return t.select("diffusion", K.numbers(F.col("vu")).alias("telespectateurs"), D.french_number(F.regexp_extract("pdm", r"([\d,]+)", 1)).alias("pdm"))


# ---- resolution by evidence --------------------------------------------------------------------------


@query(f"""{PS}, m as (select saison, id, {FOLDED.format("regexp_replace(coalesce(nom, ''), '[^[:ascii:]À-ÿŒœ]', ' ', 'g')")} as w from parts), f as (select saison, split_part(w, ' ', 1) as prenom, id, substr(split_part(w, ' ', -1), 1, 1) as ini from m where w <> ''),
 l as (select saison, numero, {FOLDED.format("regexp_replace(elimine, '[^[:ascii:]À-ÿŒœ]', ' ', 'g')")} as w from sess where elimine_rattache is false and elimine is not null), x as (select saison, numero, split_part(w, ' ', 1) as prenom, split_part(w, ' ', 2) as ini from l where len(w) - len(replace(w, ' ', '')) = 1 and len(split_part(w, ' ', 2)) = 1),
 c as (select x.saison, x.numero, count(distinct f.id) as k, min(f.id) as id from x join f using (saison, prenom, ini) group by all) select saison, numero, k as candidats, case when k = 1 then id end as id from c""")
def x13_homonyms_by_initial(spark, d):
    """A first name with an initial: of those who bear the name the one whose other name begins so, if it is one."""
    clean = lambda c: words(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7FÀ-ÿŒœ]", " "))
    m = parts(spark, d).select("saison", "id", F.split(clean(F.col("nom")), " ").alias("w"))
    f = m.filter(F.col("w")[0] != "").select("saison", "id", F.col("w")[0].alias("prenom"), F.substring(F.element_at("w", -1), 1, 1).alias("ini"))
    f = f.groupBy("saison", "prenom", "ini").agg(F.count_distinct("id").alias("k"), F.min("id").alias("one"))
    l = sessions(spark, d).filter("not elimine_rattache and elimine is not null").select("saison", "numero", F.split(clean(F.col("elimine")), " ").alias("w")).filter((F.size("w") == 2) & (F.length(F.col("w")[1]) == 1))
    x = l.select("saison", "numero", F.col("w")[0].alias("prenom"), F.col("w")[1].alias("ini")).join(f, ["saison", "prenom", "ini"])
    return x.select("saison", "numero", F.col("k").alias("candidats"), F.when(F.col("k") == 1, F.col("one")).alias("id"))


@query(f"""{PS}, c as (select saison, split_part(nom, ' ', 1) as prenom, tribu, count(*) as k, min(id) as id from parts where nom is not null and tribu is not null group by all), h as (select saison, prenom from c group by all having sum(k) > 1)
 select c.saison, c.prenom, c.tribu, case when k = 1 then id end as id from c join h using (saison, prenom)""")
def x14_homonyms_by_tribe(spark, d):
    """Homonyms of a season told apart by their tribe, where each tribe has one; else nobody is chosen."""
    c = parts(spark, d).filter("nom is not null and tribu is not null").groupBy("saison", F.split_part("nom", F.lit(" "), F.lit(1)).alias("prenom"), "tribu").agg(F.count("*").alias("k"), F.min("id").alias("one"))
    c = c.withColumn("n", F.sum("k").over(Window.partitionBy("saison", "prenom"))).filter("n > 1")
    return c.select("saison", "prenom", "tribu", F.when(F.col("k") == 1, F.col("one")).alias("id"))


@query(f"""{PS}, v as (select distinct b.saison, b.numero, b.votant as id from ballots b where votant_ok and type = 'elimination'), h as (select v.saison, v.numero, split_part(p.nom, ' ', 1) as prenom, count(*) as k from v join parts p on p.saison = v.saison and p.id = v.id where p.nom is not null group by all),
 t as (select saison, split_part(nom, ' ', 1) as prenom, count(*) as n from parts where nom is not null group by all) select h.saison, h.numero, h.prenom, t.n - h.k as restants from h join t using (saison, prenom) where t.n > 1 and t.n - h.k = 1""")
def x15_left_by_exclusion(spark, d):
    """Homonyms of whom all but one voted under their own id: the label that is left means that one."""
    first = F.split_part("nom", F.lit(" "), F.lit(1)).alias("prenom")
    p = parts(spark, d).filter("nom is not null").select("saison", "id", first)
    t = p.groupBy("saison", "prenom").agg(F.count("*").alias("n")).filter("n > 1")
    v = ballots(spark, d).filter("votant_ok and type = 'elimination'").select("saison", "numero", F.col("votant").alias("id")).distinct()
    h = v.join(p, ["saison", "id"]).groupBy("saison", "numero", "prenom").agg(F.count("*").alias("k"))
    return h.join(t, ["saison", "prenom"]).filter("n - k = 1").select("saison", "numero", "prenom", (F.col("n") - F.col("k")).alias("restants"))


@query("""select ligne, case when laureat is not null or votes_pour is not null then 'jury' when votes is null or len(votes) = 0 then 'sortie' else 'elimination' end as genre from conseils""")
def x16_kind_of_session(spark, d):
    """What a session was, from what it holds: a jury, an exit without a vote, an elimination."""
    kind = F.when(F.col("laureat").isNotNull() | F.col("votes_pour").isNotNull(), "jury").when(F.col("votes").isNull() | (F.size("votes") == 0), "sortie").otherwise("elimination")
    return table(spark, d, "conseils").select("ligne", kind.alias("genre"))


@query(f"""{S}, a as (select saison, numero, max_by(votes_contre_annonce, (maj, ligne)) as annonce from (select saison, numero, votes_contre_annonce, maj, ligne from conseils) group by all), b as (select saison, numero, count(*) filter (where cible = elimine) as lu from ballots where type = 'elimination' group by all)
 select s.saison, s.numero, coalesce(s.votes_contre, b.lu) as retenu, case when s.votes_contre is null then 'lu' when b.lu is null then 'annonce' when s.votes_contre = b.lu then 'accord' when b.lu < s.votes_contre then 'manquants' else 'en_trop' end as etat from sess s left join b using (saison, numero) where s.type = 'elimination'""")
def x17_totals_reconciled(spark, d):
    """The announced votes against whoever left, beside those read."""
    b = ballots(spark, d).filter("type = 'elimination'").groupBy("saison", "numero").agg(F.count_if(F.coalesce(F.col("cible") == F.col("elimine"), F.lit(False))).alias("lu"))
    s = sessions(spark, d).filter("type = 'elimination'").select("saison", "numero", "votes_contre").join(b, ["saison", "numero"], "left")
    state = F.when(F.col("votes_contre").isNull(), "lu").when(F.col("lu").isNull(), "annonce").when(F.col("votes_contre") == F.col("lu"), "accord").when(F.col("lu") < F.col("votes_contre"), "manquants").otherwise("en_trop")
    return s.select("saison", "numero", F.coalesce(F.col("votes_contre").cast("bigint"), "lu").alias("retenu"), state.alias("etat"))


@query("""select saison, numero, second_tour.premier as premier, second_tour.second as second, tirage.contre as tire from (select saison, numero, max_by(second_tour, (maj, ligne)) as second_tour, max_by(tirage, (maj, ligne)) as tirage from (select saison, numero, second_tour, tirage, maj, ligne from conseils where second_tour is not null or tirage is not null) group by all)""")
def x18_second_rounds(spark, d):
    """Second rounds and draws of lots, of the last extraction that tells."""
    c = table(spark, d, "conseils").filter("second_tour is not null or tirage is not null")
    o = F.struct("maj", "ligne")
    pick = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), o))
    g = c.groupBy("saison", "numero").agg(pick("second_tour").alias("s"), pick("tirage").alias("t"))
    return g.select("saison", "numero", F.col("s.premier").alias("premier"), F.col("s.second").alias("second"), F.col("t.contre").alias("tire"))


@query(f"""{P}, d as (select doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) as h from documents where text is not null and trim(text) <> '') select h, min(doc_id) as garde, count(*) as n from d group by h having count(*) > 1""")
def x24_merged_by_content(spark, d):
    """Pages of the same content, whatever their case and spaces, under the first of them."""
    t = table(spark, d, "documents").filter("text is not null and trim(text) <> ''").select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\x0B\f\r]+", " "))).alias("h"))
    return t.groupBy("h").agg(F.min("doc_id").alias("garde"), F.count("*").alias("n")).filter("n > 1")


@query("""with n as (select libelle, len(string_split_regex(libelle, ' et | & ')) as k, list_transform(string_split_regex(libelle, ' et | & '), lambda x: trim(x)) as noms from fiches_wiki where libelle is not null), c as (select distinct nom from personnes)
 select libelle, k as morceaux, (select count(*) from (select unnest(n.noms) as x) q where x in (select nom from c)) = k as resolu from (select distinct * from n) n""")
def x23_labels_of_several_names(spark, d):
    """A label of several names is parted only if each part is a known name."""
    n = table(spark, d, "fiches_wiki").filter("libelle is not null").select("libelle").distinct().withColumn("noms", F.transform(F.split("libelle", " et | & "), lambda x: F.trim(x)))
    known = table(spark, d, "personnes").select(F.col("nom").alias("x"), F.lit(1).alias("ok")).distinct()
    g = n.select("libelle", F.explode("noms").alias("x")).join(known, "x", "left").groupBy("libelle").agg(F.count("*").alias("morceaux"), (F.count("ok") == F.count("*")).alias("resolu"))
    return g


# ---- functions on text and numbers -------------------------------------------------------------------


@query(f"""with v as (select ligne, trim(regexp_replace(regexp_replace(localisation, ',\\s*France$|\\s*\\([^)]*\\)$|\\.$', ''), '^(dép\\. |près de |vers |à |Habite |\\d{{5}} )', '')) as x from participations where localisation is not null) select ligne, r.code from v join ref_lieux r on r.libelle = v.x""")
def f02_places_in_canonical_form(spark, d):
    """A place without its country, postcode and small words, found in the list."""
    x = F.trim(F.regexp_replace(F.regexp_replace("localisation", r",\s*France$|\s*\([^)]*\)$|\.$", ""), r"^(dép\. |près de |vers |à |Habite |\d{5} )", ""))
    v = table(spark, d, "participations").filter("localisation is not null").select("ligne", x.alias("libelle"))
    return v.join(table(spark, d, "ref_lieux").select("libelle", "code"), "libelle").select("ligne", "code")


@query(_values("texte, sort", [("Éliminée au 3e conseil", "elimine_conseil"), ("Abandon sur raison médicale", "abandon_medical"), ("Abandonne", "abandon_volontaire"), ("Gagnante", "vainqueur"), ("Éliminé", "elimine"), ("Parti", None), (None, None)]))
def f04_outcome_of_a_text(spark, d):
    t = spark.createDataFrame([(x,) for x in ("Éliminée au 3e conseil", "Abandon sur raison médicale", "Abandonne", "Gagnante", "Éliminé", "Parti", None)], "texte string")
    return t.select("texte", K.outcome(F.col("texte"), OUTCOMES).alias("sort"))


@query("""select ligne, pos, regexp_matches(coalesce(cible, ''), '[[:alpha:]]') as vote from (select ligne, unnest(votes).cible as cible, generate_subscripts(votes, 1) - 1 as pos from conseils)""")
def f05_cells_that_are_votes(spark, d):
    """Whether a target cell is a vote: it holds a letter."""
    c = table(spark, d, "conseils").select("ligne", F.posexplode("votes").alias("pos", "v"))
    return c.select("ligne", "pos", F.coalesce("v.cible", F.lit("")).rlike(r"\p{L}").alias("vote"))


@query("""select id, upper(replace(replace(strip_accents(prenom), '-', ' '), '''', ' ')) as cle from personnes where prenom is not null""")
def f06_key_of_a_first_name(spark, d):
    p = F.upper(F.regexp_replace(fold(F.col("prenom")), "[-']", " "))
    return table(spark, d, "personnes").filter("prenom is not null").select("id", p.alias("cle"))


@query("""select fiche, regexp_extract(libelle, '^(.+) ([A-Z])\\.?$', 1) as nom, regexp_extract(libelle, '^(.+) ([A-Z])\\.?$', 2) as initiale from fiches_wiki where regexp_matches(libelle, '^(.+) ([A-Z])\\.?$')""")
def f07_name_and_initial(spark, d):
    m = r"^(.+) ([A-Z])\.?$"
    return table(spark, d, "fiches_wiki").filter(F.col("libelle").rlike(m)).select("fiche", F.regexp_extract("libelle", m, 1).alias("nom"), F.regexp_extract("libelle", m, 2).alias("initiale"))


@query("""select ligne, replace(replace(profession, 'medecin', 'médecin'), 'ecole', 'école') as corrige from participations where profession is not null""")
def f08_misspellings_replaced(spark, d):
    """A table of misspellings applied in its order to a text."""
    c = F.col("profession")
    for wrong, right in (("medecin", "médecin"), ("ecole", "école")):
        c = F.replace(c, F.lit(wrong), F.lit(right))
    return table(spark, d, "participations").filter("profession is not null").select("ligne", c.alias("corrige"))


@query("""select doc_id, regexp_replace(regexp_replace(regexp_replace(text, ' ([;:!?»])', chr(160) || '\\1', 'g'), '''', '’', 'g'), '(\\d)-(\\d)', '\\1–\\2', 'g') as texte from documents where text is not null and lang = 'fr'""")
def f10_french_typography(spark, d):
    """Spaces that don't break before high marks, typographic apostrophes, intervals with a dash."""
    c = F.regexp_replace("text", r" ([;:!?»])", "\u00a0$1")
    c = F.regexp_replace(F.replace(c, F.lit("'"), F.lit("’")), r"(\d)-(\d)", "$1–$2")
    return table(spark, d, "documents").filter("text is not null and lang = 'fr'").select("doc_id", c.alias("texte"))


_UNITS = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dix-sept dix-huit dix-neuf".split()
_TENS = {20: "vingt", 30: "trente", 40: "quarante", 50: "cinquante", 60: "soixante", 80: "quatre-vingt"}


def _in_letters(n: int) -> str:
    """French words of a number below 100."""
    if n < 20:
        return _UNITS[n]
    base = n // 20 * 20 if n >= 60 else n // 10 * 10
    rest = n - base
    if rest == 0:
        return _TENS[base] + ("s" if base == 80 else "")
    return _TENS[base] + ("-et-" if rest in (1, 11) and base < 80 else "-") + _UNITS[rest]


@query(_values("n, mots", [(0, "zéro"), (16, "seize"), (21, "vingt-et-un"), (55, "cinquante-cinq"), (70, "soixante-dix"), (71, "soixante-et-onze"), (80, "quatre-vingts"), (81, "quatre-vingt-un"), (97, "quatre-vingt-dix-sept")]))
def f11_numbers_in_words(spark, d):
    words_ = F.array(*[F.lit(_in_letters(i)) for i in range(100)])
    n = spark.createDataFrame([(i,) for i in (0, 16, 21, 55, 70, 71, 80, 81, 97)], "n int")
    return n.select("n", F.element_at(words_, F.col("n") + 1).alias("mots"))


@query(_values("id, texte, lien", [(1, "a & b", "https://exemple.org/x"), (2, "gras et note", None), (3, "2 < 3", None)]))
def f13_tags_and_links(spark, d):
    """Entities undone, tags taken out; a link only if it is one."""
    t = spark.createDataFrame([(1, "a &amp; b", "https://exemple.org/x"), (2, "<b>gras</b>  et <i>note</i>", "javascript:x"), (3, "2 &lt; 3", "https://a b")], "id int, t string, l string")
    return t.select("id", D.without_tags(F.col("t")).alias("texte"), D.web_link(F.col("l")).alias("lien"))


@query("""select a.id as a, b.id as b from (select id, prenom, nom, substr(nom, length(prenom) + 2) as f from personnes where prenom is not null) a join (select id, prenom, substr(nom, length(prenom) + 2) as f from personnes where prenom is not null) b on a.prenom = b.prenom and a.id < b.id and levenshtein(a.f, b.f) <= 1""")
def f15_one_letter_apart(spark, d):
    """People of one first name whose family names are one letter apart: they meet under a word of which a letter was taken out."""
    from ..functions.text import deletions

    p = table(spark, d, "personnes").filter("prenom is not null").select("id", "prenom", F.expr("substring(nom, length(prenom) + 2)").alias("f"))
    k = p.select("id", "prenom", "f", F.explode(deletions(F.col("f"))).alias("k"))
    x = k.select("prenom", "k", F.col("id").alias("a"), F.col("f").alias("fa")).join(k.select("prenom", "k", F.col("id").alias("b"), F.col("f").alias("fb")), ["prenom", "k"])
    return x.filter((F.col("a") < F.col("b")) & (F.levenshtein("fa", "fb") <= 1)).select("a", "b").distinct()


@query("""select id, 'saison-' || numero as adresse from saisons where numero is not null""")
def f16_address_of_a_season(spark, d):
    return table(spark, d, "saisons").filter("numero is not null").select("id", F.concat(F.lit("saison-"), F.col("numero").cast("string")).alias("adresse"))


@query(_values("n, milliers, decimal, signe, p", [(0.0004, "0", "0,0", "+0,0", "0,0004"), (1234567.0, "1 234 567", "1234567,0", "+1234567,0", "> 1"), (-3.25, "−3", "−3,3", "−3,3", "-"), (0.04, "0", "0,0", "+0,0", "0,04")]))
def f17_numbers_as_text(spark, d):
    """Thousands, one decimal, a sign and a p-value of as many decimals as it needs."""
    x = F.col("n")
    one = F.regexp_replace(F.format_string("%.1f", F.round(x, 1)), r"^-0\.0$", "0.0")
    dec = F.translate(F.translate(one, ".", ","), "-", "−")
    whole = F.translate(F.translate(F.format_number(F.round(x), 0), ",", " "), "-", "−")
    p = F.when(x < 0, "-").when(x > 1, "> 1").when(x < 0.001, F.translate(F.format_string("%.4f", x), ".", ",")).otherwise(F.translate(F.format_string("%.2f", x), ".", ","))
    t = spark.createDataFrame([(0.0004,), (1234567.0,), (-3.25,), (0.04,)], "n double")
    return t.select("n", whole.alias("milliers"), dec.alias("decimal"), F.when(x >= 0, F.concat(F.lit("+"), dec)).otherwise(dec).alias("signe"), p.alias("p"))


@query("""select id, case when length(titre || ' (' || annee || ', ' || pays || ')') <= 40 then titre || ' (' || annee || ', ' || pays || ')' when length(titre || ' (' || annee || ')') <= 40 then titre || ' (' || annee || ')' else titre end as court from saisons where titre is not null""")
def f18_first_that_fits(spark, d):
    """The longest of several texts that keeps within a length."""
    t = F.concat("titre", F.lit(" ("), F.col("annee").cast("string"))
    long, mid = F.concat(t, F.lit(", "), "pays", F.lit(")")), F.concat(t, F.lit(")"))
    return table(spark, d, "saisons").filter("titre is not null").select("id", F.when(F.length(long) <= 40, long).when(F.length(mid) <= 40, mid).otherwise(F.col("titre")).alias("court"))


@query("""select p_partkey, round_even(p_retailprice, 0) as pair, round(p_retailprice, 0) as haut from part""")
def f20_rounding(spark, d):
    """Halves to the even number, and halves away from zero."""
    x = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", D.half_even(x, 0).alias("pair"), F.round(x, 0).alias("haut"))


@query("""select p_partkey, round(log2(p_size), 9) as l2, round(exp(-p_size / 10.0::double), 9) as e, least(30, greatest(5, p_size)) as borne from part""")
def f22_logs_and_bounds(spark, d):
    x = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.round(F.log2(x.cast("double")), 9).alias("l2"), F.round(F.exp(-x / 10.0), 9).alias("e"), F.least(F.lit(30), F.greatest(F.lit(5), x)).alias("borne"))


@query(f"""{P} select annee // 10 * 10 as decennie, cast(least(100, round(100.0::double * jour / duree_jours / 20) * 20) as integer) as pas, count(*) as n from parts where annee is not null and jour is not null group by all""")
def f23_integer_buckets(spark, d):
    p = parts(spark, d).filter("annee is not null and jour is not null")
    step = F.least(F.lit(100), (F.round(100.0 * F.col("jour") / F.col("duree_jours") / 20) * 20).cast("int"))
    return p.groupBy((F.floor(F.col("annee") / 10) * 10).cast("int").alias("decennie"), step.alias("pas")).agg(F.count("*").alias("n"))


@query(f"""{P} select saison, id, case when votes_recus is null then 'inconnu' when votes_recus = 0 then 'aucune' when votes_recus = 1 then 'une' when votes_recus <= 3 then '2-3' else '4+' end as voix from parts""")
def f24_labels_of_votes(spark, d):
    v = F.col("votes_recus")
    return parts(spark, d).select("saison", "id", F.when(v.isNull(), "inconnu").when(v == 0, "aucune").when(v == 1, "une").when(v <= 3, "2-3").otherwise("4+").alias("voix"))


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round ticks from ``low`` to ``high``: the finest step of 1, 2 or 5 times a power of ten that needs at most ``most`` of them."""
    import math

    span = max(high - low, 1e-12)
    power = math.floor(math.log10(span / most))
    step = next(m * 10.0**p for p in (power, power + 1) for m in (1, 2, 5) if math.floor(high / (m * 10.0**p)) - math.ceil(low / (m * 10.0**p)) + 1 <= most)
    return [round(k * step, 10) for k in range(math.ceil(low / step), math.floor(high / step) + 1)]


@query(_values("bas, haut, reperes", [(0.0, 100.0, "0.0 20.0 40.0 60.0 80.0 100.0"), (3.0, 17.0, "5.0 10.0 15.0"), (0.0, 1.0, "0.0 0.2 0.4 0.6 0.8 1.0")]))
def f25_round_ticks(spark, d):
    rows = [(a, b, " ".join(map(str, ticks(a, b)))) for a, b in ((0.0, 100.0), (3.0, 17.0), (0.0, 1.0))]
    return spark.createDataFrame(rows, "bas double, haut double, reperes string")


# ---- cleaning passes ---------------------------------------------------------------------------------


@query("""with c as (select prenom, count(*) as k, min(id) as id from personnes where prenom is not null group by prenom), f as (select fiche, trim(libelle) as libelle from fiches_wiki where libelle is not null and not contains(trim(libelle), ' ')) select f.fiche, c.id from f join c on c.prenom = f.libelle where c.k = 1""")
def n01_first_name_of_one(spark, d):
    """A bare first name means somebody only if one person bears it."""
    c = table(spark, d, "personnes").filter("prenom is not null").groupBy(F.col("prenom").alias("libelle")).agg(F.count("*").alias("k"), F.min("id").alias("id")).filter("k = 1")
    f = table(spark, d, "fiches_wiki").select("fiche", F.trim("libelle").alias("libelle")).filter(~F.col("libelle").contains(" "))
    return f.join(c, "libelle").select("fiche", "id")


@query(f"""{P}, c as (select saison, split_part(nom, ' ', 1) as prenom, count(*) as k, min(id) as id from parts where nom is not null group by all) select saison, prenom, id from c where k = 1""")
def n02_first_name_within_season(spark, d):
    c = parts(spark, d).filter("nom is not null").groupBy("saison", F.split_part("nom", F.lit(" "), F.lit(1)).alias("prenom")).agg(F.count("*").alias("k"), F.min("id").alias("id"))
    return c.filter("k = 1").select("saison", "prenom", "id")


@query(f"""{P}, v as (select id as saison, unnest(vainqueurs) as nom from saisons) select p.saison, p.id, case when v.nom is not null then 'vainqueur' when p.sort = 'vainqueur' then null else p.sort end as sort, case when v.nom is not null or p.sort = 'finaliste' then p.duree_jours else p.jour end as jour from parts p left join (select distinct * from v) v on v.saison = p.saison and v.nom = p.nom""")
def n04_winners_aligned(spark, d):
    """Declared winners override the outcome; winners and finalists leave on the last day."""
    v = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.explode("vainqueurs").alias("nom")).distinct().withColumn("v", F.lit(True))
    p = parts(spark, d).join(v, ["saison", "nom"], "left")
    won = F.col("v").isNotNull()
    return p.select("saison", "id", F.when(won, "vainqueur").when(F.col("sort") == "vainqueur", None).otherwise(F.col("sort")).alias("sort"), F.when(won | F.coalesce(F.col("sort") == "finaliste", F.lit(False)), F.col("duree_jours")).otherwise(F.col("jour")).alias("jour"))


@query(f"""{P} select saison, id, case when sort = 'vainqueur' then 1 else count(*) filter (where sort = 'vainqueur') over (partition by saison) + rank() over (partition by saison, coalesce(sort = 'vainqueur', false) order by coalesce(jour, 0) desc) end as rang from parts""")
def n05_winners_rank_first(spark, d):
    """Winners share the first rank; the others follow by their last day."""
    w = Window.partitionBy("saison")
    won = F.coalesce(F.col("sort") == "vainqueur", F.lit(False))
    p = parts(spark, d).withColumn("g", won).withColumn("k", F.count_if(won).over(w))
    rest = F.rank().over(Window.partitionBy("saison", "g").orderBy(F.coalesce("jour", F.lit(0)).desc()))
    return p.select("saison", "id", F.when(F.col("g"), F.lit(1)).otherwise(F.col("k") + rest).alias("rang"))


@query(f"""{P} select saison, id, case when en_cours and sort is null then null else jour end as jour, case when en_cours then null else votes_recus end as votes from parts""")
def n06_season_in_progress(spark, d):
    return parts(spark, d).select("saison", "id", F.when(~(F.col("en_cours") & F.col("sort").isNull()), F.col("jour")).alias("jour"), F.when(~F.col("en_cours"), F.col("votes_recus")).alias("votes"))


@query(f"""{P}, n as (select saison, id, classement, count(*) over (partition by saison) as n, count(*) over (partition by saison, classement) as k from parts) select saison, id, case when classement between 1 and n then classement end as rang, classement is not null and k > 1 as double from n""")
def n07_impossible_ranks(spark, d):
    """Ranks beyond the group's size are dropped; ranks given twice are reported."""
    p = parts(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("saison"))).withColumn("k", F.count("*").over(Window.partitionBy("saison", "classement")))
    return p.select("saison", "id", F.when(F.col("classement").between(1, F.col("n")), F.col("classement")).alias("rang"), (F.col("classement").isNotNull() & (F.col("k") > 1)).alias("double"))


@query(f"""{P} select p.saison, p.id, coalesce(p.genre, q.genre) as genre, p.genre is not null and q.genre is not null and p.genre <> q.genre as desaccord from parts p left join personnes q using (id)""")
def n08_only_empty_filled(spark, d):
    """An empty field filled from the person's own row; where both tell, the table wins and the difference is reported."""
    q = table(spark, d, "personnes").select("id", F.col("genre").alias("g"))
    p = parts(spark, d).select("saison", "id", "genre").join(q, "id", "left")
    return p.select("saison", "id", F.coalesce("genre", "g").alias("genre"), F.coalesce(F.col("genre") != F.col("g"), F.lit(False)).alias("desaccord"))


@query(f"""{P}, f as (select {FOLDED.format("regexp_replace(libelle, '[^[:ascii:]À-ÿŒœ]', ' ', 'g')")} as w, age, min(ville) as ville, count(distinct ville) as k from fiches_wiki where libelle is not null and ville is not null group by all), a as (select w, min(ville) as ville from f group by w having count(*) = 1 and max(k) = 1), m as (select saison, id, age, {FOLDED.format("regexp_replace(coalesce(nom, ''), '[^[:ascii:]À-ÿŒœ]', ' ', 'g')")} as w from parts)
 select m.saison, m.id, coalesce(a.ville, b.ville) as ville, case when a.ville is not null then 'nom' else 'prenom_age' end as cle from m left join a on a.w = m.w left join (select w, age, ville from f where k = 1 and not contains(w, ' ')) b on b.w = split_part(m.w, ' ', 1) and b.age = m.age where coalesce(a.ville, b.ville) is not null""")
def n09_residence_by_two_keys(spark, d):
    """A residence from another source: by the full name, else by first name and age."""
    clean = lambda c: words(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7FÀ-ÿŒœ]", " "))
    f = table(spark, d, "fiches_wiki").filter("libelle is not null and ville is not null").groupBy(clean(F.col("libelle")).alias("w"), "age").agg(F.min("ville").alias("ville"), F.count_distinct("ville").alias("k"))
    a = f.groupBy("w").agg(F.count("*").alias("n"), F.max("k").alias("k"), F.min("ville").alias("va")).filter("n = 1 and k = 1").select("w", "va")
    b = f.filter((F.col("k") == 1) & ~F.col("w").contains(" ")).select(F.col("w").alias("p"), "age", F.col("ville").alias("vb"))
    m = parts(spark, d).select("saison", "id", "age", clean(F.col("nom")).alias("w")).withColumn("p", F.split_part("w", F.lit(" "), F.lit(1)))
    x = m.join(a, "w", "left").join(b, ["p", "age"], "left")
    return x.filter("va is not null or vb is not null").select("saison", "id", F.coalesce("va", "vb").alias("ville"), F.when(F.col("va").isNotNull(), "nom").otherwise("prenom_age").alias("cle"))


@query("""select localisation as valeur, count(*) as n, max(r.code) as code from participations p left join ref_lieux r on r.libelle = p.localisation where localisation is not null group by localisation""")
def n10_places_known_or_reported(spark, d):
    r = table(spark, d, "ref_lieux").select(F.col("libelle").alias("valeur"), "code")
    v = table(spark, d, "participations").filter("localisation is not null").groupBy(F.col("localisation").alias("valeur")).agg(F.count("*").alias("n"))
    return v.join(r, "valeur", "left").select("valeur", "n", "code")


@query(f"""{P}, t as (select id as saison, unnest(tribus).nom as nom from saisons), x as (select p.saison, p.tribu, count(*) as k, min(t.nom) as nom from (select distinct saison, tribu from parts where tribu is not null) p join t on t.saison = p.saison and levenshtein(t.nom, p.tribu) <= 1 group by all) select saison, tribu, nom from x where k = 1""")
def n11_tribe_one_letter_off(spark, d):
    """A typed tribe is the declared one at an edit or less, if there is one only."""
    t = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.explode("tribus.nom").alias("nom"))  # a season's tribes
    p = parts(spark, d).filter("tribu is not null").select("saison", "tribu").distinct()
    x = p.join(t, "saison").filter(F.levenshtein("nom", "tribu") <= 1).groupBy("saison", "tribu").agg(F.count("*").alias("k"), F.min("nom").alias("nom"))
    return x.filter("k = 1").select("saison", "tribu", "nom")


@query("""with s as (select ligne, saison, id, generate_subscripts(parcours, 1) - 1 as pas, unnest(parcours) as e, jour_sortie, len(parcours) as n from participations where retire_le is null), p as (select saison, min(e.jour_debut) as lo, max(e.jour_debut) as hi from s where pas = 1 and e.jour_debut is not null group by saison)
 select s.ligne, s.pas, coalesce(s.e.jour_debut, case when s.pas = 0 then 1 when s.pas = 1 and p.lo = p.hi then p.lo end) as debut, coalesce(s.e.jour_fin, case when s.pas = s.n - 1 then s.jour_sortie end) as fin from s left join p using (saison)""")
def n13_dates_where_proven(spark, d):
    """Missing days of a path: the first step begins on day 1, a later one where all dated peers agree, the last ends with the exit."""
    s = table(spark, d, "participations").filter("retire_le is null").select("ligne", "saison", "jour_sortie", F.size("parcours").alias("n"), F.posexplode("parcours").alias("pas", "e"))
    p = s.filter("pas = 1 and e.jour_debut is not null").groupBy("saison").agg(F.min("e.jour_debut").alias("lo"), F.max("e.jour_debut").alias("hi"))
    s = s.join(p, "saison", "left")
    start = F.coalesce("e.jour_debut", F.when(F.col("pas") == 0, 1).when((F.col("pas") == 1) & (F.col("lo") == F.col("hi")), F.col("lo")))
    return s.select("ligne", "pas", start.alias("debut"), F.coalesce("e.jour_fin", F.when(F.col("pas") == F.col("n") - 1, F.col("jour_sortie"))).alias("fin"))


@query("""select ligne, coalesce(parcours[1].tribu, tribu) as tribu, coalesce(parcours[1].couleur, couleur) as couleur from participations""")
def n14_tribe_at_the_start(spark, d):
    first = F.when(F.size("parcours") > 0, F.element_at("parcours", 1))
    return table(spark, d, "participations").select("ligne", F.coalesce(first["tribu"], "tribu").alias("tribu"), F.coalesce(first["couleur"], "couleur").alias("couleur"))


@query(f"""{P}, c(saison, champ, valeur) as (values ('sp1', 'duree_jours', 40), ('zzz', 'duree_jours', 1)) select c.saison, c.valeur, (select count(*) from parts p where p.saison = c.saison) as touchees from c""")
def n15_manual_corrections(spark, d):
    """Corrections by hand with the number of rows that each one meets; one that meets none is reported with 0."""
    c = spark.createDataFrame([("sp1", 40), ("zzz", 1)], "saison string, valeur int")
    n = parts(spark, d).join(F.broadcast(c.select("saison")), "saison").groupBy("saison").agg(F.count("*").alias("k"))  # two rows
    return c.join(n, "saison", "left").select("saison", "valeur", F.coalesce("k", F.lit(0)).alias("touchees"))


@query("""select fiche, trim(regexp_replace(metier, '\\s*\\([^()]*\\)\\s*$', '')) as metier from fiches_wiki where regexp_matches(metier, '\\([^()]*\\)\\s*$')""")
def n16_bracket_at_the_end(spark, d):
    m = r"\s*\([^()]*\)\s*$"
    return table(spark, d, "fiches_wiki").filter(F.col("metier").rlike(r"\([^()]*\)\s*$")).select("fiche", F.trim(F.regexp_replace("metier", m, "")).alias("metier"))


@query(f"""{PS}, a as (select saison, numero, votant as id from ballots where votant_ok), m as (select saison, split_part(nom, ' ', 1) as prenom, id from parts where nom is not null) select m.saison, a.numero, m.prenom, min(m.id) as id from m join a on a.saison = m.saison and a.id = m.id group by all having count(distinct m.id) = 1""")
def n18_among_those_allowed(spark, d):
    """A first name resolved among those who voted that evening, if it leaves one."""
    a = ballots(spark, d).filter("votant_ok").select("saison", "numero", F.col("votant").alias("id")).distinct()
    m = parts(spark, d).filter("nom is not null").select("saison", "id", F.split_part("nom", F.lit(" "), F.lit(1)).alias("prenom"))
    return a.join(m, ["saison", "id"]).groupBy("saison", "numero", "prenom").agg(F.count_distinct("id").alias("k"), F.min("id").alias("id")).filter("k = 1").drop("k")


@query("""select a.saison, a.prefixe, a.id from (select saison, substr(id, 1, 5) as prefixe, count(distinct id) as k, min(id) as id from participations where length(id) >= 5 group by all) a where k = 1""")
def n20_prefix_of_one(spark, d):
    """Beginnings of ids that leave one participant of a season."""
    p = table(spark, d, "participations").filter(F.length("id") >= 5).groupBy("saison", F.substring("id", 1, 5).alias("prefixe")).agg(F.count_distinct("id").alias("k"), F.min("id").alias("id"))
    return p.filter("k = 1").select("saison", "prefixe", "id")


@query("""select saison, dense_rank() over (partition by saison order by date_trunc('day', publie_le)) as episode, doc_id from documents where saison is not null and publie_le is not null""")
def n25_episodes_by_date(spark, d):
    """Pages without a number take the rank of their day."""
    w = Window.partitionBy("saison").orderBy(F.date_trunc("day", "publie_le"))
    return table(spark, d, "documents").filter("saison is not null and publie_le is not null").select("saison", F.dense_rank().over(w).alias("episode"), "doc_id")


@query(_values("id, saison, valeur", [(1, "S1", "A"), (1, "S2", "B"), (1, "S3", "C"), (2, "S1", "D"), (2, "S2", "D"), (2, "S3", "D")]))
def n28_value_by_season(spark, d):
    """A cell of values told apart by season; the one without a season holds for the others."""
    t = spark.createDataFrame([(1, "A (S1)<br>B (S2)<br>C"), (2, "D")], "id int, cell string")
    x = t.select("id", F.explode(F.split("cell", "<br>")).alias("v")).select("id", F.regexp_extract("v", r"\((S\d+)\)$", 1).alias("s"), F.trim(F.regexp_replace("v", r"\((S\d+)\)$", "")).alias("v"))
    g = x.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("m"))  # the values of a cell
    s = g.select("id", "m", F.explode(F.array(*[F.lit(f"S{i}") for i in (1, 2, 3)])).alias("saison"))
    return s.select("id", "saison", F.coalesce(F.try_element_at("m", F.col("saison")), F.try_element_at("m", F.lit(""))).alias("valeur"))


@query("""with l as (select doc_id, text, regexp_replace(split_part(text, chr(10), 1), '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') as ligne from documents where text is not null) select doc_id, lower(regexp_replace(ligne, '[ \\t\\r]+', '_', 'g')) as page, substr(sha256(text), 1, 12) as empreinte from l where length(ligne) between 1 and 40""")
def n29_page_names(spark, d):
    """The first line as a page's name in one form, with the page's fingerprint."""
    line = F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"^[ \t\r]+|[ \t\r]+$", "")
    return table(spark, d, "documents").filter(F.col("text").isNotNull() & F.length(line).between(1, 40)).select("doc_id", F.lower(F.regexp_replace(line, r"[ \t\r]+", "_")).alias("page"), F.substring(F.sha2("text", 256), 1, 12).alias("empreinte"))


@query(f"""{P} select id, sum(vi) as gagnees, sum(jour) as jours, round(sum(vi) / cast(sum(jour) as double), 6) as taux from parts where vi is not null and jour is not null group by id having sum(jour) > 0""")
def n33_sums_before_rates(spark, d):
    """A rate over several seasons is the sum of the numerators over that of the denominators."""
    g = parts(spark, d).filter("vi is not null and jour is not null").groupBy("id").agg(F.sum("vi").alias("gagnees"), F.sum("jour").alias("jours")).filter("jours > 0")
    return g.select("id", "gagnees", "jours", R6(F.col("gagnees") / F.col("jours"), "taux"))


_FACETS = ["vi", "vc", "votes_recus", "jour"]


@query(f"""{P}, b as (select * from reg where {" and ".join(f"{c} is not null" for c in _FACETS)}) {" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from b" for i, a in enumerate(_FACETS) for b in _FACETS[i + 1 :])}""")
def n34_correlations_of_facets(spark, d):
    b = parts(spark, d).filter(~F.col("speciale") & ~F.col("annulee") & ~F.col("en_cours")).dropna(subset=_FACETS)
    two = [(x, y) for i, x in enumerate(_FACETS) for y in _FACETS[i + 1 :]]
    one = b.agg(*[F.corr(x, y).alias(f"{x}_{y}") for x, y in two])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), R6(F.col(f"{x}_{y}"), "r")) for x, y in two])))


@query(f"""{P} select id, count(*) filter (where sort = 'vainqueur') as titres, count(*) filter (where sort in ('vainqueur', 'finaliste')) as finales, string_agg(saison, ' ' order by annee, saison) as editions from parts where annee is not null group by id having count(*) filter (where sort in ('vainqueur', 'finaliste')) > 0""")
def n35_published_row(spark, d):
    fin = F.coalesce(F.col("sort").isin("vainqueur", "finaliste"), F.lit(False))
    g = parts(spark, d).filter("annee is not null").groupBy("id").agg(F.count_if(F.coalesce(F.col("sort") == "vainqueur", F.lit(False))).alias("titres"), F.count_if(fin).alias("finales"), F.array_sort(F.collect_list(F.struct("annee", "saison"))).alias("e")).filter("finales > 0")
    return g.select("id", "titres", "finales", F.array_join(F.transform("e", lambda x: x["saison"]), " ").alias("editions"))


@query(f"""{P} select saison, id, case when sort is null then case when genre = 'f' then 'Partie' else 'Parti' end when starts_with(sort, 'elimine') then case when genre = 'f' then 'Éliminée' else 'Éliminé' end when starts_with(sort, 'abandon') then 'Abandon' else sort end as libelle from parts""")
def n36_label_with_fallback(spark, d):
    by = lambda m, f: F.when(F.col("genre") == "f", f).otherwise(m)
    s = F.col("sort")
    return parts(spark, d).select("saison", "id", F.when(s.isNull(), by("Parti", "Partie")).when(s.startswith("elimine"), by("Éliminé", "Éliminée")).when(s.startswith("abandon"), "Abandon").otherwise(s).alias("libelle"))


@query(f"""{S} select saison, numero, cible as id, count(*) as recues from ballots where complet and type = 'elimination' and cible_ok group by all""")
def n38_votes_received(spark, d):
    return ballots(spark, d).filter("complet and type = 'elimination' and cible_ok").groupBy("saison", "numero", F.col("cible").alias("id")).agg(F.count("*").alias("recues"))


@query(f"""{PS} select saison, jour, string_agg(id, ',' order by id) as sortis from parts where jour is not null and sort is not null group by all""")
def n39_sets_by_day(spark, d):
    """Those who left on a day, as a set."""
    g = parts(spark, d).filter("jour is not null and sort is not null").groupBy("saison", "jour").agg(F.sort_array(F.collect_set("id")).alias("s"))
    return g.select("saison", "jour", F.array_join("s", ",").alias("sortis"))


@query(f"""{PS}, m as (select saison, split_part(nom, ' ', 1) as prenom, count(*) as k from parts where nom is not null group by all) select case when m.k is null then 'inconnu' when m.k > 1 then 'homonyme' else 'resolu' end as etat, count(*) as n from sess s left join m on m.saison = s.saison and m.prenom = split_part(s.elimine, ' ', 1) where s.elimine_rattache is false and s.elimine is not null group by 1""")
def n40_why_unresolved(spark, d):
    m = parts(spark, d).filter("nom is not null").groupBy("saison", F.split_part("nom", F.lit(" "), F.lit(1)).alias("prenom")).agg(F.count("*").alias("k"))
    s = sessions(spark, d).filter("not elimine_rattache and elimine is not null").select("saison", F.split_part("elimine", F.lit(" "), F.lit(1)).alias("prenom"))
    return s.join(m, ["saison", "prenom"], "left").groupBy(F.when(F.col("k").isNull(), "inconnu").when(F.col("k") > 1, "homonyme").otherwise("resolu").alias("etat")).agg(F.count("*").alias("n"))


@query(f"""{P} select saison, case when p >= 99.9 then 'complet' when p >= 80 then 'presque' when p >= 50 then 'partiel' else 'faible' end as niveau from (select saison, 100.0 * count(age) / count(*) as p from parts group by saison)""")
def n42_levels_of_completeness(spark, d):
    p = parts(spark, d).groupBy("saison").agg((100.0 * F.count("age") / F.count("*")).alias("p"))
    return p.select("saison", F.when(F.col("p") >= 99.9, "complet").when(F.col("p") >= 80, "presque").when(F.col("p") >= 50, "partiel").otherwise("faible").alias("niveau"))


@query(f"""{P}, m as (select id as saison, unnest(mecaniques) as nature from saisons), g as (select nature, p.id, sum(p.vi) as v from m join parts p using (saison) where p.vi > 0 group by all), r as (select *, rank() over (partition by nature order by v desc) as r, count(*) over (partition by nature) as n from g)
 select nature, n as gagnants, v as record, count(*) as detenteurs, min(id) as premier from r where r = 1 group by all""")
def v03_contest_cards(spark, d):
    """A card for each mechanic: winners, the record and those who share it."""
    m = table(spark, d, "saisons").select(F.col("id").alias("saison"), F.explode("mecaniques").alias("nature"))
    g = m.join(parts(spark, d).filter("vi > 0").select("saison", "id", "vi"), "saison").groupBy("nature", "id").agg(F.sum("vi").alias("v"))
    top = g.groupBy("nature").agg(F.max("v").alias("record"), F.count("*").alias("gagnants"))
    x = g.join(top, "nature").filter("v = record")
    return x.groupBy("nature", "gagnants", "record").agg(F.count("*").alias("detenteurs"), F.min("id").alias("premier"))


QUERIES = Q
