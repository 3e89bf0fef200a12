"""Null models on sessions and seasons: hash-driven draws, compared with what was observed, with their SQL.

Every group of a null model is a session, a season or a series of years: bounded, so its draws are made where
the group stands and one number a draw leaves it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions.draws import places
from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, latest, parts, regular, sessions
from ..session import cut, java_function, spread, table
from . import statistics as S
from .queries_statistics import DRAWS, P, R6, _first, _spread

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PS = f"with {PARTS_SQL}, {SESSIONS_SQL}"
_RECORD = """, m as (select avg(x) as e, stddev_samp(x) as s, count(*) as n from x)
select round(o.x, 6) as observed, round(e, 6) as expected, round(s, 6) as sd, round(case when s > 1e-12 then (o.x - e) / s end, 5) as z, round(((select count(*) from x, o, m where abs(x.x - m.e) >= abs(o.x - m.e) - 1e-12) + 1) / cast(n + 1 as double), 6) as p, n from o, m"""


def _record(observed: DataFrame, draws: DataFrame, slack: float = 1e-12) -> DataFrame:
    t = S.permutation_test(observed, draws, slack)
    return t.select(R6(F.col("observed"), "observed"), R6(F.col("expected"), "expected"), R6(F.col("sd"), "sd"), F.round("z", 5).alias("z"), R6(F.col("p"), "p"), "n")


# ---- one member drawn a group ------------------------------------------------------------------------


def _drawn_sql(ctes: str, seed: str) -> str:
    """``c`` (saison, numero, id, n, out) of ``ctes``: groups where one is out, against one drawn evenly."""
    return f"""{ctes}, k as (select saison, numero from c where n is not null group by all having sum(out) = 1 and count(*) >= 2), r as (select c.* from c join k using (saison, numero) where n is not null), o as (select avg(n) as x from r where out = 1),
 w as (select d.draw, r.n, row_number() over (partition by d.draw, saison, numero order by md5('{seed}|' || d.draw || '|' || saison || '|' || numero || '|' || id)) as i from r, (select unnest(range(1, {DRAWS + 1})) as draw) d), x as (select draw, avg(n) as x from w where i = 1 group by draw){_RECORD}"""


def _drawn(c: DataFrame, seed: str) -> DataFrame:
    """One of each group drawn evenly, ``DRAWS`` times, against the one that was out: the mean of ``n``."""
    c = c.filter("n is not null")
    k = c.groupBy("saison", "numero").agg(F.sum("out").alias("o"), F.count("*").alias("m")).filter("o = 1 and m >= 2").select("saison", "numero")
    r = cut(c.join(k, ["saison", "numero"]).select("saison", "numero", "id", F.col("n").cast("double").alias("n"), "out"))
    key = F.concat_ws("|", "saison", F.col("numero").cast("string"), "id")
    g = _spread(r, "saison", "numero").groupBy("saison", "numero").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "n"))).alias("m")).select(F.col("m.key").alias("keys"), F.col("m.n").alias("ns"))
    return _record(r.filter("out = 1").agg(F.avg("n").alias("x")), cut(S.null_draws(g, "keys", DRAWS, seed, _first)))


_VOTERS_SQL = "v as (select distinct b.saison, b.numero, b.votant as id, case when b.votant = b.elimine then 1 else 0 end as out from ballots b where b.type = 'elimination' and b.complet and b.votant_ok)"


def _voters(spark, d) -> DataFrame:
    """(saison, numero, id, out) of the voters of the sessions read whole, and whether they were the one who left."""
    b = ballots(spark, d).filter("type = 'elimination' and complet and votant_ok")
    return b.select("saison", "numero", F.col("votant").alias("id"), F.coalesce((F.col("votant") == F.col("elimine")).cast("int"), F.lit(0)).alias("out")).distinct()


@query(_drawn_sql(f"{P}, c as (select saison, 0 as numero, id, rank() over (partition by saison order by votes_recus) as n, case when sort = 'vainqueur' then 1 else 0 end as out from reg where votes_recus is not null)", "pronostic"))
def t04_winner_among_the_spared(spark, d):
    """The winner's rank by votes received against that of anybody of the season."""
    p = regular(parts(spark, d)).filter("votes_recus is not null")
    r = F.rank().over(Window.partitionBy("saison").orderBy("votes_recus"))
    return _drawn(p.select("saison", F.lit(0).alias("numero"), "id", r.alias("n"), F.coalesce((F.col("sort") == "vainqueur").cast("int"), F.lit(0)).alias("out")), "pronostic")


@query(_drawn_sql(f"{PS}, {_VOTERS_SQL}, h as (select saison, numero, row_number() over (partition by saison order by numero) as i, count(*) over (partition by saison) as k from sess where type = 'elimination'), c as (select v.saison, v.numero, v.id, case when p.genre = 'f' then 1 else 0 end as n, v.out from v join h using (saison, numero) join parts p using (saison, id) where h.i > h.k / 2.0 and p.genre is not null)", "fusion"))
def t11_gender_after_the_middle(spark, d):
    """Whether women leave more than their share in the later half of a season's sessions."""
    w = Window.partitionBy("saison")
    h = sessions(spark, d).filter("type = 'elimination'").select("saison", "numero", F.row_number().over(w.orderBy("numero")).alias("i"), F.count("*").over(w).alias("k")).filter("i > k / 2")
    p = parts(spark, d).filter("genre is not null").select("saison", "id", (F.col("genre") == "f").cast("int").alias("n"))
    return _drawn(_voters(spark, d).join(h.select("saison", "numero"), ["saison", "numero"]).join(p, ["saison", "id"]), "fusion")


@query(_drawn_sql(f"{PS}, {_VOTERS_SQL}, g as (select v.saison, v.numero, v.id, v.out, p.genre, count(*) over (partition by v.saison, v.numero, p.genre) as k, count(*) over (partition by v.saison, v.numero) as t from v join parts p using (saison, id) where p.genre is not null), c as (select saison, numero, id, case when 2 * k = t then null when 2 * k < t then 1 else 0 end as n, out from g)", "minorite"))
def t15_minority_leaves(spark, d):
    """Whether those of the gender in the minority leave more often; a tie is no minority."""
    g = _voters(spark, d).join(parts(spark, d).filter("genre is not null").select("saison", "id", "genre"), ["saison", "id"])
    g = g.withColumn("k", F.count("*").over(Window.partitionBy("saison", "numero", "genre"))).withColumn("t", F.count("*").over(Window.partitionBy("saison", "numero")))
    return _drawn(g.withColumn("n", F.when(2 * F.col("k") < F.col("t"), 1).when(2 * F.col("k") > F.col("t"), 0)), "minorite")


_BEFORE_SQL = "i as (select saison, numero, row_number() over (partition by saison order by numero) as i from sess where type = 'elimination'), a as (select b.saison, i.i + 1 as i, b.votant, b.cible, count(*) over (partition by b.saison, b.numero, b.cible) as k from ballots b join i using (saison, numero) where b.type = 'elimination')"


def _before(spark, d) -> tuple[DataFrame, DataFrame]:
    """((saison, numero, i) of the sessions in order, (saison, i, votant, cible, k) of the ballots of the session before i)."""
    i = sessions(spark, d).filter("type = 'elimination'").select("saison", "numero", F.row_number().over(Window.partitionBy("saison").orderBy("numero")).alias("i"))
    k = F.count("*").over(Window.partitionBy("saison", "numero", "cible"))
    a = ballots(spark, d).filter("type = 'elimination'").withColumn("k", k).join(i, ["saison", "numero"])
    return i, a.select("saison", (F.col("i") + 1).alias("i"), "votant", "cible", "k")


@query(_drawn_sql(f"{PS}, {_VOTERS_SQL}, {_BEFORE_SQL}, s as (select saison, i, votant as id, max(case when k = 1 then 1 else 0 end) as n from a where votant is not null group by all), c as (select v.saison, v.numero, v.id, s.n, v.out from v join i using (saison, numero) join s on s.saison = v.saison and s.i = i.i and s.id = v.id)", "isole"))
def t16_alone_with_a_vote(spark, d):
    """Whether those who named somebody alone at the session before leave more often."""
    i, a = _before(spark, d)
    s = a.filter("votant is not null").groupBy("saison", "i", F.col("votant").alias("id")).agg(F.max((F.col("k") == 1).cast("int")).alias("n"))
    return _drawn(_voters(spark, d).join(i, ["saison", "numero"]).join(s, ["saison", "i", "id"]), "isole")


@query(_drawn_sql(f"{PS}, {_VOTERS_SQL}, c as (select v.saison, v.numero, v.id, p.age as n, v.out from v join parts p using (saison, id))", "age"))
def t18_age_of_who_leaves(spark, d):
    return _drawn(_voters(spark, d).join(parts(spark, d).select("saison", "id", F.col("age").alias("n")), ["saison", "id"]), "age")


@query(_drawn_sql(f"{PS}, {_VOTERS_SQL}, {_BEFORE_SQL}, s as (select saison, i, cible as id, count(*) as k from a where cible is not null group by all), c as (select v.saison, v.numero, v.id, rank() over (partition by v.saison, v.numero order by coalesce(s.k, 0) desc) as n, v.out from v join i using (saison, numero) left join s on s.saison = v.saison and s.i = i.i and s.id = v.id)", "prevision"))
def t20_rank_by_votes_before(spark, d):
    """The rank of whoever leaves by the votes of the session before."""
    i, a = _before(spark, d)
    s = a.filter("cible is not null").groupBy("saison", "i", F.col("cible").alias("id")).agg(F.count("*").alias("k"))
    x = _voters(spark, d).join(i, ["saison", "numero"]).join(s, ["saison", "i", "id"], "left")
    return _drawn(x.withColumn("n", F.rank().over(Window.partitionBy("saison", "numero").orderBy(F.coalesce("k", F.lit(0)).desc()))), "prevision")


# ---- ballots dealt anew within a session -------------------------------------------------------------

CHUNK = 8192  # ballots whose draws are summed at once


def _dealt_share(h: np.ndarray, row: dict) -> np.ndarray | None:
    """Mean of what the dealt items pay: ``pays[i][j]`` is what item j is worth to row i; both in the order of the keys."""
    m = np.array(row["pays"], float)
    n, valued = len(m), np.count_nonzero(m[0] == m[0])  # an item whose worth isn't known isn't counted
    return np.nan_to_num(m).T.ravel().take(places(h) + n * np.arange(n)[:, None]).sum(0) / valued if valued else None


def _dealt_alike(row: dict) -> float | None:
    """The mean of a session in which every deal pays the same: what is paid is a sum of the ballot's part and the item's."""
    m = np.array(row["pays"], float)
    return None if (m - m[:, :1] - m[:1] + m[0, 0]).any() else m.diagonal().mean()


def _dealt(rows: DataFrame, seed: str, wants) -> DataFrame:
    """Targets of a session dealt anew among its ballots: the share of ballots for which ``wants(ballot, target's row)`` holds.

    ``rows``: (saison, numero, pos, mine, item); a row's key is its session and ``pos``, a text.
    """
    key = F.concat_ws("|", "saison", F.col("numero").cast("string"), "pos")
    r = cut(rows.select("saison", "numero", key.alias("key"), "mine", "item"))
    seen = F.avg(wants(F.col("mine"), F.col("item")).cast("int"))
    observed = cut(r.groupBy("saison", "numero").agg(seen.alias("x"), F.count("*").alias("m")).filter("m >= 2").agg(F.avg("x").alias("x"), F.count("x").alias("c")))
    pays = F.transform("m", lambda a: F.transform("m", lambda b: wants(a["mine"], b["item"]).cast("int")))  # ballots of a session squared
    m, by = F.sort_array(F.collect_list(F.struct("key", "mine", "item"))).alias("m"), ["saison", "numero"]
    if f := java_function(r.sparkSession, "Dealt", ArrayType(DoubleType())):
        tasks = 4 * spread(r.sparkSession, 0, 1)
        chunk = F.pmod(F.xxhash64(*by), F.lit(max(4 * tasks, r.count() // CHUNK)))
        g = r.withColumn("chunk", chunk).repartition(tasks, "chunk").groupBy("chunk", *by).agg(m).filter(F.size("m") >= 2)
        g = g.groupBy("chunk").agg(F.collect_list(F.struct(F.col("m.key").alias("keys"), F.flatten(pays).alias("pays"))).alias("g"))
        s = g.select(F.posexplode(F.call_udf(f, F.struct("g"), F.lit(seed), F.lit(DRAWS))).alias("draw", "s")).groupBy("draw").agg(F.sum("s").alias("s"))
        x = s.crossJoin(F.broadcast(observed)).filter("c > 0").select("draw", (F.col("s") / F.col("c")).alias("x"))  # one row
    else:
        g = _spread(r, *by).groupBy(*by).agg(m).filter(F.size("m") >= 2).select(F.col("m.key").alias("keys"), pays.alias("pays"))
        x = S.null_draws(g, "keys", DRAWS, seed, _dealt_share, _dealt_alike)
    return _record(observed.select("x"), cut(x))


def _dealt_sql(ctes: str, seed: str, pays: str) -> str:
    """``c`` (saison, numero, key, mine, item); ``pays`` is what ``b.item`` is worth to ``a.mine``."""
    return f"""{ctes}, k as (select saison, numero from c group by all having count(*) >= 2), r as (select c.*, row_number() over (partition by saison, numero order by key) as i from c join k using (saison, numero)),
 o as (select avg(s) as x from (select a.saison, a.numero, avg({pays}) as s from r a join r b on a.saison = b.saison and a.numero = b.numero and a.i = b.i group by all)),
 w as (select d.draw, r.saison, r.numero, r.item, row_number() over (partition by d.draw, saison, numero order by md5('{seed}|' || d.draw || '|' || key), key) as i from r, (select unnest(range(1, {DRAWS + 1})) as draw) d),
 x as (select draw, avg(s) as x from (select b.draw, a.saison, a.numero, avg({pays}) as s from r a join w b on a.saison = b.saison and a.numero = b.numero and a.i = b.i group by all) group by draw){_RECORD}"""


_KEY = "b.saison || '|' || b.numero || '|' || lpad(cast(b.pos as varchar), 4, '0') as key"


@query(_dealt_sql(f"{PS}, c as (select b.saison, b.numero, {_KEY}, v.genre as mine, t.genre as item from ballots b join parts v on v.saison = b.saison and v.id = b.votant join parts t on t.saison = b.saison and t.id = b.cible where b.type = 'elimination' and b.complet and v.genre is not null and t.genre is not null)", "sexe", "(a.mine = b.item)::int"))
def t07_votes_within_a_gender(spark, d):
    """Whether ballots go to the voter's own gender, against the session's targets dealt anew among its ballots."""
    g = parts(spark, d).filter("genre is not null").select("saison", "id", "genre")
    b = ballots(spark, d).filter("type = 'elimination' and complet").select("saison", "numero", F.lpad(F.col("pos").cast("string"), 4, "0").alias("pos"), "votant", "cible")
    b = b.join(g.withColumnsRenamed({"id": "votant", "genre": "mine"}), ["saison", "votant"]).join(g.withColumnsRenamed({"id": "cible", "genre": "item"}), ["saison", "cible"])
    return _dealt(b, "sexe", lambda a, x: a == x)


@query(_dealt_sql(f"{PS}, {_BEFORE_SQL}, e as (select saison, i, cible as id, '|' || string_agg(distinct votant, '|' order by votant) || '|' as mine from a where votant is not null and cible is not null group by all), c as (select b.saison, b.numero, {_KEY}, coalesce(e.mine, '') as mine, b.cible as item from ballots b join i using (saison, numero) left join e on e.saison = b.saison and e.i = i.i and e.id = b.votant where b.type = 'elimination' and b.complet and b.votant_ok and b.cible_ok)", "retour", "contains(a.mine, '|' || b.item || '|')::int"))
def t14_ballots_returned(spark, d):
    """Whether ballots go to those who named the voter at the session before."""
    ok = F.zip_with("votes.votant_rattache", "votes.cible_rattachee", lambda v, c: F.coalesce(v & c, F.lit(False)))
    c = table(spark, d, "conseils").filter("saison is not null and numero is not null").select("saison", "numero", "type", "complet", F.arrays_zip("votes.votant", "votes.cible", "votes.annule", ok.alias("ok")).alias("v"), "maj", "ligne")
    c = latest(c, ["saison", "numero"], ["maj", "ligne"]).filter("coalesce(type, 'elimination') = 'elimination'")
    c = c.withColumn("a", F.lag("v").over(Window.partitionBy("saison").orderBy("numero"))).filter("complet")  # sessions of a season
    named = F.filter("a", lambda y: F.coalesce(~y["annule"], F.lit(True)) & y["votant"].isNotNull())
    by = F.transform("v", lambda x: F.sort_array(F.array_distinct(F.transform(F.filter("a", lambda y: y["cible"] == x["votant"]), lambda y: y["votant"]))))
    text = F.zip_with("v", by, lambda x, e: F.struct((x["ok"] & F.coalesce(~x["annule"], F.lit(True))).alias("ok"), F.when(F.size(e) > 0, F.concat(F.lit("|"), F.array_join(e, "|"), F.lit("|"))).otherwise("").alias("mine"), F.concat(F.lit("|"), x["cible"], F.lit("|")).alias("item")))
    b = c.withColumn("a", named).select("saison", "numero", F.posexplode(text).alias("pos", "t")).filter("t.ok")
    return _dealt(b.select("saison", "numero", F.lpad(F.col("pos").cast("string"), 4, "0").alias("pos"), "t.mine", "t.item"), "retour", F.contains)


@query(_dealt_sql(f"{PS}, {_VOTERS_SQL}, {_BEFORE_SQL}, q as (select saison, i, cible as id, k, rank() over (partition by saison, i order by k desc) as r from (select saison, i, cible, count(*) as k from a where cible is not null group by all)), u as (select saison, numero, cible as id, count(*) as k from ballots where type = 'elimination' and complet and cible is not null group by all), c as (select v.saison, v.numero, v.saison || '|' || v.numero || '|' || v.id as key, case when q.r = 1 then 1 else 0 end as mine, coalesce(u.k, 0) as item from v join i using (saison, numero) left join q on q.saison = v.saison and q.i = i.i and q.id = v.id left join u on u.saison = v.saison and u.numero = v.numero and u.id = v.id where v.out = 0)", "cible", "a.mine * b.item"))
def t13_target_again(spark, d):
    """Votes that the most named of the session before receive again, against the counts of those who stay dealt anew among them; who leaves keeps theirs."""
    i, a = _before(spark, d)
    n = a.filter("cible is not null").groupBy("saison", "i", F.col("cible").alias("id")).agg(F.count("*").alias("q"))
    n = n.withColumn("r", F.rank().over(Window.partitionBy("saison", "i").orderBy(F.desc("q"))))
    u = ballots(spark, d).filter("type = 'elimination' and complet and cible is not null").groupBy("saison", "numero", F.col("cible").alias("id")).agg(F.count("*").alias("u"))
    x = _voters(spark, d).filter("out = 0").join(i, ["saison", "numero"]).join(n, ["saison", "i", "id"], "left").join(u, ["saison", "numero", "id"], "left")
    rows = x.select("saison", "numero", F.col("id").alias("pos"), F.coalesce((F.col("r") == 1).cast("int"), F.lit(0)).alias("mine"), F.coalesce("u", F.lit(0)).cast("int").alias("item"))
    return _dealt(rows, "cible", lambda m, x: m * x)


def _raced(h: np.ndarray, row: dict) -> np.ndarray:
    """The value of the member who is first in a race of exponential times, each as fast as its weight."""
    u = ((h[0] >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
    first = (-np.log(u) / np.array(row["w"], float)[:, None]).argmin(0)
    return np.array(row["n"], float)[first]


@query(f"""{P}, c as (select saison, id, age as n, vi + 1 as w, case when sort = 'vainqueur' then 1 else 0 end as out from reg where age is not null and vi is not null), k as (select saison from c group by all having sum(out) = 1 and count(*) >= 2), r as (select c.* from c join k using (saison)), o as (select avg(n) as x from r where out = 1),
 t as (select d.draw, r.saison, min_by(r.n, -ln((('0x' || substr(md5('titre|' || d.draw || '|' || saison || '|' || id), 1, 13))::bigint + 0.5) / pow(2, 52)) / r.w) as n from r, (select unnest(range(1, {DRAWS + 1})) as draw) d group by all), x as (select draw, avg(n) as x from t group by draw){_RECORD}""")
def t17_winner_by_strength(spark, d):
    """The winner's age against that of somebody drawn in proportion to contests won and one."""
    c = regular(parts(spark, d)).filter("age is not null and vi is not null").select("saison", "id", F.col("age").alias("n"), (F.col("vi") + 1).alias("w"), F.coalesce((F.col("sort") == "vainqueur").cast("int"), F.lit(0)).alias("out"))
    k = c.groupBy("saison").agg(F.sum("out").alias("o"), F.count("*").alias("m")).filter("o = 1 and m >= 2").select("saison")
    r = cut(c.join(k, "saison"))
    g = _spread(r, "saison").groupBy("saison").agg(F.sort_array(F.collect_list(F.struct(F.concat_ws("|", "saison", "id").alias("key"), "n", "w"))).alias("m")).select(F.col("m.key").alias("keys"), F.col("m.n").alias("n"), F.col("m.w").alias("w"))
    return _record(r.filter("out = 1").agg(F.avg("n").alias("x")), cut(S.null_draws(g, "keys", DRAWS, "titre", _raced)))


# ---- an order dealt anew -----------------------------------------------------------------------------


def _neighbours(h: np.ndarray, row: dict) -> np.ndarray:
    """Number of equal neighbours with the colours dealt in the order of the hashes."""
    code = np.unique(np.array(row["couleur"]), return_inverse=True)[1]
    dealt = code[np.lexsort((h[1], h[0]), axis=0)]
    return (dealt[1:] == dealt[:-1]).sum(0).astype(float)


@query(f"""{P}, c as (select saison, id, couleur, row_number() over (partition by saison order by jour, id) as i from reg where couleur is not null and jour is not null), o as (select avg(v) as x from (select a.saison, count(b.i) as v from c a left join c b on b.saison = a.saison and b.i = a.i + 1 and b.couleur = a.couleur group by a.saison)),
 w as (select d.draw, c.saison, c.couleur, row_number() over (partition by d.draw, saison order by md5('ordre|' || d.draw || '|' || id), id) as i from c, (select unnest(range(1, {DRAWS + 1})) as draw) d), l as (select draw, saison, case when couleur = lag(couleur) over (partition by draw, saison order by i) then 1 else 0 end as v from w),
 x as (select draw, avg(v) as x from (select draw, saison, sum(v) as v from l group by all) group by draw){_RECORD}""")
def t09_colours_leave_in_a_row(spark, d):
    """Exits of one colour next to each other, against the season's colours in any order."""
    c = cut(regular(parts(spark, d)).filter("couleur is not null and jour is not null").select("saison", "id", "jour", "couleur"))
    rows = F.array_sort(F.collect_list(F.struct("jour", "id", "couleur")))
    o = c.groupBy("saison").agg(rows.alias("m")).select(F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("m"))), F.lit(0), lambda s, i: s + F.coalesce((F.try_element_at("m", i)["couleur"] == F.element_at("m", i - 1)["couleur"]).cast("int"), F.lit(0))).alias("v"))
    g = _spread(c, "saison").groupBy("saison").agg(F.sort_array(F.collect_list(F.struct("id", "couleur"))).alias("m")).select(F.col("m.id").alias("keys"), F.col("m.couleur").alias("couleur"))
    return _record(o.agg(F.avg("v").alias("x")), cut(S.null_draws(g, "keys", DRAWS, "ordre", _neighbours)))


def _best_gain(h: np.ndarray, row: dict) -> np.ndarray:
    """The best gain of a split into before and after, four years at least on both sides, of the values dealt in the order of the hashes."""
    v = np.array(row["v"], float)[np.lexsort((h[1], h[0]), axis=0)]
    n, s = len(v), np.cumsum(v, 0)
    i = np.arange(1, n + 1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        g = s * s / i + (s[-1] - s) ** 2 / (n - i) - s[-1] ** 2 / n
    return g[3 : n - 4].max(0)


@query(f"""{P}, y as (select cast(annee as varchar) as k, avg(age) as v from reg where annee is not null and age is not null group by annee), t as (select count(*) as n, sum(v) as t from y),
 og as (select row_number() over (order by k) as i, sum(v) over (order by k rows unbounded preceding) as s from y), o as (select max(s * s / i + (t - s) * (t - s) / (n - i) - t * t / n) as x from og, t where i >= 4 and n - i >= 4),
 w as (select d.draw, y.v, y.k, row_number() over (partition by d.draw order by md5('rupture|' || d.draw || '|' || k), k) as i from y, (select unnest(range(1, {DRAWS + 1})) as draw) d), p as (select draw, i, sum(v) over (partition by draw order by i rows unbounded preceding) as s from w),
 x as (select draw, max(s * s / i + (t - s) * (t - s) / (n - i) - t * t / n) as x from p, t where i >= 4 and n - i >= 4 group by draw){_RECORD.replace("- 1e-12", "- 1e-6")}""")
def t06_break_in_the_years(spark, d):
    """The best split of the yearly mean ages into before and after, against the years in any order."""
    y = cut(regular(parts(spark, d)).filter("annee is not null and age is not null").groupBy(F.col("annee").cast("string").alias("k")).agg(F.avg("age").alias("v")))
    o = S.change_point(y, "k", "v").agg(F.max("gain").alias("x"))
    g = y.agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("m")).filter(F.size("m") >= 8).select(F.col("m.k").alias("keys"), F.col("m.v").alias("v"))  # a row a year
    return _record(o, cut(S.null_draws(g, "keys", DRAWS, "rupture", _best_gain)), 1e-6)


# ---- elementary --------------------------------------------------------------------------------------


@query(f"""{P}, r as (select saison, row_number() over (partition by saison order by age, id) as a, row_number() over (partition by saison order by jour, id) as b from reg where age is not null and jour is not null) select saison, count(*) as n, round(corr(a, b), 6) as rho from r group by saison having count(*) >= 5""")
def st05_spearman_ordinal(spark, d):
    """Correlation of ranks in which ties keep the order of the ids."""
    w = Window.partitionBy("saison")
    r = regular(parts(spark, d)).filter("age is not null and jour is not null").select("saison", F.row_number().over(w.orderBy("age", "id")).alias("a"), F.row_number().over(w.orderBy("jour", "id")).alias("b"))
    return r.groupBy("saison").agg(F.count("*").alias("n"), R6(F.corr("a", "b"), "rho")).filter("n >= 5")


@query("select * from (values (12.706, 1, 0.05), (2.228, 10, 0.05), (2.042, 30, 0.05), (3.169, 10, 0.01), (0.0, 5, 1.0)) t(t, degres, p)")
def st11_student_tail(spark, d):
    """Two-sided tails of Student's t, at points of the published table."""
    from ..functions.statistics import student_tail

    at = [(12.706, 1), (2.228, 10), (2.042, 30), (3.169, 10), (0.0, 5)]
    return spark.createDataFrame([(t, k, round(student_tail(t, k), 4)) for t, k in at], "t double, degres int, p double")


ROBUST = 1000  # draws of weights
CELLS = 1 << 18  # scores held at once


def _leads(z: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """In how many draws each person has the greatest sum of facets times weights; of equal ones the last leads."""
    n, draws = len(z[0]), weights.shape[1]
    out, step = np.zeros(n, np.int64), max(1, CELLS // n)
    for at in range(0, draws, step):
        w = weights[:, at : at + step, None]
        score = z[0] * w[0] + z[1] * w[1] + z[2] * w[2]
        out += np.bincount(n - 1 - score[:, ::-1].argmax(1), minlength=n)
    return out


@query(f"""{P}, b as (select saison, id, vi, votes_recus, jour from reg where vi is not null and votes_recus is not null and jour is not null), m as (select avg(vi) as a1, stddev_pop(vi) as s1, avg(votes_recus) as a2, stddev_pop(votes_recus) as s2, avg(jour) as a3, stddev_pop(jour) as s3 from b),
 z as (select saison, id, (vi - a1) / s1 as z1, -(votes_recus - a2) / s2 as z2, (jour - a3) / s3 as z3 from b, m), u as (select draw, -ln((('0x' || substr(md5('poids|' || draw || '|1'), 1, 13))::bigint + 0.5) / pow(2, 52)) as w1, -ln((('0x' || substr(md5('poids|' || draw || '|2'), 1, 13))::bigint + 0.5) / pow(2, 52)) as w2, -ln((('0x' || substr(md5('poids|' || draw || '|3'), 1, 13))::bigint + 0.5) / pow(2, 52)) as w3 from (select unnest(range(1, {ROBUST + 1})) as draw)),
 f as (select draw, saison, max_by(id, (z1 * w1 + z2 * w2 + z3 * w3, id)) as id from z, u group by draw, saison) select saison, id, round(count(*) / {ROBUST}.0::double, 6) as part from f group by saison, id""")
def st14_robust_leaders(spark, d):
    """Part of the draws of weights of three facets (even on the simplex) in which a person leads the season."""
    b = regular(parts(spark, d)).select("saison", "id", "vi", "votes_recus", "jour").dropna()
    cols = {"vi": 1.0, "votes_recus": -1.0, "jour": 1.0}
    m = b.agg(*[F.avg(c).alias(f"a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    z = b.crossJoin(F.broadcast(m)).select("saison", "id", *[(F.lit(s) * (F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}")).alias(f"z_{c}") for c, s in cols.items()])  # one row
    u = spark.range(1, ROBUST + 1).withColumnRenamed("id", "draw")
    w = [-F.log((F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("poids"), F.col("draw").cast("string"), F.lit(str(i + 1)))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)) for i in range(3)]
    weights = np.array(u.select("draw", *w).collect())[:, 1:].T  # (3, ROBUST)
    # a season's people leave it as one row, so that its draws are made where it stands
    g = z.groupBy("saison").agg(F.sort_array(F.collect_list(F.struct("id", *[f"z_{c}" for c in cols]))).alias("m")).select("saison", F.col("m.id").alias("ids"), *[F.col(f"m.z_{c}").alias(f"z{i}") for i, c in enumerate(cols)])

    def lead(batches):
        for b in batches:
            for r in b.to_pylist():
                k = _leads([np.array(r[f"z{i}"], float) for i in range(3)], weights)
                at = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays([pa.array([r["saison"]] * len(at), pa.string()), pa.array([r["ids"][i] for i in at], pa.string()), pa.array(k[at])], ["saison", "id", "k"])

    return g.mapInArrow(lead, "saison string, id string, k bigint").select("saison", "id", R6(F.col("k") / F.lit(float(ROBUST)), "part"))


@query(f"""{P}, n as (select genre, prenom, count(*) as n from personnes where genre is not null and prenom is not null group by all), t as (select genre, sum(n) as t from n group by genre), p as (select genre, count(*) as k from parts where genre is not null group by genre), o as (select split_part(nom, ' ', 1) as prenom, count(*) as vus from parts where nom is not null group by 1),
 e as (select n.prenom, sum(n.n * p.k / t.t) as attendu from n join t using (genre) join p using (genre) group by n.prenom) select e.prenom, coalesce(o.vus, 0) as vus, round(attendu, 6) as attendu, attendu >= 1 as montre from e left join o using (prenom) where attendu >= 0.05""")
def st17_first_names_seen(spark, d):
    """First names seen beside those expected; hidden below 0.05 expected, shown from one."""
    from ..session import table

    n = table(spark, d, "personnes").filter("genre is not null and prenom is not null").groupBy("genre", "prenom").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("genre")))
    p = parts(spark, d)
    k = p.filter("genre is not null").groupBy("genre").agg(F.count("*").alias("k"))
    e = n.join(k, "genre").groupBy("prenom").agg(F.sum(F.col("n") * F.col("k") / F.col("t")).alias("e")).filter("e >= 0.05")
    o = p.filter("nom is not null").groupBy(F.split_part("nom", F.lit(" "), F.lit(1)).alias("prenom")).agg(F.count("*").alias("vus"))
    return e.join(o, "prenom", "left").select("prenom", F.coalesce("vus", F.lit(0)).alias("vus"), R6(F.col("e"), "attendu"), (F.col("e") >= 1).alias("montre"))


@query(f"""{P} select saison, round(100 * (avg(case when sort = 'elimine_conseil' then 1 else 0 end) filter (where genre = 'f') - avg(case when sort = 'elimine_conseil' then 1 else 0 end) filter (where genre = 'h')), 6) as ecart from reg where sort is not null group by saison""")
def st18_contrast_of_rates(spark, d):
    """The difference of two rates in points."""
    out = (F.col("sort") == "elimine_conseil").cast("int")
    rate = lambda g: F.avg(F.when(F.col("genre") == g, out))
    return regular(parts(spark, d)).filter("sort is not null").groupBy("saison").agg(R6(100 * (rate("f") - rate("h")), "ecart"))


@query(f"""{P}, f as (select count(*) filter (where sort = 'vainqueur') as k, count(*) as n from (select saison, sort, row_number() over (partition by saison order by votes_recus desc, id) as r from reg where sort in ('vainqueur', 'finaliste') and votes_recus is not null qualify count(*) over (partition by saison) = 2) where r = 1),
 t as (select k, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)) as q from f, (select unnest(range(0, n + 1)) as i from f)) select k, n, round(least(1, sum(q) filter (where q <= (select max(q) from t where i = k) * (1 + 1e-7))), 6) as p from t group by k, n""")
def t21_binomial_of_finals(spark, d):
    """How often the finalist of more votes against them wins a final of two: an exact binomial test."""
    from ..functions.statistics import binomial_test

    w = Window.partitionBy("saison")
    f = regular(parts(spark, d)).filter("sort in ('vainqueur', 'finaliste') and votes_recus is not null").withColumn("c", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("votes_recus"), "id"))).filter("c = 2 and r = 1")
    one = f.agg(F.count_if(F.col("sort") == "vainqueur").alias("k"), F.count("*").alias("n"))

    def test(batches):
        for b in batches:
            yield b.assign(p=[round(binomial_test(int(k), int(n)), 6) if n else None for k, n in zip(b["k"], b["n"])])

    return one.mapInPandas(test, "k bigint, n bigint, p double")


QUERIES = Q
