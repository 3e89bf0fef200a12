"""Statistical queries, with SQL where the computation is exact on both sides."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics as X
from ..plans.silver import PARTS_SQL, SESSIONS_SQL, ballots, parts, regular, sessions
from ..session import cut, spread, table
from . import statistics as S
from .aggregates import average_rank
from .relational import wilson

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
U = "('0x' || substr(md5({}), 1, 13))::bigint / pow(2, 52)"
DRAWS = 10_000  # of every null model, as in the reference


def _spread(groups: DataFrame, *by: str) -> DataFrame:
    """Groups over all cores: they are small rows, their draws are the work."""
    return groups.repartition(4 * spread(groups.sparkSession, 0, 1), *by)


def _coins(h: np.ndarray, row: dict) -> np.ndarray:
    """How far from half of the members a draw's coins fall: a uniform number under a half is a hash whose first bit is 0."""
    return np.abs((h[0] >> np.uint64(63) == 0).sum(0) - row["n"] / 2.0)


def _between_colours(h: np.ndarray, row: dict) -> np.ndarray | None:
    """Variance of the colours' mean days, with the colours dealt in the order of the hashes; ids are sorted."""
    names, code = np.unique(np.array(row["couleur"]), return_inverse=True)
    if len(names) < 2:
        return None
    dealt = code[np.lexsort((h[1], h[0]), axis=0)]
    days = np.array(row["jour"], float)
    return np.var([days @ (dealt == c) / (code == c).sum() for c in range(len(names))], axis=0, ddof=1)


def _first(h: np.ndarray, row: dict) -> np.ndarray:
    """The value of the member whose hash comes first."""
    return np.array(row["ns"], float)[np.lexsort((h[1], h[0]), axis=0)[0]]


def _season_tests(spark, d):
    p = regular(parts(spark, d)).filter("genre is not null").groupBy("saison").agg(F.count("*").alias("n"), F.count_if(F.col("genre") == "f").alias("k"))
    z = (F.col("k") - F.col("n") / 2.0) / F.sqrt(F.col("n") / 4.0)
    return p.select("saison", (1.0 / (1.0 + z * z)).alias("p"))


_TESTS = "t as (select saison, 1.0 / (1.0 + z * z) as p from (select saison, (k - n / cast(2 as double)) / sqrt(n / cast(4 as double)) as z from (select saison, count(*) as n, count(*) filter (where genre = 'f') as k from reg where genre is not null group by saison)))"


@query(f"""{P}, {_TESTS}, r as (select *, row_number() over (order by p, saison) as r, count(*) over () as n from t) select saison, round(p, 6) as p, round(least(1, min(p * n / r) over (order by p desc, saison desc rows unbounded preceding)), 6) as adjusted from r""")
def st01_benjamini_hochberg(spark, d):
    t = S.benjamini_hochberg(_season_tests(spark, d), "p")
    return t.select("saison", R6(F.col("p"), "p"), R6(F.col("adjusted"), "adjusted"))


@query(f"""{P}, g as (select couleur, count(*) as n, count(*) filter (where sort = 'vainqueur') as k from reg where couleur is not null group by couleur), w as (select *, cast(k as double) / n as p, cast(1.959963985 as double) as z from g)
select couleur, n, k, round(greatest(0, 100 * (p + z*z/(2*n) - z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) as low, round(least(100, 100 * (p + z*z/(2*n) + z*sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) as high from w""")
def st02_wilson_by_colour(spark, d):
    g = regular(parts(spark, d)).filter("couleur is not null").groupBy("couleur").agg(F.count("*").alias("n"), F.count_if(F.col("sort") == "vainqueur").alias("k"))
    return g.select("couleur", "n", "k", R6(wilson(F.col("k"), F.col("n"), -1), "low"), R6(wilson(F.col("k"), F.col("n"), 1), "high"))


@query(f"""{P}, r as (select saison, rank() over (partition by saison order by age) + (count(*) over (partition by saison, age) - 1) / cast(2 as double) as a, rank() over (partition by saison order by jour) + (count(*) over (partition by saison, jour) - 1) / cast(2 as double) as b from reg where age is not null and jour is not null)
select saison, count(*) as n, round(case when stddev_pop(a) > 0 and stddev_pop(b) > 0 then corr(a, b) end, 6) as rho from r group by saison having count(*) >= 5""")
def st06_spearman(spark, d):
    p = regular(parts(spark, d)).filter("age is not null and jour is not null").select("saison", average_rank("age", ["saison"]).alias("a"), average_rank("jour", ["saison"]).alias("b"))
    g = p.groupBy("saison").agg(F.count("*").alias("n"), F.corr("a", "b").alias("c"), F.stddev_pop("a").alias("x"), F.stddev_pop("b").alias("y")).filter("n >= 5")
    return g.select("saison", "n", F.when((F.col("x") > 0) & (F.col("y") > 0), F.round("c", 6)).alias("rho"))


@query(f"""{P}, v as (select vi as s, case when sort in ('vainqueur', 'finaliste') then 1 else 0 end as y from reg where vi is not null), r as (select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / cast(2 as double) as r from v)
select sum(y)::bigint as n1, sum(1 - y)::bigint as n0, round((sum(r * y) - sum(y) * (sum(y) + 1) / cast(2 as double)) / (cast(sum(y) as double) * sum(1 - y)), 6) as auc from r""")
def st07_auc_of_wins(spark, d):
    p = regular(parts(spark, d)).select("vi", F.coalesce(F.col("sort").isin("vainqueur", "finaliste"), F.lit(False)).alias("y"))
    return S.auc(p, "vi", "y").select("n1", "n0", R6(F.col("auc"), "auc"))


@query(f"""{P}, a as (select annee as x, cast(count(*) as double) as y from reg where annee is not null group by annee), f as (select regr_slope(y, x) as s, regr_intercept(y, x) as i from a) select x as annee, round(y - (s * x + i), 6) as reste from a, f""")
def st08_detrended_years(spark, d):
    a = regular(parts(spark, d)).filter("annee is not null").groupBy(F.col("annee").alias("x")).agg(F.count("*").cast("double").alias("y"))
    f = a.agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"))
    return a.crossJoin(F.broadcast(f)).select(F.col("x").alias("annee"), R6(F.col("y") - (F.col("s") * F.col("x") + F.col("i")), "reste"))  # one row


@query(f"""{P}, t as (select count(*) filter (where genre = 'f' and sort in ('vainqueur', 'finaliste')) as f1, count(*) filter (where genre = 'f' and sort not in ('vainqueur', 'finaliste')) as f0, count(*) filter (where genre = 'h' and sort in ('vainqueur', 'finaliste')) as h1, count(*) filter (where genre = 'h' and sort not in ('vainqueur', 'finaliste')) as h0 from reg where genre in ('f', 'h') and sort is not null),
 m as (select *, f1 + f0 as r, f1 + h1 as c, f1 + f0 + h1 + h0 as n from t), k as (select m.*, unnest(range(greatest(0, r + c - n), least(r, c) + 1)) as i from m),
 q as (select *, exp(lgamma(c + 1) - lgamma(i + 1) - lgamma(c - i + 1) + lgamma(n - c + 1) - lgamma(r - i + 1) - lgamma(n - c - r + i + 1) - lgamma(n + 1) + lgamma(r + 1) + lgamma(n - r + 1)) as q from k)
 select f1, f0, h1, h0, round(least(1, sum(q) filter (where q <= (select max(q) from q where i = f1) * (1 + 1e-7))), 6) as p from q group by all""")
def st09_fisher_gender_and_final(spark, d):
    """Fisher's exact test of gender and final, made on an executor from the one row of counts."""
    r = regular(parts(spark, d)).filter("genre in ('f', 'h') and sort is not null").agg(*[F.count_if((F.col("genre") == g) & (F.col("sort").isin("vainqueur", "finaliste") == F.lit(e))).alias(f"{g}{int(e)}") for g in "fh" for e in (True, False)])

    def test(batches):
        for b in batches:
            yield b.assign(p=[round(X.fisher_exact(*map(int, t)), 6) for t in zip(b["f1"], b["f0"], b["h1"], b["h0"])])

    return r.mapInPandas(test, "f1 bigint, f0 bigint, h1 bigint, h0 bigint, p double")


@query(f"""{P}, f as (select count(*) filter (where genre = 'f') as k, count(*) as n from reg where sort = 'vainqueur' and genre is not null), t as (select k, n, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)) as q from f, (select unnest(range(0, n + 1)) as i from f))
 select k, n, round(least(1, sum(q) filter (where q <= (select max(q) from t where i = k) * (1 + 1e-7))), 6) as p, case when k > 0 then 0.025 else 0.0 end as sous_bas, case when k < n then 0.025 else 0.0 end as sur_haut from t group by k, n""")
def st10_binomial_women_winners(spark, d):
    """The exact binomial test, and the chances of as many or more at the interval's lower bound and of as few or fewer at its upper one."""
    r = regular(parts(spark, d)).filter("sort = 'vainqueur' and genre is not null").agg(F.count_if(F.col("genre") == "f").alias("k"), F.count("*").alias("n"))

    def test(batches):
        for b in batches:
            rows = []
            for k, n in zip(map(int, b["k"]), map(int, b["n"])):
                lo, hi = X.clopper_pearson(k, n) if n else (0.0, 1.0)
                rows.append((X.binomial_test(k, n), X.incomplete_beta(k, n - k + 1, lo) if 0 < k else 0.0, 1 - X.incomplete_beta(k + 1, n - k, hi) if k < n else 0.0))
            yield b.assign(**{c: [round(x[i], 6) for x in rows] for i, c in enumerate(("p", "sous_bas", "sur_haut"))})

    return r.mapInPandas(test, "k bigint, n bigint, p double, sous_bas double, sur_haut double")


_RATE = f"""v as (select saison, votant as id, count(*) as n, cast(count(*) filter (where cible = elimine) as double) / count(*) as x from ballots where type = 'elimination' and votant_ok and votant is distinct from elimine and elimine is not null group by all)"""


@query(f"""with {SESSIONS_SQL}, {_RATE}, s as (select count(*) as rows, sum(x * n) / sum(n) as mean, var_samp(x) as var, avg(cast(1 as double) / n) as inv, avg(x * (1 - x)) as win from v),
k as (select *, case when rows < 8 then 8 when var - win * inv <= 0 then 200 else greatest(1, least(200, win / (var - win * inv))) end as k from s) select saison, id, n, round((x * n + mean * k) / (n + k), 6) as shrunk from v, k""")
def st12_shrunk_accuracy(spark, d):
    b = ballots(spark, d).filter("type = 'elimination' and votant_ok and elimine is not null and votant <> elimine or (type = 'elimination' and votant_ok and elimine is not null and votant is null)")
    v = b.groupBy("saison", F.col("votant").alias("id")).agg(F.count("*").alias("n"), (F.count_if(F.col("cible") == F.col("elimine")).cast("double") / F.count("*")).alias("x"))
    return S.shrink_normal(v, "x", "n").select("saison", "id", "n", R6(F.col("shrunk"), "shrunk"))


@query(f"""{P}, b as (select saison, id, vi, votes_recus, jour from reg where vi is not null and votes_recus is not null and jour is not null), m as (select avg(vi) as a1, stddev_pop(vi) as s1, avg(votes_recus) as a2, stddev_pop(votes_recus) as s2, avg(jour) as a3, stddev_pop(jour) as s3 from b)
select saison, id, round(((vi - a1) / s1 - (votes_recus - a2) / s2 + (jour - a3) / s3) / 3, 6) as score from b, m""")
def st13_composite_score(spark, d):
    b = regular(parts(spark, d)).select("saison", "id", "vi", "votes_recus", "jour").dropna()
    cols = {"vi": 1, "votes_recus": -1, "jour": 1}
    m = b.agg(*[F.avg(c).alias(f"a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    z = sum((F.lit(float(s)) * (F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}") for c, s in cols.items()), F.lit(0.0)) / 3
    return b.crossJoin(F.broadcast(m)).select("saison", "id", R6(z, "score"))  # one row


@query(f"""with pop as (select n_regionkey as region, count(*) as pop from customer join nation on c_nationkey = n_nationkey group by 1), obs as (select n_regionkey as region, count(*) as observe from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1),
t as (select (select sum(pop) from pop) as tp, (select sum(observe) from obs) as too) select pop.region, observe, round(cast(too as double) * pop / tp, 6) as attendu, round(observe / (cast(too as double) * pop / tp), 6) as indice from pop join obs using (region), t""")
def st16_observed_and_expected(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"))
    g = c.join(n, "c_nationkey").join(per, "c_custkey", "left").groupBy("region").agg(F.count("*").alias("pop"), F.sum(F.coalesce("o", F.lit(0))).alias("observe"))
    w = Window.partitionBy()  # a row a region
    e = F.sum("observe").over(w).cast("double") * F.col("pop") / F.sum("pop").over(w)
    return g.select("region", "observe", R6(e, "attendu"), R6(F.col("observe") / e, "indice"))


@query(f"""{P}, s as (select saison, count(*) as n, abs(count(*) filter (where genre = 'f') - count(*) / cast(2 as double)) as e from reg where genre is not null group by saison),
dr as (select d.draw, s.saison, s.n from s cross join (select unnest(range(1, {DRAWS + 1})) as draw) d), b as (select draw, saison, n, (select count(*) from range(0, n) r(i) where {U.format("'parite|' || draw || '|' || saison || '|' || i")} < 0.5) as k from dr),
x as (select draw, avg(abs(k - n / cast(2 as double))) as x from b group by draw) select round((select avg(e) from s), 6) as observed, round(avg(x), 6) as expected, round(stddev_samp(x), 6) as sd from x""")
def t01_parity(spark, d):
    s = regular(parts(spark, d)).filter("genre is not null").groupBy("saison").agg(F.count("*").alias("n"), F.abs(F.count_if(F.col("genre") == "f") - F.count("*") / 2.0).alias("e"))
    keys = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.concat_ws("|", "saison", i.cast("string")))
    x = S.null_draws(_spread(s.select("saison", "n", keys.alias("keys")), "saison").drop("saison"), "keys", DRAWS, "parite", _coins)
    return s.agg(F.avg("e").alias("o")).crossJoin(x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))).select(R6(F.col("o"), "observed"), R6(F.col("m"), "expected"), R6(F.col("s"), "sd"))


@query(f"""{P}, c as (select saison, id, couleur, jour from reg where couleur is not null and jour is not null), o as (select avg(v) as x from (select variance(m) as v from (select saison, couleur, avg(jour) as m from c group by all) group by saison)),
a as (select d.draw, c.saison, c.jour, row_number() over (partition by d.draw, saison order by id) as i from c, (select unnest(range(1, {DRAWS + 1})) as draw) d), b as (select d.draw, c.saison, c.couleur, row_number() over (partition by d.draw, saison order by md5('tribus|' || d.draw || '|' || id), id) as i from c, (select unnest(range(1, {DRAWS + 1})) as draw) d),
x as (select draw, avg(v) as x from (select draw, saison, variance(m) as v from (select draw, saison, couleur, avg(jour) as m from a join b using (draw, saison, i) group by all) group by all) group by draw), m as (select avg(x) as e, stddev_samp(x) as s, count(*) as n from x)
select round(o.x, 6) as observed, round(e, 6) as expected, round(s, 6) as sd, round((o.x - e) / s, 6) as z, round(((select count(*) from x, o, m where abs(x.x - m.e) >= abs(o.x - m.e) - 1e-12) + 1) / cast(n + 1 as double), 6) as p, n from o, m""")
def t03_colours_within_season(spark, d):
    c = cut(regular(parts(spark, d)).filter("couleur is not null and jour is not null").select("saison", "id", "couleur", "jour"))
    stat = lambda x, by: x.groupBy(*by, "saison", "couleur").agg(F.avg("jour").alias("m")).groupBy(*by, "saison").agg(F.var_samp("m").alias("v"))
    observed = stat(c, []).agg(F.avg("v").alias("x"))
    g = _spread(c, "saison").groupBy("saison").agg(F.sort_array(F.collect_list(F.struct("id", "jour", "couleur"))).alias("m")).select(F.col("m.id").alias("keys"), F.col("m.jour").alias("jour"), F.col("m.couleur").alias("couleur"))
    t = S.permutation_test(observed, cut(S.null_draws(g, "keys", DRAWS, "tribus", _between_colours)))
    return t.select(R6(F.col("observed"), "observed"), R6(F.col("expected"), "expected"), R6(F.col("sd"), "sd"), R6(F.col("z"), "z"), R6(F.col("p"), "p"), "n")


@query(f"""with {SESSIONS_SQL}, c as (select saison, numero, cible as id, count(*) as n, max(case when cible = elimine then 1 else 0 end) as out from ballots where type = 'elimination' and complet and cible_ok group by all), k as (select saison, numero from c group by all having sum(out) = 1 and count(*) >= 2),
r as (select c.* from c join k using (saison, numero)), o as (select avg(n) as x from r where out = 1), w as (select d.draw, r.n, row_number() over (partition by d.draw, saison, numero order by md5('menace|' || d.draw || '|' || saison || '|' || numero || '|' || id)) as i from r, (select unnest(range(1, {DRAWS + 1})) as draw) d),
x as (select draw, avg(n) as x from w where i = 1 group by draw) select round(o.x, 6) as observed, round(avg(x.x), 6) as expected, round(stddev_samp(x.x), 6) as sd, count(*) as n from x, o group by o.x""")
def t12_one_drawn_a_session(spark, d):
    c = ballots(spark, d).filter("type = 'elimination' and complet and cible_ok").groupBy("saison", "numero", F.col("cible").alias("id")).agg(F.count("*").alias("n"), F.max(F.coalesce((F.col("cible") == F.col("elimine")).cast("int"), F.lit(0))).alias("out"))
    k = c.groupBy("saison", "numero").agg(F.sum("out").alias("o"), F.count("*").alias("m")).filter("o = 1 and m >= 2").select("saison", "numero")
    r = cut(c.join(k, ["saison", "numero"]))
    key = F.concat_ws("|", "saison", F.col("numero").cast("string"), "id")
    g = _spread(r, "saison", "numero").groupBy("saison", "numero").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "n"))).alias("m")).select(F.col("m.key").alias("keys"), F.col("m.n").alias("ns"))
    x = S.null_draws(g, "keys", DRAWS, "menace", _first)
    return r.filter("out = 1").agg(F.avg("n").alias("o")).crossJoin(x.agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("*").alias("n"))).select(R6(F.col("o"), "observed"), R6(F.col("m"), "expected"), R6(F.col("s"), "sd"), "n")


@query(f"""{P}, s as (select saison, sum(case when genre = 'f' then 1 else 0 end) as k, count(*) as n from reg where genre is not null group by saison), t as (select sum(k) as k, sum(n) as n, count(*) as g from s), j as (select cast(t.k - s.k as double) / (t.n - s.n) as x, g from s, t where t.n > s.n)
select round(cast(t.k as double) / t.n, 6) as estimate, round(sqrt((t.g - 1) / cast(t.g as double) * sum((j.x - m.a) * (j.x - m.a))), 6) as se from j, t, (select avg(x) as a from j) m group by t.k, t.n, t.g""")
def t23_season_jackknife(spark, d):
    s = regular(parts(spark, d)).filter("genre is not null").groupBy("saison").agg(F.count_if(F.col("genre") == "f").alias("k"), F.count("*").alias("n"))
    t = s.agg(F.sum("k").alias("tk"), F.sum("n").alias("tn"), F.count("*").alias("g"))
    j = s.crossJoin(F.broadcast(t)).filter("tn > n").select("tk", "tn", "g", ((F.col("tk") - F.col("k")).cast("double") / (F.col("tn") - F.col("n"))).alias("x"))  # one row
    g = j.groupBy("tk", "tn", "g").agg(F.var_pop("x").alias("v"), F.count("*").alias("c"))
    return g.select(R6(F.col("tk").cast("double") / F.col("tn"), "estimate"), R6(F.sqrt((F.col("g") - 1) / F.col("g").cast("double") * F.col("v") * F.col("c")), "se"))


@query("""with m as (select date_trunc('month', o_orderdate) as mois, sum(o_totalprice) as v from orders group by 1), x as (select mois, row_number() over (order by mois) as i, sum(v) over (order by mois rows unbounded preceding) as a, count(*) over () as n, sum(v) over () as s from m)
select strftime(mois, '%Y-%m') as mois, round((a * a / i + (s - a) * (s - a) / (n - i) - s * s / n) / 1e9, 2) as gain from x where i >= 4 and n - i >= 4""")
def m15_change_point(spark, d):
    m = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("mois")).agg(F.sum("o_totalprice").alias("v"))
    return S.change_point(m, "mois", "v").select(F.date_format("mois", "yyyy-MM").alias("mois"), F.round(F.col("gain") / 1e9, 2).alias("gain"))


def _model_rows(spark, d):
    return regular(parts(spark, d)).select("saison", "id", F.col("age").cast("double").alias("age"), (F.col("genre") == "f").cast("double").alias("femme"), F.col("vi").cast("double").alias("vi"), F.col("votes_recus").cast("double").alias("votes"), (100.0 * F.col("jour") / F.col("duree_jours")).alias("survie"), F.col("jour").cast("double").alias("jour"), F.coalesce((F.col("sort") == "vainqueur").cast("double"), F.lit(0.0)).alias("gagne"), F.coalesce(F.col("sort").isin("elimine_conseil").cast("double"), F.lit(0.0)).alias("sorti"))


@query(f"""{P}, x as (select cast(votes_recus as double) as x, 100.0 * cast(jour as double) / duree_jours as y from reg where votes_recus is not null and jour is not null) select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept from x""")
def m09_slope_by_sums(spark, d):
    o = S.ols(_model_rows(spark, d), ["votes"], "survie").groupBy().pivot("term", ["votes", "intercept"]).agg(F.first("estimate"))
    return o.select(R6(F.col("votes"), "slope"), R6(F.col("intercept"), "intercept"))


@query()
def m10_ols_clustered(spark, d):
    return S.ols(_model_rows(spark, d), ["age", "femme", "vi"], "survie", "saison")


def _terms(spark, names, beta):
    return spark.createDataFrame([(n, float(b)) for n, b in zip(names, beta)], "term string, estimate double")


@query()
def m07_logit(spark, d):
    return _terms(spark, ["intercept", "age", "vi"], S.logit(cut(_model_rows(spark, d)), ["age", "vi"], "gagne", 1e-3))


@query()
def m06_poisson(spark, d):
    return _terms(spark, ["intercept", "age", "femme"], S.poisson(cut(_model_rows(spark, d)), ["age", "femme"], "votes", "jour"))


@query()
def m08_cox(spark, d):
    return _terms(spark, ["age", "vi"], S.cox(cut(_model_rows(spark, d)), "saison", "jour", "sorti", ["age", "vi"]))


@query()
def m11_conditional_logit(spark, d):
    return _terms(spark, ["age", "vi", "votes"], S.conditional_logit(cut(_model_rows(spark, d)), ["saison"], ["age", "vi", "votes"], "gagne", 1e-3))


@query()
def m05_luce(spark, d):
    c = ballots(spark, d).filter("type = 'elimination' and cible_ok").groupBy("saison", "numero", F.col("cible").alias("id")).agg(F.max(F.coalesce((F.col("cible") == F.col("elimine")).cast("int"), F.lit(0))).alias("won"))
    field = cut(c.select(F.concat_ws("#", "saison", F.col("numero").cast("string")).alias("contest"), "id", "won"))
    return S.luce(field, rounds=500, cut=cut, tolerance=1e-10).withColumnRenamed("wins", "sorties")


@query()
def m01_correspondence(spark, d):
    p = regular(parts(spark, d)).select("genre", "couleur", F.when(F.col("age") < 30, "jeune").when(F.col("age") < 45, "moyen").otherwise("ancien").alias("tranche"))
    return S.correspondence(p, ["genre", "couleur", "tranche"])


def _best_clusters(x: DataFrame) -> DataFrame:
    """``x`` with ``prediction``, by k-means for k of 2 to 10: the k of the best silhouette whose least group holds 2 % and three rows, else 2."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    judge = ClusteringEvaluator()
    rows = x.count()
    floor = max(3, int(0.02 * rows))
    best, most = None, -2.0
    for k in range(2, min(10, rows - 1) + 1):
        fit = KMeans(k=k, seed=42).fit(x)
        best = best or fit
        if min(fit.summary.clusterSizes) >= floor and (score := judge.evaluate(fit.transform(x))) > most + 1e-9:
            best, most = fit, score
    return best.transform(x)


@query()
def m02_clusters(spark, d):
    """Groups of participants by k-means, for k of 2 to 10, the k of the best silhouette without a group under 2 %."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    x = VectorAssembler(inputCols=["age", "vi", "votes", "survie"], outputCol="raw").transform(_model_rows(spark, d).dropna(subset=["age", "vi", "votes", "survie"]))
    x = cut(StandardScaler(inputCol="raw", outputCol="features").fit(x).transform(x).select("saison", "id", "features"))
    return _best_clusters(x).groupBy(F.col("prediction").alias("groupe")).agg(F.count("*").alias("n"))


@query(f"""{P}, r as (select saison, id, 1 / cast(count(*) over (partition by saison) as double) as h, case when sort = 'vainqueur' then 1 else 0 end as y from reg) select cast(floor(h * 200) as bigint) as decile, count(*) as n, round(avg(h), 6) as attendu, round(avg(y), 6) as observe from r group by 1""")
def m18_mechanical_hazard(spark, d):
    p = regular(parts(spark, d)).select("saison", "id", F.coalesce((F.col("sort") == "vainqueur").cast("int"), F.lit(0)).alias("y"))
    n = p.groupBy("saison").agg((F.lit(1.0) / F.count("*")).alias("h"), F.count("*").alias("n"), F.sum("y").alias("k"))
    g = n.groupBy(F.floor(F.col("h") * 200).alias("decile")).agg(F.sum("n").alias("n"), F.sum(F.col("h") * F.col("n")).alias("a"), F.sum("k").alias("k"))
    return g.select("decile", "n", R6(F.col("a") / F.col("n"), "attendu"), R6(F.col("k") / F.col("n"), "observe"))


def _zeros(*names: str) -> str:
    return "select * from (values " + ", ".join(f"('{n}', 0.0::double)" for n in names) + ") t(term, score)"


def _score(rows: DataFrame, **terms: Column) -> DataFrame:
    """(term, score): the sums of the terms' scores over all rows, which vanish where the likelihood is greatest."""
    one = rows.agg(*[(F.round(F.sum(x), 4) + 0.0).alias(n) for n, x in terms.items()])
    return one.unpivot([], list(terms), "term", "score")


@query(_zeros("intercept", "age", "vi"))
def m07_score_at_the_estimate(spark, d):
    """The logit model's estimates put into its score, ridge included."""
    rows = cut(_model_rows(spark, d))
    b = [float(x) for x in S.logit(rows, ["age", "vi"], "gagne", 1e-3)]
    r = rows.dropna(subset=["age", "vi", "gagne"])
    e = F.col("gagne") - 1 / (1 + F.exp(-(b[0] + b[1] * F.col("age") + b[2] * F.col("vi"))))
    t = _score(r, intercept=e, age=e * F.col("age"), vi=e * F.col("vi"))
    ridge = F.when(F.col("term") == "intercept", b[0]).when(F.col("term") == "age", b[1]).otherwise(b[2]) * 1e-3
    return t.select("term", (F.round(F.col("score") - ridge, 2) + 0.0).alias("score"))


@query(_zeros("intercept", "age", "femme"))
def m06_score_at_the_estimate(spark, d):
    """The Poisson model's estimates put into its score."""
    rows = cut(_model_rows(spark, d))
    b = [float(x) for x in S.poisson(rows, ["age", "femme"], "votes", "jour")]
    r = rows.dropna(subset=["age", "femme", "votes", "jour"]).filter("jour > 0")
    e = F.col("votes") - F.col("jour") * F.exp(b[0] + b[1] * F.col("age") + b[2] * F.col("femme"))
    return _score(r, intercept=e, age=e * F.col("age"), femme=e * F.col("femme"))


@query(_zeros("intercept", "age", "femme", "vi"))
def m10_residuals_are_orthogonal(spark, d):
    """Residuals of the least squares, summed with each regressor."""
    rows = cut(_model_rows(spark, d))
    b = {r["term"]: r["estimate"] for r in S.ols(rows, ["age", "femme", "vi"], "survie", "saison").collect()}  # a row a term
    e = F.col("survie") - (b["intercept"] + b["age"] * F.col("age") + b["femme"] * F.col("femme") + b["vi"] * F.col("vi"))
    return _score(rows.dropna(subset=["age", "femme", "vi", "survie", "saison"]), intercept=e, age=e * F.col("age"), femme=e * F.col("femme"), vi=e * F.col("vi"))


@query(_zeros("age", "vi", "votes"))
def m11_score_at_the_estimate(spark, d):
    """The choice model's estimates put into its score by season, ridge included."""
    rows = cut(_model_rows(spark, d))
    xs = ["age", "vi", "votes"]
    b = [float(x) for x in S.conditional_logit(rows, ["saison"], xs, "gagne", 1e-3)]
    w = Window.partitionBy("saison")
    r = rows.dropna(subset=xs).withColumn("n", F.sum("gagne").over(w)).filter("n = 1").withColumn("e", F.exp(sum((F.lit(c) * F.col(x) for c, x in zip(b, xs)), F.lit(0.0))))
    r = r.withColumn("q", F.col("gagne") - F.col("e") / F.sum("e").over(w))
    t = _score(r, **{x: F.col("q") * F.col(x) for x in xs})
    ridge = F.when(F.col("term") == "age", b[0]).when(F.col("term") == "vi", b[1]).otherwise(b[2]) * 1e-3
    return t.select("term", (F.round(F.col("score") - ridge, 2) + 0.0).alias("score"))


@query(_zeros("vi", "votes"))
def m12_jury_choice_at_the_estimate(spark, d):
    """The jury's choice among its targets by contests won and votes received: the estimates put into the score."""
    b = ballots(spark, d).filter("type = 'jury' and cible is not null")
    pick = b.select("saison", "numero", "pos", F.col("cible").alias("choix"))
    who = b.select("saison", "numero", F.col("cible").alias("id")).distinct().join(regular(parts(spark, d)).select("saison", "id", F.col("vi").cast("double").alias("vi"), F.col("votes_recus").cast("double").alias("votes")).dropna(), ["saison", "id"])
    rows = cut(pick.join(who, ["saison", "numero"]).withColumn("y", (F.col("id") == F.col("choix")).cast("double")))
    keys, xs = ["saison", "numero", "pos"], ["vi", "votes"]
    beta = [float(x) for x in S.conditional_logit(rows, keys, xs, "y", 1e-3)]
    w = Window.partitionBy(*keys)
    r = rows.withColumn("n", F.sum("y").over(w)).filter("n = 1").withColumn("e", F.exp(sum((F.lit(c) * F.col(x) for c, x in zip(beta, xs)), F.lit(0.0))))
    r = r.withColumn("q", F.col("y") - F.col("e") / F.sum("e").over(w))
    t = _score(r, **{x: F.col("q") * F.col(x) for x in xs})
    return t.select("term", (F.round(F.col("score") - F.when(F.col("term") == "vi", beta[0]).otherwise(beta[1]) * 1e-3, 2) + 0.0).alias("score"))


QUERIES = Q
