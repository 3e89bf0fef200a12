"""Hand-computed fixtures of the core operators."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palabre.functions import domain as D
from palabre.functions import grid as G
from palabre.functions import statistics as X
from palabre.functions.text import fold, slug, words
from palabre.operators import aggregates as A
from palabre.operators import quality as V
from palabre.operators import relational as R
from palabre.operators import statistics as S
from palabre.operators.references import orphan_references, orphan_report
from palabre.operators.resolution import cascade, fill_if_unanimous


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_barrier_breaks_the_chain(spark):
    s = R.segments(spark.createDataFrame([("g", 1, True), ("g", 2, True), ("g", 3, False), ("g", 4, True)], "g string, n int, complete boolean"), "g", "n", "complete")
    p = spark.createDataFrame([("g", 1, "A", 1), ("g", 2, "B", 2), ("g", 3, "A", 3), ("g", 4, "A", 4), ("g", 4, "B", 5)], "g string, n int, who string, v int").join(s, ["g", "n"])
    assert (4, "A", None) in rows(R.asof_barrier(p, "g", "who", "n", "v"), "n", "who", "prev")
    assert (4, "B", 2) in rows(R.asof_barrier(p, "g", "who", "n", "v", strict=False), "n", "who", "prev")


def orphans(spark, refs, parents, **how):
    r = spark.createDataFrame(refs, "line bigint, grp string, ref string, t timestamp, k string")
    p = spark.createDataFrame(parents, "grp string, id string, t timestamp, gone timestamp, h int")
    return rows(orphan_references(r, p, ["grp", "ref"], ["grp", "id"], "line", "t", "t", "gone", **how), "line", "motif")


def test_orphans(spark):
    from datetime import datetime as dt

    early, late = dt(2020, 1, 1), dt(2021, 1, 1)
    parents = [("s", "a", early, None, 1), ("s", "a", late, None, 1), ("s", "b", early, late, 1), ("s", "c", late, None, 1), (None, "d", early, None, 1), ("s", "e", None, None, 1)]
    refs = [(1, "s", "a", early, "x"), (2, "s", "b", late, "x"), (3, "s", "c", early, "x"), (4, "s", "z", early, "x"), (5, None, "d", early, "x"), (6, "s", "c", None, "x"), (7, "s", "", early, "x"), (4, "s", "z", early, "x"), (8, "s", "e", early, "x"), (9, "s", "é" * 50_000, early, "x")]
    want = [(2, "retire"), (3, "tardif"), (4, "absent"), (4, "absent"), (5, "absent"), (7, "absent"), (9, "absent")]
    assert orphans(spark, refs, parents) == want
    assert orphans(spark, refs, parents, range_parents=1, batch_references=2) == want  # many ranges and batches
    assert orphans(spark, [], parents) == []
    assert orphans(spark, refs[:1], []) == [(1, "absent")]


def test_orphans_hot_key_in_batches(spark):
    from datetime import datetime as dt

    refs = [(i, "s", "hot" if i % 3 == 0 else f"k{i}", dt(2020, 1, 1), "x") for i in range(600)]
    parents = [("s", f"k{i}", dt(2019, 1, 1), None, 1) for i in range(0, 600, 2)]
    want = sorted([(i, "absent") for i in range(600) if i % 3 == 0 or i % 2], key=str)
    assert orphans(spark, refs, parents, batch_references=50) == want


def test_orphan_report_with_clashing_names(spark):
    r = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "line int, grp string, motif string")
    f = spark.createDataFrame([(1, "absent")], "line int, motif string")
    assert rows(orphan_report(f, r, "line", [F.col("grp")], "t"), "table_name", "grp", "motif", "n", "n_references") == [("t", "a", "absent", 1, 2)]


def test_merge_and_backfill(spark):
    a = spark.createDataFrame([("k", 30, None), ("l", None, 5)], "k string, age int, day int")
    b = spark.createDataFrame([("k", 31, 7), ("m", 20, 1)], "k string, age int, day int")
    m = {r["k"]: r for r in R.merge_by_preference(a, b, ["k"], {"age": "a", "day": "b"}).collect()}
    assert (m["k"]["age"], m["k"]["age_from"], m["k"]["age_differs"], m["k"]["day"], m["k"]["day_from"]) == (30, "a", True, 7, "b")
    assert (m["l"]["age"], m["l"]["age_from"], m["m"]["day_from"]) == (None, None, "b")
    p = spark.createDataFrame([("x", 2000, 20), ("x", 2003, None), ("x", 2010, 31), ("y", 2000, None)], "p string, y int, age int")
    assert rows(R.nearest_backfill(p, "p", "y", "age", True), "p", "y", "filled") == [("x", 2000, 20), ("x", 2003, 23), ("x", 2010, 31), ("y", 2000, None)]


def test_shares_and_curves(spark):
    c = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("h", "a", 5)], "g string, k string, n int")
    e = {r["g"]: r for r in A.entropy(c, ["g"], "n").collect()}
    assert e["g"]["entropy"] == pytest.approx(1) and e["h"]["entropy"] == 0 and e["g"]["herfindahl"] == pytest.approx(0.5)
    d = spark.createDataFrame([("r", 2), ("r", 4), ("r", None), ("r", 9)], "c string, j int")
    assert rows(A.survival_curve(d, ["c"], "j", 4), "day", "still") == [(1, 3), (2, 3), (3, 2), (4, 2)]
    assert rows(A.histogram(spark.createDataFrame([(0,), (2,), (None,)], "v int"), "v"), "v", "n") == [(0, 1), (1, 0), (2, 1)]
    assert rows(A.mode_smallest(spark.createDataFrame([("g", 2), ("g", 1), ("g", None)], "g string, v int"), ["g"], "v"), "mode", "n") == [(1, 1)]
    w = spark.range(1).select(R.wilson(F.lit(0), F.lit(5), -1).alias("a"), R.wilson(F.lit(5), F.lit(5), 1).alias("b"), R.wilson(F.lit(0), F.lit(0), 1).alias("c")).collect()[0]
    assert w["a"] == pytest.approx(0, abs=1e-9) and w["b"] == pytest.approx(100) and w["c"] is None


def test_exact_tails():
    assert X.binomial_test(5, 10) == pytest.approx(1) and X.binomial_test(0, 10) == pytest.approx(2 / 1024)
    assert X.fisher_exact(3, 0, 0, 3) == pytest.approx(0.1) and X.fisher_exact(0, 0, 0, 0) == 1
    lo, hi = X.clopper_pearson(0, 10)
    assert lo == 0 and hi == pytest.approx(1 - 0.025 ** (1 / 10))
    assert X.student_tail(2.228, 10) == pytest.approx(0.05, abs=1e-4)


def test_benjamini_hochberg(spark):
    d = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 1.0)], "k string, p double")
    got = {r["k"]: r["adjusted"] for r in S.benjamini_hochberg(d, "p").collect()}
    assert got["a"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.16 / 3) and got["b"] == pytest.approx(0.16 / 3) and got["d"] is None and got["e"] == 1


def test_shuffle_keeps_the_labels(spark):
    d = spark.createDataFrame([(b, f"{b}{i}", i % 3) for b in "xy" for i in range(9)], "b string, k string, v int")
    s = S.shuffled(d, ["b"], "k", "v", 3, "seed")
    per = s.groupBy("draw", "b", "v").count().collect()
    assert len(per) == 18 and all(r["count"] == 3 for r in per)
    assert rows(s, "draw", "k", "v") == rows(S.shuffled(d.repartition(7), ["b"], "k", "v", 3, "seed"), "draw", "k", "v")


def test_shrinkage_defaults(spark):
    d = spark.createDataFrame([(0.5, 8), (1.0, 8)], "x double, n int")
    assert [r["shrunk"] for r in S.shrink_normal(d, "x", "n").orderBy("x").collect()] == pytest.approx([(0.5 * 8 + 0.75 * 8) / 16, (8 + 0.75 * 8) / 16])


def test_models_find_their_parameters(spark):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(float)
    c = rng.poisson(2.0 * np.exp(0.3 + 0.5 * x)).astype(float)
    d = spark.createDataFrame([(float(a), float(b), float(k), 2.0, int(i % 50), float(3 + 2 * a)) for i, (a, b, k) in enumerate(zip(x, y, c))], "x double, y double, c double, e double, g int, z double").cache()
    assert S.logit(d, ["x"], "y") == pytest.approx([0.5, 1.2], abs=0.2)
    assert S.poisson(d, ["x"], "c", "e") == pytest.approx([0.3, 0.5], abs=0.1)
    o = {r["term"]: r["estimate"] for r in S.ols(d, ["x"], "z", "g").collect()}
    assert o == pytest.approx({"intercept": 3, "x": 2})
    t = rng.exponential(1 / np.exp(0.8 * x))
    h = spark.createDataFrame([("s", float(round(a, 2)), 1.0, float(b)) for a, b in zip(t, x)], "s string, t double, d double, x double")
    assert S.cox(h, "s", "t", "d", ["x"]) == pytest.approx([0.8], abs=0.15)


def test_luce_and_choice(spark):
    w = spark.createDataFrame([(c, i, i == "a") for c in range(10) for i in "ab"], "contest int, id string, won boolean")
    s = {r["id"]: r["strength"] for r in S.luce(w, 8).collect()}
    assert s["a"] > 5 * s["b"]
    d = spark.createDataFrame([(k, float(v), 1.0 if v == (1 if k % 4 else 0) else 0.0) for k in range(40) for v in (0, 1)], "s int, x double, y double")
    assert S.conditional_logit(d, ["s"], ["x"], "y") == pytest.approx([math.log(3)], abs=1e-6)


def test_change_point_and_runs(spark):
    d = spark.createDataFrame([(i, 0.0 if i < 6 else 10.0) for i in range(12)], "i int, v double")
    best = S.change_point(d, "i", "v").orderBy(F.desc("gain")).first()
    assert best["i"] == 5 and best["gain"] == pytest.approx(300)
    r = spark.createDataFrame([("g", i, c) for i, c in enumerate("aabbbc")], "g string, i int, c string")
    assert rows(A.longest_run(r, ["g"], ["i"], "c"), "longest", "repeats") == [(3, 3)]


WIKI = """{| class="x"
! rowspan=2 | A || colspan="2" | B
|-
| b1 || {{t|p||q}}
|-
| [[l|m]] || n
o
| z
|}"""


def test_grid():
    g = {(r, c): (t, o) for r, c, t, _, o in G.expand_grid(G.wiki_rows(WIKI))}
    assert g[(0, 0)] == ("A", True) and g[(1, 0)] == ("A", False) and g[(0, 2)] == ("B", False)
    assert g[(1, 2)] == ("{{t|p||q}}", True) and g[(2, 0)] == ("[[l|m]]", True) and g[(2, 1)] == ("n\no", True)
    h = G.expand_grid(G.html_rows("<table><tr><th colspan=2>H</th></tr><tr><td rowspan='9'>x</td><td>y <b>z</b></td></tr></table>"))
    assert [(r, c, t) for r, c, t, *_ in h] == [(0, 0, "H"), (0, 1, "H"), (1, 0, "x"), (1, 1, "y z")]
    assert G.wiki_rows("no table") == [] and G.expand_grid([]) == []


def test_matrix_folds_repeated_columns(spark):
    t = "{|\n! n !! s1 !! s1b !! s2\n|-\n! ann\n| x || x || y\n|-\n! bob\n| || || z\n|}"
    c = G.cells(spark.createDataFrame([(1, t), (2, None), (3, "")], "k int, t string"), ["k"], "t")
    assert rows(G.unpivot_matrix(c, ["k"]), "member", "session", "value") == [("ann", "s1", "x"), ("ann", "s2", "y"), ("bob", "s1", ""), ("bob", "s2", "z")]


def test_scalars(spark):
    r = spark.createDataFrame([("54,2", "−3", "Éléonore d'Œuvre", "&lt;b&gt;x&lt;/b&gt;  y", "https://a.b", "h ttp")], "a string, b string, c string, d string, e string, f string").select(
        D.french_number(F.col("a")), D.french_number(F.col("b")), slug(F.col("c")), D.without_tags(F.col("d")), D.web_link(F.col("e")), D.web_link(F.col("f")), fold(F.lit(None).cast("string")), words(F.lit("")), D.first_match(F.col("c"), [("x", ["eleo"]), ("y", ["euvre"])], "z")
    ).collect()[0]
    assert tuple(r) == (54.2, -3.0, "eleonore-d-oeuvre", "x y", "https://a.b", None, None, "", "x")


def test_cascade_and_fill(spark):
    m = spark.createDataFrame([("s", "1", "Ann Lee"), ("s", "2", "Bob Ray"), ("s", "3", "Bob Fox"), ("s", "4", None)], "g string, id string, nom string")
    l = spark.createDataFrame([("s", "ann"), ("s", "BOB"), ("s", "Bob Fox"), ("s", "zed"), ("t", "ann"), ("s", None)], "g string, label string")
    assert rows(cascade(l, m, "g", "label", "id", ["nom"]), "g", "label", "resolved", "how") == sorted([("s", "ann", "1", "prenom"), ("s", "BOB", None, "homonyme"), ("s", "Bob Fox", "3", "nom"), ("s", "zed", None, "inconnu"), ("t", "ann", None, "inconnu"), ("s", None, None, "inconnu")], key=str)
    d = spark.createDataFrame([("ann", "f"), ("ann", None), ("sam", "f"), ("sam", "h"), ("sam", None)], "p string, g string")
    assert rows(fill_if_unanimous(d, "p", "g", "x").filter("g is null"), "p", "x") == [("ann", "f"), ("sam", None)]


def test_quality(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, f string")
    p = spark.createDataFrame([("a",)], "id string")
    r = V.report([V.unique_key(d, ["k"], "pk"), V.foreign_key(d, ["f"], p, ["id"], "fk"), V.violations(d, "low", "warn", F.col("k"), F.col("f") == "a", "m")])
    assert rows(r, "rule", "n", "example") == [("fk", 1, "b"), ("low", 1, "1"), ("pk", 1, "1")]


def test_sources(spark, tmp_path):
    from palabre.sources import files as S_

    assert S_.optional_table(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "a.yml").write_text("lignes:\n- {nom: Ann, taux: '54,2', jour: 2020-01-02}\n- {nom: Bob}\n")
    y = S_.decimal_columns(S_.yaml_records(spark, str(tmp_path / "y"), "nom string, taux string, jour string", "lignes"), ["taux"])
    assert rows(y, "nom", "taux", "jour") == [("Ann", 54.2, "2020-01-02"), ("Bob", None, None)]
    (tmp_path / "n.csv").write_text("sexe;nom;n\n1;Ann;3\n1;Bob;4\n2;Ann;x\n")
    t = S_.separated_with_totals(spark, str(tmp_path / "n.csv"), ["sexe"], "n", spark.createDataFrame([("Ann",)], "nom string"), "nom")
    assert rows(t, "sexe", "total", "mine") == [("1", 7, 3), ("2", None, None)]
    f = S_.fingerprints(spark, str(tmp_path / "y"))
    assert S_.stale(f, f).count() == 0 and S_.stale(f, f.withColumn("print", F.lit("0"))).count() == 1
    S_.write_display(spark.createDataFrame([(1.0, 2.25)], "a double, b double"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), sep=";", header=True).collect()[0].asDict() == {"a": "1", "b": "2,3"}
    assert json.loads("[]") == []


def test_sessions_of_a_stream(spark, tmp_path):
    from datetime import datetime as dt

    from palabre.streaming.sessions import read_events, run_to_table, user_sessions

    e = spark.createDataFrame([(1, dt(2020, 1, 1, 1)), (1, dt(2020, 1, 1, 3)), (1, dt(2020, 1, 1, 23)), (2, dt(2020, 1, 9))], "user_id int, ts timestamp")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    run_to_table(user_sessions(read_events(spark, str(tmp_path / "in"), e.schema)), "sess", str(tmp_path / "cp"), "complete" if False else "append")
    got = rows(spark.table("sess"), "user_id", "n")
    assert got in ([(1, 1), (1, 2)], [(1, 1), (1, 2), (2, 1)])


def test_null_models_draw_by_md5(spark):
    import hashlib

    from palabre.functions.draws import md5_draws
    from palabre.operators import queries_statistics as QS

    keys = ["a", "é|b", "x" * 38, "y" * 70]
    got = md5_draws("seed", keys, 1200)
    assert [[f"{a:016x}{b:016x}" for a, b in got[:, i].T.tolist()] for i in range(4)] == [[hashlib.md5(f"seed|{n}|{k}".encode()).hexdigest() for n in range(1, 1201)] for k in keys]
    assert QS.DRAWS == 10_000
    people = [(f"s{s}", f"p{i}", "rb"[i % 2], i) for s in range(3) for i in range(6)]
    c = spark.createDataFrame(people, "saison string, id string, couleur string, jour int")
    drawn = S.shuffled(c, ["saison"], "id", "couleur", 11, "seed").join(c.select("saison", "id", "jour"), ["saison", "id"])
    old = drawn.groupBy("draw", "saison", "couleur").agg(F.avg("jour").alias("m")).groupBy("draw", "saison").agg(F.var_samp("m").alias("v")).groupBy("draw").agg(F.avg("v").alias("x"))
    g = c.groupBy("saison").agg(F.sort_array(F.collect_list(F.struct("id", "jour", "couleur"))).alias("m")).select(F.col("m.id").alias("keys"), F.col("m.jour").alias("jour"), F.col("m.couleur").alias("couleur"))
    new = S.null_draws(g, "keys", 11, "seed", QS._between_colours)
    assert {r["draw"]: r["x"] for r in new.collect()} == pytest.approx({r["draw"]: r["x"] for r in old.collect()})


def test_luce_ends_at_its_fixed_point(spark):
    from palabre.session import cut

    people = [(c, f"p{(c * k) % 9}", k == (1 if c < 6 else 4)) for c in range(1, 9) for k in (1, 2, 4)] + [(99, "p1", False), (99, "p2", False)]
    got = S.luce(spark.createDataFrame(people, "contest int, id string, won boolean"), 500, cut=cut, tolerance=1e-10)
    s = {r["id"]: (r["wins"], r["strength"]) for r in got.collect()}
    exposure = {i: sum(1 / sum(s[p][1] for k, p, _ in people if k == c) for c, q, _ in people if q == i and c != 99) for i in s}
    assert {i: x for i, (_, x) in s.items()} == pytest.approx({i: (s[i][0] + 0.5) / (exposure[i] + 0.5) for i in s}, abs=1e-9)
    with pytest.raises(RuntimeError):
        S.luce(spark.createDataFrame(people, "contest int, id string, won boolean"), 2, cut=cut, tolerance=1e-10)


def test_clusters_beyond_four_and_without_outliers(spark):
    from pyspark.ml.linalg import Vectors

    from palabre.operators.queries_statistics import _best_clusters

    rng = np.random.default_rng(3)
    at = [(0, 0), (10, 0), (0, 10), (10, 10), (5, 20)]
    blobs = [Vectors.dense(*rng.normal(c, 0.3)) for c in at for _ in range(40)]
    groups = lambda rows: sorted(r["count"] for r in _best_clusters(spark.createDataFrame([(v,) for v in rows], ["features"]).cache()).groupBy("prediction").count().collect())
    assert groups(blobs) == [40] * 5


def test_every_table_of_a_text_and_wide_spans(spark):
    from palabre.functions import grid as G

    text = "{|\n| a || colspan=2000 | b\n|}\nx\n{|\n! c\n|-\n| rowspan=99999 d\n|}"
    t = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "<table><tr><td>e</table> <TABLE><tr><th colspan=2>f</TABLE>")], "id int, text string")
    c = G.table_cells(t, ["id"], "text").collect()
    assert {(r["id"], r["table"]) for r in c} == {(1, 0), (1, 1), (4, 0), (4, 1)}
    assert sum(r["table"] == 0 and r["id"] == 1 for r in c) == 1001  # a span of columns ends at 1000, as in HTML
    assert [(r["row"], r["text"]) for r in c if r["id"] == 1 and r["table"] == 1] == [(0, "c"), (1, "d")]
    assert sum(r["id"] == 4 and r["text"] == "f" for r in c) == 2


def test_pages_without_anything(spark):
    from palabre.functions import wiki as K

    t = spark.createDataFrame([(1, None), (2, ""), (3, "texte"), (4, "{{Infobox\n| a2 = x\n| vide =\n}}\n| b = y\n== T ==\nc")], "id int, text string")
    assert sorted(map(tuple, K.infobox(t, ["id"], "text").collect())) == [(4, "a", 2, "x")]
    assert sorted(map(tuple, K.sections(t, ["id"], "text").collect())) == [(4, "T", "c")]
    assert K.by_header(t, ["id"], "text", {"x": ["x"]}).count() == 0


def test_global_rank_is_a_row_number(spark):
    from palabre.operators.aggregates import global_rank
    from palabre.session import cut

    d = spark.createDataFrame([(i, i % 7) for i in range(500)], "id int, v int").repartition(9)
    got = global_rank(d, [F.col("v").desc(), F.col("id").asc()], "rank", cut).collect()
    want = sorted(((i, i % 7) for i in range(500)), key=lambda x: (-x[1], x[0]))
    assert [(r["id"], r["v"]) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1, 501))
    assert global_rank(d.limit(0), [F.col("id").asc()], "rank", cut).count() == 0


def test_family_of_a_list(spark):
    from palabre.functions.domain import family_of
    from palabre.functions.text import words

    v = spark.createDataFrame([("Ancien maçon, Lyon",), ("maçon boulanger",), ("dompteur",), (None,), ("",)], "v string")
    e = spark.createDataFrame([("b", "Maçon", "chantier"), ("a", "Boulanger", "bouche"), ("c", None, "x"), ("d", "", "y")], "code string, libelle string, poste string")
    assert sorted(map(tuple, family_of(v, "v", words, e, "libelle", "code", "poste").collect())) == [("Ancien maçon, Lyon", "chantier"), ("maçon boulanger", "bouche")]
    assert family_of(v, "v", words, e.limit(0), "libelle", "code", "poste").count() == 0


def test_cards_are_one_file_a_value(spark, tmp_path):
    from palabre.sources.files import read_cards, write_cards

    odd = ["a b/é%+", "", None, "_x", "s0000001"]
    d = spark.createDataFrame([(v, f"p{i}", i) for i in range(50) for v in odd], "saison string, id string, age int").repartition(8)
    write_cards(d, "saison", f"file:{tmp_path}/cards", 3)
    assert len([f for f in (tmp_path / "cards").iterdir() if f.suffix == ".json"]) == len(odd)
    assert rows(read_cards(spark, "saison", f"file:{tmp_path}/cards", "id string, age int", 2), "saison", "id", "age") == rows(d, "saison", "id", "age")


def test_cards_of_a_season_come_from_one_task(spark, tmp_path, monkeypatch):
    from palabre.operators import queries_wide

    spark.createDataFrame([(f"s{i % 7}", f"p{i}", "x", i) for i in range(70)], "saison string, id string, nom string, age int").repartition(5).write.parquet(f"{tmp_path}/participations.parquet")
    monkeypatch.setattr(queries_wide, "_folder", lambda *_: f"file:{tmp_path}/cards")
    assert rows(queries_wide.s11_a_file_a_card(spark, str(tmp_path)), "fichier", "n") == [(f"s{i}.json", 10) for i in range(7)]
    assert len([f for f in (tmp_path / "cards").rglob("*.json") if not f.name.startswith(("_", "."))]) == 7


def test_robust_leaders_leave_no_row_a_draw(spark):
    from conftest import DATA

    from palabre.operators import queries_nulls

    rng = np.random.default_rng(1)
    z, w = [rng.integers(-3, 4, 9).astype(float) for _ in range(3)], rng.random((3, 40))
    brute = [max((sum(float(z[k][i]) * float(w[k][t]) for k in range(3)), i) for i in range(9))[1] for t in range(40)]
    assert queries_nulls._leads(z, w).tolist() == np.bincount(brute, minlength=9).tolist()
    assert "draw" not in queries_nulls.st14_robust_leaders(spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["t07_votes_within_a_gender", "t13_target_again", "t14_ballots_returned"])
def test_sessions_that_pay_the_same_in_every_deal_are_not_hashed(query):
    """By what a session pays: one gender of targets or voters, nobody named before, nobody to return a vote to."""
    from palabre.functions.draws import md5_draws
    from palabre.operators import queries_nulls as N

    alike = {"t07_votes_within_a_gender": [[1, 0, 1], [1, 0, 1], [1, 0, 1]], "t13_target_again": [[0, 0], [0, 0]], "t14_ballots_returned": [[0, 0, 0]] * 3}[query]
    other = {"t07_votes_within_a_gender": [[1, 0], [0, 1]], "t13_target_again": [[0, 0], [2, 1]], "t14_ballots_returned": [[0, 1, 0], [0, 0, 0], [0, 0, 0]]}[query]
    value = N._dealt_alike({"pays": alike})
    assert (N._dealt_share(md5_draws("seed", list("abc")[: len(alike)], 50), {"pays": alike}) == value).all()
    dealt = N._dealt_share(md5_draws("seed", list("abc")[: len(other)], 50), {"pays": other})
    assert N._dealt_alike({"pays": other}) is None and len(set(dealt)) > 1


def test_dealt_sessions_are_hashed_and_placed_without_a_sort(monkeypatch):
    """t07, t14: digests of keys that share a beginning, of one or several blocks, and places in their order; only equal halves are sorted."""
    from hashlib import md5

    from palabre.functions import draws as D

    for seed, keys in (("sexe", [f"s|7|{i:04d}" for i in range(12)]), ("q" * 60, ["a", "b", "é" * 40, "a"]), ("retour", ["s|7|0001"]), ("q" * 118, ["ab", "ac"])):
        h = D.md5_draws(seed, keys, 1012)
        for i, key in enumerate(keys):
            for t in (1, 9, 10, 99, 100, 999, 1000, 1012):
                assert f"{h[0, i, t - 1]:016x}{h[1, i, t - 1]:016x}" == md5(f"{seed}|{t}|{key}".encode()).hexdigest()
    h = np.random.default_rng(1).integers(0, 2**64, (2, 12, 200), dtype=np.uint64)
    h[0, 3, 5], h[:, 4, 6] = h[0, 2, 5], h[:, 1, 6]
    want = np.lexsort((h[1], h[0]), axis=0).argsort(0)
    assert (D.places(h) == want).all()
    wide = np.concatenate([h[:, :, 10:]] * 6, 1)
    assert (D.places(wide) == np.lexsort((wide[1], wide[0]), axis=0).argsort(0)).all()
    monkeypatch.setattr(D.np, "lexsort", None)
    assert (D.places(h[:, :, 10:]) == want[:, 10:]).all()


@pytest.mark.parametrize("seed, keys", [("retour", [f"s0000016|3|{i:04d}" for i in range(9)]), ("q" * 55, ["a", "b", "\u00e9" * 40, "a", "c" * 70]), ("cible", ["ab", "ac"])])
def test_dealt_sessions_are_summed_in_the_jvm(spark, seed, keys):
    """t14 (t07, t13): the same sums as by hashlib, one block or several, an item whose worth is unknown and equal keys, and as many as sessions."""
    from hashlib import md5

    from pyspark.sql.types import ArrayType, DoubleType

    from palabre.session import java_function

    n = len(keys)
    pays = np.random.default_rng(2).integers(-1, 3, (n, n)).astype(object)
    pays[:, -1] = None
    same = np.ones((n, n), int)
    same[:, 0] = 4
    g = [(keys, pays.ravel().tolist()), (keys, same.ravel().tolist()), (keys, [None] * (n * n))]
    df = spark.createDataFrame([(g,)], "g array<struct<keys: array<string>, pays: array<int>>>").coalesce(1)
    f = java_function(spark, "Dealt", ArrayType(DoubleType()))
    got = df.select(F.call_udf(f, F.struct("g"), F.lit(seed), F.lit(1012)).alias("s")).first().s
    for t, s in enumerate(got, 1):
        order = sorted(range(n), key=lambda j: (md5(f"{seed}|{t}|{keys[j]}".encode()).digest(), j))
        assert s == pytest.approx(np.mean([pays[i, j] for i, j in enumerate(order) if pays[i, j] is not None]) + same.diagonal().mean())


def test_ballots_returned_are_dealt_without_python(spark, monkeypatch):
    """t14: neither hashed nor placed by numpy where the JVM can do it, and the same row by numpy."""
    from conftest import DATA

    from palabre.operators import queries_nulls as N

    way = S.null_draws
    monkeypatch.setattr(N, "DRAWS", 200)
    monkeypatch.setattr(S, "null_draws", None)
    row = N.t14_ballots_returned(spark, DATA).collect()
    monkeypatch.setattr(S, "null_draws", way)
    monkeypatch.setattr(N, "java_function", lambda *_: None)
    assert N.t14_ballots_returned(spark, DATA).collect() == row


def test_ballots_returned_on_odd_ballots(spark, tmp_path):
    """t14: a target that isn't known, lists that are null or empty, annulled ballots and an unread session before, as in SQL."""
    import duckdb
    from conftest import DATA, canonical

    from palabre.operators import queries_nulls as N

    v = lambda a, b, out=False, known=True: (a, True, b, known, out)
    votes = {
        1: [v("a", "b"), v("c", "b"), v("b", "a"), v("d", "b", True), v(None, "c"), v("a", None)],
        2: [v("b", "a"), v("a", "b"), v("c", None), v("d", "c", None), v(None, "a"), v("b", "c", known=None)],
        3: None, 4: [v("a", "b"), v("b", "c")], 5: [], 6: [v("a", "b"), v("b", "a"), v("c", "a")], 7: [v("a", "c"), v("c", "b"), v("b", "a")], 8: [v("x", None), v("y", None)],
    }
    rows = [(i, s, n, None if n == 2 else "elimination", n != 6, x) for i, (s, n, x) in enumerate([("s1", n, x) for n, x in votes.items()] + [("s2", None, votes[1]), ("s2", 4, votes[2]), (None, 1, votes[1]), (None, 2, votes[2])])]
    kind = "ligne long, saison string, numero int, type string, complet boolean, votes array<struct<votant string, votant_rattache boolean, cible string, cible_rattachee boolean, annule boolean>>"
    texts = ["episode", "elimine", "annulation"]
    c = spark.createDataFrame(rows, kind).withColumns({x: F.lit(None).cast("string") for x in texts} | {x: F.lit(0) for x in ("votes_contre", "votes_exprimes")} | {"elimine_rattache": F.lit(True), "maj": F.lit("2020-01-01").cast("timestamp")})
    c.coalesce(1).write.parquet(str(tmp_path / "conseils.parquet"))
    duck = duckdb.connect()
    for name in ("participations", "saisons"):
        duck.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    duck.execute(f"create view conseils as select * from read_parquet('{tmp_path}/conseils.parquet/*.parquet')")
    got, want = N.t14_ballots_returned(spark, str(tmp_path)), duck.sql(N.SQL["t14_ballots_returned"])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)
