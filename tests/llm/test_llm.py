"""The operators on training data against brute force and hand-made fixtures."""

import random
import re
import unicodedata
from collections import Counter
from datetime import datetime as dt
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from palabre.llm import bpe, canonical, glyphs, identities, linkage, mixing, names, spam_pages, survivors

LONG = "mot " * 60_000


def rows(df, *cols):
    return sorted(map(tuple, df.select(*(cols or df.columns)).collect()), key=str)


# ---- 1 canonical lists -----------------------------------------------------------------------------

JOBS = [("m1", "Sapeur-pompier"), ("m2", "Expert-comptable"), ("m3", "Comptable"), ("m4", "Hôte de l'air")]


def test_similarity_search_is_exact():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 6)))
    a = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(150)})
    b = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)})
    grams = lambda t: {f"_{w}_"[i : i + 2] for w in t.split() for i in range(len(w) + 1)}
    for least in (0.44, 0.7):
        rarity = Counter(p for y in b for p in canonical.pairs(y))
        index = canonical.Index([(y, y) for y in b], frozenset(b), dict(rarity), least)
        want = {(x, y): len(grams(x) & grams(y)) / len(grams(x) | grams(y)) for x in a for y in b}
        want = {k: pytest.approx(v) for k, v in want.items() if v >= least}
        assert {(x, b[k]): s for x in a for k, s in index.similar(x)} == want


def test_values_are_mapped(spark):
    vals = ["Sapeur-pompier", "SAPEUSE POMPIERE", "sapeur-pomipier", "Exprt-comptable", "comptable à mi-temps", "Pompier pro", "dompteur", "", "  ", None, "hotesse de l'air", LONG, "Comptable, Lyon"]
    d = spark.createDataFrame([(i, v, "x", "y") for i, v in enumerate(vals * 2)], "ligne int, job string, v string, code string")
    got = {r["ligne"]: r["code"] for r in canonical.map_column(d, "ligne", "job", JOBS, synonyms=[("pompier pro", "m1")], genders=True).collect()}
    n = len(vals)
    want = {1: "m1", 2: "m1", 3: "m2", 4: "m3", 5: "m1", 6: "", 7: "", 8: "", 10: "m4", 11: "", 12: "m3"}
    assert {k: got.get(k) for k in want} == want and 0 not in got and 9 not in got
    assert all(got[k + n] == v for k, v in want.items())
    assert canonical.map_column(d.limit(0), "ligne", "job", JOBS).count() == 0
    assert {r["code"] for r in canonical.map_column(d, "ligne", "job", []).collect()} == {""}


def test_words_cut_short_and_slips_in_short_words(spark):
    """Another domain: a list of devices."""
    devices = [("d1", "Perceuse à colonne"), ("d2", "Scie circulaire plongeante"), ("d3", "Étau"), ("d4", "Rabot"), ("d5", "Visseuse")]
    vals = {"perc colonne": "d1", "SCP": "d2", "scie circ plong": "d2", "rabbot": "d4", "Éteau": "d3", "viss": "d5", "la rabot bleu": "d4", "rabbot bleu": "", "perceuse": "d1", "marteau": ""}
    d = spark.createDataFrame([(k,) for k in vals], "v string")
    assert {r["v"]: r["code"] for r in canonical.map_values(d, devices).collect()} == vals


def test_forms_are_learned_from_other_rows(spark):
    """People who once wrote the entry of the list tell what their other words mean."""
    data = [(f"p{i}", v) for i in range(6) for v in ("Comptable", f"gratte papier n {i}")] + [("q", "Comptable"), ("q", "dompteur"), ("r", "dompteur"), (None, "x"), ("s", None)]
    d = spark.createDataFrame(data, "id string, job string")
    mapped = canonical.map_values(d.select(F.col("job").alias("v")).dropna(), JOBS)
    learned = canonical.learn_forms(d, ["id"], "job", mapped, JOBS)
    assert ("gratte", "m3") in learned and not [x for x in learned if "dompteur" in x[0]]
    again = canonical.map_values(d.select(F.col("job").alias("v")).dropna(), JOBS, synonyms=learned)
    assert {r["code"] for r in again.filter("v like 'gratte%'").collect()} == {"m3"}
    assert canonical.learn_forms(d.limit(0), ["id"], "job", mapped, JOBS) == []


# ---- 2 spellings of names --------------------------------------------------------------------------

PEOPLE = [("virginie-brobol", "Virginie Brobol", "Virginie"), ("noemie-tibum", "Noémie Tibum", "Noémie"), ("theo-tibum", "Théo Tibum", "Théo"), ("jean-luc-crivi", "Jean-Luc Crivi", "Jean-Luc"), ("ann-lee-wong", "Ann Lee Wong", None)]


def links(spark, part, councils=(), people=PEOPLE):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(part)], "ligne int, saison string, id string, nom string, nom_complet string")
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(councils)], "ligne int, saison string, elimine string, elimine_rattache boolean")
    q = spark.createDataFrame(list(people), "id string, nom string, prenom string")
    return {(r["origine"], r["ligne"]): r["id"] for r in identities.spelling_links(p, c, q).collect()}


def test_spellings_are_linked(spark):
    part = [
        ("s", "virg-brobol", "Virg Brobol", None), ("s", "brobol-virginie", "BROBOL, Virginie", "BROBOL, Virginie"), ("s", "noemye-tibom", "Noémye Tibom", None), ("s", "t-tibum", "T. Tibum", None),
        ("s", "x-tibum", "X Tibum", None), ("s", "jl-crivi", "J.-L. Crivi", None), ("s", "virginie-nini-brobol", "Virginie « Nini » Brobol", None), ("s", "nini-brobol", "Nini Brobol", None), ("s", "noemie-tibum", "Noémie Tibum", None),
        ("s", None, None, None), ("s", "", "", ""), ("s", "zed-zed", "Zed Zedovic", None), ("s", "long", LONG, None), ("s", "virg-brobol", "Virg Brobol", None), ("s", "theoparis-tibum", "ThéoTibum", None),
    ]
    councils = [("s", "Tibum Noemie", False), ("s", "Théo", False), ("s", "Théo", True), ("s", "tirage au sort", False), ("t", "Théo Tibum", False), ("s", None, False), ("s", "", False), ("s", LONG, False), ("s", "Théo", None), ("s", "V. Brobol", False)]
    got = links(spark, part, councils)
    p = {k[1]: v for k, v in got.items() if k[0] == "participations"}
    assert p == {0: "virginie-brobol", 1: "virginie-brobol", 2: "noemie-tibum", 3: "theo-tibum", 5: "jean-luc-crivi", 6: "virginie-brobol", 7: "virginie-brobol", 13: "virginie-brobol", 14: "theo-tibum"}
    assert {k[1]: v for k, v in got.items() if k[0] == "conseils"} == {0: "noemie-tibum", 1: "theo-tibum", 9: "virginie-brobol"}
    assert links(spark, [], []) == {}
    assert links(spark, part[:1], [], []) == {}


def test_a_spelling_taken_over_links_another(spark):
    """Two slips away from the person, one from a spelling that was merged before."""
    part = [("s", "a", "Virginie Brobel", None), ("s", "b", "Virginie Brabel", None)]
    assert links(spark, part) == {("participations", 0): "virginie-brobol", ("participations", 1): "virginie-brobol"}


def test_names_of_any_length_are_read(spark):
    """Family names of two and three letters, names of nine words, given names of four."""
    people = [("anh-le", "Anh Le", "Anh"), ("tom-roy", "Tom Roy", "Tom"), ("long", "Ana Maria Da Silva Pereira Costa Lima Souza Alves", "Ana"), ("four", "Jean Paul Marie Yves Tavernier", "Jean Paul Marie Yves")]
    part = [("s", "le-anh", "LE Anh", None), ("s", "t-roy", "T. Roy", None), ("s", "x", "Ana Maria Da Silva Pereira Costa Lima Souza Alvez", None), ("s", "y", "Tavernier Jean-Paul-Marie-Yves", None), ("s", "rey", "Tom Rey", None)]
    got = links(spark, part, people=people)
    assert {k[1]: v for k, v in got.items()} == {0: "anh-le", 1: "tom-roy", 2: "long", 3: "four"}


def test_nicknames_are_learned(spark):
    """A form that no rule explains, met beside two family names of people who have the same given name."""
    people = [(f"p{i}", f"Isabelle {f}", "Isabelle") for i, f in enumerate(("Marovin", "Tesquelet", "Brindacier"))] + [("o", "Karim Zorvat", "Karim")]
    part = [("s", "a", "Zaza Marovin", None), ("s", "b", "Tesquelet Zaza", None), ("s", "c", "Zaza Brindacier", None), ("s", "d", "Momo Zorvat", None)]
    assert {k[1]: v for k, v in links(spark, part, people=people).items()} == {0: "p0", 1: "p1", 2: "p2"}


def test_initials_that_are_also_particles(spark):
    people = [("ludivine-maronet", "Ludivine Maronet", "Ludivine"), ("dominique-tassin", "Dominique Tassin", "Dominique")]
    part = [("s", "a", "L. Maronet", None), ("s", "b", "Tassin D.", None)]
    assert {k[1]: v for k, v in links(spark, part, people=people).items()} == {0: "ludivine-maronet", 1: "dominique-tassin"}


def test_unlisted_spellings_are_one_entity(spark):
    part = [("s", "a", "Nicolas Dupertuis", None), ("s", "b", "Dupertuis Nicolas", None), ("s", "c", "Nicollas Dupertuis", None), ("s", "d", "Paul Autremer", None), ("t", "c", "Nicollas Dupertuis", None)]
    p = spark.createDataFrame(part, "saison string, id string, nom string, nom_complet string")
    q = spark.createDataFrame(PEOPLE, "id string, nom string, prenom string")
    people, _, targets, nicks = identities.link_people(p, q)
    ent = {(r["saison"], r["id"]): r["ent"] for r in identities.entities(people, targets.select("g").distinct(), nicks).collect()}
    assert ent["s", "a"] == ent["s", "b"] == ent["s", "c"] != ent["s", "d"]


def test_edits_equal_brute_force():
    rng = random.Random(6)

    def osa(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return min(3, d[-1][-1])

    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert names.edits(a, b) == osa(a, b)


def test_close_words_equals_brute_force(spark):
    rng = random.Random(5)
    ws = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(120)})

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[j - 1] + 1, d[j - 1] + (x != y)))
            d = e
        return d[-1]

    w = spark.createDataFrame([(x,) for x in ws], "w string")
    got = {(r["a"], r["b"]) for r in names.close_words(w.select(F.col("w").alias("a")), w.select(F.col("w").alias("b")), 99).collect()}
    assert {(a, b) for a in ws for b in ws if lev(a, b) <= 1} <= got
    swaps = {(a, a[:i] + a[i + 1] + a[i] + a[i + 2 :]) for a in ws for i in range(len(a) - 1)}
    assert {x for x in swaps if x[1] in ws} <= got


# ---- 3 linkage ---------------------------------------------------------------------------------------


def test_label_model_recovers_matches():
    rng = np.random.default_rng(2)
    chance = [np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.array([0.05, 0.05, 0.9]), np.array([0.02, 0.1, 0.88]), np.array([0.5, 0.1, 0.4])]
    truth = rng.random(4000) < 0.6
    votes = np.column_stack([rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)] + [np.where(truth, rng.choice(3, 4000, p=p), rng.choice(3, 4000, p=c)) for p, c in zip(([0.8, 0.1, 0.1], [0.7, 0.1, 0.2], [0.9, 0.1, 0.0]), chance[2:])])
    pat, inv, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post = linkage.label_model(pat, n.astype(float), chance, np.full(len(pat), 0.7))[inv.ravel()]
    assert ((post >= 0.5) == truth).mean() > 0.95


def test_sources_are_linked(spark):
    part = [(f"s{i % 2}", f"p{i}", f"Prénom{'abcdefghij'[i]} Famil{'qrstuvwxyz'[i] * 3}ec", None, 20 + i, "Comptable", None, "f") for i in range(10)]
    cards = [(i, f"Titre Alpha{'un' if i % 2 else 'deux'} 2001" if i % 3 else f"Saison {i % 2 + 1}", f"Prénom{'abcdefghij'[i]} Famil{'qrstuvwxyz'[i] * 3}ec", 20 + i, "comptable", None, "femme") for i in range(10)]
    cards += [(99, None, None, None, None, None, None), (98, "", "", 0, "", "", ""), (97, "Saison 1", "Inconnu Personne", 30, LONG, "x", "homme"), cards[4]]
    p = spark.createDataFrame(part, "saison string, id string, nom string, nom_complet string, age int, profession string, localisation string, genre string")
    c = spark.createDataFrame(cards, "fiche int, edition string, libelle string, age int, metier string, ville string, genre string")
    q = spark.createDataFrame([(x[1], x[2], x[2].split()[0]) for x in part], "id string, nom string, prenom string")
    g = spark.createDataFrame([("s0", 1, "Titre Alphadeux", 2001), ("s1", 2, "Titre Alphaun", 2001)], "id string, numero int, titre string, annee int")
    run = lambda p, c: linkage.link_sources(p, c, q, g, partial(canonical.map_values, entries=JOBS), partial(canonical.map_values, entries=[]))
    got = run(p, c)
    assert rows(got, "saison", "id", "fiche") == sorted([(f"s{i % 2}", f"p{i}", i) for i in range(10)], key=str)
    assert all(0.5 <= r["confidence"] <= 1 for r in got.collect())
    assert run(p.limit(0), c).count() == 0 and run(p, c.limit(0)).count() == 0


def test_title_between_two_is_looked_up_in_both(spark):
    g = spark.createDataFrame([("s0", 1, "Rosurelao", 2001), ("s1", 2, "Rosulelao", 2002), ("s2", 3, "Cap sur Rosuelaon", 2003)], "id string, numero int, titre string, annee int")
    e = spark.createDataFrame([("Rosuelao",), ("Rosurelao",), ("Rosurelao 2001",), ("Saison 3",), ("Autre chose",)], "edition string")
    got = {(r["edition"], r["saison"]): r["off"] for r in linkage.resolve_groups(e, g).collect()}
    assert got[("Rosuelao", "s0")] == got[("Rosuelao", "s1")] == got[("Rosurelao", "s0")] == got[("Saison 3", "s2")] == 0
    assert ("Rosurelao 2001", "s1") not in got and got[("Rosurelao", "s1")] == 1 and not [k for k in got if k[0] == "Autre chose"]
    part = [(f"s{i % 2}", f"p{i}", f"Prénom{'abcdefghij'[i]} Famil{'qrstuvwxyz'[i] * 3}ec", None, 20 + i, "Comptable", None, "f") for i in range(10)]
    cards = [(i, "Rosuelao" if i % 2 else "Inconnue au bataillon", part[i][2], 20 + i, "comptable", None, "femme") for i in range(10)]
    p = spark.createDataFrame(part, "saison string, id string, nom string, nom_complet string, age int, profession string, localisation string, genre string")
    c = spark.createDataFrame(cards, "fiche int, edition string, libelle string, age int, metier string, ville string, genre string")
    q = spark.createDataFrame([(x[1], x[2], x[2].split()[0]) for x in part], "id string, nom string, prenom string")
    out = linkage.link_sources(p, c, q, g, partial(canonical.map_values, entries=JOBS), partial(canonical.map_values, entries=[]))
    assert rows(out, "saison", "id", "fiche") == sorted([(f"s{i % 2}", f"p{i}", i) for i in range(10)], key=str)


def test_forms_are_learned_in_a_season_where_no_family_name_is_one_persons(spark):
    names_ = ["Titovard", "Mulochet", "Garibeau"]
    q = spark.createDataFrame([(f"{g}-{f}", f"{g} {f}", g) for f in names_ for g in ("Christophe", "Hélène")], "id string, nom string, prenom string")
    p = spark.createDataFrame([(f"s{i}", f"Christophe-{f}", f"Christophe {f}", None) for i, f in enumerate(names_)], "saison string, id string, nom string, nom_complet string")
    seen = spark.createDataFrame([(f"s{i}", f"tof {f.lower()}") for i, f in enumerate(names_)], "saison string, n string")
    assert rows(identities.link_people(p, q, evidence=seen, seen=seen)[3], "nick", "given") == [("tof", "christophe")]


def test_typed_name_of_two_is_that_of_who_stands_in_the_season(spark):
    people = spark.createDataFrame([("s", "a", "anna borvilet", "a"), ("s", "x", "anna borvolet", None), ("t", "x", "anna borvolet", None)], "saison string, id string, n string, pid string")
    full = spark.createDataFrame([("anna borvolet", "anna|borvilet", 1.0), ("anna borvolet", "anna|borvalet", 1.0)], "n string, own string, cost double")
    listed = spark.createDataFrame([("a", "anna", "anna|borvilet"), ("b", "anna", "anna|borvalet")], "pid string, g string, sp string")
    assert rows(linkage._linked_within(people, full, listed), "saison", "id", "pid") == sorted([("s", "a", "a"), ("s", "x", "a"), ("t", "x", None)], key=str)


# ---- 4 survivors ---------------------------------------------------------------------------------------

PREFS = [("age", "wikipedia-fr", 1), ("age", "fandom", 2), ("day", "fandom", 1)]


def best(spark, data, at_least=2):
    d = spark.createDataFrame(data, "line int, g string, age int, day int, src map<string,string>, t timestamp, v string, champ string")
    p = spark.createDataFrame(PREFS, "champ string, source string, rang int")
    f = [survivors.Field("age", F.col("age")), survivors.Field("day", F.col("day"))]
    return rows(survivors.best_values(d, p, ["g"], "line", "t", "src", f, at_least), "g", "champ", "line" if False else "ligne")


def test_trust_then_time(spark):
    a, b = dt(2020, 1, 1), dt(2021, 1, 1)
    data = [
        (5, "g", 30, None, {"age": "Wikipédia FR"}, a, "x", "y"), (2, "g", 31, 4, {"age": "wiki Fandom", "day": "blog"}, b, "x", "y"), (9, "g", 30, 5, {"age": "?"}, b, None, None),
        (1, "h", 20, None, None, a, None, None), (3, "h", 21, None, {}, b, None, None), (4, "alone", 50, 1, {"age": "fandom"}, b, None, None),
        (7, "tie", 40, None, {"age": "fandom"}, a, None, None), (6, "tie", 41, None, {"age": "fandom"}, a, None, None), (8, None, 18, None, {}, a, None, None), (10, None, 18, None, {}, a, None, None),
    ]
    want = sorted([("g", "age", 5), ("g", "day", 2), ("h", "age", 3), ("tie", "age", 6), (None, "age", 8)], key=str)
    assert best(spark, data) == want
    assert best(spark, data + data[:2] + [(11, "n", None, None, None, a, None, None)] * 2) == want
    assert best(spark, []) == []


def test_precedence_where_times_are_missing(spark):
    a, b = dt(2020, 1, 1), dt(2021, 1, 1)
    data = [(i, f"k{i // 2}", 20 + i % 2, None, {}, a if i % 2 == 0 else b, None, None) for i in range(20)]
    data += [(101, "open", 21, None, {}, None, None, None), (100, "open", 20, None, {}, None, None, None)]
    assert ("open", "age", 101) in best(spark, data)  # 21 follows 20 elsewhere, though line 100 is smaller
    assert survivors.precedence.__doc__


def test_order_of_values_is_transitive(spark):
    """20 before 21 and 21 before 22 are learned; 20 and 22 never meet but here. A weak precedence against the order is left out."""
    t = lambda k: dt(2020, 1, k)
    data = [(100 * g + i, f"k{g}", v, None, {}, t(1 + i), None, None) for g in range(6) for i, v in enumerate((20, 21) if g < 3 else (21, 22))]
    data += [(900, "back", 22, None, {}, t(1), None, None), (901, "back", 20, None, {}, t(2), None, None)]
    data += [(1, "open", 22, None, {}, None, None, None), (2, "open", 20, None, {}, None, None, None), (4, "half", 20, None, {}, t(9), None, None), (5, "half", 22, None, {}, None, None, None)]
    got = best(spark, data)
    assert ("open", "age", 1) in got and ("half", "age", 5) in got


def test_survivors_equal_brute_force(spark):
    rng = random.Random(7)
    src = [None, "fandom", "wikipedia-fr", "Wikipédia FR (x)", "blog"]
    data = [(i, f"g{rng.randint(0, 30)}", rng.choice([None, 20, 21, 22]), None, {"age": s} if (s := rng.choice(src)) else {}, dt(2020, 1, rng.randint(1, 28)), None, None) for i in range(200)]
    rank = {"fandom": 2, "wikipedia-fr": 1, "Wikipédia FR (x)": 1}
    want = []
    for g in {x[1] for x in data}:
        mine = [x for x in data if x[1] == g]
        ok = [x for x in mine if x[2] is not None]
        if len(mine) > 1 and ok:
            key = lambda x: (-rank.get(x[4].get("age"), 99), x[5])
            top = max(map(key, ok))
            first = {v: min(x[0] for x in ok if x[2] == v) for v in {x[2] for x in ok if key(x) == top}}
            want.append((g, "age", min(first.values())))
    assert best(spark, data) == sorted(want, key=str)


# ---- 5 glyphs --------------------------------------------------------------------------------------------


def test_one_form():
    same = ["Svetlana", "Светлана Борвумоманд", "Γιώργος", "Đorđe", "Łukasz", "Şirin", "Åsa", "Jérôme « Jé » D.", "", "œuf", "نام", "می‌روم", "Anne-Sophie", "Борис Smith"]
    assert [glyphs.consistent(x) for x in same] == same
    pairs = {
        "Ｍａｒｉｅ－Ｌａｕｒｅ　Ｆ": "Marie-Laure F", "Béné": "Béné", "Béne‌́": "Béné", "Le Bris": "Le Bris", "​Noël": "Noël", "Аntоіnе": "Antoine", "Kéνin": "Kévin", "Sandrin𝚎": "Sandrine",
        "Sébaﬆien": "Sébastien", "Jean‑Luc": "Jean-Luc", "Pau­line": "Pauline", "Борис‍ Тр": "Борис Тр", "Дмитрий": "Дмитрий", "Cаmіllе": "Camille", "Бoрис": "Борис",
    }
    assert {k: glyphs.consistent(k) for k in pairs} == pairs
    assert glyphs.consistent(None) is None and glyphs.consistent("é" * 50_000) == "é" * 50_000
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice("aéñz -Жжωо́​ Ａ𝚊") for _ in range(12))
        once = glyphs.consistent(t)
        assert glyphs.consistent(once) == once and unicodedata.is_normalized("NFC", once)


def test_mapping_has_no_conflicts_and_the_fast_path_is_right(spark):
    for a in ("latin", "cyrillic", "greek", ""):
        assert glyphs._pairs(a)
    plain = [chr(c) for c in range(0x180) if re.match(glyphs.PLAIN, "x" + chr(c) + "x")]
    assert [c for c in plain if glyphs.consistent("x" + c + "x") != "x" + c + "x"] == []
    d = spark.createDataFrame([("Le Bris",), (None,), ("",), ("ok",)], "v string")
    assert rows(d.select(glyphs.consistent_text(F.col("v")).alias("w"))) == sorted([("Le Bris",), (None,), ("",), ("ok",)], key=str)


# ---- 7 tokenizer -------------------------------------------------------------------------------------------


def test_ids_equal_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(bpe.BYTE_BPE_50K)
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abé漢 \n\t0!'sétion😀") for _ in range(rng.choice([3, 50, 900]))) for _ in range(200)] + ["<|endoftext|>", "a" * 30_000, " ", "\r\n\r\n", LONG]
    e = bpe.Encoder(ranks, cached=50)  # the cache is emptied many times
    assert all(e.encode(t) == lib.encode_ordinary(t) and e.count(t) == len(e.encode(t)) for t in texts)
    assert b"".join(lib.decode_single_token_bytes(i) for i in e.encode(texts[0])).decode() == texts[0]
    d = spark.createDataFrame([(1, "Bonjour", "x"), (2, "", "y"), (3, None, "z"), (1, "Bonjour", "x"), (None, "a", None)], "doc_id bigint, text string, ids string")
    hello, a = lib.encode_ordinary("Bonjour"), lib.encode_ordinary("a")
    assert rows(bpe.encode_corpus(d, "doc_id", "text")) == sorted([(1, hello), (1, hello), (2, []), (3, []), (None, a)], key=str)
    assert bpe.encode_corpus(d.limit(0), "doc_id", "text").count() == 0


# ---- 8 mixtures ---------------------------------------------------------------------------------------------


def corpus(spark):
    docs = [(i, "big", "un mot et encore un " * (1 + i % 7), 1.0, 1) for i in range(900)] + [(1000 + i, "small", "petit texte ici " * (1 + i % 3), None, 2) for i in range(60)] + [(2000, None, "x", 1.0, 1), (2001, "big", None, 1.0, 1), (2002, "big", "", 1.0, 1), (2003, "other", "z", 1.0, 1)]
    t = [("big", 0.5, 1), ("small", 0.3, 4), ("gone", 0.2, 3)]
    return spark.createDataFrame(docs, "doc_id bigint, source string, text string, w double, copies int"), spark.createDataFrame(t, "source string, part_cible double, repetitions_max int")


def test_shares_are_reached(spark):
    docs, t = corpus(spark)
    m = mixing.mixture(docs, t).cache()
    s = {r["source"]: r for r in mixing.shares(m, t).collect()}
    assert s["big"]["part_obtenue"] == pytest.approx(0.625, abs=0.01) and s["small"]["part_obtenue"] == pytest.approx(0.375, abs=0.01)
    assert s["gone"]["tokens"] == 0 and s["small"]["most_copies"] <= 4 and s["big"]["most_copies"] <= 1
    assert m.count() == m.select("doc_id").distinct().count() and m.filter("doc_id in (2000, 2001, 2002, 2003)").count() == 0
    assert rows(mixing.mixture(docs.repartition(5), t)) == rows(m)
    assert mixing.mixture(docs.limit(0), t).count() == 0 and mixing.mixture(docs, t.limit(0)).count() == 0


def test_given_size_and_weights(spark):
    docs, t = corpus(spark)
    m = mixing.mixture(docs, t, total_tokens=2000, weight="w")
    got = {r["source"]: r["t"] for r in m.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    assert abs(got["big"] - 1250) <= 40 and abs(got["small"] - 750) <= 15
    far = mixing.mixture(docs, t, total_tokens=10**9)
    assert {r["source"]: r["m"] for r in far.groupBy("source").agg(F.min("copies").alias("m")).collect()} == {"big": 1, "small": 4}
    heavy = docs.withColumn("w", F.when(F.col("doc_id") < 450, 1000.0).otherwise(0.001))
    taken = mixing.mixture(heavy, t, total_tokens=2000, weight="w").filter("source = 'big'")
    assert taken.filter("doc_id < 450").count() > 0.95 * taken.count()


# ---- 9 spam pages -------------------------------------------------------------------------------------------


def test_spam_is_told_from_writing(spark):
    rng = random.Random(4)
    sent = ["La pluie a éteint le feu et personne n'a le courage de le rallumer ce soir.", "Au moment du vote, trois regards se croisent et tout le monde comprend la suite.", "Ils mangent des crabes, du manioc et parfois un peu de pain quand la chance tourne.", "Le camp rouge perd son immunité pour moins d'une seconde, au grand dam de Julie Marten.", "On retrouve Paul Verdier près du puits, occupé à compter les grains de riz qui restent."]
    prose = [" ".join(rng.choice(sent) for _ in range(rng.randint(2, 6))) for _ in range(300)]
    cast = ["Conseil 1 : Paul Verdier (3 voix), Julie Marten (2 voix)\nConseil 2 : Anne Lorieux (4 voix), Marc Tavel (1 voix)\nJury : Zoé Caron, Luc Pimet, Léa Doran, Eva Sorel"] * 5
    words = "tente sac lampe couteau gourde poncho hamac collier promo soldes avis gratuit officiel".split()
    spam = [", ".join(f"{rng.choice(words)} {rng.choice(words)}" for _ in range(30)) for _ in range(10)]
    spam += ["\n".join(f"[{rng.choice(words)} promo](http://lien{i}.example/x-{i})" for i in range(12)) for _ in range(10)]
    docs = [(i, t, "x") for i, t in enumerate([*prose, *cast, *spam])] + [(900, None, ""), (901, "", ""), (902, " \n", ""), (903, spam[0], "dup"), (904, sent[0] * 2000, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    got = {r["doc_id"] for r in spam_pages.spam_pages(d, "doc_id", "text").collect()}
    n = len(prose) + len(cast)
    assert got == {*range(n, n + len(spam)), 903}
    assert spam_pages.spam_pages(d.limit(0), "doc_id", "text").count() == 0


PARTS = {
    "fr": ["le camp rouge|la plus jeune du groupe|un ancien pompier|mon équipe|le vent du nord|cette alliance|la pêche du matin|son meilleur ami".split("|"), "n'a pas pu garder|a perdu|cherche depuis l'aube|veut cacher|a retrouvé avec joie|ne quitte plus|aurait aimé voir|partage".split("|"), "le feu de la veille|les restes du repas|une boîte pleine de riz|son avance sur les autres|la clé du coffre|un peu de calme|le sac de toile|ses deux bulletins".split("|"), "au bord de la rivière|pendant que la pluie tombe|avant le vote du soir|sans rien dire à personne|et tout le monde le sait|sous les arbres de la plage|comme à chaque fois|pour la dernière épreuve".split("|")],
    "it": ["il gruppo rosso|la più giovane tra loro|un vecchio pompiere|mia cugina|il vento di ieri|questa intesa|la pesca mattutina|quel ragazzo".split("|"), "non riesce a tenere|perde ancora|cerca fin dall'alba|vuole nascondere|ritrova con gioia|non lascia più|vorrebbe vedere|divide".split("|"), "il fuoco della notte|gli avanzi della cena|una scatola piena di riso|il vantaggio sugli altri|la chiave del forziere|un po' di calma|il sacco di tela|i suoi biglietti".split("|"), "lungo il fiume|mentre piove forte|prima della votazione|senza dirlo agli altri|e ognuno lo sa bene|sotto gli alberi della spiaggia|come ogni volta|per l'ultima prova".split("|")],
}


def _page(rng, lang):
    """Three to seven different sentences."""
    cols = [rng.sample(x, 7) for x in PARTS[lang]]
    return " ".join(" ".join(c[i] for c in cols).capitalize() + "." for i in range(rng.randint(3, 7)))


def test_a_third_of_spam_does_not_mask_itself(spark):
    rng = random.Random(8)
    goods = "tente sac lampe couteau gourde poncho hamac collier promo soldes avis gratuit officiel".split()
    prose = [_page(rng, "fr") for _ in range(200)]
    lists = [", ".join(f"{rng.choice(goods)} {rng.choice(goods)}" for _ in range(rng.randint(20, 40))) for _ in range(100)]
    d = spark.createDataFrame(list(enumerate(prose + lists)), "doc_id int, text string")
    got = {r["doc_id"] for r in spam_pages.spam_pages(d, "doc_id", "text").collect()}
    assert got == set(range(200, 300))
    assert {r["doc_id"] for r in spam_pages.spam_pages(d.repartition(7), "doc_id", "text").collect()} == got


def test_writing_in_a_language_that_is_not_known_is_no_spam(spark):
    rng = random.Random(9)
    d = spark.createDataFrame(list(enumerate([_page(rng, "fr") for _ in range(150)] + [_page(rng, "it") for _ in range(20)])), "doc_id int, text string")
    assert spam_pages.spam_pages(d, "doc_id", "text").count() == 0
