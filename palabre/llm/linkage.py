"""Records of two sources matched without a common key, each match with a confidence.

Candidates come from names, group (season) and agreeing attributes. Labelling functions vote on each
candidate: how close the names are, whether the group is the same, how far the ages are apart, whether
job, place and gender agree. A generative model learns by EM, from counts of vote patterns alone, how
often each vote falls in matches and how often in others, and the share of matches. What votes an
attribute casts by chance is known from both sides' distributions; that is where the other class starts
from, weighing as ``CHANCE`` candidates. Functions found to be correlated within a class are taken
together and the model is learned again, until none are. The posterior is the confidence.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import cut
from .identities import MERGED, _single_words, clear_best, link_people, other_forms, own_spellings, spell_rows
from .names import close_words, given_matches, matches, matches_within, merged, name_keys, split_words

VOTES = ["v_name", "v_group", "v_age", "v_job", "v_place", "v_gender"]
LEVELS = {"v_name": 5, "v_group": 2, "v_age": 5, "v_job": 3, "v_place": 3, "v_gender": 3}
OPEN = 2  # the first functions have no chance that is known beforehand
CHANCE = 200.0  # candidates as which the known chance weighs
ITERATIONS = 200
DEPENDENT = 0.25  # Cramér's V from which two functions are taken together
SURE = 0.5  # least posterior of a match
NEAR = 1  # edits by which the title meant may be further off than the closest one


# ---- label model ---------------------------------------------------------------------------------


def _expectation(patterns: np.ndarray, counts: np.ndarray, groups: list[tuple[int, ...]], chance: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """Posterior of each vote pattern; the functions of a group are taken together, with a vote for each combination."""
    codes = []
    for g in groups:
        code, p0 = np.zeros(len(patterns), dtype=int), np.ones(1)
        for k in g:
            code, p0 = code * len(chance[k]) + patterns[:, k], np.outer(p0, chance[k]).ravel()
        codes.append((code, p0, 5.0 if min(g) < OPEN else CHANCE))
    post = start.copy()
    for _ in range(ITERATIONS):
        w, v = counts * post, counts * (1 - post)
        share = (w.sum() + 1.0) / (counts.sum() + 2.0)
        logit = np.full(len(patterns), np.log(share / (1 - share)))
        for code, p0, weight in codes:
            p1 = (np.bincount(code, w, len(p0)) + 5.0 * p0) / (w.sum() + 5.0)
            q1 = (np.bincount(code, v, len(p0)) + weight * p0) / (v.sum() + weight)
            logit += np.log(p1[code]) - np.log(q1[code])
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-9:
            break
    return post


def _dependence(patterns: np.ndarray, weight: np.ndarray, a: tuple[int, ...], b: tuple[int, ...], sizes: list[int]) -> float:
    """Cramér's V of two groups of functions over weighted patterns."""

    def code(g: tuple[int, ...]) -> np.ndarray:
        out = np.zeros(len(patterns), dtype=int)
        for k in g:
            out = out * sizes[k] + patterns[:, k]
        return np.unique(out, return_inverse=True)[1].ravel()

    x, y = code(a), code(b)
    t = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(t, (x, y), weight)
    n = t.sum()
    e = np.outer(t.sum(1), t.sum(0)) / max(n, 1e-9)
    chi = ((t - e) ** 2 / np.where(e > 0, e, 1)).sum()
    return math.sqrt(chi / max(n, 1e-9) / max(1, min(t.shape) - 1))


def label_model(patterns: np.ndarray, counts: np.ndarray, chance: list[np.ndarray], start: np.ndarray) -> np.ndarray:
    """Posterior of each pattern. The most dependent groups of functions are joined until none depend by ``DEPENDENT`` within a class."""
    sizes = [len(c) for c in chance]
    groups: list[tuple[int, ...]] = [(k,) for k in range(len(sizes))]
    post = _expectation(patterns, counts, groups, chance, start)
    while len(groups) > 2:
        v = lambda a, b: max(_dependence(patterns, counts * w, a, b, sizes) for w in (post, 1 - post) if (counts * w).sum() >= CHANCE)  # noqa: B023, E731
        if max((counts * post).sum(), (counts * (1 - post)).sum()) < CHANCE:
            return post
        worst, a, b = max((v(a, b), a, b) for a, b in itertools.combinations(groups, 2))
        if worst < DEPENDENT:
            return post
        groups = [tuple(sorted(a + b)), *[g for g in groups if g not in (a, b)]]
        post = _expectation(patterns, counts, groups, chance, post)
    return post


def chance_votes(cards: DataFrame, who: DataFrame) -> list[np.ndarray]:
    """How often each vote falls between a card and somebody else: from the distributions of both sides' attributes.

    One job counts the values of both sides. What comes to the driver is a row for each age, entry of the
    lists and gender, whatever the number of cards and people.
    """
    one = lambda attr, x, a, b: F.struct(F.lit(attr).alias("attr"), x.cast("string").alias("x"), a.cast("double").alias("a"), b.cast("double").alias("b"))
    attrs = [("age", "ages"), ("job", "jobs"), ("place", "places"), ("gender", "genders")]
    left = cards.select(F.inline(F.array(one("all", F.lit(""), F.lit(1), F.lit(0)), *[one(c, F.col(c), F.lit(1), F.lit(0)) for c, _ in attrs])))

    def spread(c: str, s: str) -> Column:
        return F.transform(s, lambda x: one(c, x, F.lit(0), F.lit(1) / F.size(s)))

    sets = [spread(c, s) for c, s in attrs]
    right = who.select(F.inline(F.concat(F.array(one("all", F.lit(""), F.lit(0), F.lit(1))), *sets)))
    counts: dict[str, list[tuple[str, float, float]]] = {c: [] for c in ("all", *(c for c, _ in attrs))}
    for r in left.unionByName(right).filter(F.col("x").isNotNull()).groupBy("attr", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        counts[r["attr"]].append((r["x"], r["a"], r["b"]))
    _, n, m = (counts["all"] or [("", 0.0, 0.0)])[0]
    n, m = max(1.0, n), max(1.0, m)
    out = [np.full(LEVELS[v], 1 / LEVELS[v]) for v in VOTES[:OPEN]]
    for c, _ in attrs:
        a, b = sum(x[1] for x in counts[c]), sum(x[2] for x in counts[c])
        known = a / n * b / m
        if c == "age":
            levels = np.zeros(5)
            for (u, p, _), (v, _, q) in itertools.product(counts[c], counts[c]):
                gap = abs(int(u) - int(v))
                levels[0 if gap == 0 else 1 if gap <= 2 else 2 if gap <= 5 else 4] += p * q
            levels *= known / max(levels.sum(), 1e-9)
            levels[3] = 1 - known
        else:
            same = known * sum(p * q for _, p, q in counts[c]) / max(a * b, 1e-9)
            levels = np.array([same, 1 - known, max(0.0, known - same)])
        out.append(levels)
    return [np.maximum(c, 1e-4) / np.maximum(c, 1e-4).sum() for c in out]


def confidence(pairs: DataFrame, chance: list[np.ndarray]) -> DataFrame:
    """``pairs`` with ``confidence``. Only counts of vote patterns, at most the product of the levels, come to the driver."""
    rows = pairs.groupBy(*VOTES).agg(F.count("*").alias("n")).collect()
    if not rows:
        return pairs.withColumn("confidence", F.lit(0.0))
    patterns = np.array([[r[v] for v in VOTES] for r in rows], dtype=int)
    counts = np.array([r["n"] for r in rows], dtype=float)
    post = label_model(patterns, counts, chance, np.where(patterns[:, 0] < 4, 0.9, 0.5))
    fitted = pairs.sparkSession.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, post)], ", ".join(f"{v} int" for v in VOTES) + ", confidence double")
    return pairs.join(F.broadcast(fitted), VOTES)  # at most the product of the levels


# ---- groups, people and attributes ---------------------------------------------------------------


def resolve_groups(typed: DataFrame, groups: DataFrame) -> DataFrame:
    """(edition, saison, off) of the different typed names of groups: by number, else by title with slips, told apart by year.

    The more groups there are, the more titles lie one letter apart. So all groups stay whose title is at most
    ``NEAR`` further off than the closest one's; ``off`` is 0 for those that are as close as can be.
    """
    e = typed.select("edition").dropna().distinct().withColumn("t", words(F.col("edition")))
    number = F.coalesce(F.nullif(F.regexp_extract("t", r"^(?:la )?s(?:aison)?(?: no?)? ?(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract("t", r"^(?:la )?(\d+) ?(?:e|eme|ere|er)? saison$", 1), F.lit("")))
    year = F.expr(r"try_cast(nullif(regexp_extract(t, '(?:^|\\s)((?:19|20)\\d\\d)(?:$|\\s)', 1), '') as int)")
    e = e.withColumn("number", number.try_cast("int")).withColumn("year", year)
    e = e.withColumn("title", F.trim(F.regexp_replace(F.regexp_replace("t", r"(?:^|\s)(?:19|20)\d\d(?=$|\s)", " "), r"\s+", " ")))
    g = groups.select(F.col("id").alias("saison"), "numero", F.col("annee").alias("annee"), words(F.col("titre")).alias("name")).filter(F.col("name") != "")
    by_number = e.join(merged(g), F.col("number") == F.col("numero")).select("edition", "saison", F.lit(0).alias("off"))
    g = g.withColumn("core", F.element_at(F.split("name", " "), -1))
    t = e.filter(F.col("number").isNull() & (F.col("title") != "")).select("edition", "title", "year", F.explode(F.array_distinct(F.split("title", " "))).alias("w")).filter(F.length("w") >= 4)
    met = close_words(t.select(F.col("w").alias("a")).distinct(), g.select(F.col("core").alias("b")).distinct())
    x = t.join(merged(met), F.col("w") == F.col("a")).join(merged(g), F.col("b") == F.col("core"))
    off = F.levenshtein("title", "name")
    x = x.withColumn("cost", off + F.when(F.col("year").isNull() | (F.col("year") == F.col("annee")), 0).otherwise(3))
    x = x.filter(F.col("cost") <= 4).groupBy("edition", "saison").agg(F.min("cost").alias("cost"))
    x = x.withColumn("off", F.col("cost") - F.min("cost").over(Window.partitionBy("edition"))).filter(F.col("off") <= NEAR)
    return by_number.unionByName(x.select("edition", "saison", "off"))


def _codes(values: DataFrame, mapped: Callable) -> DataFrame:
    return cut(mapped(values.dropna().distinct()).filter(F.col("code") != "").select("v", "code"))


def _vote_age(a: Column, ages: Column) -> Column:
    """0 equal, 1 one or two years apart, 2 up to five, 3 unknown, 4 further apart."""
    gap = F.array_min(F.transform(ages, lambda x: F.abs(x - a)))
    return F.when(a.isNull() | (F.size(ages) == 0), 3).when(gap == 0, 0).when(gap <= 2, 1).when(gap <= 5, 2).otherwise(4)


def _vote_same(a: Column, values: Column) -> Column:
    return F.when(a.isNull() | (F.size(values) == 0), 1).when(F.array_contains(values, a), 0).otherwise(2)


def _linked_within(people: DataFrame, full: DataFrame, listed: DataFrame) -> DataFrame:
    """``people`` (saison, id, n, pid): a name that several listed people explain is that of the one who stands in the season under another id too.

    ``full``: (n, own, cost), all candidates of the names. The longer the list, the more names have several.
    """
    there = people.filter(F.col("pid").isNotNull()).select("saison", "pid").distinct().join(merged(listed.select("pid", F.col("sp").alias("own"))), "pid")
    there = there.groupBy("saison", "own").agg(F.when(F.count("*") == 1, F.min("pid")).alias("met"))
    met = people.filter(F.col("pid").isNull()).select("saison", "n").distinct().join(merged(full.filter(F.col("cost") <= MERGED)), "n").join(merged(there), ["saison", "own"])
    met = clear_best(met, ["saison", "n"], "own").filter(F.col("met").isNotNull()).select("saison", "n", "met")
    return cut(people.join(merged(met), ["saison", "n"], "left").select("saison", "id", "n", F.coalesce("pid", "met").alias("pid")))


def link_sources(part: DataFrame, cards: DataFrame, persons: DataFrame, groups: DataFrame, job_map: Callable, place_map: Callable) -> DataFrame:
    """(saison, id, fiche, confidence) of each card and each id of the person that it describes in that season.

    ``job_map`` and ``place_map`` give (v, code) of the different values of a column v. Nulls vote "unknown"; a
    card without a name, or whose typed season is another than the candidate's, has no candidate. A typed season
    that may be several is looked up in each of them, one that is in no list counts as not said; a title a
    little further off than the closest counts where no candidate of the closest is sure. A card
    describes one person in one season: the candidate of the highest confidence, then the closest name and
    age; of two that are alike in all none is taken. Repeated rows of a card come out once; empty tables
    give no rows. Attributes of several rows of a person in a season count as one set.
    """
    c = cards.select("fiche", "edition", "libelle", F.when(F.col("age").between(16, 80), F.col("age")).alias("age"), "metier", "ville", F.when(F.lower(F.substring("genre", 1, 1)) == "f", "f").when(F.lower(F.substring("genre", 1, 1)) == "h", "h").alias("gender"))
    c = cut(spell_rows(c, ["libelle"]).filter(F.col("n") != "").dropDuplicates(["fiche"]))
    typed = cut(resolve_groups(cards, groups))
    seen = c.join(merged(typed.filter(F.col("off") == 0)), "edition").select("saison", "n")
    people, full, listed, nicks = link_people(part.select("saison", "id", "nom", "nom_complet"), persons, evidence=c, seen=seen)
    people = _linked_within(people, full, listed)
    given = listed.select("g").distinct()
    # people in no list are told apart by the words of their names
    people = people.withColumn("ent", F.coalesce("pid", F.concat(F.lit("\u0001"), F.when(F.col("n").contains(" "), F.array_join(F.array_sort(F.split("n", " ")), " ")).otherwise(F.col("id")))))
    there = people.select("saison", "ent").distinct()
    strangers = own_spellings(people.filter(F.col("pid").isNull()), given)
    mine = listed.select(F.col("pid").alias("ent"), "g", "sp").unionByName(strangers)
    bears = cut(there.join(merged(mine), "ent"))  # (saison, ent, g, sp) of those who took part

    # attributes of a person in a season, as sets bounded by their domains
    job_codes = _codes(part.select(F.col("profession").alias("v")).union(cards.select("metier")), job_map)
    place_codes = _codes(part.select(F.col("localisation").alias("v")).union(cards.select("ville")), place_map)
    usable = F.when(F.col("age").between(16, 80), F.col("age"))
    rows = part.select("saison", "id", usable.alias("age"), "profession", "localisation", F.substring("genre", 1, 1).alias("genre")).distinct()
    rows = rows.join(merged(job_codes.select(F.col("v").alias("profession"), F.col("code").alias("job"))), "profession", "left").join(merged(place_codes.select(F.col("v").alias("localisation"), F.col("code").alias("place"))), "localisation", "left")
    ids = people.groupBy("saison", "id").agg(F.min("ent").alias("ent"))
    who = rows.join(merged(ids), ["saison", "id"]).groupBy("saison", "ent").agg(F.collect_set("age").alias("ages"), F.collect_set("job").alias("jobs"), F.collect_set("place").alias("places"), F.collect_set("genre").alias("genders"))
    who = cut(who)

    c = c.join(merged(typed.groupBy("edition").agg(F.lit(True).alias("typed"))), "edition", "left")
    c = c.join(merged(job_codes.select(F.col("v").alias("metier"), F.col("code").alias("job"))), "metier", "left").join(merged(place_codes.select(F.col("v").alias("ville"), F.col("code").alias("place"))), "ville", "left")
    c = cut(c.select("fiche", "n", "edition", F.col("typed").isNull().alias("unsaid"), "age", "job", "place", "gender"))

    # full names, within the season where it is said; a typed nickname may stand for the given name, or the given
    # name for a nickname that is all that is known
    forms = other_forms(nicks, both=True)
    said = cut(c.filter(~F.col("unsaid")).join(merged(typed), "edition"))
    a = said.join(merged(matches_within(said, bears, "saison", forms)), ["saison", "n"]).select("fiche", "saison", "ent", "cost", "off", F.when(F.col("off") == 0, 0).otherwise(1).alias("v_group"))
    unsaid = c.filter("unsaid").select("fiche", "n")
    any_ = matches(name_keys(unsaid.select("n").distinct()), bears, forms).select("n", "sp", "cost").join(merged(unsaid), "n").join(merged(bears.select("saison", "ent", "sp")), "sp")
    a = a.unionByName(any_.select("fiche", "saison", "ent", "cost", F.lit(0).alias("off"), F.lit(1).alias("v_group")))
    a = a.withColumn("v_name", F.when(F.col("cost") <= 0.05, 0).when(F.col("cost") <= 1.0, 1).otherwise(2))
    # a given name, alone or with an initial: those who alone bear it in the season, or who agree in two attributes
    initials = F.transform(split_words(F.substring_index("sp", "|", -1)), lambda f: F.substring(f, 1, 1))
    bears = bears.join(merged(given), "g", "left_semi").select("saison", "ent", "g", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), initials))).alias("i")).distinct()
    singles = _single_words(c.select("n"))
    named = said.filter(F.col("off") == 0).join(merged(singles), "n").join(merged(given_matches(singles.select("w"), given, nicks)), "w")
    named = cut(named.select("fiche", "saison", "g", "i", "gcost", "age", "job", "place"))
    once = bears.select("saison", "g", "ent").distinct().groupBy("saison", "g").agg(F.count("*").alias("k"), F.min("ent").alias("ent")).withColumn("i", F.lit("")).unionByName(bears.filter(F.col("i") != "").groupBy("saison", "g", "i").agg(F.countDistinct("ent").alias("k"), F.min("ent").alias("ent")))
    b = named.join(merged(once.filter(F.col("k") == 1)), ["saison", "g", "i"]).select("fiche", "saison", "ent", (F.col("gcost") + 1.0).alias("cost"), F.lit(0).alias("off"), F.lit(0).alias("v_group"), F.lit(3).alias("v_name"))
    keyed = bears.join(merged(who), ["saison", "ent"])
    key = lambda p, x, q, y: F.concat(F.lit(p), x.cast("string"), F.lit(q), y.cast("string"))
    cross = lambda p, xs, q, ys: F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: key(p, x, q, y))))
    keyed = keyed.select("saison", "ent", "g", "i", F.explode(F.concat(cross("a", F.col("ages"), "j", F.col("jobs")), cross("a", F.col("ages"), "p", F.col("places")), cross("j", F.col("jobs"), "p", F.col("places")))).alias("k"))
    near = F.when(F.col("age").isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.col("age") - 2, F.col("age") + 2))
    one = lambda x: F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x))
    mine = named.select("fiche", "saison", "g", "i", "gcost", F.explode(F.concat(cross("a", near, "j", one(F.col("job"))), cross("a", near, "p", one(F.col("place"))), cross("j", one(F.col("job")), "p", one(F.col("place"))))).alias("k"))
    d = mine.alias("m").join(merged(keyed).alias("t"), (F.col("m.saison") == F.col("t.saison")) & (F.col("m.g") == F.col("t.g")) & (F.col("m.k") == F.col("t.k")) & ((F.col("m.i") == "") | (F.col("m.i") == F.col("t.i"))))
    d = d.select("m.fiche", "m.saison", "t.ent", (F.col("m.gcost") + 1.2).alias("cost"), F.lit(0).alias("off"), F.lit(0).alias("v_group"), F.lit(4).alias("v_name"))
    pairs = a.unionByName(b).unionByName(d).groupBy("fiche", "saison", "ent").agg(F.min(F.struct("v_name", "cost", "off", "v_group")).alias("x")).select("fiche", "saison", "ent", "x.*")

    pairs = pairs.join(merged(c), "fiche").join(merged(who), ["saison", "ent"])
    pairs = pairs.withColumn("v_age", _vote_age(F.col("age"), F.col("ages"))).withColumn("v_job", _vote_same(F.col("job"), F.col("jobs")))
    pairs = pairs.withColumn("v_place", _vote_same(F.col("place"), F.col("places"))).withColumn("v_gender", _vote_same(F.col("gender"), F.col("genders")))
    gap = F.coalesce(F.array_min(F.transform("ages", lambda x: F.abs(x - F.col("age")))), F.lit(99))
    pairs = cut(pairs.select("fiche", "saison", "ent", "off", (F.col("cost") + F.col("off")).alias("cost"), gap.alias("gap"), *[F.col(v).cast("int").alias(v) for v in VOTES]))
    scored = confidence(pairs, chance_votes(c, who)).filter(F.col("confidence") >= SURE)
    order = [F.col("off"), F.round("confidence", 3).desc(), F.col("cost"), F.col("gap")]
    w = Window.partitionBy("fiche").orderBy(*order)
    best = scored.withColumn("r", F.rank().over(w)).filter(F.col("r") == 1).withColumn("k", F.count("*").over(Window.partitionBy("fiche"))).filter(F.col("k") == 1)
    return best.join(merged(ids), ["saison", "ent"]).select("saison", "id", "fiche", "confidence")
