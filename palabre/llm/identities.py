"""Spellings of names linked to the people they mean, by merging and matching again.

Each listed person starts as a profile of one spelling. Typed names are read in every possible way and
meet the profiles under a family name, exactly or by a slip; the given name may be typed as itself, by a
slip, another known form, its beginning or initials. A name that one profile explains clearly better than
any other is merged with it. The profile takes over its spelling, and with it the initials and beginnings
that stand for that spelling; forms of given names that no rule knows (nicknames) are learned beforehand
from names whose family name leaves one person alone. Names still open meet the richer profiles again,
until nothing merges any more. Labels without a full name are resolved among the participants of their group alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .names import PARTICLES, form_cost, given_matches, matches, merged, name_keys, nicknames, profiled, spelled, split_words

MARGIN = 0.25  # by which the best match must be ahead of another person's
AGAIN = 0.2  # cost of a match with a spelling taken over
MERGED = 1.5  # greatest cost at which two spellings of unlisted people are merged
SUPPORT = 2  # family names in which a form of a given name must be met to be learned
EXPLAINED = 1.2  # a form that costs as much is not well explained by rule
SHARE = 0.2  # least part of a form's meetings that one given name must have


def profiles(persons: DataFrame, pid: str, name: str, given: str) -> DataFrame:
    """(pid, g, sp): the given name and the spelling, given name | family words, of each person.

    Particles are no family words unless the family name has no others.
    """
    return persons.select(F.col(pid).alias("pid"), profiled(name, given).alias("x")).filter(F.col("pid").isNotNull() & F.col("x.sp").isNotNull()).select("pid", "x.*").distinct()


def clear_best(candidates: DataFrame, by: list[str], who: str) -> DataFrame:
    """The cheapest candidate of each group if it is ahead of every other ``who`` by ``MARGIN``."""
    w = Window.partitionBy(*by).orderBy("cost", who)
    c = candidates.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("cost").over(w))
    return c.filter((F.col("r") == 1) & (F.col("next").isNull() | (F.col("next") - F.col("cost") >= MARGIN))).drop("r", "next")


def other_forms(pairs: DataFrame, both: bool = False) -> DataFrame:
    """(g, other): the known forms of each given name, parted by |, from (nick, given); with ``both``, also the given names of each form."""
    pairs = pairs.select("nick", "given").union(pairs.select("given", "nick")) if both else pairs
    return pairs.filter(F.col("nick") != F.col("given")).groupBy(F.col("given").alias("g")).agg(F.array_join(F.array_sort(F.collect_set("nick")), "|").alias("other"))


def beside_in_group(seen: DataFrame, there: DataFrame) -> DataFrame:
    """(f, n, sp, g): names ``seen`` (saison, n) with a family word that one of those ``there`` (saison, sp, g) alone bears in the season."""
    alone = there.select("saison", "sp", "g", F.explode(F.array_distinct(split_words(F.substring_index("sp", "|", -1)))).alias("f"))
    alone = alone.groupBy("saison", "f").agg(F.count("*").alias("k"), F.min("sp").alias("sp"), F.min("g").alias("g")).filter(F.col("k") == 1)
    d = seen.select("saison", "n").distinct().select("saison", "n", F.explode(F.array_distinct(split_words(F.col("n")))).alias("f"))
    return d.join(merged(alone), ["saison", "f"]).select("f", "n", "sp", "g").distinct()


def learned_forms(names: DataFrame, targets: DataFrame, beside: DataFrame | None = None) -> DataFrame:
    """(nick, given): forms of given names that no rule explains well, met beside a family name that one listed person bears.

    ``beside`` (f, n, sp, g) are further names with a family word and the one person it stands for: in a long list
    few family names are borne by one person, within a season most are.

    A form counts once for each person; it must be met beside ``SUPPORT`` of them, mean the given name in
    ``SHARE`` of its meetings and be no listed given name itself.
    """
    family = targets.select("sp", "g", F.explode(F.array_distinct(split_words(F.substring_index("sp", "|", -1)))).alias("f"))
    alone = family.groupBy("f").agg(F.count("*").alias("k"), F.min("sp").alias("sp"), F.min("g").alias("g")).filter(F.col("k") == 1)
    d = names.select("n", split_words(F.col("n")).alias("ws"))
    d = d.filter(F.size("ws") > 1).select("n", "ws", F.explode(F.array_distinct("ws")).alias("f"))
    left = F.filter("ws", lambda x: (x != F.col("f")) & ~x.isin(PARTICLES))
    d = d.join(merged(alone.select("f", "sp", "g")), "f").select("f", "n", "ws", "sp", "g")
    if beside is not None:
        d = d.unionByName(beside.select("f", "n", split_words(F.col("n")).alias("ws"), "sp", "g").filter(F.size("ws") > 1))
    d = d.withColumn("left", left).filter(F.size("left").between(1, 2)).select("sp", "g", F.array_join("left", " ").alias("nick"))
    votes = d.filter((F.length("nick") > 1) & (F.col("nick") != F.col("g"))).distinct().groupBy("nick", "g").agg(F.count("*").alias("n"))
    votes = votes.withColumn("all", F.sum("n").over(Window.partitionBy("nick"))).filter((F.col("n") >= SUPPORT) & (F.col("n") >= F.lit(SHARE) * F.col("all")))
    votes = votes.join(merged(targets.select(F.col("g").alias("nick")).distinct()), "nick", "left_anti")
    return votes.filter(F.coalesce(form_cost("nick", "g"), F.lit(9.0)) >= EXPLAINED).select("nick", F.col("g").alias("given"))


def resolve(names: DataFrame, targets: DataFrame, known: DataFrame, evidence: DataFrame, beside: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((n, own, pid), (n, own, cost), (nick, given)): the person of each name that has a clear one, all candidates, and all forms known in the end.

    ``own`` is the listed spelling of a profile; one that several persons bear has no clear person. Each
    round is one join of the names still open with what the profiles took over in the round before. ``evidence.n``
    are further names from which forms are learned, ``beside`` as for ``learned_forms``.
    """
    spellings = targets.groupBy(F.col("sp").alias("own")).agg(F.when(F.count("*") == 1, F.min("pid")).alias("pid"))
    names = names.select("n").distinct()
    best = F.min(F.struct("cost", "f", "w")).alias("b")
    one = lambda m: m.groupBy("n", "own").agg(best).select("n", "own", "b.*")
    known = cut(known.select("nick", "given").union(learned_forms(names.union(evidence).distinct(), targets, beside)).distinct())
    forms = other_forms(known)
    found = cut(one(matches(name_keys(names), targets.select("sp").distinct(), forms).withColumnRenamed("sp", "own")))
    linked = cut(clear_best(found, ["n"], "own").join(merged(spellings), "own").select("n", "own", "pid", "f", "w"))
    fresh = linked
    while True:
        # spellings of the names merged last that their profiles don't have yet
        spelled = fresh.filter(F.length("w") > 2).select(F.concat_ws("|", "w", "f").alias("sp"), "own").filter(F.col("sp") != F.col("own")).distinct()
        still = names.join(merged(linked.select("n")), "n", "left_anti")
        more = matches(name_keys(still), spelled, forms).join(merged(spelled), "sp").select("n", "own", (F.col("cost") + F.lit(AGAIN)).alias("cost"), "f", "w")
        found = cut(one(found.unionByName(more)))
        fresh = cut(clear_best(found.join(merged(linked.select("n")), "n", "left_anti"), ["n"], "own").join(merged(spellings), "own").select("n", "own", "pid", "f", "w"))
        if fresh.isEmpty():
            break
        linked = linked.unionByName(fresh)
    return linked.select("n", "own", "pid"), found.select("n", "own", "cost"), known


def own_spellings(people: DataFrame, given: DataFrame) -> DataFrame:
    """(ent, g, sp) of people in no list, from their typed names: the given name may be the first two words, the first or the last.

    Where one of these is a name of ``given``, the others are left out.
    """
    d = people.filter(F.col("n") != "").select("ent", F.filter(split_words(F.trim(F.regexp_replace("n", r"(?<=\S) [dl](?= \S)", ""))), lambda x: (F.length(x) == 1) | ~x.isin(PARTICLES)).alias("ws")).distinct().filter(F.size("ws") > 0)
    n = F.size("ws")
    part = lambda lo, k: F.array_join(F.slice("ws", F.lit(lo), F.greatest(F.lit(0), k)), " ")
    cuts = F.array(
        F.struct(F.lit(3).alias("o"), part(1, F.lit(2)).alias("g"), part(3, n - 2).alias("fs")),
        F.struct(F.lit(2).alias("o"), F.element_at("ws", 1).alias("g"), part(2, n - 1).alias("fs")),
        F.struct(F.lit(1).alias("o"), F.element_at("ws", -1).alias("g"), part(1, n - 1).alias("fs")),
    )
    d = d.select("ent", "ws", F.inline(cuts)).join(merged(given.select("g", F.lit(True).alias("known"))), "g", "left")
    each = d.groupBy("ent", "ws").agg(F.collect_set(F.struct(F.coalesce("known", F.lit(False)).alias("known"), "o", "g", "fs")).alias("cuts"))  # three at most
    top = F.array_max("cuts")
    each = each.select("ent", F.inline(F.when(top["known"], F.array(top)).otherwise(F.col("cuts"))))
    return each.select("ent", "g", F.concat_ws("|", "g", "fs").alias("sp")).distinct()


def entities(people: DataFrame, given: DataFrame, nicks: DataFrame) -> DataFrame:
    """``people`` (saison, id, n, pid) with ``ent``: the listed person, else one key for all spellings of an unlisted one in a season.

    Unlisted people have no reference spelling, so their typed names are each other's profiles: a name is merged
    with the spelling of the season that explains it clearly best, in two steps, so that a chain of three
    spellings comes together. Names of the same words are one.
    """
    none = F.array_join(F.array_sort(split_words(F.col("n"))), " ")
    open_ = people.filter(F.col("pid").isNull() & F.col("n").contains(" ")).select("saison", "n", none.alias("key")).distinct()
    own = own_spellings(open_.select(F.col("n").alias("ent"), "n"), given)
    met = matches(name_keys(open_.select("n").distinct()), own, other_forms(nicks, both=True)).filter(F.col("cost") <= MERGED)
    met = met.join(merged(own.select(F.col("ent").alias("m"), "sp")), "sp").groupBy("n", "m").agg(F.min("cost").alias("cost"))
    there = open_.select("saison", F.col("n").alias("m"), F.col("key").alias("other"))
    edges = open_.join(merged(met), "n").join(merged(there), ["saison", "m"]).filter(F.col("key") != F.col("other")).groupBy("saison", "key", "other").agg(F.min("cost").alias("cost"))
    best = clear_best(edges, ["saison", "key"], "other").select("saison", "key", F.least("key", "other").alias("to"))
    best = cut(best)
    on = best.select("saison", F.col("key").alias("to"), F.col("to").alias("last"))
    best = best.join(merged(on), ["saison", "to"], "left").select("saison", "key", F.coalesce(F.least("last", "to"), F.col("to")).alias("to"))
    keyed = people.withColumn("key", F.when(F.col("n").contains(" "), none).otherwise(F.col("id")))
    return keyed.join(merged(best), ["saison", "key"], "left").withColumn("ent", F.coalesce("pid", F.concat(F.lit("\u0001"), F.coalesce("to", "key")))).drop("key", "to")


def _single_words(names: DataFrame) -> DataFrame:
    """(n, w, i): labels that are a given name, alone or with an initial of the family name on either side."""
    d = names.select("n").distinct().withColumn("ws", split_words(F.col("n"))).filter(F.size("ws") > 0)
    ends = [F.struct(F.array_join("ws", " ").alias("w"), F.lit("").alias("i"))]
    last, first = F.element_at("ws", -1), F.element_at("ws", 1)
    with_last = F.struct(F.array_join(F.slice("ws", 1, F.size("ws") - 1), " ").alias("w"), last.alias("i"))
    with_first = F.struct(F.array_join(F.slice("ws", 2, F.size("ws") - 1), " ").alias("w"), first.alias("i"))
    many = F.size("ws") > 1
    out = F.concat(F.array(*ends), F.when(many & (F.length(last) == 1), F.array(with_last)).otherwise(F.array()), F.when(many & (F.length(first) == 1), F.array(with_first)).otherwise(F.array()))
    return d.select("n", F.inline(out)).filter(F.length("w") > 1)


def _among_group(labels: DataFrame, present: DataFrame, nicks: DataFrame) -> DataFrame:
    """(saison, n, pid) of labels of a given name that one participant of the group alone bears.

    ``present``: (saison, pid, g, i). People are counted for each group and given name before the join, so
    a group of any size costs a label one row for each name it may stand for.
    """
    one = F.when(F.count("*") == 1, F.min("pid"))
    whole = present.select("saison", "pid", "g").distinct().groupBy("saison", "g").agg(F.count("*").alias("people"), one.alias("pid")).withColumn("i", F.lit(""))
    part = present.select("saison", "pid", "g", "i").distinct().groupBy("saison", "g", "i").agg(F.count("*").alias("people"), one.alias("pid"))
    counted = whole.select("saison", "g", "i", "people", "pid").unionByName(part.select("saison", "g", "i", "people", "pid").filter(F.col("i") != ""))
    singles = _single_words(labels.select("n"))
    given = given_matches(singles.select("w"), present.select("g"), nicks)
    x = labels.select("saison", "n").distinct().join(merged(singles), "n").join(merged(given), "w").join(merged(counted), ["saison", "g", "i"])
    # the cheapest reading decides; it must mean one person
    level = x.groupBy("saison", "n").agg(F.min("gcost").alias("least"))
    x = x.join(merged(level), ["saison", "n"]).filter(F.col("gcost") < F.col("least") + MARGIN)
    return x.groupBy("saison", "n").agg(F.sum("people").alias("people"), F.min("pid").alias("pid")).filter((F.col("people") == 1) & F.col("pid").isNotNull()).select("saison", "n", "pid")


def spell_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``n``: the folded name of the first of ``columns`` that has at least two words, else of the first not empty."""
    return rows.withColumn("n", spelled(*columns))


def link_people(part: DataFrame, persons: DataFrame, more: DataFrame | None = None, evidence: DataFrame | None = None, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """People of the participations: ((saison, id, n, pid or null), candidates, profiles, nicknames).

    Work is done for each different name. Rows whose id is listed keep it. ``more.n`` are further names that
    shall have candidates, ``seen`` (saison, n) names of the season's people. Nicknames quoted in the names are known from the start.
    """
    quoted = part.select(F.explode(F.array("nom", "nom_complet")).alias("nom")).filter(F.col("nom").isNotNull()).distinct()
    targets = cut(profiles(persons, "id", "nom", "prenom"))
    listed = persons.select("id").dropna().distinct().withColumn("pid", F.col("id"))
    keyed = part.select("saison", "id", "nom", "nom_complet").distinct().join(merged(listed), "id", "left")
    keyed = cut(spell_rows(keyed.withColumn("slug", F.replace("id", F.lit("-"), F.lit(" "))), ["nom_complet", "nom", "slug"]).select("saison", "id", "n", "pid"))
    names = keyed.filter(F.col("pid").isNull() & (F.col("n") != "")).select("n")
    names = (names if more is None else names.union(more.select("n"))).distinct()
    beside = None
    if seen is not None:
        there = keyed.filter(F.col("pid").isNotNull()).select("saison", "pid").distinct().join(merged(targets), "pid")
        beside = beside_in_group(seen, there)
    linked, found, nicks = resolve(names, targets, nicknames(quoted, "nom"), names.limit(0) if evidence is None else evidence.select("n"), beside)
    via = linked.filter(F.col("pid").isNotNull()).select("n", F.col("pid").alias("via"))
    people = keyed.join(merged(via), "n", "left").select("saison", "id", "n", F.coalesce("pid", "via").alias("pid"))
    return cut(people), found, targets, nicks


def spelling_links(part: DataFrame, councils: DataFrame, persons: DataFrame) -> DataFrame:
    """(origine, ligne, id): rows of ``part`` whose id isn't listed though the person is, and rows of ``councils``
    with an unattached label that names a listed participant of the season.

    Null, empty and blank names are linked by their id's words, or not at all; a name that two people explain
    about equally well is left open. Names may have any number of words. Repeated rows come out each. Other
    columns are not read.
    """
    labels = councils.filter((~F.col("elimine_rattache")) & F.col("elimine").isNotNull()).select("ligne", "saison", "elimine")
    labels = cut(spell_rows(labels, ["elimine"]).filter(F.col("n") != "").select("ligne", "saison", "n"))
    people, full, targets, nicks = link_people(part, persons, labels)
    listed = persons.select("id").dropna().distinct()
    mine = people.filter(F.col("pid").isNotNull() & (F.col("pid") != F.col("id")))
    mine = mine.groupBy("saison", "id").agg(F.min("pid").alias("pid"), F.countDistinct("pid").alias("k")).filter(F.col("k") == 1)
    rows = part.select("ligne", "saison", "id").join(merged(listed), "id", "left_anti").join(merged(mine), ["saison", "id"]).select(F.lit("participations").alias("origine"), "ligne", F.col("pid").alias("id"))

    # who was there: listed people, and others under their own id
    who = people.select("saison", "n", F.coalesce("pid", F.concat(F.lit("\u0001"), F.col("id"))).alias("pid")).distinct()
    initials = F.transform(split_words(F.substring_index("sp", "|", -1)), lambda f: F.substring(f, 1, 1))
    named = cut(who.select("saison", "pid").distinct().join(merged(targets), "pid"))
    given = targets.select("g").distinct()
    strangers = who.filter(F.col("pid").startswith("\u0001")).select("saison", "pid", split_words(F.col("n")).alias("ws"))
    runs = F.transform(F.sequence(F.lit(1), F.size("ws")), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(2), F.size("ws") - s + 1)), lambda k: F.array_join(F.slice("ws", s, k), " ")))
    strangers = strangers.filter(F.size("ws") > 0).select("saison", "pid", "ws", F.explode(F.array_distinct(F.flatten(runs))).alias("g")).join(merged(given), "g")
    strangers = strangers.select("saison", "pid", "g", F.explode(F.array_distinct(F.transform("ws", lambda f: F.substring(f, 1, 1)))).alias("i"))
    present = cut(named.select("saison", "pid", "g", F.explode(initials).alias("i")).unionByName(strangers).distinct())

    keys = labels.select("saison", "n").distinct()
    # full names: matched against everybody, kept among those who were there
    there = named.groupBy("saison", F.col("sp").alias("own")).agg(F.when(F.count("*") == 1, F.min("pid")).alias("pid"))
    cand = keys.join(merged(full), "n").join(merged(there), ["saison", "own"]).select("saison", "n", "own", "pid", "cost")
    # spellings under which the people of a season stand in that season count as theirs
    own = people.filter(F.col("pid").isNotNull()).select("saison", "n", "pid").distinct().join(merged(keys), ["saison", "n"]).join(merged(targets.select("pid", F.col("sp").alias("own"))), "pid").withColumn("cost", F.lit(0.0))
    cand = cand.unionByName(own.select(cand.columns)).groupBy("saison", "n", "own").agg(F.min(F.struct("cost", "pid")).alias("b")).select("saison", "n", "own", "b.*")
    cand = cut(cand)
    best = clear_best(cand, ["saison", "n"], "own").filter(F.col("pid").isNotNull()).select("saison", "n", "pid")
    alone = _among_group(keys.join(merged(cand.select("saison", "n").distinct()), ["saison", "n"], "left_anti"), present, nicks)
    alone = alone.join(merged(listed.select(F.col("id").alias("pid"))), "pid", "left_semi")
    hits = labels.join(merged(best.unionByName(alone.select("saison", "n", "pid"))), ["saison", "n"])
    return rows.unionByName(hits.select(F.lit("conseils").alias("origine"), "ligne", F.col("pid").alias("id")))
