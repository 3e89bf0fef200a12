"""Freely typed values mapped to the closest entry of a reference list.

A set-similarity join with prefix filter: every list entry (in all of its forms) and every window of
words of a typed value is a set of character pairs. Pairs are ordered by rarity over the list and all
values; only the rarest of each set, as many as the least similarity asks for, are joined; sizes and
positions prune; the Jaccard similarity of what is left is computed exactly and the best entry is kept.
Windows let the entry stand among other words. Work is done once for each different value. The list's
side is an inverted index of prefixes that every worker holds: its size is bounded by ``REFERENCE_MAX``.

Beside its label an entry has forms that follow from it by rule (feminine forms, words cut short,
initials), and forms that are learned: words typed in rows of people whose other rows name one entry.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .names import edits, folded

LEAST = 0.44  # least Jaccard similarity of a window and a form
SURE = 0.7  # similarity from which no further check is made
SLIPS = 2  # edits by which a window of less similarity may differ
SHORT = 5  # a form of so few letters must be met exactly among other words, and within one edit alone
CUT = 0.8  # similarity that words cut short, and initials, count as
CUT_LETTERS = 5  # letters that a label's only word must keep where it is cut short among other words; two less where it stands alone
REFERENCE_MAX = 50_000  # entries of a reference list; a longer one is refused
MORE_WORDS = 1  # words that a window may have beyond the longest form
PURE = 0.5  # a form is learned if the 90 % interval of the part of its people whose other rows name the entry lies above
# Small words that abbreviations leave out.
SMALL = frozenset("a au aux d de des du en et l la le les".split())


def feminine(form: str) -> set[str]:
    """Feminine forms of folded French words, by ending: each word that has one takes it."""
    def one(w: str, eur: str) -> str:
        if w in ("de", "en", "au", "des", "air", "train", "taxi", "chef"):
            return {"chef": "cheffe"}.get(w, w)
        if w.endswith("teur") and eur == "trice":
            return w[:-4] + "trice"
        if w.endswith("eur"):
            return w[:-3] + ("euse" if eur == "trice" else eur)
        for a, b in (("hote", "hotesse"), ("maitre", "maitre"), ("barman", "barmaid")):
            if w == a:
                return b
        for a, b in (("ier", "iere"), ("er", "ere"), ("ien", "ienne"), ("on", "onne"), ("if", "ive"), ("al", "ale"), ("ant", "ante"), ("at", "ate"), ("ert", "erte"), ("in", "ine")):
            if w.endswith(a):
                return w[: -len(a)] + b
        return w
    out = set()
    for eur in ("trice", "euse", "eure"):
        ws = form.split()
        cut = next((i for i, w in enumerate(ws) if i and w in ("de", "d", "des", "en", "a", "au", "la", "l")), len(ws))
        out.add(" ".join([one(w, eur) for w in ws[:cut]] + ws[cut:]))
    return out - {form}


def forms(entries: list[tuple[str, str]], synonyms: list[tuple[str, str]], genders: bool) -> list[tuple[str, str]]:
    """(form, code) of every entry: its label, its synonyms, and feminine forms of both. A form of two codes stays with the label's, then the first."""
    by: dict[str, tuple[int, str]] = {}
    more: dict[str, list[str]] = defaultdict(list)
    for form, code in synonyms:
        more[code].append(form)
    for code, label in sorted(entries):
        base = [(0, folded(label))] + [(1, folded(s)) for s in more.get(code, [])]
        for rank, f in [*base, *[(r + 2, g) for r, f in base if genders for g in feminine(f)]]:
            if f and (f not in by or by[f][0] > rank):
                by[f] = (rank, code)
    return sorted((f, c) for f, (_, c) in by.items())


def pairs(text: str) -> set[str]:
    """Character pairs of each word of a folded text, with a mark at both ends of a word."""
    return {w[i : i + 2] for x in text.split() for w in (f"_{x}_",) for i in range(len(w) - 1)}


def expand(text: Column, abbreviations: dict[str, str]) -> Column:
    """Folded words, with the abbreviations written out."""
    t = F.concat(F.lit(" "), words(text), F.lit(" "))
    for a, b in sorted(abbreviations.items()):
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


class Index:
    """The forms of a list, found by similarity: an inverted index of the rarest pairs of each form.

    ``own`` are the forms that stand in the list or follow from it by rule; only these are cut short. ``rarity``
    counts each pair over the list and the values. A pair that the list doesn't hold can't join and ranks first.
    """

    def __init__(self, listed: list[tuple[str, str]], own: frozenset[str], rarity: dict[str, int], least: float = LEAST):
        self.listed, self.own, self.least = listed, own, least
        self.rank = {p: i + 1 for i, p in enumerate(sorted(rarity, key=lambda p: (rarity[p], p)))}
        self.sets = [pairs(f) for f, _ in listed]
        self.prefixes: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, s in enumerate(self.sets):
            for i, p in enumerate(self._prefix(s)):
                self.prefixes[p].append((k, i))
        self.longest = max((len(f.split()) for f, _ in listed), default=1) + MORE_WORDS
        self._index_cuts()
        self.best = lru_cache(1 << 17)(self._best)

    def _prefix(self, s: set[str]) -> list[str]:
        ordered = sorted(s, key=lambda p: (self.rank.get(p, 0), p))
        return ordered[: max(1, len(s) - -int(-self.least * len(s) // 1) + 1)] if s else []

    def similar(self, text: str) -> list[tuple[int, float]]:
        """(form, Jaccard similarity) of every form that is at least ``least`` similar."""
        s = pairs(text)
        n, met = len(s), {}
        for i, p in enumerate(self._prefix(s)):
            for k, j in self.prefixes.get(p, ()):
                if k in met:
                    continue
                m = len(self.sets[k])
                if n < self.least * m or m < self.least * n:
                    met[k] = 0.0
                elif i + j + 1 + min(n - i - 1, m - j - 1) < self.least / (1 + self.least) * (n + m) - 1e-9:
                    continue  # too late in both: a pair before this one would have to be common
                else:
                    common = len(s & self.sets[k])
                    met[k] = common / (n + m - common)
        return [(k, x) for k, x in met.items() if x >= self.least - 1e-9]

    def _best(self, window: str, alone: bool) -> tuple[float, int, str, str, float] | None:
        """(score, size, form, code, similarity) of the best form for a window."""
        out = None
        for k, sim in self.similar(window):
            form, code = self.listed[k]
            letters = len(form.replace(" ", ""))
            if sim < 0.999:
                if letters <= SHORT and not (alone and letters > 3 and edits(window, form) == 1):
                    continue
                if sim < SURE and not self._slipped(window, form):
                    continue
            z = len(self.sets[k])
            out = max(out or (0.0,), (sim * sim * z, z, form, code, sim))
        if out is None and (found := self._cut_short(window, alone)):
            form, code = found
            z = len(pairs(form))
            out = (CUT * CUT * z, z, form, code, CUT)
        return out

    @staticmethod
    def _slipped(window: str, form: str) -> bool:
        """One edit apart, or ``SLIPS`` behind the same first letter."""
        e = edits(window, form)
        return e <= 1 or (e <= SLIPS and window[0] == form[0])

    def _index_cuts(self) -> None:
        """What labels and their feminine forms may be cut to: initials of three words or more, the first letters of their words, their first words."""
        self.initials: dict[str, dict[str, str]] = defaultdict(dict)
        self.heads: dict[tuple[int, str], list[tuple[list[str], str, str]]] = defaultdict(list)
        for f, c in self.listed:
            if f not in self.own:
                continue
            ws = [w for w in f.split() if w not in SMALL]
            if len(ws) > 2:
                self.initials["".join(w[0] for w in ws)].setdefault(c, f)
            for k in range(1, len(ws) + 1):
                self.heads[k, ws[0][:2]].append((ws, f, c))

    def _cut_short(self, window: str, alone: bool) -> tuple[str, str] | None:
        """(form, code) of the only entry whose words begin with the window's, in their order, or have it as initials.

        Words that a label has beyond the window's may be missing only where the window is the whole value.
        """
        ws = [w for w in window.split() if w not in SMALL]
        if not ws:
            return None
        found = dict(self.initials.get(ws[0], ())) if len(ws) == 1 else {}
        least = 2 if len(ws) > 1 else CUT_LETTERS - 2 * alone
        for form, f, c in self.heads.get((len(ws), ws[0][:2]), ()) if len(ws[0]) > 1 else ():
            whole = len(form) == len(ws)
            if all(b.startswith(a) for a, b in zip(ws, form)) and (all(len(w) >= least for w in ws) and sum(map(len, ws)) > 2 if whole else alone and ws == form[: len(ws)]):
                found.setdefault(c, f)
        return (*found.values(), *found) if len(found) == 1 else None

    def match(self, text: str) -> tuple[str, float | None]:
        """(code, similarity) of a folded text: the best window's; ('', None) if none is close enough."""
        w = text.split()
        best = None
        seen = set()
        for i in range(len(w)):
            for k in range(1, min(self.longest, len(w) - i) + 1):
                seg = " ".join(w[i : i + k])
                if seg not in seen:
                    seen.add(seg)
                    b = self.best(seg, k == len(w))
                    if b and (best is None or (b[0], b[1], best[3]) > (best[0], best[1], b[3])):
                        best = b
        return (best[3], best[4]) if best else ("", None)


def _counted(known: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column("t").to_pylist():
                n.update(pairs(t or "") & known)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["p", "n"])

    return run


def _matched(listed: list[tuple[str, str]], own: frozenset[str], rarity: dict[str, int], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(listed, own, rarity, least)
        for b in batches:
            found = [index.match(t or "") for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("v"), pa.array([c for c, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["v", "code", "sim"])

    return run


def map_values(values: DataFrame, entries: list[tuple[str, str]], synonyms: list[tuple[str, str]] = (), abbreviations: dict[str, str] | None = None, genders: bool = False, least: float = LEAST) -> DataFrame:
    """(v, code, sim) of every different value of ``values.v``; code is '' and sim null if no entry is close enough.

    ``synonyms`` are further (form, code). Entries below ``SURE`` count as close only within ``SLIPS`` edits.
    Among the close entries the one of the greatest similarity squared times size wins, so a long entry met
    with a slip is preferred to a short one contained in it; ties go to the longer form, then the smaller code.
    Empty and blank values map to ''. An empty list maps everything to ''.
    """
    listed = forms(entries, synonyms, genders)
    own = frozenset(f for f, _ in forms(entries, (), genders))
    v = values.select("v").distinct().withColumn("t", expand(F.col("v"), abbreviations or {}))
    known = frozenset(p for f, _ in listed for p in pairs(f))
    rarity = Counter(p for f, _ in listed for p in pairs(f))
    for r in v.select("t").mapInArrow(_counted(known), "p string, n bigint").groupBy("p").agg(F.sum("n").alias("n")).collect():  # pairs of the list alone
        rarity[r["p"]] += r["n"]
    return v.select("v", "t").mapInArrow(_matched(listed, own, dict(rarity), least), "v string, code string, sim double")


def learn_forms(rows: DataFrame, person: list[str], column: str, mapped: DataFrame, entries: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(form, code) learned from ``rows``: words of values that no entry is close to, of people whose other rows name one entry.

    A run of up to four words is learned if the entry is named by more than ``PURE`` of the people it is met
    with, by the lower bound of Wilson's interval (so by three of three); of runs within each other the shortest is kept.
    At most ``REFERENCE_MAX`` forms are read on the driver; more raise.
    """
    each = rows.select(*person, F.col(column).alias("v")).dropna().distinct().join(mapped.select("v", "code"), "v")
    one = each.filter(F.col("code") != "").groupBy(*person).agg(F.min("code").alias("code"), F.max("code").alias("last")).filter(F.col("code") == F.col("last")).drop("last")
    w = F.filter(F.split(words(F.col("v")), " "), lambda x: x != "")
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size("w") - i)), lambda k: F.array_join(F.slice("w", i + 1, k), " ")))))
    open_ = each.filter(F.col("code") == "").select(*person, w.alias("w")).filter(F.size("w") > 0).select(*person, F.explode(runs).alias("form")).distinct()
    n = open_.join(one, person).groupBy("form", "code").agg(F.count("*").alias("n"))
    top = n.groupBy("form").agg(F.sum("n").alias("all"), F.max_by("code", F.struct("n", "code")).alias("code"), F.max("n").alias("n"))
    z, k = 1.645**2, F.col("all")
    p = F.col("n") / k
    low = (p + z / (2 * k) - F.sqrt(z * (p * (1 - p) / k + z / (4 * k * k)))) / (1 + z / k)
    got = top.filter(low > PURE).select("form", "code", "n").limit(REFERENCE_MAX + 1).collect()
    if len(got) > REFERENCE_MAX:
        raise ValueError(f"more than {REFERENCE_MAX} learned forms")
    kept: dict[str, str] = {}
    for form, code, _ in sorted(got, key=lambda r: (len(r["form"].split()), r["form"])):
        inside = {" ".join(x[i : i + k]) for x in [form.split()] for k in range(1, len(x)) for i in range(len(x) - k + 1)}
        if not any(kept.get(x) == code for x in inside) and any(len(x) > 2 and x not in SMALL for x in form.split()):
            kept[form] = code
    return sorted(kept.items())


def reference(df: DataFrame, code: str, label: str) -> list[tuple[str, str]]:
    """The list's entries, on the driver; more than ``REFERENCE_MAX`` raise. Null codes and labels are left out."""
    rows = df.select(code, label).dropna().limit(REFERENCE_MAX + 1).collect()
    if len(rows) > REFERENCE_MAX:
        raise ValueError(f"more than {REFERENCE_MAX} entries")
    return [(r[0], r[1]) for r in rows]


def unlisted(rows: DataFrame, line: str, column: str, entries: list[tuple[str, str]]) -> DataFrame:
    """(line, v) of the rows whose value isn't null nor letter for letter a label of the list."""
    labels = sorted({x for _, x in entries})
    typed = rows.select(F.col(line).alias("line"), F.col(column).alias("v")).filter(F.col("v").isNotNull())
    return typed.join(rows.sparkSession.createDataFrame([(x,) for x in labels], "v string"), "v", "left_anti")


def map_column(rows: DataFrame, line: str, column: str, entries: list[tuple[str, str]], **how) -> DataFrame:
    """(``line``, champ, code) of each row whose value isn't null nor letter for letter a label of the list.

    ``rows`` may repeat; each row comes out once for each time. A value that a third of all rows hold is
    mapped once; the join back to the rows is split by AQE where one value holds many.
    """
    typed = unlisted(rows, line, column, entries)
    mapped = map_values(typed.select("v"), entries, **how)
    return typed.join(mapped, "v").select(F.col("line").alias(line), F.lit(column).alias("champ"), "code")
