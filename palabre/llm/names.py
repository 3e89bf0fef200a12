"""Names as people type them: words, slips, nicknames, initials, and keys under which variants meet."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.text import words
from .glyphs import PLAIN, consistent, consistent_text

PARTICLES = ["le", "la", "de", "du", "des", "d", "l", "van", "von"]
SLIP_LETTERS = 4  # a shorter family word must be met letter for letter: one letter off, it is another name
MOST_LETTERS = 64  # a longer word or given name is looked up as it stands: its slips would be as many as its letters
LONG_LETTERS = 7  # words from this length on may differ by two edits
MOST = 2.9  # greatest cost of a match
QUOTED = re.compile(r"[«“\"„][^»”\"]*[»”\"]")
SURELY = re.compile(PLAIN)  # texts that are in their consistent form already
MAY_BE_GLUED = re.compile(r"[a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ]|[^\x00-ÿ]")  # what parted words match, and some more
GLUED = regex.compile(r"(\p{Ll})(\p{Lu})")
LIGATURES = str.maketrans({"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "đ": "d", "ł": "l"})
MARKS = regex.compile(r"\p{M}+")
WORDS = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Words of a text in lower case, without accents, parted by single spaces."""
    t = text.lower()
    if not t.isascii():
        t = MARKS.sub("", unicodedata.normalize("NFKD", t.translate(LIGATURES)))
    return " ".join(WORDS.findall(t))


def folded_name(text: str | None) -> str:
    """Folded words of a name in its consistent form, without what is quoted; words glued together are parted at an inner capital. '' for null."""
    if not text:
        return ""
    t = QUOTED.sub(" ", text)
    if not t.isascii() and not SURELY.match(t):
        t = consistent(t)
    return folded(GLUED.sub(r"\1 \2", t) if MAY_BE_GLUED.search(t) else t)


def _spelled(*columns: pd.Series) -> pd.Series:
    known: dict[tuple, str] = {}
    out = []
    for row in zip(*columns):
        if (n := known.get(row)) is None:
            first = n = ""
            for x in row:
                n = folded_name(x)
                if " " in n:
                    break
                first = first or n
            n = known[row] = n if " " in n else first
        out.append(n)
    return pd.Series(out)


def _profiled(name: pd.Series, given: pd.Series) -> pd.DataFrame:
    out = []
    for n, g in zip(map(folded_name, name), map(folded_name, given)):
        g = g or n.split(" ")[0]
        rest = (n[len(g) :] if f"{n} ".startswith(f"{g} ") else n).split()
        families = [w for w in rest if w not in PARTICLES] or rest
        out.append((g, f"{g}|{' '.join(families)}") if families and g else (None, None))
    return pd.DataFrame(out, columns=["g", "sp"])


_spelled.__annotations__ = {"columns": pd.Series, "return": pd.Series}
_profiled.__annotations__ = {"name": pd.Series, "given": pd.Series, "return": pd.DataFrame}
# in Python, where the consistent form is made: one pass for each name
spelled = F.pandas_udf(_spelled, StringType())
profiled = F.pandas_udf(_profiled, StructType([StructField("g", StringType()), StructField("sp", StringType())]))


def merged(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is merged whatever the sizes: these tables grow with the data, and what Spark
    takes for a small one (a checkpoint, an exploded column) may be many times its estimate. Skewed keys are split by AQE."""
    return df.hint("merge")


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def nicknames(names: DataFrame, column: str) -> DataFrame:
    """(nick, given) learned from names that quote the nickname after the given name: Anna « Nan » Lee."""
    m = r"^\s*(.+?)\s*[«“\"„](.+?)[»”\"]"
    c = consistent_text(F.col(column))
    d = names.filter(F.col(column).rlike(r"[«“\"„]")).select(words(F.regexp_extract(c, m, 1)).alias("given"), words(F.regexp_extract(c, m, 2)).alias("nick"))
    return d.filter((F.col("given") != "") & (F.col("nick") != "") & (F.col("nick") != F.col("given"))).groupBy("nick", "given").agg(F.count("*").alias("n"))


def deletions(c: Column) -> Column:
    """The word and the words that it leaves when one letter is taken out."""
    n = F.length(c)
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))))


def close_words(left: DataFrame, right: DataFrame, short: int = 7) -> DataFrame:
    """(a, b, edits) of the different words ``left.a`` and ``right.b`` that a slip of the pen can part.

    They meet under a shared word of their deletions: one letter more, less or other, or two swapped. Words
    of fewer than ``short`` letters may differ by one edit or swap, longer ones by two edits.
    """
    x = left.select("a", F.explode(deletions(F.col("a"))).alias("k"))
    y = right.select("b", F.explode(deletions(F.col("b"))).alias("k"))
    pairs = x.join(y, "k").select("a", "b").distinct()
    edits = F.levenshtein(F.col("a"), F.col("b"), 2)
    swapped = (F.length("a") == F.length("b")) & (F.sort_array(F.split("a", "")) == F.sort_array(F.split("b", "")))
    pairs = pairs.withColumn("edits", edits).filter(F.col("edits") >= 0)
    pairs = pairs.withColumn("edits", F.when((F.col("edits") == 2) & swapped, F.lit(1)).otherwise(F.col("edits")))
    return pairs.filter((F.col("edits") <= 1) | (F.least(F.length("a"), F.length("b")) >= short))


def given_forms(given: DataFrame, nicks: DataFrame) -> DataFrame:
    """(g, form, cost, slip): what a given name may be typed as, and whether a slip of that form counts as well."""
    known = nicks.groupBy(F.col("given").alias("g")).agg(F.collect_set("nick").alias("nicks"))
    g = given.select("g").distinct().join(known, "g", "left")
    n = F.length("g")
    one = lambda form, cost, slip: F.struct(form.alias("form"), F.lit(cost).alias("cost"), F.lit(slip).alias("slip"))
    own = F.array(one(F.col("g"), 0.0, 0.8))
    begun = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.struct(F.substring("g", F.lit(1), i).alias("form"), F.when(i == 1, 1.4).otherwise(0.9).alias("cost"), F.lit(-1.0).alias("slip")))
    letters = F.transform(split_words(F.col("g")), lambda x: F.substring(x, 1, 1))
    initials = F.filter(F.array(one(F.array_join(letters, " "), 1.2, -1.0), one(F.array_join(letters, ""), 1.2, -1.0)), lambda x: F.col("g").contains(" "))
    glued = F.array(*[one(F.concat("g", F.lit(p)), 0.6, -1.0) for p in PARTICLES if len(p) == 2])
    short = F.transform(F.coalesce("nicks", F.array().cast("array<string>")), lambda x: F.struct(x.alias("form"), F.lit(0.5).alias("cost"), F.when(F.length(x) >= 4, 1.3).otherwise(-1.0).alias("slip")))
    return g.select("g", F.inline(F.concat(own, F.filter(begun, lambda x: n > 1), initials, glued, short))).filter(F.col("form") != "")


def given_matches(typed: DataFrame, given: DataFrame, nicks: DataFrame) -> DataFrame:
    """(w, g, gcost): the given names ``given.g`` that a typed ``typed.w`` may stand for.

    Costs: 0 the same, 0.5 a nickname, 0.6 a particle stuck to it, 0.8 a slip, 0.9 the beginning of the
    name, 1.2 initials, 1.3 a slip in a nickname, 1.4 one initial. Typed words and forms meet in one join
    under the word itself or a word of their deletions.
    """
    tagged = lambda c: F.transform(deletions(c), lambda x: F.concat(F.lit("~"), x))
    none = F.array().cast("array<string>")
    t = typed.select("w").distinct().select("w", F.explode(F.concat(F.array("w"), F.when(F.length("w").between(3, MOST_LETTERS), tagged(F.col("w"))).otherwise(none))).alias("k"))
    f = given_forms(given, nicks)
    f = f.select("g", "form", "cost", "slip", F.explode(F.concat(F.array("form"), F.when((F.col("slip") > 0) & F.length("form").between(3, MOST_LETTERS), tagged(F.col("form"))).otherwise(none))).alias("k"))
    x = t.join(merged(f), "k")
    edits = F.levenshtein(F.col("w"), F.col("form"), 2)
    swapped = (F.length("w") == F.length("form")) & (F.sort_array(F.split("w", "")) == F.sort_array(F.split("form", "")))
    x = x.withColumn("e", F.when((edits == 2) & swapped, 1).otherwise(edits)).filter(F.col("e") >= 0)
    long = F.least(F.length("w"), F.length("form")) >= 6
    cost = F.when(F.col("e") == 0, F.col("cost")).when((F.col("slip") > 0) & (F.col("e") == 1), F.col("slip")).when((F.col("slip") > 0) & (F.col("cost") == 0) & long, F.col("slip") + 0.4)
    return x.withColumn("c", cost).filter(F.col("c").isNotNull()).groupBy("w", "g").agg(F.min("c").alias("gcost"))


# ---- one typed name against one spelling ---------------------------------------------------------


@lru_cache(1 << 16)
def edits(a: str, b: str) -> int:
    """Letters added, lost, changed or swapped with the next between two words; 3 stands for more than two."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            v = min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1)
            if before and j and x == b[j - 1] and y == a[i - 1]:
                v = min(v, before[j - 1] + 1)
            new.append(v)
        before, row = row, new
    return min(3, row[-1])


def family_cost(typed: str, family: str) -> float | None:
    e = edits(typed, family)
    if e == 0:
        return 0.0
    short = min(len(typed), len(family))
    return 0.6 + 0.4 * e if (e == 1 and short >= SLIP_LETTERS) or (e == 2 and short >= LONG_LETTERS) else None


@lru_cache(1 << 16)
def given_cost(typed: str, given: str, other: tuple[str, ...] = ()) -> float | None:
    """What it costs to read ``typed`` as ``given``, whose known other forms are ``other``; None if it can't be.

    0 the same, 0.5 a known form, 0.6 a particle stuck to it, 0.8 a slip, 0.9 the beginning of it or of each of
    its words, 1.2 its initials or two slips in a longer name, 1.3 a slip in a known form, 1.4 one initial.
    """
    if typed == given:
        return 0.0
    if typed in other:
        return 0.5
    if typed in {given + p for p in PARTICLES if len(p) == 2}:
        return 0.6
    e = edits(typed, given)
    if e == 1 and min(len(typed), len(given)) >= 3:
        return 0.8
    for a, b in ((typed, given), (given, typed)):
        if b.startswith(a) and (len(a) == 1 or len(a) > 2 or a == typed):
            return 1.4 if len(a) == 1 else 0.9
    t, g = typed.split(), given.split()
    if len(g) > 1 and (t == [w[0] for w in g] or t == ["".join(w[0] for w in g)]):
        return 1.2
    if len(t) == len(g) > 1 and all(b.startswith(a) for a, b in zip(t, g)):
        return 0.9
    if e == 2 and min(len(typed), len(given)) >= 6:
        return 1.2
    if any(len(o) >= 4 and edits(typed, o) == 1 for o in other):
        return 1.3
    return None


def reading_cost(name: str, given: str, families: list[str], other: tuple[str, ...]) -> tuple[float, str, str] | None:
    """The cheapest way to read all words of ``name`` as this person: (cost, word of the family name, words of the given name).

    Any word may be the family name and any run of the others the given name; words left over, words before
    the given name and family words that are missing cost a little.
    """
    ws = name.split()
    have = set(ws)
    best = None
    longest = max(3, len(given.split()) + 1)
    for f in dict.fromkeys(ws):
        costs = [c for t in families if (c := family_cost(f, t)) is not None]
        if not costs:
            continue
        fc = min(costs)
        missing = max(0, sum(t not in have for t in families) - (fc > 0))
        i = ws.index(f)
        left = [w for j, w in enumerate(ws) if j != i and (len(w) == 1 or w not in PARTICLES)]  # d and l may be initials
        for s in range(len(left)):
            for k in range(1, min(longest, len(left) - s) + 1):
                gc = given_cost(" ".join(left[s : s + k]), given, other)
                if gc is not None:
                    cost = fc + gc + 0.3 * sum(w not in PARTICLES for w in left[:s] + left[s + k :]) + 0.25 * any(w not in PARTICLES for w in left[:s]) + 0.3 * missing
                    if best is None or (cost, f) < best[:2]:
                        best = (cost, f, " ".join(left[s : s + k]))
    return best


READING = StructType([StructField("cost", DoubleType()), StructField("f", StringType()), StructField("w", StringType())])


@F.pandas_udf(READING)
def read_as(name: pd.Series, spelling: pd.Series, other: pd.Series) -> pd.DataFrame:
    """``reading_cost`` of each pair; a spelling is given name | family words, other forms are parted by |. Null beyond ``MOST``."""
    out = []
    for n, sp, o in zip(name, spelling, other):
        g, _, fs = sp.partition("|")
        r = reading_cost(n, g, fs.split(), tuple(o.split("|")) if o else ())
        out.append(r if r and r[0] <= MOST else (None, None, None))
    return pd.DataFrame(out, columns=["cost", "f", "w"])


@F.pandas_udf(DoubleType())
def form_cost(typed: pd.Series, given: pd.Series) -> pd.Series:
    """``given_cost`` of each pair without known forms; null where the given name can't be typed so."""
    return pd.Series([given_cost(t, g) for t, g in zip(typed, given)], dtype="float64")


def word_keys(word: Column) -> Column:
    """Hashes under which a family word meets those that a slip may have made of it: of the word, and of what is left when a letter is taken out."""
    return F.transform(F.when(F.length(word).between(SLIP_LETTERS, MOST_LETTERS), deletions(word)).otherwise(F.array(word)), lambda x: F.xxhash64(x))


def name_keys(names: DataFrame) -> DataFrame:
    """(k, n, f) of every word of ``names.n`` that may be a family name: each beside at least one more."""
    d = names.select("n").filter(F.col("n").contains(" ")).select("n", F.explode(F.array_distinct(split_words(F.col("n")))).alias("f"))
    return d.select(F.explode(word_keys(F.col("f"))).alias("k"), "n", "f")


def spelling_keys(spellings: DataFrame) -> DataFrame:
    """(k, sp, t) of every family word of ``spellings.sp``."""
    d = spellings.select("sp").distinct().select("sp", F.explode(F.array_distinct(split_words(F.substring_index("sp", "|", -1)))).alias("t"))
    return d.select(F.explode(word_keys(F.col("t"))).alias("k"), "sp", "t")


def half_keys(word: Column, typed: bool) -> Column:
    """Beginnings and ends of a family word, one of which a slip leaves as it is: of half its length but one letter, for a typed word also those of a word one letter longer or shorter."""
    n = F.length(word)
    lengths = F.array_distinct(F.array(*[F.floor((n + k - 1) / 2).cast("int") for k in ((-1, 0, 1) if typed else (0,))]))
    halves = F.flatten(F.transform(lengths, lambda h: F.array(F.concat(F.lit("<"), F.substring(word, F.lit(1), h)), F.concat(F.lit(">"), F.substring(word, n - h + 1, h)))))
    return F.when(n >= SLIP_LETTERS, F.concat(halves, F.array(word))).otherwise(F.array(word))


def _edited(x: DataFrame) -> DataFrame:
    e = F.levenshtein(F.col("f"), F.col("t"), 2)
    return x.filter((F.col("f") == F.col("t")) | (e >= 0))


def matches_within(names: DataFrame, spellings: DataFrame, group: str, nicks: DataFrame) -> DataFrame:
    """(group, n, ent, cost): as ``matches``, of names and spellings of one group alone, for ``spellings`` (group, sp, ent).

    In a group a half of a family word tells people well enough apart, so the keys are few.
    """
    x = names.select(group, "n").distinct().filter(F.col("n").contains(" ")).select(group, "n", F.explode(F.array_distinct(split_words(F.col("n")))).alias("f"))
    x = x.select(group, "n", "f", F.explode(half_keys(F.col("f"), True)).alias("k"))
    y = spellings.select(group, "sp", "ent").distinct().select(group, "sp", "ent", F.explode(F.array_distinct(split_words(F.substring_index("sp", "|", -1)))).alias("t"))
    y = y.select(group, "sp", "ent", "t", F.explode(half_keys(F.col("t"), False)).alias("k"))
    return _read(_edited(x.join(merged(y), [group, "k"])).select(group, "n", "sp", "ent").distinct(), nicks).groupBy(group, "n", "ent").agg(F.min("cost").alias("cost"))


def _read(x: DataFrame, nicks: DataFrame) -> DataFrame:
    """``x`` (n, sp, ...) with the cost of reading the name so, for those that can be."""
    kept = x.columns
    x = x.withColumn("g", F.substring_index("sp", "|", 1)).join(merged(nicks), "g", "left")
    return x.withColumn("r", read_as("n", "sp", F.coalesce("other", F.lit("")))).filter(F.col("r.cost").isNotNull()).select(*kept, "r.*")


def matches(keys: DataFrame, spellings: DataFrame, nicks: DataFrame) -> DataFrame:
    """(n, sp, cost, f, w): the spellings ``spellings.sp`` that the names of ``keys`` can be read as.

    Names and spellings, each different one once, meet under a word of their family names in one join. A
    family name that a large part of all names bears meets only its different spellings, one a given name.
    The join is merged, never broadcast: both sides are many times what their tables' sizes tell.
    """
    x = _edited(keys.join(merged(spelling_keys(spellings)), "k").filter((F.col("f") != F.col("t")) | (F.col("k") == F.xxhash64("f"))))
    return _read(x.select("n", "sp").distinct(), nicks)

