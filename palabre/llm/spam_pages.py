"""Pages of keywords, links and product tags, told from writing by robust distance.

Every text is cut into passages. A passage gets features of density (links, tags, codes, separators),
entropy, repetition, function words and proper names. For each language a robust centre and covariance
are fitted over the passages of the whole corpus by concentration steps; a passage is marked if its
Mahalanobis distance is an outlier's and it lies in the direction of spam: fewer function words and
names, more links, separators and repetition. A document is found if marked passages hold the greater
part of its characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, even

# Frequent function words of the corpus's languages.
FUNCTION_WORDS = {
    "fr": "le la les l un une des du de d et en à au aux que qui ne n pas se s ce c cette ces son sa ses leur il elle ils elles on nous je j y a ont est sont était pour par sur dans avec sans mais ou où dont plus lui qu si comme quand dès jusqu avoir été être fait tout toute trop même aucun entre".split(),
    "en": "the a an of to and in is are was were it its that this with for on at by from as his her their they he she not but which who when we i had have has be been or than so what would there after every never more most one any all".split(),
    "es": "el la los las un una unos de del al y en que no se su sus por con para lo le es era fue son pero como más a o e ha han había donde cuando quien este esta sin todo entre hasta nadie ya muy".split(),
    "de": "der die das den dem des ein eine einen einem einer und in zu von mit auf für ist war nicht sich es im am an als auch aus nach bei aber oder wie so noch nur wird wurde hat hatte sie er ich wir man um vor über unter dass was keine zum zur".split(),
}
FUNCTION_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
FEATURES = ["ex", "fw", "lk", "sp", "rp", "en"]
# Directions of spam: words that are neither function words nor parts of names, links and tags, repeated pairs.
SPAM = {"ex": -1.0, "lk": 1.0, "rp": 1.0}
FLOOR = {"ex": 0.06, "fw": 0.06, "lk": 0.02, "sp": 0.06, "rp": 0.03, "en": 0.03}  # least standard deviation taken
PASSAGE_WORDS = 12  # lines shorter than this without an end of sentence are read with the next
STEPS = 3  # concentration steps
KEEP = 0.5  # share of passages that a step keeps: up to half of a language's may be anything
CUT = 22.46  # quantile 0.999 of chi squared with 6 degrees of freedom
# By how much the covariance of the nearer half of normal data is less than of all, for 1 to 6 features that vary.
CONSISTENT = [7.0, 3.26, 2.45, 2.11, 1.92, 1.785]
RELATED = 0.95  # part of a correlation that is kept, so that features that go together in all passages can be told apart from none
AHEAD = 3.5  # robust standard deviations in one of the directions
OTHER = "xx"  # language of sentences that hold next to no function words of a known one
KNOWN = 0.2  # least part of function words in writing of a known language
OFTEN = 4  # times from which a pair of words counts as repeated
COMMONEST = 0.15  # most that one word makes up of writing in any language
CELLS = 1000  # cells of the grid on which medians and limits are counted
FAR = 200.0  # squared distances beyond are counted as this one
TOKEN = re.compile(r"[^\W\d_]+")
WORDS_AND_MARKS = re.compile(r"[^\W\d_]+|(?:[^\w\s'’-]|[\d_\n])+")
LINKISH = regex.compile(r"https?://\S+|www\.\S+|\b[\p{L}\p{N}-]+\.(?:\p{L}{2,}\.)?[\p{L}]{3,}(?:/\S*)?\b|<[^<>]*>|\]\(|[#＃]\w+|\b\p{Lu}{2,}-?\p{N}{3,}\b|\p{N}+[.,]\p{N}{2}\s?[€$£]|[|»•·→►★]", regex.IGNORECASE)
LINKED = re.compile(r"[#＃<|»•·→►★€$£\[]|\w[.]\w|\d{3}")  # what any of these holds
SEPARATOR = re.compile(r"[,;|»•·/*→►★\n]|\s[-–]\s|#")
ENDED = re.compile(r"[.!?…][\s\"'»”)\]]*$")
SENTENCE = regex.compile(r"(?<=[.!?…][\"'»”)]?)\s+(?=[\p{Lu}«\"“¿¡—–(])|(?<=\p{Ll}[.!?…])(?=\p{Lu}\p{Ll})")
LINES = re.compile(r"[\r\n]+")


def passages(text: str) -> list[str]:
    """The text in pieces: sentences; runs of lines without an end of sentence until they hold enough words."""
    out: list[str] = []
    held: list[str] = []
    n = 0
    for line in LINES.split(text):
        for piece in SENTENCE.split(line):
            if not piece.strip():
                continue
            if ENDED.search(piece[-12:]):
                if held:
                    out.append("\n".join(held))
                    held, n = [], 0
                out.append(piece)
            else:
                held.append(piece)
                n += len(TOKEN.findall(piece))
                if n >= PASSAGE_WORDS:
                    out.append("\n".join(held))
                    held, n = [], 0
    if held:
        out.append("\n".join(held))
    return out


def language(often: Counter, sentences: float) -> str:
    """The known language most of whose function words stand in the text; ``OTHER`` where these are too few and most of the text is sentences that don't turn on one word."""
    n = {k: sum(often[w] for w in s if w in often) for k, s in FUNCTION_SETS.items()}
    top = max(n, key=lambda k: (n[k], k))
    total = often.total()
    unknown = sentences > 0.5 and n[top] < KNOWN * total and max(often.values()) <= max(2, COMMONEST * total)
    return OTHER if unknown else top


def _split(piece: str) -> tuple[list[str], list[str], list[tuple[str, str]], list[bool]]:
    """Words, words in lower case, neighbours in lower case, and for each word whether a mark of punctuation stands before it."""
    parts = WORDS_AND_MARKS.findall(piece)
    words, starts, new = [], [], True
    for x in parts:
        if x[0].isalpha():
            words.append(x)
            starts.append(new)
            new = False
        else:
            new = True
    low = " ".join(words).lower().split(" ") if words else []
    if len(low) != len(words):
        low = [w.lower() for w in words]
    return words, low, [p for p, s in zip(zip(low, low[1:]), starts[1:]) if not s], starts


def features(text: str) -> tuple[str, list[tuple[int, list[float]]]]:
    """Language by function words, and size and features of each different passage.

    A passage that stands on the page many times is one passage of that many characters, and counts less than ``OFTEN`` times among the
    repeated pairs of words: copies of a sentence alone don't make a page of keywords.
    """
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    times = Counter(passages(text))
    cut = {p: _split(p) for p in times}
    often: Counter = Counter()
    pairs: Counter = Counter()
    for p, (_, low, ps, _) in cut.items():
        often.update(low)
        for _ in range(min(OFTEN - 1, times[p])):
            pairs.update(ps)
    ended = sum(len(p) for p in times if ENDED.search(p[-12:]) and len(cut[p][0]) >= 4)
    lang = language(often, ended / max(1, sum(map(len, times))))
    own = FUNCTION_SETS.get(lang, frozenset())
    out = []
    for piece, (words, low, ps, starts) in cut.items():
        size = len("".join(piece.split()))
        n = len(low)
        if not n:
            out.append((size * times[piece], [0.0, 0.0, 1.0, 1.0, 0.0, 1.0]))
            continue
        linked = sum(len(m.group()) for m in LINKISH.finditer(piece)) if LINKED.search(piece) else 0
        function = sum(w in own for w in low)
        explained = function
        # names stand in pairs of capitalised words that the page doesn't keep repeating
        name = [w.istitle() and len(w) > 1 and often[x] <= 2 for w, x in zip(words, low)]
        if True in name:
            beside = [a and b and not s for a, b, s in zip(name, name[1:], starts[1:])]
            explained += sum(a and (x or y) and w not in own for a, x, y, w in zip(name, [False, *beside], [*beside, False], low))
        counts = Counter(low)
        entropy = -sum(v / n * math.log(v / n) for v in counts.values()) / math.log(n) if n > 1 else 1.0
        repeated = sum(pairs[p] >= OFTEN for p in ps) / max(1, len(ps))
        out.append((size * times[piece], [explained / n, function / n, min(1.0, linked / max(1, size)), min(1.0, len(SEPARATOR.findall(piece)) / n), repeated, entropy]))
    return lang, out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, langs, sizes, cols = [], [], [], [[] for _ in FEATURES]
        at = b.column("id").to_pylist()
        for i, text in zip(at, b.column("text").to_pylist()):
            if not text or text.isspace():
                continue
            lang, rows = features(text)
            for size, f in rows:
                ids.append(i)
                langs.append(lang)
                sizes.append(size)
                for c, v in zip(cols, f):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("id").type), pa.array(langs, pa.string()), pa.array(sizes, pa.int64()), *[pa.array(c, pa.float64()) for c in cols]], ["id", "lang", "size", *FEATURES])


def _moments(df: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance by language: one row of sums for each language comes to the driver."""
    sums = [F.avg(f).alias(f"m_{f}") for f in FEATURES] + [F.avg(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(FEATURES) for b in FEATURES[i:]]
    out = {}
    for r in df.groupBy("lang").agg(*sums).collect():
        m = np.array([r[f"m_{f}"] for f in FEATURES])
        s = np.array([[r[f"s_{a}_{b}"] if i <= j else r[f"s_{b}_{a}"] for j, b in enumerate(FEATURES)] for i, a in enumerate(FEATURES)])
        out[r["lang"]] = (m, s - np.outer(m, m))
    return out


def _by_language(fit: dict[str, tuple[np.ndarray, np.ndarray]], what: str) -> Column:
    """Squared distance ('d2'), or how far it leads along the spam direction in which it is farthest ('to')."""
    out = F.lit(0.0)
    for lang, (m, c) in sorted(fit.items()):
        floor = np.array([FLOOR[f] for f in FEATURES])
        c = c + np.diag(np.maximum(0.0, floor**2 - np.diag(c)))
        c = RELATED * c + (1 - RELATED) * np.diag(np.diag(c))
        z = [F.col(f) - F.lit(float(m[i])) for i, f in enumerate(FEATURES)]
        if what == "d2":
            inv = np.linalg.inv(c)
            e = sum((z[i] * z[j] * F.lit(float(inv[i, j] * (1 if i == j else 2))) for i in range(len(z)) for j in range(i, len(z))), F.lit(0.0))
        else:
            e = F.greatest(*[z[i] * F.lit(SPAM[f] / math.sqrt(c[i, i])) for i, f in enumerate(FEATURES) if f in SPAM])
        out = F.when(F.col("lang") == lang, e).otherwise(out)
    return out


def _quantiles(df: DataFrame, columns: list[str], most: float, q: float) -> dict[tuple[str, str], float]:
    """The ``q`` quantile of each column by language, exact on a grid of ``CELLS`` cells from 0 to ``most``: at most that many counts of each come to the driver."""
    cell = lambda c: F.least(F.lit(CELLS), F.ceil(F.col(c) * F.lit(CELLS / most)).cast("int"))
    long = df.select("lang", F.inline(F.array(*[F.struct(F.lit(c).alias("c"), cell(c).alias("at")) for c in columns])))
    by: dict[tuple[str, str], list[tuple[int, int]]] = defaultdict(list)
    for r in long.groupBy("lang", "c", "at").agg(F.count("*").alias("n")).collect():
        by[r["lang"], r["c"]].append((r["at"], r["n"]))
    out = {}
    for k, counts in by.items():
        left = q * sum(n for _, n in counts)
        for at, n in sorted(counts):
            left -= n
            if left <= 0:
                out[k] = at * most / CELLS
                break
    return out


def fit(rows: DataFrame, steps: int = STEPS, keep: float = KEEP) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and covariance of the central part of each language's passages.

    Starts from medians; each step keeps the ``keep`` nearest passages and fits them anew. The covariance of
    the half kept last is scaled to that of all passages were they normal, by the number of features that
    vary, so passages that are no writing don't widen it. Nothing depends on order or partitions.
    """
    med = _quantiles(rows, FEATURES, 1.0, 0.5)
    now = {k: (np.array([med[k, f] for f in FEATURES]), np.diag([(2 * FLOOR[f]) ** 2 for f in FEATURES])) for k in sorted({k for k, _ in med})}
    for _ in range(steps):
        d = rows.withColumn("d2", _by_language(now, "d2"))
        bound = F.lit(0.0)
        for (lang, _), q in sorted(_quantiles(d, ["d2"], FAR, keep).items()):
            bound = F.when(F.col("lang") == lang, F.lit(q)).otherwise(bound)
        now |= _moments(d.filter(F.col("d2") <= bound))
    floor = np.array([FLOOR[f] for f in FEATURES])
    varying = {k: max(1, int((np.diag(c) > 0.05 * floor**2).sum())) for k, (_, c) in now.items()}
    return {k: (m, c * CONSISTENT[varying[k] - 1]) for k, (m, c) in now.items()}


def score_documents(docs: DataFrame, doc_id: str, text: str, threshold: float = CUT) -> DataFrame:
    """(``doc_id``, n_chars, spam_chars) of every document with a text that isn't blank.

    Null, empty and blank texts have no passages and no row; a repeated doc_id is taken as one document
    of all its texts. Other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"id {kind}, lang string, size bigint, " + ", ".join(f"{f} double" for f in FEATURES)
    rows = cut(even(docs.select(docs[doc_id].alias("id"), docs[text].alias("text")), "id").mapInArrow(_rows, schema))
    robust = fit(rows)
    marked = (_by_language(robust, "d2") > F.lit(threshold)) & (_by_language(robust, "to") > AHEAD)
    out = rows.groupBy("id").agg(F.sum("size").alias("n_chars"), F.sum(F.when(marked, F.col("size")).otherwise(F.lit(0))).alias("spam_chars"))
    return out.withColumnRenamed("id", doc_id)


def spam_pages(docs: DataFrame, doc_id: str, text: str, share: float = 0.5) -> DataFrame:
    """(``doc_id``) of the documents whose greater part is keywords, links or product tags."""
    s = score_documents(docs, doc_id, text)
    return s.filter(F.col("spam_chars") > F.lit(share) * F.col("n_chars")).select(doc_id)
