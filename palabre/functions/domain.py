"""Scalar functions for typed values: numbers, ordered classification, labels, links, lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words


def french_number(c: Column) -> Column:
    """A decimal written with a comma and perhaps the minus sign U+2212, as a double; null where it is none."""
    return F.regexp_replace(F.translate(c, ",−", ".-"), r"[   ]", "").try_cast("double")


def first_match(c: Column, rules: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """The code of the first rule, in order, of whose keywords the folded text holds one; null stays null."""
    t = words(c)
    out = F.lit(otherwise)
    for code, keys in reversed(rules):
        hit = None
        for k in keys:
            e = F.contains(t, F.lit(k))
            hit = e if hit is None else hit | e
        out = F.when(hit, F.lit(code)).otherwise(out)
    return F.when(c.isNotNull(), out)


def without_tags(c: Column) -> Column:
    """Entities undone first, then tags taken out and white space collapsed."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def web_link(c: Column) -> Column:
    """The link if it is plain http(s) without spaces or quotes, else null."""
    return F.when(c.rlike(r"^https?://[^\s\"'<>]+$"), c)


def label(code: Column, gender: Column, labels: dict[str, tuple[str, str]]) -> Column:
    """Label of a code in the form of the gender; the code itself where it has none."""
    out = code
    for k, (m, f) in labels.items():
        out = F.when(code == k, F.when(gender == "f", F.lit(f)).otherwise(F.lit(m))).otherwise(out)
    return out


def enumerate_words(c: Column) -> Column:
    """'a, b et c' of an array; the empty text of an empty one."""
    n = F.size(c)
    return F.when(n <= 0, "").when(n == 1, F.element_at(c, 1)).otherwise(F.concat(F.array_join(F.slice(c, F.lit(1), F.greatest(F.lit(1), n - 1)), ", "), F.lit(" et "), F.element_at(c, -1)))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


LIST_MAX = 10_000  # entries of a list of families; a longer one is refused


def family_of(values: DataFrame, value: str, folded: Callable[[Column], Column], entries: DataFrame, label: str, order: str, family: str) -> DataFrame:
    """(``value``, ``family``) of the values that hold an entry's words: the family of the first such entry by ``order``.

    The entries are read on the driver, ``LIST_MAX`` of them at most, and asked in their order.
    """
    rows = entries.select(folded(F.col(label)).alias("w"), order, family).filter(F.col("w") != "").orderBy(order).limit(LIST_MAX + 1).collect()
    if len(rows) > LIST_MAX:
        raise ValueError(f"more than {LIST_MAX} entries")
    listed = F.array(*[F.struct(F.lit(r["w"]).alias("w"), F.lit(r[family]).alias("f")) for r in rows]).cast("array<struct<w:string,f:string>>")
    d = values.select(value, folded(F.col(value)).alias("_t")).withColumn("_hit", F.filter(listed, lambda e: F.contains(F.col("_t"), e["w"])))
    return d.filter(F.size("_hit") > 0).select(value, F.col("_hit")[0]["f"].alias(family))
