"""Text normalisation as Catalyst expressions: accents, slugs, token folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks of the Latin alphabets, and the plain letter that each stands for: by decomposition, and a few that have none.
_BARE = {chr(c): d[0] for c in range(0xE0, 0x250) if chr(c).islower() and len(d := unicodedata.normalize("NFD", chr(c))) > 1 and d[0].isascii()}
_BARE |= {"ø": "o", "đ": "d", "ł": "l"}
MARKED, PLAIN = "".join(_BARE), "".join(_BARE.values())


def fold(c: Column) -> Column:
    """Lower case without accents or ligatures; other characters stay."""
    c = F.lower(c)
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "œ", "oe"), "æ", "ae"), "ß", "ss")
    return F.regexp_replace(F.translate(c, MARKED, PLAIN), r"\p{M}", "")


def words(c: Column) -> Column:
    """Folded words separated by single spaces."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", " "))


def slug(c: Column) -> Column:
    """URL key: folded words joined by hyphens."""
    return F.regexp_replace(words(c), " ", "-")


def deletions(c: Column) -> Column:
    """The word and the words that it leaves when one letter is taken out."""
    n = F.length(c)
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))
    return F.array_distinct(F.concat(F.array(c), F.when(n > 0, one).otherwise(F.array().cast("array<string>"))))
