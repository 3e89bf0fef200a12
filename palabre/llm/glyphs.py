"""One consistent form for text whose characters differ but look the same.

A mapping is precomputed by rule for widths, styled letters, ligatures, spaces, hyphens, invisible
characters, accents written as separate marks and look-alike letters; it is checked for conflicts
and compiled into a trie that is walked once over the grapheme clusters of a text, always taking the
longest match. Look-alikes depend on the alphabet most letters of the text belong to.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Look-alike letters, each beside its Latin twin. The first are the same in nearly every
# typeface; the further ones are only near, and are taken as Latin in Latin words alone.
CYRILLIC, CYRILLIC_AS = "АВЕКМНОРСТХУІЈЅаеорсухіјѕ", "ABEKMHOPCTXYIJSaeopcyxijs"
CYRILLIC_NEAR, CYRILLIC_NEAR_AS = "ҮԌԚԜһԁԛԝкмтвнӏү", "YGQWhdqwkmtbhly"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳ", "ABEZHIKMNOPTYXovj"
GREEK_NEAR, GREEK_NEAR_AS = "αικρυχγηωετϲ", "aikpuxynwetc"
ARMENIAN = "ՏՍՕԼ" + "օսոհցզյ"
ARMENIAN_AS = "SUOL" + "ounhgqj"
LATIN_TWINS = "ɑɡɩʋᴏᴠᴡᴢꞮ"
LATIN_TWINS_AS = "agivovwzI"
HYPHENS = "‐‑‒−﹣֊˗⁃"
# Code points that show nothing, beside the categories Cf and variation selectors.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ⠀"
COMPATIBLE = [(0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0xFB00, 0xFB06), (0x2100, 0x214F), (0x2160, 0x2188), (0x1D2C, 0x1D6A), (0x2C7C, 0x2C7D), (0x132, 0x133), (0x13F, 0x140), (0x149, 0x149), (0x17F, 0x17F)]
TWINNED = frozenset(CYRILLIC + CYRILLIC_AS + GREEK + GREEK_AS)
JOINED = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gujarati}\p{Gurmukhi}\p{Kannada}\p{Malayalam}\p{Oriya}\p{Tamil}\p{Telugu}\p{Sinhala}\p{Extended_Pictographic}]")
CLUSTER = regex.compile(r"\X")
ALPHABETS = {"latin": regex.compile(r"\p{Latin}"), "cyrillic": regex.compile(r"\p{Cyrillic}"), "greek": regex.compile(r"\p{Greek}"), "armenian": regex.compile(r"\p{Armenian}")}


class Conflict(ValueError):
    """Two rules give the same sequence different outputs."""


def _put(out: dict[str, str], a: str, b: str) -> None:
    if a != b and out.setdefault(a, b) != b:
        raise Conflict(f"{a!r}: {out[a]!r} and {b!r}")


@lru_cache(maxsize=1)
def _common() -> dict[str, str]:
    """The mapping for texts of every alphabet: widths, styles, spaces, hyphens, invisible characters, accents."""
    out: dict[str, str] = {}
    for lo, hi in COMPATIBLE:
        for c in map(chr, range(lo, hi + 1)):
            n = unicodedata.normalize("NFKC", c)
            if n != c and all(x.isalnum() or 0x20 < ord(x) < 0x7F for x in n):
                _put(out, c, n)
    for c in map(chr, [*range(0x34000), *range(0xE0000, 0xE1000)]):  # no other code points are assigned
        kind = unicodedata.category(c)
        if c in out:
            continue
        if kind == "Zs":
            _put(out, c, " ")
        elif kind == "Cf" or c in INVISIBLE or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF:
            _put(out, c, "")
        elif c in HYPHENS:
            _put(out, c, "-")
        elif kind[0] == "L" and unicodedata.normalize("NFC", c) != c:
            _put(out, c, unicodedata.normalize("NFC", c))
        if kind[0] == "L" and len(d := unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFC", d) == c:
            _put(out, d, c)
            if len(d) > 2:  # a letter already composed in part, then the rest of its marks
                for i in range(2, len(d)):
                    if (p := unicodedata.normalize("NFC", d[:i]) + d[i:]) != d:
                        _put(out, p, c)
    return out


def _pairs(alphabet: str) -> dict[str, str]:
    """The mapping for texts mostly in one alphabet ('' for texts in another one)."""
    out = dict(_common())
    all_twins = [(CYRILLIC, CYRILLIC_AS), (CYRILLIC_NEAR, CYRILLIC_NEAR_AS), (GREEK, GREEK_AS), (GREEK_NEAR, GREEK_NEAR_AS), (ARMENIAN, ARMENIAN_AS), (LATIN_TWINS, LATIN_TWINS_AS)]
    twins = {"latin": all_twins, "cyrillic": [(CYRILLIC_AS, CYRILLIC)], "greek": [(GREEK_AS, GREEK)]}.get(alphabet, [])
    for a, b in twins:
        for x, y in zip(a, b, strict=True):
            _put(out, x, y)
    # a look-alike letter under separate marks: composed after it is replaced
    for a, b in list(out.items()):
        if len(a) == 1 and len(b) == 1 and b.isalpha():
            for m in "̧̀́̂̃̈̊̌":
                if len(n := unicodedata.normalize("NFC", b + m)) == 1 and a + m not in out:
                    _put(out, a + m, n)
    return out


@lru_cache(maxsize=4)
def compile_trie(alphabet: str) -> dict:
    """Nested dictionaries by character; the output of a state is under the empty key."""
    root: dict = {}
    for a, b in _pairs(alphabet).items():
        at = root
        for c in a:
            at = at.setdefault(c, {})
        at[""] = b
    return root


@lru_cache(maxsize=1)
def _silent() -> frozenset[str]:
    return frozenset(a for a, b in _common().items() if b == "")


def alphabet_of(text: str) -> str:
    """The alphabet of the letters that have no twin; then of most letters. A tie goes to Latin, then by name."""
    plain = unicodedata.normalize("NFKC", text)
    n = {k: len(p.findall(plain)) for k, p in ALPHABETS.items()}
    sure = {k: sum(1 for c in p.findall(plain) if c not in TWINNED) for k, p in ALPHABETS.items()}
    top = max(n, key=lambda k: (sure[k], n[k], k == "latin"))
    return top if 3 * n[top] >= sum(c.isalpha() for c in plain) and n[top] else ""


def _apply(text: str, alphabet: str) -> str:
    trie, silent, out = compile_trie(alphabet), _silent(), []
    keep_joiners = JOINED.search(text) is not None
    for m in CLUSTER.finditer(text):
        s = m.group()
        if len(s) == 1 and s not in trie:
            out.append(s)
            continue
        if len(s) > 1 and not keep_joiners:  # a mark may stand behind something invisible
            s = "".join(c for c in s if c not in silent)
        i = 0
        while i < len(s):
            if keep_joiners and s[i] in "‌‍︎️":
                out.append(s[i])
                i += 1
                continue
            at, end, best = trie, i + 1, s[i]
            for j in range(i, len(s)):
                at = at.get(s[j])
                if at is None:
                    break
                if "" in at:
                    end, best = j + 1, at[""]
            out.append(best)
            i = end
    joined = "".join(out)
    return joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)


def consistent(text: str | None) -> str | None:
    """``text`` in its consistent form; null stays null and the empty text empty.

    A text that mixes alphabets may be mostly of another one once its look-alikes are replaced; then the
    pass is repeated, so that the form of a form is itself. Letters of another alphabet than the text's own are replaced only in words where they stand among
    letters of the text's alphabet or where all of them have a twin; a word rightly written in another
    alphabet stays.
    """
    if not text or text.isascii():
        return text
    seen = []
    while text not in seen:
        seen.append(text)
        text = _one_pass(text)
    return min(seen[seen.index(text) :])  # one form; if forms ever led round in a circle, the first of them


def _one_pass(text: str) -> str:
    alphabet = alphabet_of(text)
    if alphabet not in ("latin", "cyrillic", "greek"):
        return _apply(text, "")
    mine = ALPHABETS[alphabet]
    out = []
    for part in regex.split(r"(\p{Zs}+)", text):
        changed = _apply(part, alphabet)
        left = [c for c in changed if c.isalpha() and not mine.match(c)]
        own = sum(1 for c in unicodedata.normalize("NFKC", part) if c.isalpha() and mine.match(c))
        out.append(_apply(part, "") if left and not own else changed)
    joined = "".join(out)
    return joined if unicodedata.is_normalized("NFC", joined) else unicodedata.normalize("NFC", joined)


@F.pandas_udf(StringType())
def _consistent_udf(s: pd.Series) -> pd.Series:
    return s.map(consistent, na_action="ignore")


# Characters that are in their form already: these texts never leave the JVM.
PLAIN = r"^[\x00-\x7F¡-¬®-ıĴ-ľŁ-ňŊ-ž]*$"


def suspect(c: Column) -> Column:
    """True where the text holds a character outside of ASCII and the composed letters of Latin-1 and Extended-A."""
    return ~c.rlike(PLAIN)


def consistent_text(c: Column) -> Column:
    """Column form of :func:`consistent`. Python gets only the suspect texts, and a null for each other."""
    return F.when(suspect(c), _consistent_udf(F.when(suspect(c), c))).otherwise(c)
