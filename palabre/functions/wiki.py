"""Facts read from wiki pages: infoboxes, sections, tables by the labels of their headers, sentences with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import table_cells
from .text import words


def infobox(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, key, rank, value) of the lines ``| key = value`` of a page's infobox: a number at the end of a key is its rank, 1 without one."""
    line = df.select(*keep, F.explode(F.regexp_extract_all(F.regexp_extract(F.col(text), r"(?s)(\{\{Infobox.*?\n\}\})", 1), F.lit(r"(?m)^\s*\|\s*([\p{L}_ ]+?\d*\s*=[^\n]*)$"), F.lit(1))).alias("l"))
    key, value = F.trim(F.substring_index("l", "=", 1)), F.trim(F.regexp_replace("l", r"^[^=]*=", ""))
    rank = F.coalesce(F.nullif(F.regexp_extract(key, r"(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    return line.select(*keep, F.regexp_replace(words(F.regexp_replace(key, r"\d+$", "")), " ", "_").alias("key"), rank.alias("rank"), value.alias("value")).filter(F.col("value") != "")


def sections(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, title, body) of the sections under ``== title ==`` of a page."""
    parts = F.split(F.col(text), r"(?m)^(?===[^=])")
    d = df.select(*keep, F.explode(parts).alias("p")).filter(F.col("p").rlike(r"^==[^=]"))
    return d.select(*keep, F.trim(F.regexp_extract("p", r"^==\s*([^=\n]+?)\s*==", 1)).alias("title"), F.trim(F.regexp_replace("p", r"^==[^\n]*\n?", "")).alias("body"))


def plain(c: Column) -> Column:
    """Text of a cell: what a link shows, without bold marks, notes, templates and tags."""
    c = F.regexp_replace(c, r"<ref[^>]*/>|<ref[^>]*>.*?</ref>", "")
    c = F.regexp_replace(c, r"\{\{[^{}]*\}\}", "")
    c = F.regexp_replace(F.regexp_replace(c, r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1"), r"'''?|<[^>]*>", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def by_header(df: DataFrame, keep: list[str], text: str, roles: dict[str, list[str]]) -> DataFrame:
    """(keep, table, row, one column a role): rows of every table, each cell under the role that its header's label has, wherever it stands.

    ``roles`` lists the folded words that a label of each role begins with. A table without any of them gives
    no rows; a role that a table lacks is null.
    """
    c = table_cells(df, keep, text)
    label = words(plain(F.col("text")))
    role = F.coalesce(*[F.when(label.rlike(f"^(?:{'|'.join(keys)})"), F.lit(r)) for r, keys in roles.items()])
    head = c.filter("header").select(*keep, "table", "col", "row", role.alias("role")).filter(F.col("role").isNotNull())
    head = head.groupBy(*keep, "table", "col").agg(F.min_by("role", "row").alias("role"))
    body = c.filter("not header").join(head, [*keep, "table", "col"])
    return body.groupBy(*keep, "table", "row").pivot("role", list(roles)).agg(F.first(plain(F.col("text"))))


def outcome(c: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The code of the first pattern, in order, that the folded text holds."""
    t, out = words(c), F.lit(otherwise)
    for code, pattern in reversed(rules):
        out = F.when(t.rlike(pattern), F.lit(code)).otherwise(out)
    return F.when(c.isNotNull(), out)


def numbers(c: Column) -> Column:
    """The number of a cell with notes and spaces between its digits, as a long; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(plain(c), r"(\d{1,3}(?:[  .]\d{3})+|\d+)", 1), r"[^\d]", ""), F.lit("")).cast("bigint")
