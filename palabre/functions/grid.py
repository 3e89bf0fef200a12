"""Tables in wiki or HTML markup as rectangular grids.

A state machine reads cells at brace and link depth 0, so a separator inside a template is text. Spans
are expanded: every position holds the text of the cell that covers it, and whether it is its origin.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

SPAN = re.compile(r"\b(rowspan|colspan)\s*=\s*[\"']?\s*(\d+)", re.IGNORECASE)
MOST = {"colspan": 1000, "rowspan": 65534}  # where the HTML standard clamps a span; rows end with their table besides
BARE = re.compile(r"^\s*(?:(?:rowspan|colspan|style|class|align|bgcolor|width|scope)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s|]+)\s*)+", re.IGNORECASE)
CELL = StructType([StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("text", StringType()), StructField("header", BooleanType()), StructField("origin", BooleanType())])


def _split(line: str, marks: tuple[str, ...]) -> list[str]:
    """Parts of a line at marks that stand outside of braces and links."""
    out, depth, at, i = [], 0, 0, 0
    while i < len(line):
        two = line[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        elif depth == 0 and two in marks:
            out.append(line[at:i])
            i += 2
            at = i
        else:
            i += 1
    return [*out, line[at:]]


def _attributes(cell: str) -> tuple[dict[str, int], str]:
    """Spans and text of a cell: what stands before a single bar is attributes if it looks like some."""
    depth = 0
    for i, c in enumerate(cell):
        if cell[i : i + 2] in ("{{", "[["):
            depth += 1
        elif cell[i : i + 2] in ("}}", "]]"):
            depth -= 1
        elif c == "|" and depth == 0:
            head = cell[:i]
            if "=" in head or not head.strip():
                return _spans(head), cell[i + 1 :].strip()
            break
    if m := BARE.match(cell):  # attributes whose bar is missing
        return _spans(m.group()), cell[m.end() :].strip()
    return {}, cell.strip()


def _spans(head: str) -> dict[str, int]:
    return {k.lower(): max(1, min(MOST[k.lower()], int(v))) for k, v in SPAN.findall(head)}


def wiki_tables(text: str) -> list[list[list[tuple[str, bool, int, int]]]]:
    """Of every table in wiki markup its rows of (text, header, rows, columns)."""
    tables: list[list[list]] = []
    rows: list[list] | None = None
    for line in text.split("\n"):
        s = line.strip()
        if rows is None or s.startswith("{|"):
            if s.startswith("{|"):
                rows = [[]]
                tables.append(rows)
        elif s.startswith("|}"):
            rows = None
        elif s.startswith("|-"):
            rows.append([])
        elif s.startswith("|+"):
            continue
        elif s[:1] in ("|", "!"):
            head = s[0] == "!"
            for part in _split(s[1:], ("||", "!!") if head else ("||",)):
                a, t = _attributes(part)
                rows[-1].append((t, head, a.get("rowspan", 1), a.get("colspan", 1)))
        elif rows[-1] and s:  # text that goes on
            t, h, r, c = rows[-1][-1]
            rows[-1][-1] = (f"{t}\n{s}", h, r, c)
    return [[r for r in t if r] for t in tables]


def wiki_rows(text: str) -> list[list[tuple[str, bool, int, int]]]:
    """Rows of the first table in wiki markup."""
    return next(iter(wiki_tables(text)), [])


def html_tables(text: str) -> list[list[list[tuple[str, bool, int, int]]]]:
    return [r for m in re.finditer(r"<table\b[^>]*>.*?(?:</table>|$)", text, re.IGNORECASE | re.DOTALL) if (r := html_rows(m.group()))]


def html_rows(text: str) -> list[list[tuple[str, bool, int, int]]]:
    """Rows of the first table in HTML."""
    m = re.search(r"<table\b[^>]*>(.*?)(</table>|$)", text, re.IGNORECASE | re.DOTALL)
    if not m:
        return []
    rows = []
    for r in re.split(r"<tr\b[^>]*>", m.group(1), flags=re.IGNORECASE)[1:]:
        row = []
        for tag, attrs, body in re.findall(r"<(t[hd])\b([^>]*)>(.*?)(?=<t[hd]\b|</t[hd]>|</tr>|$)", r, re.IGNORECASE | re.DOTALL):
            a = _spans(attrs)
            row.append((" ".join(re.sub(r"<[^>]*>", " ", body).split()), tag.lower() == "th", a.get("rowspan", 1), a.get("colspan", 1)))
        if row:
            rows.append(row)
    return rows


def expand_grid(rows: list[list[tuple[str, bool, int, int]]]) -> list[tuple[int, int, str, bool, bool]]:
    """(row, col, text, header, origin) of every position; spans that run past the last row end there."""
    taken: dict[tuple[int, int], tuple[str, bool, bool]] = {}
    for i, row in enumerate(rows):
        j = 0
        for text, header, down, across in row:
            while (i, j) in taken:
                j += 1
            for x in range(i, min(len(rows), i + down)):
                for y in range(j, j + across):
                    taken.setdefault((x, y), (text, header, (x, y) == (i, j)))
            j += across
    return [(i, j, *v) for (i, j), v in sorted(taken.items())]


def _cells_of(t: str | None) -> list[dict] | None:
    if t is None:
        return None
    return [dict(zip(CELL.names, c)) for c in expand_grid(wiki_rows(t) or html_rows(t))]


TABLE_CELL = StructType([StructField("table", IntegerType()), *CELL.fields])


@F.pandas_udf(ArrayType(TABLE_CELL))
def _tables_udf(s: pd.Series) -> pd.Series:
    def of(t: str | None) -> list[dict] | None:
        return None if t is None else [{"table": k, **dict(zip(CELL.names, c))} for k, rows in enumerate(wiki_tables(t) or html_tables(t)) for c in expand_grid(rows)]

    return s.map(of)


def table_cells(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, table, row, col, text, header, origin): one row a position of every table of each row's text."""
    return df.select(*keep, F.inline(_tables_udf(F.col(text))))


@F.pandas_udf(ArrayType(CELL))
def _grid_udf(s: pd.Series) -> pd.Series:
    return s.map(_cells_of)


def grid(c: Column) -> Column:
    """Array of the cells of the first table of a text; empty without a table, null for null."""
    return _grid_udf(c)


def cells(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row a position of the grid of each row's text."""
    return df.select(*keep, F.inline(grid(F.col(text))))


def unpivot_matrix(c: DataFrame, key: list[str]) -> DataFrame:
    """(key, member, session, value) of a matrix whose first row names sessions and first column members.

    Roles come from the place of headers; a column equal to the one before it below its header is folded.
    """
    head = c.filter("row = 0 and col > 0").select(*key, "col", F.col("text").alias("session"))
    side = c.filter("col = 0 and row > 0").select(*key, "row", F.col("text").alias("member"))
    body = c.filter("row > 0 and col > 0").select(*key, "row", "col", "text")
    whole = c.filter("row > 0 and col > 0").groupBy(*key, "col").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("all"))
    before = whole.select(*key, (F.col("col") + 1).alias("col"), F.col("all").alias("prev"))
    kept = whole.join(before, [*key, "col"], "left").filter(F.col("prev").isNull() | (F.col("prev") != F.col("all"))).select(*key, "col")
    return body.join(kept, [*key, "col"], "left_semi").join(head, [*key, "col"]).join(side, [*key, "row"]).select(*key, "member", "session", F.col("text").alias("value"))
