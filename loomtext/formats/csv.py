"""CSV and TSV (RFC 4180): rows of a text, strictness, headers, and writing."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..charclass import quoted
from ..grammar import P, eof, regex
from ..machine import Error, Parser, Result


@dataclass(frozen=True)
class Csv:
    delimiter: str = ","
    quote: str = '"'
    trim: bool = False
    skip_empty: bool = False


TSV = Csv(delimiter="\t")


class Problem(Enum):
    """What can be wrong with a CSV text."""

    QUOTE = "unterminated quote"
    FIELD = "characters after a quoted field"
    COLUMNS = "inconsistent columns"


def problem(r: Result) -> Problem | None:
    """Which of them a failed result tells of."""
    if r.status != "failure":
        return None
    if any(e.message and e.message.startswith("Inconsistent columns") for e in r.errors):
        return Problem.COLUMNS
    return Problem.QUOTE if any(e.kind == "Unexpected" and e.found == '"' for e in r.errors) else Problem.FIELD


def grammar(c: Csv = Csv()) -> P:
    def field(java: bool) -> P:
        q, d = quoted(c.quote, java), quoted(c.delimiter, java)
        return rf"{q}(?:[^{q}]++|{q}{q})*+{q}|[^{q}{d}\r\n]*+"

    def value(raw: str) -> str:
        if raw.startswith(c.quote):
            raw = raw[1:-1].replace(c.quote * 2, c.quote)
        return raw.strip() if c.trim else raw

    cell = regex(field(False), field(True), "field").map(value)
    record = cell.sep_by1(regex(quoted(c.delimiter, False), quoted(c.delimiter, True), f'"{c.delimiter}"'))
    rows = record.sep_by1(regex(r"\r\n|\n|\r", r"\r\n|\n|\r", "newline")) << eof
    return rows.map(lambda rs: [r for r in rs if any(r)]) if c.skip_empty else rows


@lru_cache(maxsize=64)
def _parser(c: Csv) -> Parser:
    return Parser(grammar(c))


def parse_csv(text: str, c: Csv = Csv()) -> Result:
    return _parser(c)(text)


def parse_strict(text: str, c: Csv = Csv()) -> Result:
    """All rows as wide as the first."""
    r = parse_csv(text, c)
    if r.status == "failure":
        return r
    width = len(r.value[0]) if r.value else 0
    for i, row in enumerate(r.value):
        if len(row) != width:
            return Result("failure", None, (Error("Custom", None, (), f"Inconsistent columns: expected {width}, found {len(row)} at row {i + 1}", r.consumed),), 0, r.consumed)
    return r


def parse_maps(text: str, c: Csv = Csv()) -> Result:
    """Rows as maps by the first row's names; the shorter of both counts, of equal names the last."""
    r = parse_csv(text, c)
    if r.status == "failure":
        return r
    head, rows = (r.value[0], r.value[1:]) if r.value else ([], [])
    return Result(r.status, [dict(zip(head, row, strict=False)) for row in rows], r.errors, r.consumed, r.furthest)


def format_csv(rows: list[list[str]], c: Csv = Csv()) -> str:
    def cell(x: str) -> str:
        return c.quote + x.replace(c.quote, c.quote * 2) + c.quote if any(ch in x for ch in (c.delimiter, "\n", "\r", c.quote)) else x

    return "\n".join(c.delimiter.join(map(cell, row)) for row in rows)


def record_fields(text: Column, c: Csv = Csv()) -> Column:
    """The fields of a column of single records, in the JVM; null where it is no record."""
    q, d = quoted(c.quote, True), quoted(c.delimiter, True)
    one = rf"(?:{q}(?:[^{q}]|{q}{q})*+{q}|[^{q}{d}\r\n]*+)"
    cells = F.regexp_extract_all(F.concat(F.lit(c.delimiter), text), F.lit(rf"\G{d}({one})"), F.lit(1))
    plain = F.transform(cells, lambda x: F.when(x.startswith(c.quote), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(c.quote * 2), F.lit(c.quote))).otherwise(x))
    return F.when(text.rlike(rf"\A{one}(?:{d}{one})*+\z"), plain)


def format_fields(cells: Column, c: Csv = Csv()) -> Column:
    """One record of an array of strings, in the JVM."""
    special = "[" + "".join(quoted(x, True) for x in (c.delimiter, "\n", "\r", c.quote)) + "]"
    return F.array_join(F.transform(cells, lambda x: F.when(x.rlike(special), F.concat(F.lit(c.quote), F.replace(x, F.lit(c.quote), F.lit(c.quote * 2)), F.lit(c.quote))).otherwise(x)), c.delimiter)
