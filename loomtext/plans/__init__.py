"""From a grammar to a Spark plan: regular grammars as JVM expressions, the others as vectorised Python."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..grammar import P
from ..lower import NotRegular, lower
from ..machine import Error, Parser, Result
from ..schema import fields, result_type
from . import values


def tier(p: P) -> str:
    """"jvm" or "python": whether a grammar matches without the interpreter."""
    try:
        lower(p)
        return "jvm"
    except NotRegular:
        return "python"


def matches(text: Column, p: P) -> Column:
    """Whether a regular grammar matches at the start."""
    return text.rlike(rf"\A{lower(p)}")


def captured(text: Column, p: P) -> Column:
    """What a regular grammar consumes at the start; null where it fails, which is not the same as ''."""
    return F.when(matches(text, p), F.regexp_extract(text, rf"\A({lower(p)})", 1))


def consumed(text: Column, p: P) -> Column:
    return F.length(captured(text, p))


def items(text: Column, item: P) -> Column:
    """All items of a regular grammar in a text, from left to right, what is between them skipped."""
    return F.regexp_extract_all(text, F.lit(f"({lower(item)})"), F.lit(1))


def location(text: str, offset: int) -> dict:
    """1-based line and column of an offset, clamped to the text; only a newline ends a line."""
    offset = min(max(offset, 0), len(text))
    return {"line": text.count("\n", 0, offset) + 1, "column": offset - text.rfind("\n", 0, offset), "offset": offset}


def error_row(e: Error, text: str) -> dict:
    return {"kind": e.kind, "found": e.found, "expected": sorted(set(e.expected)), "message": e.message, "loc": location(text, e.offset)}


class _Held:
    """A parser compiled once for each Python worker's task, from what can be sent there."""

    def __init__(self, source: P | Callable[[str], Result]):
        self.source, self.parser = source, None

    def __call__(self, text: str, *start: int) -> Result:
        if self.parser is None:
            self.parser = Parser(self.source) if isinstance(self.source, P) else self.source
        return self.parser(text, *start)

    def __getstate__(self) -> dict:
        return {"source": self.source, "parser": None}


def _struct(texts: pa.Array, held: _Held, value: Callable[[Any], Any], kind: pa.DataType, with_trace: bool) -> pa.StructArray:
    """Results as one Arrow struct, a column at a time."""
    status, values, errors, consumed, furthest, trace, absent = [], [], [], [], [], [], []
    for t in texts.to_pylist():
        r = None if t is None else held(t)
        absent.append(r is None)
        status.append(None if r is None else r.status)
        values.append(None if r is None or r.status == "failure" else value(r.value))
        errors.append(None if r is None else [error_row(e, t) for e in r.errors])
        consumed.append(None if r is None else r.consumed)
        furthest.append(None if r is None else location(t, r.furthest))
        trace.append(None if r is None else [dict(zip(("label", "start", "end", "value"), x, strict=True)) for x in r.trace])
    columns = [status, values, errors, consumed, furthest] + [trace] * with_trace
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))


def _interpreted(text: Column, held: _Held, value_type: str, value: Callable[[Any], Any], with_trace: bool = False) -> Column:
    schema = result_type(value_type, with_trace)
    kind = to_arrow_type(fields(f"r {schema}")["r"].dataType)

    @F.arrow_udf(schema)
    def run(texts: pa.Array) -> pa.Array:
        return _struct(texts, held, value, kind, with_trace)

    return run(text)


def _same(v: Any) -> Any:
    return v


def parse(text: Column, p: P | Callable[[str], Result], value_type: str, value: Callable[[Any], Any] = _same) -> Column:
    """RESULT of each text: status, value, errors with locations, consumed, furthest. A null text gives null.

    Where grammar and value are regular, the JVM does what succeeds; only the other texts go to the interpreter, for their errors.
    """
    held = _Held(p)
    fast = values.lowered(p) if isinstance(p, P) and value is _same and not _recovers(p) else None
    if fast is None:
        return _interpreted(text, held, value_type, value)
    matched = text.rlike(rf"\A{fast[0]}")
    n = F.length(F.regexp_extract(text, rf"\A({fast[0]})", 1))
    slow = _interpreted(F.when(~matched, text), held, value_type, value)
    before = F.substring(text, F.lit(1), n)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    column = F.length(F.substring_index(before, "\n", -1)) + 1
    empty = F.array().cast(result_type(value_type).partition("errors:")[2].partition(",consumed")[0])
    done = F.struct(F.lit("success").alias("status"), fast[1](text, F.lit(0)).cast(value_type).alias("value"), empty.alias("errors"), n.alias("consumed"), F.struct(line.cast("int").alias("line"), column.cast("int").alias("column"), n.alias("offset")).alias("furthest"))
    return F.when(matched, done).otherwise(slow)


def _recovers(p: P) -> bool:
    """Whether a grammar may give a partial result."""
    return p.kind in ("recover", "recover_with", "sync") or any(_recovers(q) for q in p.args if isinstance(q, P)) or (p.kind == "dispatch" and any(_recovers(q) for _, q in p.args[0]))


def traced(text: Column, p: P, value_type: str = "string", value: Callable[[Any], Any] = _same) -> Column:
    """RESULT with the trace of the parts marked by ``trace`` or ``debug``: array<struct<label, start, end, value>>."""
    return _interpreted(text, _Held(p), value_type, value, True)


def parse_from(text: Column, start: Column, p: P, value_type: str, value: Callable[[Any], Any] = _same) -> Column:
    """RESULT of each text from an offset on: ``consumed`` counts from there, locations are those of the whole text."""
    held = _Held(p)
    kind = to_arrow_type(fields(f"r {result_type(value_type)}")["r"].dataType)

    @F.arrow_udf(result_type(value_type))
    def run(texts: pa.Array, starts: pa.Array) -> pa.Array:
        at = iter([x for x in starts.to_pylist() if x is not None])
        return _struct(texts, lambda t: held(t, next(at)), value, kind, False)

    # A null on either side is one on both; the starts left are those of the texts left.
    return run(F.when(start.isNotNull(), text), F.when(text.isNotNull(), start).cast("int"))


def parse_value(text: Column, p: P | Callable[[str], Result], value_type: str, value: Callable[[Any], Any] = _same) -> Column:
    """Only the value; null for failures."""
    fast = values.lowered(p) if isinstance(p, P) and value is _same else None
    if fast is not None:
        return F.when(text.rlike(rf"\A{fast[0]}"), fast[1](text, F.lit(0)).cast(value_type))
    held = _Held(p)
    kind = to_arrow_type(fields(f"v {value_type}")["v"].dataType)

    @F.arrow_udf(value_type)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            r = None if t is None else held(t)
            out.append(None if r is None or r.status == "failure" else value(r.value))
        return pa.array(out, kind)

    return run(text)
