"""Grammars derived from types: ``Name(value,value)`` for a dataclass or a Spark struct."""

from __future__ import annotations

import dataclasses
import typing
from decimal import Decimal
from types import NoneType, UnionType
from typing import Any

from pyspark.sql import types as T

from .grammar import P, any_char, char, fail, letter, regex, seq, string, succeed

_INT = regex("-?+[0-9]++", "-?+[0-9]++", "integer").map(int)


def _ranged(low: int, high: int) -> P:
    return _INT.flat_map(lambda v: succeed(v) if low <= v <= high else fail(f"{v} is out of range"))


_LETTERS = letter.many1().capture()
_DOUBLE = regex(r"-?+[0-9]++\.[0-9]++", r"-?+[0-9]++\.[0-9]++", "double")
_BOOL = string("true").as_(True) | string("false").as_(False)
PRIMITIVES: dict[Any, P] = {str: _LETTERS, int: _INT, float: _DOUBLE.map(float), bool: _BOOL, Decimal: regex(r"-?+[0-9]++(?:\.[0-9]++)?+", r"-?+[0-9]++(?:\.[0-9]++)?+", "decimal").map(Decimal)}
SPARK: dict[type, P] = {
    T.StringType: _LETTERS,
    T.BooleanType: _BOOL,
    T.ByteType: _ranged(-(2**7), 2**7 - 1),
    T.ShortType: _ranged(-(2**15), 2**15 - 1),
    T.IntegerType: _ranged(-(2**31), 2**31 - 1),
    T.LongType: _ranged(-(2**63), 2**63 - 1),
    T.DoubleType: PRIMITIVES[float],
    T.FloatType: PRIMITIVES[float],
    T.DecimalType: PRIMITIVES[Decimal],
}
character = any_char.surrounded_by(char("'"))


def _listed(item: P, *names: str) -> P:
    open_ = string(names[0] + "(")
    for n in names[1:]:
        open_ = open_ | string(n + "(")
    return item.sep_by(char(",")).between(open_, char(")"))


def _optional(p: P) -> P:
    return p.between(string("Some("), char(")")) | string("None").as_(None)


def derived(t: Any, rename: dict[str, str] | None = None) -> P:
    """The grammar of a type: primitives, Optional, list, dataclasses; or a Spark type (structs need a name: pass ("Name", StructType)).

    Fields of a dataclass with ``metadata={"ignore": True}`` are left out and keep their defaults.
    """
    if t in PRIMITIVES:
        return PRIMITIVES[t]
    if isinstance(t, tuple) and isinstance(t[1], T.StructType):
        parts = [derived(f.dataType) if not f.nullable else _optional(derived(f.dataType)) for f in t[1].fields]
        return _fields(t[0], parts).map(lambda vs: dict(zip(t[1].names, vs, strict=True)))
    if isinstance(t, T.ArrayType):
        return _listed(derived(t.elementType), "List", "Seq", "Vector")
    if isinstance(t, T.DataType):
        return SPARK[type(t)]
    origin = typing.get_origin(t)
    if origin in (typing.Union, UnionType):
        (inner,) = [a for a in typing.get_args(t) if a is not NoneType]
        return _optional(derived(inner))
    if origin is list:
        return _listed(derived(typing.get_args(t)[0]), "List", "Seq", "Vector")
    if dataclasses.is_dataclass(t):
        hints = typing.get_type_hints(t)
        fs = [f for f in dataclasses.fields(t) if not f.metadata.get("ignore")]
        return _fields((rename or {}).get(t.__name__, t.__name__), [derived(hints[f.name]) for f in fs]).map(lambda vs: t(**dict(zip([f.name for f in fs], vs, strict=True))))
    raise TypeError(f"no grammar for {t}")


def _fields(name: str, parts: list[P]) -> P:
    inner = [p if i == 0 else char(",") >> p for i, p in enumerate(parts)]
    return seq(*inner).between(string(name + "("), char(")"))
