"""Values of grammars as JVM expressions: what the interpreter would give, without Python.

``value(p)`` takes the text from where the grammar begins on, and the offset of that place, and assumes that the grammar
matches there.  Only functions that are known by name are lowered (int, float, len, sum, constants, dictionaries, and
the arithmetic of ``operator``); whatever else a grammar holds raises NotRegular, and it is interpreted.
"""

from __future__ import annotations

import operator
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..grammar import Composed, Constant, OnPair, P, cons, fold_left, fold_right
from ..lower import NotRegular, lower

Value = Callable[[Column, Column], Column]
#: A text has fewer characters.
MOST_CHARS = 2**31 - 1
ARITHMETIC: dict[Callable, Callable[[Column, Column], Column]] = {operator.add: F.try_add, operator.sub: F.try_subtract, operator.mul: F.try_multiply}
# Decimal digits of the basic plane, which int() reads.
_DIGITS = "".join(chr(c) for c in range(128, 0x10000) if unicodedata.category(chr(c)) == "Nd")
_ASCII = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def _width(p: P) -> int | None:
    """The length of all matches of a literal, where they have one in common."""
    if p.kind in ("map", "capture", "skip"):
        return _width(p.args[0])
    if p.kind == "or":
        widths = {_width(q) for q in p.args}
        return widths.pop() if len(widths) == 1 else None
    return 1 if p.kind == "char" else len(p.args[0]) if p.kind == "string" else None


def _match(rest: Column, p: P) -> Column:
    if (n := _width(p)) is not None:
        return F.substring(rest, 1, n)
    return F.regexp_extract(rest, rf"\A({lower(p)})", 1)


def _after(rest: Column, at: Column, p: P) -> tuple[Column, Column]:
    n = F.lit(width) if (width := _width(p)) is not None else F.length(_match(rest, p))
    return F.substring(rest, n + 1, F.lit(MOST_CHARS)), at + n


def _literal(p: P) -> bool:
    """Whether a match depends on nothing but the characters matched."""
    return p.kind in ("char", "string") or (p.kind in ("map", "capture", "skip") and _literal(p.args[0])) or (p.kind == "or" and all(map(_literal, p.args)))


def _whole(p: P) -> bool:
    """Whether a grammar that matched gives the same on its match alone."""
    if p.kind in ("look", "not", "eof", "offset", "dispatch", "recover", "optional"):
        return False
    if p.kind == "or":
        return _literal(p)
    if p.kind == "string_in":
        return True
    return all(_whole(q) for q in p.args if isinstance(q, P))


_open: set[int] = set()


def _once(p: P, f: Callable):
    """What ``f`` makes of the grammar that a reference stands for; one that leads back to itself is not regular."""
    if id(p) in _open or not p.args[0]:
        raise NotRegular("recursive")
    _open.add(id(p))
    try:
        return f(p.args[0][0])
    finally:
        _open.discard(id(p))


def pattern(p: P) -> P:
    """The grammar that matches what this one does, for the functions of this module."""
    k, a = p.kind, p.args
    if k == "ref":
        return _once(p, pattern)
    if k == "recover":
        return P("or", (pattern(a[0]), pattern(a[1])))
    if k == "offset":
        return P("succeed", (None,))
    if k in ("memo", "named", "expect"):
        return pattern(a[0])
    if k == "dispatch":
        if any(len(c) != 1 for chars, _ in a[0] for c in chars):
            raise NotRegular(k)
        from ..charclass import CharClass

        cases = [P("right", (P("look", (P("char", (CharClass("", None, chars),)),)), pattern(q))) for chars, q in a[0]]
        others = P("not", (P("char", (CharClass("", None, "".join(chars for chars, _ in a[0])),)),))
        return P("or", (*cases, *[P("right", (others, pattern(q))) for q in a[1:] if q is not None]))
    if k == "pratt":
        return pattern(chains(p))
    if k == "rule":
        return pattern(unrolled(p))
    return P(k, tuple(pattern(q) if isinstance(q, P) else q for q in a))


def chains(p: P) -> P:
    """A table of left-associative binary operators as chains, one inside the other."""
    atom, ops = p.args
    if any(o.kind != "left" or o.parser.kind not in ("char", "string") for o in ops):
        raise NotRegular("pratt")
    spellings = [o.parser.args[0].chars if o.parser.kind == "char" else o.parser.args[0] for o in ops]
    if any(x != y and y.startswith(x) for x in spellings for y in spellings):
        raise NotRegular("pratt")
    out = atom
    for power in sorted({o.power for o in ops}, reverse=True):
        own = [o.parser.as_(o.apply) for o in ops if o.power == power]
        out = out.chain_left1(own[0] if len(own) == 1 else P("or", tuple(own)))
    # Behind an operator without an operand the whole expression fails.
    return P("left", (out, P("not", (P("or", tuple(o.parser for o in ops)),))))


def unrolled(p: P) -> P:
    """Direct left recursion A -> A op B | ... | B, each result a function of both sides, as a chain of B."""
    body, last, steps = p.args[0], None, []
    parts = body.args if body.kind == "or" else (body,)
    for q in parts:
        if q.kind == "map" and isinstance(q.args[1], OnPair) and q.args[0].kind == "zip" and q.args[0].args[0].kind == "left" and _names(q.args[0].args[0].args[0], p):
            (_, op), right = q.args[0].args[0].args, q.args[0].args[1]
            steps.append((op.as_(q.args[1].f), right))
        elif last is None and q is parts[-1]:
            last = q
    if last is None or not steps or any(r is not last for _, r in steps) or len(steps) != len(parts) - 1 or not all(_literal(o) for o, _ in steps):
        raise NotRegular("rule")
    return last.chain_left1(steps[0][0] if len(steps) == 1 else P("or", tuple(o for o, _ in steps)))


def _names(q: P, p: P) -> bool:
    return q.kind == "ref" and bool(q.args[0]) and q.args[0][0] is p


def _items(rest: Column, p: P) -> Column:
    return F.regexp_extract_all(rest, F.lit(rf"\G({lower(pattern(p))})"), F.lit(1))


def _applied(op: P, left: Column, right: Column, sign: Column) -> Column:
    """One step of a fold; ``op`` gives one of the known functions, by its spelling."""
    cases = op.args if op.kind == "or" else (op,)
    out = None
    for q in cases:
        f = q.args[1].value if q.kind == "map" and isinstance(q.args[1], Constant) else None
        if f not in ARITHMETIC or q.args[0].kind not in ("char", "string"):
            raise NotRegular("fold")
        word = q.args[0].args[0].chars if q.args[0].kind == "char" else q.args[0].args[0]
        got = ARITHMETIC[f](left, right)
        out = F.when(sign == word, got) if out is None else out.when(sign == word, got)
    return out


def _fold(p: P, left: bool) -> Value:
    """(first & (op & item).many()) folded over known functions."""
    if p.kind != "zip" or p.args[1].kind != "many" or p.args[1].args[0].kind != "zip":
        raise NotRegular("fold")
    first, (op, item) = p.args[0], p.args[1].args[0].args
    if not (_whole(pattern(item)) and _whole(pattern(first))):
        raise NotRegular("fold")
    one, each, zero = value(first), value(item), F.lit(0)

    def run(rest: Column, at: Column) -> Column:
        more, _ = _after(rest, at, pattern(first))
        steps = F.transform(_items(more, P("zip", (op, item))), lambda x: F.struct(_match(x, op).alias("s"), each(_after(x, zero, op)[0], zero).cast("bigint").alias("v")))
        begin = one(rest, at).cast("bigint")
        if left:
            return F.aggregate(steps, begin, lambda acc, x: _applied(op, acc, x["v"], x["s"]))
        # From the right: a step holds the sign before its value, which waits for the value on its left. The steps are worked out once.
        none = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("bigint").alias("v"))
        joined = lambda x, acc: F.when(acc["s"].isNull(), x).otherwise(_applied(op, x, acc["v"], acc["s"]))
        return F.aggregate(F.reverse(steps), none, lambda acc, x: F.struct(x["s"].alias("s"), joined(x["v"], acc).alias("v")), lambda acc: joined(begin, acc))

    return run


def _number(text: Column, kind: str) -> Column:
    """Other digits than ASCII ones are only looked for where a cast fails."""
    return F.coalesce(text.try_cast(kind), F.translate(text, _DIGITS, _ASCII).try_cast(kind))


def _mapped(inner: P, f: Callable) -> Value:
    if isinstance(f, Composed):
        return _mapped(P("map", (inner, f.first)), f.second)
    if f is fold_left or f is fold_right:
        return _fold(inner, f is fold_left)
    if isinstance(f, Constant):
        return lambda rest, at: F.lit(f.value)
    if f is cons:
        a, b = (value(q) for q in inner.args)
        return lambda rest, at: F.concat(F.array(a(rest, at)), b(*_after(rest, at, pattern(inner.args[0]))))
    own = value(inner)
    table = getattr(f, "__self__", None)
    if isinstance(table, dict) and getattr(f, "__name__", "") == "__getitem__" and table:
        keys = [F.lit(x) for kv in table.items() for x in kv]
        return lambda rest, at: F.element_at(F.create_map(*keys), own(rest, at))
    if f is int:
        return lambda rest, at: _number(own(rest, at), "bigint")
    if f is float:
        return lambda rest, at: _number(own(rest, at), "double")
    if f is len and inner.kind in ("many", "map"):
        return lambda rest, at: F.size(own(rest, at))
    if f is len:
        return lambda rest, at: F.length(own(rest, at))
    if f is list:
        return own
    if f is sum:
        return lambda rest, at: F.aggregate(own(rest, at), F.lit(0).cast("bigint"), lambda x, y: F.try_add(x, y))
    raise NotRegular("a function that is not known")


def value(p: P) -> Value:
    """The value of a grammar that matches."""
    k, a = p.kind, p.args
    if k in ("char", "string", "string_in", "regex", "capture"):
        return lambda rest, at: _match(rest, p)
    if k in ("skip", "eof", "not"):
        return lambda rest, at: F.lit(None)
    if k == "succeed":
        return lambda rest, at: F.lit(list(a[0]) if isinstance(a[0], tuple) else a[0]) if a[0] != () else F.array().cast("array<bigint>")
    if k == "offset":
        return lambda rest, at: at
    if k == "ref":
        return _once(p, value)
    if k in ("memo", "named", "expect", "look"):
        return value(a[0])
    if k == "map":
        return _mapped(*a)
    if k in ("left", "right"):
        if k == "left":
            return value(a[0])
        second, first = value(a[1]), pattern(a[0])
        return lambda rest, at: second(*_after(rest, at, first))
    if k in ("zip", "seq"):
        runs, before = [value(q) for q in a], [pattern(q) for q in a]

        def both(rest: Column, at: Column) -> Column:
            out = []
            for i, (run, q) in enumerate(zip(runs, before, strict=True)):
                out.append(run(rest, at).alias(f"_{i + 1}"))
                rest, at = _after(rest, at, q)
            return F.struct(*out)

        return both
    if k == "many":
        if not _whole(pattern(a[0])):
            raise NotRegular("items that depend on what follows")
        each = value(a[0])
        if a[2] is not None:
            return lambda rest, at: F.transform(F.slice(_items(rest, a[0]), 1, a[2]), lambda x: each(x, F.lit(0)))
        return lambda rest, at: F.transform(_items(rest, a[0]), lambda x: each(x, F.lit(0)))
    if k == "optional":
        own = value(a[0])
        return lambda rest, at: F.when(rest.rlike(rf"\A{lower(pattern(a[0]))}"), own(rest, at))
    if k in ("or", "recover"):
        cases = [(lower(pattern(q)), value(q)) for q in a]
        return lambda rest, at: reduce(lambda out, c: out.when(rest.rlike(rf"\A{c[0]}"), c[1](rest, at)), cases[1:], F.when(rest.rlike(rf"\A{cases[0][0]}"), cases[0][1](rest, at)))
    if k == "dispatch":
        runs, other = [(chars, value(q)) for chars, q in a[0]], value(a[1]) if a[1] else None

        def routed(rest: Column, at: Column) -> Column:
            first, out = F.substring(rest, 1, 1), F
            for chars, run in runs:
                out = out.when(first.isin(list(chars)), run(rest, at))
            return out.otherwise(other(rest, at)) if other else out

        return routed
    if k == "pratt":
        return value(chains(p))
    if k == "rule":
        return value(unrolled(p))
    raise NotRegular(k)


def lowered(p: P) -> tuple[str, Value] | None:
    """The regular expression of a grammar and its value, or None if either needs the interpreter."""
    try:
        return lower(pattern(p)), value(p)
    except NotRegular:
        return None
