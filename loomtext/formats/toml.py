"""TOML: typed values in tables, arrays of tables, duplicates rejected."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..grammar import P, Ref, char, choice, eof, regex, string, succeed
from ..machine import Error, Parser, Result


@dataclass
class Table:
    is_array: bool = False
    pairs: dict[str, Any] = field(default_factory=dict)
    subtables: dict[str, list[Table]] = field(default_factory=dict)
    defined: bool = False


# Fixed values of the format.
_DATE, _TIME = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]++)?+"
_FLOAT = r"[+-]?+(?:inf|nan|(?:0|[1-9](?:_?[0-9])*+)(?:\.[0-9](?:_?[0-9])*+(?:[eE][+-]?+[0-9]++)?+|[eE][+-]?+[0-9]++))"
_INT = r"0x[0-9a-fA-F](?:_?[0-9a-fA-F])*+|0o[0-7](?:_?[0-7])*+|0b[01](?:_?[01])*+|[+-]?+(?:0|[1-9](?:_?[0-9])*+)"
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|\r?\n\s*|(.))")
_NAMED = {"b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", '"': '"', "\\": "\\"}


def _lex(p: str, label: str) -> P:
    return regex(p, p, label)


def _unescape(body: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _NAMED.get(m[3], "") if m[3] else "", body)


def _time(raw: str) -> dt.time:
    clock, _, fraction = raw.partition(".")
    return dt.time.fromisoformat(clock).replace(microsecond=int((fraction + "000000")[:6]))


def _stamp(raw: str) -> Any:
    """A date, a time or both. Raises ValueError for one that no calendar or clock has."""
    if re.fullmatch(_DATE, raw):
        return dt.date.fromisoformat(raw)
    if re.fullmatch(_TIME, raw):
        return _time(raw)
    day, rest = dt.date.fromisoformat(raw[:10]), raw[11:]
    m = re.fullmatch(rf"({_TIME})(Z|z|[+-][0-9]{{2}}:[0-9]{{2}})?", rest)
    zone = None if not m[2] else dt.UTC if m[2] in "Zz" else dt.datetime.strptime(m[2], "%z").tzinfo
    return dt.datetime.combine(day, _time(m[1]), zone)


def _int(raw: str) -> int:
    """A 64-bit integer. Raises ValueError for a larger one."""
    v = int(raw.replace("_", ""), 0 if raw[:2] in ("0x", "0o", "0b") else 10)
    if not -(2**63) <= v < 2**63:
        raise ValueError
    return v


def _checked(p: P, f: Callable[[str], Any], what: str) -> P:
    """What ``f`` makes of a lexeme; where it cannot, a failure at the lexeme's start."""

    def step(x: tuple[int, str]) -> P:
        try:
            return succeed(f(x[1]))
        except ValueError:
            return P("fail_at", (f"{what}: {x[1]}", x[0]))

    return (P("offset") & p).flat_map(step)


blank = _lex(r"[ \t]*+", "blank")
gap = _lex(r"(?:[ \t\r\n]++|#[^\n]*+)*+", "blank")


def _strings() -> P:
    esc = r'\\(?:["\\bfnrt]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})'
    multi = _lex(r'"""(?:[^"\\]++|\\(?:.|\r?\n)|"(?!""))*+"""', "string").map(lambda r: _unescape(re.sub(r"\A\r?\n", "", r[3:-3])))
    multi_literal = _lex(r"'''(?:[^']++|'(?!''))*+'''", "string").map(lambda r: re.sub(r"\A\r?\n", "", r[3:-3]))
    basic = _lex(rf'"(?:[^"\\\n\r]++|{esc})*+"', "string").map(lambda r: _unescape(r[1:-1]))
    return choice(multi, multi_literal, basic, _lex(r"'[^'\n\r]*+'", "string").map(lambda r: r[1:-1]))


def grammar() -> P:
    value = Ref()
    text = _strings()
    word = r"(?![0-9A-Za-z_.:+-])"
    stamp = _lex(rf"(?:{_DATE}(?:[Tt ]{_TIME}(?:Z|z|[+-][0-9]{{2}}:[0-9]{{2}})?+)?+|{_TIME}){word}", "date")
    stamp = _checked(stamp, _stamp, "invalid date or time")
    number = _lex(rf"(?:{_FLOAT}){word}", "float").map(lambda r: float(r.replace("_", ""))) | _checked(_lex(rf"(?:{_INT}){word}", "integer"), _int, "integer out of range")
    flag = _lex(rf"(?:true|false){word}", "boolean").map("true".__eq__)
    key = (_lex("[A-Za-z0-9_-]++", "key") | _lex(r'"(?:[^"\\\n\r]++|\\.)*+"', "key").map(lambda r: _unescape(r[1:-1])) | _lex(r"'[^'\n\r]*+'", "key").map(lambda r: r[1:-1]))
    path = (blank >> key << blank).sep_by1(char("."))
    items = (gap >> value << gap)
    array = ((items & (char(",") >> items).many()).map(lambda x: [x[0], *x[1]]) << char(",").optional() << gap | gap.as_(())).map(list).between(char("["), char("]"))
    pair = path & (char("=") >> blank >> value)
    inline = (pair << blank).sep_by(char(",")).map(lambda ps: {".".join(k): v for k, v in ps}).between(char("{") << blank, blank >> char("}"))
    value.set(choice(text, stamp, number, flag, array, inline))
    end = blank >> _lex(r"#[^\n\r]*+", "comment").optional() >> (_lex(r"\r\n|\n", "newline") | eof)
    at = P("offset")
    line = choice(
        (at & (string("[[") >> path << string("]]"))).map(lambda x: ("array", *x)),
        (at & (char("[") >> path << char("]"))).map(lambda x: ("table", *x)),
        (at & pair).map(lambda x: ("pair", *x)),
    )
    skip = _lex(r"(?:[ \t\r\n]++|#[^\n]*+)*+", "blank")
    return (skip >> (blank >> line << end << skip).many()) << eof


def build(lines: list[tuple]) -> tuple[Table | None, str, int]:
    """The root table, or a message and its offset."""
    root = Table()
    here = root
    for kind, at, body in lines:
        if kind == "pair":
            name = ".".join(body[0])
            if name in here.pairs or name in here.subtables:
                return None, f"duplicate key: {name}", at
            here.pairs[name] = body[1]
            continue
        t = root
        for part in body[:-1]:
            t = t.subtables.setdefault(part, [Table()])[-1]
        name, found = body[-1], None
        found = t.subtables.get(name)
        shown = f"[[{'.'.join(body)}]]" if kind == "array" else f"[{'.'.join(body)}]"
        if name in t.pairs or (found and (found[-1].is_array != (kind == "array") or (kind == "table" and found[-1].defined))):
            return None, f"duplicate table definition: {shown}", at
        if kind == "array":
            here = Table(True, defined=True)
            t.subtables.setdefault(name, []).append(here)
        else:
            here = found[-1] if found else t.subtables.setdefault(name, [Table()])[-1]
            here.defined = True
    return root, "", 0


def parse_toml(text: str) -> Result:
    r = _TOML(text)
    if r.status == "failure":
        return r
    root, message, at = build(r.value)
    if root is None:
        return Result("failure", None, (Error("Custom", None, (), message, at),), 0, at)
    return Result(r.status, root, r.errors, r.consumed, r.furthest)


def rows(root: Table) -> list[tuple[list[str], list[int], str, str, str]]:
    """(table path, index in each array of tables, key, type, value as text) for each pair."""
    out, stack = [], [([], [], root)]
    while stack:
        path, index, t = stack.pop()
        for k, v in t.pairs.items():
            out.append((path, index, k, type(v).__name__, v.isoformat() if hasattr(v, "isoformat") else str(v).lower() if isinstance(v, bool) else str(v)))
        for name, many in t.subtables.items():
            for i, sub in enumerate(many):
                stack.append(([*path, name], [*index, i], sub))
    return out


_TOML = Parser(grammar())
