"""A subset of YAML: scalars, flow collections, block sequences and mappings, also nested by indentation."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from ..grammar import P, Ref, char, choice, eof, regex
from ..machine import Parser, Result

# Fixed values of the subset.
_NULL, _TRUE, _FALSE = {"null", "~", ""}, {"true", "yes", "on"}, {"false", "no", "off"}


def scalar(raw: str) -> Any:
    raw = raw.strip()
    if raw in _NULL:
        return None
    if raw in _TRUE or raw in _FALSE:
        return raw in _TRUE
    if re.fullmatch(r"[+-]?[0-9]+", raw):
        return int(raw)
    if re.fullmatch(r"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?", raw):
        return float(raw)
    return raw


def _each_once(f: Callable[[int], P]) -> Callable[[int], P]:
    made: dict[int, P] = {}

    def get(n: int) -> P:
        if n not in made:
            made[n] = f(n)
        return made[n]

    return get


def _lex(p: str, label: str) -> P:
    return regex(p, p, label)


_ESC = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "0": "\0"}
_double = _lex(r'"(?:[^"\\]++|\\.)*+"', "string").map(lambda r: re.sub(r"\\(.)", lambda m: _ESC.get(m[1], m[1]), r[1:-1]))
_single = _lex(r"'(?:[^']++|'')*+'", "string").map(lambda r: r[1:-1].replace("''", "'"))
_gap = _lex(r"(?:[ \t\r\n]++|(?<=[ \t\r\n])#[^\n]*+)*+", "blank")
_end = _lex(r"[ \t]*+(?:(?<=[ \t])#[^\n]*+)?+", "blank")


def flow() -> P:
    value = Ref()
    plain = _lex(r"(?:[^,\[\]{}:#\r\n\"']|:(?![ \t\r\n,\]}])|(?<![ \t])#)(?:[^,\[\]{}:#\r\n]|:(?![ \t\r\n,\]}])|(?<![ \t])#)*+", "scalar").map(scalar)
    key = _double | _single | _lex(r"[^,\[\]{}:#\r\n\"']++", "key").map(str.strip)
    pair = (key << _gap << char(":") << _gap) & (value | _gap.as_(None))
    seq = (value << _gap).sep_by(char(",") << _gap).between(char("[") << _gap, char("]"))
    mapping = (pair << _gap).sep_by(char(",") << _gap).map(dict).between(char("{") << _gap, char("}"))
    value.set(choice(seq, mapping, _double, _single, plain))
    return value


def document() -> P:
    f = flow()
    line_plain = _lex(r"(?![-?][ \t])(?:[^\s#\[{\"'&*!|>%@`](?:[^\r\n#:]|:(?!\s)|(?<![ \t])#)*+)(?!:)", "scalar").map(scalar)
    inline = choice(_lex(r"(?=[\[{\"'])", "flow") >> f, line_plain) << _end
    key = (_double | _single | _lex(r"(?:[^\s:#\[\]{},\"'-]|-(?! )|:(?!\s))(?:[^:\r\n#]|:(?!\s))*+", "key").map(str.strip)) << _lex(r"[ \t]*+:(?=\s|\Z)", "':'")
    blank_lines = r"(?:[ \t]*+(?:#[^\n]*+)?+(?:\r\n|\n))*+"

    # Each depth has its grammar once, so that it is compiled once.
    @_each_once
    def block(least: int) -> P:
        return _lex(rf"{blank_lines}(?= {{{least},}})", "block") >> _lex(r" *+", "indent").flat_map(lambda s: at(len(s)) if len(s) >= least else P("fail", ("less indented",)))

    @_each_once
    def at(n: int) -> P:
        follow = _lex(rf"(?:\r\n|\n){blank_lines} {{{n}}}(?! )", "line") if n else _lex(rf"(?:\r\n|\n){blank_lines}(?![ \t\r\n]|---|\.\.\.|\Z)", "line")
        nested = _end >> _lex(r"\r\n|\n", "newline") >> P("defer", (lambda: block(n + 1),))
        same = _end >> _lex(r"\r\n|\n", "newline") >> _lex(rf"{blank_lines} {{{n}}}(?=- )", "block") >> P("defer", (lambda: sequence(n),))
        item = _lex(r"-(?=\s|\Z)", "'-'") >> choice(_lex(r" ++", "blank").capture().flat_map(lambda s: compact(n + 1 + len(s))), nested, _end.as_(None))
        pair = key & choice(_lex(r"[ \t]++(?![#\r\n])", "blank") >> inline, nested, same, _end.as_(None))
        return choice(item.sep_by1(follow), pair.sep_by1(follow).map(dict), inline)

    @_each_once
    def sequence(n: int) -> P:
        follow = _lex(rf"(?:\r\n|\n){blank_lines} {{{n}}}(?=- )", "line")
        return (_lex(r"- *+", "'-'") >> inline).sep_by1(follow)

    @_each_once
    def compact(n: int) -> P:
        """What stands after a dash: a value, or a mapping whose next keys are as far right."""
        return P("defer", (lambda: at(n),))

    top = _lex(rf"{blank_lines}(?:---[ \t]*+(?:\r\n|\n)?+)?+", "start") >> (P("defer", (lambda: block(0),)) | _gap.as_(None))
    return (top << _end << _gap << _lex(r"(?:\.\.\.\s*+)?+", "end") << eof)


def parse_yaml(text: str) -> Result:
    return _YAML(text)


_YAML = Parser(document())
