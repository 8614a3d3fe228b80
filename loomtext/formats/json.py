"""JSON (RFC 8259): values with numbers as written, and lossless trees."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from ..grammar import P, Ref, char, eof, first_char_choice, regex, string, token, tree_of
from ..machine import Error, Node, Parser, Result


@dataclass(frozen=True)
class Number:
    value: float
    raw: str


# Fixed values of the format.
_WS = r"[ \t\n\r]*+"
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_STRING = r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_ONE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))")


def _lex(pattern: str, label: str) -> P:
    return regex(pattern, pattern, label)


ws = _lex(_WS, "whitespace")


def unescape(raw: str) -> str:
    body = raw[1:-1]
    if "\\" not in body:
        return body
    out = _ONE.sub(lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES[m[2]], body)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def grammar() -> P:
    value = Ref()
    text = _lex(_STRING, "string").map(unescape)
    number = _lex(_NUMBER, "number").map(lambda r: Number(float(r), r.replace("E", "e")))
    comma = char(",") << ws
    member = (text << ws << char(":") << ws) & value
    array = (value << ws).sep_by(comma).between(char("[") << ws, char("]"))
    obj = (member << ws).sep_by(comma).map(dict).between(char("{") << ws, char("}"))
    value.set(first_char_choice(("{", obj), ("[", array), ('"', text), ("t", string("true").as_(True)), ("f", string("false").as_(False)), ("n", string("null").as_(None)), ("-0123456789", number)))
    return (ws >> value << ws << eof)


def lossless() -> P:
    """Whitespace and punctuation are tokens; the source of the tree is the text."""
    value = Ref()
    space = token("Whitespace", _lex(r"[ \t\n\r]++", "whitespace")).optional()
    mark = lambda c, kind: token(kind, char(c))
    member = tree_of("Member", space, token("String", _lex(_STRING, "string")), space, mark(":", "Colon"), space, value, space)
    item = space & value & space

    def listed(one: P) -> P:
        return one & (mark(",", "Comma") & one).many()

    array = tree_of("Array", mark("[", "LeftBracket"), listed(item) | space, mark("]", "RightBracket"))
    obj = tree_of("Object", mark("{", "LeftBrace"), listed(member) | space, mark("}", "RightBrace"))
    scalars = (('"', token("String", _lex(_STRING, "string"))), ("-0123456789", token("Number", _lex(_NUMBER, "number"))), ("t", token("True", string("true"))), ("f", token("False", string("false"))), ("n", token("Null", string("null"))))
    value.set(first_char_choice(("{", obj), ("[", array), *scalars))
    return tree_of("Document", space, value, space) << eof


def parse_json(text: str) -> Result:
    return _SEMANTIC(text)


#: Whitespace, string, number, a mark, or true, false, null, by the number of their group.
_SCANNED = re.compile(rf"([ \t\n\r]++)|({_STRING})|({_NUMBER})|([{{}}\[\]:,])|(true)|(false)|(null)")
_LEAVES = (None, "Whitespace", "String", "Number", None, "True", "False", "Null")
_MARKS = {"{": "LeftBrace", "}": "RightBrace", "[": "LeftBracket", "]": "RightBracket", ":": "Colon", ",": "Comma"}


def scanned(text: str) -> Node | None:
    """The tree that ``lossless`` gives, in one pass over the tokens with a stack of open nodes; None for what is not JSON."""
    leaf, whole = Node.leaf, Node.with_width
    children: list = []
    # Open nodes above this one, and where each begins; what may come next: a value, a key, a colon, or what follows a value.
    above: list[tuple[str, list, int]] = []
    kind, begin, due, fresh, at = "Document", 0, "value", False, 0
    for m in iter(_SCANNED.scanner(text).match, None):
        group, own, start, at = m.lastindex, m[0], at, m.end()
        if group == 1:
            # Before a key it belongs to the member that begins here, unless the object is empty.
            if due == "key":
                due = "spaced key"
                space = own
            else:
                children.append(leaf("Whitespace", own))
        elif group != 4:
            if due == "value":
                children.append(leaf(_LEAVES[group], own))
                due, fresh = "end", False
            elif group == 2 and due in ("key", "spaced key"):
                above.append((kind, children, begin))
                kind, begin, children = "Member", start, [leaf("String", own)]
                if due == "spaced key":
                    begin -= len(space)
                    children.insert(0, leaf("Whitespace", space))
                due, fresh = "colon", False
            else:
                return None
        elif own in "{[":
            if due != "value":
                return None
            above.append((kind, children, begin))
            kind, due = ("Object", "key") if own == "{" else ("Array", "value")
            begin, children, fresh = start, [leaf(_MARKS[own], own)], True
        elif own == ":":
            if due != "colon":
                return None
            children.append(leaf("Colon", own))
            due = "value"
        elif own == ",":
            if due != "end" or kind == "Document":
                return None
            if kind == "Member":
                member = whole(kind, children, start - begin)
                kind, children, begin = above.pop()
                children.append(member)
            children.append(leaf("Comma", own))
            due = "key" if kind == "Object" else "value"
        else:
            # A list ends after a value, or where it has none at all.
            if own == "}":
                if kind == "Member" and due == "end":
                    member = whole(kind, children, start - begin)
                    kind, children, begin = above.pop()
                    children.append(member)
                elif not (kind == "Object" and fresh):
                    return None
                if due == "spaced key":
                    children.append(leaf("Whitespace", space))
            elif not (kind == "Array" and (due == "end" or fresh)):
                return None
            children.append(leaf(_MARKS[own], own))
            done = whole(kind, children, at - begin)
            kind, children, begin = above.pop()
            children.append(done)
            due, fresh = "end", False
    return whole(kind, children, at) if at == len(text) and kind == "Document" and due == "end" else None


def parse_lossless(text: str) -> Result:
    """A text that is JSON is scanned, which is several times faster; the grammar tells what is wrong with others."""
    tree = scanned(text)
    return _LOSSLESS(text) if tree is None else Result("success", tree, (), len(text), len(text))


def parse_as(text: str, f: Callable[[Any], Any]) -> Result:
    """What ``f`` makes of the value; a value that it rejects by None or an error is a failure."""
    r = parse_json(text)
    if r.status == "failure":
        return r
    try:
        got = f(r.value)
    except (TypeError, KeyError, ValueError, AttributeError, IndexError):
        got = None
    return r if got is None and r.value is None else Result("failure", None, (Error("Custom", None, (), "Type mismatch", r.consumed),), 0, r.consumed) if got is None else Result(r.status, got, r.errors, r.consumed, r.furthest)


def validate(tree: Node) -> list[Error]:
    """Missing and unexpected nodes of a tree, in document order, with their offsets."""
    out, at, stack = [], 0, [tree]
    while stack:
        n = stack.pop()
        if n.cls == "missing":
            out.append(Error("EndOfInput", None, (n.kind,), None, at))
        elif n.cls == "unexpected":
            out.append(Error("Custom", None, (), f"Unexpected input: '{n.source()}'", at))
        at += len(n.text)
        stack += reversed(n.children or [])
    return out


def plain(v: Any) -> Any:
    """The value with numbers as Python numbers."""
    if isinstance(v, Number):
        return int(v.raw) if re.fullmatch(r"-?[0-9]+", v.raw) else v.value
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, list) else v


_SEMANTIC, _LOSSLESS = Parser(grammar()), Parser(lossless())
