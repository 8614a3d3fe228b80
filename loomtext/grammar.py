"""Grammars as immutable values, and the combinators that build them.

A grammar is a tree of ``P`` nodes; nothing is run while it is built.  ``Ref`` makes recursion possible by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .charclass import CharClass


@dataclass(frozen=True)
class Constant:
    """A function that gives one value, whatever it is given."""

    value: Any

    def __call__(self, _: Any) -> Any:
        return self.value


@dataclass(frozen=True)
class Composed:
    """One function, then another."""

    first: Callable
    second: Callable

    def __call__(self, x: Any) -> Any:
        return self.second(self.first(x))


@dataclass(frozen=True)
class OnPair:
    """A function of two arguments on a pair."""

    f: Callable[[Any, Any], Any]

    def __call__(self, x: tuple) -> Any:
        return self.f(x[0], x[1])


def cons(x: tuple) -> list:
    """The first of a pair before the list that is the second."""
    return [x[0], *x[1]]


@dataclass(frozen=True, eq=False)
class P:
    """One node: what it does and its parts."""

    kind: str
    args: tuple = ()

    def __or__(self, other: P) -> P:
        return choice(self, other)

    def __and__(self, other: P) -> P:
        return P("zip", (self, other))

    def __rshift__(self, other: P) -> P:
        return P("right", (self, other))

    def __lshift__(self, other: P) -> P:
        return P("left", (self, other))

    def map(self, f: Callable) -> P:
        if self.kind == "map":
            inner, g = self.args
            return P("map", (inner, Composed(g, f)))
        return P("map", (self, f))

    def as_(self, value: Any) -> P:
        return self.map(Constant(value))

    def void(self) -> P:
        return P("skip", (self,))

    def flat_map(self, f: Callable[[Any], P]) -> P:
        return P("flat_map", (self, f))

    def capture(self) -> P:
        return P("capture", (self,))

    def optional(self) -> P:
        return P("optional", (self,))

    def many(self) -> P:
        return P("many", (self, 0, None))

    def many1(self) -> P:
        return P("many", (self, 1, None))

    def at_least(self, n: int) -> P:
        return P("many", (self, n, None))

    def count(self, n: int) -> P:
        return P("many", (self, max(n, 0), max(n, 0)))

    def skip_many(self) -> P:
        return P("skip", (self.many(),))

    def skip_many1(self) -> P:
        return P("skip", (self.many1(),))

    def sep_by1(self, sep: P) -> P:
        return (self & (sep >> self).many()).map(cons)

    def sep_by(self, sep: P) -> P:
        return self.sep_by1(sep) | succeed(()).map(list)

    def end_by(self, sep: P) -> P:
        return (self << sep).many()

    def between(self, before: P, after: P) -> P:
        return (before >> self) << after

    def surrounded_by(self, around: P) -> P:
        return self.between(around, around)

    def look_ahead(self) -> P:
        return P("look", (self,))

    def not_followed_by(self) -> P:
        return P("not", (self,))

    def lexeme(self) -> P:
        return self << spaces

    def named(self, name: str) -> P:
        return P("named", (self, name))

    def expect(self, message: str) -> P:
        return P("expect", (self, message))

    def or_else(self, other: P) -> P:
        return choice(self, other)

    def recover(self, fallback: P) -> P:
        """The fallback's value with this parser's errors: a partial result."""
        return P("recover", (self, fallback))

    def recover_value(self, f: Callable) -> P:
        return P("recover_with", (self, lambda error: succeed(f(error))))

    def recover_with(self, f: Callable[[Any], P]) -> P:
        return P("recover_with", (self, f))

    def attempt(self) -> P:
        return P("attempt", (self,))

    def expect_token(self, kind: str) -> P:
        """A missing-token node of no width where this parser fails."""
        return P("recover_with", (self, lambda _: P("missing", (kind,))))

    def sync_until(self, chars: str) -> P:
        """Where this parser fails, skip to one of ``chars`` and wrap what was skipped."""
        return P("sync", (self, chars))

    def trace(self, label: str) -> P:
        """Notes each attempt in the result's trace: label, start, end (None where it fails)."""
        return P("trace", (self, label, False))

    def debug(self, label: str) -> P:
        """Like trace, with the value."""
        return P("trace", (self, label, True))

    def memoize(self) -> P:
        return P("memo", (self,))

    def rule(self, name: str = "rule") -> P:
        """Memoised, and left-recursive if it refers to itself."""
        return P("rule", (self, name))

    def chain_left1(self, op: P) -> P:
        return (self & (op & self).many()).map(fold_left)

    def chain_left(self, op: P, default: Any) -> P:
        return self.chain_left1(op) | succeed(default)

    def chain_right1(self, op: P) -> P:
        return (self & (op & self).many()).map(fold_right)

    def chain_right(self, op: P, default: Any) -> P:
        return self.chain_right1(op) | succeed(default)

    # Older names.
    times, many_non_empty, separated_by, separated_by_non_empty, ended_by, label = count, many1, sep_by, sep_by1, end_by, named
    chainl1, chainr1, skip_many_non_empty = chain_left1, chain_right1, skip_many1
    many_at_least, exactly, or_ = at_least, count, __or__


def fold_left(x: tuple) -> Any:
    out, rest = x
    for f, y in rest:
        out = f(out, y)
    return out


def fold_right(x: tuple) -> Any:
    first, rest = x
    if not rest:
        return first
    out = rest[-1][1]
    values = [first, *[y for _, y in rest]]
    for i in range(len(rest) - 1, -1, -1):
        out = rest[i][0](values[i], out)
    return out


class Ref(P):
    """A grammar given later, for recursion: ``r = Ref(); r.set(...)``."""

    def __init__(self) -> None:
        super().__init__("ref", ([],))

    def set(self, p: P) -> Ref:
        self.args[0][:] = [p]
        return self


def defer(f: Callable[[], P]) -> P:
    return P("defer", (f,))


def succeed(value: Any) -> P:
    return P("succeed", (value,))


def fail(message: str) -> P:
    return P("fail", (message,))


fail_with = fail
offset = P("offset")
eof = P("eof")


def satisfy(test: Callable[[str], bool] | CharClass, label: str = "character") -> P:
    return P("char", (test,)) if isinstance(test, CharClass) else P("test", (test, label))


def char(c: str) -> P:
    return P("char", (CharClass(f"'{c}'", None, c),))


def one_of(cs: str) -> P:
    return P("char", (CharClass(f"one of '{cs}'", None, cs),))


def none_of(cs: str) -> P:
    return P("char", (CharClass(f"none of '{cs}'", None, cs, True),))


any_char = P("char", (CharClass("any character", None, "", True),))
digit = P("char", (CharClass("digit", "javaDigit"),))
letter = P("char", (CharClass("letter", "javaLetter"),))
alpha_num = P("char", (CharClass("letter or digit", "javaLetterOrDigit"),))
whitespace = P("char", (CharClass("whitespace", "javaWhitespace"),))
spaces = whitespace.skip_many()
spaces1 = whitespace.skip_many1()


def string(s: str) -> P:
    return P("string", (s,)) if s else succeed("")


def symbol(s: str) -> P:
    return string(s).lexeme()


def string_in(*words: str) -> P:
    """The longest of the words."""
    words = tuple(sorted({w for w in words if w}, key=lambda w: (-len(w), w)))
    if not words:
        raise ValueError("string_in needs a word that is not empty")
    return P("string_in", (words,))


def keywords(values: dict[str, Any]) -> P:
    return string_in(*values).map(dict(values).__getitem__)


def choice(*ps: P) -> P:
    """Ordered choice; three or more plain strings match the longest."""
    if not ps:
        raise ValueError("choice needs an alternative")
    flat = [q for p in ps for q in (p.args if p.kind == "or" else (p,))]
    if len(flat) >= 3 and all(p.kind == "string" for p in flat):
        return string_in(*(p.args[0] for p in flat))
    return P("or", tuple(flat)) if len(flat) > 1 else flat[0]


def first_char_choice(*cases: tuple[str, P], fallback: P | None = None) -> P:
    """Dispatch on the next character: each case has the characters that it begins with."""
    seen: set[str] = set()
    if not cases:
        raise ValueError("first_char_choice needs a case")
    for chars, _ in cases:
        if not chars or seen & set(chars):
            raise ValueError("a case needs characters of its own")
        seen |= set(chars)
    return P("dispatch", (tuple(cases), fallback))


def regex(python: str, java: str, label: str) -> P:
    """A lexeme given by a pattern, with the same possessive meaning in both dialects."""
    return P("regex", (python, java, label))


def seq(*ps: P) -> P:
    """All values in a tuple."""
    return P("seq", ps)


@dataclass(frozen=True)
class Op:
    """An operator of a precedence table; ``kind``: left, right, prefix or postfix."""

    kind: str
    parser: P
    power: int
    apply: Callable


def pratt(atom: P, *ops: Op) -> P:
    return P("pratt", (atom, ops))


def _divide(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def c_family(atom: P) -> P:
    """The fixed precedence of C-like languages over integers; division truncates towards zero."""
    # Operators and their binding powers, the longer spelling before its prefix.
    table = [
        ("||", 10, lambda a, b: int(bool(a) or bool(b))),
        ("&&", 20, lambda a, b: int(bool(a) and bool(b))),
        ("==", 30, lambda a, b: int(a == b)),
        ("!=", 30, lambda a, b: int(a != b)),
        ("<=", 40, lambda a, b: int(a <= b)),
        (">=", 40, lambda a, b: int(a >= b)),
        ("<", 40, lambda a, b: int(a < b)),
        (">", 40, lambda a, b: int(a > b)),
        ("+", 50, lambda a, b: a + b),
        ("-", 50, lambda a, b: a - b),
        ("*", 60, lambda a, b: a * b),
        ("/", 60, _divide),
        ("%", 60, lambda a, b: a - b * _divide(a, b)),
    ]
    ops = [Op("left", symbol(s), p, f) for s, p, f in table]
    ops += [Op("prefix", symbol("-"), 70, lambda a: -a), Op("prefix", symbol("!") << string("=").not_followed_by(), 70, lambda a: int(not a))]
    return pratt(atom.lexeme(), *ops)


def token(kind: str, p: P) -> P:
    """A token node of a lossless tree."""
    return P("token", (kind, p))


def tree_of(kind: str, *ps: P) -> P:
    """A tree node over the nodes of its parts, lists flattened and nothings left out."""
    return P("tree", (kind, ps))
