"""The interpreter: a grammar compiled to closures, run on one text.

Compiled parsers call each other as plain Python functions, which take heap and no C stack, so that nesting is
bounded by memory.  A parser returns ``(position, value)``, or None with the furthest errors noted in the state.
Regular parts run as one compiled pattern.  Offsets are code points; lines and columns are derived at the end.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, NamedTuple

from .grammar import P
from .lower import NotRegular, lower

MOST_FRAMES = 10_000_000
#: Compiled grammars that a part keeps of those that it makes while it runs.
MOST_MADE = 64


class Error(NamedTuple):
    """kind: Unexpected, EndOfInput or Custom."""

    kind: str
    found: str | None
    expected: tuple[str, ...]
    message: str | None
    offset: int


@dataclass(frozen=True)
class Result:
    status: str
    value: Any
    errors: tuple[Error, ...]
    consumed: int
    furthest: int
    trace: tuple[tuple, ...] = ()

    @property
    def is_success(self) -> bool:
        return self.status == "success"

    def to_option(self) -> Any:
        return None if self.status == "failure" else self.value


@dataclass(init=False)
class Node:
    """A node of a lossless tree: token, tree, missing or unexpected."""

    cls: str
    kind: str
    text: str
    children: list | None

    def __init__(self, cls: str, kind: str, text: str = "", children: list | None = None) -> None:
        self.cls, self.kind, self.text, self.children = cls, kind, text, children
        self.width = len(text) + sum([c.width for c in children]) if children else len(text)

    @classmethod
    def with_width(cls, kind: str, children: list, width: int) -> Node:
        """A tree whose width is known; it is not summed again."""
        node = cls.__new__(cls)
        node.cls, node.kind, node.text, node.children, node.width = "tree", kind, "", children, width
        return node

    @classmethod
    def leaf(cls, kind: str, text: str) -> Node:
        """A token."""
        node = cls.__new__(cls)
        node.cls, node.kind, node.text, node.children, node.width = "token", kind, text, None, len(text)
        return node

    def source(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append(n.text)
            stack += reversed(n.children or [])
        return "".join(out)


def _token(kind: str) -> Callable[[str], Node]:
    return lambda text: Node("token", kind, text)


def _tree(kind: str) -> Callable[..., Node]:
    return lambda *children: Node("tree", kind, "", list(children))


identifier_node, number_node, keyword_node = _token("Identifier"), _token("Number"), _token("Keyword")
expression_node, statement_node = _tree("Expression"), _tree("Statement")


class ErrorsNeeded(Exception):
    """A part asks for the errors of another one, which a quiet run does not note."""


class State:
    """``quiet``: errors are not noted, as if all lay behind one that is further than any text."""

    def __init__(self, text: str, quiet: bool = False):
        self.text, self.n = text, len(text)
        self.least = sys.maxsize if quiet else -1
        self.far, self.errors, self.partial = self.least, [], []
        self.memo: dict = {}
        self.heads: dict = {}
        self.stack: list = []
        self.trace: list = []

    def note(self, e: Error) -> None:
        if e.offset > self.far:
            self.far, self.errors = e.offset, [e]
        elif e.offset == self.far:
            self.errors.append(e)

    def wrong(self, i: int, expected: str, length: int = 1) -> None:
        if i < self.far:
            return
        if i >= self.n:
            self.note(Error("EndOfInput", None, (expected,), None, i))
        else:
            self.note(Error("Unexpected", self.text[i : i + length], (expected,), None, i))


Run = Callable[[State, int], "tuple[int, Any] | None"]


class Compiler:
    """Parsers by the node that they came from; ``outer`` has those of the grammar that made this part while it ran."""

    def __init__(self, outer: Compiler | None = None) -> None:
        self.done: dict[int, Run] = {}
        self.keep: list[P] = []
        self.outer = outer

    def get(self, p: P) -> Run:
        up = self.outer
        while up is not None:
            if id(p) in up.done:
                return up.done[id(p)]
            up = up.outer
        if id(p) not in self.done:
            self.keep.append(p)
            # A parser met again while it is being compiled is recursive: it is looked up when run.
            later: list[Run] = []
            self.done[id(p)] = lambda s, i: later[0](s, i)
            later.append(self.compiled(p))
            self.done[id(p)] = later[0]
        return self.done[id(p)]

    def compiled(self, p: P) -> Run:
        if p.kind in ("skip", "capture", "many", "string_in", "regex", "not", "look"):
            if (fast := self.as_pattern(p)) is not None:
                return fast
        return getattr(self, p.kind + "_")(*p.args)

    def as_pattern(self, p: P) -> Run | None:
        inner = p.args[0] if p.kind in ("skip", "capture") else p
        if p.kind in ("many", "look"):
            return None
        try:
            match = re.compile(lower(inner, java=False)).match
        except NotRegular:
            return None
        if p.kind in ("string_in", "regex", "not"):
            label = " or ".join(f'"{w}"' for w in p.args[0]) if p.kind == "string_in" else p.args[2] if p.kind == "regex" else "Unexpected success"
            width = max(map(len, p.args[0])) if p.kind == "string_in" else 1

            def leaf(s: State, i: int) -> Any:
                m = match(s.text, i)
                if m is None:
                    if p.kind == "not":
                        s.note(Error("Custom", None, (), label, i))
                    else:
                        s.wrong(i, label, width)
                    return None
                return m.end(), None if p.kind == "not" else m[0]

            return leaf
        slow = self.get(inner)
        keep = p.kind == "capture"

        def fast(s: State, i: int) -> Any:
            m = match(s.text, i)
            if m is not None:
                return m.end(), m[0] if keep else None
            slow(s, i)  # for its errors
            return None

        return fast

    def ref_(self, box: list) -> Run:
        return self.get(box[0]) if box else self._unset

    def _unset(self, s: State, i: int) -> Any:
        raise ValueError("a reference was never set")

    def defer_(self, f: Callable[[], P]) -> Run:
        held: list[Run] = []

        def run(s: State, i: int) -> Any:
            if not held:
                held.append(self.get(f()))
            return held[0](s, i)

        return run

    def succeed_(self, value: Any) -> Run:
        return lambda s, i: (i, value)

    def fail_(self, message: str) -> Run:
        return lambda s, i: s.note(Error("Custom", None, (), message, i))

    def fail_at_(self, message: str, at: int) -> Run:
        def failed(s: State, i: int) -> Any:
            s.far, s.errors = max(s.far, i), []  # a positioned failure outranks guesses at what could have followed
            s.note(Error("Custom", None, (), message, s.far))
            s.errors = [Error("Custom", None, (), message, at)]

        return failed

    def offset_(self) -> Run:
        return lambda s, i: (i, i)

    def eof_(self) -> Run:
        return lambda s, i: (i, None) if i >= s.n else s.note(Error("Custom", None, (), "Expected end of input", i))

    def char_(self, cls: Any) -> Run:
        match = re.compile(cls.python()).match

        def run(s: State, i: int) -> Any:
            if match(s.text, i):
                return i + 1, s.text[i]
            return s.wrong(i, cls.label)

        return run

    def test_(self, test: Callable, label: str) -> Run:
        return lambda s, i: (i + 1, s.text[i]) if i < s.n and test(s.text[i]) else s.wrong(i, label)

    def string_(self, word: str) -> Run:
        label, k = f'"{word}"', len(word)
        return lambda s, i: (i + k, word) if s.text.startswith(word, i) else s.wrong(i, label, k)

    def map_(self, p: P, f: Callable) -> Run:
        run = self.get(p)

        def mapped(s: State, i: int) -> Any:
            got = run(s, i)
            return None if got is None else (got[0], f(got[1]))

        return mapped

    def skip_(self, p: P) -> Run:
        run = self.get(p)

        def skipped(s: State, i: int) -> Any:
            got = run(s, i)
            return None if got is None else (got[0], None)

        return skipped

    def capture_(self, p: P) -> Run:
        run = self.get(p)

        def captured(s: State, i: int) -> Any:
            got = run(s, i)
            return None if got is None else (got[0], s.text[i : got[0]])

        return captured

    def flat_map_(self, p: P, f: Callable) -> Run:
        run = self.get(p)

        made: dict[int, tuple[P, Run]] = {}

        def chained(s: State, i: int) -> Any:
            got = run(s, i)
            if got is None:
                return None
            q = f(got[1])
            if q.kind == "succeed":
                return got[0], q.args[0]
            if q.kind in ("fail", "fail_at"):
                return Compiler(self).get(q)(s, got[0])
            # A grammar that is given again is compiled once; it is held, so that no other one has its identity.
            if id(q) not in made:
                if len(made) >= MOST_MADE:
                    made.clear()
                made[id(q)] = q, Compiler(self).get(q)
            return made[id(q)][1](s, got[0])

        return chained

    def _two(self, p: P, q: P, pick: Callable) -> Run:
        a, b = self.get(p), self.get(q)

        def both(s: State, i: int) -> Any:
            x = a(s, i)
            if x is None:
                return None
            y = b(s, x[0])
            return None if y is None else (y[0], pick(x[1], y[1]))

        return both

    def zip_(self, p: P, q: P) -> Run:
        return self._two(p, q, lambda x, y: (x, y))

    def left_(self, p: P, q: P) -> Run:
        return self._two(p, q, lambda x, y: x)

    def right_(self, p: P, q: P) -> Run:
        return self._two(p, q, lambda x, y: y)

    def seq_(self, *ps: P) -> Run:
        runs = [self.get(p) for p in ps]

        def all_(s: State, i: int) -> Any:
            out = []
            for run in runs:
                got = run(s, i)
                if got is None:
                    return None
                i = got[0]
                out.append(got[1])
            return i, tuple(out)

        return all_

    def or_(self, *ps: P) -> Run:
        runs = [self.get(p) for p in ps]

        def either(s: State, i: int) -> Any:
            kept = len(s.partial)
            for run in runs:
                got = run(s, i)
                if got is not None:
                    return got
                del s.partial[kept:]
            return None

        return either

    def dispatch_(self, cases: tuple, fallback: P | None) -> Run:
        table = {c: self.get(p) for chars, p in cases for c in chars}
        other = self.get(fallback) if fallback else None
        label = f'one of "{"".join(chars for chars, _ in cases)}"'

        def run(s: State, i: int) -> Any:
            own = table.get(s.text[i]) if i < s.n else None
            if own is not None:
                return own(s, i)
            return other(s, i) if other else s.wrong(i, label)

        return run

    def optional_(self, p: P) -> Run:
        run = self.get(p)
        if p.kind in ("regex", "string", "char") or (p.kind == "token" and p.args[1].kind in ("regex", "string", "char")):
            return lambda s, i: run(s, i) or (i, None)  # nothing in it recovers

        def maybe(s: State, i: int) -> Any:
            kept = len(s.partial)
            got = run(s, i)
            if got is None:
                del s.partial[kept:]
                return i, None
            return got

        return maybe

    def many_(self, p: P, least: int, most: int | None) -> Run:
        run = self.get(p)

        def repeat(s: State, i: int) -> Any:
            out: list = []
            while most is None or len(out) < most:
                kept = len(s.partial)
                got = run(s, i)
                if got is None:
                    del s.partial[kept:]
                    break
                if got[0] == i and len(out) >= least and most is None:
                    break  # no progress: it would go on for ever
                out.append(got[1])
                i = got[0]
            return (i, out) if len(out) >= least else None

        return repeat

    def look_(self, p: P) -> Run:
        run = self.get(p)

        def look(s: State, i: int) -> Any:
            got = run(s, i)
            return None if got is None else (i, got[1])

        return look

    def not_(self, p: P) -> Run:
        run = self.get(p)

        def absent(s: State, i: int) -> Any:
            held, kept = (s.far, s.errors), len(s.partial)
            s.far, s.errors = s.least, []
            got = run(s, i)
            partial = len(s.partial) > kept
            s.far, s.errors = held
            del s.partial[kept:]
            if got is None:
                return i, None
            return s.note(Error("Custom", None, (), "Unexpected partial success" if partial else "Unexpected success", i))

        return absent

    def _alone(self, run: Run, s: State, i: int) -> tuple:
        """The outcome, with the errors of this run alone."""
        if s.least >= 0:
            raise ErrorsNeeded
        held, kept = (s.far, s.errors), len(s.partial)
        s.far, s.errors = -1, []
        got = run(s, i)
        errors, partial = s.errors, s.partial[kept:]
        s.far, s.errors = held
        if got is None:
            del s.partial[kept:]
        return got, errors, partial

    def named_(self, p: P, name: str) -> Run:
        run = self.get(p)

        def named(s: State, i: int) -> Any:
            got, errors, _ = self._alone(run, s, i)
            if got is None:
                for e in errors:
                    s.note(Error(e.kind, e.found, (*e.expected, name), e.message, e.offset) if e.kind == "Unexpected" else e)
            return got

        return named

    def expect_(self, p: P, message: str) -> Run:
        run = self.get(p)

        def expect(s: State, i: int) -> Any:
            got, errors, _ = self._alone(run, s, i)
            if got is None:
                s.note(Error("Custom", None, (), message, max([i, *(e.offset for e in errors)])))
            return got

        return expect

    def recover_(self, p: P, fallback: P) -> Run:
        run, other = self.get(p), self.get(fallback)

        def recover(s: State, i: int) -> Any:
            got, errors, _ = self._alone(run, s, i)
            if got is None:
                got, more, _ = self._alone(other, s, i)
                if got is None:
                    for e in [*errors, *more]:
                        s.note(e)
                else:
                    s.partial.extend(errors)
            return got

        return recover

    def recover_with_(self, p: P, f: Callable) -> Run:
        run = self.get(p)

        def recover(s: State, i: int) -> Any:
            got, errors, _ = self._alone(run, s, i)
            if got is None:
                first = errors[0] if errors else Error("Custom", None, (), "failure", i)
                q = f(first)
                if q.kind == "missing":
                    s.partial.append(first)
                return Compiler(self).get(q)(s, i)
            return got

        return recover

    def missing_(self, kind: str) -> Run:
        return lambda s, i: (i, Node("missing", kind))

    def sync_(self, p: P, chars: str) -> Run:
        run, stop = self.get(p), set(chars)

        def sync(s: State, i: int) -> Any:
            got, errors, _ = self._alone(run, s, i)
            if got is not None:
                return got
            j = i
            while j < s.n and s.text[j] not in stop:
                j += 1
            if j >= s.n and j == i:
                for e in errors:
                    s.note(e)
                return None
            skipped = s.text[i:j]
            s.partial.extend([*errors, Error("Custom", None, (), f"Unexpected input: '{skipped}'", i)])
            return j, Node("unexpected", "Unexpected", "", [Node("token", "Skipped", skipped)] if skipped else [])

        return sync

    def attempt_(self, p: P) -> Run:
        run = self.get(p)

        def attempt(s: State, i: int) -> Any:
            kept = len(s.partial)
            got, errors, partial = self._alone(run, s, i)
            del s.partial[kept:]
            if got is None:
                return i, Result("failure", None, tuple(dict.fromkeys([*partial, *errors])), 0, max([i, *(e.offset for e in errors)]))
            return got[0], Result("partial" if partial else "success", got[1], tuple(partial), got[0] - i, got[0])

        return attempt

    def trace_(self, p: P, label: str, value: bool) -> Run:
        run = self.get(p)

        def traced(s: State, i: int) -> Any:
            got = run(s, i)
            s.trace.append((label, i, None if got is None else got[0], repr(got[1]) if value and got is not None else None))
            return got

        return traced

    def memo_(self, p: P) -> Run:
        run, key = self.get(p), object()

        def memo(s: State, i: int) -> Any:
            at = (key, i)
            if at not in s.memo:
                kept = len(s.partial)
                got = run(s, i)
                s.memo[at] = got, s.partial[kept:]
                return got
            got, partial = s.memo[at]
            s.partial.extend(partial)
            return got

        return memo

    def rule_(self, p: P, name: str) -> Run:
        """Left recursion by growing a seed: the rule first fails at its own position, then is run again on what
        it has found there as long as it gets further.  Rules that took part are evaluated anew each time."""
        run, key = self.get(p), object()

        def rule(s: State, i: int) -> Any:
            at = (key, i)
            if at in s.memo:
                seed = s.memo[at]
                if seed[1]:  # it is being evaluated: everything on the stack above it depends on the seed
                    seed[2][0] = True
                    k = len(s.stack) - 1
                    while s.stack[k] != at:
                        s.heads[s.stack[k]] = True
                        k -= 1
                return seed[0]
            used = [False]
            s.memo[at] = (None, True, used)
            s.stack.append(at)
            got = run(s, i)
            while used[0] and got is not None:
                s.memo[at] = (got, True, used)
                again = run(s, i)
                if again is None or again[0] <= got[0]:
                    break
                got = again
            s.stack.pop()
            if s.heads.pop(at, False):
                del s.memo[at]  # its result holds for one seed of an outer rule only
            else:
                s.memo[at] = (got, False, used)
            return got

        return rule

    def pratt_(self, atom: P, ops: tuple) -> Run:
        base = self.get(atom)
        prefix = [(self.get(o.parser), o) for o in ops if o.kind == "prefix"]
        after = [(self.get(o.parser), o) for o in ops if o.kind != "prefix"]

        def expression(s: State, i: int, least: int) -> Any:
            got = None
            for run, o in prefix:
                hit = run(s, i)
                if hit is not None:
                    inner = expression(s, hit[0], o.power)
                    if inner is None:
                        return None
                    got = inner[0], o.apply(inner[1])
                    break
            if got is None and (got := base(s, i)) is None:
                return None
            i, value = got
            while True:
                for run, o in after:
                    if o.power <= least:
                        continue
                    hit = run(s, i)
                    if hit is None:
                        continue
                    if o.kind == "postfix":
                        i, value = hit[0], o.apply(value)
                        break
                    right = expression(s, hit[0], o.power - (o.kind == "right"))
                    if right is None:
                        return None
                    i, value = right[0], o.apply(value, right[1])
                    break
                else:
                    return i, value

        return lambda s, i: expression(s, i, 0)

    def token_(self, kind: str, p: P) -> Run:
        run = self.get(p)
        if p.kind in ("regex", "string", "char"):
            match = re.compile(lower(p, java=False)).match

            def lexeme(s: State, i: int) -> Any:
                m = match(s.text, i)
                if m is None:
                    return run(s, i)  # for its errors
                return m.end(), Node("token", kind, m[0])

            return lexeme

        def tok(s: State, i: int) -> Any:
            got = run(s, i)
            return None if got is None else (got[0], Node("token", kind, s.text[i : got[0]]))

        return tok

    def tree_(self, kind: str, ps: tuple) -> Run:
        runs = [self.get(p) for p in ps]

        def tree(s: State, i: int) -> Any:
            children: list[Node] = []
            for run in runs:
                got = run(s, i)
                if got is None:
                    return None
                i, x = got
                if x is None:
                    continue
                if x.__class__ is Node:
                    children.append(x)
                    continue
                todo = [x]
                while todo:
                    x = todo.pop()
                    if isinstance(x, Node):
                        children.append(x)
                    elif isinstance(x, (list, tuple)):
                        todo += x[::-1]
            return i, Node("tree", kind, "", children)

        return tree


class Parser:
    """A compiled grammar; it travels as the grammar and is compiled where it arrives."""

    def __init__(self, p: P):
        self.grammar = p
        self.run = Compiler().get(p)
        # Most texts parse, and what parses has no errors: those are worked out in a second run, for texts that need them.
        self.loud, self.calls, self.again = False, 0, 0

    def __reduce__(self) -> tuple:
        return Parser, (self.grammar,)

    def __call__(self, text: str, start: int = 0) -> Result:
        """The result from ``start`` on; offsets are those of the whole text, ``consumed`` counts from there."""
        if sys.getrecursionlimit() < MOST_FRAMES:
            sys.setrecursionlimit(MOST_FRAMES)
        if not self.loud:
            s = State(text, True)
            self.calls += 1
            try:
                got = self.run(s, start)
            except ErrorsNeeded:
                self.loud, got = True, None
            if got is not None and not s.partial:
                return Result("success", got[1], (), got[0] - start, got[0], tuple(s.trace))
            self.again += 1
            self.loud = self.loud or (self.calls >= 100 and 2 * self.again > self.calls)
        return self.interpret(State(text), start)

    def interpret(self, s: State, start: int = 0) -> Result:
        """Run on a prepared state."""
        got = self.run(s, start)
        if got is None:
            # What was recovered from before the failure is told too.
            return Result("failure", None, tuple(dict.fromkeys([*s.partial, *s.errors])), 0, max(s.far, start), tuple(s.trace))
        return Result("partial" if s.partial else "success", got[1], tuple(s.partial), got[0] - start, got[0], tuple(s.trace))


def parse(p: P, text: str, start: int = 0) -> Result:
    return Parser(p)(text, start)


def run_recursive(p: P, text: str, frames: int = 10_000) -> Result:
    """Run with a bound on nesting: RecursionError beyond it."""
    parser, before = Parser(p), sys.getrecursionlimit()
    sys.setrecursionlimit(frames)
    try:
        return parser.interpret(State(text))
    finally:
        sys.setrecursionlimit(before)
