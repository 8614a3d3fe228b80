"""Parsing again only what an edit touched: a token, else the smallest region with a parser of its own, else all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .machine import Node, Result


@dataclass(frozen=True)
class TextEdit:
    start: int
    end: int
    new_text: str

    def __post_init__(self) -> None:
        if not 0 <= self.start <= self.end:
            raise ValueError("an edit needs 0 <= start <= end")

    @property
    def delta(self) -> int:
        return len(self.new_text) - (self.end - self.start)

    def apply(self, text: str) -> str:
        if self.end > len(text):
            raise ValueError("the edit ends beyond the text")
        return text[: self.start] + self.new_text + text[self.end :]


@dataclass(frozen=True)
class Bundle:
    """Parsers of a language: of a whole text, of regions by kind, and of single tokens by kind."""

    full: Callable[[str], Result]
    regions: dict = field(default_factory=dict)
    tokens: dict = field(default_factory=dict)
    min_reparse_size: int = 50


@dataclass(frozen=True)
class Reparsed:
    tree: Node
    text: str
    how: str
    region: tuple[int, int]
    ok: bool = True


def _chain(root: Node, start: int, end: int, known: set) -> list[tuple[Node, int, int]]:
    """(node, offset, child index) from the root down to the deepest node that holds [start, end]; where an edit stands
    between two, the first that is a tree or of a known kind."""
    out, node, at = [(root, 0, 0)], root, 0
    while node.children:
        held = []
        for i, child in enumerate(node.children):
            width = child.width
            if at <= start and end <= at + width and width:
                held.append((child, at, i))
            at += width
        if not held:
            break
        out.append(next((x for x in held if x[0].cls == "tree" or x[0].kind in known), held[0]))
        node, at, _ = out[-1]
    return out


def _spliced(chain: list[tuple[Node, int, int]], depth: int, new: Node) -> Node:
    for k in range(depth, 0, -1):
        parent, index = chain[k - 1][0], chain[k][2]
        new = Node.with_width(parent.kind, [*parent.children[:index], new, *parent.children[index + 1 :]], parent.width - parent.children[index].width + new.width) if parent.cls == "tree" and not parent.text else Node(parent.cls, parent.kind, parent.text, [*parent.children[:index], new, *parent.children[index + 1 :]])
    return new


def _whole(text: str, bundle: Bundle) -> Reparsed:
    r = bundle.full(text)
    if r.status != "failure":
        return Reparsed(r.value, text, "full", (0, len(text)))
    # Still lossless: the text as one node that nobody expected.
    return Reparsed(Node("unexpected", "Unexpected", "", [Node("token", "Skipped", text)]), text, "full", (0, len(text)), False)


def reparse(tree: Node, text: str, edit: TextEdit, bundle: Bundle) -> Reparsed:
    """The tree after an edit; its source is always the edited text."""
    new_text = edit.apply(text)
    chain = _chain(tree, edit.start, edit.end, set(bundle.tokens))
    node, at, _ = chain[-1]
    if node.cls == "token" and node.kind in bundle.tokens:
        own = TextEdit(edit.start - at, edit.end - at, edit.new_text).apply(node.text)
        r = bundle.tokens[node.kind](own)
        if own and r.status == "success" and r.consumed == len(own):
            return Reparsed(_spliced(chain, len(chain) - 1, Node("token", node.kind, own)), new_text, "token", (at, at + len(own)))
    for depth in range(len(chain) - 1, 0, -1):
        node, at, _ = chain[depth]
        size = node.width
        # A token at either edge of the edit may now run on beyond the region, so that edits at an edge go further up.
        if node.kind not in bundle.regions or edit.start <= at or edit.end >= at + size:
            continue
        if size >= len(text) - bundle.min_reparse_size:
            break
        region = new_text[at : at + size + edit.delta]
        r = bundle.regions[node.kind](region)
        if r.status == "success" and r.consumed == len(region):
            return Reparsed(_spliced(chain, depth, r.value), new_text, "block", (at, at + len(region)))
    return _whole(new_text, bundle)


def reparse_all(tree: Node, text: str, edits: list[TextEdit], bundle: Bundle) -> Reparsed:
    """Edits of one text, all in its coordinates, none overlapping; over half of the text: all of it is parsed again."""
    ordered = sorted(edits, key=lambda e: (e.start, e.end))
    for a, b in zip(ordered, ordered[1:], strict=False):
        if a.end > b.start:
            raise ValueError("edits overlap")
    if 2 * sum(max(e.end - e.start, len(e.new_text)) for e in ordered) > len(text):
        for e in reversed(ordered):
            text = e.apply(text)
        return _whole(text, bundle)
    out = Reparsed(tree, text, "none", (0, 0))
    for e in reversed(ordered):
        out = reparse(out.tree, out.text, e, bundle)
    return out


def json_bundle() -> Bundle:
    """For lossless JSON trees: scalars as tokens, objects and arrays as regions."""
    from .formats import json as j
    from .grammar import eof, string, token
    from .machine import Parser

    lexers = {"String": j._lex(j._STRING, "string"), "Number": j._lex(j._NUMBER, "number"), "True": string("true"), "False": string("false"), "Null": string("null")}
    region = lambda text: _inner(j.parse_lossless(text))
    return Bundle(j.parse_lossless, {"Object": region, "Array": region}, {k: Parser(token(k, p) << eof) for k, p in lexers.items()})


def _inner(r: Result) -> Result:
    """The value inside a document, if there is nothing around it."""
    if r.status == "failure" or len(r.value.children) != 1:
        return Result("failure", None, r.errors, 0, r.furthest)
    return Result(r.status, r.value.children[0], r.errors, r.consumed, r.furthest)
