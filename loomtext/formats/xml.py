"""XML with an internal DTD subset's entities; external identifiers are read and never fetched.

References within one text or attribute may expand to ``Config.most_expanded`` characters; more is a failure at that place, since a few
lines of declarations can stand for any amount. None lifts the limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..grammar import P, Ref, char, choice, eof, fail, regex, string, succeed
from ..machine import Parser, Result


@dataclass(frozen=True)
class Config:
    expand_entities: bool = True
    resolve_dtd: bool = True
    preserve_whitespace: bool = False
    keep_comments: bool = True
    most_expanded: int | None = 1 << 20


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, str]] = field(default_factory=list)
    children: list = field(default_factory=list)

    @property
    def prefix(self) -> str | None:
        return self.name.partition(":")[0] if ":" in self.name else None

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class CData:
    text: str


@dataclass(frozen=True)
class Comment:
    text: str


@dataclass(frozen=True)
class Instruction:
    target: str
    text: str


@dataclass
class Document:
    version: str | None
    encoding: str | None
    standalone: str | None
    root: Element


# Fixed values of the format.
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_REF = re.compile(r"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|([^\s;&<]+));")


class Wrong(Exception):
    """What is wrong, and where: the offset in the text that is expanded."""

    def __init__(self, message: str, at: int = 0):
        super().__init__(message)
        self.at = at


def _lex(p: str, label: str) -> P:
    return regex(p, p, label)


ws = _lex(r"[ \t\r\n]*+", "whitespace")
ws1 = _lex(r"[ \t\r\n]++", "whitespace")
name = _lex(r"[^\W\d.\-][\w.\-:]*+|:[\w.\-:]*+", "name")
quoted = _lex(r'"[^"]*+"|' + r"'[^']*+'", "quoted value").map(lambda r: r[1:-1])


class Entities:
    """What the internal subset declares, and references expanded by it."""

    def __init__(self, config: Config):
        self.config = config
        self.clear()

    def clear(self) -> None:
        """One compiled grammar serves many documents, one after the other."""
        self.values, self.external, self.unparsed, self.lenient = dict(PREDEFINED), set(), set(), False

    def declare(self, declared: tuple) -> None:
        for kind, key, body in declared:
            if kind == "lenient":
                self.lenient = True
            elif key in self.values and key not in PREDEFINED or key in self.external or key in self.unparsed:
                continue  # the first declaration holds
            elif kind == "internal":
                self.values[key] = body
            else:
                (self.unparsed if kind == "unparsed" else self.external).add(key)

    def expand(self, text: str, attribute: bool) -> str:
        out, size, work = [], 0, [(text, 0, ())]
        if not self.config.expand_entities:
            return text
        while work:
            body, at, inside = work.pop()
            m = _REF.search(body, at)
            plain = body[at : m.start() if m else len(body)]
            if inside and attribute and "<" in plain:
                raise Wrong("< in entity replacement text used in attribute")
            out.append(plain)
            size += len(plain)
            if self.config.most_expanded is not None and size > self.config.most_expanded:
                raise Wrong("entity expansion is too large")
            if m is None:
                continue
            work.append((body, m.end(), inside))
            where = m.start() if not inside else 0
            if m[1] or m[2]:
                code = int(m[1], 16) if m[1] else int(m[2])
                if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                    raise Wrong("character reference out of range", where)
                out.append(chr(code))
            elif m[3] in inside:
                raise Wrong(f"circular entity reference: {m[3]}", where)
            elif m[3] in self.unparsed:
                raise Wrong(f"reference to unparsed entity: &{m[3]};", where)
            elif m[3] in PREDEFINED:
                out.append(PREDEFINED[m[3]])
            elif m[3] in self.values:
                work.append((self.values[m[3]], 0, (*inside, m[3])))
            elif m[3] in self.external:
                if attribute:
                    raise Wrong(f"external entity in attribute: &{m[3]};", where)
                out.append(m[0])
            elif self.lenient or not self.config.resolve_dtd:
                out.append(m[0])
            else:
                raise Wrong(f"undeclared entity: &{m[3]};", where)
        return "".join(out)


def _doctype() -> P:
    external = (string("SYSTEM") >> ws1 >> quoted) | (string("PUBLIC") >> ws1 >> quoted >> ws1 >> quoted)
    unparsed = (ws1 >> string("NDATA") >> ws1 >> name).map(lambda _: "unparsed") | succeed("external")
    body = quoted.map(lambda v: ("internal", v)) | (external >> unparsed).map(lambda k: (k, None))
    entity = ((string("<!ENTITY") >> ws1 >> name << ws1) & (body << ws << char(">"))).map(lambda x: (x[1][0], x[0], x[1][1]))
    parameter = _lex(r"<!ENTITY[ \t\r\n]++%(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", "parameter entity").as_(("skip", None, None))
    other = _lex(r"<!(?:ELEMENT|ATTLIST|NOTATION)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<!--(?:(?!-->)[\s\S])*+-->|<\?(?:(?!\?>)[\s\S])*+\?>", "declaration").as_(("skip", None, None))
    reference = _lex(r"%[^\s;]++;", "parameter reference").as_(("lenient", None, None))
    subset = (char("[") >> (ws >> choice(entity, parameter, other, reference)).many() << ws << char("]") << ws) | succeed([])
    outside = (ws1 >> external).map(lambda _: [("lenient", None, None)]) | succeed([])
    return (string("<!DOCTYPE") >> ws1 >> name & outside << ws) & (subset << char(">"))


def content(entities: Entities) -> P:
    c = entities.config
    element = Ref()

    def expanded(p: P, attribute: bool) -> P:
        def step(x: tuple) -> P:
            at, raw = x
            try:
                return succeed(entities.expand(raw, attribute))
            except Wrong as e:
                return P("fail_at", (str(e), at + e.at))

        return (P("offset") & p).flat_map(step)

    attribute = (ws1 >> name << ws << char("=") << ws) & choice(
        char('"') >> expanded(_lex(r'[^"<]*+', "value"), True) << char('"'), char("'") >> expanded(_lex(r"[^'<]*+", "value"), True) << char("'")
    )
    text = expanded(_lex(r"[^<]++", "text"), False).map(Text)
    cdata = _lex(r"<!\[CDATA\[(?:(?!\]\]>)[\s\S])*+\]\]>", "CDATA").map(lambda r: CData(r[9:-3]))
    comment = _lex(r"<!--(?:(?!--)[\s\S])*+-->", "comment").map(lambda r: Comment(r[4:-3]))
    pi = _lex(r"<\?(?![xX][mM][lL][\s?])(?:(?!\?>)[\s\S])*+\?>", "processing instruction").map(lambda r: Instruction(*(r[2:-2].split(None, 1) + ["", ""])[:2]))

    def inside(children: list) -> list:
        if not c.keep_comments:
            children = [x for x in children if not isinstance(x, Comment)]
        if c.preserve_whitespace:
            return children
        trimmed = [Text(x.text.strip(" \t\r\n")) if isinstance(x, Text) else x for x in children]
        return [x for x in trimmed if not (isinstance(x, Text) and not x.text)]

    def unique(x: tuple) -> P:
        names = [k for k, _ in x[1]]
        return fail(f"duplicate attribute in <{x[0]}>") if len(set(names)) < len(names) else succeed(x)

    def closed(x: tuple) -> P:
        (tag, attributes), body = x
        if body is None:
            return succeed(Element(tag, attributes))
        kids, (at, end) = body
        return succeed(Element(tag, attributes, inside(kids))) if end == tag else P("fail_at", (f"mismatched end tag: expected </{tag}>, found </{end}>", at))

    # Nothing of it depends on a tag's name, so that it is compiled once, not for each element.
    start = ((char("<") >> name) & (attribute.many() << ws)).flat_map(unique)
    end = P("offset") & (string("</") >> name << ws << char(">"))
    body = string("/>").as_(None) | ((char(">") >> P("defer", (lambda: node,)).many()) & end)
    element.set((start & body).flat_map(closed))
    node = choice(cdata, comment, pi, _lex(r"(?=<[^/!?])", "'<'") >> element, text)
    return element


def document(entities: Entities) -> P:
    config = entities.config
    pseudo = lambda k: (ws1 >> string(k) >> ws >> char("=") >> ws >> quoted).optional()
    declaration = (string("<?xml") >> (pseudo("version") & pseudo("encoding")) & pseudo("standalone") << ws << string("?>")).map(lambda x: (*x[0], x[1])) | succeed((None, None, None))
    misc = _lex(r"(?:[ \t\r\n]++|<!--(?:(?!--)[\s\S])*+-->|<\?(?![xX][mM][lL][\s?])(?:(?!\?>)[\s\S])*+\?>)*+", "markup")
    doctype = _doctype().optional()

    def known(x: tuple | None) -> P:
        if x is not None and config.resolve_dtd:
            entities.declare([*x[0][1], *x[1]])
        elif x is not None:
            entities.lenient = True
        return succeed(None)

    return ((declaration << misc) & (doctype.flat_map(known) >> misc >> content(entities) << misc << eof)).map(lambda x: Document(*x[0], x[1]))


_made: dict[tuple[Config, bool], tuple[Entities, Parser]] = {}


def _compiled(config: Config, whole: bool) -> tuple[Entities, Parser]:
    if (config, whole) not in _made:
        entities = Entities(config)
        _made[config, whole] = entities, Parser(document(entities) if whole else ws >> content(entities) << ws << eof)
    return _made[config, whole]


def parse_xml(text: str, config: Config = Config()) -> Result:
    entities, parser = _compiled(config, True)
    entities.clear()
    return parser(text)


def parse_fragment(text: str, config: Config = Config()) -> Result:
    entities, parser = _compiled(config, False)
    entities.clear()
    return parser(text)
