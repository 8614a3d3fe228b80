"""Protocol Buffers schemas: messages (also nested), enums, services, maps, oneofs, options."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..grammar import P, Ref, char, choice, eof, regex
from ..machine import Parser, Result

# Fixed values of the format.
SCALARS = ("double", "float", "int32", "int64", "uint32", "uint64", "sint32", "sint64", "fixed32", "fixed64", "sfixed32", "sfixed64", "bool", "string", "bytes")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    number: int
    label: str = ""
    key_type: str = ""

    @property
    def is_scalar(self) -> bool:
        return self.type in SCALARS


@dataclass
class Message:
    name: str
    fields: list = field(default_factory=list)
    nested: list = field(default_factory=list)


@dataclass
class Enum:
    name: str
    values: list = field(default_factory=list)


@dataclass(frozen=True)
class Method:
    name: str
    input: str
    output: str
    client_streaming: bool
    server_streaming: bool


@dataclass
class Service:
    name: str
    methods: list = field(default_factory=list)


@dataclass
class File:
    syntax: str = "proto3"
    package: str = ""
    imports: list = field(default_factory=list)
    options: list = field(default_factory=list)
    messages: list = field(default_factory=list)
    enums: list = field(default_factory=list)
    services: list = field(default_factory=list)


def _lex(p: str, label: str) -> P:
    return regex(p, p, label)


blank = _lex(r"(?:\s++|//[^\n]*+|/\*(?:(?!\*/)[\s\S])*+\*/)*+", "blank")


def tok(p: P) -> P:
    return p << blank


def word(w: str) -> P:
    return tok(_lex(rf"{w}\b", f'"{w}"'))


name = tok(_lex(r"[A-Za-z_][A-Za-z0-9_]*+", "name"))
path = tok(_lex(r"\.?+[A-Za-z_][A-Za-z0-9_]*+(?:\.[A-Za-z_][A-Za-z0-9_]*+)*+", "type"))
number = tok(_lex(r"0[xX][0-9a-fA-F]++|[0-9]++", "number")).map(lambda r: int(r, 0) if r[:2] in ("0x", "0X") else int(r))
text = tok(_lex(r'"(?:[^"\\\n]++|\\.)*+"|' + r"'(?:[^'\\\n]++|\\.)*+'", "string")).map(lambda r: r[1:-1])
mark = lambda c: tok(char(c))
end = mark(";")


def grammar() -> P:
    constant = tok(_lex(r"[+-]?+[\w.]++", "constant")) | text
    option = (word("option") >> tok(_lex(r"[\w.()]++", "option")) << mark("=")) & (constant << end)
    brackets = tok(_lex(r"\[[^\]]*+\]", "options")).optional()
    label = (word("repeated") | word("optional") | word("required")).optional().map(lambda x: x or "")
    plain = ((label & path) & (name << mark("=")) & (number << brackets << end)).map(lambda x: Field(x[0][1], x[0][0][1], x[1], x[0][0][0]))
    mapping = ((word("map") >> mark("<") >> path << mark(",")) & (path << mark(">")) & (name << mark("=")) & (number << brackets << end)).map(lambda x: Field(x[0][1], x[0][0][1], x[1], "map", x[0][0][0]))
    reserved = (_lex(r"(?:reserved|extensions)\b[^;]*+;", "reserved") << blank).as_(None)
    message = Ref()
    one = (word("oneof") >> name >> plain.many1().between(mark("{"), mark("}"))).map(lambda fs: [Field(f.name, f.type, f.number, "oneof") for f in fs])
    value = (name << mark("=")) & (tok(_lex("-?+[0-9]++", "number")).map(int) << brackets << end)
    enum = ((word("enum") >> name) & choice(option.as_(None), reserved, value).many().between(mark("{"), mark("}"))).map(lambda x: Enum(x[0], [v for v in x[1] if v]))

    def body(x: tuple) -> Message:
        flat = [f for part in x[1] if part is not None for f in (part if isinstance(part, list) else [part])]
        return Message(x[0], [f for f in flat if isinstance(f, Field)], [f for f in flat if not isinstance(f, Field)])

    message.set(((word("message") >> name) & choice(message, enum, one, option.as_(None), reserved, mapping, plain, end.as_(None)).many().between(mark("{"), mark("}"))).map(body))
    stream = word("stream").optional().map(bool)
    side = (stream & path).between(mark("("), mark(")"))
    rpc = ((word("rpc") >> name) & side & (word("returns") >> side << (end | (mark("{") >> (option.many()) >> mark("}"))))).map(lambda x: Method(x[0][0], x[0][1][1], x[1][1], x[0][1][0], x[1][0]))
    service = ((word("service") >> name) & choice(rpc, option.as_(None)).many().between(mark("{"), mark("}"))).map(lambda x: Service(x[0], [m for m in x[1] if m]))
    syntax = (word("syntax") >> mark("=") >> text << end).map(lambda x: ("syntax", x))
    package = (word("package") >> path << end).map(lambda x: ("package", x))
    imported = (word("import") >> (word("public") | word("weak")).optional() >> text << end).map(lambda x: ("imports", x))

    def collected(parts: list) -> File:
        f = File()
        for p in parts:
            if isinstance(p, tuple):
                if p[0] in ("syntax", "package"):
                    setattr(f, *p)
                elif p[0] == "imports":
                    f.imports.append(p[1])
                else:
                    f.options.append(p[1])
            elif p is not None:
                {Message: f.messages, Enum: f.enums, Service: f.services}[type(p)].append(p)
        return f

    top = choice(syntax, package, imported, option.map(lambda x: ("option", x)), message, enum, service, end.as_(None))
    return (blank >> top.many() << eof).map(collected)


def parse_proto(source: str) -> Result:
    return _PROTO(source)


_PROTO = Parser(grammar())
