"""Lexers that formats share."""

from __future__ import annotations

from ..grammar import P, any_char, char, digit, one_of, regex, string

hex_digit = one_of("0123456789abcdefABCDEF")
unicode_escape = (string("\\u") >> hex_digit.count(4).capture()).map(lambda h: chr(int(h, 16)))
sign = one_of("+-").optional()
unsigned_int = regex("[0-9]++", "[0-9]++", "digit").map(int)
signed_int = regex("[+-]?+[0-9]++", "[+-]?+[0-9]++", "integer").map(int)
floating_point = regex(r"[+-]?+[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+", r"[+-]?+[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+", "number").map(float)
hspace = one_of(" \t")
hspaces = hspace.skip_many()
newline = string("\r\n") | char("\n") | char("\r")
identifier = regex("[A-Za-z_][A-Za-z0-9_]*+", "[A-Za-z_][A-Za-z0-9_]*+", "identifier")


def quoted_string(quote: str) -> P:
    """Between quotes, with backslash escapes kept for what follows them."""
    plain = regex(rf"[^{quote}\\]++", rf"[^{quote}\\]++", "text")
    escape = (char("\\") >> any_char).map(lambda c: {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}.get(c, c))
    return (plain | unicode_escape | escape).many().map("".join).between(char(quote), char(quote))


double_quoted_string, single_quoted_string = quoted_string('"'), quoted_string("'")


def line_comment(start: str) -> P:
    return (string(start) >> regex(r"[^\r\n]*+", r"[^\r\n]*+", "comment")).map(str)


def block_comment(start: str, end: str) -> P:
    body = (string(end).not_followed_by() >> any_char).many().capture()
    return body.between(string(start), string(end))


digits = digit.many1().capture()
