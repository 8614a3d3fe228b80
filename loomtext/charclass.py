"""Character classes with the meaning they have in the JVM, as Python and as Java regular expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

# Blanks of the JVM's isWhitespace that are no space, line or paragraph separators, and the separators it leaves out.
_CONTROL_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_NO_BREAK = "   "


def is_whitespace(c: str) -> bool:
    return c in _CONTROL_BLANKS or (c not in _NO_BREAK and unicodedata.category(c) in ("Zs", "Zl", "Zp"))


def is_digit(c: str) -> bool:
    return unicodedata.category(c) == "Nd"


def is_letter(c: str) -> bool:
    return unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lm", "Lo")


TESTS: dict[str, Callable[[str], bool]] = {
    "javaDigit": is_digit,
    "javaLetter": is_letter,
    "javaLetterOrDigit": lambda c: is_letter(c) or is_digit(c),
    "javaWhitespace": is_whitespace,
}


_known: dict[str, str] = {}


def _ranges(name: str) -> str:
    """A named class as the inside of a Python character class; the JVM takes code points beyond the BMP for no letters."""
    if name in _known:
        return _known[name]
    test, out, start = TESTS[name], [], None
    for code in range(0x10001):
        hit = code < 0x10000 and not 0xD800 <= code < 0xE000 and test(chr(code))
        if hit and start is None:
            start = code
        elif not hit and start is not None:
            out.append(f"\\u{start:04x}-\\u{code - 1:04x}")
            start = None
    _known[name] = "".join(out)
    return _known[name]


def _quoted(c: str, java: bool) -> str:
    if c.isascii() and c.isalnum():
        return c
    code = ord(c)
    if java:
        return f"\\x{{{code:x}}}"
    return f"\\U{code:08x}" if code > 0xFFFF else f"\\u{code:04x}"


@dataclass(frozen=True)
class CharClass:
    """One character: of a named class, of a set, or outside a set."""

    label: str
    named: str | None = None
    chars: str = ""
    negated: bool = False

    def python(self) -> str:
        if self.named:
            return f"[{_ranges(self.named)}]"
        if not self.chars:
            return r"[\s\S]" if self.negated else r"(?!)"
        return f"[{'^' if self.negated else ''}{''.join(_quoted(c, False) for c in self.chars)}]"

    def java(self) -> str:
        if self.named:
            return f"\\p{{{self.named}}}"
        if not self.chars:
            return r"[\s\S]" if self.negated else r"(?!)"
        return f"[{'^' if self.negated else ''}{''.join(_quoted(c, True) for c in self.chars)}]"

    def test(self, c: str) -> bool:
        if self.named:
            return ord(c) < 0x10000 and TESTS[self.named](c)
        return (c in self.chars) != self.negated


def quoted(text: str, java: bool) -> str:
    return "".join(_quoted(c, java) for c in text)


assert sys.version_info >= (3, 11)  # possessive repetition in re
