"""Regular grammars as one regular expression, with the commitments of ordered choice kept.

A choice becomes an atomic group, a repetition a possessive one, so that the pattern never takes back what the
grammar would not.  What is not regular, or whose pieces are needed, raises NotRegular.
"""

from __future__ import annotations

from .charclass import quoted
from .grammar import P


class NotRegular(Exception):
    pass


def nullable(p: P) -> bool:
    """Whether a regular grammar may match nothing."""
    k, a = p.kind, p.args
    if k in ("succeed", "optional", "look", "not", "eof"):
        return True
    if k in ("zip", "left", "right"):
        return nullable(a[0]) and nullable(a[1])
    if k == "seq":
        return all(map(nullable, a))
    if k == "or":
        return any(map(nullable, a))
    if k == "many":
        return a[1] == 0 or nullable(a[0])
    if k in ("map", "skip", "capture"):
        return nullable(a[0])
    return False


def lower(p: P, java: bool = True, depth: int = 0) -> str:
    k, a = p.kind, p.args
    if depth > 200:
        raise NotRegular("nested too deep")

    def sub(q: P) -> str:
        return lower(q, java, depth + 1)

    if k == "char":
        return a[0].java() if java else a[0].python()
    if k == "string":
        return f"(?:{quoted(a[0], java)})"
    if k == "string_in":
        return "(?>" + "|".join(quoted(w, java) for w in a[0]) + ")"
    if k == "regex":
        return f"(?>{a[1] if java else a[0]})"
    if k == "succeed":
        return ""
    if k == "eof":
        return r"\z" if java else r"\Z"
    if k in ("zip", "left", "right", "seq"):
        return "".join(map(sub, a))
    if k == "or":
        return "(?>" + "|".join(map(sub, a)) + ")"
    if k == "optional":
        return f"(?:{sub(a[0])})?+"
    if k == "many":
        if nullable(a[0]):
            raise NotRegular("a repetition needs a part that consumes")
        body = f"(?:{sub(a[0])})"
        if a[2] is not None:
            return f"{body}{{{a[1]}}}+" if a[1] else ""
        return body + ("*+" if a[1] == 0 else "++" if a[1] == 1 else f"{{{a[1]},}}+")
    if k == "look":
        return f"(?={sub(a[0])})"
    if k == "not":
        return f"(?!{sub(a[0])})"
    if k in ("skip", "capture", "map"):
        return sub(a[0])
    raise NotRegular(k)


def is_regular(p: P) -> bool:
    try:
        lower(p)
        return True
    except NotRegular:
        return False
