"""Secrets in texts and in what is encoded in them.

Three kinds of match are looked for in the text itself (the base).  A worklist then unwraps layers until
nothing new comes up: URL escapes, Unicode and character escapes, base64 (both alphabets, wrapped or not, read from
each of four places of a run), UTF-16 and UTF-32 written as single bytes, and gzip, zlib, bzip2, xz or zstd streams, in
any nesting.  Each layer keeps, for each of its characters, the range of the original text that it came from, and is
scanned like the text; a match that needed no decoding is the base's own.

A run of base64 is decoded if a secret fits in it.  The shortest secret has 16 characters, so 22 of base64; the shortest
streams that unpack to as much (zlib: 2 bytes, a literal and a repetition in 4, 4 of a check sum; zstd: 4, 2 of a header, 4 of a block)
have 10 bytes, so 14 characters, the first of which tell what it is.
A layer seen before over the same range (a cycle, such as a stream that unpacks to itself) is not taken again.

Spans are in code points of the original text, the end exclusive.  A match in a compressed stream spans the
stream.  A stream whose content is over ``max_layer`` bytes is scanned in windows of 5/8 of that which overlap by 1/8;
``complete`` is then false, since what is longer than the overlap may be cut.

Nulls: a null text is empty; a null id is an id like others.  Repeated rows are scanned each.  Empty input: no
rows.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from io import StringIO
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean

# The kinds in order, their patterns, the group that has a least length, and that length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),
}
ORDER = {k: i for i, k in enumerate(KINDS)}
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
# The least characters of base64 for a stream and for text, and how short streams (zlib, zstd) begin there.
LEAST_STREAM, LEAST_TEXT = 14, 22
_SHORT = re.compile(r"eA[E-H]|eF[4-7]|eJ[w-z]|eN[o-r]|KLUv[/_][Q-Za-f]")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{14,}={0,2}")
_CHARS = re.compile(r"[A-Za-z0-9+/_-]+")
_PAD = re.compile(r"={0,2}")
# Line ends inside a wrapped run, also as written in strings.
_JOINT = re.compile(r"(?<=[A-Za-z0-9+/_-])(?:\r?\n|(?:\\r)?\\n)[ \t]*(?=[A-Za-z0-9+/_-])")
_STANDARD, _SAFE = re.compile(r"[+/]"), re.compile(r"[_-]")
_STANDARD_RUN, _SAFE_RUN = re.compile(r"[A-Za-z0-9+/]{14,}"), re.compile(r"[A-Za-z0-9_-]{14,}")
_TO_STANDARD = str.maketrans("-_", "+/")
_MAGIC = re.compile(r"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
# ASCII in two or four bytes each; no secret is in less than eight such characters.
_SPACED = re.compile(r"(?:[\t\n\r -~]\x00{1,3}){8,}[\t\n\r -~]?")
_NARROW = re.compile(r"[\x00-\xff]+")
# Starts of streams whose bytes are written as characters in UTF-8.
_WIDE = re.compile(rb"\x1f\xc2\x8b\x08|x(?:[\x01\x5e]|\xc2\x9c|\xc3\x9a)|BZh[1-9]1AY&SY|\xc3\xbd7zXZ\x00|\x28\xc2\xb5/\xc3\xbd")
MAX_LAYER = 1 << 23


class Via:
    """Places in the original text for a layer's characters, looked up when asked for: those of ``parent`` (a number stands for itself) at ``at``."""

    def __init__(self, n: int, at: Callable, parent: Via | None = None) -> None:
        self.n, self.at, self.parent = n, at, parent

    def __getitem__(self, i: int | slice | np.ndarray) -> np.ndarray:
        got = self.at(np.arange(*i.indices(self.n)) if isinstance(i, slice) else i)
        return got if self.parent is None else self.parent[got]


class Layer(NamedTuple):
    """A text, the range [lo, hi) of the original that each character came from, the end of what follows the last one (such as
    base64 padding), whether it is one line of what may be a wrapped run, whether its streams were taken out, and whether it is
    looked at for streams only."""

    text: str
    lo: Via
    hi: Via
    end: int | None = None
    piece: bool = False
    opened: bool = False
    wide: bool = False

    def range(self, i: int, j: int) -> tuple[int, int]:
        return int(self.lo[i]), self.end if j == len(self.text) and self.end is not None else int(self.hi[j - 1])


def scan(text: str) -> list[tuple[str, int, int]]:
    """All matches: kind, start, end; leftmost and not overlapping for each kind, those too short left out."""
    return [(kind, *m.span()) for kind, (pattern, group, least) in KINDS.items() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def _replaced(layer: Layer, parts: Iterator[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer | None:
    """The layer with ranges [a, b) put as other text, each of whose characters came from a range of the layer; None without any."""
    out, starts, froms, news, los, his, at, n = StringIO(newline=""), array("q"), array("q", [0]), array("q", [0]), array("q"), array("q"), 0, 0
    for a, b, new, lo, hi in parts:
        out.write(layer.text[at:a])
        out.write(new)
        starts.extend((n, n + a - at))
        n += a - at + len(new)
        at = b
        froms.append(at)
        los.frombytes(lo.astype(np.int64).tobytes())
        his.frombytes((hi - 1).astype(np.int64).tobytes())
        news.append(len(los))
    if not at:
        return None
    out.write(layer.text[at:])
    starts.append(n)
    text = out.getvalue()

    # Odd stretches are new, even ones start in the layer where the part before them ended.
    def came(places: array) -> Callable:
        first, old, before, put = (np.frombuffer(x, np.int64) for x in (starts, froms, news, places))

        def at(i: np.ndarray) -> np.ndarray:
            k = np.searchsorted(first, i, "right") - 1
            inside = np.minimum(before[k // 2] + i - first[k], len(put) - 1)
            return np.where(k % 2 == 1, put[inside], old[k // 2] + i - first[k])

        return at

    return layer._replace(text=text, lo=Via(len(text), came(los), layer.lo), hi=Via(len(text), came(his), layer.hi), opened=False)


def _utf8(raw: bytes, keep: bool = True) -> tuple[str, np.ndarray, np.ndarray]:
    """Characters with their byte ranges; bytes that are not UTF-8 stand for themselves or, if not kept, give U+FFFD."""
    code = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    lone = (code >= 0xDC80) & (code < 0xDD00)
    ends = np.cumsum(np.where(lone, 1, 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)))
    text = np.where(lone, code - 0xDC00 if keep else 0xFFFD, code).astype(np.uint32).tobytes().decode("utf-32-le")
    return text, np.concatenate([[0], ends[:-1]]), ends


def _unquoted(layer: Layer) -> Iterator[tuple]:
    for m in _URL.finditer(layer.text):
        new, i, j = _utf8(bytes.fromhex(m[0].replace("%", "")))
        yield *m.span(), new, m.start() + 3 * i, m.start() + 3 * j


def _unescaped(layer: Layer) -> Iterator[tuple]:
    for m in _ESCAPE.finditer(layer.text):
        codes, starts, ends = array("q"), array("q"), array("q")
        for x in _ONE.finditer(m[0]):
            code = int(x[4]) if x[4] else int(x[1] or x[2] or x[3], 16)
            if 0xDC00 <= code < 0xE000 and codes and 0xD800 <= codes[-1] < 0xDC00:
                codes[-1] = 0x10000 + ((codes[-1] - 0xD800) << 10) + code - 0xDC00
                ends[-1] = m.start() + x.end()
            else:
                codes.append(code)
                starts.append(m.start() + x.start())
                ends.append(m.start() + x.end())
        new = "".join(chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else "\ufffd" for c in codes)
        yield *m.span(), new, np.array(starts, np.int64), np.array(ends, np.int64)


def _squeezed(layer: Layer) -> Iterator[tuple]:
    """Runs of wide ASCII characters without their zero bytes."""
    for m in _SPACED.finditer(layer.text):
        at = np.flatnonzero(np.frombuffer(m[0].encode("latin-1"), np.uint8)) + m.start()
        yield *m.span(), m[0].replace("\0", ""), at, np.append(at[1:], m.end())


def _parts(raw: memoryview, end: list[int]) -> Iterator[bytes]:
    """The content of a compressed stream, a part at a time; ``end`` gets the stream's length and whether it ended. Raises what its library raises if there is none or it is broken."""
    step = 1 << 16
    if raw[:2] == b"\x1f\x8b" or raw[:1] == b"\x78":
        z = zlib.decompressobj(47)
    elif raw[:3] == b"BZh":
        z = bz2.BZ2Decompressor()
    elif raw[:6] == b"\xfd7zXZ\x00":
        z = lzma.LZMADecompressor()
    else:
        import zstandard

        # Four bytes of input may give 128 KB and no limit can be set: few are given at once.
        z, step = zstandard.ZstdDecompressor().decompressobj(), 1 << 10
    at, rest = 0, b""
    while not z.eof:
        chunk = rest
        if not rest and getattr(z, "needs_input", True):
            chunk = raw[at : at + step]
            at += len(chunk)
            if not chunk and not isinstance(z, type(zlib.decompressobj())):
                break
        out = z.decompress(chunk) if step == 1 << 10 else z.decompress(chunk, 1 << 20)
        rest = getattr(z, "unconsumed_tail", b"")
        end[:] = at - len(z.unused_data), z.eof
        if out:
            yield out
        elif not chunk and getattr(z, "needs_input", True):
            break


def _contents(raw: memoryview, most: int, end: list[int]) -> Iterator[tuple[bytes, bool]]:
    """The content of a compressed stream and True, nothing if it is broken; if it is over ``most`` bytes, overlapping windows of it and False."""
    step = max(most // 2, 1)
    keep = max(most // 8, 1)
    held, size, large = [], 0, False
    try:
        for part in _parts(raw, end):
            held.append(part)
            size += len(part)
            if size > (step + keep if large else most):
                whole = b"".join(held)
                large = True
                for i in range(0, size - step - keep + 1, step):
                    yield whole[i : i + step + keep], False
                    last = i + step
                held = [whole[last:]]
                size -= last
    except Exception:  # noqa: BLE001 - each library has its own errors for bytes that only looked like a stream
        return
    if size:
        yield b"".join(held), not large


def _plain(raw: bytes) -> str | None:
    """Bytes as text, if they look like one."""
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return None
    return text if sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text) else None


def _runs(text: str) -> Iterator[tuple[str, Callable, int, bool]]:
    """Runs of base64 characters: the characters, the place of each in the text, the end with padding, and whether a run is one line of several."""
    joints = [m.span() for m in _JOINT.finditer(text)] if "\n" in text or "\\n" in text else []
    wrapped: set[int] = set()
    k = 0
    while k < len(joints):
        first = k
        while k + 1 < len(joints) and _CHARS.fullmatch(text, joints[k][1], joints[k + 1][0]):
            k += 1
        begin = joints[first][0]
        while begin and text[begin - 1] in _ALPHABET:
            begin -= 1
        last = _CHARS.match(text, joints[k][1]).end()
        edges = [begin, *(x for span in joints[first : k + 1] for x in span), last]
        k += 1
        pieces = list(zip(edges[::2], edges[1::2], strict=True))
        run = "".join(text[i:j] for i, j in pieces)
        if len(run) >= LEAST_STREAM:
            wrapped.update(i for i, _ in pieces)
            sizes = np.cumsum([0, *(j - i for i, j in pieces)])
            starts = np.array([i for i, _ in pieces])
            yield run, lambda i, sizes=sizes, starts=starts: starts[(p := np.searchsorted(sizes, i, "right") - 1)] + i - sizes[p], _PAD.match(text, last).end(), False
    for m in _B64.finditer(text):
        yield m[0].rstrip("="), lambda i, s=m.start(): s + i, m.end(), m.start() in wrapped


def _views(run: str) -> Iterator[tuple[int, str]]:
    """A run and, if it mixes both alphabets, the runs of each in it."""
    yield 0, run
    if _STANDARD.search(run) and _SAFE.search(run):
        for alphabet in (_STANDARD_RUN, _SAFE_RUN):
            yield from ((m.start(), m[0]) for m in alphabet.finditer(run))


def _decoded(layer: Layer) -> Iterator[Layer]:
    """What base64 runs in a layer hold, read from each of four places, so that what precedes a token does not hide it.

    Bytes are characters of their own; a layer of the UTF-8 they hold comes too where it may have streams written as characters.
    """
    for run, place, stop, piece in _runs(layer.text):
        for off, view in _views(run):
            if len(view) < LEAST_TEXT and not _SHORT.search(view):
                continue
            end = int(layer.hi[stop - 1]) if off + len(view) == len(run) else None
            view = view.translate(_TO_STANDARD)  # noqa: PLW2901
            for k in range(4):
                size = len(view) - k
                size -= size % 4 == 1
                raw = base64.b64decode(view[k : k + size] + "=" * (-size % 4))
                made = [(raw.decode("latin-1"), lambda i: i, lambda i: i + 1)]
                if not raw.isascii() and _WIDE.search(raw):
                    # No byte that is not UTF-8 is part of such a stream.
                    new, i, j = _utf8(raw, keep=False)
                    made.append((new, lambda x, i=i: i[x], lambda x, j=j: j[x]))
                for new, i, j in made:
                    lo = Via(len(new), lambda x, i=i, c=off + k, place=place: place(c + i(x) * 8 // 6), layer.lo)
                    hi = Via(len(new), lambda x, j=j, c=off + k, place=place: place(c - (-j(x) * 8 // 6) - 1), layer.hi)
                    yield Layer(new, lo, hi, end, piece or layer.piece, wide=i is not made[0][1])


def _streams(layer: Layer, most: int, cut: list) -> Iterator[Layer]:
    """What compressed streams in a layer hold, members one after another too, then the layer with blanks for them; ``cut`` gets the place of one whose content comes in windows."""
    left, done = StringIO(newline=""), 0
    for m in _NARROW.finditer(layer.text):
        raw, at = None, m.start()
        while x := _MAGIC.search(layer.text, at, m.end()):
            raw = memoryview(m[0].encode("latin-1")) if raw is None else raw
            end, own = [0, False], raw[x.start() - m.start() :]
            # Where a stream ends is known when all of it has been read; its content is read twice if it is large.
            first = next(contents := _contents(own, most, end), None)
            at = x.start() + 1
            if first is None:
                continue
            if not first[1]:
                try:
                    for _ in _parts(own, end):
                        pass
                except Exception:  # noqa: BLE001 - broken, as in _contents
                    continue
                cut.append(x.start())
            a, b = layer.range(x.start(), x.start() + end[0])
            for content, _ in chain([first], contents):
                text = None if content.isascii() else _plain(content)
                text = content.decode("latin-1") if text is None else text
                yield Layer(text, Via(len(text), lambda i, a=a: i * 0 + a), Via(len(text), lambda i, b=b: i * 0 + b), None, layer.piece)
            # Further members follow; what looks like a stream inside one is part of it.
            if end[1]:
                at = x.start() + end[0]
                left.write(layer.text[done : x.start()])
                left.write("\ufffd" * end[0])
                done = at
    left.write(layer.text[done:])
    yield layer._replace(text=left.getvalue(), opened=True)


def _inside(layer: Layer) -> Iterator[Layer]:
    """All layers one step inside a layer without streams."""
    if "%" in layer.text and (new := _replaced(layer, _unquoted(layer))):
        yield new
    if ("\\" in layer.text or "&#" in layer.text) and (new := _replaced(layer, _unescaped(layer))):
        yield new
    if "\0" in layer.text and (new := _replaced(layer, _squeezed(layer))):
        yield new
    yield from _decoded(layer)


def _covered(span: tuple[str, int, int], by: dict) -> bool:
    """Whether a match in one line of a run is a piece of one in the run."""
    kind, a, b = span
    return any(x <= a and b <= y and (x == a or kind == "hex") for x, y in by.get(kind, ()))


def find(text: str, max_layer: int = MAX_LAYER) -> tuple[list, list, bool]:
    """Base matches, all matches (kind, start, end), and whether no stream had to be scanned in windows."""
    base = scan(text)
    found, pieces, seen = set(base), set(), set()
    root = Layer(text, Via(len(text), lambda i: i), Via(len(text), lambda i: i + 1))
    # Layers come one at a time, so that the windows of a large stream are not all held.
    work, cut = [iter([root])], []
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        body, lo, hi = layer[:3]
        if layer is not root:
            mark = (hashlib.sha1(body.encode("utf-8", "surrogatepass")).digest(), int(lo[0]), int(hi[len(body) - 1]), layer.piece, layer.opened, layer.wide) if body else None
            if mark is None or mark in seen:
                continue
            seen.add(mark)
            if not layer.opened and _MAGIC.search(body):
                work.append(_streams(layer, max_layer, cut))
                continue
            if layer.wide:
                continue
            for kind, a, b in scan(body):
                x, y = int(lo[a:b].min()), int(hi[a:b].max())
                if text[x:y] != body[a:b]:
                    (pieces if layer.piece else found).add((kind, x, y))
        work.append(_inside(layer))
    if pieces:
        whole: dict = {}
        for kind, a, b in found:
            whole.setdefault(kind, []).append((a, b))
        found |= {p for p in pieces if not _covered(p, whole)}
    by = lambda x: (x[1], ORDER[x[0]], x[2])
    return sorted(base, key=by), sorted(found, key=by), not cut


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            rows = [find(x.as_py() or "") for x in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id")]
                + [pa.array([sum(k == kind for k, _, _ in b) for b, _, _ in rows], pa.int64()) for kind in KINDS]
                + [pa.array([_joined(x[i]) for x in rows], pa.string()) for i in (0, 1)]
                + [pa.array([c for _, _, c in rows], pa.bool_())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", "complete"],
            )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex of the base, base_spans, spans, complete) for each row; spans as kind:start:end, comma-joined."""
    lean(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_run, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, complete boolean").withColumnRenamed("doc_id", id_col)
