"""Counts that quality operators share, for many texts at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import Words, split_words, window_names

# The classes of bytes, and the characters that count as symbols.
CLASSES = ("lower", "upper", "digit", "blank", "newline", "stop", "symbol", "other", "letter")
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, CLASSES.index("other"), np.uint8)
_CLASS[97:123] = CLASSES.index("lower")
_CLASS[65:91] = CLASSES.index("upper")
_CLASS[48:58] = CLASSES.index("digit")
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = CLASSES.index("blank")
_CLASS[0x0A] = CLASSES.index("newline")
_CLASS[list(b".,;:!?'\"-()")] = CLASSES.index("stop")
_CLASS[list(SYMBOLS)] = CLASSES.index("symbol")
_CLASS[0xC0:] = CLASSES.index("letter")  # the first byte of a character beyond ASCII
_CLASS[0x80:0xC0] = 255  # the others
_OF_CLASS = (_CLASS[:, None] == np.arange(len(CLASSES))).astype(np.int64)
_BLANK = " \t\n\x0b\x0c\r"


def byte_counts(w: Words) -> np.ndarray:
    """How often each byte is in each text."""
    at = w.doc_bytes
    return np.stack([np.bincount(w.data[at[d] : at[d + 1]], minlength=256) for d in range(len(w))]) if len(w) else np.zeros((0, 256), np.int64)


def class_counts(w: Words) -> np.ndarray:
    """Characters of each class, one row for each text."""
    return byte_counts(w) @ _OF_CLASS


def repeat_words(w: Words, n: int = 5) -> np.ndarray:
    """Words of each text in n-word windows found twice or more in it, the first occurrence included."""
    names, out = window_names(w.h, n), np.zeros(len(w), np.int64)
    for d in range(len(w)):
        a, b = w.first[d], w.first[d + 1]
        if b - a <= n:
            continue
        own = names[a : b - n + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            hit = np.zeros(len(own), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            cover = np.zeros(b - a + 1, np.int64)
            cover[:-n] += hit
            cover[n:] -= hit
            out[d] = np.count_nonzero(np.cumsum(cover[:-1]) > 0)
    return out


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    seen, lines, again = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            lines += 1
            if line in seen:
                again += 1
            seen.add(line)
    return lines, again


class Stats:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and classes of each text."""

    def __init__(self, texts: pa.Array, fold: bool = False):
        self.w = w = split_words(texts, fold)
        self.n_words = np.diff(w.first).astype(np.int64)
        self.classes = class_counts(w)
        blank, newline = CLASSES.index("blank"), CLASSES.index("newline")
        self.chars = self.classes.sum(axis=1)
        self.word_chars = self.chars - self.classes[:, blank] - self.classes[:, newline]
        self.n_symbols = self.classes[:, CLASSES.index("symbol")]
        lines = [duplicate_lines(x.as_py() or "") for x in texts]
        self.n_lines = np.array([x for x, _ in lines], np.int64)
        self.n_dup_lines = np.array([y for _, y in lines], np.int64)
        self.n_repeat_words = repeat_words(w)
