"""Removal of repeated passages by recompression.

Rounds of recompression rename a text from words upwards: maximal runs of one symbol, then pairs of a
left and a right symbol (a hash decides which symbols are left), become new symbols.  The name of a
symbol is a 64-bit fingerprint of its parts, so that all tasks name alike without a dictionary, and
equal passages get equal symbols but for a few at their ends.  Each symbol carries the range of words
that decided it; a symbol is interior to a window if that range lies in it.  Equal windows hence have
the same interior symbols.  A window is represented by its first interior symbol in an order that
prefers long ones; consecutive windows with the same one form a group: one row for about ten words.

A group whose symbol nobody shares holds no repeat.  Groups alike in symbol, place and words repeat as a
whole.  Only groups that share a symbol and differ, at the ends of repeats, have their windows compared one
by one.  Names only propose: what is compared are the words themselves, by a 128-bit cryptographic digest
(BLAKE2b), and no word is removed unless those agree.

Nulls: a null text has no words; null ids are ids like others.  Rows that repeat an id and a text are
occurrences of their own, and so repeats.  Texts shorter than a window keep all words.  Empty input: no
rows.  Ids are integers or what casts to them.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import BASE, U, Words, mix, slices, split_words, window_names

ROUNDS, WIDEST = 4, 14
GROUP = "doc_id long, t long, i0 int, i1 int, name long, span long, span2 long"
SPAN = ["span", "span2"]


def rename(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, widest: int = WIDEST) -> tuple[np.ndarray, ...]:
    """Symbols after the rounds: name, first word, word after the last, and the range of words that decided it.

    ``first``: the first word of each text, and the end.  At the end of a text the range goes beyond it.
    """
    n = len(h)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, stop = first[:-1][doc], first[1:][doc]
    sym, a, b = h.copy(), np.arange(n), np.arange(1, n + 1)
    lo, hi = a.copy(), b.copy()
    for r in range(rounds):
        if len(sym) < 2:
            break
        joined = doc[1:] == doc[:-1]
        if r == 0:
            # Runs: a word run no wider than ``widest`` becomes one symbol.
            head = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | ~joined]))
            tail = np.concatenate([head[1:], [len(sym)]]) - 1
            k = tail - head + 1
            before = np.where(a[head] > start[head], a[head] - 1, start[head] - 1)
            after = np.where(b[tail] < stop[tail], b[tail] + 1, stop[tail] + 1)
            wide = k > widest
            if wide.any():
                # Wider ones stay words, decided by the whole run.
                each = np.where(wide, k, 1)
                at = np.repeat(head, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                run = np.repeat(np.arange(len(head)), each)
                single = wide[run]
                new_a, new_b = a[at], np.where(single, b[at], b[tail[run]])
                k, lo, hi, sym = np.where(single, 1, k[run]), before[run], after[run], sym[at]
            else:
                new_a, new_b, lo, hi, sym, at = a[head], b[tail], before, after, sym[head], head
            a, b, doc, start, stop = new_a, new_b, doc[at], start[at], stop[at]
            sym = np.where(k > 1, mix(sym + k.astype(U) * U(BASE)), sym)
            joined = doc[1:] == doc[:-1]
        right = (mix(sym ^ U(0x9E3779B97F4A7C15 * (r + 1) & (2**64 - 1))) & U(1)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = joined & ~right[:-1] & right[1:] & (b[1:] - a[:-1] <= widest)
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        # What stays alone was decided by the neighbour that it could have joined.
        has_next = np.zeros(len(sym), bool)
        has_next[:-1] = joined
        has_last = np.zeros(len(sym), bool)
        has_last[1:] = joined
        next_hi = np.where(has_next, np.concatenate([hi[1:], hi[:1]]), stop + 1)
        last_lo = np.where(has_last, np.concatenate([lo[:1], lo[:-1]]), start - 1)
        alone = ~pair & ~second
        new_hi = np.where(alone & ~right, np.maximum(hi, next_hi), hi)
        new_lo = np.where(alone & right, np.minimum(lo, last_lo), lo)
        p = np.flatnonzero(pair)
        name = sym.copy()
        name[p] = mix(sym[p] * U(BASE) + sym[p + 1])
        new_hi[p] = np.maximum(hi[p], hi[p + 1])
        new_lo[p] = np.minimum(lo[p], lo[p + 1])
        end = b.copy()
        end[p] = b[p + 1]
        keep = ~second
        sym, a, b, lo, hi, doc, start, stop = name[keep], a[keep], end[keep], new_lo[keep], new_hi[keep], doc[keep], start[keep], stop[keep]
        # Ranges never shrink from one symbol to the next, so that a window's interior symbols are neighbours.
        hi = np.maximum.accumulate(hi)
        lo = np.minimum.accumulate(lo[::-1])[::-1]
    return sym, a, b, lo, hi


def groups(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Windows of n words, grouped: first word of the first and of the last window, name, place of the symbol after the
    first window's start (-1 for a window without one, named by itself), text."""
    starts = np.concatenate([np.arange(x, y - n + 1) for x, y in zip(first[:-1], first[1:], strict=True)]) if len(first) > 1 else np.zeros(0, int)
    text = np.repeat(np.arange(len(first) - 1), np.maximum(np.diff(first) - n + 1, 0))
    if not len(starts):
        z = np.zeros(0, int)
        return z, z, np.zeros(0, U), z, z
    sym, a, b, lo, hi = rename(h, first)
    x = np.searchsorted(lo, starts, side="left")
    y = np.searchsorted(hi, starts + n, side="right")
    order = (mix(sym) >> U(8)) | ((U(255) - (b - a).astype(U)) << U(56))
    best = _first_least(order, x, y)
    names = window_names(h, n)
    bare = best < 0
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | bare[1:] | (text[1:] != text[:-1])
    # Of equal windows in a row, each of which repeats another, the first makes one group and the rest a second one.
    like = np.zeros(len(starts), bool)
    like[1:] = bare[1:] & bare[:-1] & (text[1:] == text[:-1]) & (names[starts[1:]] == names[starts[:-1]])
    new[1:] &= ~(like[1:] & like[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(starts)]]) - 1
    at = best[head]
    none = at < 0
    name = np.where(none, names[starts[head]], mix(sym[at] + U(1)))
    place = np.where(none, -1, a[at] - starts[head])
    return starts[head], starts[tail], name, place, text[head]


def _first_least(order: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first index of the least value in each [x, y); -1 for an empty range."""
    out = np.full(len(x), -1)
    some = np.flatnonzero(y > x)
    if not len(some):
        return out
    levels, width = [np.arange(len(order))], 1
    while width * 2 <= (y - x).max():
        p = levels[-1]
        q = p[width:]
        p = p[: len(q)]
        levels.append(np.where(order[q] < order[p], q, p))
        width *= 2
    k = np.frexp((y - x)[some])[1] - 1
    for level in range(len(levels)):
        own = some[k == level]
        p, q = levels[level][x[own]], levels[level][y[own] - (1 << level)]
        out[own] = np.where(order[q] < order[p], q, p)
    return out


class Spans:
    """Words one after the other, each followed by a blank, so that equal words are equal bytes whatever stood between them."""

    def __init__(self, w: Words):
        size = w.ends - w.starts
        self.at = np.concatenate([[0], np.cumsum(size + 1)])
        word = np.repeat(np.arange(len(size)), size)
        out = np.full(self.at[-1], 32, np.uint8)
        within = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        out[self.at[word] + within] = w.data[w.starts[word] + within]
        self.body = memoryview(out)

    def digests(self, i0: np.ndarray, i1: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Digests, as two longs, of the words [i0, i1) and a place."""
        salts = [int(x).to_bytes(4, "little", signed=True) for x in range(-1, int(place.max(initial=-1)) + 1)]
        ends = zip(self.at[i0].tolist(), self.at[i1].tolist(), (place + 1).tolist(), strict=True)
        raw = b"".join(blake2b(self.body[a:b], digest_size=16, salt=salts[k]).digest() for a, b, k in ends)
        return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _grouped(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = split_words(batch.column("text"))
                i0, i1, name, place, doc = groups(w.h, w.first, n)
                bare = place == -1
                span = Spans(w).digests(i0, np.where(bare, i0, i1) + n, place)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(doc)),
                        batch.column("t").take(pa.array(doc)),
                        pa.array((i0 - w.first[doc]).astype(np.int32)),
                        pa.array((i1 - w.first[doc]).astype(np.int32)),
                        pa.array(name.view(np.int64)),
                        pa.array(span[:, 0]),
                        pa.array(span[:, 1]),
                    ],
                    names=[x.split()[0] for x in GROUP.split(", ")],
                )

    return run


def _windows(n: int):
    """Each window of the listed groups, with its group's name and its own digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                w = split_words(batch.column("text"))
                found = batch.column("found")
                rows = found.flatten()
                i0, i1 = rows.field("i0").to_numpy(), rows.field("i1").to_numpy()
                of = np.repeat(np.arange(len(batch)), found.value_lengths().to_numpy())
                size = (i1 - i0 + 1).astype(np.int64)
                each = np.repeat(np.arange(len(rows)), size)
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + i0[each]
                doc = pa.array(of[each])
                first = w.first[of[each]] + pos
                span = Spans(w).digests(first, first + n, np.full(len(first), -1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(doc),
                        batch.column("t").take(doc),
                        pa.array(pos.astype(np.int32)),
                        rows.field("name").take(pa.array(each)),
                        pa.array(span[:, 0]),
                        pa.array(span[:, 1]),
                        rows.field("times").take(pa.array(each)),
                    ],
                    names=["doc_id", "t", "pos", "name", *SPAN, "times"],
                )

    return run


def _remove(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                total, removed, texts = [], [], []
                for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                    words = (text.as_py() or "").encode().split()
                    total.append(len(words))
                    gone = np.zeros(len(words) + 1, np.int64)
                    if found.is_valid:
                        rows = found.values
                        np.add.at(gone, rows.field("i0").to_numpy(), 1)
                        np.add.at(gone, rows.field("i1").to_numpy() + n, -1)
                        stay = np.cumsum(gone[:-1]) == 0
                        words = [words[i] for i in np.flatnonzero(stay)]
                    removed.append(total[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text) for each row: words in a window that occurs elsewhere go, the rest is joined by a space."""
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
    found = scratch.keep(texts.mapInArrow(_grouped(window), GROUP))
    # A table of its own: a join whose sides are both plain shuffles can have its hot partitions split.
    shared = scratch.keep(found.groupBy("name").agg(F.count(F.lit(1)).alias("k"), *[f(c).alias(f"{c}_{x}") for c in SPAN for x, f in (("lo", F.min), ("hi", F.max))]).filter("k > 1"))
    alike = scratch.keep(found.join(shared.select("name", F.expr("span_lo = span_hi and span2_lo = span2_hi").alias("whole")), "name"))
    scratch.drop(found, shared)
    whole = alike.filter("whole").select("doc_id", "t", "i0", "i1")
    mixed = alike.filter("not whole")
    kinds = mixed.groupBy("name", *SPAN).agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc_id", "t", "i0", "i1")).alias("one"))
    kinds = scratch.keep(kinds)
    repeated = scratch.keep(mixed.join(kinds.filter("k > 1").select("name", *SPAN), ["name", *SPAN], "left_semi").select("doc_id", "t", "i0", "i1"))
    single = kinds.select("one.*", "name", F.least("k", F.lit(2)).cast("int").alias("times"))
    at = scratch.keep(single.groupBy("doc_id", "t").agg(F.collect_list(F.struct("i0", "i1", "name", "times")).alias("found")))
    same = (F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))) & (F.col("l.t") == F.col("r.t"))
    # Rows equal in id and text were counted one by one above; one of them is enough here.
    those = texts.alias("l").join(at.alias("r"), same).select("l.doc_id", "l.t", "l.text", "r.found")
    windows = scratch.keep(those.mapInArrow(_windows(window), "doc_id long, t long, pos int, name long, span long, span2 long, times int"))
    often = windows.groupBy("name", *SPAN).agg(F.sum("times").alias("k")).filter("k > 1").select("name", *SPAN)
    ends = windows.filter("times = 1").join(often, ["name", *SPAN], "left_semi").select("doc_id", "t", F.col("pos").alias("i0"), F.col("pos").alias("i1"))
    gone = scratch.keep(whole.union(repeated).union(ends).groupBy("doc_id", "t").agg(F.collect_list(F.struct("i0", "i1")).alias("found")))
    scratch.drop(alike, kinds, repeated, at, windows)
    out = texts.alias("l").join(gone.alias("r"), same, "left").select("l.doc_id", "l.text", "r.found")
    return out.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_text string").withColumnRenamed("doc_id", id_col)
