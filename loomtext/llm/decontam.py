"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

A benchmark item of n words is a bag of its five-word shingles (A-Z as a-z; an item of fewer words has
shingles of its own length), each weighing its number of occurrences.  In a document every window of
n words (the whole document, if shorter) that holds any shingle of an item of that size gets a 256-bit
SimHash (the others have similarity 0).  The j-th occurrence of a shingle in a bag is an element of its own, so
that two bags of weighted Jaccard similarity 0.75 share 6/7 of their elements however they are spread, and each bit differs
with a chance of acos(6/7) / pi = 0.172.  Fingerprints are cut in BLOCKS blocks of 64 bits: two within RADIUS
agree in some block up to RADIUS // BLOCKS bits, so that the blocks find all pairs within RADIUS, and 0.7% of
random ones.  At 0.75 a pair strays beyond RADIUS with a chance of 1e-9, above 0.75 with less.  A candidate is a leak
if the weighted Jaccard similarity of the two bags, taken exactly, is 0.75 or more.

The benchmark goes to the executors in blocks of about ``bytes_per_block`` bytes of text, one pass over the documents
for each, so that what is broadcast is bounded whatever the benchmark's size.

Nulls: a null text, or item, has no words and no leak; a null id is reported as null.  Repeated rows are
reported each.  Empty tables: no rows.  Ids are integers or what casts to them.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, lean, received, send
from .words import U, mix, slices, split_words, window_names

SHINGLE, BLOCKS, RADIUS = 5, 4, 83
NEAR = RADIUS // BLOCKS
_SALTS = mix(np.arange(101, 101 + BLOCKS, dtype=U))
#: Pairs of a window and an item looked at together, and windows fingerprinted together.
PAIRS, WINDOWS = 1 << 18, 1 << 11
LEAK = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming int"


def _signs(names: np.ndarray, nth: int = 1) -> np.ndarray:
    """One row of 64 BLOCKS numbers, 1 or -1, for the nth occurrence of each shingle."""
    own = mix(names[:, None] ^ (_SALTS + U(nth * 0x9E3779B97F4A7C15 & (2**64 - 1)))[None, :])
    return np.unpackbits(own.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _again(names: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For j = 1, 2, ...: places whose shingle is found j times or more in the ``width`` - 1 before, and the place of the j-th before."""
    order = np.argsort(names, kind="stable")
    j = 1
    while j < len(names):
        late, early = order[j:], order[:-j]
        near = (names[late] == names[early]) & (late - early < width)
        if not near.any():
            return
        yield j, late[near], early[near]
        j += 1


def simhash(names: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of ``width`` shingles, a row of BLOCKS words for each."""
    out = []
    for lo in range(0, len(names) - width + 1, WINDOWS):
        own = names[lo : lo + WINDOWS + width - 1]
        n = len(own) - width + 1
        sums = np.zeros((len(own) + 1, 64 * BLOCKS), np.int32)
        np.cumsum(_signs(own), axis=0, out=sums[1:])
        total = sums[width:] - sums[:n]
        step = None
        for j, late, early in _again(own, width):
            # In windows from where it enters to that of its j-th predecessor, the element is the (j + 1)-th.
            step = np.zeros((n + 1, 64 * BLOCKS), np.int32) if step is None else step
            change = _signs(own[late], j + 1) - _signs(own[late], j)
            np.add.at(step, np.minimum(np.maximum(late - width + 1, 0), n), change)
            np.subtract.at(step, np.minimum(early + 1, n), change)
        if step is not None:
            total = total + np.cumsum(step[:n], axis=0)
        out.append(np.packbits(total > 0, axis=1).view(U))
    return np.concatenate(out) if out else np.zeros((0, BLOCKS), U)


class Size:
    """Items of one number of words: bags and fingerprints."""

    def __init__(self, n: int):
        self.n, self.k = n, min(SHINGLE, n)
        self.width, self.ids, self.bags = n - self.k + 1, [], []

    def close(self) -> None:
        self.prints = np.concatenate([simhash(names, self.width) for names in self.bags])
        self.bags = [np.unique(names, return_counts=True) for names in self.bags]

    def agreeing(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window and item of all pairs that agree in some block up to NEAR bits, PAIRS pairs looked at together."""
        items = max(1, min(len(self.ids), PAIRS))
        rows = max(1, PAIRS // items)
        for lo in range(0, len(prints), rows):
            for first in range(0, len(self.ids), items):
                own, theirs = prints[lo : lo + rows], self.prints[first : first + items]
                some = np.bitwise_count(own[:, None, 0] ^ theirs[None, :, 0]) <= NEAR
                for block in range(1, BLOCKS):
                    some |= np.bitwise_count(own[:, None, block] ^ theirs[None, :, block]) <= NEAR
                win, item = np.nonzero(some)
                yield win + lo, item + first

    def within(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Window, item and distance of all pairs within RADIUS, in parts."""
        for win, item in self.agreeing(prints):
            far = np.bitwise_count(prints[win] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
            near = far <= RADIUS
            yield win[near], item[near], far[near]


class Index:
    """Sizes, and which of them have an item with a given shingle."""

    def __init__(self, items: list[tuple]):
        self.sizes: list[Size] = []
        by: dict[int, Size] = {}
        w = split_words(pa.array([t for _, t in items], pa.string()), fold=True)
        for i, (item_id, _) in enumerate(items):
            h = w.h[w.first[i] : w.first[i + 1]]
            if len(h):
                if len(h) not in by:
                    by[len(h)] = Size(len(h))
                    self.sizes.append(by[len(h)])
                s = by[len(h)]
                s.ids.append(item_id)
                s.bags.append(window_names(h, s.k))
        self.lookup = {}
        for k in sorted({s.k for s in self.sizes}):
            pairs = [(np.unique(np.concatenate(s.bags)), z) for z, s in enumerate(self.sizes) if s.k == k]
            names, of = np.concatenate([x for x, _ in pairs]), np.concatenate([np.full(len(x), z) for x, z in pairs])
            order = np.argsort(names, kind="stable")
            names, of = names[order], of[order]
            keys, at = np.unique(names, return_index=True)
            self.lookup[k] = keys, np.append(at, len(names)), of
        for s in self.sizes:
            s.close()

    def hits(self, k: int, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and size of each shingle that an item of that size has."""
        keys, at, of = self.lookup[k]
        slot = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
        pos = np.flatnonzero(keys[slot] == names)
        slot = slot[pos]
        count = at[slot + 1] - at[slot]
        each = np.repeat(at[slot], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(pos, count), of[each]


def _leaks(size: Size, names: np.ndarray, similarity: float) -> Iterator[tuple]:
    """Item, similarity, first shingle and distance of every window that verifies."""
    width, shared = min(size.width, len(names)), {}
    for lo in range(0, len(names) - width + 1, WINDOWS):
        for win, item, far in size.within(simhash(names[lo : lo + WINDOWS + width - 1], width)):
            for q in np.unique(item):
                keys, counts = size.bags[q]
                if q not in shared:
                    slot = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
                    member = keys[slot] == names
                    shared[q] = slot, member, np.concatenate([[0], np.cumsum(member)])
                slot, member, sums = shared[q]
                own = win[item == q] + lo
                most = sums[own + width] - sums[own]
                # At most so many are shared; repeated shingles may lower it.
                fit = 100 * most >= round(100 * similarity) * (width + size.width - most)
                for i, d in zip(own[fit], far[item == q][fit], strict=True):
                    part = slot[i : i + width][member[i : i + width]]
                    both = int(np.minimum(np.bincount(part, minlength=len(keys)), counts).sum())
                    union = width + size.width - both
                    if 100 * both >= round(100 * similarity) * union:
                        yield size.ids[q], both / union, int(i), int(d)


def find_in(batch: pa.RecordBatch, index: Index, similarity: float) -> Iterator[tuple]:
    """The best window (the first of equals) for each row and item that leaks."""
    w = split_words(batch.column("text"), fold=True)
    doc = np.repeat(np.arange(len(w)), np.diff(w.first))
    best: dict[tuple, tuple] = {}
    for k in index.lookup:
        names = window_names(w.h, k)
        whole = doc[: len(names)] == doc[k - 1 :] if len(names) else np.zeros(0, bool)
        pos, size = index.hits(k, names)
        inside = whole[pos]
        pos, size = pos[inside], size[inside]
        order = np.lexsort((pos, size, doc[pos]))
        pos, size = pos[order], size[order]
        reach = np.array([s.width for s in index.sizes])
        cut = np.ones(len(pos), bool)
        cut[1:] = (size[1:] != size[:-1]) | (doc[pos[1:]] != doc[pos[:-1]]) | (pos[1:] - pos[:-1] > 2 * reach[size[1:]])
        heads = np.flatnonzero(cut)
        if not len(heads):
            continue
        for a, b in zip(heads, np.append(heads[1:], len(pos)), strict=True):
            s, d = index.sizes[size[a]], doc[pos[a]]
            first, last = w.first[d], w.first[d + 1] - k + 1
            lo, hi = max(first, pos[a] - s.width + 1), min(last, pos[b - 1] + s.width)
            if 100 * (hi - lo) < round(100 * similarity) * s.width:
                continue
            for item, sim, start, far in _leaks(s, names[lo:hi], similarity):
                new = (-sim, int(lo + start - first), min(s.n, int(last - first) + k - 1), far)
                if (d, item) not in best or new < best[d, item]:
                    best[d, item] = new
    for (d, item), (sim, start, n, far) in sorted(best.items(), key=lambda x: (x[0][0], x[1])):
        yield int(d), item, -sim, start, n, far


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", bytes_per_block: int = 1 << 24) -> DataFrame:
    """(id, item_id, similarity, start_word, n_words, hamming): one row for each document and item that it contains."""
    lean(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bytes_per_block))

    def searched(block: int) -> DataFrame:
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        sent = send(spark, Index([tuple(r) for r in own.collect()]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = received(sent)
            for whole in batches:
                for batch in slices(whole, "text"):
                    rows = list(find_in(batch, index, similarity))
                    if rows:
                        d, item, sim, start, n, far = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(d)), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(far, pa.int32())],
                            names=["doc_id", "item_id", "similarity", "start_word", "n_words", "hamming"],
                        )

        return texts.mapInArrow(run, LEAK)

    return reduce(DataFrame.union, map(searched, range(blocks))).withColumnRenamed("doc_id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns. A row with a null id stays."""
    id_col = how.get("id_col", "doc_id")
    leaky = Scratch(docs.sparkSession, "leaks").keep(find_leaks(docs, benchmark, **how).select(F.col(id_col).alias("__lt_id")).distinct())
    few = F.broadcast(leaky) if leaky.count() <= 1_000_000 else leaky
    return docs.join(few, F.col(id_col).cast("long") == F.col("__lt_id"), "left_anti")
