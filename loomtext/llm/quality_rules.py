"""Quality rules by distribution divergence.

References are learned from all documents: for each language, the histogram of character classes and that of
common words.  A word is common in a language if it makes up ``least_share`` of its words (so there are at most
1 / least_share); all others count as one.  A language has a reference if it has ``least_language`` words, however
many others have.  A document is compared with its language's reference, or, if its language is null, with the
nearest; it is not compared if its language has none.  It is rejected if the Jensen-Shannon distance (root of the divergence in bits) of either histogram is over its limit.
Guards: texts under ``least_words`` words are not compared, their histograms being noise, and the limit of the words'
histogram is widened by what chance alone brings in a text and a reference of those lengths.

Base rules come first: fewer than 10 words, or over 20% of the words in repeated 5-word windows, fails.

Nulls: a null text has no words, and so fails; null ids and languages are ids and languages like others.  Repeated
rows are judged each.  Empty input: no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean, received, send
from .textstats import CLASSES, Stats, class_counts
from .words import U, name_words, slices, split_words

OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"


@dataclass
class Rules:
    class_limit: float = 0.25
    word_limit: float = 0.35
    least_words: int = 50
    least_share: float = 0.004
    least_language: int = 1000


@dataclass
class Common:
    """Names of common words (sorted), and for each a stretch from ``first`` of the languages it is common in, with its share there."""

    names: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    share: np.ndarray
    rest: np.ndarray
    count: np.ndarray

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Jensen-Shannon distance of a text's words from each language's, over that language's common words and the rest."""
        total, size = np.zeros(len(self.rest)), len(own)
        seen, q = np.zeros(0, np.int64), np.zeros(0)
        if len(self.names):
            slot = np.minimum(np.searchsorted(self.names, own), len(self.names) - 1)
            n = np.bincount(slot[self.names[slot] == own], minlength=len(self.names))
            hit = np.flatnonzero(n)
            much = self.first[hit + 1] - self.first[hit]
            seen = np.repeat(self.first[hit] - np.cumsum(much) + much, much) + np.arange(much.sum())
            q = np.repeat(n[hit] / size, much)
        owner, s, langs = self.owner[seen], self.share[seen], len(self.rest)
        total += np.bincount(owner, _apart(q, s), langs)
        # A common word that the text lacks differs by its whole share.
        total += np.maximum(1 - self.rest - np.bincount(owner, s, langs), 0)
        total += _apart(np.maximum(1 - np.bincount(owner, q, langs), 0), self.rest)
        return np.sqrt(np.maximum(total / 2, 0))


@dataclass
class References:
    """Languages, a row of class shares and a number of words for each, and their common words: of each, and of all for texts without a language."""

    languages: list
    classes: np.ndarray
    sizes: np.ndarray
    each: list[Common]
    all: Common | None


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Twice the part of the divergence in bits that shares p and q of one thing bring."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(2 * p / (p + q)), 0) + np.where(q > 0, q * np.log2(2 * q / (p + q)), 0)


def _common(langs: np.ndarray, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> Common:
    order = np.lexsort((langs, words))
    langs, words = langs[order], words[order]
    share = counts[order] / sizes[langs]
    names, first = np.unique(words, return_index=True)
    rest = np.maximum(1 - np.bincount(langs, share, len(sizes)), 0)
    return Common(names, np.append(first, len(words)), langs, share, rest, np.bincount(langs, minlength=len(sizes)))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of rows of p from rows of q."""
    m = (p + q) / 2

    def kl(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=-1)

    return np.sqrt(np.maximum((kl(p) + kl(q)) / 2, 0))


def _language_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters of each class and words, by language; a row for each language of a slice."""
    for whole in batches:
        for batch in slices(whole, "text"):
            w = split_words(batch.column("text"), hashes=False)
            counts, words, langs = class_counts(w), np.diff(w.first), batch.column("lang").to_pylist()
            keys = sorted(set(langs))
            place = {k: i for i, k in enumerate(keys)}
            of = np.array([place[x] for x in langs])
            total, n = np.zeros((len(keys), len(CLASSES)), np.int64), np.zeros(len(keys), np.int64)
            np.add.at(total, of, counts)
            np.add.at(n, of, words)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(n), pa.array(list(total), pa.list_(pa.int64()))], names=["lang", "n", "classes"])


def _language_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word (A-Z as a-z) by language, combined for each slice before the shuffle."""
    for whole in batches:
        for batch in slices(whole, "text"):
            w = split_words(batch.column("text"), fold=True)
            langs = batch.column("lang").to_pylist()
            rows: dict = {}
            for d, lang in enumerate(langs):
                rows.setdefault(lang, []).append(w.h[w.first[d] : w.first[d + 1]])
            for lang, parts in rows.items():
                names, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names.view(np.int64)), pa.array(counts)], names=["lang", "word", "n"])


def references(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> References:
    """Counts over all documents; what comes to the driver is bounded by the shares, 1 / least_share words for each language."""
    spark = docs.sparkSession
    lean(spark)
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("text is not null and lang is not null")
    per = texts.mapInArrow(_language_classes, "lang string, n long, classes array<long>").groupBy("lang")
    per = per.agg(F.sum("n").alias("n"), *[F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))])
    found = sorted(per.filter(F.col("n") >= max(1, rules.least_language)).collect())
    if not found:
        return References([], np.zeros((0, len(CLASSES))), np.zeros(0), [], None)
    classes, sizes = np.array([r[2:] for r in found], float), np.array([r[1] for r in found], float)
    listed = F.broadcast(spark.createDataFrame([(r[0], i, float(r[1] * rules.least_share)) for i, r in enumerate(found)], "lang string, i int, least double"))
    counted = texts.join(listed, "lang", "left_semi").mapInArrow(_language_words, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = counted.join(listed, "lang").filter("n >= least").select("i", "word", "n").toArrow()
    langs, counts = got["i"].to_numpy().astype(np.int64), got["n"].to_numpy()
    words = np.ascontiguousarray(got["word"].to_numpy()).astype(np.int64).view(U)
    order = np.argsort(langs, kind="stable")
    edges = np.searchsorted(langs[order], np.arange(len(found) + 1))
    own = [order[edges[i] : edges[i + 1]] for i in range(len(found))]
    each = [_common(langs[x] * 0, words[x], counts[x], sizes[i : i + 1]) for i, x in enumerate(own)]
    return References([r[0] for r in found], classes / np.maximum(classes.sum(axis=1, keepdims=True), 1), sizes, each, _common(langs, words, counts, sizes))


def judge(texts: pa.Array, langs: list, ref: References, rules: Rules) -> tuple[Stats, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, base_failed, both distances (NaN where guarded) and kept."""
    s = Stats(texts, fold=False)
    failed = (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)
    by_class, by_word = np.full(len(langs), np.nan), np.full(len(langs), np.nan)
    folded = name_words(s.w.data, s.w.starts, s.w.ends, fold=True)
    over = np.zeros(len(langs), bool)
    place = {x: i for i, x in enumerate(ref.languages)}
    for d, lang in enumerate(langs):
        n = int(s.n_words[d])
        if n < rules.least_words or not place or (lang is not None and lang not in place):
            continue
        p = s.classes[d] / s.chars[d]
        own = folded[s.w.first[d] : s.w.first[d + 1]]
        rows = slice(None) if lang is None else slice(place[lang], place[lang] + 1)
        words = ref.all if lang is None else ref.each[place[lang]]
        c, v = distance(p[None, :], ref.classes[rows]), words.distances(own)
        near = int(np.argmin(c / rules.class_limit + v / rules.word_limit))
        by_class[d], by_word[d] = c[near], v[near]
        chance = np.sqrt(words.count[near] / (8 * np.log(2)) * (1 / n + 1 / ref.sizes[rows][near]))
        over[d] = by_class[d] > rules.class_limit or by_word[d] > rules.word_limit + chance
    return s, failed, by_class, by_word, ~failed & ~over


def apply_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", ref: References | None = None) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept) for each row."""
    # At most 1 / least_share words of each language that has a reference.
    sent = send(docs.sparkSession, ref or references(docs, rules, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(sent)
        for whole in batches:
            for batch in slices(whole, "text"):
                s, failed, c, v, kept = judge(batch.column("text"), batch.column("lang").to_pylist(), known, rules)
                cols = [s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words]
                more = [pa.array(failed), pa.array(c, from_pandas=True), pa.array(v, from_pandas=True), pa.array(kept)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in cols], *more], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, OUT).withColumnRenamed("doc_id", id_col)


def kept_rows(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    sent = send(docs.sparkSession, references(docs, rules, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(sent)
        for whole in batches:
            for batch in slices(whole, text_col):
                kept = judge(batch.column(text_col), batch.column(lang_col).cast(pa.string()).to_pylist(), known, rules)[-1]
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
