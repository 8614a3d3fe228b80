"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the last term in linear time as half of
sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2).  x holds a text's words (A-Z as a-z, hashed to ``slots``, 1 + log of
the count, scaled to unit length), statistics of its structure and its declared length; labels, language, source
and id are no inputs.

The model is fitted on the driver to ``sample`` labelled documents at most (those of the smallest id hashes), a
sample that does not grow with the table; every document is scored on its whole text.

Nulls: a null text is empty and gets a score; a null declared length counts as the true one; rows with a null id
are scored, and held out.  Repeated rows are scored each.  Labels: a null quality or id is no label, of several for
an id the least counts.  Without labels of both kinds every score is 0.5.  Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import lean, received, send
from .textstats import CLASSES, Stats
from .words import U, slices

STATS = 16


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, idx: np.ndarray, val: np.ndarray, at: np.ndarray) -> np.ndarray:
        """at: where each text's entries begin, and the end; each text has some."""
        return 1 / (1 + np.exp(-np.clip(self.margin(idx, val, at)[0], -30, 30)))

    def margin(self, idx: np.ndarray, val: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[idx] * val[:, None]
        total = np.add.reduceat(vx, at[:-1], axis=0)
        own = np.add.reduceat((vx**2).sum(axis=1), at[:-1])
        return self.bias + np.add.reduceat(self.w[idx] * val, at[:-1]) + 0.5 * ((total**2).sum(axis=1) - own), total


def features(texts: pa.Array, lengths: pa.Array, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, their values, where each text's begin (and the end), and a row of statistics for each text."""
    s = Stats(texts, fold=True)
    slot = (s.w.h >> U(20)).astype(np.int64) % slots
    idx, val, at = [], [], [0]
    for d in range(len(s.w)):
        i, n = np.unique(slot[s.w.first[d] : s.w.first[d + 1]], return_counts=True)
        x = 1 + np.log(n)
        idx.append(i)
        val.append(x / np.sqrt((x**2).sum()) if len(x) else x)
        at.append(at[-1] + len(i))
    chars, words, lines = np.maximum(s.chars, 1), np.maximum(s.n_words, 1), np.maximum(s.n_lines, 1)
    told = np.where(pa.compute.is_valid(lengths).to_numpy(zero_copy_only=False), lengths.fill_null(0).to_numpy(zero_copy_only=False), s.chars)
    share = s.classes / chars[:, None]
    cols = [share[:, CLASSES.index(c)] for c in ("lower", "upper", "digit", "blank", "newline", "stop", "symbol", "letter")]
    cols += [np.log1p(s.n_words), s.word_chars / words, s.n_dup_lines / lines, s.n_repeat_words / words, np.diff(at) / words, np.log1p(s.n_words / lines), np.log1p(np.maximum(told, 0)), np.sign(told - s.chars)]
    return np.concatenate([*idx, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*val, np.zeros(0)]).astype(np.float32), np.array(at), np.stack(cols, axis=1).astype(np.float32)


def joined(idx: np.ndarray, val: np.ndarray, at: np.ndarray, stats: np.ndarray, slots: int, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and standardised statistics as one sparse row for each text."""
    n, k = stats.shape
    z = np.clip((stats - mean) / scale, -4, 4) / np.sqrt(k)
    new_at = at + k * np.arange(n + 1)
    out_i, out_v = np.empty(new_at[-1], np.int64), np.empty(new_at[-1], np.float32)
    is_word = np.ones(new_at[-1], bool)
    stat = (new_at[:-1, None] + np.arange(k)).ravel()
    is_word[stat] = False
    out_i[stat], out_v[stat] = np.tile(slots + np.arange(k), n), z.ravel()
    out_i[is_word], out_v[is_word] = idx, val
    return out_i, out_v, new_at


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], slots: int, factors: int = 8, epochs: int = 12, seed: int = 5) -> Machine:
    """Adam on the logistic loss, for (slots, values, statistics, label) of each text, in the order given."""
    rng = np.random.Generator(np.random.PCG64(seed))
    size = slots + STATS
    m = Machine(0.0, np.zeros(size, np.float32), (rng.standard_normal((size, factors)) * 0.05).astype(np.float32), np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    labels = np.array([r[3] for r in rows], np.float32)
    if not len(rows) or labels.min() == labels.max():
        m.v[:] = 0
        return m
    stats = np.stack([r[2] for r in rows])
    m.mean, m.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    first, second, step, bias = np.zeros((size, factors + 1), np.float32), np.zeros((size, factors + 1), np.float32), 0, [0.0, 0.0]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 128):
            own = [rows[i] for i in order[lo : lo + 128]]
            at = np.concatenate([[0], np.cumsum([len(r[0]) for r in own])])
            idx, val, at = joined(np.concatenate([r[0] for r in own]), np.concatenate([r[1] for r in own]), at, np.stack([r[2] for r in own]), slots, m.mean, m.scale)
            y, total = m.margin(idx, val, at)
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[order[lo : lo + 128]]) / len(own)
            doc = np.repeat(np.arange(len(own)), np.diff(at))
            g = error[doc] * val
            touched, place = np.unique(idx, return_inverse=True)
            grad = np.empty((len(touched), factors + 1))
            grad[:, 0] = np.bincount(place, g, len(touched)) + 1e-5 * m.w[touched]
            inner = total[doc] - m.v[idx] * val[:, None]
            for f in range(factors):
                grad[:, f + 1] = np.bincount(place, g * inner[:, f], len(touched)) + 1e-5 * m.v[touched, f]
            step += 1
            first[touched] = 0.9 * first[touched] + 0.1 * grad
            second[touched] = 0.999 * second[touched] + 0.001 * grad**2
            move = 0.02 * (first[touched] / (1 - 0.9**step)) / (np.sqrt(second[touched] / (1 - 0.999**step)) + 1e-6)
            m.w[touched] -= move[:, 0]
            m.v[touched] -= move[:, 1:]
            gb = float(error.sum())
            bias = [0.9 * bias[0] + 0.1 * gb, 0.999 * bias[1] + 0.001 * gb**2]
            m.bias -= 0.02 * (bias[0] / (1 - 0.9**step)) / (np.sqrt(bias[1] / (1 - 0.999**step)) + 1e-6)
    return m


def _remainder(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, sample: int = 8192, slots: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", label_col: str = "quality") -> Machine:
    """A machine for labelled rows whose crc32(id as text) mod 5 is not 0."""
    lean(docs.sparkSession)
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (_remainder(id_col) != 0)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(length_col).cast("long").alias("told"))
    # The sample is bounded by its parameter, so it may be broadcast.
    chosen = chosen.join(F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample)), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                idx, val, at, stats = features(batch.column("text"), batch.column("told"), slots)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(idx, pa.int32())), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(val, pa.float32())), pa.array(list(stats), pa.list_(pa.float32())), batch.column("y")],
                    names=["id", "idx", "val", "stats", "y"],
                )

    got = chosen.mapInArrow(run, "id long, idx array<int>, val array<float>, stats array<float>, y int").toArrow()
    rows, key = [], []
    for batch in got.to_batches():
        for i, idx, val, stats, y in zip(*batch.columns, strict=True):
            key.append((i.as_py(), len(rows)))
            rows.append((idx.values.to_numpy().astype(np.int64), val.values.to_numpy(), stats.values.to_numpy(), y.as_py()))
    return fit([rows[k] for _, k in sorted(key, key=lambda x: (x[0], rows[x[1]][0].tobytes()))], slots)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", slots: int = 1 << 15, **how) -> DataFrame:
    """(id, held_out, score, predicted) for each row."""
    # Weights and factors of a fixed number of slots: about 1 MB.
    sent = send(docs.sparkSession, train(docs, labels, slots=slots, id_col=id_col, text_col=text_col, length_col=length_col, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(sent)
        for whole in batches:
            for batch in slices(whole, "text"):
                idx, val, at, stats = features(batch.column("text"), batch.column("told"), slots)
                score = m.score(*joined(idx, val, at, stats, slots, m.mean, m.scale)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(_remainder(id_col) == 0, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"), F.col(length_col).cast("long").alias("told"))
    return texts.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
