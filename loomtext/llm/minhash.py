"""Near-duplicates by min-max hashing: one permutation gives a signature its minimum and its maximum.

A text's set holds its distinct five-word shingles (A-Z as a-z; with fewer words, the whole sequence).
Texts of one set form a class.  64 permutations give 128 signature values in 32 bands of 4, so that a
pair at similarity 0.75 shares no band with a chance of 5e-6; the minimum and the maximum of one
permutation are never in one band.  Pairs in a band's bucket are tried around centres first, in rounds;
classes that still share a bucket and are apart are then tried wherever they share one of their rarest
shingles (an exact condition, see ``_residual``).  Each link is confirmed on the full sets.  Two classes
already connected need no trial, so that a group of many copies costs a few trials for each, not one for
each pair; no bucket, partner or candidate is capped.

Nulls: a null text, or one without words, has an empty set and is linked with nothing.  Rows with a
null id are linked with nothing and kept.  Rows that share an id are one document: those that repeat a
text count once, those with different texts link what each of their texts is linked with.
Empty input: no rows.  Ids are integers or what casts to them.  Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .words import BASE, U, mix, shingles, slices, split_words, window_names

PERMUTATIONS, ROWS = 64, 4
_rng = np.random.Generator(np.random.PCG64(4242))
MULTIPLIERS = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
BANDS = 2 * PERMUTATIONS // ROWS
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
#: Pairs whose signatures agree in fewer values than this share are not tried: seven deviations below 0.75.
LEAST_AGREEMENT = 0.48
KEY = ["set_a", "set_b", "n_shingles"]
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig binary, bands array<long>"
#: Ids of up to this many rows are broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Counts of shingles that order a set, by a hash of the shingle (4 MB broadcast).
COUNTERS = 1 << 20


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all permutations, then maxima: one row of 128 for each set, none of them empty."""
    out = np.empty((len(sets), 2 * PERMUTATIONS), U)
    if sets:
        flat = np.concatenate(sets)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for p in range(PERMUTATIONS):
            v = flat * MULTIPLIERS[p]
            v ^= v >> U(32)
            out[:, p] = np.minimum.reduceat(v, at)
            out[:, PERMUTATIONS + p] = np.maximum.reduceat(v, at)
    return out


def band_names(sig: np.ndarray) -> np.ndarray:
    """One 64-bit name for each band of each signature; the band's number is part of it."""
    four = sig.reshape(len(sig), BANDS, ROWS)
    out = _SALT[None, :] + four[:, :, 0]
    for k in range(1, ROWS):
        out = out * U(BASE) + four[:, :, k]
    return mix(out)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            w = split_words(batch.column("text"), fold=True)
            names = window_names(w.h, 5)
            sets = [shingles(w, d, names) for d in range(len(w))]
            some = [i for i, s in enumerate(sets) if len(s)]
            a, b = np.zeros(len(w), U), np.zeros(len(w), U)
            for i in some:
                a[i], b[i] = _fingerprint(sets[i])
            sig = signatures([sets[i] for i in some])
            bands = band_names(sig).view(np.int64)
            small = (sig >> U(24)).astype(np.uint8)
            row = {i: k for k, i in enumerate(some)}
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    pa.array([small[row[i]].tobytes() if i in row else None for i in range(len(sets))], pa.binary()),
                    pa.array([bands[row[i]] if i in row else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"],
            )


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a set."""
    return int(mix(s).sum()), int(mix(s ^ U(BASE)).sum())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of texts whose set is the one asked for (of the texts of a repeated id, one may be)."""
    for whole in batches:
        for batch in slices(whole, "text"):
            w = split_words(batch.column("text"), fold=True)
            names = window_names(w.h, 5)
            sets = [shingles(w, d, names) for d in range(len(w))]
            asked = zip(*(batch.column(c).to_numpy().view(U).tolist() for c in ("set_a", "set_b")), strict=True)
            same = [i for i, (s, want) in enumerate(zip(sets, asked, strict=True)) if len(s) and _fingerprint(s) == want]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(same, pa.int64())), pa.array([sets[i].view(np.int64) for i in same], pa.list_(pa.int64()))], names=["node", "sh"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree well enough to be worth a trial."""
    for batch in batches:
        if len(batch):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in ("sig_a", "sig_b"))
            # One byte of each value is kept, so that 1 in 256 agrees by chance.
            batch = batch.filter(pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT))
        yield batch.select(["a", "b", "n_a", "n_b"])


class Corpus:
    """Texts, their classes (node, its key, the least id of it) and the classes' signatures."""

    def __init__(self, texts: DataFrame, classes: DataFrame, reps: DataFrame, unique: bool, scratch: Scratch):
        self.texts, self.classes, self.reps, self.unique, self.scratch = texts, classes, reps, unique, scratch

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, sh): the sets of some classes."""
        asked = self.scratch.keep(self.classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc_id"), "node", "set_a", "set_b"))
        few = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
        got = self.texts.join(few, "doc_id").select("node", "set_a", "set_b", "text").mapInArrow(_sets, "node long, sh array<long>")
        return self.scratch.keep(got if self.unique else got.dropDuplicates(["node"]))


def _links(pairs: DataFrame, corpus: Corpus, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) with this similarity of their full sets."""
    scratch = corpus.scratch
    sig = corpus.reps.select("node", "sig")
    near = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    near = scratch.keep(near.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(_agreement, "a long, b long, n_a long, n_b long"))
    sets = corpus.sets(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
    got = near.join(sets.select(F.col("node").alias("a"), F.col("sh").alias("sh_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("sh").alias("sh_b")), "b")
    both = F.size(F.array_intersect("sh_a", "sh_b"))
    links = scratch.keep(got.withColumn("both", both).filter(F.col("both") * 100 >= round(similarity * 100) * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))
    scratch.drop(near, sets)
    return links


def _pairs(rows: DataFrame, x: Column, n_x: Column, y: Column, n_y: Column) -> DataFrame:
    return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(x < y, n_x).otherwise(n_y).alias("n_a"), F.when(x < y, n_y).otherwise(n_x).alias("n_b"))


def _bin(n: Column) -> Column:
    """Sizes up to 32 each for itself, larger ones in bins of a tenth; in order."""
    return F.when(n <= 32, n).otherwise(F.floor(F.log(n.cast("double")) * 10.5 - 36.4) + 33).cast("int")


def _meeting(few: DataFrame, percent: int) -> DataFrame:
    """Rows (node, root, n, i, s, least, most) by the keys (s, p, q) at which those meet whose sizes and positions allow the similarity.

    Of sets of n and m whose first shared members stand i-th and j-th, at least ``percent (n + m) / (100 + percent)``
    must be shared, so that neither n - i nor m - j may be less: m is at most (100 + percent)(n - i) / percent - n, and
    n likewise.  The smaller set lists the sizes that it can meet and the larger one those that it can, in bins, and
    both join on member and both sizes: other pairs are never formed.  At each such key the rows of its most frequent
    root meet only those of other roots, so that a large connected group is not paired with itself.
    """
    scaled = F.floor((F.col("n") - F.col("i")) * (100 + percent) / percent + F.lit(1e-9)) - F.col("n")
    rows = few.withColumns({"top": scaled, "low": F.ceil(F.col("n") * percent / 100 - F.lit(1e-9))})
    own = _bin(F.col("n"))
    small = rows.filter("top >= n").select("node", "root", "n", "top", "s", F.lit(True).alias("small"), own.alias("p"), F.explode(F.sequence(own, F.least(_bin(F.col("top")), F.col("most")))).alias("q"))
    start, stop = F.greatest(_bin(F.col("low")), F.col("least")), F.least(own, _bin(F.col("top")))
    large = rows.filter(F.col("top") >= F.col("low")).filter(start <= stop).select("node", "root", "n", "top", "s", F.lit(False).alias("small"), F.explode(F.sequence(start, stop)).alias("p"), own.alias("q"))
    return small.union(large)


def _residual(rows: DataFrame, corpus: Corpus, percent: int) -> DataFrame:
    """Pairs of rows (node, root) with different roots, among them all that have the similarity.

    Of a set of n, any other that is similar enough shares one of the first n - ceil(percent n / 100) + 1
    members, whatever the order; and the first shared ones' positions bound what can be shared (``_meeting``).
    The order here takes the rarest first, by a table of COUNTERS counts, so that a passage that many texts
    share brings no pair about unless it makes up most of both.  At each key the rows of its most frequent root meet
    only those of other roots, so that a large connected group is not paired with itself.
    """
    scratch = corpus.scratch
    rows = scratch.keep(rows)
    sets = corpus.sets(rows.select("node"))
    counted = sets.mapInArrow(_count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    counts = np.zeros(COUNTERS, np.int64)
    for part in counted.toArrow().to_batches():
        counts[part.column("slot").to_numpy()] = part.column("n").to_numpy()
    counts = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**32 - 1).astype(np.uint32))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = counts.value
        for batch in batches:
            sh = batch.column("sh")
            at, flat = sh.offsets.to_numpy(), sh.values.to_numpy(zero_copy_only=False).view(U)
            ids, sizes, out = batch.column("node").to_numpy(), [], []
            for i in range(len(batch)):
                s = flat[at[i] : at[i + 1]]
                s = s[np.lexsort((s, order[(s >> U(40)) % U(COUNTERS)]))]
                out.append(s[: len(s) - -(-percent * len(s) // 100) + 1])
                sizes.append(len(out[-1]))
            for lo in range(0, len(ids), 256):
                some = slice(lo, lo + 256)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], sizes[some])), pa.array(np.repeat(np.diff(at)[some], sizes[some]).astype(np.int64)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in sizes[some]])), pa.array(np.concatenate(out[some]).view(np.int64))], names=["node", "n", "i", "s"])

    few = scratch.keep(sets.mapInArrow(first, "node long, n long, i int, s long").join(rows, "node"))
    size = _bin(F.col("n"))
    shared = few.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(size).alias("least"), F.max(size).alias("most"))
    shared = scratch.keep(shared.filter("lo != hi").select("s", "least", "most"))
    at = ["s", "p", "q"]
    met = scratch.keep(_meeting(few.join(shared, "s"), percent))
    # Where one root has all rows of a key, or all are smaller or all larger, nothing meets.
    per = met.groupBy(*at, "root").agg(F.count(F.lit(1)).alias("k"), F.max("small").alias("some_small"), F.min("small").alias("all_small"))
    main = per.groupBy(*at).agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"), F.max("some_small").alias("x"), F.min("all_small").alias("y")).filter("roots > 1 and x and not y")
    others = per.join(main.select(*at, "main"), at).filter("root != main").select(*at, "root", "main")
    others = scratch.keep(met.join(others, [*at, "root"]))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in at]
    fit = (F.col("x.n") <= F.col("y.n")) & (F.col("y.n") <= F.col("x.top")) & (F.col("x.n") <= F.col("y.top")) & (F.col("x.n") * 100 >= percent * F.col("y.n"))
    once = (F.col("x.n") < F.col("y.n")) | (F.col("x.node") < F.col("y.node"))

    def pairs(x: DataFrame, y: DataFrame, roots: Column) -> DataFrame:
        one = x.filter("small").alias("x").join(y.filter("not small").alias("y"), [*same, roots, fit, once])
        return _pairs(one, F.col("x.node"), F.col("x.n"), F.col("y.node"), F.col("y.n"))

    return pairs(others, met, F.col("x.root") != F.col("y.root")).union(pairs(met, others, F.col("x.root") == F.col("y.main")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        sh = batch.column("sh").flatten().to_numpy(zero_copy_only=False).view(U)
        counts += np.bincount(((sh >> U(40)) % U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    slot = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(counts[slot])], names=["slot", "n"])


def near_duplicates(docs: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text", center_rounds: int = 8) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; ids are integers.

    ``center_rounds`` bounds the rounds around centres; they end earlier when few trials succeed.  It
    changes the work, not the result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    percent = round(similarity * 100)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = scratch.keep(texts.mapInArrow(_sign, SIGNED))
    some = signed.filter("n_shingles > 0 and doc_id is not null")
    again = scratch.keep(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id"))
    unique = again.isEmpty()
    # Ids may stand for several texts: a class has a number of its own.
    classes = scratch.keep(some.groupBy(*KEY).agg(F.min("doc_id").alias("rep")).withColumn("node", F.monotonically_increasing_id()))
    named = some.join(classes.withColumnRenamed("rep", "doc_id"), [*KEY, "doc_id"])
    reps = scratch.keep((named if unique else named.dropDuplicates(["node"])).select("node", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sig", "bands"))
    corpus = Corpus(texts, classes, reps, unique, scratch)
    banded = reps.select("node", "rep", "n", F.explode("bands").alias("band"))
    # A table of its own: a join whose sides are both plain shuffles can have its hot partitions split.
    shared = scratch.keep(banded.groupBy("band").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("band"))
    members = scratch.keep(banded.join(shared, "band"))
    roots = links = tried = None
    if not unique:
        several = some.join(again, "doc_id", "left_semi").join(classes.select(*KEY, "node"), KEY).select("doc_id", "node").distinct()
        links = scratch.keep(several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a < node").select("a", F.col("node").alias("b")).distinct())
        roots = None if links.isEmpty() else components(links, scratch)
    for rounds in range(center_rounds + 1):
        now = members if roots is None else members.join(roots, "node", "left")
        now = now.withColumn("root", F.col("node") if roots is None else F.coalesce("root", "node"))
        # A bucket is done when all its members are connected. The first centre has the least id, as the text that others were made from often has.
        order = F.xxhash64(F.lit(rounds), "node") if rounds else F.col("rep")
        spots = now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(order.alias("order"), "node", "n", "root")).alias("c")).filter("lo != hi")
        current = scratch.keep(now.join(spots.select("band", "c"), "band"))
        if current.isEmpty():
            break
        last = rounds == center_rounds or (rounds > 0 and found * 50 < trials)  # noqa: F821
        if last:
            pairs = _residual(current.select("node", "root").distinct(), corpus, percent)
        else:
            c = F.col("c")
            pairs = _pairs(current.filter("node != c.node and root != c.root"), F.col("node"), F.col("n"), c["node"], c["n"])
        pairs = pairs.filter(F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        new = _links(pairs, corpus, similarity)
        trials, found = pairs.count(), new.count()
        if found:
            links = new if links is None else scratch.keep(links.union(new))
            roots = components(links, scratch)
        scratch.drop(current)
        if last:
            break
        tried = pairs.select("a", "b") if tried is None else scratch.keep(tried.union(pairs.select("a", "b")))
    linked = classes.select(*KEY, "node", "rep")
    if roots is not None:
        least = roots.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("component_id"))
        linked = linked.join(roots.join(least, "root").select("node", "component_id"), "node", "left")
        linked = linked.select(*KEY, F.coalesce("component_id", "rep").alias("component_id"))
    else:
        linked = linked.select(*KEY, F.col("rep").alias("component_id"))
    out = signed.select("doc_id", *KEY).join(linked, KEY, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "n_shingles", own.alias("component_id"))
    if not unique:
        # A row without words has its id's component.
        per = out.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("all"))
        out = out.join(per, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("all", "component_id").alias("component_id"))
    out = scratch.finish(out)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each near-duplicate group: the rows of ``docs`` that are kept, with all their columns; rows that repeat an id and a text once."""
    found = near_duplicates(docs, similarity, id_col, text_col)
    scratch = Scratch(docs.sparkSession, "kept")
    number = F.col(id_col).cast("long")
    per = found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__lt_id")).agg(F.count(F.lit(1)).alias("k"), F.min("kept").alias("kept"))
    per = scratch.keep(per.filter("k > 1 or not kept"))
    gone, again = per.filter("not kept").select("__lt_id"), per.filter("kept").select("__lt_id")
    left = docs.join(gone, number == F.col("__lt_id"), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, number == F.col("__lt_id"), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, number == F.col("__lt_id"), "left_anti").unionByName(once)
