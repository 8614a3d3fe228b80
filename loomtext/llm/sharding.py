"""Sharding by sampled splitters, in DataFrame functions only.

Every record has a key: the hash of its text, then a hash of its id.  A size-weighted sample of keys,
bounded by ``sample_size``, gives quantile boundaries of many ranges; exact row and byte counts of the
ranges follow; ranges that came out overfull are sampled again and subdivided.  Ranges of more than
``range_bytes`` are then cut evenly by the value of their keys, so that no task holds more of a table of
any size; consecutive ranges make up shards of nearly equal bytes: the range in which a shard should end is
cut between the two texts that are nearest.  Equal texts are neighbours in key order; where copies of one
text outweigh a range, such a hot text is subdivided, by the id's hash, and if its rows have one id too (or
none), by a number written with each row, but its ranges stay in one shard unless it outweighs half of one.

Nulls: a null text has no bytes and is as the empty text; null ids are as any other id.  Repeated rows
are each placed.  Empty input: no rows.  Columns of the input that bear a name of the result are replaced,
other columns may have any name.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, unused

LEAST, MOST = -(2**63), 2**63 - 1
#: Up to so many ranges are looked up in the plan itself, more in a table that is broadcast (24 bytes for each).
LITERALS = 4096


class Names(NamedTuple):
    """Columns of the operator's own: key (hash of the text, of the id), weight, range, and a row's number."""

    h: str
    k: str
    w: str
    r: str
    t: str


def _keyed(docs: DataFrame, c: Names, id_col: str, text_col: str, hot: list[tuple[int, int]]) -> DataFrame:
    """``hot``: keys of rows that only a number of their own tells apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumns({c.h: F.xxhash64(text), c.k: F.xxhash64(F.lit(7), F.col(id_col)), "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)})
    if hot:
        alone = F.struct(F.col(c.h).alias("h"), F.col(c.k).alias("k")).isin([F.struct(F.expr(_literal(h)).alias("h"), F.expr(_literal(k)).alias("k")) for h, k in hot])
        out = out.withColumn(c.k, F.when(alone, F.xxhash64(c.k, c.t)).otherwise(F.col(c.k)))
    return out


def _longs(xs: list[int]) -> Column:
    return F.lit([int(x) for x in xs]) if xs else F.array().cast("array<bigint>")


def _literal(x: int) -> str:
    return f"{x}L" if x != LEAST else "(-9223372036854775807L - 1L)"


def _range_of(bounds: list[tuple[int, int]], c: Names) -> Column:
    """How many bounds are at or below a row's key, by binary search."""
    if not bounds:
        return F.lit(0)
    hs = F.expr("array(" + ",".join(_literal(h) for h, _ in bounds) + ")")
    ks = F.expr("array(" + ",".join(_literal(k) for _, k in bounds) + ")")
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]

    def step(at: Column, by: Column) -> Column:
        h, k = F.get(hs, at + by), F.get(ks, at + by)
        return F.when((h < F.col(c.h)) | ((h == F.col(c.h)) & (k <= F.col(c.k))), at + by).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(-1), step) + 1


def _sample(rows: DataFrame, per: float, c: Names) -> list[tuple[int, int, int]]:
    """Keys and how often each was drawn, in key order: ``per`` draws for each unit of weight, by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit(11), c.h, c.k), F.lit(1 << 30)) / F.lit(float(1 << 30))
    draws = F.floor(F.col(c.w) * F.lit(per) + u).cast("long")
    got = rows.select(c.h, c.k, draws.alias("n")).filter("n > 0").groupBy(c.h, c.k).agg(F.sum("n").alias("n")).collect()
    return sorted((r[0], r[1], r[2]) for r in got)


def _bounds(sample: list[tuple[int, int, int]], parts: int) -> set[tuple[int, int]]:
    """Quantile boundaries that part the sample in ``parts``. A text that is cut has ranges of its own."""
    total = sum(n for _, _, n in sample)
    if not total or parts < 2:
        return set()
    width, weight, out, seen, due = total / parts, {}, set(), 0.0, total / parts
    for h, _, n in sample:
        weight[h] = weight.get(h, 0) + n
    for h, k, n in sample:
        if seen >= due - 1e-9:
            out |= {(h, LEAST), (h, k), (min(h + 1, MOST), LEAST)} if weight[h] > width else {(h, LEAST)}
            due += width * (1 + (seen - due) // width)
        seen += n
    return out


def _cut(bounds: list[tuple[int, int]], bytes_of: list[int], range_bytes: int, c: Names) -> tuple[Column, int]:
    """The number of a row's part of a range, the ranges' parts being of ``range_bytes`` or so, and how many parts there are."""
    low = [(LEAST, LEAST), *bounds]
    high = [*bounds, (MOST + 1, LEAST)]
    parts = [max(1, -(-b // range_bytes)) for b in bytes_of]
    first = [sum(parts[:i]) for i in range(len(parts) + 1)] if len(parts) < 64 else _running(parts)
    if first[-1] == len(parts):
        return F.col(c.r).cast("long"), len(parts)
    one = [a[0] == b[0] or (b == (a[0] + 1, LEAST)) for a, b in zip(low, high, strict=True)]
    start = [float(a[1] if x else a[0]) for a, x in zip(low, one, strict=True)]
    stop = [float((b[1] if a[0] == b[0] else MOST) if x else b[0]) for a, b, x in zip(low, high, one, strict=True)]
    i = F.col(c.r)
    place = F.when(F.get(F.lit(one), i), F.col(c.k)).otherwise(F.col(c.h)).cast("double")
    share = (place - F.get(F.lit(start), i)) / F.get(F.lit([max(b - a, 1.0) for a, b in zip(start, stop, strict=True)]), i)
    n = F.get(_longs(parts), i)
    return F.get(_longs(first[:-1]), i) + F.least(F.greatest(F.floor(share * n), F.lit(0)), n - 1), first[-1]


def _running(xs: list[int]) -> list[int]:
    out = [0]
    for x in xs:
        out.append(out[-1] + x)
    return out


def _counts(rows: DataFrame, by: Column, n: int) -> list[tuple[int, int]]:
    """Rows and bytes of each of n ranges."""
    out = [(0, 0)] * n
    for r in rows.groupBy(by.alias("r")).agg(F.count(F.lit(1)), F.sum("size")).collect():
        out[r[0]] = (r[1], r[2])
    return out


def _splitters(slim: DataFrame, n: int, size: int, ranges: int, sample_size: int, rounds: int, c: Names) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """Bounds, rows and bytes of the ranges, and which ranges stayed overfull."""
    # Half of the weight goes by rows, so that a range holds neither too many bytes nor too many rows.
    weighed = slim.withColumn(c.w, F.col("size") * F.lit(n / size) + 1.0)
    bounds = sorted(_bounds(_sample(weighed, sample_size / (2 * n), c), ranges))
    for last in [*[False] * (rounds - 1), True]:
        stats = _counts(weighed, _range_of(bounds, c), len(bounds) + 1)
        over = {i: rows / n + b / size for i, (rows, b) in enumerate(stats) if rows > 1 and max(rows / n, b / size) > 2.5 / ranges}
        if last or not over:
            break
        inside = weighed.withColumn(c.r, _range_of(bounds, c)).filter(F.col(c.r).isin(list(over)))
        drawn = _sample(inside, sample_size / (n * sum(over.values())), c)
        more = set()
        for i, weight in over.items():
            own = [x for x in drawn if bisect.bisect_right(bounds, x[:2]) == i]
            more |= _bounds(own, 1 + round(weight * ranges))
        if not more - set(bounds):
            break
        bounds = sorted({*bounds, *more})
    return bounds, stats, sorted(over)


def _ends(slim: DataFrame, bounds: list[tuple[int, int]], bytes_of: list[int], n_shards: int, c: Names) -> set[tuple[int, int]]:
    """Bounds between two texts, those nearest to where each shard should end, in ranges that hold several texts."""
    low, high = [(LEAST, LEAST), *bounds], [*bounds, (MOST + 1, LEAST)]
    before, size = _running(bytes_of), sum(bytes_of)
    due = []
    for k in range(1, n_shards):
        i = bisect.bisect_right(before, k * size / n_shards) - 1
        if i < len(bytes_of) and low[i][1] == LEAST and high[i][1] == LEAST and high[i][0] - low[i][0] > 1:
            due.append((i, k * size / n_shards - before[i]))
    if not due:
        return set()
    texts = slim.withColumn(c.r, _range_of(bounds, c)).filter(F.col(c.r).isin([i for i, _ in due])).groupBy(c.r, c.h).agg(F.sum("size").alias("b"))
    texts = texts.withColumn("b", F.sum("b").over(Window.partitionBy(c.r).orderBy(c.h).rowsBetween(Window.unboundedPreceding, 0)))
    nearest = [F.min_by(F.col(c.h), F.when(F.col(c.r) == i, F.abs(F.col("b") - at))).alias(f"x{j}") for j, (i, at) in enumerate(due)]
    return {(h + 1, LEAST) for h in texts.agg(*nearest).first() if h is not None and h < MOST}


def _shards(bounds: list[tuple[int, int]], bytes_of: list[int], n_shards: int) -> list[int]:
    """The shard of each range, by its middle. The ranges of one text count as one, unless it outweighs half of a shard."""
    low, size, out, before, i = [(LEAST, LEAST), *bounds], max(1, sum(bytes_of)), [], 0, 0
    while i < len(bytes_of):
        j = i + 1
        while j < len(low) and low[j][0] == low[i][0]:
            j += 1
        whole = sum(bytes_of[i:j])
        together = whole * 2 * n_shards <= size
        for b in [whole] if together else bytes_of[i:j]:
            out += [min(n_shards - 1, int((before + b / 2) * n_shards / size))] * (j - i if together else 1)
            before += b
        i = j
    return out


def shard(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 128, sample_size: int = 16384, rounds: int = 4, range_bytes: int = 1 << 28) -> DataFrame:
    """All columns of ``docs`` and: size, text_crc32, law, shard, slot (gapless in each shard), grown_shard (null under this law).

    ``sample_size`` bounds the keys drawn in a round (in expectation, with a deviation of its root);
    the ranges number ``n_shards * ranges_per_shard`` and four times that at most after subdivision, and
    besides one for each ``range_bytes`` of text.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    docs = docs.drop("law", "shard", "slot", "grown_shard")
    c = Names(*(unused(docs, x) for x in ("__lt_h", "__lt_k", "__lt_w", "__lt_r", "__lt_t")))
    ranges, hot = n_shards * ranges_per_shard, []

    def keys(rows: DataFrame) -> DataFrame:
        return scratch.keep(_keyed(rows.select(id_col, text_col, *[c.t] * bool(hot)), c, id_col, text_col, hot).select(c.h, c.k, "size"))

    slim = keys(docs)
    n, size = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    bounds, base, shards, part, filled = [], [0], [0], F.lit(0).cast("long"), [0] * n_shards
    if n:
        bounds, stats, over = _splitters(slim, n, size, ranges, sample_size, rounds, c)
        if over:
            same = slim.withColumn(c.r, _range_of(bounds, c)).filter(F.col(c.r).isin(over)).groupBy(c.r).agg(F.min(c.h).alias("h"), F.max(c.h).alias("x"), F.min(c.k).alias("k"), F.max(c.k).alias("y"))
            hot = [(r["h"], r["k"]) for r in same.filter("h = x and k = y").collect()]
        if hot:
            # Rows equal in text and id: each is written with a number, the one thing that tells them apart.
            docs = scratch.keep(docs.withColumn(c.t, F.monotonically_increasing_id()))
            scratch.drop(slim)
            slim = keys(docs)
            bounds, stats, _ = _splitters(slim, n, size, ranges, sample_size, rounds, c)
        if ends := _ends(slim, bounds, [b for _, b in stats], n_shards, c) - set(bounds):
            bounds = sorted({*bounds, *ends})
            stats = _counts(slim, _range_of(bounds, c), len(bounds) + 1)
        shard_of = _shards(bounds, [b for _, b in stats], n_shards)
        part, parts = _cut(bounds, [b for _, b in stats], range_bytes, c)
        if parts > len(stats):
            shard_of = [at for at, (_, b) in zip(shard_of, stats, strict=True) for _ in range(max(1, -(-b // range_bytes)))]
            stats = _counts(slim.withColumn(c.r, _range_of(bounds, c)), part, parts)
        shards, base = shard_of, []
        for at, (rows, _) in zip(shards, stats, strict=True):
            base.append(filled[at])
            filled[at] += rows
    scratch.drop(slim)
    placed = _keyed(docs, c, id_col, text_col, hot).withColumn(c.r, _range_of(bounds, c)).withColumn(c.r, part)
    if len(shards) <= LITERALS:
        at, start = F.get(F.lit(shards), F.col(c.r)), F.get(_longs(base), F.col(c.r))
    else:
        table = docs.sparkSession.createDataFrame(list(zip(range(len(shards)), shards, base, strict=True)), f"{c.r} long, {c.w} int, {c.t}_ long")
        placed = placed.join(F.broadcast(table) if len(shards) <= 1_000_000 else table, c.r)
        at, start = F.col(c.w), F.col(c.t + "_")
    order = Window.partitionBy(c.r).orderBy(c.h, c.k, F.col(id_col), "size")
    return placed.withColumns(
        {
            "law": F.lit("bytes"),
            "shard": at.cast("int"),
            "slot": start.cast("long") + F.row_number().over(order) - 1,
            "grown_shard": F.lit(None).cast("int"),
        }
    ).drop(*c, c.t + "_")
