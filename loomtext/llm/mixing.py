"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Each source is dealt over shards by a seeded hash and laid out there in seeded order, cut in blocks of
``block_tokens`` words.  Blocks go to sources by highest quotients (weight over odd numbers), no source
beyond ``max_repeats`` times its blocks; a source's blocks go to its shards the same way, by their
words.  That gives an integer quota for each shard.  The shard takes every block as many whole times as
the quota allows and the rest as one seeded, cyclic run of blocks, so that few texts are cut.

Nulls: a null text has no words, a null source is a source of its own (last), a null id is an id like
others.  Repeated rows are documents of their own.  Empty input: no rows.  A source without words has
target 0.  Sources and their shards (``max_shards`` and one for each source at most) are listed on the driver.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, unused

WORD = r"[^\x20\x09-\x0D]++"


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """``total`` shared by weight; what would go beyond ``most`` times a size is shared again among the others."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients weight / (2 k + 1), none beyond its cap; ties to the first.

    A divisor found by bisection gives the seats below the last few, which are then dealt one by one.
    """
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    seats = min(seats, sum(caps[i] for i in live))
    given = [0] * len(weights)
    if not live or seats <= 0:
        return given

    def at(d: float) -> list[int]:
        return [min(caps[i], math.ceil(weights[i] / d - 0.5)) if weights[i] / d > 0.5 else 0 for i in live]

    lo, hi = 0.0, 4 * max(weights[i] for i in live)
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid <= 0 or sum(at(mid)) > seats:
            lo = mid
        else:
            hi = mid
    for i, x in zip(live, at(hi), strict=True):
        given[i] = x
    heap = [(-weights[i] / (2 * given[i] + 1), i) for i in live if given[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * given[i] + 1), i))
    return given


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_repeats: int = 2, block_tokens: int = 64, rows_per_shard: int = 256, max_shards: int = 1 << 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Id, source, and: size, source_size, target, taken, whole (times the full text is taken), and the word ranges
    [from1, to1) and [from2, to2) taken once more.  ``taken`` counts all of these."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = scratch.keep(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text).alias("u"))
    )
    found = sorted(sized.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in found]
    w = [float(weights[i % len(weights)]) for i in range(len(found))]
    goals = targets(sizes, w, share * sum(sizes), max_repeats)
    total = sum(r[2] for r in found)
    parts = [max(1, min(r[2] // rows_per_shard, max_shards * r[2] // total)) for r in found]
    src = spark.createDataFrame([(r[0], i, r[1], goals[i], parts[i]) for i, r in enumerate(found)], "name string, s int, source_size long, target double, parts int")
    # Both listings are bounded: the sources, and max_shards rows and one for each source.
    small = F.broadcast if len(found) <= 100_000 else (lambda df: df)
    dealt = sized.join(small(src), sized["source"].eqNullSafe(src["name"])).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "u"), F.col("parts").cast("long")).cast("int"))
    per = {(r[0], r[1]): r[2] for r in dealt.groupBy("s", "part").agg(F.sum("size")).collect()}
    blocks = {k: -(-n // block_tokens) for k, n in per.items()}
    own: list[dict] = [{} for _ in found]
    for (i, part), n in sorted(blocks.items()):
        own[i][part] = n
    have = [sum(x.values()) for x in own]
    # A source that is taken max_repeats times gets all of its blocks so often, whatever they hold; the others' seats are
    # counted in blocks as full as theirs.
    full = [g >= max_repeats * z for g, z in zip(goals, sizes, strict=True)]
    due = [0.0 if all_ else g * n / z for all_, g, n, z in zip(full, goals, have, sizes, strict=True)]
    seats = sainte_lague(due, [max_repeats * n for n in have], round(sum(due)))
    rows = []
    for i, parts_of in enumerate(own):
        most = [max_repeats * n for n in parts_of.values()]
        dealt_to = most if full[i] else sainte_lague(list(parts_of.values()), most, seats[i])
        rows += [(i, part, n, q // n if n else 0, q % n if n else 0) for (part, n), q in zip(parts_of.items(), dealt_to, strict=True)]
    quotas = spark.createDataFrame(rows, "s int, part int, blocks long, times long, extra long")
    small = F.broadcast if len(rows) <= 1_000_000 else (lambda df: df)
    end = F.sum("size").over(Window.partitionBy("s", "part").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, 0))
    b = F.lit(block_tokens)
    laid = dealt.join(small(quotas), ["s", "part"]).withColumns({"b1": end, "lap": F.col("blocks") * b, "run": F.col("extra") * b, "a": F.pmod(F.xxhash64(F.lit(seed + 2), "s", "part"), F.greatest("blocks", F.lit(1))) * b}).withColumn("b0", F.col("b1") - F.col("size"))

    def cut(shift) -> tuple:
        """The part of [b0, b1) in the run of blocks, from the text's first word on."""
        lo, hi = F.greatest("b0", F.col("a") - shift), F.least("b1", F.col("a") + F.col("run") - shift)
        return F.greatest(lo - F.col("b0"), F.lit(0)), F.greatest(hi - F.col("b0"), lo - F.col("b0"), F.lit(0))

    (f1, t1), (f2, t2) = cut(F.lit(0)), cut(F.col("lap"))
    return laid.select("id", "source", "size", "source_size", "target", F.col("times").alias("whole"), f1.alias("from1"), t1.alias("to1"), f2.alias("from2"), t2.alias("to2"), "u").withColumn(
        "taken", F.col("whole") * F.col("size") + (F.col("to1") - F.col("from1")) + (F.col("to2") - F.col("from2"))
    ).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "whole", "from1", "to1", "from2", "to2", F.col("u").alias("text_key"))


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; a cut text has its taken words, joined by a space, as a row of its own.

    A row without words is not taken.  Rows equal in id, text and source are told apart by nothing and taken alike.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    names = ("id", "u", "s", "n", "t", "size", "whole", "from1", "to1", "from2", "to2")
    c = {x: unused(docs, f"__lt_{x}") for x in names}
    taken = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    plan = taken.select(F.col(id_col).alias(c["id"]), F.col("text_key").alias(c["u"]), F.col(source_col).alias(c["s"]), *[F.col(x).alias(c[x]) for x in names[5:]], F.col("taken").alias(c["t"]))
    key = [c["u"], c["id"], c["s"]]
    # Rows equal in all three are numbered, so that each meets its own plan once; only they are.
    plan = plan.withColumn(c["n"], F.row_number().over(Window.partitionBy(*key).orderBy(*[c[x] for x in ("size", "whole", "from1", "to1", "from2", "to2")])))
    plan = scratch.keep(plan.filter(f"{c['t']} > 0 or {c['n']} > 1").drop(c["t"]))
    again = plan.filter(F.col(c["n"]) > 1).select(*key).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn(c["u"], F.xxhash64(F.lit(how.get("seed", 17)), F.col(id_col), text))

    def same(left: str, right: str):
        return (F.col(f"{left}.{c['u']}") == F.col(f"{right}.{c['u']}")) & F.col(f"{left}.{id_col}").eqNullSafe(F.col(f"{right}.{c['id']}")) & F.col(f"{left}.{source_col}").eqNullSafe(F.col(f"{right}.{c['s']}"))

    one = F.lit(1)
    if again.isEmpty():
        rows = rows.withColumn(c["n"], one)
    else:
        alone = rows.alias("d").join(again.alias("a"), same("d", "a"), "left_anti").withColumn(c["n"], one)
        several = rows.alias("d").join(again.alias("a"), same("d", "a"), "left_semi")
        rows = alone.unionByName(several.withColumn(c["n"], F.row_number().over(Window.partitionBy(c["u"], id_col, source_col).orderBy(F.lit(1)))))
    both = rows.alias("d").join(plan.alias("p"), same("d", "p") & (F.col(f"d.{c['n']}") == F.col(f"p.{c['n']}")))
    from1, to1, from2, to2 = (F.col(c[x]) for x in ("from1", "to1", "from2", "to2"))
    n1, n2 = to1 - from1, to2 - from2
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    piece = F.array_join(F.concat(F.slice(words, (from1 + 1).cast("int"), n1.cast("int")), F.slice(words, (from2 + 1).cast("int"), n2.cast("int"))), " ")
    extra = F.when(n1 + n2 == 0, F.array().cast("array<string>")).when(n1 + n2 == F.col(c["size"]), F.array(text)).otherwise(F.array(piece))
    out = both.withColumn(c["t"], F.explode(F.concat(F.array_repeat(text, F.col(c["whole"]).cast("int")), extra)))
    cols = [F.col(c["t"]).alias(x) if x == text_col else F.char_length(c["t"]).cast("long").alias(x) if x == "n_chars" else F.col(f"d.{x}").alias(x) for x in docs.columns]
    return out.select(*cols)
