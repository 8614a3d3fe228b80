"""Lossless trees as node tables: one row for each node, in pre-order, with intervals for navigation.

``node_id`` and ``last_desc`` bound a node's descendants, ``offset`` and ``width`` its text.  What lies in what is
found by ``contained``: each interval is cut in blocks of powers of two, two of a size at most, and each point names the
block of each size that it lies in, so that containment is an equality join that forms no other pairs.  A large document
is thus dealt over tasks, and costs its logarithm, not its square.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..machine import Node, Result
from ..schema import NODE

_TYPES = [pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
_NAMES = [x.split()[0] for x in NODE.split(", ")]


def _digest(node: Node, below: list[bytes]) -> bytes:
    head = f"{node.cls}\0{node.kind}\0{len(node.text)}\0{node.text}\0{len(below)}\0".encode("utf-8", "surrogatepass")
    return hashlib.blake2b(head + b"".join(below), digest_size=8).digest()


def rows_of(doc: int | None, root: Node, paths: bool = False, structure: bool = False) -> list[tuple]:
    """The rows of one tree, children after their parents."""
    out: list[list] = []
    work: list[tuple] = [(root, -1, 0, 0)]
    below: list[list[bytes]] = [[]]
    at = 0
    while work:
        node, parent, index, depth = work.pop()
        if node is None:  # all below this parent are out
            out[parent][2] = len(out) - 1
            out[parent][9] = at - out[parent][10]
            if structure:
                own = below.pop()
                below[-1].append(_digest(index, own))
                out[parent][12] = int.from_bytes(below[-1][-1], "little", signed=True)
            continue
        me = len(out)
        path = None if not paths else [] if parent < 0 else [*out[parent][11], index]
        out.append([doc, me, me, None if parent < 0 else parent, index, depth, node.cls, node.kind, node.text, len(node.text), at, path, None])
        at += len(node.text)
        if node.children:
            # Its own node travels with the mark, for the hash.
            work.append((None, me, node, 0))
            work += [(c, me, i, depth + 1) for i, c in reversed(list(enumerate(node.children)))]
            if structure:
                below.append([])
        elif structure:
            below[-1].append(_digest(node, []))
            out[me][12] = int.from_bytes(below[-1][-1], "little", signed=True)
    return [tuple(r) for r in out]


def node_table(df: DataFrame, parse: Callable[[str], Result], id_col: str = "doc_id", text_col: str = "text", paths: bool = False, structure: bool = False) -> DataFrame:
    """Nodes of each text that parses to a tree; others have none. A path takes as much room as a node is deep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(paths, structure)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = None if text is None else parse(text)
                if r is not None and r.status != "failure":
                    rows.add(doc, r.value)
                if len(rows.text) > 50_000:
                    yield rows.batch()
                    rows = _Rows(paths, structure)
            if rows.text:
                yield rows.batch()

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, NODE)


class _Rows:
    """What ``rows_of`` gives for many trees, as columns: numbers lie in arrays, and what follows from others is worked out for all at once."""

    #: Digests that recur, by what they are made of; dropped when there are too many.
    digests: dict[tuple, bytes] = {}

    def __init__(self, paths: bool, structure: bool):
        self.docs: list[int | None] = []
        self.counts = array("i")
        self.text: list[str] = []
        self.cls: list[str] = []
        self.kind: list[str] = []
        self.last, self.parent, self.index, self.depth, self.width = (array("i") for _ in range(5))
        self.steps = array("i") if paths else None
        self.structure: list[bytes] | None = [] if structure else None

    def digest(self, node: Node, below: list[bytes]) -> bytes:
        key = (node.cls, node.kind, node.text, *below)
        found = self.digests.get(key)
        if found is None:
            found = _digest(node, below)
            if len(below) <= 64 and len(node.text) <= 256:
                if len(self.digests) >= 50_000:
                    self.digests.clear()
                self.digests[key] = found
        return found

    def add(self, doc: int | None, root: Node) -> None:
        text, cls, kind = self.text.append, self.cls.append, self.kind.append
        last, parent, index, depth, width = self.last.append, self.parent.append, self.index.append, self.depth.append, self.width.append
        steps, structure = self.steps, self.structure
        first, n = len(self.text), 0
        # Open nodes above this one: their children still to come, their number, their node, the path to their children, digests of these.
        above: list[tuple] = []
        due, me, owner, path, below = enumerate((root,)), -1, None, [], []
        while True:
            for i, node in due:
                text(node.text)
                cls(node.cls)
                kind(node.kind)
                last(n)
                parent(me)
                index(i)
                depth(len(above))
                width(node.width)
                if steps is not None and above:
                    steps.extend(path)
                    steps.append(i)
                if node.children:
                    if structure is not None:
                        structure.append(b"")
                    if steps is not None:
                        own = [*path, i] if above else []
                    else:
                        own = path
                    above.append((due, me, owner, path, below))
                    due, me, owner, path, below = enumerate(node.children), n, node, own, []
                    n += 1
                    break
                n += 1
                if structure is not None:
                    structure.append(self.digest(node, []))
                    below.append(structure[-1])
            else:
                if not above:
                    break
                self.last[first + me] = n - 1
                if structure is not None:
                    structure[first + me] = done = self.digest(owner, below)
                due, me, owner, path, below = above.pop()
                if structure is not None:
                    below.append(done)
        self.docs.append(doc)
        self.counts.append(n)

    def batch(self) -> pa.RecordBatch:
        n = len(self.text)
        of = np.repeat(np.arange(len(self.docs)), self.counts)
        ends = np.cumsum(self.counts, dtype=np.int64)
        first = (ends - self.counts)[of]
        text = pa.array(self.text, pa.string())
        length = np.asarray(pc.utf8_length(text), dtype=np.int64)
        at = np.cumsum(length) - length
        parent = np.asarray(self.parent, dtype=np.int32)
        ints = lambda x: pa.array(np.asarray(x, dtype=np.int32))
        path, structure = pa.nulls(n, _TYPES[11]), pa.nulls(n, _TYPES[12])
        if self.steps is not None:
            # As many steps as a node is deep.
            path = pa.ListArray.from_arrays(ints(np.concatenate(([0], np.cumsum(self.depth, dtype=np.int64)))), ints(self.steps), type=_TYPES[11])
        if self.structure is not None:
            structure = pa.array(np.frombuffer(b"".join(self.structure), dtype="<i8"))
        columns = [
            pa.array(self.docs, pa.int64()).take(pa.array(of)), ints(np.arange(n) - first), ints(self.last), pa.array(parent, mask=parent < 0), ints(self.index), ints(self.depth),
            pa.array(self.cls, pa.string()), pa.array(self.kind, pa.string()), text, ints(self.width), ints(at - at[first]), path, structure,
        ]
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def held_apart(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged, whatever its size: Spark guesses at tables that Python made from the files that they
    were made of, far too low, and would collect millions of nodes on the driver to broadcast them."""
    return df.hint("merge")


def _shift(way: str, x: Column | str, by: Column) -> Column:
    return F.call_function(f"shift{way}", x, by)


def _levels(n: Column) -> Column:
    """The powers of two up to a number, each a row."""
    return F.explode(F.sequence(F.lit(0), F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")))


def _blocked(intervals: DataFrame, first: Column, last: Column) -> DataFrame:
    """Each interval [first, last] once for each of the blocks that make it up: size ``__xk`` as a power of two, number ``__xb``; empty ones
    not at all. Rows are made rather than arrays with functions on their elements, which Spark does not compile."""
    own = intervals.withColumns({"__a": first.cast("long"), "__z": last.cast("long") + 1}).filter("__a < __z")
    own = own.withColumn("__xk", _levels(F.col("__z") - F.col("__a")))
    size = _shift("left", F.lit(1).cast("long"), F.col("__xk"))
    own = own.withColumns({"__l": _shift("right", F.col("__a") + size - 1, F.col("__xk")), "__r": _shift("right", F.col("__z"), F.col("__xk"))}).filter("__l < __r")
    odd = lambda x: F.col(x).bitwiseAND(F.lit(1)) == 1
    ends = F.array(F.when(odd("__l"), F.col("__l")), F.when(odd("__r"), F.col("__r") - 1))
    return own.withColumn("__xb", F.explode(ends)).filter("__xb is not null").drop("__a", "__z", "__l", "__r")


def contained(points: DataFrame, point: Column, intervals: DataFrame, first: Column, last: Column, doc_col: str = "doc_id") -> DataFrame:
    """All columns of both sides for each point in an interval [first, last] of its document; clashing names are the caller's to avoid."""
    cut = _blocked(intervals, first, last).withColumnRenamed(doc_col, "__d")
    # Only sizes that a document's intervals have are looked for: a bit for each.
    sizes = cut.groupBy(F.col("__d").alias("__e")).agg(F.bit_or(_shift("left", F.lit(1).cast("long"), F.col("__xk"))).alias("__ks"))
    put = points.withColumn("__p", point.cast("long")).join(held_apart(sizes), F.col(doc_col).eqNullSafe(F.col("__e")))
    put = put.withColumn("__k", _levels(F.col("__ks"))).filter(_shift("right", "__ks", F.col("__k")).bitwiseAND(F.lit(1)) == 1)
    put = put.withColumn("__b", _shift("right", "__p", F.col("__k")))
    both = put.join(held_apart(cut), F.col(doc_col).eqNullSafe(F.col("__d")) & (F.col("__k") == F.col("__xk")) & (F.col("__b") == F.col("__xb")))
    return both.drop("__p", "__e", "__ks", "__k", "__b", "__d", "__xk", "__xb")


def to_source(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): leaves in order; missing nodes have no text."""
    ordered = F.array_sort(F.collect_list(F.struct("node_id", "text")))
    return nodes.filter(F.length("text") > 0).groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def children(nodes: DataFrame) -> DataFrame:
    """Each node with its offset recomputed from the widths of the siblings before it."""
    before = Window.partitionBy("doc_id", "parent_id").orderBy("child_index").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("offset_in_parent", F.coalesce(F.sum("width").over(before), F.lit(0)))


def siblings(nodes: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "parent_id").orderBy("child_index")
    return nodes.withColumns({"prev_sibling": F.lag("node_id").over(order), "next_sibling": F.lead("node_id").over(order)})


def located(nodes: DataFrame) -> DataFrame:
    """Each node with the 1-based line and column at which it begins, from the texts of the nodes before it."""
    before = Window.partitionBy("doc_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    last = F.when(ends > 0, F.col("offset") + F.length("text") - F.length(F.substring_index("text", "\n", -1)))
    line = F.coalesce(F.sum(ends).over(before), F.lit(0)) + 1
    column = F.col("offset") - F.coalesce(F.max(last).over(before), F.lit(0)) + 1
    return nodes.withColumns({"line": line.cast("int"), "column": column.cast("int")})


def descendants(nodes: DataFrame, of: Column) -> DataFrame:
    """(doc_id, ancestor_id, node_id, kind): all below the nodes that satisfy a condition."""
    top = nodes.filter(of).select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("last_desc").alias("last"))
    return contained(nodes.select("doc_id", "node_id", "kind"), F.col("node_id"), top, F.col("ancestor_id") + 1, F.col("last")).select("doc_id", "ancestor_id", "node_id", "kind")


def ancestors(nodes: DataFrame, of: Column) -> DataFrame:
    """(doc_id, node_id, ancestor_id, kind, depth): all above the nodes that satisfy a condition."""
    low = nodes.filter(of).select("doc_id", "node_id")
    above = nodes.select("doc_id", F.col("node_id").alias("ancestor_id"), "last_desc", "kind", "depth")
    return contained(low, F.col("node_id"), above, F.col("ancestor_id") + 1, F.col("last_desc")).select("doc_id", "node_id", "ancestor_id", "kind", "depth")


#: Characters of a document that lie in one block: a target is compared with the nodes whose own text lies there, 64 at most.
_NEAR = 6


def node_at(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """The deepest node over each (doc_id, target), the end exclusive; none at the end of the text. A text is made of the nodes' own texts,
    so that it is the one whose own text lies there; no other interval has to be looked at."""
    end = F.col("offset") + F.length("text")
    own = nodes.filter(F.length("text") > 0).select(F.col("doc_id").alias("__d"), "node_id", "kind", "depth", F.col("offset").alias("__a"), end.alias("__z"))
    own = own.withColumn("__xb", F.explode(F.sequence(F.shiftright("__a", _NEAR), F.shiftright(F.col("__z") - 1, _NEAR))))
    put = targets.select("doc_id", "target").distinct().withColumn("__b", F.shiftright(F.col("target").cast("int"), _NEAR))
    hit = put.join(held_apart(own), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__b") == F.col("__xb")) & F.col("target").between(F.col("__a"), F.col("__z") - 1))
    return hit.groupBy("doc_id", "target").agg(F.max_by(F.struct("node_id", "kind", "depth"), "depth").alias("n")).select("doc_id", "target", "n.*")


#: Sizes of the blocks that intervals have their home in, as powers of two; a table's offsets are below the largest.
_HOMES = (6, 12, 18, 24, 30, 36)


def _home(first: Column, last: Column) -> Column:
    """The least size of block that holds a whole interval [first, last]."""
    alike = lambda k: F.shiftright(first, k) == F.shiftright(last, k)
    out = F.when(alike(_HOMES[0]), _HOMES[0])
    for k in _HOMES[1:]:
        out = out.when(alike(k), k)
    return out


def enclosing(nodes: DataFrame, ranges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The deepest node that holds each (doc_id, start, end), both edges included; with ``kinds``, of one of them:
    the region to parse again after an edit. Each node is in the table once, at the smallest block that holds it, and a range names the
    blocks around it. Only the nodes that lie across one of the 63 places where a block is cut have it as their home, so that a range
    meets 63 times a tree's depth at most in each of six blocks, and the nodes of one block of 64 characters."""
    own = nodes.filter(F.col("kind").isin(kinds)) if kinds else nodes
    own = own.select(F.col("doc_id").alias("__d"), "node_id", "kind", "depth", "offset", "width", F.col("offset").cast("long").alias("__a"), (F.col("offset").cast("long") + F.col("width")).alias("__z"))
    own = own.withColumn("__xk", _home(F.col("__a"), F.col("__z"))).withColumn("__xb", _shift("right", "__a", F.col("__xk")))
    # A range's end may be before its start.
    put = ranges.select("doc_id", "start", "end").distinct().withColumns({"__s": F.col("start").cast("long"), "__e": F.greatest("start", "end").cast("long")}).filter("start is not null and end is not null")
    put = put.withColumn("__k", F.explode(F.array(*map(F.lit, _HOMES)))).filter(F.col("__k") >= _home(F.col("__s"), F.col("__e"))).withColumn("__b", _shift("right", "__s", F.col("__k")))
    there = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__k") == F.col("__xk")) & (F.col("__b") == F.col("__xb"))
    hit = put.join(held_apart(own), there & (F.col("__a") <= F.col("__s")) & (F.col("__e") <= F.col("__z")))
    return hit.groupBy("doc_id", "start", "end").agg(F.max_by(F.struct("node_id", "kind", "offset", "width"), F.struct("depth", "node_id")).alias("n")).select("doc_id", "start", "end", "n.*")


def paths(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, path): child indexes from the root; those that the parser gave, where it did. A document's nodes are read in
    order, as they are sorted in one task (which may spill), each with the last index seen at every depth; those of documents without an
    id, which can't be told apart, get none."""
    # Paths that are known go to Python as texts, after a step more, so that none is empty: with each row that it adds, Spark counts all rows
    # of a batch of arrays again.
    given = F.array_join(F.concat(F.array(F.lit(-1)), "path"), ",").alias("path")
    ordered = nodes.select("doc_id", "node_id", "depth", "child_index", given).repartition("doc_id").sortWithinPartitions("doc_id", "node_id")
    return ordered.mapInArrow(_with_paths, "doc_id bigint, node_id int, path array<int>")


#: Nodes whose paths are made at once.
_PATHS_AT_ONCE = 10_000


def _with_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    doc, open_ = None, np.zeros(0, dtype=np.int32)
    for whole in batches:
        for begin in range(0, len(whole), _PATHS_AT_ONCE):
            batch = whole.slice(begin, _PATHS_AT_ONCE)
            docs, depth = batch.column(0), np.asarray(batch.column(2), dtype=np.int64)
            known = np.asarray(docs.is_valid()).astype(bool)
            ids = np.asarray(docs.fill_null(0), dtype=np.int64)
            found = _filled(np.where(known, depth, 0), np.asarray(batch.column(3), dtype=np.int32), open_ if doc is not None and known[0] and ids[0] == doc else open_[:0])
            doc = int(ids[-1]) if known[-1] else None
            open_ = np.asarray(found[len(batch) - 1].values, dtype=np.int32)
            given = batch.column(4)
            path = found
            if given.null_count < len(given):
                # Not pc.list_slice, which makes an empty list of one that is missing.
                path = pc.if_else(given.is_valid(), pc.list_slice(pc.split_pattern(given, ",").cast(_TYPES[11]), 1), found)
            yield pa.RecordBatch.from_arrays([docs, batch.column(1), path], names=["doc_id", "node_id", "path"])


def _filled(depth: np.ndarray, index: np.ndarray, before: np.ndarray) -> pa.ListArray:
    """Paths of nodes in pre-order, the path before the first one known: at each depth the last index, as far as a node is deep."""
    ends = np.concatenate(([0], np.cumsum(depth)))
    steps = np.zeros(ends[-1], dtype=np.int32)
    rows = np.flatnonzero(depth)
    k = 1
    while len(rows):
        own = np.maximum.accumulate(np.where(depth[rows] == k, np.arange(len(rows)), -1))
        steps[ends[rows] + k - 1] = np.where(own < 0, before[k - 1] if k <= len(before) else 0, index[rows[own]])
        rows, k = rows[depth[rows] > k], k + 1
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(steps), type=_TYPES[11])


def problems(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, offset, kind, detail): missing and unexpected nodes, for reading in document order."""
    return nodes.filter(F.col("node_class").isin("missing", "unexpected")).select("doc_id", "node_id", "offset", F.when(F.col("node_class") == "missing", "EndOfInput").otherwise("Custom").alias("kind"), F.col("kind").alias("detail"))


def interned(nodes: DataFrame) -> DataFrame:
    """Distinct tokens with the number of their occurrences: the dictionary of a table of trees."""
    return nodes.filter("node_class = 'token'").groupBy("kind", "text").agg(F.count(F.lit(1)).alias("n"))


def interned_trees(nodes: DataFrame) -> DataFrame:
    """(structure, kind, width, nodes, n): distinct subtrees, equal in kinds, texts and shape, with the number of their occurrences.
    The table must have been made with ``structure``."""
    size = F.col("last_desc") - F.col("node_id") + 1
    return nodes.filter("structure is not null").groupBy("structure", "kind", "width", size.alias("nodes")).agg(F.count(F.lit(1)).alias("n"))


def replace_at(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """The node table after the nodes in ``edits`` (doc_id, target, new_text) became tokens of that text, of the same kind; what was
    below them goes. Of nested targets the outer one counts; of several texts for a target the least."""
    only = edits.groupBy("doc_id", "target").agg(F.min("new_text").alias("text"))
    zero, none = F.lit(0), F.lit(None)
    new = only.select("doc_id", "target", zero.alias("node_id"), zero.alias("last_desc"), none.alias("parent_id"), zero.alias("child_index"), zero.alias("depth"), F.lit("token").alias("node_class"), none.alias("kind"), "text")
    return _put(nodes, new, True)


def spliced(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """The node table with subtrees put in place of others: ``new`` holds for each (doc_id, target) the rows of a tree, numbered from 0.

    What does not lie in a target stays and is numbered anew; lengths, offsets and ends of intervals follow.  A target
    that is in another one, or in no document, is left out; documents without an id stay as they are.  Paths and
    structures are null.  A document's nodes are held by one task, as they are when it is parsed.
    """
    return _put(nodes, new, False)


#: What a node to be spliced is told by; ``target`` is null for those that are there already.
_SPLICED = "doc_id bigint, target int, node_id int, last_desc int, parent_id int, child_index int, depth int, node_class string, kind string, text string, width int, offset int"


def _put(nodes: DataFrame, new: DataFrame, same_kind: bool) -> DataFrame:
    """Documents and what is put in them brought together once. With ``same_kind``, what is put has its target's kind."""
    columns = [x.split() for x in _SPLICED.split(", ")]
    missing = {"target": nodes, "width": new, "offset": new}
    rows = lambda df: df.select(*((F.lit(None) if missing.get(n) is df else F.col(n)).cast(t).alias(n) for n, t in columns))
    both = rows(nodes).unionByName(rows(new).filter("doc_id is not null and target is not null")).repartition("doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_documents(batches):
            yield _put_in(whole, same_kind)

    return both.mapInArrow(run, NODE)


def _whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, sorted by document, cut between documents only; those without an id anywhere."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        known = len(batch) - batch.column(0).null_count
        if known < len(batch):
            yield batch.slice(0, len(batch) - known)
            batch = batch.slice(len(batch) - known)
        if not known:
            continue
        docs = np.asarray(batch.column(0))
        last = int(np.searchsorted(docs, docs[-1]))
        if last or (held and held[0].column(0)[0].as_py() != docs[0]):
            yield from pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
            held = []
        held.append(batch.slice(last))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _put_in(batch: pa.RecordBatch, same_kind: bool) -> pa.RecordBatch:
    """Whole documents with what is put in them."""
    got = {n: batch.column(i) for i, n in enumerate(x.split()[0] for x in _SPLICED.split(", "))}
    whole = lambda n, none=0: np.asarray(got[n].fill_null(none), dtype=np.int64)
    doc, target, node = whole("doc_id"), whole("target", -1), whole("node_id")
    last, parent, index, depth, width, offset = whole("last_desc"), whole("parent_id", -1), whole("child_index"), whole("depth"), whole("width"), whole("offset")
    length = np.asarray(pc.utf8_length(got["text"]).fill_null(0), dtype=np.int64)
    if got["doc_id"].null_count:
        every = np.arange(len(batch))
        return _spliced_batch(got, every, every, node, last, parent, index, depth, width, offset)
    # Documents by number: with a node's, a key of the table.
    number = np.cumsum(np.concatenate(([0], doc[1:] != doc[:-1]))) if len(doc) else doc
    order = np.lexsort((node, target, number))
    old, new = order[target[order] < 0], order[target[order] >= 0]
    at = lambda rows, of: (number[rows] << 32) + of[rows]
    keys = at(old, node)
    first = np.searchsorted(keys, number[old] << 32)  # the row of each one's document
    # Trees to put in, in order of their targets, which are at ``top``: those that are in no other one.
    trees_, tree, added = np.unique(at(new, target), return_inverse=True, return_counts=True)
    chars = np.bincount(tree, length[new], len(trees_)).astype(np.int64)
    top = np.searchsorted(keys, trees_)
    there = np.flatnonzero((top < len(keys)) & (keys[np.minimum(top, len(keys) - 1)] == trees_)) if len(keys) else np.zeros(0, dtype=np.int64)
    ends = np.maximum.accumulate(at(old[top[there]], last)) if len(there) else there
    there = there[np.concatenate(([True], ends[:-1] < trees_[there[1:]]))] if len(there) else there
    top = top[there]
    stop = np.searchsorted(keys, at(old[top], last), "right")
    inside = np.zeros(len(old) + 1, dtype=np.int64)
    np.add.at(inside, top, 1)
    np.add.at(inside, stop, -1)
    stays = np.cumsum(inside[:-1]) == 0
    # By how many rows and characters a document has grown before each node, and before the one after it.
    rows_at, chars_at = np.zeros(len(old) + 1, dtype=np.int64), np.zeros(len(old) + 1, dtype=np.int64)
    rows_at[top + 1] = added[there] - (last[old[top]] - node[old[top]] + 1)
    chars_at[top + 1] = chars[there] - width[old[top]]
    rows_at, chars_at = np.cumsum(rows_at), np.cumsum(chars_at)
    grown = lambda x, i, rows: x[i] - x[first[rows]]

    def place(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """New numbers of old nodes and of their parents, and new offsets."""
        up = np.searchsorted(keys, at(old[rows], parent))
        found = (parent[old[rows]] >= 0) & (keys[np.minimum(up, len(keys) - 1)] == at(old[rows], parent))
        more = np.where(found, grown(rows_at, np.minimum(up, len(keys) - 1), rows), 0)
        return node[old[rows]] + grown(rows_at, rows, rows), parent[old[rows]] + more, offset[old[rows]] + grown(chars_at, rows, rows)

    kept = np.flatnonzero(stays)
    end = np.searchsorted(keys, at(old[kept], last), "right")
    one = [*place(kept)]
    one = [one[0], last[old[kept]] + grown(rows_at, end, kept), one[1], index[old[kept]], depth[old[kept]], width[old[kept]] + chars_at[end] - chars_at[kept], one[2]]
    # Rows of trees: by the number of their tree among those that are put in, and the rows where these begin.
    of = np.full(len(trees_), -1)
    of[there] = np.arange(len(there))
    of = of[tree]
    put, of = new[of >= 0], of[of >= 0]
    own = (of << 32) + node[put]
    after = np.cumsum(length[put])
    before = after - length[put]
    start = before[np.searchsorted(of, of)]
    end = np.minimum(np.searchsorted(own, (of << 32) + last[put]), max(len(own) - 1, 0))
    held = own[end] == (of << 32) + last[put]
    begin, wide = (before - start)[held], (after[end] - before)[held]
    put, of = put[held], of[held]
    ids, ups, starts = place(top)
    whose = old[top][of]
    above = np.where(node[put] == 0, ups[of], np.where(parent[put] < 0, -1, ids[of] + parent[put]))
    two = [ids[of] + node[put], ids[of] + last[put], above, np.where(node[put] == 0, index[whose], index[put]), depth[whose] + depth[put], wide, starts[of] + begin]
    return _spliced_batch(got, np.concatenate((old[kept], put)), np.concatenate((old[kept], whose if same_kind else put)), *(np.concatenate(x) for x in zip(one, two, strict=True)))


def _spliced_batch(got: dict[str, pa.Array], rows: np.ndarray, kinds: np.ndarray, node, last, parent, index, depth, width, offset) -> pa.RecordBatch:
    taken = lambda n, i: got[n].take(pa.array(i))
    ints = lambda x: pa.array(x.astype(np.int32))
    columns = [
        taken("doc_id", rows), ints(node), ints(last), pa.array(parent.astype(np.int32), mask=parent < 0), ints(index), ints(depth), taken("node_class", rows), taken("kind", kinds), taken("text", rows),
        ints(width), ints(offset), pa.nulls(len(rows), _TYPES[11]), pa.nulls(len(rows), _TYPES[12]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)
