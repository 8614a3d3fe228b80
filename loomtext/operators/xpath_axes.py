"""XPath 1.0 over a table of XML nodes: axes as joins, predicates as columns.

Node rows are in document order, attributes right after their element, with ``last_desc`` as the end of a node's
interval: ``node_id`` 0 is the document.  A location path is a chain of joins from a table of contexts, one step
at a time: child, parent, attribute and sibling axes join on the parent, descendant and ancestor axes on blocks
(``trees.contained``).  ``position()`` and ``last()`` are windows over the nodes that a step finds for one context.
Siblings are not paired where a running count over them tells as much: the n-th one, how many there are, or all of
them for several contexts.  No join broadcasts nodes (``trees.held_apart``).

An expression is worked out for a table of contexts (doc_id, node_id, and the position and size where it has some) as one
column by key; node sets in it become tables, counted, compared or made strings by an aggregate for each context.  Variables,
the namespace axis and id(), lang() are not evaluated: ValueError, when the plan is made.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..formats import xml, xpath
from . import trees

XML_NODE = "doc_id bigint, node_id int, last_desc int, parent_id int, depth int, kind string, name string, value string"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
TESTS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
SIDES = ("following-sibling", "preceding-sibling", "following", "preceding")
SIBLINGS = SIDES[:2]
NUMERIC = ("position", "last", "count", "sum", "number", "string-length", "floor", "ceiling", "round")
REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")


def rows_of(doc: int | None, document: xml.Document) -> list[tuple]:
    """The rows of one document: kind (root, element, attribute, text, comment, processing-instruction), name, and string value."""
    out: list[list] = [[doc, 0, 0, None, 0, "root", None, ""]]
    work: list[tuple] = [(None, 0, None), (document.root, 0, 1)]
    while work:
        node, parent, depth = work.pop()
        if node is None:
            out[parent][2] = len(out) - 1
            continue
        me = len(out)
        if isinstance(node, xml.Element):
            out.append([doc, me, me, parent, depth, "element", node.name, ""])
            out += [[doc, me + 1 + i, me + 1 + i, me, depth + 1, "attribute", k, v] for i, (k, v) in enumerate(node.attributes)]
            work.append((None, me, None))
            work += [(c, me, depth + 1) for c in reversed(node.children)]
        elif isinstance(node, (xml.Text, xml.CData)):
            out.append([doc, me, me, parent, depth, "text", None, node.text])
        elif isinstance(node, xml.Comment):
            out.append([doc, me, me, parent, depth, "comment", None, node.text])
        else:
            out.append([doc, me, me, parent, depth, "processing-instruction", node.target, node.text])
    # The value of an element is all text in it: a running total of the texts, cut at its ends.
    at, total, parts = [0], 0, []
    for r in out:
        total += len(r[7]) if r[5] == "text" else 0
        parts += [r[7]] if r[5] == "text" else []
        at.append(total)
    whole = "".join(parts)
    for r in out:
        if r[5] in ("root", "element"):
            r[7] = whole[at[r[1]] : at[r[2] + 1]]
    return [tuple(r) for r in out]


def xml_nodes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: xml.Config = xml.Config()) -> DataFrame:
    """The nodes of each well-formed text; others have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                r = None if text is None else xml.parse_xml(text, config)
                if r is not None and r.status != "failure":
                    rows += rows_of(doc, r.value)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=[x.split()[0] for x in XML_NODE.split(", ")])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, XML_NODE)


def _test(test: str, axis: str) -> Column:
    main = "attribute" if axis == "attribute" else "element"
    kind = F.col("kind")
    if test == "node()":
        return F.lit(True)
    if test in ("text()", "comment()", "processing-instruction()"):
        return kind == test[:-2]
    if test.startswith("processing-instruction("):
        return (kind == "processing-instruction") & (F.col("name") == test[23:-1].strip("'\""))
    if test == "*":
        return kind == main
    if test.endswith(":*"):
        return (kind == main) & F.col("name").startswith(test[:-1])
    return (kind == main) & (F.col("name") == test)


def _numeric(e: Any) -> bool:
    return isinstance(e, (xpath.Num, xpath.Negation)) or (isinstance(e, xpath.Call) and e.name in NUMERIC) or (isinstance(e, xpath.Binary) and e.op in ("+", "-", "*", "div", "mod"))


def _placed(e: Any) -> bool:
    """Whether an expression asks for the position or the size of its own context."""
    if isinstance(e, xpath.Call):
        return e.name in ("position", "last") or any(map(_placed, e.args))
    if isinstance(e, xpath.Binary):
        return _placed(e.left) or _placed(e.right)
    if isinstance(e, xpath.Negation):
        return _placed(e.inner)
    return isinstance(e, xpath.Path) and e.base not in (None, "/") and _placed(e.base)


def _free(e: Any) -> bool:
    """Whether a predicate is the same for a node wherever it stands among those found."""
    return not _numeric(e) and not _placed(e)


def _nth(e: Any) -> int | None:
    """The one position that a predicate asks for: [n] or [position() = n]."""
    if isinstance(e, xpath.Binary) and e.op == "=":
        sides = [x for x in (e.left, e.right) if not (isinstance(x, xpath.Call) and x.name == "position" and not x.args)]
        return _nth(sides[0]) if len(sides) == 1 and isinstance(sides[0], xpath.Num) else None
    return int(float(e.raw)) if isinstance(e, xpath.Num) and float(e.raw).is_integer() and 0 < float(e.raw) < 2**31 else None


class Evaluator:
    """Expressions over one table of nodes."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes
        self.n = 0

    def fresh(self) -> str:
        self.n += 1
        return f"__v{self.n}"

    # Contexts are (doc_id, at, ...): ``at`` is the context node; ``c`` tells contexts apart where a node is one more than once.

    def step(self, here: DataFrame, step: xpath.Step) -> DataFrame:
        """(doc_id, c, at) of the nodes that a step finds from (doc_id, c, at), each once for each c."""
        if step.axis in SIBLINGS and step.predicates and (n := _nth(step.predicates[0])) is not None:
            found = self.nth_sibling(here, step, n)
            return self.filtered(found, step.predicates[1:], step.axis in REVERSE).select("doc_id", "c", "at").distinct()
        if step.axis in SIDES and all(map(_free, step.predicates)):
            here = self.widest(here, step.axis)
        found = self.axis(here, step.axis).filter(_test(step.test, step.axis))
        found = found.select("doc_id", "c", F.col("at").alias("from"), F.col("node_id").alias("at"))
        if not step.predicates:
            return found.select("doc_id", "c", "at").distinct()
        return self.filtered(found, step.predicates, step.axis in REVERSE).select("doc_id", "c", "at").distinct()

    def filtered(self, found: DataFrame, predicates: tuple, backwards: bool) -> DataFrame:
        """Those of (doc_id, c, from, at) that satisfy predicates, one after the other."""
        for p in predicates:
            group = Window.partitionBy("doc_id", "c", "from")
            order = group.orderBy(F.col("at").desc() if backwards else F.col("at"))
            if not _free(p):
                found = found.withColumns({"position": F.row_number().over(order).cast("double"), "last": F.count(F.lit(1)).over(group).cast("double")})
            if self.is_set(p):
                found, hold = self.truth(found, p)
            else:
                found, value, kind = self.value(found, p)
                hold = (value == F.col("position")) if kind == "number" else self.boolean(value, kind)
            found = found.filter(hold).select("doc_id", "c", "from", "at")
        return found

    def axis(self, here: DataFrame, axis: str) -> DataFrame:
        """Context columns and those of the nodes on an axis."""
        nodes = self.nodes
        point = nodes.select("doc_id", F.col("node_id").alias("at"), F.col("last_desc").alias("at_last"), F.col("parent_id").alias("at_parent"), F.col("kind").alias("at_kind"))
        if axis == "self":
            return here.join(trees.held_apart(nodes.withColumnRenamed("doc_id", "d")), (F.col("doc_id") == F.col("d")) & (F.col("at") == F.col("node_id"))).drop("d")
        if axis in ("child", "attribute"):
            low = nodes.filter((F.col("kind") == "attribute") if axis == "attribute" else (F.col("kind") != "attribute")).withColumnRenamed("doc_id", "d")
            return here.join(trees.held_apart(low), (F.col("doc_id") == F.col("d")) & (F.col("at") == F.col("parent_id"))).drop("d")
        if axis == "parent":
            up = here.join(trees.held_apart(point.select("doc_id", "at", "at_parent")), ["doc_id", "at"])
            return up.join(trees.held_apart(nodes.withColumnRenamed("doc_id", "d")), (F.col("doc_id") == F.col("d")) & (F.col("at_parent") == F.col("node_id"))).drop("d", "at_parent")
        if axis in ("descendant", "descendant-or-self"):
            top = here.join(trees.held_apart(point.select("doc_id", "at", "at_last")), ["doc_id", "at"])
            own = nodes.filter("kind != 'attribute'") if axis == "descendant" else nodes
            got = trees.contained(own, F.col("node_id"), top, F.col("at") + (1 if axis == "descendant" else 0), F.col("at_last"))
            return got.filter((F.col("kind") != "attribute") | (F.col("node_id") == F.col("at"))).drop("at_last")
        if axis in ("ancestor", "ancestor-or-self"):
            return trees.contained(here, F.col("at"), nodes, F.col("node_id") + (1 if axis == "ancestor" else 0), F.col("last_desc"))
        if axis in ("following-sibling", "preceding-sibling"):
            up = here.join(trees.held_apart(point.filter("at_kind != 'attribute'").select("doc_id", "at", "at_parent")), ["doc_id", "at"])
            low = nodes.filter("kind != 'attribute'").withColumnRenamed("doc_id", "d")
            side = (F.col("node_id") > F.col("at")) if axis == "following-sibling" else (F.col("node_id") < F.col("at"))
            return up.join(trees.held_apart(low), (F.col("doc_id") == F.col("d")) & (F.col("at_parent") == F.col("parent_id")) & side).drop("d", "at_parent")
        if axis in ("following", "preceding"):
            up = here.join(trees.held_apart(point.select("doc_id", "at", "at_last")), ["doc_id", "at"])
            low = nodes.filter("kind != 'attribute'").withColumnRenamed("doc_id", "d")
            side = (F.col("node_id") > F.col("at_last")) if axis == "following" else (F.col("last_desc") < F.col("at"))
            return up.join(trees.held_apart(low), (F.col("doc_id") == F.col("d")) & side).drop("d", "at_last")
        raise ValueError(f"the axis {axis} is not evaluated")

    def siblings(self) -> DataFrame:
        """(doc_id, at, up) and what a test reads of all nodes that may have siblings."""
        return self.nodes.filter("kind != 'attribute' and parent_id is not null").select("doc_id", F.col("node_id").alias("at"), F.col("parent_id").alias("up"), "kind", "name")

    def nth_sibling(self, here: DataFrame, step: xpath.Step, n: int) -> DataFrame:
        """(doc_id, c, from, at) of the n-th sibling that a step's test holds for, by numbers among those of one parent."""
        upto = Window.partitionBy("doc_id", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        own = _test(step.test, step.axis).cast("long")
        ranked = self.siblings().select("doc_id", "at", "up", own.alias("own")).withColumn("rank", F.sum("own").over(upto))
        due = F.col("rank") + n if step.axis == "following-sibling" else F.col("rank") - F.col("own") + 1 - n
        wanted = here.select("doc_id", "c", "at").join(trees.held_apart(ranked), ["doc_id", "at"]).select("doc_id", "c", F.col("at").alias("from"), "up", due.alias("rank"))
        return wanted.join(trees.held_apart(ranked.filter("own = 1").select("doc_id", "up", "rank", "at")), ["doc_id", "up", "rank"]).select("doc_id", "c", "from", "at")

    def widest(self, here: DataFrame, axis: str) -> DataFrame:
        """Of contexts that find parts of one row of nodes, the one that finds all of them."""
        if axis in SIBLINGS:
            up = here.select("doc_id", "c", "at").join(trees.held_apart(self.siblings().select("doc_id", "at", "up")), ["doc_id", "at"])
            return up.groupBy("doc_id", "c", "up").agg((F.min if axis == "following-sibling" else F.max)("at").alias("at")).drop("up")
        if axis == "preceding":
            return here.groupBy("doc_id", "c").agg(F.max("at").alias("at"))
        ends = here.select("doc_id", "c", "at").join(trees.held_apart(self.nodes.select("doc_id", F.col("node_id").alias("at"), "last_desc")), ["doc_id", "at"])
        return ends.groupBy("doc_id", "c").agg(F.min_by("at", "last_desc").alias("at"))

    def counted(self, e: Any) -> bool:
        """Whether a set is one step to siblings, each in it or not whatever the context."""
        return isinstance(e, xpath.Path) and e.base is None and len(e.steps) == 1 and e.steps[0].axis in SIBLINGS and all(map(_free, e.steps[0].predicates))

    def tally(self, rows: DataFrame, e: xpath.Path) -> tuple[DataFrame, Column]:
        """How many siblings a step finds from each context, by a running count."""
        (step,), n = e.steps, self.fresh()
        families = rows.select("doc_id", "at").distinct().join(trees.held_apart(self.siblings().select("doc_id", "at", "up")), ["doc_id", "at"]).select("doc_id", "up").distinct()
        own = self.siblings().join(trees.held_apart(families), ["doc_id", "up"])
        zero = F.lit(0)
        hits = own.filter(_test(step.test, step.axis)).select("doc_id", zero.alias("c"), zero.alias("from"), "at")
        hits = self.filtered(hits, step.predicates, False).select("doc_id", "at", F.lit(1).cast("long").alias("hit"))
        order = F.col("at") if step.axis == "preceding-sibling" else F.col("at").desc()
        before = Window.partitionBy("doc_id", "up").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        per = own.select("doc_id", "at", "up").join(trees.held_apart(hits), ["doc_id", "at"], "left").select("doc_id", "at", F.sum("hit").over(before).alias(n))
        return rows.join(trees.held_apart(per), ["doc_id", "at"], "left"), F.coalesce(F.col(n), F.lit(0).cast("long"))

    def path(self, here: DataFrame, p: xpath.Path) -> DataFrame:
        """(doc_id, c, at) of the nodes of a path from contexts (doc_id, c, at)."""
        steps = p.steps
        if p.base == "/":
            here = here.select("doc_id", "c", F.lit(0).alias("at")).distinct()
            if len(steps) > 1 and steps[0] == xpath.ANYWHERE and steps[1].axis == "child" and all(map(_free, steps[1].predicates)):
                here, steps = self.anywhere(here, steps[1]), steps[2:]
        elif p.base is not None:
            here = self.node_set(here, p.base)
            if p.predicates:
                here = self.filtered(here.withColumn("from", F.lit(0)), p.predicates, False).select("doc_id", "c", "at")
        for s in steps:
            here = self.step(here, s)
        return here

    def anywhere(self, here: DataFrame, step: xpath.Step) -> DataFrame:
        """(doc_id, c, at) of what //step finds, where its predicates ask for no position: nodes of the whole document, by their test alone.
        By the descendants of the root, each node would be looked for in as many blocks as a document's length has bits."""
        own = self.nodes.filter("kind != 'attribute' and parent_id is not null").filter(_test(step.test, step.axis))
        low = own.select(F.col("doc_id").alias("d"), F.col("node_id").alias("at"))
        found = here.select("doc_id", "c").join(trees.held_apart(low), F.col("doc_id") == F.col("d")).select("doc_id", "c", F.lit(0).alias("from"), "at")
        return self.filtered(found, step.predicates, False).select("doc_id", "c", "at").distinct()

    def node_set(self, here: DataFrame, e: Any) -> DataFrame:
        if isinstance(e, xpath.Path):
            return self.path(here, e)
        if isinstance(e, xpath.Binary) and e.op == "|":
            return self.node_set(here, e.left).union(self.node_set(here, e.right)).distinct()
        raise ValueError("not a set of nodes")

    def is_set(self, e: Any) -> bool:
        return isinstance(e, xpath.Path) or (isinstance(e, xpath.Binary) and e.op == "|")

    @staticmethod
    def boolean(v: Column, kind: str) -> Column:
        if kind == "boolean":
            return F.coalesce(v, F.lit(False))
        return F.coalesce((v != 0) & ~F.isnan(v) if kind == "number" else F.length(v) > 0, F.lit(False))

    @staticmethod
    def number(v: Column, kind: str) -> Column:
        if kind == "number":
            return v
        if kind == "boolean":
            return v.cast("double")
        text = F.regexp_replace(v, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
        return F.when(text.rlike(r"\A-?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)\z"), text.try_cast("double")).otherwise(F.lit(float("nan")))

    @staticmethod
    def string(v: Column, kind: str) -> Column:
        if kind == "string":
            return v
        if kind == "boolean":
            return F.when(v, "true").otherwise("false")
        whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
        return F.when(F.isnan(v), "NaN").when(whole, F.floor(v).cast("string")).when(F.abs(v) == float("inf"), F.when(v > 0, "Infinity").otherwise("-Infinity")).otherwise(v.cast("string"))

    def sets_of(self, rows: DataFrame, e: Any) -> tuple[DataFrame, DataFrame, str]:
        """Rows with a number of their own, and the nodes of a set for each: (c, at, value)."""
        mark = self.fresh()
        # What tells a context apart is its node, once for all rows that share it.
        keyed = rows.withColumn(mark, F.col("at"))
        contexts = rows.select("doc_id", F.col("at").alias("c"), "at").distinct()
        found = self.node_set(contexts, e)
        values = self.nodes.select("doc_id", F.col("node_id").alias("at"), "value", "name")
        return keyed, found.join(trees.held_apart(values), ["doc_id", "at"]), mark

    def joined(self, rows: DataFrame, e: Any, agg: Callable, empty: Column) -> tuple[DataFrame, Column]:
        keyed, found, mark = self.sets_of(rows, e)
        v = self.fresh()
        per = found.groupBy("doc_id", F.col("c").alias(mark)).agg(agg().alias(v))
        out = keyed.join(trees.held_apart(per), ["doc_id", mark], "left").drop(mark)
        return out, F.coalesce(F.col(v), empty)

    def value(self, rows: DataFrame, e: Any) -> tuple[DataFrame, Column, str]:
        """Rows, perhaps with more columns, the value of an expression for each, and its type; a set of nodes is the string of its first."""
        if isinstance(e, xpath.Num):
            return rows, F.lit(float(e.raw)), "number"
        if isinstance(e, xpath.Literal):
            return rows, F.lit(e.text), "string"
        if isinstance(e, xpath.Negation):
            rows, v, kind = self.value(rows, e.inner)
            return rows, -self.number(v, kind), "number"
        if self.is_set(e):
            rows, v = self.joined(rows, e, lambda: F.min(F.struct("at", "value"))["value"], F.lit(None).cast("string"))
            return rows, F.coalesce(v, F.lit("")), "string"
        if isinstance(e, xpath.Call):
            return self.call(rows, e)
        if isinstance(e, xpath.Binary):
            return self.binary(rows, e)
        raise ValueError(f"{xpath.print_xpath(e)} is not evaluated")

    def truth(self, rows: DataFrame, e: Any) -> tuple[DataFrame, Column]:
        if self.counted(e):
            rows, v = self.tally(rows, e)
            return rows, v > 0
        if self.is_set(e):
            return self.joined(rows, e, lambda: F.lit(True), F.lit(False))
        rows, v, kind = self.value(rows, e)
        return rows, self.boolean(v, kind)

    def binary(self, rows: DataFrame, e: xpath.Binary) -> tuple[DataFrame, Column, str]:
        if e.op in ("and", "or"):
            rows, a = self.truth(rows, e.left)
            name = self.fresh()
            rows = rows.withColumn(name, a)
            rows, b = self.truth(rows, e.right)
            return rows, (F.col(name) & b) if e.op == "and" else (F.col(name) | b), "boolean"
        if e.op in ("=", "!=", "<", "<=", ">", ">="):
            return self.compared(rows, e)
        rows, a, ka = self.value(rows, e.left)
        name = self.fresh()
        rows = rows.withColumn(name, self.number(a, ka))
        rows, b, kb = self.value(rows, e.right)
        x, y = F.col(name), self.number(b, kb)
        whole = F.when(y == 0, F.when((x == 0) | F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(x / F.when(y != 0, y))
        out = {"+": x + y, "-": x - y, "*": x * y, "div": whole, "mod": F.when(y == 0, F.lit(float("nan"))).otherwise(x % F.when(y != 0, y))}[e.op]
        return rows, out, "number"

    def compared(self, rows: DataFrame, e: xpath.Binary) -> tuple[DataFrame, Column, str]:
        turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        left, right, op = e.left, e.right, e.op
        if self.is_set(right) and not self.is_set(left):
            left, right, op = right, left, turned.get(op, op)
        order = op not in ("=", "!=")
        if self.is_set(left) and self.is_set(right):
            # Some node of one with some node of the other: all values of both for each context.
            rows, a = self.joined(rows, left, lambda: F.collect_set("value"), F.array().cast("array<string>"))
            name = self.fresh()
            rows = rows.withColumn(name, a)
            rows, b = self.joined(rows, right, lambda: F.collect_set("value"), F.array().cast("array<string>"))
            turn = (lambda v: self.number(v, "string")) if order else (lambda v: v)
            return rows, F.exists(name, lambda x: F.exists(b, lambda y: self.holds(op, turn(x), turn(y), order))), "boolean"
        if self.is_set(left):
            rows, v, kind = self.value(rows, right)
            name = self.fresh()
            rows = rows.withColumn(name, v)
            if kind == "boolean":
                rows, some = self.truth(rows, left)
                return rows, TESTS[op](some, F.col(name)), "boolean"
            rows, values = self.joined(rows, left, lambda: F.collect_set("value"), F.array().cast("array<string>"))
            as_number = order or kind == "number"
            other = self.number(F.col(name), kind) if as_number else F.col(name)
            return rows, F.exists(values, lambda x: self.holds(op, self.number(x, "string") if as_number else x, other, as_number)), "boolean"
        rows, a, ka = self.value(rows, left)
        name = self.fresh()
        rows = rows.withColumn(name, a)
        rows, b, kb = self.value(rows, right)
        a = F.col(name)
        if order or (ka != kb and "number" in (ka, kb) and "boolean" not in (ka, kb)) or ka == kb == "number":
            return rows, self.holds(op, self.number(a, ka), self.number(b, kb), True), "boolean"
        if "boolean" in (ka, kb):
            return rows, TESTS[op](self.boolean(a, ka), self.boolean(b, kb)), "boolean"
        return rows, TESTS[op](a, b), "boolean"

    @staticmethod
    def holds(op: str, a: Column, b: Column, numbers: bool) -> Column:
        """Numbers that are none are unlike all, themselves too; Spark's equal themselves and are above all others."""
        if not numbers:
            return TESTS[op](a, b)
        real = ~F.isnan(a) & ~F.isnan(b)
        return (TESTS[op](a, b) | ~real) if op == "!=" else (TESTS[op](a, b) & real)

    def call(self, rows: DataFrame, e: xpath.Call) -> tuple[DataFrame, Column, str]:
        name, args = e.name, e.args
        if name in ("position", "last") and not args:
            return rows, F.col(name), "number"
        if name in ("true", "false") and not args:
            return rows, F.lit(name == "true"), "boolean"
        if name == "count" and len(args) == 1 and self.counted(args[0]):
            rows, v = self.tally(rows, args[0])
            return rows, v.cast("double"), "number"
        if name == "count" and len(args) == 1:
            rows, v = self.joined(rows, args[0], lambda: F.count(F.lit(1)).cast("double"), F.lit(0.0))
            return rows, v, "number"
        if name == "sum" and len(args) == 1:
            rows, v = self.joined(rows, args[0], lambda: F.sum(self.number(F.col("value"), "string")), F.lit(0.0))
            return rows, v, "number"
        if name in ("name", "local-name", "namespace-uri") and len(args) <= 1:
            own = xpath.Path(None, (), (xpath.Step("self", "node()"),)) if not args else args[0]
            rows, v = self.joined(rows, own, lambda: F.min(F.struct("at", "name"))["name"], F.lit(None).cast("string"))
            v = F.coalesce(v, F.lit(""))
            return rows, {"name": v, "local-name": F.substring_index(v, ":", -1), "namespace-uri": F.lit("")}[name], "string"
        if name in ("boolean", "not") and len(args) == 1:
            rows, v = self.truth(rows, args[0])
            return rows, v if name == "boolean" else ~v, "boolean"
        if name in ("string", "number", "string-length", "normalize-space") and not args:
            args = (xpath.Path(None, (), (xpath.Step("self", "node()"),)),)
        got = []
        for a in args:
            rows, v, kind = self.value(rows, a)
            held = self.fresh()
            rows = rows.withColumn(held, v)
            got.append((F.col(held), kind))
        s, n = [self.string(*x) for x in got], [self.number(*x) for x in got]
        space = lambda v: F.regexp_replace(F.regexp_replace(v, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"[ \t\r\n]+", " ")
        made = {
            ("string", 1): lambda: (s[0], "string"),
            ("number", 1): lambda: (n[0], "number"),
            ("string-length", 1): lambda: (F.length(s[0]).cast("double"), "number"),
            ("normalize-space", 1): lambda: (space(s[0]), "string"),
            ("starts-with", 2): lambda: (s[0].startswith(s[1]), "boolean"),
            ("contains", 2): lambda: (s[0].contains(s[1]), "boolean"),
            ("translate", 3): lambda: (F.call_function("translate", s[0], s[1], s[2]), "string"),
            ("floor", 1): lambda: (F.floor(n[0]).cast("double"), "number"),
            ("ceiling", 1): lambda: (F.ceil(n[0]).cast("double"), "number"),
            ("round", 1): lambda: (F.floor(n[0] + 0.5).cast("double"), "number"),
        }
        at = F.call_function("instr", s[0], s[1]) if len(s) == 2 else None
        if name == "substring-before" and len(s) == 2:
            return rows, F.when(at > 0, F.substring(s[0], F.lit(1), at - 1)).otherwise(""), "string"
        if name == "substring-after" and len(s) == 2:
            return rows, F.when(at > 0, F.substring(s[0], at + F.length(s[1]), F.length(s[0]))).otherwise(""), "string"
        if name == "concat" and len(s) >= 2:
            return rows, F.concat(*s), "string"
        if name == "substring" and len(s) in (2, 3):
            # Positions are rounded, and what is before the text counts off the length.
            start = F.floor(n[1] + 0.5)
            stop = F.floor(n[2] + 0.5) + start if len(s) == 3 else F.length(s[0]) + 1
            low = F.greatest(start, F.lit(1))
            return rows, F.when(stop > low, F.substring(s[0], low.cast("int"), (F.least(stop, F.length(s[0]) + 1) - low).cast("int"))).otherwise(""), "string"
        if (name, len(s)) in made:
            v, kind = made[name, len(s)]()
            return rows, v, kind
        raise ValueError(f"{name}() with {len(args)} arguments is not evaluated")


def select(nodes: DataFrame, expression: str) -> DataFrame:
    """(doc_id, node_id, kind, name, value): the nodes that a path finds in each document, each once."""
    e = _parsed(expression)
    here = nodes.filter("node_id = 0").select("doc_id", F.lit(0).alias("c"), F.lit(0).alias("at"))
    found = Evaluator(nodes).node_set(here, e).select("doc_id", F.col("at").alias("node_id"))
    return found.join(trees.held_apart(nodes), ["doc_id", "node_id"]).select("doc_id", "node_id", "kind", "name", "value")


def evaluate(nodes: DataFrame, expression: str) -> DataFrame:
    """(doc_id, value string): an expression's value for each document; of a set of nodes, the first one's."""
    run = Evaluator(nodes)
    here = nodes.filter("node_id = 0").select("doc_id", F.lit(0).alias("at"), F.lit(1.0).alias("position"), F.lit(1.0).alias("last"))
    rows, v, kind = run.value(here, _parsed(expression))
    return rows.select("doc_id", run.string(v, kind).alias("value"))


def _parsed(expression: str) -> Any:
    r = xpath.parse_xpath(expression)
    if r.status == "failure":
        raise ValueError(f"not an XPath expression: wrong at {r.furthest}")
    return r.value
