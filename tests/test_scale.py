"""What keeps queries whole on large tables: sides of joins, tasks, and pairs that are never formed."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["tree_ancestors", "tree_descendants", "tree_node_at", "tree_paths", "tree_reparse_region", "tree_replace", "tree_siblings", "tree_splice"])
def test_node_tables_are_not_broadcast(spark, name):
    """Estimates of node tables are those of the files behind them."""
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "SortMergeJoin" in plan or name == "tree_replace"
    assert "Broadcast" not in plan


@pytest.mark.parametrize("name", ["xpath_ancestor", "xpath_attribute", "xpath_child", "xpath_descendant", "xpath_nested", "xpath_position", "xpath_siblings", "xpath_value"])
def test_xml_nodes_are_not_broadcast(spark, name):
    plan = plan_of(entry.queries()[name](spark, SMALL))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


XML = "<r><a/><b x='1'><e/></b>t<b x='2'/><!-- c --><b x='3'><e/></b><a/><d><b x='4'/><a/><b x='5'/></d></r>"


@pytest.mark.parametrize(
    "expression, expected",
    [
        ("//b[count(preceding-sibling::b[e]) = 1]/@x", "23"),
        ("//b[count(following-sibling::node()) = 0]/@x", "5"),
        ("//b[not(preceding-sibling::b)]/@x", "14"),
        ("//b[following-sibling::a[not(following-sibling::a)]]/@x", "1234"),
        ("//b/@x[count(following-sibling::node()) > 0]", ""),
        ("//a/preceding-sibling::b[1]/@x", "34"),
        ("//a/following-sibling::b[position() = 2]/@x", "2"),
        ("//b/following-sibling::b[1][e]/@x", "3"),
        ("//b/following-sibling::b/@x", "235"),
        ("//a/preceding-sibling::b/@x", "1234"),
        ("//e/following::b[not(e)]/@x", "245"),
        ("//a/preceding::b/@x", "1234"),
        ("//b[e]/following-sibling::b[last()]/@x", "3"),
    ],
)
def test_siblings_are_counted(spark, expression, expected):
    from loomtext.operators import xpath_axes

    nodes = xpath_axes.xml_nodes(spark.createDataFrame([(1, XML)], "doc_id long, text string"))
    assert "".join(sorted(r["value"] for r in xpath_axes.select(nodes, expression).collect())) == expected


def test_siblings_are_not_paired(spark):
    """20,000 siblings are 200 million pairs."""
    from pyspark.sql import functions as F

    from loomtext.operators import xpath_axes

    text = F.concat(F.lit("<r>"), F.repeat(F.lit("<b/><a/>"), 10_000), F.lit("</r>"))
    nodes = xpath_axes.xml_nodes(spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"))).persist()
    for e, n in (("/r/a[count(preceding-sibling::b) = 7]", 1), ("/r/a/preceding-sibling::b[2]", 9_999), ("/r/b/following-sibling::a", 10_000)):
        got = xpath_axes.select(nodes, e)
        assert got.count() == n
        # A join of pairs has an order of nodes as its condition.
        assert n == 10_000 or not re.search(r"SortMergeJoin.*(Inner|LeftOuter), \(", plan_of(got))
    nodes.unpersist()


def test_quiet_runs_give_the_same(spark):
    """A first run without errors is followed by one with them where a text fails or recovers; who asks for errors gets them."""
    from loomtext.formats import json, yaml
    from loomtext.grammar import char, digit, succeed
    from loomtext.machine import Parser, State

    number = digit.many1().capture().map(int)
    for p in (number, number.named("n") | char("x"), number.expect("n") & char("y"), number.recover(succeed(-1)), number.attempt(), char("a").not_followed_by() >> number, json.grammar(), json.lossless()):
        run = Parser(p)
        for text in ("12", "x", "y", "", "a1", "12y", "[1, 2]", '{"a": [}', "[1,"):
            assert run(text) == Parser(p).interpret(State(text))
    kept = Parser(json.lossless())
    kept("[1]")
    assert kept.calls == 1 and not kept.again
    assert yaml.parse_yaml("a:\n  - b\n  - [1, {c: d}]\n").value == {"a": ["b", [1, {"c": "d"}]]}


def test_depths_of_yaml_are_compiled_once():
    import re as patterns

    from loomtext import machine
    from loomtext.formats import yaml

    text = "a:\n  - b\n  - [1, {c: d}]\n"
    yaml.parse_yaml(text)
    made, compile_ = [], patterns.compile
    machine.re.compile = lambda *a: made.append(a) or compile_(*a)
    try:
        yaml.parse_yaml(text)
    finally:
        machine.re.compile = compile_
    assert not made


def test_right_chains_work_steps_out_once(spark):
    plan = entry.queries()["chain_right"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_tasks_hold_as_many_rows_however_many_there_are(spark):
    from loomtext import sources

    many = 12 * sources.ROWS_PER_TASK
    assert sources.spread(spark.range(many, numPartitions=2)).rdd.getNumPartitions() == 12
    assert sources.spread(spark.range(10, numPartitions=2)).rdd.getNumPartitions() == 4


def test_shards_end_between_two_texts(spark):
    """Shards are even to within the longest text, and copies of one text that outweigh a range stay together."""
    from pyspark.sql import functions as F

    from loomtext.llm import sharding

    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 80 == 0, F.repeat(F.lit("copy "), 40)).otherwise(F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")))).alias("text"))
    placed = sharding.shard(docs, 8, ranges_per_shard=4, sample_size=256).select("size", "shard", "text", "slot").persist()
    per = placed.groupBy("shard").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("hi")).collect()
    sizes = [r["b"] for r in per]
    assert len(per) == 8 and all(r["n"] == r["d"] == r["hi"] + 1 for r in per) and sum(r["n"] for r in per) == 6000
    assert placed.groupBy("text").agg(F.countDistinct("shard").alias("k")).filter("k > 1").count() == 0
    without = sharding.shard(docs.filter("doc_id % 80 != 0"), 8, ranges_per_shard=4, sample_size=256).groupBy("shard").agg(F.sum("size").alias("b"), F.max("size").alias("m")).collect()
    assert max(r["b"] for r in without) - min(r["b"] for r in without) <= 2 * max(r["m"] for r in without)
    assert max(sizes) - min(sizes) <= 2 * 75 * 201
    placed.unpersist()


def test_python_is_given_small_slices_of_blocks(spark):
    from loomtext.llm import tokencount

    n = 3 * tokencount.SLICE_BYTES // 2
    blocks = spark.createDataFrame([("f", 0, bytes([1, 0]) * n), ("f", 1, bytes([2, 0]) * 7 + bytes([0, 1]))], "file string, block long, data binary")
    assert max(len(r["data"]) for r in tokencount._sliced(blocks).collect()) == tokencount.SLICE_BYTES
    assert [tuple(r) for r in tokencount.scan_separators(blocks, 256).collect()] == [("f", 0, 0, n + 7, True)]


def test_json_is_scanned_as_its_grammar_reads_it():
    from loomtext.formats import json

    good = ['{ "id": 1, "tags": ["O", null], "in": {"c" : -2.5e3} }', "[]", "[ ]", "{}", "{ }", ' [1,[2 ,{"a":{}}] , true] ', '"x\\u00e9"', '{"a":1 ,\n"b":[false,{ }]}', "0"]
    for text in good:
        assert json.scanned(text) == json._LOSSLESS(text).value and json.parse_lossless(text) == json._LOSSLESS(text)
    for text in ("", " ", "[", "]", "[1,]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "{1:2}", "01", "1 2", "[1}", '{"a":[}', "truefalse", ",", "[,1]", '{"a" "b":1}', "{ ]"):
        assert json.scanned(text) is None and json.parse_lossless(text) == json._LOSSLESS(text)
    deep = json.scanned("[" * 100_000 + "]" * 100_000)
    assert deep.width == 200_000 and json._LOSSLESS.calls


def test_intervals_are_cut_by_compiled_expressions(spark):
    """Spark interprets functions on the elements of arrays, at some 30 microseconds a node."""
    from pyspark.sql import functions as F

    from loomtext.operators import trees

    own = spark.range(9).select(F.col("id").alias("doc_id"), F.col("id").alias("p"))
    assert "lambda" not in plan_of(trees.contained(own, F.col("p"), own.withColumnRenamed("p", "a"), F.col("a"), F.col("a") + 3))


def test_blocks_hold_what_intervals_hold(spark):
    from pyspark.sql import functions as F

    from loomtext.operators import trees

    rows = [(d, i, a, a + w) for d in (None, 1, 2) for i, (a, w) in enumerate([(0, -1), (0, 0), (3, 1), (5, 36), (7, 0), (0, 63), (64, 0), (63, 2), (1, 99)]) if (d, i) != (2, 5)]
    intervals = spark.createDataFrame(rows, "doc_id long, i int, a int, z int")
    points = spark.createDataFrame([(d, p) for d in (None, 1, 2, 3) for p in range(110)], "doc_id long, p int")
    got = {(r["doc_id"], r["p"], r["i"]) for r in trees.contained(points, F.col("p"), intervals, F.col("a"), F.col("z")).collect()}
    assert got == {(d, p, i) for d, i, a, z in rows for p in range(a, z + 1)}


def test_xml_elements_are_compiled_once(monkeypatch):
    from loomtext import machine
    from loomtext.formats import xml

    text = "<r>" + "".join(f'<p id="{i}"><n>x</n><e/></p>' for i in range(50)) + "</r>"
    xml.parse_xml(text)
    made, compiled = [], machine.Compiler.compiled
    monkeypatch.setattr(machine.Compiler, "compiled", lambda self, p: made.append(p) or compiled(self, p))
    assert len(xml.parse_xml(text).value.root.children) == 50 and not made
    wrong = xml.parse_xml("<r><a>x</b></r>")
    assert [(e.message, e.offset) for e in wrong.errors] == [("mismatched end tag: expected </a>, found </b>", 7)]
    assert "duplicate attribute in <a>" in [e.message for e in xml.parse_xml("<r><a x='1' x='2'/></r>").errors]


def test_nodes_anywhere_are_not_looked_for_in_blocks(spark):
    from loomtext.operators import xpath_axes

    nodes = xpath_axes.xml_nodes(spark.createDataFrame([(1, XML), (2, "<b x='9'/>")], "doc_id long, text string"))
    for e, n in (("//b[e]/@x", "13"), ("//b[2]/@x", "25"), ("//b/@x", "123459")):
        found = xpath_axes.select(nodes, e)
        assert "".join(sorted(r["value"] or " " for r in found.collect())) == n, e
    assert "shiftright" not in plan_of(xpath_axes.select(nodes, "//b[e]/@x"))


def _trees(n: int):
    from loomtext.formats import json
    from loomtext.machine import Node

    texts = ['{"k": 1, "a": ["s", [], {}]}', "[[1, 2], [1, 2]]", "7", '["é", "\U0001f600"]']
    made = [json.parse_lossless(t).value for t in texts] + [Node("tree", "T", "own", [Node("missing", "M"), Node("unexpected", "U", "", [Node("token", "S", "x")]), Node("tree", "E", "", [])])]
    return [(None if i % 5 == 4 else i, made[i % len(made)]) for i in range(n)]


@pytest.mark.parametrize("paths, structure", [(False, False), (True, False), (False, True), (True, True)])
def test_columns_of_nodes_are_their_rows(paths, structure):
    from loomtext.operators import trees

    made = trees._Rows(paths, structure)
    for doc, root in _trees(12):
        made.add(doc, root)
    batch = made.batch()
    assert batch.schema.types == trees._TYPES
    assert list(zip(*(c.to_pylist() for c in batch.columns), strict=True)) == [r for doc, root in _trees(12) for r in trees.rows_of(doc, root, paths, structure)]


def test_digests_that_are_kept_are_bounded(monkeypatch):
    from loomtext.machine import Node
    from loomtext.operators import trees

    monkeypatch.setattr(trees._Rows, "digests", {})
    made = trees._Rows(False, True)
    for i in range(50_010):
        made.add(i, Node("token", "N", str(i)))
    made.add(0, Node("token", "N", "x" * 300))
    assert len(made.digests) == 10 and len(set(made.structure)) == 50_011


@pytest.mark.parametrize("name, times", [("tree_node_at", 1), ("tree_paths", 2)])
def test_texts_are_parsed_once_for_each_node_table(spark, name, times):
    assert plan_of(entry.queries()[name](spark, SMALL)).count("MapInArrow") == times + (name == "tree_paths")


def test_nodes_are_found_by_their_own_text(spark):
    from loomtext.formats import json
    from loomtext.machine import Node, Result
    from loomtext.operators import trees

    long = '["' + "x" * 200 + '", [' + "1, " * 40 + "2]]"
    parse = lambda t: Result("success", Node("tree", "T", "own", [Node("missing", "M"), Node("token", "S", "x")]), (), 4, 4) if t == "ownx" else json.parse_lossless(t)
    texts = [(1, long), (2, "ownx"), (3, "7"), (4, "wrong")]
    nodes = trees.node_table(spark.createDataFrame(texts, "doc_id long, text string"), parse)
    at = [(d, x) for d, t in texts for x in range(-2, len(t) + 2)]
    got = {(r.doc_id, r.target): (r.node_id, r.depth) for r in trees.node_at(nodes, spark.createDataFrame(at * 2, "doc_id long, target int")).collect()}
    rows = [r for r in nodes.collect()]
    want = {}
    for d, x in at:
        over = [(r.depth, r.node_id) for r in rows if r.doc_id == d and r.offset <= x < r.offset + r.width]
        if over:
            want[d, x] = max(over)[::-1]
    assert got == want


def test_paths_go_on_over_batches(monkeypatch):
    import pyarrow as pa

    from loomtext.operators import trees

    monkeypatch.setattr(trees, "_PATHS_AT_ONCE", 5)
    rows = [r for doc, root in _trees(24) if doc is not None for r in trees.rows_of(doc, root, True)]
    lone = [(None, i, 1, 0) for i in range(7)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    given = ["-1,9,12" if i % 11 == 3 else "-1" if i % 11 == 5 else None for i in range(len(lone) + len(rows))]
    table = [(*x, g) for x, g in zip([*lone, *((r[0], r[1], r[5], r[4]) for r in rows)], given, strict=True)]
    for size in (7, 13, len(table)):
        parts = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*table[i : i + size], strict=True), kinds, strict=True)], names=list("abcde")) for i in range(0, len(table), size)]
        got = [p for b in trees._with_paths(iter(parts)) for p in b.column(2).to_pylist()]
        assert got == [p if g is None else [9, 12] if g != "-1" else [] for g, p in zip(given, [[]] * 7 + [r[11] for r in rows], strict=True)]


def test_arrays_do_not_go_to_python_row_by_row(spark):
    """Spark sizes a batch anew for each row, at a cost of all of its rows where a column holds arrays."""
    from loomtext.formats import json
    from loomtext.operators import trees

    texts = spark.createDataFrame([(1, "[[1, 2], []]"), (2, "7")], "doc_id long, text string")
    nodes, known = trees.node_table(texts, json.parse_lossless), trees.node_table(texts, json.parse_lossless, paths=True)
    some = nodes.filter("node_id % 2 = 0").union(known.filter("node_id % 2 = 1"))
    want = sorted(tuple(r) for r in known.select("doc_id", "node_id", "path").collect())
    for own in (nodes, known, some):
        assert sorted(tuple(r) for r in trees.paths(own).collect()) == want
        sent = re.search(r"MapInArrow _with_paths.*?\n(.*?)$", trees.paths(own)._jdf.queryExecution().optimizedPlan().toString(), re.S)
        assert sent and "array_join" in sent[1]


def test_regions_are_found_in_one_pass(spark):
    """Texts are parsed once, an interval is one row, and what a range meets is what lies across the cuts of its blocks."""
    from loomtext.operators import trees

    plan = plan_of(entry.queries()["tree_reparse_region"](spark, SMALL))
    assert plan.count("MapInArrow") == 1 and plan.count("SortMergeJoin") == 1
    spans = [(1, 0, 5000), (2, 0, 70), (3, 60, 4), (4, 64, 0), (5, 64, 6), (6, 70, 4930), (7, 4090, 10), (8, 4096, 0), (9, 2**31 - 9, 5)]
    rows = [(d, n, a, w, n, "K" if n % 4 else "L") for d in (None, 1, 2) for n, a, w in spans]
    nodes = spark.createDataFrame(rows, "doc_id long, node_id int, offset int, width int, depth int, kind string")
    places = [-1, 0, 3, 60, 63, 64, 65, 70, 71, 4089, 4096, 4100, 4101, 5000, 5001, 2**31 - 9, 2**31 - 4]
    asked = [(d, a, z) for d in (None, 1, 3) for a in places for z in places] + [(1, None, 3), (1, 3, None)]
    for kinds in (None, ["L"]):
        got = {(r.doc_id, r.start, r.end): r.node_id for r in trees.enclosing(nodes, spark.createDataFrame(asked * 2, "doc_id long, start int, end int"), kinds).collect()}
        want = {}
        for d, a, z in asked:
            over = [n for e, n, o, w, _, k in rows if e == d and (kinds is None or k in kinds) and a is not None and z is not None and o <= a <= o + w and z <= o + w]
            if over:
                want[d, a, z] = max(over)
        assert got == want


def test_splicing_brings_documents_together_once(spark):
    plan = plan_of(entry.queries()["tree_replace"](spark, SMALL))
    assert "SortMergeJoin" not in plan and "Window" not in plan


@pytest.mark.parametrize("size", [2, 7, 1000])
def test_splicing_goes_on_over_batches(spark, size):
    """Against trees changed one by one; what is in a target, in no node or in no document is left out."""
    import random

    from loomtext import splice
    from loomtext.formats import json
    from loomtext.machine import Node
    from loomtext.operators import trees

    r = random.Random(size)
    roots = {d: json.parse_lossless(json_text).value for d, json_text in enumerate(['{"k": 1, "a": ["é", [], {}]}', "[[1, 2], [3, [4, 5]]]", "7", '[["\U0001f600"], 1]'] * 3)}
    small = [Node("token", "N", "99"), Node("tree", "T", "own", [Node("missing", "M"), Node("tree", "E", "x", [Node("token", "S", "yz")])])]
    table = {d: trees.rows_of(d, root, True) for d, root in roots.items()}
    new, want = [], {}
    for d, root in roots.items():
        chosen = sorted(r.sample(range(len(table[d])), min(3, len(table[d]))) if d % 5 else [])
        outer, end = [], -1
        for t in chosen:
            tree = small[r.randrange(2)]
            new += [(d, t, *x[1:9]) for x in trees.rows_of(d, tree)]
            if t > end:
                outer.append((t, tree))
                end = table[d][t][2]
        for t, tree in reversed(outer):
            root = splice.replace_at(root, table[d][t][11], tree)
        want[d] = [x[:11] for x in trees.rows_of(d, root)]
    new += [(0, 99, *x[1:9]) for x in trees.rows_of(0, small[1])] + [(50, 0, *x[1:9]) for x in trees.rows_of(0, small[1])] + [(None, 0, *x[1:9]) for x in trees.rows_of(0, small[0])]
    lone = [(None, *x[1:]) for x in table[1]]
    schema = "doc_id long, target int, node_id int, last_desc int, parent_id int, child_index int, depth int, node_class string, kind string, text string"
    nodes = spark.createDataFrame([x for rows in table.values() for x in rows] + lone * 2, trees.NODE)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = [tuple(x) for x in trees.spliced(nodes, spark.createDataFrame(new, schema)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {x[11:] for x in got} == {(None, None)}
    for d in want:
        assert sorted(x[:11] for x in got if x[0] == d) == want[d]
    assert sorted(x[1:11] for x in got if x[0] is None) == sorted(x[1:11] for x in lone * 2)
    assert len(got) == sum(map(len, want.values())) + 2 * len(lone)


def test_catalogues_are_parsed_before_the_steps_that_read_them(spark):
    """Steps begin at one time, and each would parse what is not kept yet."""
    from loomtext import queries

    spark.catalog.clearCache()
    nodes = queries._catalog(spark, SMALL)
    kept = [(x.numCachedPartitions(), x.numPartitions()) for x in spark.sparkContext._jsc.sc().getRDDStorageInfo()]
    assert any(a == b == 4 * spark.sparkContext.defaultParallelism for a, b in kept)
    nodes.unpersist()
