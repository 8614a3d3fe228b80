"""Queries for the engine's own operators, and the SQL that gives the same rows.

Most parse text rendered from relational columns, so that the SQL needs no parser: it reads the columns.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import derive, plans
from .formats import csv, json, proto, toml, xml, xpath, yaml
from .formats.common import block_comment, double_quoted_string, floating_point, hspaces, identifier
from .functions import and_then, column_of, is_failure, is_partial, line_of, line_starts, register, result_summary, same_result, show_error, show_result, span_at, span_in, utf16_offset
from .grammar import OnPair, Op, P, Ref, alpha_num, any_char, c_family, char, choice, digit, eof, fail, first_char_choice, keywords, letter, none_of, offset, one_of, pratt, satisfy, spaces, string, string_in, succeed, symbol, token, tree_of
from .incremental import TextEdit, json_bundle, reparse, reparse_all
from .operators import edits, trees, xpath_axes
from .sources import read_table, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


number = digit.many1().capture().map(int)


# Primitives and combinators, lowered to JVM expressions.


def lowered(name: str, table: str, key: str, column: str, p: P, sql: str) -> None:
    """What a regular grammar takes from the start of a column."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = read_table(spark, d, table)
        text = F.col(column)
        return t.select(key, plans.captured(text, p).alias("value"), plans.consumed(text, p).alias("consumed"))

    run.__name__ = name
    query(f"SELECT {key}, CASE WHEN ok THEN v END AS value, CAST(CASE WHEN ok THEN length(v) END AS INTEGER) AS consumed FROM (SELECT {key}, {sql} FROM {table})")(run)


def _re(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '^(?:{pattern})') AS ok, regexp_extract({column}, '^({pattern})', 1) AS v"


lowered("char_any", "part", "p_partkey", "p_name", any_char, _re("p_name", "(?s:.)"))
lowered("digit_many1", "customer", "c_custkey", "c_name", letter.many1() >> char("#") >> digit.many1(), _re("c_name", "[A-Za-z]+#[0-9]+"))
lowered("letters_prefix", "part", "p_partkey", "p_name", letter.many1(), _re("p_name", "[A-Za-z]+"))
lowered("one_of_run", "part", "p_partkey", "p_type", one_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ").many(), _re("p_type", "[A-Z]*"))
lowered("none_of_run", "part", "p_partkey", "p_type", none_of(" ").many1(), _re("p_type", "[^ ]+"))
lowered("optional_sign", "events", "event_id", "props", char("{") >> char("-").optional() >> spaces >> char('"'), _re("props", '[{]-?\\s*"'))
lowered("sep_by_words", "part", "p_partkey", "p_name", letter.many1().sep_by1(char(" ")), _re("p_name", "[A-Za-z]+(?: [A-Za-z]+)*"))
lowered("end_by_words", "part", "p_partkey", "p_type", letter.many1().end_by(char(" ")), _re("p_type", "(?:[A-Za-z]+ )*"))
lowered("count_three", "customer", "c_custkey", "c_name", letter.count(3), _re("c_name", "[A-Za-z]{3}"))
lowered("at_least_two", "customer", "c_custkey", "c_name", alpha_num.at_least(2), _re("c_name", "[A-Za-z0-9]{2,}"))
lowered("between_quotes", "events", "event_id", "props", char("{") >> none_of('"').many1().between(char('"'), char('"')), _re("props", '[{]"[^"]+"'))
lowered("whole_input", "nation", "n_nationkey", "n_name", (letter | one_of(" _")).many1() << eof, "regexp_full_match(n_name, '[A-Za-z _]+') AS ok, n_name AS v")
lowered("lexeme_symbol", "part", "p_partkey", "p_type", letter.many1().lexeme() >> letter.many1(), _re("p_type", "[A-Za-z]+\\s+[A-Za-z]+"))
lowered("string_literal", "customer", "c_custkey", "c_name", string("Customer"), "starts_with(c_name, 'Customer') AS ok, 'Customer' AS v")
lowered("look_ahead", "part", "p_partkey", "p_name", letter.many1() << char(" ").look_ahead(), "regexp_matches(p_name, '^[A-Za-z]+ ') AS ok, regexp_extract(p_name, '^([A-Za-z]+) ', 1) AS v")
lowered("string_in_longest", "orders", "o_orderkey", "o_orderpriority", string_in("1", "1-URGENT", "2-HIGH", "3-MEDIUM", "4"), "o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') OR left(o_orderpriority, 1) IN ('1', '4') AS ok, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE left(o_orderpriority, 1) END AS v")
lowered("not_followed_by", "part", "p_partkey", "p_type", char("S").not_followed_by() >> letter.many1(), "p_type NOT LIKE 'S%' AND regexp_matches(p_type, '^[A-Za-z]') AS ok, regexp_extract(p_type, '^([A-Za-z]+)', 1) AS v")


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS low, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS high FROM events GROUP BY 1")
def json_events(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: JSON properties parsed by our grammar, aggregated."""
    k = plans.parse_value(F.col("props"), json.parse_json, "bigint", lambda v: int(v["k"].raw) if "k" in v else None)
    return spread(read_table(spark, d, "events")).select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS level, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS failed FROM orders")
def keyword_values(spark: SparkSession, d: str) -> DataFrame:
    p = keywords({"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3})
    level = plans.parse_value(F.col("o_orderpriority"), p, "int")
    return read_table(spark, d, "orders").select("o_orderkey", level.alias("level"), level.isNull().alias("failed"))


@query("SELECT p_partkey, CAST(CASE WHEN p_type LIKE 'S%' THEN 1 WHEN p_type LIKE 'P%' OR p_type LIKE 'E%' THEN 2 ELSE 0 END AS INTEGER) AS route FROM part")
def first_char_dispatch(spark: SparkSession, d: str) -> DataFrame:
    p = first_char_choice(("S", any_char.as_(1)), ("PE", any_char.as_(2)), fallback=succeed(0))
    return read_table(spark, d, "part").select("p_partkey", plans.parse_value(F.col("p_type"), p, "int").alias("route"))


_TERM = "concat(l_orderkey, '+', l_linenumber, '*', l_partkey, '-', l_suppkey)"
_SUM = "sum(l_orderkey + l_linenumber * l_partkey - l_suppkey)"


def _arithmetic(name: str, p: P, render: Callable[[], Column], sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = spread(read_table(spark, d, "lineitem")).select("l_linenumber", plans.parse_value(render(), p << eof, "bigint").alias("v"))
        return t.groupBy("l_linenumber").agg(F.count("v").alias("n"), F.sum("v").alias("total"))

    run.__name__ = name
    query(f"SELECT l_linenumber, count(*) AS n, CAST({sql} AS BIGINT) AS total FROM lineitem GROUP BY 1")(run)


_BINARY = [("+", 1, operator.add), ("-", 1, operator.sub), ("*", 2, operator.mul)]
_mul = number.chain_left1(char("*").as_(operator.mul))
_sum = _mul.chain_left1(char("+").as_(operator.add) | char("-").as_(operator.sub))
_left = Ref()
_left.set((((_left << char("+")) & _mul).map(OnPair(operator.add)) | ((_left << char("-")) & _mul).map(OnPair(operator.sub)) | _mul).rule("sum"))
_term = lambda: F.expr(_TERM)
_arithmetic("chain_left", _sum, _term, _SUM)
_arithmetic("pratt_table", pratt(number, *[Op("left", char(s), p, f) for s, p, f in _BINARY]), _term, _SUM)
_arithmetic("c_family_precedence", c_family(number), _term, _SUM)
_arithmetic("left_recursion", _left, _term, _SUM)
_arithmetic("chain_right", number.chain_right1(char("-").as_(operator.sub)), lambda: F.expr("concat_ws('-', l_orderkey, l_linenumber, l_suppkey)"), "sum(l_orderkey - (l_linenumber - l_suppkey))")
_arithmetic("sep_by_sum", number.sep_by(char(",")).map(sum), lambda: F.expr("concat_ws(',', l_orderkey, l_partkey, l_suppkey)"), "sum(l_orderkey + l_partkey + l_suppkey)")
_arithmetic("flat_map_counted", number.lexeme().flat_map(lambda n: (number.lexeme()).count(n)).map(sum), lambda: F.expr("concat_ws(' ', 2, l_partkey, l_suppkey)"), "sum(l_partkey + l_suppkey)")
_arithmetic("defer_memo", Ref().set((char("(") >> number.memoize() << char(")")) | number), lambda: F.expr("concat('(', l_partkey, ')')"), "sum(l_partkey)")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Order keys, every third with a letter in front."""
    return spread(read_table(spark, d, "orders")).select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('x', o_orderkey) ELSE cast(o_orderkey as string) END").alias("t"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'partial' ELSE 'success' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'Unexpected ''x'' (expected: digit) at line 1, column 1 (offset 0)' END AS error FROM orders")
def recover_fallback(spark: SparkSession, d: str) -> DataFrame:
    r = plans.parse(F.col("t"), number.recover(succeed(-1)), "bigint")
    return _mixed(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.status", "r.value", F.when(is_partial(F.col("r")), show_error(F.get("r.errors", F.lit(0)))).alias("error"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 'a key is needed' END AS message FROM orders")
def expect_message(spark: SparkSession, d: str) -> DataFrame:
    r = plans.parse(F.col("t"), number.named("key").expect("a key is needed"), "bigint")
    return _mixed(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.value", F.when(is_failure(F.col("r")), F.get("r.errors", F.lit(0))["message"]).alias("message"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'failure' ELSE 'success' END AS inner_status, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE length(CAST(o_orderkey AS VARCHAR)) END AS INTEGER) AS consumed FROM orders")
def attempt_reified(spark: SparkSession, d: str) -> DataFrame:
    r = plans.parse(F.col("t"), number.attempt(), "string", lambda v: v.status)
    return _mixed(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.value").alias("inner_status"), "r.consumed")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_orderkey END AS value FROM orders")
def or_else_value(spark: SparkSession, d: str) -> DataFrame:
    p = choice(number << eof, number.recover_value(lambda e: -1))
    return _mixed(spark, d).select("o_orderkey", plans.parse_value(F.col("t"), p, "bigint").alias("value"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_orderkey ELSE NULL END AS skipped, CAST(length(CAST(o_orderkey AS VARCHAR)) + (o_orderkey % 3 = 0)::INT + 1 AS INTEGER) AS consumed FROM orders")
def sync_until_statement(spark: SparkSession, d: str) -> DataFrame:
    p = number.sync_until(";") << char(";")
    r = plans.parse(F.concat("t", F.lit("; rest")), p, "string", lambda v: None if isinstance(v, int) else v.source())
    return _mixed(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.value").alias("skipped"), "r.consumed")


@query("SELECT o_orderkey, CAST(length(CAST(o_orderkey AS VARCHAR)) + 1 AS INTEGER) AS at FROM orders")
def offset_position(spark: SparkSession, d: str) -> DataFrame:
    t = spread(read_table(spark, d, "orders")).select("o_orderkey", F.concat(F.lit("#"), F.col("o_orderkey")).alias("t"))
    return t.select("o_orderkey", plans.parse_value(F.col("t"), char("#") >> number >> offset, "int").alias("at"))


# Formats.


@query("SELECT c_custkey, CAST(3 AS INTEGER) AS n, c_name AS name, 'a \"quoted\", line\nbreak' AS note FROM customer")
def csv_fields(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "customer")
    line = csv.format_fields(F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.lit('a "quoted", line\nbreak')))
    return t.select("c_custkey", csv.record_fields(line).alias("f")).select("c_custkey", F.size("f").alias("n"), F.col("f")[1].alias("name"), F.col("f")[2].alias("note"))


def _customer_csv(spark: SparkSession, d: str) -> DataFrame:
    """One CSV text for each customer: a header and a row."""
    t = spread(read_table(spark, d, "customer"))
    return t.select("c_custkey", F.concat(F.lit("id,name,segment\n"), F.col("c_custkey"), F.lit(',"'), F.col("c_name"), F.lit('","say ""'), F.col("c_mktsegment"), F.lit('"""')).alias("t"))


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, 'say \"' || c_mktsegment || '\"' AS segment FROM customer")
def csv_maps(spark: SparkSession, d: str) -> DataFrame:
    m = plans.parse_value(F.col("t"), csv.parse_maps, "array<string>", lambda v: [v[0]["id"], v[0]["name"], v[0]["segment"]])
    return _customer_csv(spark, d).select("c_custkey", m.alias("m")).select("c_custkey", F.col("m")[0].alias("id"), F.col("m")[1].alias("name"), F.col("m")[2].alias("segment"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'failure' ELSE 'success' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'Inconsistent columns: expected 3, found 1 at row 3' END AS message FROM customer")
def csv_strict(spark: SparkSession, d: str) -> DataFrame:
    t = _customer_csv(spark, d).withColumn("t", F.when(F.col("c_custkey") % 2 == 0, F.concat("t", F.lit("\nshort"))).otherwise(F.col("t")))
    r = plans.parse(F.col("t"), csv.parse_strict, "int", len)
    return t.select("c_custkey", r.alias("r")).select("c_custkey", "r.status", F.when(is_failure(F.col("r")), F.get("r.errors", F.lit(0))["message"]).alias("message"))


@query("SELECT c_custkey, 'id,name,segment' || chr(10) || c_custkey || ',' || c_name || ',\"say \"\"' || c_mktsegment || '\"\"\"' AS text FROM customer")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return _customer_csv(spark, d).select("c_custkey", plans.parse_value(F.col("t"), csv.parse_csv, "string", csv.format_csv).alias("text"))


def _order_json(spark: SparkSession, d: str) -> DataFrame:
    t = spread(read_table(spark, d, "orders"))
    return t.select("o_orderkey", F.expr("""concat('{ "id": ', o_orderkey, ', "tags": ["', o_orderstatus, '", "', o_orderpriority, '", null], "in": {"c" : ', o_custkey, '} }')""").alias("t"))


@query("SELECT o_orderkey, o_orderkey AS id, o_orderpriority AS tag, o_custkey AS c FROM orders")
def json_nested(spark: SparkSession, d: str) -> DataFrame:
    v = plans.parse_value(F.col("t"), json.parse_json, "struct<id:bigint,tag:string,c:bigint>", lambda v: {"id": int(v["id"].raw), "tag": v["tags"][1], "c": int(v["in"]["c"].raw)})
    return _order_json(spark, d).select("o_orderkey", v.alias("v")).select("o_orderkey", "v.*")


@query("""SELECT o_orderkey AS doc_id, '{ "id": ' || o_orderkey || ', "tags": ["' || o_orderstatus || '", "' || o_orderpriority || '", null], "in": {"c" : ' || o_custkey || '} }' AS text FROM orders""")
def json_lossless_source(spark: SparkSession, d: str) -> DataFrame:
    return trees.to_source(_nodes(spark, d))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return trees.node_table(_order_json(spark, d), json.parse_lossless, "o_orderkey", "t")


#: {"k": <key>, "a": ["s1", "s2", ...]} with key % 4 strings: documents of different shapes.
_SHAPES = "WITH o AS (SELECT o_orderkey AS doc_id, length(CAST(o_orderkey AS VARCHAR)) AS l, o_orderkey % 4 AS m FROM orders) "


def _shapes(spark: SparkSession, d: str, **how) -> DataFrame:
    strings = "array_join(transform(filter(array(1, 2, 3), i -> i <= o_orderkey % 4), i -> concat('\"s', i, '\"')), ', ')"
    t = spread(read_table(spark, d, "orders")).select("o_orderkey", F.expr(f"""concat('{{"k": ', o_orderkey, ', "a": [', {strings}, ']}}')""").alias("t"))
    return trees.node_table(t, json.parse_lossless, "o_orderkey", "t", **how)


def _orders(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read_table(spark, d, "orders").select(k.alias("doc_id"), F.length(k.cast("string")).alias("l"), (k % 4).alias("m"))


@query(_SHAPES + "SELECT doc_id, CAST(1 AS BIGINT) AS objects, CAST(1 AS BIGINT) AS arrays, CAST(2 AS BIGINT) AS members, CAST(2 + m AS BIGINT) AS strings, CAST(1 + greatest(m - 1, 0) AS BIGINT) AS commas FROM o")
def tree_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.sum((F.col("kind") == k).cast("long"))
    return _shapes(spark, d).groupBy("doc_id").agg(n("Object").alias("objects"), n("Array").alias("arrays"), n("Member").alias("members"), n("String").alias("strings"), n("Comma").alias("commas"))


@query(_SHAPES + """, t AS (SELECT doc_id, l, CAST(doc_id % (14 + l) AS INTEGER) AS target FROM o)
    SELECT doc_id, target, CASE WHEN target = 0 THEN 'LeftBrace' WHEN target < 4 THEN 'String' WHEN target = 4 THEN 'Colon' WHEN target = 5 THEN 'Whitespace' WHEN target < 6 + l THEN 'Number' WHEN target = 6 + l THEN 'Comma'
        WHEN target = 7 + l THEN 'Whitespace' WHEN target < 11 + l THEN 'String' WHEN target = 11 + l THEN 'Colon' WHEN target = 12 + l THEN 'Whitespace' ELSE 'LeftBracket' END AS kind FROM t""")
def tree_node_at(spark: SparkSession, d: str) -> DataFrame:
    targets = _orders(spark, d).select("doc_id", F.expr("doc_id % (14 + l)").cast("int").alias("target"))
    return trees.node_at(_shapes(spark, d), targets).select("doc_id", "target", "kind")


@query(_SHAPES + "SELECT doc_id, 'Array' AS above, CAST(CASE m WHEN 0 THEN 2 ELSE 3 * m END AS BIGINT) AS n FROM o UNION ALL SELECT doc_id, 'Object', CAST(14 + CASE m WHEN 0 THEN 2 ELSE 3 * m END AS BIGINT) FROM o")
def tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    """How much lies below each array and object."""
    nodes = _shapes(spark, d)
    below = trees.descendants(nodes, F.col("kind").isin("Object", "Array"))
    names = nodes.select("doc_id", F.col("node_id").alias("ancestor_id"), F.col("kind").alias("above"))
    return below.join(trees.held_apart(names), ["doc_id", "ancestor_id"]).groupBy("doc_id", "above").agg(F.count(F.lit(1)).alias("n"))


@query(_SHAPES + """SELECT doc_id, CAST(CASE doc_id % 3 WHEN 0 THEN 8 ELSE 14 + l END AS INTEGER) AS start, CASE doc_id % 3 WHEN 0 THEN 'Object' ELSE 'Array' END AS kind, CAST(CASE doc_id % 3 WHEN 0 THEN 0 ELSE 13 + l END AS INTEGER) AS offset,
    CAST(CASE m WHEN 0 THEN 2 ELSE 6 * m END + CASE doc_id % 3 WHEN 0 THEN 14 + l ELSE 0 END AS INTEGER) AS width FROM o""")
def tree_reparse_region(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("CASE doc_id % 3 WHEN 0 THEN 8 ELSE 14 + l END").cast("int")
    ranges = _orders(spark, d).select("doc_id", start.alias("start"), start.alias("end"))
    return trees.enclosing(_shapes(spark, d), ranges, ["Object", "Array"]).select("doc_id", "start", "kind", "offset", "width")


@query("SELECT o_orderkey % 4 AS m, count(*) AS n, CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 6 * (o_orderkey % 4) END AS INTEGER) AS width FROM orders GROUP BY ALL")
def tree_interned_trees(spark: SparkSession, d: str) -> DataFrame:
    """Arrays that are equal in kinds, texts and shape are one entry."""
    found = trees.interned_trees(_shapes(spark, d, structure=True)).filter("kind = 'Array'")
    return found.select(F.expr("CAST(CASE width WHEN 2 THEN 0 ELSE width / 6 END AS BIGINT)").alias("m"), "n", "width")


@query(_SHAPES + "SELECT doc_id, CAST(1 AS INTEGER) AS line, CAST(14 + l AS INTEGER) AS \"column\" FROM o UNION ALL SELECT doc_id, 1, CAST(15 + 6 * (i - 1) + l AS INTEGER) FROM o, unnest(range(1, m + 1)) t(i)")
def tree_locations(spark: SparkSession, d: str) -> DataFrame:
    """Line and column of each array and of the strings in it."""
    nodes = trees.located(_shapes(spark, d, paths=True))
    return nodes.filter("kind = 'Array' or (kind = 'String' and depth = 4)").select("doc_id", "line", "column")


@query("""SELECT o_orderkey AS doc_id, '{ "id": 0, "tags": ["' || o_orderstatus || '", "' || o_orderpriority || '", null], "in": {"c" : ' || o_custkey || '} }' AS text FROM orders""")
def tree_replace(spark: SparkSession, d: str) -> DataFrame:
    # Parsed twice, which takes less than to keep the nodes does.
    nodes = _nodes(spark, d)
    first = nodes.filter("kind = 'Number'").groupBy("doc_id").agg(F.min("node_id").alias("target")).withColumn("new_text", F.lit("0"))
    return trees.to_source(trees.replace_at(nodes, first))


@query("""SELECT o_orderkey AS doc_id, '{"k": ' || o_orderkey || ', "a": <' || o_custkey || '>}' AS text, CAST(16 AS BIGINT) AS nodes, CAST(16 + length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)) AS INTEGER) AS width, 'token' AS class, CAST(13 + length(CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS offset FROM orders""")
def tree_splice(spark: SparkSession, d: str) -> DataFrame:
    """Each array, whatever it holds, becomes a token: texts, numbers, widths and offsets of the new node table."""
    nodes = _shapes(spark, d).persist()
    keys = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("<"), "o_custkey", F.lit(">")).alias("new_text"))
    new = trees.replace_at(nodes, nodes.filter("kind = 'Array'").select("doc_id", F.col("node_id").alias("target")).join(trees.held_apart(keys), "doc_id")).persist()
    per = new.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.when(F.col("node_id") == 0, F.col("width"))).alias("width"), F.max(F.when(F.col("kind") == "Array", F.struct(F.col("node_class").alias("class"), "offset"))).alias("a"))
    return trees.to_source(new).join(trees.held_apart(per), "doc_id").select("doc_id", "text", "nodes", "width", "a.class", "a.offset")


@query("SELECT count(*) AS tokens, CAST(sum(n) AS BIGINT) AS total FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
def tree_interned(spark: SparkSession, d: str) -> DataFrame:
    order = spread(read_table(spark, d, "orders")).select("o_orderkey", F.concat(F.lit('"'), "o_orderstatus", F.lit('"')).alias("t"))
    found = trees.interned(trees.node_table(order, json.parse_lossless, "o_orderkey", "t"))
    return found.agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("total"))


@query("SELECT c_custkey, c_name AS name, c_custkey AS id, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer")
def toml_config(spark: SparkSession, d: str) -> DataFrame:
    t = spread(read_table(spark, d, "customer"))
    text = F.expr("""concat('# customer\nid = ', c_custkey, '\n[person]\nname = "', c_name, '"\n[person.place]\nnation = ', c_nationkey, ' # key\n[[accounts]]\nbalance = ', format_string('%.2f', c_acctbal), '\n')""")
    v = plans.parse_value(text, toml.parse_toml, "struct<name:string,id:bigint,nation:bigint,balance:double>", _toml_row)
    return t.select("c_custkey", v.alias("v")).select("c_custkey", "v.name", F.col("v.id").cast("bigint").alias("id"), F.col("v.nation").alias("nation"), F.col("v.balance").alias("balance"))


def _toml_row(root: toml.Table) -> dict:
    person = root.subtables["person"][0]
    return {"name": person.pairs["name"], "id": root.pairs["id"], "nation": person.subtables["place"][0].pairs["nation"], "balance": float(root.subtables["accounts"][0].pairs["balance"])}


@query("SELECT c_custkey, c_name AS name, c_custkey AS id, CAST(2 AS INTEGER) AS tags FROM customer")
def yaml_document(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("concat('name: ', c_name, '\nid: ', c_custkey, '\ntags:\n  - ', c_mktsegment, '\n  - [1, {a: b}]\n')")
    v = plans.parse_value(text, yaml.parse_yaml, "struct<name:string,id:bigint,tags:int>", lambda v: {"name": v["name"], "id": v["id"], "tags": len(v["tags"])})
    return spread(read_table(spark, d, "customer")).select("c_custkey", v.alias("v")).select("c_custkey", "v.*")


@query("SELECT p_partkey, p_name AS name, 'x<&' || p_size AS note, CAST(1 AS INTEGER) AS children FROM part")
def xml_elements(spark: SparkSession, d: str) -> DataFrame:
    text = F.expr("""concat('<?xml version="1.0"?><!DOCTYPE part [<!ENTITY lead "x">]><part note="&lead;&lt;&amp;', p_size, '"><!-- c --><n:name>', p_name, '</n:name></part>')""")
    v = plans.parse_value(text, _xml_parse, "struct<name:string,note:string,children:int>", _xml_row)
    return spread(read_table(spark, d, "part")).select("p_partkey", v.alias("v")).select("p_partkey", "v.*")


def _xml_parse(text: str):
    return xml.parse_xml(text, xml.Config(keep_comments=False))


def _xml_row(doc: xml.Document) -> dict:
    return {"name": doc.root.children[0].children[0].text, "note": doc.root.attributes[0][1], "children": len(doc.root.children)}


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'failure' ELSE 'success' END AS status, CAST(CASE WHEN page_id % 3 <> 0 THEN length(coalesce(html, '')) END AS INTEGER) AS n, true AS placed FROM pages")
def xml_pages(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages are no XML: a failure with a position, not an error of the job. In a CDATA section they are text, kept as it is."""
    html = F.coalesce("html", F.lit(""))
    text = F.when(F.col("page_id") % 3 == 0, html).otherwise(F.concat(F.lit("<page><![CDATA["), html, F.lit("]]></page>")))
    r = plans.parse(text, xml.parse_xml, "int", _page_length)
    return spread(read_table(spark, d, "pages")).select("page_id", r.alias("r")).select("page_id", "r.status", F.col("r.value").alias("n"), (~is_failure(F.col("r")) | (F.size("r.errors") > 0)).alias("placed"))


def _page_length(doc: xml.Document) -> int:
    return sum(len(c.text) for c in doc.root.children)


_CATALOG = """concat('<catalog n="', count(1), '">', array_join(transform(array_sort(collect_list(struct(p_partkey, p_name, p_size, p_brand))), x -> concat('<part id="', x.p_partkey, '" size="', x.p_size, '"><name>', x.p_name, '</name>', IF(x.p_size % 2 = 0, '<even/>', ''), '<maker><name>', x.p_brand, '</name></maker></part>')), ''), '</catalog>')"""


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """One document for each of 50 groups of parts."""
    t = read_table(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("g")).agg(F.expr(_CATALOG).alias("t"))
    # Every step of a path reads the nodes: they are parsed once, in a few tasks a core, since each step has as many. And before the
    # steps: these begin at one time, and would each parse texts that another one is at.
    nodes = xpath_axes.xml_nodes(t.repartition(4 * spark.sparkContext.defaultParallelism, "g"), "g", "t").persist()
    nodes.count()
    return nodes


def _xpath(name: str, expression: str, sql: str) -> None:
    """Nodes that a path finds: how many and their values, by document."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        found = xpath_axes.select(_catalog(spark, d), expression)
        return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))

    run.__name__ = name
    query(f"WITH p AS (SELECT *, CAST(p_partkey % 50 AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) AS i, count(*) OVER (PARTITION BY p_partkey % 50) AS k FROM part) SELECT doc_id, count(*) AS n, min(v) AS low, max(v) AS high FROM ({sql}) GROUP BY 1")(run)


_xpath("xpath_child", "/catalog/part/name", "SELECT doc_id, p_name AS v FROM p")
_xpath("xpath_descendant", "//name", "SELECT doc_id, p_name AS v FROM p UNION ALL SELECT doc_id, p_brand FROM p")
_xpath("xpath_attribute", "//part[@size > 25 and not(even)]/@id", "SELECT doc_id, CAST(p_partkey AS VARCHAR) AS v FROM p WHERE p_size > 25 AND p_size % 2 = 1")
_xpath("xpath_position", "/catalog/part[position() = last()]/name | /catalog/part[2]/maker/name", "SELECT doc_id, p_name AS v FROM p WHERE i = k UNION ALL SELECT doc_id, p_brand FROM p WHERE i = 2")
_xpath("xpath_ancestor", "//maker/name[. = 'Brand#13']/ancestor::part[1]/@size", "SELECT doc_id, CAST(p_size AS VARCHAR) AS v FROM p WHERE p_brand = 'Brand#13'")
_xpath("xpath_siblings", "//even/following-sibling::maker/../preceding-sibling::part[1]/name", "SELECT a.doc_id, a.p_name AS v FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.i = a.i + 1 WHERE b.p_size % 2 = 0")
_xpath("xpath_nested", "/catalog/part[count(preceding-sibling::part[even]) = 1][contains(name, 'a') or starts-with(maker/name, 'M')]/@id", "SELECT doc_id, CAST(p_partkey AS VARCHAR) AS v FROM (SELECT *, coalesce(sum(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM p) WHERE e = 1 AND (contains(p_name, 'a') OR starts_with(p_brand, 'M'))")


@query("SELECT CAST(p_partkey % 50 AS BIGINT) AS doc_id, count(*) || ':' || CAST(sum(p_size) AS BIGINT) || ':' || arg_min(p_name, p_partkey) AS value FROM part GROUP BY 1")
def xpath_value(spark: SparkSession, d: str) -> DataFrame:
    return xpath_axes.evaluate(_catalog(spark, d), "concat(/catalog/@n, ':', sum(//part/@size), ':', normalize-space(//name))")


_DATED = """CASE o_orderkey % 5 WHEN 0 THEN concat('d = 2024-02-', 10 + o_orderkey % 20, ' # ', o_orderkey) WHEN 1 THEN concat('k = ', o_orderkey, '\nd = 2023-02-29') WHEN 2 THEN concat('n = ', o_orderkey, '9999999999999999999') WHEN 3 THEN concat('t = 25:61:00 #', o_orderkey) ELSE concat('n = -', o_orderkey) END"""


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 'success' ELSE 'failure' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'd=2024-02-' || (10 + o_orderkey % 20) WHEN 4 THEN 'n=-' || o_orderkey END AS value,
    CAST(CASE o_orderkey % 5 WHEN 1 THEN 9 + length(CAST(o_orderkey AS VARCHAR)) WHEN 2 THEN 4 WHEN 3 THEN 4 END AS INTEGER) AS at,
    CASE o_orderkey % 5 WHEN 1 THEN 'invalid date or time: 2023-02-29' WHEN 2 THEN 'integer out of range: ' || o_orderkey || '9999999999999999999' WHEN 3 THEN 'invalid date or time: 25:61:00' END AS message FROM orders""")
def toml_checked(spark: SparkSession, d: str) -> DataFrame:
    """Dates, times and integers that do not exist are failures where they stand."""
    r = plans.parse(F.expr(_DATED), toml.parse_toml, "string", _first_pair)
    e = F.get("r.errors", F.lit(0))
    return spread(read_table(spark, d, "orders")).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.status", "r.value", e["loc"]["offset"].alias("at"), e["message"].alias("message"))


def _first_pair(root: toml.Table) -> str:
    (_, _, key, _, value), *_ = toml.rows(root)
    return f"{key}={value}"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'failure' ELSE 'partial' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN ['digit', chr(39) || 'z' || chr(39)] ELSE ['digit'] END AS expected FROM orders")
def zip_keeps_errors(spark: SparkSession, d: str) -> DataFrame:
    """A sequence that fails tells what its left side recovered from, too."""
    text = F.concat(F.lit("x"), F.when(F.col("o_orderkey") % 3 == 0, "y").otherwise("z"), F.col("o_orderkey"))
    r = plans.parse(text, (number.recover(char("x").as_(0))) & char("z"), "string", str)
    expected = F.flatten(F.transform(F.col("r.errors"), lambda e: e["expected"]))
    return spread(read_table(spark, d, "orders")).select("o_orderkey", r.alias("r")).select("o_orderkey", "r.status", expected.alias("expected"))


@query("SELECT n_regionkey, n_name AS name, CAST(n_nationkey AS BIGINT) AS number FROM nation")
def proto_enum(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("  "), x["n_name"], F.lit(" = "), x["n_nationkey"], F.lit(";"))), "\n").alias("body"))
    text = F.concat(F.lit('syntax = "proto3";\n// nations\nenum Nation {\n'), F.col("body"), F.lit("\n}\n"))
    v = plans.parse_value(text, proto.parse_proto, "array<struct<name:string,number:bigint>>", lambda f: [{"name": n, "number": k} for n, k in f.enums[0].values])
    return t.select("n_regionkey", F.explode(v).alias("v")).select("n_regionkey", "v.*")


_PATHS = [("//a[@id=\"x\"]/b|c", "//a[@id = 'x']/b | c"), ("(1+2)*3", "(1 + 2) * 3"), ("../child::y/text()", "../y/text()"), ("count(//x[position()<3])", "count(//x[position() < 3])"), ("-a div b", "-a div b"), ("a[", None)]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(a.replace("'", "''"), "NULL" if b is None else "'" + b.replace("'", "''") + "'") for a, b in _PATHS) + ") t(source, printed)")
def xpath_normal_form(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(a,) for a, _ in _PATHS], "source string")
    return t.select("source", plans.parse_value(F.col("source"), xpath.parse_xpath, "string", xpath.print_xpath).alias("printed"))


@query("SELECT l_orderkey, l_linenumber, l_partkey AS part, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS supplier FROM lineitem")
def derived_record(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.types import StructType

    p = derive.derived(("Item", StructType.fromDDL("part bigint not null, supplier bigint")))
    text = F.expr("concat('Item(', l_partkey, ',', CASE WHEN l_linenumber % 2 = 0 THEN concat('Some(', l_suppkey, ')') ELSE 'None' END, ')')")
    v = plans.parse_value(text, p << eof, "struct<part:bigint,supplier:bigint>")
    return spread(read_table(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", v.alias("v")).select("l_orderkey", "l_linenumber", "v.*")


# Lines, edits, incremental parsing.


@query("SELECT doc_id, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INTEGER) AS line, CAST(length(regexp_extract(p, '[^\\n]*$')) + 1 AS INTEGER) AS \"column\" FROM (SELECT doc_id, substr(coalesce(text, ''), 1, CAST(length(text) // 2 AS INTEGER)) AS p FROM documents)")
def line_lookup(spark: SparkSession, d: str) -> DataFrame:
    half = F.floor(F.length("text") / 2).cast("int")
    return read_table(spark, d, "documents").select("doc_id", line_of(F.col("text"), half).alias("line"), column_of(F.col("text"), half).alias("column"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS units FROM documents")
def utf16_length(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", utf16_offset(F.col("text"), F.length("text")).alias("units"))


@query("SELECT doc_id, CASE WHEN length(text) >= 8 THEN sha256('<' || substr(text, 3, 4) || '-' || substr(text, 9)) END AS h, CAST(length(text) // 2 - CASE WHEN length(text) // 2 < 2 THEN length(text) // 2 - 1 ELSE 1 END AS INTEGER) AS moved FROM documents")
def edits_applied(spark: SparkSession, d: str) -> DataFrame:
    """Both edits of each text, null where one lies beyond its end; and where its middle is after the first."""
    e = [edits.edit(F.lit(a), F.lit(b), F.lit(s)) for a, b, s in ((0, 2, "<"), (6, 8, "-"))]
    half = F.floor(F.length("text") / 2).cast("int")
    return read_table(spark, d, "documents").select("doc_id", F.sha2(edits.applied_all(F.col("text"), F.array(*e)), 256).alias("h"), edits.adjusted(e[0], half).alias("moved"))


@query("""SELECT o_orderkey, '{ "id": 7' || o_orderkey || ', "tags": ["' || o_orderstatus || '", "' || o_orderpriority || '", null], "in": {"c" : ' || o_custkey || '} }' AS text, 'token' AS how FROM orders""")
def incremental_token(spark: SparkSession, d: str) -> DataFrame:
    """An edit inside a number: only that token is parsed again, and the tree's source is the edited text."""
    v = F.pandas_udf(_edited, "text string, how string")
    return _order_json(spark, d).select("o_orderkey", v(F.col("t")).alias("v")).select("o_orderkey", "v.*")


def _edited(texts):
    import pandas as pd

    bundle = json_bundle()
    rows = []
    for t in texts:
        r = reparse(json.parse_lossless(t).value, t, TextEdit(8, 8, "7"), bundle)
        rows.append((r.tree.source(), r.how))
    return pd.DataFrame(rows, columns=["text", "how"])


# Recipes.


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """A URL's parts in the JVM: each is the regular grammar up to it."""
    scheme, host, path = one_of("abcdefghijklmnopqrstuvwxyz").many1(), none_of("/:?#").many1(), (char("/") >> none_of("?#").many())
    url = F.col("url")
    upto = [scheme, scheme << string("://"), (scheme << string("://")) & host]
    start = [F.lit(0), plans.consumed(url, upto[1]), plans.consumed(url, upto[2])]
    cut = lambda p, at: plans.captured(F.substring(url, at + 1, F.length(url)), p)
    return read_table(spark, d, "pages").select("page_id", cut(scheme, start[0]).alias("scheme"), cut(host, start[1]).alias("host"), cut(path, start[2]).alias("path"))


@query("SELECT conv_id, turn, role AS level, CAST(length(coalesce(text, '')) AS INTEGER) AS n FROM conversations")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    line = (none_of("]").many1().capture().between(char("["), char("]")) << spaces) & ((letter | one_of("_-")).many1().capture() << string(": ")) & any_char.many().capture()
    text = F.concat(F.lit("[2024-01-01] "), F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    v = plans.parse_value(text, line, "struct<level:string,n:int>", lambda x: {"level": x[0][1], "n": len(x[1])})
    return spread(read_table(spark, d, "conversations")).select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", "v.*")


@query("SELECT s_suppkey, 's' || s_suppkey AS name, 'example.com' AS domain FROM supplier")
def email_parts(spark: SparkSession, d: str) -> DataFrame:
    word = (alpha_num | one_of("._-")).many1().capture()
    v = plans.parse_value(F.concat(F.lit("s"), "s_suppkey", F.lit("@example.com")), (word << char("@")) & (word << eof), "array<string>", list)
    return read_table(spark, d, "supplier").select("s_suppkey", v.alias("v")).select("s_suppkey", F.col("v")[0].alias("name"), F.col("v")[1].alias("domain"))


@query("SELECT r_regionkey, 'region' AS section, r_name AS name FROM region")
def ini_sections(spark: SparkSession, d: str) -> DataFrame:
    pair = (letter.many1().capture() << symbol("=")) & none_of("\n").many().capture()
    ini = (none_of("]").many1().capture().between(char("["), char("]")) << char("\n")) & pair.sep_by(char("\n")).map(dict)
    v = plans.parse_value(F.concat(F.lit("[region]\nname= "), "r_name", F.lit("\nkey=1")), ini << eof, "array<string>", lambda x: [x[0], x[1]["name"]])
    return read_table(spark, d, "region").select("r_regionkey", v.alias("v")).select("r_regionkey", F.col("v")[0].alias("section"), F.col("v")[1].alias("name"))


@query("SELECT n_nationkey, CAST(1 + n_nationkey % 6 AS INTEGER) AS level, n_name AS title FROM nation")
def markdown_headers(spark: SparkSession, d: str) -> DataFrame:
    head = (char("#").many1().map(len) << char(" ")) & any_char.many().capture()
    text = F.concat(F.repeat(F.lit("#"), (1 + F.col("n_nationkey") % 6).cast("int")), F.lit(" "), F.col("n_name"))
    v = plans.parse_value(text, head << eof, "struct<level:int,title:string>", lambda x: {"level": x[0], "title": x[1]})
    return read_table(spark, d, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", "v.*")


# The remaining combinators, navigation and edits.


lowered("skip_many_spaces", "part", "p_partkey", "p_name", letter.skip_many1() >> spaces >> letter.skip_many(), _re("p_name", "[A-Za-z]+\\s*[A-Za-z]*"))
lowered("satisfy_class", "nation", "n_nationkey", "n_name", one_of("ABCDEFGHIJKLM").optional() >> letter.at_least(3), _re("n_name", "[A-M]?[A-Za-z]{3,}"))
lowered("choice_of_three", "customer", "c_custkey", "c_mktsegment", choice(string("AUTO"), string("BUILD"), letter.count(2)), _re("c_mktsegment", "AUTO|BUILD|[A-Za-z]{2}"))
lowered("surrounded_by_hash", "customer", "c_custkey", "c_name", letter.many1() >> digit.many().surrounded_by(char("#")).optional(), _re("c_name", "[A-Za-z]+(?:#[0-9]*#)?"))


@query("SELECT c_custkey, regexp_extract(c_name, '^([A-Za-z]+)#', 1) AS word, CAST(regexp_extract(c_name, '#([0-9]+)', 1) AS BIGINT) AS number, 'seen' AS mark FROM customer")
def zip_map_as(spark: SparkSession, d: str) -> DataFrame:
    p = (letter.many1().capture() << char("#")) & number & eof.as_("seen")
    v = plans.parse_value(F.col("c_name"), p, "struct<word:string,number:bigint,mark:string>", lambda x: {"word": x[0][0], "number": x[0][1], "mark": x[1]})
    return spread(read_table(spark, d, "customer")).select("c_custkey", v.alias("v")).select("c_custkey", "v.*")


@query("SELECT n_nationkey, CAST(length(regexp_extract(n_name, '^[AEIOU]*')) AS INTEGER) AS vowels FROM nation")
def satisfy_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Any Python test of a character."""
    p = satisfy(lambda c: c.upper() in "AEIOU", "vowel").many().capture().map(len)
    return read_table(spark, d, "nation").select("n_nationkey", plans.parse_value(F.col("n_name"), p, "int").alias("vowels"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'odd key' END AS message, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS INTEGER) AS at FROM orders")
def fail_positioned(spark: SparkSession, d: str) -> DataFrame:
    p = first_char_choice(("x", any_char >> fail("odd key")), fallback=number)
    r = plans.parse(F.col("t"), p, "bigint")
    first = F.get("r.errors", F.lit(0))
    return _mixed(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", first["message"].alias("message"), first["loc"]["offset"].alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS named FROM orders")
def named_expected(spark: SparkSession, d: str) -> DataFrame:
    r = plans.parse(F.col("t"), number.named("key"), "bigint")
    return _mixed(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", F.coalesce(F.array_contains(F.get("r.errors", F.lit(0))["expected"], "key").cast("int"), F.lit(0)).alias("named"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS value FROM orders")
def recover_with_error(spark: SparkSession, d: str) -> DataFrame:
    p = number.recover_with(lambda e: any_char >> number.map(lambda v: -v))
    return _mixed(spark, d).select("o_orderkey", plans.parse_value(F.col("t"), p, "bigint").alias("value"))


def _key_tree() -> P:
    return tree_of("Line", token("Number", digit.many1().capture()).expect_token("Number"), token("Rest", any_char.many().capture()))


@query("SELECT o_orderkey AS doc_id, CAST(0 AS INTEGER) AS \"offset\", 'EndOfInput' AS kind, 'Number' AS detail FROM orders WHERE o_orderkey % 3 = 0")
def tree_problems(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that were expected and not found."""
    nodes = trees.node_table(_mixed(spark, d), plans._Held(_key_tree()), "o_orderkey", "t")
    return trees.problems(nodes).select("doc_id", "offset", "kind", "detail")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'failure' ELSE 'success' END AS status, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + length(CAST(o_orderkey AS VARCHAR)) END AS INTEGER) AS consumed FROM orders")
def result_sequence(spark: SparkSession, d: str) -> DataFrame:
    one, two = plans.parse(F.lit("#"), char("#"), "string"), plans.parse(F.col("t"), number, "bigint")
    t = _mixed(spark, d).select("o_orderkey", one.alias("a"), two.alias("b"))
    return t.select("o_orderkey", and_then(F.col("a"), F.col("b")).alias("r")).select("o_orderkey", "r.status", "r.consumed")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Trees of [n_nationkey,"n_name"]."""
    t = read_table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("["), "n_nationkey", F.lit(',"'), "n_name", F.lit('"]')).alias("t"))
    return trees.node_table(t, json.parse_lossless, "n_nationkey", "t")


@query("SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(1 + length(CAST(n_nationkey AS VARCHAR)) + 1 AS BIGINT) AS offset_in_parent, CAST(length(n_name) + 2 AS INTEGER) AS width FROM nation")
def tree_children(spark: SparkSession, d: str) -> DataFrame:
    return trees.children(_pairs(spark, d)).filter("kind = 'String'").select("doc_id", F.col("offset_in_parent").cast("bigint").alias("offset_in_parent"), "width")


@query(_SHAPES + "SELECT doc_id, CAST(i * 3 - 1 AS INTEGER) AS child_index, 'String' AS before, 'Whitespace' AS after FROM o, unnest(range(1, m)) t(i) UNION ALL SELECT doc_id, 2, 'Member', 'Member' FROM o")
def tree_siblings(spark: SparkSession, d: str) -> DataFrame:
    """What stands before and after each comma."""
    nodes = _shapes(spark, d)
    s = trees.siblings(nodes).filter("kind = 'Comma'").select("doc_id", "child_index", "prev_sibling", "next_sibling")
    kind = nodes.select("doc_id", "node_id", "kind")
    for side, name in (("prev_sibling", "before"), ("next_sibling", "after")):
        s = s.join(trees.held_apart(kind.withColumnsRenamed({"node_id": side, "kind": name})), ["doc_id", side])
    return s.select("doc_id", "child_index", "before", "after")


@query(_SHAPES + ", k AS (SELECT unnest(['Document', 'Object', 'Member', 'Array']) AS kind, unnest([0, 1, 2, 3]) AS depth) SELECT doc_id, kind, depth, CAST(m AS BIGINT) AS n FROM o, k WHERE m > 0")
def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """What is above the strings in the array, and above how many."""
    found = trees.ancestors(_shapes(spark, d), (F.col("kind") == "String") & (F.col("depth") == 4))
    return found.groupBy("doc_id", "kind", "depth").agg(F.count(F.lit(1)).alias("n"))


@query(_SHAPES + "SELECT doc_id, '0/3/4/' || (3 * i - 2) AS path, true AS parsed FROM o, unnest(range(1, m + 1)) t(i)")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from depths and child indexes, equal to those that the parser gives."""
    nodes = _shapes(spark, d)
    found = trees.paths(nodes).join(trees.held_apart(_shapes(spark, d, paths=True).select("doc_id", "node_id", "kind", "depth", F.col("path").alias("given"))), ["doc_id", "node_id"])
    text = F.array_join(F.col("path").cast("array<string>"), "/")
    return found.filter("kind = 'String' and depth = 4").select("doc_id", text.alias("path"), (F.col("path") == F.col("given")).alias("parsed"))


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines, CAST(CASE WHEN contains(text, chr(10)) THEN instr(text, chr(10)) END AS INTEGER) AS second FROM documents")
def line_index(spark: SparkSession, d: str) -> DataFrame:
    starts = read_table(spark, d, "documents").select("doc_id", line_starts(F.col("text")).alias("s"))
    return starts.select("doc_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("lines"), F.get("s", F.lit(1)).alias("second"))


@query("""WITH d AS (SELECT doc_id, substr(text, 1, CAST(length(text) // 3 AS INTEGER)) AS a, substr(text, 1, CAST(length(text) // 2 AS INTEGER)) AS b FROM documents)
    SELECT doc_id, CAST(1 + length(a) - length(replace(a, chr(10), '')) AS INTEGER) AS first_line, CAST(length(regexp_extract(a, '[^\\n]*$')) + 1 AS INTEGER) AS first_column, CAST(1 + length(b) - length(replace(b, chr(10), '')) AS INTEGER) AS last_line, CAST(length(regexp_extract(b, '[^\\n]*$')) + 1 AS INTEGER) AS last_column, a IS NOT NULL AS same FROM d""")
def line_spans(spark: SparkSession, d: str) -> DataFrame:
    """The lines and columns of a range, from the text and from its line index."""
    text, n = F.col("text"), F.length("text")
    a, b = F.floor(n / 3).cast("int"), F.floor(n / 2).cast("int")
    t = read_table(spark, d, "documents").select("doc_id", span_at(text, a, b).alias("s"), span_in(line_starts(text), n, a, b).alias("i"), text.isNotNull().alias("some"))
    field = lambda x, k: F.when(F.col("some"), F.col(f"s.{x}.{k}"))
    return t.select("doc_id", field("start", "line").alias("first_line"), field("start", "column").alias("first_column"), field("end", "line").alias("last_line"), field("end", "column").alias("last_column"), (F.col("some") & (F.col("s") == F.col("i"))).alias("same"))


_EDITS = [(0, 2, "<"), (4, 4, "new"), (6, 9, "")]


@query("SELECT doc_id, unnest([0, 4, 6]) AS start, unnest([0, 3, 8]) AS shifted, unnest(['replacement', 'insertion', 'deletion']) AS kind, unnest([true, false, false]) AS hits FROM documents")
def edits_composed(spark: SparkSession, d: str) -> DataFrame:
    """Starts for applying edits one after the other, their kinds, and whether each overlaps the first two characters."""
    rows = F.explode(F.array(*[edits.edit(F.lit(a), F.lit(b), F.lit(x)) for a, b, x in _EDITS]))
    each = read_table(spark, d, "documents").select("doc_id", rows.alias("e")).select("doc_id", "e.*")
    e = F.struct("start", "end", "new_text")
    return edits.composed(each).select("doc_id", "start", F.col("shifted").cast("int").alias("shifted"), edits.kind(e).alias("kind"), edits.affects(e, F.lit(0), F.lit(2)).alias("hits"))


def _reparsed(name: str, edit: Callable[[str], list[TextEdit]], sql: str) -> None:
    """Edits of an order's JSON text, parsed again: the tree's source, and how much the edit applied last made parse."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        import pandas as pd

        @F.pandas_udf("text string, how string")
        def again(texts):
            bundle, rows = json_bundle(), []
            for t in texts:
                r = reparse_all(json.parse_lossless(t).value, t, edit(t), bundle)
                rows.append((r.tree.source(), r.how))
            return pd.DataFrame(rows, columns=["text", "how"])

        padded = _order_json(spark, d).withColumn("t", F.concat(F.lit("["), "t", F.lit(', "' + "-" * 80 + '"]')))
        return padded.select("o_orderkey", again("t").alias("v")).select("o_orderkey", "v.*")

    run.__name__ = name
    query(f"SELECT o_orderkey, {sql} FROM orders")(run)


_HEAD = """'[{ "id": ' || o_orderkey || ', "tags": ["' || o_orderstatus || '", "' || o_orderpriority || '", null"""
_TAIL = """], "in": {"c" : ' || o_custkey || '} }, "' || repeat('-', 80) || '"]'"""
_reparsed("incremental_block", lambda t: [TextEdit(t.index("null") + 4, t.index("null") + 4, ", 1")], f"{_HEAD}, 1{_TAIL} AS text, 'block' AS how")
_reparsed("incremental_full", lambda t: [TextEdit(0, len(t), t[9 : t.index(",")] + " ")], "o_orderkey || ' ' AS text, 'full' AS how")
_reparsed("incremental_batch", lambda t: [TextEdit(t.index("null"), t.index("null") + 4, "true"), TextEdit(len(t) - 2, len(t) - 2, "+")], f"{_HEAD.replace('null', 'true')}{_TAIL.replace('"]', '+"]')} AS text, 'block' AS how")


# Further formats and recipes.


@query("SELECT c_custkey, c_name AS name, 'a,\"b' AS note FROM customer")
def tsv_fields(spark: SparkSession, d: str) -> DataFrame:
    tabs = csv.TSV
    line = csv.format_fields(F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.lit('a,"b')), tabs)
    return read_table(spark, d, "customer").select("c_custkey", csv.record_fields(line, tabs).alias("f")).select("c_custkey", F.col("f")[1].alias("name"), F.col("f")[2].alias("note"))


def _id_of(v: dict) -> int | None:
    return int(v["id"].raw) if int(v["id"].raw) % 2 else None


def _json_id(text: str):
    return json.parse_as(text, _id_of)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Type mismatch' END AS message FROM orders")
def json_extracted(spark: SparkSession, d: str) -> DataFrame:
    r = plans.parse(F.col("t"), _json_id, "bigint")
    return _order_json(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", F.col("r.value").alias("id"), F.get("r.errors", F.lit(0))["message"].alias("message"))


def _undeclared(text: str):
    return xml.parse_xml(text)


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'failure' ELSE 'success' END AS status FROM part")
def xml_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the internal subset; one that is not declared is an error."""
    name = F.when(F.col("p_partkey") % 2 == 0, "other").otherwise("who")
    text = F.concat(F.lit('<!DOCTYPE a [<!ENTITY who "x">]><a>&'), name, F.lit(";</a>"))
    return spread(read_table(spark, d, "part")).select("p_partkey", plans.parse(text, _undeclared, "int", lambda v: 1).alias("r")).select("p_partkey", "r.status")


@query("SELECT s_suppkey, 'Get' || s_suppkey AS method, 'In' AS input, true AS streamed FROM supplier")
def proto_service(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('syntax = "proto3"; service S { rpc Get'), F.col("s_suppkey"), F.lit(" (In) returns (stream Out); }"))
    v = plans.parse_value(text, proto.parse_proto, "struct<method:string,input:string,streamed:boolean>", _method_row)
    return read_table(spark, d, "supplier").select("s_suppkey", v.alias("v")).select("s_suppkey", "v.*")


def _method_row(f: proto.File) -> dict:
    m = f.services[0].methods[0]
    return {"method": m.name, "input": m.input, "streamed": m.server_streaming}


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def shared_lexers(spark: SparkSession, d: str) -> DataFrame:
    """identifier /* comment */ = "text" number"""
    p = ((identifier << hspaces << block_comment("/*", "*/") << hspaces << char("=") << hspaces) >> (double_quoted_string << hspaces)) & floating_point
    text = F.concat(F.lit('key_1 /* a * b */ = "'), F.col("c_name"), F.lit('" '), F.expr("format_string('%.2f', c_acctbal)"))
    v = plans.parse_value(text, p << eof, "struct<name:string,balance:double>", lambda x: {"name": x[0], "balance": x[1]})
    return spread(read_table(spark, d, "customer")).select("c_custkey", v.alias("v")).select("c_custkey", "v.*")


@query("SELECT s_suppkey, CAST(10 + s_nationkey AS BIGINT) AS country, '555' AS area FROM supplier")
def phone_parts(spark: SparkSession, d: str) -> DataFrame:
    p = (char("+") >> number << char(" ")) & digit.count(3).capture().between(char("("), char(")"))
    v = plans.parse_value(F.concat(F.lit("+"), 10 + F.col("s_nationkey"), F.lit(" (555) 01")), p, "struct<country:bigint,area:string>", lambda x: {"country": x[0], "area": x[1]})
    return read_table(spark, d, "supplier").select("s_suppkey", v.alias("v")).select("s_suppkey", "v.*")


@query("SELECT s_suppkey, true AS verbose, s_name AS name FROM supplier")
def cli_arguments(spark: SparkSession, d: str) -> DataFrame:
    word = none_of(' "').many1().capture()
    value = double_quoted_string | word
    flag = string("--") >> (identifier & (char("=") >> value).optional())
    v = plans.parse_value(F.concat(F.lit('--verbose --name="'), F.col("s_name"), F.lit('"')), flag.sep_by1(char(" ")).map(dict) << eof, "struct<verbose:boolean,name:string>", lambda x: {"verbose": "verbose" in x, "name": x["name"]})
    return read_table(spark, d, "supplier").select("s_suppkey", v.alias("v")).select("s_suppkey", "v.*")


@query("SELECT n_nationkey, n_name AS field, CAST(n_regionkey AS BIGINT) AS at FROM nation")
def json_path_steps(spark: SparkSession, d: str) -> DataFrame:
    step = (char(".") >> none_of(".[").many1().capture()) | number.between(char("["), char("]"))
    v = plans.parse_value(F.concat(F.lit("$."), F.col("n_name"), F.lit("["), F.col("n_regionkey"), F.lit("]")), char("$") >> step.many() << eof, "struct<field:string,at:bigint>", lambda x: {"field": x[0], "at": x[1]})
    return read_table(spark, d, "nation").select("n_nationkey", v.alias("v")).select("n_nationkey", "v.*")


@query("SELECT r_regionkey, 'a,b' AS columns, lower(r_name) AS source FROM region")
def select_statement(spark: SparkSession, d: str) -> DataFrame:
    name = (identifier | string("*")).lexeme()
    p = (symbol("SELECT") >> name.sep_by1(symbol(","))) & (symbol("FROM") >> name)
    text = F.concat(F.lit("SELECT a , b FROM "), F.lower(F.regexp_replace("r_name", " ", "_")))
    v = plans.parse_value(text, p << eof, "struct<columns:string,source:string>", lambda x: {"columns": ",".join(x[0]), "source": x[1].replace("_", " ")})
    return read_table(spark, d, "region").select("r_regionkey", v.alias("v")).select("r_regionkey", "v.*")


@query("SELECT o_orderkey, 'success' AS json, CASE WHEN o_orderkey % 3 = 0 THEN 'failure' ELSE 'success' END AS toml FROM orders")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register(spark)
    _order_json(spark, d).withColumn("k", F.when(F.col("o_orderkey") % 3 == 0, "k =").otherwise("k = 1")).createOrReplaceTempView("order_texts")
    return spark.sql("SELECT o_orderkey, json_status(t) AS json, toml_status(k) AS toml FROM order_texts")


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS c, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS k FROM orders")
def sql_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of formats in SQL, as JSON."""
    register(spark)
    _order_json(spark, d).withColumn("k", F.when(F.col("o_orderkey") % 3 == 0, "k =").otherwise(F.concat(F.lit("k = "), "o_orderkey"))).createOrReplaceTempView("order_texts")
    return spark.sql("SELECT o_orderkey, get_json_object(json_value(t), '$.in.c') AS c, CAST(get_json_object(toml_value(k), '$.pairs.k') AS BIGINT) AS k FROM order_texts")


@query("SELECT o_orderkey, CAST(i AS INTEGER) AS row, CASE i WHEN 0 THEN 'a' ELSE CAST(o_orderkey + i AS VARCHAR) END AS first, CAST(CASE i WHEN 0 THEN 1 ELSE i END AS INTEGER) AS n FROM orders, unnest(range(0, 2 + o_orderkey % 2)) t(i)")
def sql_csv_table(spark: SparkSession, d: str) -> DataFrame:
    """A table function: records of a text as rows."""
    register(spark)
    line = "concat('a\n', o_orderkey + 1, IF(o_orderkey % 2 = 1, concat('\n', o_orderkey + 2, ',x'), ''))"
    spread(read_table(spark, d, "orders")).select("o_orderkey", F.expr(line).alias("t")).createOrReplaceTempView("csv_texts")
    return spark.sql("SELECT o_orderkey, r.row, r.fields[0] AS first, size(r.fields) AS n FROM csv_texts, LATERAL csv_records(t) r")


@query("SELECT o_orderkey, CAST(2 + o_orderkey % 2 AS BIGINT) AS strings, CAST(length(CAST(o_orderkey AS VARCHAR)) + 7 + CASE WHEN o_orderkey % 2 = 1 THEN 5 ELSE 0 END AS INTEGER) AS width FROM orders")
def sql_json_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A table function: the lossless tree of a text as rows."""
    register(spark)
    text = """concat('["', o_orderkey, IF(o_orderkey % 2 = 1, '","ab', ''), '",""]')"""
    spread(read_table(spark, d, "orders")).select("o_orderkey", F.expr(text).alias("t")).createOrReplaceTempView("json_texts")
    return spark.sql("SELECT o_orderkey, count_if(n.kind = 'String') AS strings, max(n.width) AS width FROM json_texts, LATERAL json_nodes(t) n GROUP BY 1")


@query("SELECT o_orderpriority, count_if(o_orderkey % 3 <> 0) AS successes, CAST(0 AS BIGINT) AS partials, count_if(o_orderkey % 3 = 0) AS failures, CAST(sum(CASE WHEN o_orderkey % 3 <> 0 THEN length(CAST(o_orderkey AS VARCHAR)) ELSE 0 END) AS BIGINT) AS consumed, 'Unexpected ''x'' (expected: digit) at line 1, column 1 (offset 0)' AS first FROM orders GROUP BY 1")
def result_summaries(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate over results."""
    t = spread(read_table(spark, d, "orders")).select("o_orderpriority", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat('x', o_orderkey) ELSE cast(o_orderkey as string) END").alias("t"))
    r = t.select("o_orderpriority", plans.parse(F.col("t"), number, "bigint").alias("r"))
    return r.groupBy("o_orderpriority").agg(result_summary(F.col("r")).alias("s")).select("o_orderpriority", "s.successes", "s.partials", "s.failures", "s.consumed", F.element_at("s.first_failure.errors", 1).alias("first"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Partial(-1, Unexpected ''x'' (expected: digit) at line 1, column 1 (offset 0))' ELSE 'Success(' || o_orderkey || ', ' || length(CAST(o_orderkey AS VARCHAR)) || ')' END AS shown, o_orderkey % 3 <> 0 AS same FROM orders")
def result_shown(spark: SparkSession, d: str) -> DataFrame:
    a, b = plans.parse(F.col("t"), number.recover(succeed(-1)), "bigint"), plans.parse(F.col("t"), number, "bigint")
    t = _mixed(spark, d).select("o_orderkey", a.alias("a"), b.alias("b"))
    return t.select("o_orderkey", show_result(F.col("a")).alias("shown"), same_result(F.col("a"), F.col("b")).alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN ['letter:0:1', 'number:1:' || (1 + length(CAST(o_orderkey AS VARCHAR)))] ELSE ['letter:0:-', 'number:0:' || length(CAST(o_orderkey AS VARCHAR))] END AS steps FROM orders")
def trace_column(spark: SparkSession, d: str) -> DataFrame:
    """What marked parts tried, and how far they got."""
    r = plans.traced(F.col("t"), letter.trace("letter").optional() >> number.debug("number"), "bigint")
    step = lambda x: F.concat(x["label"], F.lit(":"), x["start"], F.lit(":"), F.coalesce(x["end"].cast("string"), F.lit("-")))
    return _mixed(spark, d).select("o_orderkey", r.alias("r")).select("o_orderkey", F.transform("r.trace", step).alias("steps"))


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS value, CAST(length(CAST(o_custkey AS VARCHAR)) AS INTEGER) AS consumed FROM orders")
def parse_from_offset(spark: SparkSession, d: str) -> DataFrame:
    """Interpreting from an offset that each row tells."""
    t = spread(read_table(spark, d, "orders")).select("o_orderkey", F.concat("o_orderkey", F.lit("|"), "o_custkey").alias("t"), F.length(F.col("o_orderkey").cast("string")).alias("n"))
    return t.select("o_orderkey", plans.parse_from(F.col("t"), F.col("n") + 1, number, "bigint").alias("r")).select("o_orderkey", "r.value", "r.consumed")
