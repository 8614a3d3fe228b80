"""Column functions on results, locations and edits, and their registration for SQL."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import NODE


def is_success(r: Column) -> Column:
    return r["status"] == "success"


def is_partial(r: Column) -> Column:
    return r["status"] == "partial"


def is_failure(r: Column) -> Column:
    return r["status"] == "failure"


def to_option(r: Column) -> Column:
    return F.when(~is_failure(r), r["value"])


def errors(r: Column) -> Column:
    return F.coalesce(r["errors"], F.array())


def and_then(first: Column, second: Column) -> Column:
    """Two results in sequence: the second's value, errors merged, consumed added; the first's failure stays."""
    status = F.when(is_failure(first) | is_failure(second), "failure").when(is_partial(first) | is_partial(second), "partial").otherwise("success")
    return F.struct(status.alias("status"), F.when(status != "failure", second["value"]).alias("value"), F.when(is_failure(first), first["errors"]).otherwise(F.concat(first["errors"], second["errors"])).alias("errors"), F.when(status == "failure", 0).otherwise(first["consumed"] + second["consumed"]).alias("consumed"))


def show_error(e: Column) -> Column:
    """An error as a sentence."""
    at = F.concat(F.lit(" at line "), e["loc"]["line"], F.lit(", column "), e["loc"]["column"], F.lit(" (offset "), e["loc"]["offset"], F.lit(")"))
    what = (
        F.when(e["kind"] == "Unexpected", F.concat(F.lit("Unexpected '"), e["found"], F.lit("' (expected: "), F.array_join(e["expected"], ", "), F.lit(")")))
        .when(e["kind"] == "EndOfInput", F.concat(F.lit("Unexpected end of input (expected: "), F.array_join(e["expected"], ", "), F.lit(")")))
        .otherwise(e["message"])
    )
    return F.concat(what, at)


def _prefix(text: Column, offset: Column) -> Column:
    return F.substring(text, F.lit(1), F.greatest(offset, F.lit(0)).cast("int"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a code-point offset."""
    p = _prefix(text, offset)
    return F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(_prefix(text, offset), "\n", -1)) + 1


def line_starts(text: Column) -> Column:
    """Offsets at which lines begin."""
    lengths = F.transform(F.split(text, "\n", -1), lambda x: F.length(x) + 1)
    acc = F.struct(F.array(F.lit(0)).alias("out"), F.lit(0).alias("at"))
    full = F.aggregate(lengths, acc, lambda a, n: F.struct(F.concat(a["out"], F.array(a["at"] + n)).alias("out"), (a["at"] + n).alias("at")))["out"]
    return F.slice(full, 1, F.size(full) - 1)


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code-point offset in UTF-16 units."""
    p = _prefix(text, offset)
    return F.length(p) + F.regexp_count(p, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def location_at(text: Column, offset: Column) -> Column:
    """Line, column and offset of a place, held within the text."""
    at = F.greatest(F.least(offset, F.length(text)), F.lit(0)).cast("int")
    return F.struct(line_of(text, at).cast("int").alias("line"), column_of(text, at).cast("int").alias("column"), at.alias("offset"))


def span_at(text: Column, start: Column, end: Column) -> Column:
    """Both ends of a range, the end exclusive and never before the start."""
    return F.struct(location_at(text, start).alias("start"), location_at(text, F.greatest(start, end)).alias("end"))


def location_in(starts: Column, length: Column, offset: Column) -> Column:
    """``location_at`` by the line starts of a text, worked out once for many places."""
    at = F.greatest(F.least(offset, length), F.lit(0)).cast("int")
    line = F.size(F.filter(starts, lambda x: x <= at))
    return F.struct(line.alias("line"), (at - F.get(starts, line - 1) + 1).alias("column"), at.alias("offset"))


def span_in(starts: Column, length: Column, start: Column, end: Column) -> Column:
    return F.struct(location_in(starts, length, start).alias("start"), location_in(starts, length, F.greatest(start, end)).alias("end"))


def show_location(loc: Column) -> Column:
    return F.concat(F.lit("line "), loc["line"], F.lit(", column "), loc["column"], F.lit(" (offset "), loc["offset"], F.lit(")"))


def show_result(r: Column) -> Column:
    """A result as a sentence."""
    told = F.array_join(F.transform(errors(r), show_error), "; ")
    return F.when(is_success(r), F.concat(F.lit("Success("), r["value"].cast("string"), F.lit(", "), r["consumed"], F.lit(")"))).when(is_partial(r), F.concat(F.lit("Partial("), r["value"].cast("string"), F.lit(", "), told, F.lit(")"))).otherwise(F.concat(F.lit("Failure("), told, F.lit(")")))


def same_result(a: Column, b: Column) -> Column:
    """Whether two results are equal; nulls equal nulls."""
    return a["status"].eqNullSafe(b["status"]) & a["value"].eqNullSafe(b["value"]) & a["errors"].eqNullSafe(b["errors"]) & a["consumed"].eqNullSafe(b["consumed"])


def result_summary(r: Column) -> Column:
    """An aggregate over results: how many of each status, characters consumed, and the messages of the first failure's errors by offset."""
    first = F.min(F.when(is_failure(r), F.struct(r["furthest"]["offset"].alias("offset"), F.array_sort(F.transform(errors(r), show_error)).alias("errors"))))
    n = lambda k: F.coalesce(F.sum((r["status"] == k).cast("long")), F.lit(0).cast("long"))
    return F.struct(n("success").alias("successes"), n("partial").alias("partials"), n("failure").alias("failures"), F.coalesce(F.sum(r["consumed"].cast("long")), F.lit(0).cast("long")).alias("consumed"), first.alias("first_failure"))


def register(spark: SparkSession) -> None:
    """Formats for SQL: <format>_status(text); <format>_value(text), the value as JSON; xpath_normal(text); and the table functions
    json_nodes(text), the lossless tree's nodes, xml_nodes(text), csv_records(text), toml_pairs(text), for FROM and LATERAL."""
    import json as std

    import pyarrow as pa

    from ..formats import csv, json, proto, toml, xml, xpath, yaml
    from ..operators import trees, xpath_axes
    from ..plans import _Held  # noqa: F401 - parsers travel as they do there

    def plain(v: Any) -> Any:
        if isinstance(v, json.Number):
            return json.plain(v)
        if dataclasses.is_dataclass(v) and not isinstance(v, type):
            return {f.name: plain(getattr(v, f.name)) for f in dataclasses.fields(v)}
        if hasattr(v, "_asdict"):
            v = v._asdict()
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return v.isoformat() if hasattr(v, "isoformat") else v

    def status(f: Callable) -> Callable:
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else f(t).status for t in texts.to_pylist()], pa.string())

        return run

    def shown(f: Callable) -> Callable:
        def run(texts: pa.Array) -> pa.Array:
            results = [None if t is None else f(t) for t in texts.to_pylist()]
            return pa.array([None if r is None or r.status == "failure" else std.dumps(plain(r.value), ensure_ascii=False) for r in results], pa.string())

        return run

    def arrow(run: Callable) -> Callable:
        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "string")

    for name, f in (("csv", csv.parse_csv), ("json", json.parse_json), ("toml", toml.parse_toml), ("xml", xml.parse_xml), ("yaml", yaml.parse_yaml), ("proto", proto.parse_proto)):
        spark.udf.register(f"{name}_status", arrow(status(f)))
        spark.udf.register(f"{name}_value", arrow(shown(f)))

    def normal(texts: pa.Array) -> pa.Array:
        results = [None if t is None else xpath.parse_xpath(t) for t in texts.to_pylist()]
        return pa.array([None if r is None or r.status == "failure" else xpath.print_xpath(r.value) for r in results], pa.string())

    spark.udf.register("xpath_normal", arrow(normal))

    class JsonNodes:
        def eval(self, text: str):
            r = None if text is None else json.parse_lossless(text)
            if r is not None and r.status != "failure":
                yield from (x[1:11] for x in trees.rows_of(None, r.value))

    class XmlNodes:
        def eval(self, text: str):
            r = None if text is None else xml.parse_xml(text)
            if r is not None and r.status != "failure":
                yield from (x[1:] for x in xpath_axes.rows_of(None, r.value))

    class CsvRecords:
        def eval(self, text: str):
            r = None if text is None else csv.parse_csv(text)
            if r is not None and r.status != "failure":
                yield from enumerate(r.value)

    class TomlPairs:
        def eval(self, text: str):
            r = None if text is None else toml.parse_toml(text)
            if r is not None and r.status != "failure":
                yield from toml.rows(r.value)

    for name, kind, schema in (
        ("json_nodes", JsonNodes, NODE.partition(", ")[2].partition(", path")[0]),
        ("xml_nodes", XmlNodes, xpath_axes.XML_NODE.partition(", ")[2]),
        ("csv_records", CsvRecords, "row int, fields array<string>"),
        ("toml_pairs", TomlPairs, "path array<string>, index array<int>, key string, type string, value string"),
    ):
        spark.udtf.register(name, F.udtf(kind, returnType=schema))
