"""Text edits as rows and columns: (start, end, new_text), the end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edit(start: Column, end: Column, new_text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), new_text.alias("new_text"))


def delta(e: Column) -> Column:
    return F.length(e["new_text"]) - (e["end"] - e["start"])


def kind(e: Column) -> Column:
    """insertion, deletion or replacement."""
    return F.when(e["start"] == e["end"], "insertion").when(F.length(e["new_text"]) == 0, "deletion").otherwise("replacement")


def valid(text: Column, e: Column) -> Column:
    return (e["start"] >= 0) & (e["start"] <= e["end"]) & (e["end"] <= F.length(text))


def applied(text: Column, e: Column) -> Column:
    """The text after an edit; null if the edit is out of bounds."""
    return F.when(valid(text, e), F.concat(F.substring(text, F.lit(1), e["start"]), e["new_text"], F.substring(text, e["end"] + 1, F.length(text))))


def applied_all(text: Column, edits: Column) -> Column:
    """The text after an array of edits that do not overlap, all in coordinates of the text: the last goes first."""
    return F.aggregate(F.reverse(F.array_sort(edits)), text, lambda t, e: applied(t, e))


def affects(e: Column, start: Column, end: Column) -> Column:
    """Whether an edit overlaps a range, edges not counted."""
    return (e["start"] < end) & (e["end"] > start)


def adjusted(e: Column, offset: Column) -> Column:
    """Where an offset is after an edit; inside the edit, at the end of the new text."""
    return F.when(offset < e["start"], offset).when(offset >= e["end"], offset + delta(e)).otherwise(e["start"] + F.length(e["new_text"]))


def composed(edits: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Edits (doc_id, start, end, new_text) of one text, with ``shifted`` starts for applying them one after the other, and
    whether one overlaps its predecessor."""
    order = Window.partitionBy(doc_col).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumns({"shifted": F.col("start") + F.coalesce(F.sum(F.length("new_text") - (F.col("end") - F.col("start"))).over(before), F.lit(0)), "overlaps": F.coalesce(F.lag("end").over(order) > F.col("start"), F.lit(False))})
