"""A stream of edits, each document's text and tree kept as state and parsed again where it changed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..incremental import Bundle, Reparsed, TextEdit, _whole, reparse
from ..machine import Node

OUT = "doc_id long, seq long, how string, region_start int, region_end int, ok boolean, text string"
STATE = "text string, tree binary"


def packed(tree: Node) -> bytes:
    """A tree as plain rows in pre-order: class, kind, text, number of children (none for a leaf)."""
    rows, work = [], [tree]
    while work:
        n = work.pop()
        rows.append((n.cls, n.kind, n.text, None if n.children is None else len(n.children)))
        work += reversed(n.children or [])
    return json.dumps(rows).encode()


def unpacked(raw: bytes) -> Node:
    done: list[Node] = []
    for cls, kind, text, k in reversed(json.loads(raw)):
        children = None if k is None else [done.pop() for _ in range(k)]
        done.append(Node(cls, kind, text, children))
    return done.pop()


def replay(tree_and_text: Reparsed | None, rows: list[tuple], bundle: Bundle) -> Iterator[tuple[int, Reparsed]]:
    """Edits (seq, start, end, new_text) in order of seq; the first to an unknown document is its text."""
    now = tree_and_text
    for seq, start, end, new in sorted(rows):
        now = _whole(new, bundle) if now is None else reparse(now.tree, now.text, TextEdit(start, end, new), bundle)
        yield seq, now


def incremental(edits: DataFrame, bundle: Callable[[], Bundle], ttl_ms: int = 3_600_000) -> DataFrame:
    """(doc_id, seq, how, region, ok, text) for each row of a stream (doc_id, seq, start, end, new_text).

    Documents without an edit for ``ttl_ms`` are forgotten. A null doc_id is a document like others.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = None
        if state.exists:
            text, tree = state.get
            now = Reparsed(unpacked(bytes(tree)), text, "none", (0, 0))
        rows = [tuple(r) for f in frames for r in f[["seq", "start", "end", "new_text"]].itertuples(index=False)]
        out = []
        for seq, now in replay(now, rows, bundle()):
            out.append((key[0], seq, now.how, *now.region, now.ok, now.text))
        if now is not None:
            state.update((now.text, packed(now.tree)))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    return edits.groupBy("doc_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
