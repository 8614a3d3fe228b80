"""What the driver calls."""

import __spark_entry__ as entry

import loomtext.queries as core


def test_registry():
    assert set(core.ORACLE_SQL) == set(core.QUERIES) and set(core.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
