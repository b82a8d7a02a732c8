"""The driver contract: entry() in a plain session, stable schema; every SQL key
has a callable; oracle columns are named like the Spark columns."""

import re

import __spark_entry__ as E
from keepwise.plans import catalog


def test_entry_schema_is_stable(spark):
    a = E.entry(spark)
    b = E.entry(spark)
    assert a.schema == b.schema
    assert [f.dataType.simpleString() for f in a.schema.fields] == ["string", "double", "string", "bigint"]
    assert a.count() == b.count() > 0


def test_registry_shape():
    q, s = E.queries(), E.oracle_sql()
    assert len(catalog.queries()) >= 80 and set(catalog.queries()) <= set(q) and set(s) <= set(q)
    for name, sql in s.items():
        assert re.search(r"\bSELECT\b", sql, re.I), name
