"""Side by side of single-row aggregates without a join.

Each input is one row with its own columns; the union (missing columns NULL)
is folded with ``first(ignorenulls)``, so no join - and no nested-loop join -
appears in the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*parts: DataFrame) -> DataFrame:
    cols: list[str] = []
    for p in parts:
        cols += [c for c in p.columns if c not in cols]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
