"""Vector near-duplicates against all pairs in double precision."""

import numpy as np
import pytest
from pyspark.sql import types as T

from keepwise.llm import embed_dedup as E
from tests.conftest import SF_MID

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType())])


def brute(rows):
    use = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows
           if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links, root = {}, list(range(len(use)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, (i, x) in enumerate(use):
        for b, (j, y) in enumerate(use[:a]):
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    low = {}
    for a, (i, _) in enumerate(use):
        low[find(a)] = min(i, low.get(find(a), i))
    want = [(i, links.get(a, 0), low[find(a)]) for a, (i, _) in enumerate(use)]
    used = {i for i, _ in use}
    return sorted(want + [(i, 0, i) for i, _ in rows if i not in used])


def run(spark, rows, **k):
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], SCHEMA).repartition(4)
    out = E.near_duplicate_vectors(df, **k).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in out)


DOUBLES = T.StructType([SCHEMA["vec_id"], T.StructField("embedding", T.ArrayType(T.DoubleType())), *SCHEMA.fields[2:]])


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [5e-324, 5e-324]), (5, [1e308, -1e308]), (6, [1.0, -1.0]), (7, [1e300, 1e-300])]
    df = spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], DOUBLES).selectExpr("*", "vec_id AS cls", "label AS cell", "label AS tile", "v AS low")
    out = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicate_vectors(df).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7)}


@pytest.mark.parametrize("visitors", [0.1, 1.0])
def test_visitors_of_a_tile_are_dealt_over_tasks(spark, visitors):
    """A dense cell: most vectors visit its tiles, several tasks hold each of them."""
    rng = np.random.default_rng(12)
    vecs = [np.ones(8) + rng.normal(size=8) * 0.35 for _ in range(260)] + list(rng.normal(size=(40, 8)))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    assert run(spark, rows, cell=60, tile=30, visitors=visitors) == brute(rows)


@pytest.mark.parametrize("cell,tile", [(2048, 4096), (40, 25), (10**6, 50)])
def test_clusters_copies_and_odd_vectors(spark, cell, tile):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(30, 16))
    vecs = [b + rng.normal(size=16) * s for b in base for s in (0.0, 0.05, 0.2, 0.35, 0.45, 0.5, 0.6)]
    vecs += [base[0]] * 40 + [base[0] * 3] + [base[1] + rng.normal(size=16) * 0.05 for _ in range(80)]
    vecs += list(rng.normal(size=(60, 16)))
    order = rng.permutation(len(vecs))
    rows = [(int(i), [float(np.float32(x)) for x in vecs[k]]) for i, k in enumerate(order)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [None] * 16), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [1.0] * 15),
             (n + 5, rows[0][1][:8]), (n + 6, rows[0][1][:8]), (n + 7, []), (n + 8, [-0.0] + [1.0] * 15), (n + 9, [0.0] + [1.0] * 15)]
    assert run(spark, rows, cell=cell, tile=tile) == brute(rows)


def test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()]
    assert run(spark, rows, cell=100, tile=60) == brute(rows)


def test_error_bound_holds():
    u = E.unit(np.random.default_rng(1).normal(size=(300, 64)))
    q, s, e, length = E.quantise(u)
    approx = (q @ q.T) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - approx) <= e[:, None] * length[None, :] + e[None, :] + 1e-9).all()


def test_empty(spark):
    assert run(spark, []) == []
