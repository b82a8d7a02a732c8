"""Ranked search against a plain scorer: small blocks, ties, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from keepwise.llm import ranked_search as R

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("term", T.StringType())])


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, top=10):
    """[(item_id, [(score, doc_id), ...])] in the order of the items."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    full = [(d, c, sum(c.values())) for d, c in counts if c]
    N, L = len(full), sum(n for _, _, n in full)
    df = Counter(t for _, c, _ in full for t in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        scored = []
        for d, c, n in full:
            m = 100 - 75 + (75 * n * N) // L
            s = sum(k * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, k in asked.items() if t in c)
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out.append((item, scored[:top]))
    return out


def found(df):
    out = {}
    for r in df.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r.rank, r.score, r.doc_id))
    return out


def corpus(seed, n=400, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Straße", "ÉTÉ", "x9", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    make = lambda k: " ".join(rng.choices(vocabulary, weights, k=k))
    docs = [(i, make(rng.randrange(1, 60))) for i in range(n)]
    docs += [(5000 + i, docs[3][1]) for i in range(40)]            # ties, decided by doc_id
    items = [(i, make(rng.randrange(1, 25)) + rng.choice(["", ".", " W0 w0-W1", " unknown"])) for i in range(12)]
    return docs, [*items, (90, docs[3][1]), (91, docs[3][1].upper())]


@pytest.mark.parametrize("block,leaf", [(2048, 128), (64, 4), (30, 1)])
def test_against_plain(spark, make_docs, block, leaf):
    docs, items = corpus(block)
    random.Random(1).shuffle(docs)
    rows = make_docs([(d, t, "en", "s") for d, t in docs]).repartition(3)
    asked = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    for bounds in ({}, {"batch_items": 5}, {"batch_terms": 20}):
        got = found(R.search(rows, asked, block_docs=block, leaf=leaf, **bounds))
        for item, best in plain(docs, items):
            assert got.get(item, []) == [(k + 1, s, d) for k, (s, d) in enumerate(best)], (item, bounds)


def test_odd_rows(spark, make_docs):
    long = " ".join(f"t{i % 5000}" for i in range(60_000)) + " needle"
    docs = [(1, None), (2, ""), (3, " .,;"), (None, "needle here"), (None, "needle here"), (7, "needle here"), (7, "needle here"), (8, long), (9, "NEEDLE\x00needle_x")]
    rows = make_docs([(d, t, None, None) for d, t in docs]).selectExpr("*", "doc_id AS block", "text AS term", "lang AS places")
    items = [(1, "needle"), (2, None), (3, "  "), (4, "no such"), (None, "here")]
    asked = spark.createDataFrame([(i, t, None) for i, t in items], ITEMS)
    got = found(R.search(rows, asked, block_docs=3, leaf=1))
    for item, best in plain(docs, items):
        assert got.get(item, []) == [(k + 1, s, d) for k, (s, d) in enumerate(best)], item
    twice = R.search(rows, asked.unionByName(asked.where("item_id = 1")), leaf=1).where("item_id = 1").collect()
    assert sorted(r["rank"] for r in twice) == sorted([1, 2, 3, 4, 5, 6] * 2)      # a repeated item has its own rows
    assert R.search(make_docs([]), asked).count() == 0
    assert R.search(rows, spark.createDataFrame([], ITEMS)).count() == 0


def test_range_maxima_and_pruning():
    rng = np.random.default_rng(4)
    lists = []
    for t in range(6):
        at = np.sort(rng.choice(1000, size=rng.integers(1, 700), replace=False)).astype(np.int64)
        lists.append((f"t{t}", at, rng.integers(0, 10**6, len(at)).astype(np.int64)))
    table = R.BlockTables(np.arange(1000), lists)
    for _ in range(300):
        t = int(rng.integers(6))
        a, b = np.sort(rng.integers(0, len(lists[t][1]) + 1, 2))
        base = table.start[t]
        want = lists[t][2][a:b].max(initial=0)
        assert table.maxima(np.array([base + a]), np.array([base + b]))[0] == want
    # one document far above the rest: the search scores far fewer documents than there are
    lists = [(n, at, np.where(at == 77, 10**9, v)) for n, at, v in lists if 77 in at] or [("t", np.array([77]), np.array([10**9]))]
    table, best, seen = R.BlockTables(np.arange(1000), lists), R.Best(1), []
    table._score = lambda lo, hi, *rest: seen.append(hi - lo)
    table.search([(n, 1) for n, _, _ in lists], best)
    assert best.heap[0][1] == -77 and sum(seen) == 0


def test_lengths_beyond_64_bits():
    n = np.array([1, 5, 10_000_000], dtype=np.int64)
    docs, total = 30_000_000_000, 20_000_000_000_000
    assert R.length_part(n, docs, total).tolist() == [25 + 75 * int(x) * docs // total for x in n]
