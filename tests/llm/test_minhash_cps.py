"""Near-duplicate components against brute force over all pairs of full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.llm import minhash_cps as M
from keepwise.llm import shingles
from keepwise.llm.graph import components, tile_labels
from tests.conftest import SF_MID


def reference_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """{doc_id: (n, component)} over all pairs that share a shingle."""
    sets = {i: reference_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = {}
    for i, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(i)
    tried = set()
    for ids in at.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1:]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        a, b = find(i), find(j)
                        root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(spark, make_docs, rows):
    want = brute(rows)
    out = M.near_duplicates(make_docs([(i, t, "en", "s") for i, t in rows]).repartition(4)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def near_copies(rng, n, words, change):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in range(change):
            w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_sets_of_the_test_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("text").limit(300).collect()]
    texts += ["", None, "  ", "One", "one  ONE", "É é É é É", "a b c d e", "A B C D E"]
    got = list(shingles.shingle_sets(texts))
    assert [len(g) for g in got] == [len(reference_set(t)) for t in texts]
    for a in range(0, 300, 7):
        for b in range(a, a + 5):
            assert shingles.intersection(got[a], got[b]) == len(reference_set(texts[a]) & reference_set(texts[b]))
    assert np.array_equal(got[-1], got[-2]) and not np.array_equal(got[-4], got[-5])


def test_documents_of_the_small_table(spark, make_docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, make_docs, rows)


def test_large_groups_and_pairs_near_the_threshold(spark, make_docs, monkeypatch):
    monkeypatch.setattr(M, "NODE", 16)
    rng = random.Random(3)
    texts = near_copies(rng, 150, 100, 1) + near_copies(rng, 60, 200, 6) + near_copies(rng, 60, 100, 4)
    texts += ["same words in every copy of this one"] * 80 + ["few words", "Few  words", "few word", ""]
    for k in range(40):   # a shared passage in otherwise different texts
        texts.append(" ".join(f"p{i}" for i in range(60)) + " " + " ".join(f"u{k}_{i}" for i in range(60)))
    rng.shuffle(texts)
    check(spark, make_docs, list(enumerate(texts)))


def one_node(classes):
    """All classes in one node, in place of the trees."""
    return classes.select("cls", F.lit(1).cast("long").alias("node"), F.lit(classes.count()).alias("size"))


def unlike_with_pairs(rng, unlike, pairs):
    texts = [" ".join(f"u{k}_{i}" for i in range(60)) for k in range(unlike)]
    for _ in range(pairs):
        texts += near_copies(rng, 2, 60, 1)
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_pairs_that_meet_only_across_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(M, "NODE", 4)
    monkeypatch.setattr(M, "leaves", one_node)
    check(spark, make_docs, unlike_with_pairs(random.Random(5), 20, 8))


def test_large_mixed_nodes_are_dealt_as_pairs_of_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(M, "NODE", 16)
    monkeypatch.setattr(M, "leaves", one_node)
    held, dealt = [], M._dealt

    def spy(members, classes):
        held.extend(members.groupBy("node", "block").agg(F.count("*").alias("n"), F.collect_list("cls").alias("cls")).collect())
        return dealt(members, classes)

    monkeypatch.setattr(M, "_dealt", spy)
    check(spark, make_docs, unlike_with_pairs(random.Random(6), 120, 8))
    assert max(r.n for r in held) <= 2 * 2 * 16   # two blocks, which vary about NODE


def test_block_pairs_meet_once(spark, monkeypatch):
    monkeypatch.setattr(M, "NODE", 4)
    rows = [(k, 9, 0 if k < 30 else k // 2) for k in range(60)] + [(k, 8, k) for k in range(3)]
    mixed = M._mixed(spark.createDataFrame(rows, "cls long, node long, component long"))
    groups = {}
    for r in M._block_pairs(mixed).collect():
        groups.setdefault((r.node, r.block), []).append(r)
    met = [(n, *sorted((a.cls, b.cls))) for (n, _), g in groups.items() for k, a in enumerate(g) for b in g[k + 1:]
           if a.component != b.component and (a.own or a.right != b.right)]
    want = [(n, a, b) for a, n, c in rows for b, o, d in rows if n == o and a < b and c != d]
    assert sorted(met) == sorted(want)


def test_very_large_mixed_nodes_branch_on(spark, make_docs, monkeypatch):
    monkeypatch.setattr(M, "NODE", 4)
    monkeypatch.setattr(M, "DEALS", 8)
    monkeypatch.setattr(M, "leaves", one_node)
    held, pairs = [], M._block_pairs
    monkeypatch.setattr(M, "_block_pairs", lambda rows: held.extend(rows.select("node", "size").distinct().collect()) or pairs(rows))
    rows = unlike_with_pairs(random.Random(7), 60, 8)
    check(spark, make_docs, rows)
    assert held and max(r.size for r in held) < 20


def test_odd_rows(spark, make_docs):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(5, t, "en", "s"), (5, t, "en", "s"), (3, t + " more", None, None), (None, t, "en", "s"), (None, None, None, None),
            (9, None, "en", "s"), (9, "", "en", "s"), (7, "other text of its own here", "en", "s"), (7, "and a different one under its id", "en", "s")]
    docs = make_docs(rows).selectExpr("*", "doc_id AS component_id", "text AS sketch")
    out = M.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.n_shingles > 40} == {3}
    assert sum(r.kept for r in out) == 1 + 1 + 2 + 2   # 3; the null row alone; both of 9; both of 7
    left = M.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == sorted(
        [(3, t + " more"), (-1, ""), (9, ""), (9, ""), (7, rows[7][1]), (7, rows[8][1])])
    assert M.near_duplicates(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 150), (150, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 200: 150}


@pytest.mark.parametrize("n,m", [(1, 0), (50, 30), (200, 400)])
def test_tile_labels(n, m):
    rng = np.random.default_rng(n)
    i, j = rng.integers(0, n, m), rng.integers(0, n, m)
    got, want = tile_labels(n, i, j), np.arange(n)
    for _ in range(n):
        for a, b in zip(i, j):
            want[a] = want[b] = min(want[a], want[b])
    assert np.array_equal(got, want)
