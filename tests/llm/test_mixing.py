"""Mixing: targets against direct water-filling, whole blocks, caps, reruns."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from keepwise.llm import mixing as M
from tests.conftest import SF_MID, SF_SMALL


def targets(size):
    """{source: target} by capping and sharing again until nothing is above."""
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in size else [])
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * size[s] for s in capped)
        out = {s: left * w[s] / sum(w[t] for t in free) for s in free}
        over = {s for s in free if out[s] > 2 * size[s]}
        if not over:
            return {**out, **{s: 2.0 * size[s] for s in capped}}
        capped |= over


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in M.mix_documents(docs).collect()}
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    size = Counter()
    for t, s in text.values():
        size[s] += len((t or "").encode().split())
    want, taken = targets(size), Counter()
    assert set(rows) == set(text)
    for i, r in rows.items():
        s = text[i][1]
        assert r.size == len((text[i][0] or "").encode().split()) and r.source_size == size[s]
        assert r.target == pytest.approx(want[s], rel=1e-12) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * M.BLOCK
    again = M.mix_documents(docs.repartition(7)).collect()
    assert {r.doc_id: r for r in again} == rows


def test_permutations_are_permutations():
    for n in [1, 2, 3, 5, 64, 1000, 4097]:
        got = M.permuted(np.arange(n), np.full(n, n), np.full(n, 99, dtype=np.uint64))
        assert sorted(got) == list(range(n))
    a, b = (M.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k, dtype=np.uint64)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_pieces_are_whole_blocks_and_rows_hold_the_words(spark, make_docs):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(n)), "en", s) for i, (n, s) in enumerate(
        [(500, "b"), (3, "a"), (0, "a"), (130, None), (64, "b"), (1, "c"), (90, "c"), (700, "é")])]
    rows += [(4, rows[4][1], "en", "b"), (None, "x y z", "en", "c"), (20, None, "en", "zero")]
    docs = make_docs(rows).selectExpr("*", "doc_id AS row", "text AS key", "source AS sid")
    per = M.mix_documents(docs).collect()
    assert len(per) == len(rows) and all(r.taken <= 2 * r.size for r in per)
    assert [r.target for r in per if r.doc_id == 20] == [0.0]
    out = M.mixed_rows(docs)
    assert out.columns == docs.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        w = r.text.split()
        assert r.n_chars == len(r.text) and len(set(w)) == len(w)
        got[r.doc_id] += len(w)
        full = next(t for i, t, _, _ in rows if i == r.doc_id).split()
        order = {x: k for k, x in enumerate(full)}
        assert [order[x] for x in w] == sorted(order[x] for x in w)
    for r in per:
        want[r.doc_id] += r.taken
    assert got == Counter({k: v for k, v in want.items() if v})


def test_slots_use_every_block_before_any_again(spark, make_docs):
    docs = make_docs([(i, "w " * 50, "en", "ab"[i % 2]) for i in range(40)])
    plan = M.source_targets(M.document_sizes(docs), block=8)
    use = defaultdict(Counter)
    for r in M.drawn_slots(plan, shard_slots=50).collect():
        use[r.sid][r.block] += 1
    for p in plan.collect():
        counts = [use[p.sid][k] for k in range(p.n_blocks)]
        assert sum(counts) == p.n_slots and max(counts) - min(counts) <= 1 and set(use[p.sid]) <= set(range(p.n_blocks))


def plain_permuted(pos, n, key):
    """One place of the permutation, number by number."""
    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    while True:
        a, b = pos >> half, pos % 2**half
        for k in range(4):
            a, b = b, a ^ mix((b + mix((key + k + 1) % 2**64)) % 2**64) % 2**half
        pos = a * 2**half + b
        if pos < n:
            return pos


def test_taken_words_against_plain_python(spark):
    """Blocks, slots and permutations recomputed one by one; how slots fall into shards does not change what is taken."""
    docs = sorted((r.doc_id, r.source, len((r.text or "").encode().split())) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    want = targets(size)

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    taken = {}
    for sid, s in enumerate(sorted(size, key=lambda s: [ord(c) for c in s])):
        n = -(-size[s] // M.BLOCK)
        use = Counter(plain_permuted(j % n, n, mix((sid * 1_000_003 + j // n + M.SEED) % 2**64)) for j in range(round(want[s] * n / size[s])))
        at = 0
        for i, source, words in docs:
            if source == s:
                taken[i] = sum(use[w // M.BLOCK] for w in range(at, at + words))
                at += words
    assert {r.doc_id: r.taken for r in M.mix_documents(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()} == taken


def test_draws_of_ranges_fit_together(monkeypatch):
    """Every range of shards is drawn on its own, and together they hold every slot once."""
    monkeypatch.setattr(M, "RANGE", 4)
    for n_shards, slots in ((1, 100), (4, 0), (37, 5000), (64, 123_457)):
        at = 0
        per = []
        for first in range(0, n_shards, 4):
            before, counts = M._range_counts(7, 3, slots, n_shards, first)
            assert before == at and len(counts) == min(4, n_shards - first)
            at += int(counts.sum())
            per += counts.tolist()
        assert at == slots
    mean = slots / n_shards
    assert all(abs(c - mean) < 7 * mean**0.5 for c in per)


def test_a_very_long_document(spark, make_docs):
    docs = make_docs([(1, "long " * 400_000, "en", "a"), (2, "x y z", "en", "a"), (3, "p " * 70, "en", "b")])
    out = {r.doc_id: r for r in M.mix_documents(docs).collect()}
    assert out[1].size == 400_000 and 0 < out[1].taken <= 800_000 and sum(r.taken for r in out.values()) > 500_000
    assert sum(len(r.text.split()) for r in M.mixed_rows(docs).collect()) == sum(r.taken for r in out.values())


def test_empty(spark, make_docs):
    assert M.mix_documents(make_docs([])).count() == 0
    assert M.mixed_rows(make_docs([])).count() == 0
