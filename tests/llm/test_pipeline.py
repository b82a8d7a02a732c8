"""Every stage of the pipeline against a brute-force version on its own input, and run() against the stages."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from keepwise.llm import mixing, sql
from keepwise.llm.common import materialize
from keepwise.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm.conftest import LABELS
from tests.llm.test_minhash_cps import brute
from tests.llm.test_pii import extended
from tests.llm.test_tokens import whole

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "t"))
    return out


def rows(df):
    return sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_stages_return_the_columns_of_documents(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages[:5])


def test_quality(stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'; CREATE VIEW labels AS FROM '{SF}/labels.parquet'")
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({sql.QUALITY_RULES})").fetchall() if k}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in kept] and 0 < len(kept) < 1000


def test_near_duplicates(stages):
    want = brute([(r[0], r[1]) for r in rows(stages[1])])
    keep = {c for _, c in want.values()}
    assert rows(stages[2]) == [r for r in rows(stages[1]) if r[0] in keep] and len(keep) < len(want)


def test_personal_data(stages):
    before = rows(stages[2])
    spans = extended([r[1] for r in before])
    want = []
    for n, r in enumerate(before):
        text, at = "", 0
        for kind, s, e in sorted(spans[n], key=lambda x: (x[1], x[2])):
            if s >= at:
                text += r[1][at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        text += r[1][at:]
        want.append((r[0], text, r[2], r[3], len(text)))
    assert rows(stages[3]) == want and any(spans.values())


def test_mixing(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix_documents(stages[3]).collect()}
    text = {r[0]: r for r in rows(stages[3])}
    got = Counter()
    for r in rows(stages[4]):
        words, full = r[1].encode().split(), iter(text[r[0]][1].encode().split())
        assert all(w in full for w in words) and r[2:4] == text[r[0]][2:4] and r[4] == len(r[1])   # a subsequence
        got[r[0]] += len(words)
    assert got == Counter({i: n for i, n in taken.items() if n}) and max(Counter(r[0] for r in rows(stages[4])).values()) == 2


def test_packing(stages):
    texts = Counter(whole(r[1]).tobytes() for r in rows(stages[4]))
    pieces, by_sequence = {}, {}
    for p in stages[5].collect():
        ids = np.frombuffer(bytes(p.ids), "<u2").astype("<u4")
        assert zlib.crc32(ids.tobytes()) == p.ids_crc32 and len(ids) == p.length
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        pieces[p.sequence_id * 4096 + p.offset] = (p.start, p.doc_tokens, ids)
    found, held = Counter(), []
    for at in sorted(pieces):
        start, n, ids = pieces[at]
        assert start == sum(map(len, held))
        held.append(ids)
        if sum(map(len, held)) == n:
            found[np.concatenate(held).tobytes()] += 1
            held = []
    assert found == texts and not held
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert all(sum(n for _, n in v) == 4096 for k, v in by_sequence.items() if k < len(by_sequence) - 1)


def test_run_is_the_stages_in_order(spark, stages):
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, SF_SMALL).collect())
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF_SMALL), "t")
    assert sum(r[2] for r in got) == sum(r.length for r in docs.collect()) > 0


def test_nulls_extra_columns_and_empty_tables(spark, make_docs):
    text = " ".join(f"word{i} stays{i} alone{i}" for i in range(40))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (None, text + " more of it", "fr", None), (2, None, None, None), (3, "", "en", "a"),
            (4, " ".join(f"other{i} words{i} second{i}" for i in range(60)), None, "b"), (None, None, None, None)]
    folder = scratch_path(spark, "sf")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    docs = make_docs(rows).selectExpr("*", "doc_id AS row", "text AS key", "lang AS shard", "source AS doc", "n_chars AS id", "lang AS new_text")
    for name, stage in corpus_pipeline.STAGES:
        last, docs = docs, materialize(stage(spark, docs, folder), "t")
        assert name == "packing" or docs.columns == last.columns
    assert docs.count() > 0
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = materialize(stage(spark, empty, folder), "t")
        assert empty.count() == 0
