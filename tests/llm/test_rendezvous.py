"""Rendezvous sharding: the law against plain Python, growth, weights, written shards."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from keepwise.llm import queries
from keepwise.llm import rendezvous as R
from keepwise.llm.files import shared_folder
from tests.conftest import SF_MID


def plain_shard(key, shards):
    def wait(s):
        u = (int(hashlib.md5(f"{'' if key is None else key}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / shards[s]
    return min(sorted(shards), key=lambda s: (wait(s), s))


def test_query_against_plain(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_rendezvous"](spark, SF_MID).collect()
    assert len(rows) == len(docs)
    eight, nine = {k: 1.0 for k in range(8)}, {k: 1.0 for k in range(9)}
    for r in rows:
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, eight), plain_shard(r.doc_id, nine))
        assert r.grown_shard in (r.shard, 8)                        # a new shard takes rows only into itself
    for shard in range(8):
        mine = sorted((r.slot, r.doc_id) for r in rows if r.shard == shard)
        assert [s for s, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == sorted(d for _, d in mine)


def test_weights_and_moves(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = {0: 1.0, 1: 2.0, 5: 5.0}
    rows = keys.select("doc_id", R.shard_of(F.col("doc_id"), weights).alias("s"), R.shard_of(F.col("doc_id"), {**weights, 7: 2.0}).alias("g"),
                       R.shard_of(F.col("doc_id"), {0: 1.0, 5: 5.0}).alias("less")).collect()
    n = Counter(r.s for r in rows)
    assert all(abs(n[s] / 20_000 - w / 8) < 0.015 for s, w in weights.items())
    assert all(r.g in (r.s, 7) for r in rows) and all(r.less == r.s for r in rows if r.s != 1)     # only what has to move does
    assert [r.s for r in rows[:300]] == [plain_shard(r.doc_id, weights) for r in rows[:300]]
    with pytest.raises(ValueError):
        R.shard_of(F.col("doc_id"), {0: 0.0})


def test_odd_rows(spark, make_docs):
    rows = [(None, f"text {i % 3}", "en", "s") for i in range(300)] + [(5, None, None, None), (5, "", "en", "s"), (5, "é" * 30_000, "en", "s"), (6, "x", "en", "s")]
    docs = make_docs(rows).selectExpr("*", "doc_id AS shard", "text AS slot", "lang AS task", "source AS place", "n_chars AS _text")
    out = R.sharded(docs.repartition(4), shared_folder(spark, "shards"), {0: 1.0, 1: 1.0, 2: 3.0}).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in out) == sorted(
        (d or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    assert len({r.shard for r in out if r.doc_id is None}) == 1 and len({r.shard for r in out if r.doc_id == 5}) == 1
    for shard in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    folder = shared_folder(spark, "shards")
    back = R.write_shards(docs, folder, rows_per_file=50)
    assert back.select("doc.*").columns == docs.columns and back.count() == len(rows)
    assert spark.read.parquet(f"{folder}/shard={back.first().shard}").count() > 0
    assert R.sharded(make_docs([]), shared_folder(spark, "shards")).count() == 0
