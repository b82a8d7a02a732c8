"""Toxicity: features against a direct count, held-out accuracy, edge rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.llm import toxicity as T
from tests.llm.conftest import LABELS

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = T.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.toxic is not None]
    hit = sum(r.predicted for r in held if r.toxic)
    assert hit / sum(r.toxic for r in held) > 0.8 and hit / sum(r.predicted for r in held) > 0.9


def test_features_do_not_depend_on_windows(monkeypatch):
    text = " ".join(f"wörd{i} ABC-{i}" for i in range(500))
    whole = T.features(text)
    monkeypatch.setattr(T, "WINDOW", 57)
    assert np.array_equal(T.features(text), whole)
    table = np.full(1 << T.BITS, -1, dtype=np.int32)
    table[whole[::3]] = np.arange(len(whole[::3]))
    assert np.array_equal(T.features(text, table), np.arange(len(whole[::3])))
    assert np.array_equal(T.features("  A\tb\n"), T.features("a b"))
    for flat in (" a b ", " hé 日本語😀 "):       # characters, not bytes
        grams = {flat[i:i + n] for n in T.GRAMS for i in range(len(flat) - n + 1)}
        assert len(T.features(flat)) == len(grams)


def test_edge_rows(spark, make_docs):
    rows = [(i, "you awful idiot here" if i % 3 == 0 else f"pleasant calm words {i}", "en", "s") for i in range(60)]
    rows += [(None, "idiot", None, None), (100, None, "en", "s"), (101, "", "en", "s"), (3, rows[3][1], "en", "s")]
    docs = make_docs(rows).selectExpr("*", "doc_id AS toxic", "n_chars AS label_id")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)] + [(3, 1, 0), (None, 1, 1), (5, 1, None)], LABELS)
    out = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    assert out[None].held_out is False and out[100].score == out[101].score
    assert out[3].predicted == 1 and out[4].predicted == 0
    none = T.toxicity(docs, labels.where(F.lit(False))).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.0}
    assert T.toxicity(make_docs([]), labels).count() == 0


def test_sample_is_bounded_and_never_held_out(spark, make_docs):
    docs = make_docs([(i, "t", "en", "s") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], LABELS)
    ids = [r.doc_id for r in T.training_rows(docs, labels, limit=50).collect()]
    assert len(ids) == 50 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    a, b = (T.fit(docs.repartition(k), labels) for k in (1, 5))
    assert np.array_equal(a.feature, b.feature) and a.intercept == pytest.approx(b.intercept)


def plain_feature(gram):
    """The feature of one n-gram, number by number."""
    h = 0
    for k, c in enumerate(gram):
        v = (ord(c) + 1) * 2654435769 % 2**32
        v = (v ^ v >> 16) * 0x45D9F3B5 % 2**32
        v ^= v >> 13
        h += v * pow(2654435769, k, 2**32)
    h %= 2**32
    return ((h ^ h >> 15) + len(gram)) * 0x85EBCA6B % 2**32 >> (32 - T.BITS)


def plain_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    flat = " " + " ".join(w for w in low.replace("\t", " ").replace("\n", " ").split(" ") if w) + " "
    return {plain_feature(flat[i:i + n]) for n in T.GRAMS for i in range(len(flat) - n + 1)}


def test_whole_model_against_plain_python(spark, make_docs):
    rng = np.random.default_rng(3)
    words = ["kind", "calm", "Tree", "río", "naïve", "stone"], ["vile", "scum", "hate", "río", "stone"]
    texts = [(i, " ".join(rng.choice(words[i % 3 == 0], 6)) + ("\tEND" if i % 5 else "")) for i in range(90)] + [(500, None), (501, "")]
    docs = make_docs([(i, t, "en", "s") for i, t in texts])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(80)], LABELS)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train = [(i, int(i % 3 == 0), plain_features(t)) for i, t in texts if i < 80 and not held(i)]
    n = [sum(y == k for _, y, _ in train) for k in (0, 1)]
    count = {}
    for _, y, f in train:
        for x in f:
            count.setdefault(x, [0, 0])[y] += 1
    ratio = {x: np.log((p + 1) / (n[1] + 2)) - np.log((q + 1) / (n[0] + 2)) for x, (q, p) in count.items() if p + q > 1}
    sure = {x: abs(r) / np.sqrt(1 / (count[x][1] + 1) + 1 / (count[x][0] + 1)) for x, r in ratio.items()}
    kept = sorted(sorted(ratio, key=lambda x: (-round(sure[x], 12), x))[:T.FEATURES])
    place, value = {x: k for k, x in enumerate(kept)}, np.array([ratio[x] for x in kept])
    rows = sorted((i, sorted(place[x] for x in f if x in place), y) for i, y, f in train)
    w, b = T._logistic([np.array(r, dtype=np.int32) for _, r, _ in rows], np.array([y for *_, y in rows], dtype=float), value, T.L2, T.STEPS)
    for r in T.toxicity(docs, labels).collect():
        f = [place[x] for x in plain_features(dict(texts)[r.doc_id]) if x in place]
        assert r.score == pytest.approx(1 / (1 + np.exp(-(b + (w * value)[f].sum()))), rel=1e-9)


def test_sample_is_bounded_in_rows(spark, make_docs):
    """One labelled id over very many rows is one training row, and the scan keeps its own parallelism."""
    docs = make_docs([(1, f"same id, text {i} " * 3, "en", "s") for i in range(3000)] + [(i, f"other text {i}", "en", "s") for i in range(2, 40)]).repartition(6)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 40)], LABELS)
    rows = T.training_rows(docs, labels, limit=10)
    assert rows.count() <= 10 and len({r.doc_id for r in rows.collect()}) == rows.count()
    assert "Coalesce 32" not in rows._jdf.queryExecution().executedPlan().toString()
    assert T.toxicity(docs, labels).count() == 3038
    long = make_docs([(1, "plain words " * 150_000, "en", "s"), (2, "x", "en", "s"), (3, "vile " * 10, "en", "s")])
    assert T.toxicity(long, labels).count() == 3
