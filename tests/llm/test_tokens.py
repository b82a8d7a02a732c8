"""Packing and token files against the tokenizer run on whole texts."""

import random
import zlib

import numpy as np
import pytest

from keepwise.llm import bitplane, files, packing, tokens
from tests.conftest import SF_SMALL

ODD = ["", None, "   \n\t", "Ünï cödé's don't I'LL 12345 x y é ́z Σας ΟΔΟΣ",
       "<|endoftext|> a<|startoftext|>b", " a　b\x1cc", "!!!???...$$$", "ab" * 5000, "9 " * 3000, "漢字かな交じり文 😀😀"]


def whole(text):
    from tokenizers import Tokenizer

    t = whole.__dict__.setdefault("t", Tokenizer.from_file(tokens.vocabulary_path()))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, tokens.END_ID], dtype="<u4")


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(7)
    alphabet = "aBc'sß é́ \n\t12_-<|>ΣσİI"
    fuzz = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    return rows + [(10_000 + i, t) for i, t in enumerate(ODD + fuzz)]


def test_chunkwise_ids_are_the_ids_of_whole_texts(texts):
    memo = tokens.tokens_of(tokens.vocabulary_path())
    for _, t in texts:
        assert tokens.text_ids(t, memo) == whole(t).tobytes(), repr(t)[:80]


def test_memo_stays_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_CHUNKS", 5)
    memo = tokens.Tokens(tokens.vocabulary_path())
    for i in range(50):
        assert tokens.text_ids(f"w{i} Tail.", memo) == whole(f"w{i} tail.").tobytes()
        assert len(memo.young) + len(memo.young.older) <= 20 and not getattr(memo.young.older, "older", None)


def test_pack_cuts_every_id_once_and_fills_sequences(spark, make_docs, texts):
    docs = make_docs([(i, t, "en", "s") for i, t in texts]).repartition(5)
    rows = packing.pack(docs, size=256).collect()
    want = {i: whole(t) for i, t in texts}
    total = sum(map(len, want.values()))
    got = {i: np.zeros(len(a), dtype=int) for i, a in want.items()}
    filled = {}
    for r in rows:
        a = want[r.doc_id]
        piece = a[r.start:r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(a)
        assert zlib.crc32(piece.tobytes()) == r.ids_crc32
        assert np.array_equal(np.frombuffer(bytes(r.ids), "<u2"), piece)
        got[r.doc_id][r.start:r.start + r.length] += 1
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all((g == 1).all() for g in got.values())
    for seq, parts in filled.items():
        at = 0
        for off, length in sorted(parts):
            assert off == at
            at += length
        assert at == 256 or seq == max(filled)
    assert len(filled) == -(-total // 256)


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [1, 7, 8, 4096])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
    assert np.array_equal(bitplane.from_planes(bitplane.to_planes(ids, bits), n, bits), ids)


@pytest.mark.parametrize("bits,block", [(8, 1 << 16), (1, 100), (8, 33)])
def test_token_files_round_trip_in_doc_order(spark, make_docs, texts, bits, block):
    rows = [(i, t, "en", "s") for i, t in texts] + [(None, "no id", None, None), (10_000, "again", "en", "s")]
    docs = make_docs(rows).repartition(4)
    out = bitplane.token_files(docs, files.shared_folder(spark, "t"), bits=bits, block=block).collect()
    want = sorted(((-1 if i is None else i), t or "") for i, t, _, _ in rows)
    at = 0
    for r, (i, t) in zip(sorted(out, key=lambda r: r.start), want, strict=True):
        a = whole(t)
        assert (-1 if r.doc_id is None else r.doc_id) == i and r.start == at and r.n_tokens == len(a)
        assert bytes(r.ids) == a.tobytes() and r.ids_crc32 == zlib.crc32(a.tobytes())
        at += len(a)


def test_random_access_to_blocks(spark, make_docs, tmp_path):
    name = f"file://{tmp_path}/x.bpl"
    ids = np.arange(1000, dtype="<u4")
    with files.writing(name) as out:
        w = bitplane.PlaneWriter(out, block=64)
        w.add(1, ids)
        w.close()
    with files.reading(name) as src:
        reader = bitplane.PlaneReader(src)
        assert np.array_equal(reader.block(7), ids[7 * 64:8 * 64])
        assert np.array_equal(reader.block(15), ids[15 * 64:])


def test_empty_tables(spark, make_docs):
    assert packing.pack(make_docs([])).count() == 0
    assert bitplane.token_files(make_docs([]), files.shared_folder(spark, "e")).count() == 0


def test_clashing_columns_are_not_read(spark, make_docs):
    docs = make_docs([(1, "one two", "en", "s"), (2, None, None, None)])
    odd = docs.selectExpr("*", "doc_id AS part", "text AS ids", "lang AS n_tokens", "source AS base", "text AS file")
    assert sorted(packing.pack(odd).collect()) == sorted(packing.pack(docs).collect())
    a, b = (bitplane.token_files(d, files.shared_folder(spark, "c")).collect() for d in (odd, docs))
    assert sorted(a) == sorted(b)
