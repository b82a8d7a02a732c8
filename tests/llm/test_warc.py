"""Archives: exact round trip, revisits, seek table, single-record seeks."""

import hashlib

import pytest
import zstandard
from pyspark.sql import types as T

from keepwise.llm import files, warc

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                      T.StructField("html", T.StringType()), T.StructField("record_id", T.StringType())])
LONG = "<p>" + "é" * 60 + "</p>"


@pytest.fixture(scope="module")
def archive(spark):
    rows = [(i, f"http://h/{i}", LONG if i % 3 == 0 else f"page {i} \r\n\r\n" + "x" * i, "clash") for i in range(60)]
    rows += [(100, None, None, None), (101, "http://a\r\nb", "", None), (102, "u", "short", None), (103, "u", "short", None),
             (104, "u", "y" * 3_000_000, None), (None, "u", "no id", None), (200, "u", LONG, None), (200, "u", LONG, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    index = warc.write_archive(pages, files.shared_folder(spark, "w"), frame_bytes=500)
    return rows, index, warc.read_archive(index).collect()


def test_every_record_comes_back(archive):
    rows, _, out = archive
    assert len(out) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = sorted(((-1 if i is None else i), hashlib.sha256((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h, _ in rows)
    assert sorted(((-1 if r.record_id is None else r.record_id), r.payload_digest, r.payload_bytes) for r in out) == want
    text = {i: h or "" for i, _, h, _ in rows}
    for r in out:
        h = text[r.record_id]
        if h in first and r.record_id != first[h]:
            assert r.record_type == "revisit" and r.refers_to == first[h] and r.payload is None
        else:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload).decode() == h


def test_rows_repeated_under_an_id_keep_their_type(spark):
    pages = spark.createDataFrame([(7, "u", LONG, None)] * 3 + [(8, "u", LONG, None)] * 2, PAGES)
    out = warc.read_archive(warc.write_archive(pages, files.shared_folder(spark, "w"))).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in out) == [(7, "response", None)] * 3 + [(8, "revisit", 7)] * 2


def test_seek_table_and_plain_zstandard_agree(archive):
    _, index, _ = archive
    for (name,) in index.select("file").distinct().collect():
        with files.reading(name) as src:
            table = warc.seek_table(src)
            frames = b"".join(warc.read_frame(src, start, packed) for start, packed, _ in table)
            assert [len(warc.read_frame(src, s, p)) for s, p, _ in table] == [raw for _, _, raw in table]
            src.seek(0)
            plain = zstandard.ZstdDecompressor().stream_reader(src, read_across_frames=True).read()
        assert plain == frames


def test_one_record_by_seek(archive):
    _, index, _ = archive
    [(headers, body)] = warc.find_record(index, 104)
    assert headers["WARC-Type"] == "response" and body == b"y" * 3_000_000
    assert warc.find_record(index, 999) == []


def test_empty(spark):
    pages = spark.createDataFrame([], PAGES)
    assert warc.read_archive(warc.write_archive(pages, files.shared_folder(spark, "w"))).count() == 0
