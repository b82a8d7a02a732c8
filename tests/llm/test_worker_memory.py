"""What Python workers hold: Arrow batches are cut by bytes, and freed memory and tokenizers do not outlive their stage."""

from pyspark.sql import functions as F

from keepwise.llm import packing, tokens
from keepwise.llm.common import BATCH_BYTES, map_columns
from tests.conftest import SF_SMALL


def in_workers(spark, report):
    """``report()`` of the worker of every task."""
    def run(batches):
        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([report()])], ["n"])

    return [r.n for r in spark.range(64, numPartitions=8).mapInArrow(run, "n long").collect()]


def resident():
    import re

    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) >> 10


def test_batches_of_texts_are_cut_by_bytes(spark):
    def run(frames):
        for rows in frames:
            yield {"n": [len(rows["text"])], "size": [sum(map(len, rows["text"]))]}

    texts = spark.range(6000, numPartitions=1).select(F.repeat(F.lit("0123456789"), 300).alias("text"))
    sizes = map_columns(texts, run, "n long, size long").collect()
    assert sum(r.n for r in sizes) == 6000 and max(r.size for r in sizes) < 1.1 * BATCH_BYTES   # 18 MB in all
    long = spark.range(3, numPartitions=1).select(F.repeat(F.lit("0123456789"), 600_000).alias("text"))
    assert [r.size for r in map_columns(long, run, "n long, size long").collect()] == [6_000_000] * 3


def test_an_own_setting_is_kept(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    other = spark.newSession()
    other.conf.set(name, "2m")
    map_columns(other.range(1), lambda frames: frames, "id long")
    assert other.conf.get(name) == "2m"


def test_workers_let_go_of_the_tokenizer(spark):
    pieces = packing.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(8))
    assert pieces.count() > 0
    assert not any(in_workers(spark, lambda: tokens.tokens_of.cache_info().currsize))


def test_workers_give_freed_memory_back(spark):
    def run(frames):
        for rows in frames:
            held = [bytes(1000 + i % 7) for i in range(100_000)]      # 100 MB in small pieces, all freed but the last
            last = held[-1]
            del held
            yield {"id": rows["id"], "n": [len(last)] * len(rows["id"])}

    before = max(in_workers(spark, resident))
    assert map_columns(spark.range(64, numPartitions=8), run, "id long, n long").count() == 64
    assert max(in_workers(spark, resident)) < before + 50
