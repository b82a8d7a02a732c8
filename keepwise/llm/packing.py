"""Packing by concatenate-and-cut with two-pass prefix sums.

Pass 1 tokenizes every document where it is read (no shuffle) and writes ids
with each document's offset inside its partition. The partition totals, one row
per partition, become global offsets by a running sum. Pass 2 adds the offsets
and cuts the global id stream into fixed windows: window g // size is the
sequence, g % size the place in it. A document that crosses a border leaves one
piece on each side (boundary records), so every window is full except the last.

The order of concatenation is the order of the written table (partition, then
row), which is fixed once pass 1 is written: a lost executor re-reads it.

Edge cases: null or empty text is just the end id; repeated rows are packed each
on their own; null doc_id is kept; extra columns are not read; an empty table
gives no pieces; a text of any length is cut into as many pieces as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm import tokens
from keepwise.llm.common import give_back, lean_batches, materialize, small_batches

if TYPE_CHECKING:
    import pyarrow as pa

SEQUENCE = 4096
IDS_SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids binary"
PIECE_SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                "sequence_id long, offset long, ids binary")


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """part, doc_id, local_start, n_tokens, ids (packed as unsigned 16-bit where
    the vocabulary allows it; ids below 65,536)."""
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, at, memo = TaskContext.get().partitionId(), 0, tokens.tokens_of(path)
        for whole in batches:
            for batch in small_batches([whole]):
                starts, counts, packed = [], [], []
                for text in batch.column("text").to_pylist():
                    ids = np.frombuffer(tokens.text_ids(text, memo), dtype="<u4").astype("<u2")
                    starts.append(at)
                    counts.append(len(ids))
                    packed.append(ids.tobytes())
                    at += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * batch.num_rows, pa.int32()), batch.column("doc_id"), pa.array(starts, pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["part", "doc_id", "local_start", "n_tokens", "ids"])
            give_back()

    return lean_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, IDS_SCHEMA)


def partition_offsets(ids: DataFrame) -> DataFrame:
    """part, base: ids of all partitions before it (one row per partition)."""
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def pack(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece, with its ids (unsigned 16-bit little-endian)."""
    ids = materialize(tokenized(docs, vocabulary), "pack-ids")
    # one row per input partition: bounded by the number of tasks, not by the rows
    placed = ids.join(F.broadcast(partition_offsets(ids)), "part").select(
        "doc_id", "n_tokens", "ids", (F.col("base") + F.col("local_start")).alias("global_start"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        import pyarrow as pa

        tokens.forget()     # every text is tokenized by now
        for batch in small_batches(batches):
            rows = []
            for doc_id, n, raw, g in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "global_start"))):
                a = np.frombuffer(raw, dtype="<u2")
                at = 0
                while at < n:
                    seq, off = divmod(g + at, size)
                    piece = a[at:at + min(size - off, n - at)]
                    rows.append((doc_id, at, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), n, seq, off, piece.tobytes()))
                    at += len(piece)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            types = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        give_back()

    return lean_batches(placed).mapInArrow(cut, PIECE_SCHEMA)
