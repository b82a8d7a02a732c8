"""Token-id files with bit-plane shuffling.

Ids are written in ascending doc_id order, cut into fixed-size blocks. Each block
is transposed into planes (all first bytes, all second bytes, ... or single
bits), every plane is compressed with zstandard on its own, and a chunk index at
the end of the file says where each plane lies. High planes are almost constant,
so they nearly vanish.

File: ``BPLANE01``, the compressed planes, a zstandard-compressed index (block
ids, plane lengths; doc_ids and token counts), then <u8 index offset, <u4 index
length, <u4 format (bits per plane). All integers little-endian.

The order comes from a range partitioning on doc_id; a file per partition, each
a bounded share of the rows, is written and read as a stream of blocks, so a
task holds one block and the document at hand. ``start`` is a running sum over
per-file totals (one row per file).

Edge cases: null or empty text is just the end id; null doc_ids sort first;
repeated doc_ids keep all their rows, ordered by text; an
empty table writes no file and returns no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm import files, tokens
from keepwise.llm.common import materialize, small_batches

MAGIC = b"BPLANE01"
BLOCK = 1 << 16
LEVEL = 3


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block of uint32 ids: 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    flags = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        flags = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Streams ids into a file; holds at most one block."""

    def __init__(self, out, block: int = BLOCK, bits: int = 8, level: int = LEVEL):
        self.out, self.block, self.bits = out, block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending, self.held, self.at = [], 0, len(MAGIC)
        self.chunks: list[list[int]] = []
        self.docs: list[tuple[int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.pending.append(ids)
        self.held += len(ids)
        while self.held >= self.block:
            a = np.concatenate(self.pending)
            self._flush(a[: self.block])
            self.pending, self.held = [a[self.block:]], len(a) - self.block

    def _flush(self, ids: np.ndarray) -> None:
        sizes = []
        for plane in to_planes(ids, self.bits):
            packed = self.zstd.compress(plane)
            self.out.write(packed)
            sizes.append(len(packed))
        self.chunks.append([len(ids), *sizes])
        self.at += sum(sizes)

    def close(self) -> None:
        if self.held:
            self._flush(np.concatenate(self.pending))
        null = np.array([d is None for d, _ in self.docs], dtype=np.uint8)
        index = b"".join([
            len(self.chunks).to_bytes(8, "little"), np.array(self.chunks, dtype="<u4").tobytes(),
            len(self.docs).to_bytes(8, "little"), null.tobytes(),
            np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes(),
            np.array([n for _, n in self.docs], dtype="<i8").tobytes()])
        packed = self.zstd.compress(index)
        self.out.write(packed)
        self.out.write(self.at.to_bytes(8, "little") + len(packed).to_bytes(4, "little") + self.bits.to_bytes(4, "little"))


class PlaneReader:
    """Reads a file's documents in order, block by block, or any one block."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - 16)
        tail = source.read(16)
        at, length, self.bits = (int.from_bytes(tail[a:b], "little") for a, b in ((0, 8), (8, 12), (12, 16)))
        source.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(source.read(length))
        width = 1 + 32 // self.bits
        n = int.from_bytes(raw[:8], "little")
        self.chunks = np.frombuffer(raw, "<u4", n * width, 8).reshape(n, width)
        p = 8 + 4 * n * width
        m = int.from_bytes(raw[p:p + 8], "little")
        null = np.frombuffer(raw, np.uint8, m, p + 8)
        self.doc_ids = [None if gone else d for d, gone in zip(np.frombuffer(raw, "<i8", m, p + 8 + m).tolist(), null)]
        self.n_tokens = np.frombuffer(raw, "<i8", m, p + 8 + 9 * m)
        self.offsets = len(MAGIC) + np.concatenate([[0], np.cumsum(self.chunks[:, 1:].sum(axis=1, dtype=np.int64))])

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        zstd, n = zstandard.ZstdDecompressor(), int(self.chunks[k, 0])
        return from_planes([zstd.decompress(self.source.read(int(s))) for s in self.chunks[k, 1:]], n, self.bits)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.zeros(0, dtype="<u4"), 0
        for i, n in enumerate(self.n_tokens):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield self.doc_ids[i], held[:n]
            held = held[n:]


def write_planes(docs: DataFrame, folder: str, vocabulary: str | None = None, block: int = BLOCK,
                 bits: int = 8) -> DataFrame:
    """Tokenize and write; returns the manifest (file_no, file, n_docs, n_tokens), written beside the files."""
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file_no, memo = TaskContext.get().partitionId(), tokens.tokens_of(path)
        name, parts = f"{folder}/ids-{file_no:06d}.bpl", small_batches(batches)
        part = next(parts, None)
        if part is None:
            return
        n_docs = n_tokens = 0
        with files.writing(name) as out:
            writer = PlaneWriter(out, block, bits)
            while part is not None:
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.frombuffer(tokens.text_ids(text, memo), dtype="<u4")
                    writer.add(doc_id, ids)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(ids)
                part = next(parts, None)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([file_no], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()),
                                          pa.array([n_tokens], pa.int64())], ["file_no", "file", "n_docs", "n_tokens"])

    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text"))   # rows of a hot id go to many files
    return materialize(ordered.mapInArrow(run, "file_no int, file string, n_docs long, n_tokens long"), "plane-manifest")


def read_planes(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of every document of the files.

    One row per file is dealt out to the tasks; each streams its file.
    """
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("file_no", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                rows = []
                with files.reading(name) as source:
                    for doc_id, ids in PlaneReader(source).documents():
                        raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
                        rows.append((doc_id, at, len(ids), zlib.crc32(raw), raw))
                        at += len(ids)
                        if len(rows) >= 512:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    tasks = max(1, based.sparkSession.sparkContext.defaultParallelism * 4)
    return based.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def token_files(docs: DataFrame, folder: str, vocabulary: str | None = None, block: int = BLOCK, bits: int = 8) -> DataFrame:
    """Write every document's ids and read the files back."""
    return read_planes(write_planes(docs, folder, vocabulary, block, bits))
