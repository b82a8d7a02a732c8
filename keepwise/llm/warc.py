"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME bytes. A
bundle (one file per partition) ends with a seek table in a skippable frame:
per frame its compressed and raw length, then the magic number. Any reader of
plain Zstandard reads the bundle as one stream; a reader that knows the table
jumps to one frame. The index maps a record id to (file, frame, offset in the
frame, length), so one record costs one seek and one frame.

Equal payloads of at least MIN_REVISIT bytes are stored once: the record with
the smallest id is the response, the others are revisit records without payload
that name it. Which payloads repeat is an aggregation of digests with map-side
combine; the payloads are written where they are read, unless the list of repeated
records is too long to broadcast (then they are shuffled once, by id and digest).

Edge cases: a null payload is empty; a null url gives a record without target; a
null id is kept as such; rows repeated under one id keep one record each, of the
same type;
an empty table writes no bundle; extra columns are not read; a payload of any
length becomes a frame of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm import files
from keepwise.llm.common import materialize

FRAME = 1 << 20
LEVEL = 3
MIN_REVISIT = 100
TASK_BYTES = 16 << 20     # packed bytes of frames that a task reads
#: Fixed values of the skippable frame that holds the seek table.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

INDEX = ("record_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, "
         "file string, frame int, frame_start long, frame_bytes long, offset long, length long")


def _u32(n: int) -> bytes:
    return n.to_bytes(4, "little")


class BundleWriter:
    """Streams records into frames; holds one frame."""

    def __init__(self, out, frame_bytes: int = FRAME, level: int = LEVEL):
        self.out, self.limit = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held, self.held_bytes, self.at = [], 0, 0
        self.table: list[tuple[int, int]] = []
        self.located: list[tuple[int, int, int, int, int]] = []
        self._open: list[tuple[int, int]] = []

    def add(self, record: bytes) -> None:
        self._open.append((self.held_bytes, len(record)))
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= self.limit:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        n = len(self.table)
        self.located += [(n, self.at, len(packed), off, size) for off, size in self._open]
        self.table.append((len(packed), self.held_bytes))
        self.at += len(packed)
        self.held, self.held_bytes, self._open = [], 0, []

    def close(self) -> None:
        self.flush()
        body = b"".join(_u32(c) + _u32(r) for c, r in self.table)
        body += _u32(len(self.table)) + b"\0" + _u32(SEEKABLE_MAGIC)
        self.out.write(_u32(SKIPPABLE_MAGIC) + _u32(len(body)) + body)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed length, raw length) of every frame, from the footer."""
    end = source.size()
    source.seek(end - 9)
    tail = source.read(9)
    if int.from_bytes(tail[5:], "little") != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    n = int.from_bytes(tail[:4], "little")
    source.seek(end - 9 - 8 * n)
    body, start, out = source.read(8 * n), 0, []
    for k in range(n):
        packed, raw = (int.from_bytes(body[8 * k + j:8 * k + j + 4], "little") for j in (0, 4))
        out.append((start, packed, raw))
        start += packed
    return out


def read_frame(source, start: int, length: int) -> bytes:
    source.seek(start)
    return zstandard.ZstdDecompressor().decompress(source.read(length))


def _id(n) -> str:
    return "none" if n is None else str(n)


def make_record(record_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    kind = "revisit" if revisit else "response"
    block = HTTP_HEAD + (b"" if revisit else payload)
    head = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:record:{_id(record_id)}>\r\nWARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: <urn:record:{_id(refers_to)}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (HTTP head taken off)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block[len(HTTP_HEAD):]


def _urn(value: str | None) -> int | None:
    number = value[len("<urn:record:"):-1] if value else "none"
    return None if number == "none" else int(number)


def with_revisits(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    """record_id, url, payload, digest, first_id (of the response) and is_repeated.

    Who repeats whom is settled on (id, digest) rows; the payloads are only
    joined to the outcome, by their own id, so a payload shared by a third of
    all records makes no hot key.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = (pages.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
            .withColumn("digest", F.sha2("payload", 256)))
    keys = materialize(rows.where(F.octet_length("payload") >= MIN_REVISIT).select("record_id", "digest"), "warc-keys")
    groups = materialize(keys.groupBy("digest").agg(F.min("record_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").drop("n"), "warc-repeated")
    repeated = (keys.join(groups, "digest").distinct()
                .select(F.col("record_id").alias("rid"), F.col("digest").alias("rdigest"), "first_id"))
    return (rows.join(repeated, F.col("record_id").eqNullSafe(F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
            .select("record_id", "url", "payload", "digest", "first_id", F.col("rdigest").isNotNull().alias("is_repeated")))


def write_archive(pages: DataFrame, folder: str, record_id: str = "page_id", url: str = "url", payload: str = "html",
                  frame_bytes: int = FRAME) -> DataFrame:
    """Write the bundles; returns the index, itself written beside them."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        rows, first = [], next((f for f in frames if len(f)), None)
        if first is None:
            return
        with files.writing(name) as out:
            writer, pdf = BundleWriter(out, frame_bytes), first
            while pdf is not None:
                for rid, target, body, digest, first_id, repeated in zip(
                        pdf["record_id"], pdf["url"], pdf["payload"], pdf["digest"], pdf["first_id"], pdf["is_repeated"]):
                    rid = None if pd.isna(rid) else int(rid)
                    first_id = None if pd.isna(first_id) else int(first_id)
                    revisit = bool(repeated) and rid != first_id
                    refers = first_id if revisit else None
                    writer.add(make_record(rid, target, body, digest, refers, revisit))
                    rows.append((rid, "revisit" if revisit else "response", refers, digest, len(body)))
                pdf = next(frames, None)
            writer.close()
        index = pd.DataFrame(rows, columns=["record_id", "record_type", "refers_to", "payload_digest", "payload_bytes"])
        place = pd.DataFrame(writer.located, columns=["frame", "frame_start", "frame_bytes", "offset", "length"])
        index.insert(5, "file", name)
        yield pd.concat([index.astype({"record_id": "Int64", "refers_to": "Int64"}), place], axis=1)

    return materialize(with_revisits(pages, record_id, url, payload).mapInPandas(run, INDEX), "warc-index")


def read_archive(index: DataFrame) -> DataFrame:
    """Every record read back from its frame: record_id, url, record_type, refers_to,
    payload_digest, payload_bytes and payload (null for revisits).

    Frames, not records, are dealt to the tasks; each is read and opened once.
    Digest and size of a response are computed from the payload that was read.
    """
    work = (index.groupBy("file", "frame", "frame_start", "frame_bytes")
            .agg(F.collect_list(F.struct("offset", "length")).alias("places")))   # bounded by the frame size
    # dealt by what the frames hold: a shuffle sees only the few bytes of their index rows
    total = work.agg(F.sum("frame_bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(total["n"], max(cores, -(-int(total["b"] or 0) // TASK_BYTES))))
    work = work.repartition(tasks, "file", "frame")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, start, length, at in zip(pdf["file"], pdf["frame_start"], pdf["frame_bytes"], pdf["places"]):
                rows = []
                with files.reading(name) as source:
                    raw = read_frame(source, int(start), int(length))
                for place in at:
                    headers, body = parse_record(raw[place["offset"]:place["offset"] + place["length"]])
                    revisit = headers["WARC-Type"] == "revisit"
                    rows.append((_urn(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Type"],
                                 _urn(headers.get("WARC-Refers-To")),
                                 headers["WARC-Payload-Digest"].split(":")[1] if revisit else hashlib.sha256(body).hexdigest(),
                                 int(headers["X-Payload-Length"]) if revisit else len(body), None if revisit else body))
                yield pd.DataFrame(rows, columns=["record_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes",
                                                  "payload"]).astype({"record_id": "Int64", "refers_to": "Int64"})

    return work.mapInPandas(run, "record_id long, url string, record_type string, refers_to long, "
                                 "payload_digest string, payload_bytes long, payload binary")


def find_record(index: DataFrame, record_id: int) -> list[tuple[dict[str, str], bytes]]:
    """One record by id: one seek and one frame each."""
    out = []
    for r in index.where(F.col("record_id") == record_id).collect():
        with files.reading(r.file) as source:
            raw = read_frame(source, r.frame_start, r.frame_bytes)
        out.append(parse_record(raw[r.offset:r.offset + r.length]))
    return out
