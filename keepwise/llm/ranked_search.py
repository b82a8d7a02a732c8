"""Ranked lexical search by range-maximum queries over posting lists.

Index. Documents are taken in blocks of at most ``BLOCK_DOCS`` rows and about
``BLOCK_TERMS`` terms, in the task that reads them, so a hot source or a very long
text is never gathered. Inside a block documents stand in doc_id order; per term of
the block there is a row with the document places and the term frequencies. The
number of documents with a term is the sum of its lists' lengths, the corpus totals
come from a row per block.

Search. Blocks are dealt out with the posting lists of the query's terms (the query
terms of a batch are bounded, so they are broadcast). Per list a sparse table of
maxima over power-of-two spans answers "largest impact of this term between two
places" with two look-ups. For every item a heap holds document intervals of the
block by the sum of these maxima, an upper bound of every score inside. The interval
with the highest bound is split at the document of the largest single impact, which
is scored exactly; intervals of at most ``LEAF`` documents are scored whole. The
search of a block ends when no bound reaches the item's tenth score so far, which is
carried from block to block. Each task gives its ten best per item, and the best of
all follow.

Queries are taken in batches of at most ``BATCH_ITEMS`` items and ``BATCH_TERMS``
different terms an item, each a pass over the index, so what is broadcast has a bound
however many items there are.

Edge cases: a null or empty text has no terms: such a document never scores, such an
item has no rows; repeated documents are documents of their own; repeated items (and
null item_ids) each give their own rows; equal scores go by ascending doc_id, null
last; an empty table gives no rows; extra columns are not read. All arithmetic but
the weight's logarithm is in whole numbers.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import materialize
from keepwise.operators.rank import running_sums

#: on UTF-8 bytes: digits, letters, and all of every character beyond ASCII
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK_DOCS, BLOCK_TERMS = 2048, 1 << 20
LEAF, TOP = 128, 10
BATCH_ITEMS, BATCH_TERMS = 1000, 100_000
NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order (bytes.lower changes A-Z only)."""
    return TERM.findall((text or "").encode("utf-8", "replace").lower())


class _Numbers(dict):
    """term -> its number in a block, given on first sight."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


def _block_rows(block: int, ids: list, found: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
    """The rows of one block: first its documents (term null: ids, term counts), then its terms."""
    known = np.array([NO_ID if i is None else i for i in ids], dtype=np.int64)
    order = np.argsort(known, kind="stable")
    known, found = known[order], [found[i] for i in order]
    null = np.array([ids[i] is None for i in order], dtype=np.uint8)
    sizes = np.array([len(f) for f in found], dtype=np.int64)
    n = len(ids)
    key, tf = np.unique(np.concatenate(found) * n + np.repeat(np.arange(n), sizes), return_counts=True)
    term, place = key // n, (key % n).astype("<i4")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1, [len(term)]]) if len(term) else np.zeros(1, dtype=np.int64)
    offsets = pa.py_buffer((starts * 4).astype("<i4").tobytes())

    def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
        body = pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, offsets, pa.py_buffer(values.astype("<i4").tobytes())])
        return pa.concat_arrays([pa.array([first.tobytes()], pa.binary()), body])

    count = len(starts)
    words = [t.decode("utf-8", "replace") for t in numbers]     # in order of their numbers
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * count, pa.int64()), pa.array([None, *words], pa.string()),
         pa.array(np.concatenate([[0], np.diff(starts)]), pa.int64()), lists(place, known), lists(tf, sizes),
         pa.array([null.tobytes()] + [None] * (count - 1), pa.binary()),
         pa.array([int((sizes > 0).sum())] + [0] * (count - 1), pa.int64()), pa.array([int(sizes.sum())] + [0] * (count - 1), pa.int64())],
        ["block", "term", "df", "places", "tfs", "nulls", "n_docs", "n_terms"])


HITS = "key long, item_id long, doc_id long, score long, task long"
INDEX = "block long, term string, df long, places binary, tfs binary, nulls binary, n_docs long, n_terms long"


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The written index of all rows of ``docs`` (columns ``INDEX``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, found, held, numbers = [], [], 0, _Numbers()
        for batch in batches:
            texts = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                terms = terms_of(texts[i].as_py())
                ids.append(doc_id)
                found.append(np.fromiter(map(numbers.__getitem__, terms), dtype=np.int64, count=len(terms)))
                held += len(terms)
                if len(ids) >= block_docs or held >= block_terms:
                    yield _block_rows(block, ids, found, numbers)
                    ids, found, held, numbers, block = [], [], 0, _Numbers(), block + 1
        if ids:
            yield _block_rows(block, ids, found, numbers)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "search-index")


def impacts(tf: np.ndarray, m: np.ndarray, w: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m))"""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m = 100 - 75 + ((75 n N) div L), beyond 64 bits where it has to be."""
    if not n_terms:
        return np.full(len(n), 25, dtype=np.int64)
    if 75 * int(n.max(initial=0)) * n_docs < 1 << 62:
        return 25 + (75 * n * n_docs) // n_terms
    return np.array([25 + (75 * int(x) * n_docs) // n_terms for x in n], dtype=np.int64)


class BlockTables:
    """One block's posting lists for a batch of queries, laid end to end, and their sparse table.

    ``table[k][i]`` is the largest impact in ``[i, i + 2^k)`` of the laid-out lists; spans asked
    for lie inside one list, so that a span of the table may reach over its end does no harm."""

    def __init__(self, doc_ids: np.ndarray, lists: list[tuple[str, np.ndarray, np.ndarray]]):
        self.doc_ids, self.n = doc_ids, len(doc_ids)
        self.number = {t: i for i, (t, _, _) in enumerate(lists)}
        sizes = np.array([len(p) for _, p, _ in lists], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.place = np.concatenate([p for _, p, _ in lists]) if lists else np.zeros(0, dtype=np.int64)
        # places of list i lie at i * (n + 1) and up: one sorted array to find a document in every list at once
        self.key = self.place + np.repeat(np.arange(len(lists)), sizes) * (self.n + 1)
        self.table = [np.concatenate([v for _, _, v in lists]) if lists else np.zeros(0, dtype=np.int64)]
        span, longest = 1, int(sizes.max(initial=0))
        while 2 * span <= longest:
            last = self.table[-1]
            up = last.copy()
            np.maximum(last[:-span], last[span:], out=up[:-span])
            self.table.append(up)
            span *= 2
        self.flat = np.stack(self.table) if len(self.place) else np.zeros((1, 0), dtype=np.int64)
        self.log = np.zeros(longest + 2, dtype=np.int64)
        for i in range(2, longest + 2):
            self.log[i] = self.log[i >> 1] + 1

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The largest impact of each list between places a and b of the layout; 0 where there is none."""
        out = np.zeros(len(a), dtype=np.int64)
        some = np.flatnonzero(b > a)
        x, y = a[some], b[some]
        k = self.log[y - x]
        out[some] = np.maximum(self.flat[k, x], self.flat[k, y - (1 << k)])
        return out

    def search(self, query: list[tuple[str, int]], best: "Best", leaf: int = LEAF) -> None:
        """Best-first over document intervals; what scores goes to ``best``."""
        known = [(self.number[t], c) for t, c in query if t in self.number]
        if not known:
            return
        q, times = (np.array(x, dtype=np.int64) for x in zip(*known))
        a, b = self.start[q], self.start[q + 1]
        heap, ties = [], 0

        def push(lo, hi, a, b):
            nonlocal ties
            if lo >= hi:
                return
            tops = self.maxima(a, b) * times
            bound = int(tops.sum())
            if best.open_to(bound, int(self.doc_ids[lo])):
                ties += 1
                heapq.heappush(heap, (-bound, ties, lo, hi, a, b, tops))

        push(0, self.n, a, b)
        while heap:
            bound, _, lo, hi, a, b, tops = heapq.heappop(heap)
            if -bound < best.floor:
                return
            if not best.open_to(-bound, int(self.doc_ids[lo])):
                continue
            if hi - lo <= leaf:
                self._score(lo, hi, a, b, times, best)
                continue
            t = int(tops.argmax())                       # the document of the largest impact
            d = int(self.place[a[t] + int(self.flat[0, a[t]:b[t]].argmax())])
            at = np.searchsorted(self.key, q * (self.n + 1) + d)
            hit = (at < b) & (self.place[np.minimum(at, len(self.place) - 1)] == d)
            best.offer(int((self.flat[0, at[hit]] * times[hit]).sum()), int(self.doc_ids[d]))
            push(lo, d, a, at)
            push(d + 1, hi, at + hit, b)

    def _score(self, lo: int, hi: int, a: np.ndarray, b: np.ndarray, times: np.ndarray, best: "Best") -> None:
        n = b - a
        at = np.arange(int(n.sum())) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        score = np.zeros(hi - lo, dtype=np.int64)
        np.add.at(score, self.place[at] - lo, self.flat[0, at] * np.repeat(times, n))
        for d in np.flatnonzero(score >= max(best.floor, 1)):
            best.offer(int(score[d]), int(self.doc_ids[lo + d]))


class Best:
    """The ``size`` best (score, doc_id) of an item: highest score, then smallest doc_id."""

    def __init__(self, size: int = TOP):
        self.size, self.heap, self.floor = size, [], 1

    def open_to(self, bound: int, doc_id: int) -> bool:
        """Whether a document from ``doc_id`` up with at most this score could enter."""
        return bound > self.floor or bound == self.floor and (len(self.heap) < self.size or -doc_id > self.heap[0][1])

    def offer(self, score: int, doc_id: int) -> None:
        if score < 1:
            return
        if len(self.heap) < self.size:
            heapq.heappush(self.heap, (score, -doc_id))
        elif (score, -doc_id) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc_id))
        if len(self.heap) == self.size:
            self.floor = self.heap[0][0]


def _query_terms(items: DataFrame) -> DataFrame:
    """(key, item_id, term, times): the distinct terms of every item with their repeats; key tells rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            for key, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                count = Counter(terms_of(text))
                if count:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(count), pa.int64()), pa.array([item] * len(count), pa.int64()),
                         pa.array([t.decode("utf-8", "replace") for t in count], pa.string()), pa.array(list(count.values()), pa.int64())],
                        ["key", "item_id", "term", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("long").alias("item_id"),
                        F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, "key long, item_id long, term string, times long"), "search-queries")


def _batches(queries: DataFrame, batch_items: int, batch_terms: int) -> DataFrame:
    """(key, part): items in order, a new part after so many items or terms (one item may go beyond)."""
    per = queries.groupBy("key").agg(F.count(F.lit(1)).alias("terms"))
    placed = running_sums(per, ["key"], ["terms"])
    part = F.concat_ws("-", F.floor((F.col("index") - 1) / batch_items), F.floor(F.col("terms_before") / batch_terms))
    return placed.select("key", part.alias("part"))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS,
           leaf: int = LEAF, batch_items: int = BATCH_ITEMS, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of every item."""
    index = build_index(docs, block_docs, block_terms)
    queries = _query_terms(items)
    spark = docs.sparkSession
    total = index.where(F.col("term").isNull()).agg(F.sum("n_docs").alias("N"), F.sum("n_terms").alias("L"), F.count(F.lit(1)).alias("b")).first()
    n_docs, n_terms, n_blocks = int(total["N"] or 0), int(total["L"] or 0), int(total["b"] or 0)
    # df of the query terms only: the lists of other terms are not looked at
    asked = queries.select("term").distinct()
    df = index.select("term", "df").where("df > 0").groupBy("term").agg(F.sum("df").alias("n")).join(asked, "term")
    df = materialize(df, "search-df")
    parts = materialize(_batches(queries, batch_items, batch_terms), "search-batches")
    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(n_blocks, max(4 * cores, n_blocks // 16)))
    found = spark.createDataFrame([], HITS)
    for (part,) in parts.select("part").distinct().collect():    # as many as the bounds need
        mine = queries.join(parts.where(F.col("part") == part), "key")
        rows = mine.join(df, "term").select("key", "item_id", "term", "times", "n").orderBy("key", "term").collect()
        weight = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["n"] + 1))) for r in rows}
        asks: dict[tuple, list] = {}
        for r in rows:
            if weight[r["term"]]:
                asks.setdefault((r["key"], r["item_id"]), []).append((r["term"], r["times"]))
        hits = _search_batch(index, weight, asks, n_docs, n_terms, tasks, top, leaf)
        found = found.unionByName(hits)
    found = materialize(found, "search-hits")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "task")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def _search_batch(index: DataFrame, weight: dict, asks: dict, n_docs: int, n_terms: int, tasks: int, top: int, leaf: int) -> DataFrame:
    """key, item_id, doc_id, score, task: what each task found for each item of a batch."""
    spark = index.sparkSession
    used = sorted(t for t, w in weight.items() if w)
    words = spark.createDataFrame([(t,) for t in used], "term string")
    lists = index.where("df > 0").join(F.broadcast(words), "term", "left_semi")    # at most a batch's terms
    rows = (lists.unionByName(index.where(F.col("term").isNull())).select("block", "term", "places", "tfs", "nulls")
            .repartition(tasks, "block").sortWithinPartitions("block", F.col("term").asc_nulls_first()))

    def blocks(batches):
        block, docs, lists = None, None, []
        for batch in batches:
            ids, terms = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            places, tfs, nulls = batch.column(2), batch.column(3), batch.column(4)
            for i, b in enumerate(ids):
                if b != block:
                    if docs is not None:
                        yield docs, lists
                    block, docs, lists = b, None, []
                raw, tf = places[i].as_buffer(), tfs[i].as_buffer()
                if terms[i] is None:
                    m = length_part(np.frombuffer(tf, "<i8"), n_docs, n_terms)
                    docs = np.frombuffer(raw, "<i8").copy(), np.frombuffer(nulls[i].as_buffer(), np.uint8).copy()
                else:
                    at = np.frombuffer(raw, "<i4").astype(np.int64)
                    lists.append((terms[i], at, impacts(np.frombuffer(tf, "<i4").astype(np.int64), m[at], weight[terms[i]])))
        if docs is not None:
            yield docs, lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, bests = TaskContext.get().partitionId(), {k: Best(top) for k in asks}
        missing: set[int] = set()
        for (ids, null), lists in blocks(batches):
            table = BlockTables(ids, lists)
            if null.any():
                missing.add(NO_ID)
            for key, query in asks.items():
                table.search(query, bests[key], leaf)
        out = [(k, item, None if -d == NO_ID and missing else -d, s, task) for (k, item), best in bests.items() for s, d in best.heap]
        if out:
            kinds = [pa.int64()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "item_id", "doc_id", "score", "task"])

    return rows.mapInArrow(run, HITS)
