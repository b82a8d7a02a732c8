"""Conversation structure repair.

Rows are damaged by a fixed rule, judged, and each conversation gets the cheapest edits that give it a legal
sequence of roles (``conversation_edits``: iterative-deepening A*).

Conversations of at most ``LONG`` rows are dealt by their id and searched whole, one after the other in sorted
order. A longer one is never gathered: its rows are numbered by a range-partitioned sort, repeats are found by
an aggregation over (conversation, role and text), and it is cut into stretches of ``CHUNK`` rows, each searched
in a task of its own from every state to every state. A stretch ends with the edit of its last row, so that no
sequence of edits is the beginning of another one and ASCII order goes stretch by stretch. The tables of the
stretches (a few numbers each) are combined in order; then the stretches write their lines in parallel, and only
the checksum of the repaired text, which SHA-256 defines in sequence, reads them one by one as a stream.

Rows of a conversation stand by turn (nulls first), then role, then text; equal rows are interchangeable.

Edge cases: a null conv_id is a conversation of its own; null role or text is one space (a blank text; a role that
has to be rewritten); roles count by their first character, an empty role has none and can't stay; a conversation
whose rows are all dropped gives zeros, an empty audit and the checksum of the empty string; gaps beyond 64 bits
stop at the largest long; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.llm import conversation_edits as E
from keepwise.llm.common import ASCII_SPACE, materialize, small_batches
from keepwise.operators.rank import running_sums

LONG, CHUNK = 4096, 1024
DAMAGE = 20
#: what stands for a null in the hashed key, the role and the text
NULL = " "
MOST = (1 << 63) - 1
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows after damage; dropped ones stay as ``gone`` markers."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    kind = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")) % DAMAGE
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(name("role"))
    gone = kind == 0
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(~gone, role).otherwise("").alias("role"),
                                F.when(~gone, text).otherwise("").alias("text"), gone.alias("gone"),
                                F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return rows.drop("_copy")


def last_character(text: str) -> str:
    """The last character that is no ASCII space, '' for a blank text."""
    return text.rstrip(ASCII_SPACE)[-1:]


class Tally:
    """What is counted over rows in order; tallies of neighbouring stretches add up."""

    FIELDS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last"]

    def __init__(self, rows=0, blank=0, duplicate=0, truncated=0, illegal=0, turns=0, low=None, high=None, first="", last=""):
        self.rows, self.blank, self.duplicate, self.truncated, self.illegal = rows, blank, duplicate, truncated, illegal
        self.turns, self.low, self.high, self.first, self.last = turns, low, high, first, last

    @classmethod
    def of(cls, turn, initial: str, blank: bool, duplicate: bool, truncated: bool) -> "Tally":
        return cls(1, int(blank), int(duplicate), int(truncated), 0, int(turn is not None), turn, turn, initial, initial)

    def add(self, other: "Tally") -> None:
        if other.rows:
            if self.rows:
                self.illegal += self.last + other.first not in E.LEGAL_PAIRS
            else:
                self.first = other.first
            self.last = other.last
        for f in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, f, getattr(self, f) + getattr(other, f))
        self.turns += other.turns - int(self.high is not None and self.high == other.low)    # sorted by turn
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)

    def counts(self) -> list[int]:
        return [self.gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def faults_of(rows: Iterable[tuple], seen: set | None = None) -> Iterator[tuple[bool, bool, bool]]:
    """(blank, duplicate, truncated) of (role, text) rows: the first that holds."""
    seen = set() if seen is None else seen
    for role, text in rows:
        end = last_character(text)
        known = (role, text) in seen
        seen.add((role, text))
        yield not end, bool(end) and known, bool(end) and not known and end not in ".!?"


def repair(rows: list[tuple]) -> list:
    """The result's values for one conversation of (turn, role, text) in order."""
    tally, faults, initials = Tally(), [], []
    for (turn, role, _), (blank, duplicate, short) in zip(rows, faults_of((r, t) for _, r, t in rows)):
        tally.add(Tally.of(turn, role[:1], blank, duplicate, short))
        initials.append(role[:1])
        faults.append(E.REMOVE if blank or duplicate else E.CUT_SHORT if short else E.SOUND)
    cost, audit = E.Stretch(initials, faults).cheapest()
    lines = "\n".join(E.repaired_lines(audit, [(r, t) for _, r, t in rows]))
    return [*tally.counts(), cost, audit, hashlib.sha256(lines.encode("utf-8", "replace")).hexdigest()]


def _stream(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in small_batches(batches):
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _out(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _map_sorted(df: DataFrame, names: list[str], fn, schema: T.StructType) -> DataFrame:
    """``fn`` over the rows (tuples of ``names``) of every partition."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return df.select(*names).mapInArrow(lambda batches: _out(fn(_stream(batches, names)), arrow), schema)


def _schema(id_type: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", id_type), *T.StructType.fromDDL(rest).fields])


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations of bounded length, each searched in one go."""
    def run(stream):
        for conv, group in groupby(stream, key=lambda r: r[0]):
            yield (conv, *repair([(turn, role, text) for _, turn, role, text, gone in group if not gone]))

    names = ["conv_id", "turn", "role", "text", "gone"]
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    return _map_sorted(rows.repartition("conv_id").sortWithinPartitions(*order), names, run,
                       _schema(rows.schema["conv_id"].dataType, RESULT))


def _is(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _in_stretches(rows: DataFrame, chunk: int) -> DataFrame:
    """Conversations of any length, cut into stretches of ``chunk`` rows."""
    kind = rows.schema["conv_id"].dataType
    live = rows.where(~F.col("gone")).drop("gone").withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "_row"]
    numbered = running_sums(live, order, [])
    firsts = numbered.groupBy("conv_id").agg(F.min("index").alias("_from")).withColumnRenamed("conv_id", "_conv")
    end = F.substring(F.rtrim(F.col("text"), F.lit(ASCII_SPACE)), -1, 1)
    placed = materialize(
        numbered.join(firsts, _is("conv_id", "_conv"))
        .select("conv_id", "turn", "role", "text", (F.col("index") - F.col("_from")).alias("at"),
                F.floor((F.col("index") - F.col("_from")) / chunk).alias("chunk"), F.substring("role", 1, 1).alias("initial"),
                (end == "").alias("blank"), (~F.contains(F.lit(".!?"), end)).alias("short"),
                F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text")).alias("digest")), "conversation-rows")

    seen = (placed.groupBy("conv_id", "digest").agg(F.min("at").alias("_first"))
            .select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "_first"))
    judged = placed.select("conv_id", "chunk", "at", "turn", "initial", "blank", "short", "digest").join(
        seen, _is("conv_id", "_conv") & (F.col("digest") == F.col("_digest")))
    judged = judged.select("conv_id", "chunk", "at", "turn", "initial", "blank", (F.col("at") > F.col("_first")).alias("known"), "short")

    def tables(stream):
        for (conv, k), group in groupby(stream, key=lambda r: (r[0], r[1])):
            tally, initials, faults = Tally(), [], []
            for _, _, _, turn, initial, blank, known, short in group:
                duplicate = known and not blank
                short = short and not blank and not known
                tally.add(Tally.of(turn, initial, blank, duplicate, short))
                initials.append(initial)
                faults.append(E.REMOVE if blank or duplicate else E.CUT_SHORT if short else E.SOUND)
            stretch = E.Stretch(initials, faults)
            ways = [stretch.cheapest(a, b) for a in range(4) for b in range(4)]
            yield (conv, k, [w[0] if w else None for w in ways], [w[1] if w else None for w in ways],
                   *(getattr(tally, f) for f in Tally.FIELDS))

    names = ["conv_id", "chunk", "at", "turn", "initial", "blank", "known", "short"]
    stretches = materialize(_map_sorted(
        judged.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at"), names, tables,
        _schema(kind, "chunk long, costs array<long>, audits array<string>, rows long, blank long, duplicate long, truncated long, "
                      "illegal long, turns long, low long, high long, first string, last string")), "conversation-stretches")

    def combine(stream):
        for conv, group in groupby(stream, key=lambda r: r[0]):
            tally, now, back = Tally(), {E.START: (0, 0)}, []     # state -> (cost, place of its edits in ASCII order)
            for _, _, costs, audits, *counts in group:
                tally.add(Tally(*counts))
                best = {}
                for a, (cost, place) in now.items():
                    for b in range(4):
                        if costs[4 * a + b] is not None:
                            way = (cost + costs[4 * a + b], place, audits[4 * a + b], a)
                            if b not in best or way < best[b]:
                                best[b] = way
                order = sorted(best, key=lambda b: best[b][1:3])
                back.append({b: best[b][3] for b in best})
                now = {b: (best[b][0], order.index(b)) for b in best}
            tails = {E.START: "", E.SYSTEM: "II", E.USER: "I", E.ASSISTANT: ""}
            # a tail's "I" stands after edits that no other state's edits begin with: their places decide
            cost, _, state = min((c + E.INSERT * len(tails[s]), place, s) for s, (c, place) in now.items())
            last, rest = len(back) - 1, tails[state]
            yield (conv, None, None, None, *tally.counts(), cost)
            for k in range(last, -1, -1):
                entry = back[k][state]
                yield (conv, k, 4 * entry + state, rest if k == last else "", *[None] * 6)
                state = entry

    names = ["conv_id", "chunk", "costs", "audits", *Tally.FIELDS]
    chosen = materialize(_map_sorted(
        stretches.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"), names, combine,
        _schema(kind, "chunk long, way int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")),
        "conversation-ways")

    ways = chosen.where(F.col("chunk").isNotNull()).select("conv_id", "chunk", "way", "tail")
    edits = ways.join(stretches.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "audits"),
                      _is("conv_id", "_conv") & (F.col("chunk") == F.col("_chunk")))
    edits = edits.select(F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), (F.floor(F.col("way") / 4)).cast("int").alias("entry"),
                         F.concat(F.get("audits", F.col("way")), "tail").alias("edits"))
    texts = placed.select("conv_id", "chunk", "at", "role", "text").join(edits, _is("conv_id", "_conv") & (F.col("chunk") == F.col("_chunk")))

    def lines(stream):
        for (conv, k), group in groupby(stream, key=lambda r: (r[0], r[1])):
            group = list(group)
            out = list(E.repaired_lines(group[0][6], [(r[3], r[4]) for r in group], group[0][5]))
            yield conv, k, group[0][6], "\n".join(out), len(out)

    names = ["conv_id", "chunk", "at", "role", "text", "entry", "edits"]
    written = materialize(_map_sorted(
        texts.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "at"), names, lines,
        _schema(kind, "chunk long, edits string, body string, n long")), "conversation-lines")

    def checksum(stream):
        for conv, group in groupby(stream, key=lambda r: r[0]):
            digest, audit, some = hashlib.sha256(), [], False
            for _, _, edits, body, n in group:
                audit.append(edits)
                if n:
                    digest.update((b"\n" if some else b"") + body.encode("utf-8", "replace"))
                    some = True
            yield conv, "".join(audit), digest.hexdigest()

    sums = _map_sorted(written.repartition("conv_id").sortWithinPartitions("conv_id", "chunk"), ["conv_id", "chunk", "edits", "body", "n"],
                       checksum, _schema(kind, "audit string, repaired_sha256 string"))
    counts = chosen.where(F.col("chunk").isNull()).withColumnRenamed("conv_id", "_conv").drop("chunk", "way", "tail")
    return sums.join(counts, _is("conv_id", "_conv")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_conversations(conversations: DataFrame, long: int = LONG, chunk: int = CHUNK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation."""
    rows = damaged(conversations)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > long)
    lengthy = materialize(sizes.select(F.col("conv_id").alias("_conv")), "conversation-lengthy")
    if lengthy.isEmpty():
        return _whole(rows)
    same = _is("conv_id", "_conv")
    apart = materialize(rows.join(lengthy, same, "left_semi"), "conversation-apart")
    found = _in_stretches(apart, chunk)
    # a lengthy conversation of which every row is dropped has no stretch
    none = apart.groupBy("conv_id").agg(F.min("gone").alias("gone")).where("gone").select("conv_id")
    return (_whole(rows.join(lengthy, same, "left_anti")).unionByName(found)
            .unionByName(_whole(apart.join(none.withColumnRenamed("conv_id", "_conv"), same, "left_semi").dropDuplicates(["conv_id"]))))
