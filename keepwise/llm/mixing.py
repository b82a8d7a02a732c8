"""Mixing sources to target weights by blocks.

A source's documents, in order of doc_id, are one run of words, packed into blocks
of ``block`` words. Targets come from weights, a total share of all words and a cap
per source (what is cut off is shared again by weight). A source gets as many block
slots as its target needs; how many of them fall into each output shard is drawn
from a multinomial distribution over the shards. Slot j of a source with n blocks is
block ``permutation[j // n](j % n)``: every pass over a source goes through its own
pseudorandom permutation (a Feistel network with cycle walking), so no block is
used twice before all were used once. Blocks and documents meet in an equi-join on
(source, block).

Only word counts travel: positions inside a source are prefix sums over a range
partitioning on (source, doc_id), one total per partition and source, so a source
with a third of all rows is spread over many tasks. Results do not depend on the
partitioning (but for which of several rows alike in id, text and source is which), and reruns agree.

Edge cases: null or empty text has size 0 and is never taken; a null source is a
source of its own, the last one; repeated rows are separate documents; a source
without words has target 0; an empty table gives an empty result; extra columns
are not read by ``mix_documents`` and are kept by ``mixed_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.llm.common import let, map_columns, materialize, words
from keepwise.llm.shingles import mix
from keepwise.llm.sieve import Sieve

BLOCK, SHARD_SLOTS, SEED = 64, 4096, 20_24
#: shards drawn together, and slots that a task fills
RANGE, TASK_SLOTS = 64, 250_000
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def document_sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row (a number of its own, or the column named), doc_id, key (hash of the text), source, size in words."""
    text, number = F.col("text").cast("string"), F.col(row) if row else F.monotonically_increasing_id()
    return docs.select(number.alias("row"), F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"),
                       F.col("source").cast("string"), F.size(words(text)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """One row per source: sid, source, source_size, target, n_blocks, n_slots.

    Sources are capped in order of cap / weight: one is capped if an even deal of
    what is left, to it and all after it, would pass its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = (per.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
           .withColumn("w", F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")))
           .withColumn("limit", F.col("source_size") * cap).withColumn("r", F.col("limit") / F.col("w")))
    up = Window.orderBy("r", "sid")
    total = F.sum("source_size").over(Window.partitionBy(F.lit(0))) * share
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    per = (per.withColumn("left", total - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
           .withColumn("capped", F.col("left") > F.col("r") * F.sum("w").over(after)))
    whole = Window.partitionBy(F.lit(0))
    level = ((total - F.coalesce(F.sum(F.when(F.col("capped"), F.col("limit"))).over(whole), F.lit(0.0)))
             / F.sum(F.when(~F.col("capped"), F.col("w"))).over(whole))
    target = F.when(F.col("capped"), F.col("limit")).otherwise(F.least(F.coalesce(level * F.col("w"), F.lit(0.0)), F.col("limit")))
    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.when(n_blocks > 0, F.round(target * n_blocks / F.col("source_size"))).otherwise(0).cast("long")
    return per.select("sid", "source", "source_size", target.alias("target"), n_blocks.alias("n_blocks"), slots.alias("n_slots"))


def positions(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """row, sid, doc_id, key, size, start: every document's place in its source."""
    placed = sizes.join(plan.select("sid", F.col("source").alias("s")), F.col("source").eqNullSafe(F.col("s")))

    def run(frames: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        part, last, used = TaskContext.get().partitionId(), None, 0
        for rows in frames:
            sid, size = rows["sid"], rows["size"]
            before = np.cumsum(size) - size
            new = np.concatenate([[sid[0] != last], sid[1:] != sid[:-1]])     # rows are sorted by source
            start = np.where(new, before, 0)
            local = before - np.maximum.accumulate(start)
            first = np.cumsum(new) == 0                                       # still the source of the batch before
            local[first] += used
            yield {**rows, "part": np.full(len(sid), part, dtype=np.int32), "local": local}
            last, used = sid[-1], int(local[-1] + size[-1])

    order = ["sid", "doc_id", "key", "row"]     # the row last: it parts rows that agree in all else
    ordered = placed.select(*order, "size").repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(map_columns(ordered, run, "row long, sid long, doc_id long, key long, size long, part int, local long"),
                        "mix-local")
    totals = local.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(totals.select("sid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "mix-bases")
    return local.join(base, ["sid", "part"]).select("row", "sid", "doc_id", "key", "size", (F.col("base") + F.col("local")).alias("start"))


def permuted(pos: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of pos under the pseudorandom permutation of range(n) named by key, elementwise."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x, half, mask, key):
        a, b = x >> half, x & mask
        for k in range(4):
            a, b = b, a ^ (mix(b + mix(key + np.uint64(k + 1))) & mask)
        return (a << half) | b

    x, size = pos.astype(np.uint64), n.astype(np.uint64)
    walk = np.arange(len(x))
    while len(walk):
        x[walk] = once(x[walk], half[walk], mask[walk], key[walk])
        walk = walk[x[walk] >= size[walk]]
    return x.astype(np.int64)


def _range_counts(seed: int, sid: int, slots: int, n_shards: int, at: int) -> tuple[int, np.ndarray]:
    """Slots of a source before a range of ``RANGE`` shards and in each shard of it.

    The multinomial draw over all shards by halving: each half of a range gets a binomial share of
    its slots, from a generator seeded by source and range. Any range is reached from the top in a
    logarithm of steps, alike in every task, so no task draws for all shards."""
    lo, hi, before = 0, n_shards, 0
    while hi - lo > RANGE:
        mid = lo + RANGE * (-(-(hi - lo) // RANGE) // 2)
        left = int(np.random.default_rng([seed, sid, lo, hi]).binomial(slots, (mid - lo) / (hi - lo)))
        if at < mid:
            hi, slots = mid, left
        else:
            lo, slots, before = mid, slots - left, before + left
    return before, np.random.default_rng([seed, sid, lo, hi]).multinomial(slots, np.full(hi - lo, 1 / (hi - lo)))


def drawn_slots(plan: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """shard, sid, slot, turn, block: what every slot of the mix holds. Written once: its size is known only then."""
    total = int(plan.agg(F.sum("n_slots")).first()[0] or 0)
    n_shards = max(1, -(-total // shard_slots))

    def fill(frames):
        for rows in frames:
            for sid, n, slots, at in zip(*(np.asarray(rows[c]).tolist() for c in ("sid", "n_blocks", "n_slots", "range"))):
                before, counts = _range_counts(seed, sid, slots, n_shards, at)
                slot = before + np.arange(counts.sum())
                turn = slot // n
                key = mix(np.uint64(sid) * np.uint64(1_000_003) + turn.astype(np.uint64) + np.uint64(seed))
                size = np.full(len(slot), n)
                yield {"shard": np.repeat(at + np.arange(len(counts)), counts), "sid": np.full(len(slot), sid), "slot": slot, "turn": turn,
                       "block": permuted(slot - turn * n, size, key)}

    ranges = (plan.select("sid", "n_blocks", "n_slots").where("n_slots > 0")
              .withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1), F.lit(RANGE)))))
    tasks = max(1, -(-total // TASK_SLOTS))
    return materialize(map_columns(ranges.repartition(tasks, "sid", "range"), fill, "shard long, sid long, slot long, turn long, block long", 64),
                       "mix-slots")


def pieces(placed: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """shard, slot, turn and the words [word_from, word_to) of each document in that slot's block."""
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    return (parts.join(slots, ["sid", "block"])
            .select("row", "sid", "doc_id", "key", "shard", "slot", "turn",
                    F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("word_from"),
                    F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("word_to")))


def _prepared(sizes: DataFrame, block: int, seed: int, targets: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    plan = materialize(source_targets(sizes, block=block, **targets), "mix-plan")
    return plan, materialize(positions(sizes, plan), "mix-places"), drawn_slots(plan, seed=seed)


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED, **targets) -> DataFrame:
    """Per document: doc_id, size, source_size, target and the words the mix takes of it."""
    plan, placed, slots = _prepared(materialize(document_sizes(docs), "mix-sizes"), block, seed, targets)
    # how often each block is used: all the join needs to know about the slots
    used = materialize(slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times")), "mix-used")
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    overlap = (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
               - F.greatest(F.col("start"), F.col("block") * block))
    taken = (parts.join(used, ["sid", "block"]).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken")))
    return (placed.join(taken, "row", "left").join(plan.select("sid", "source_size", "target"), "sid")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_rows(docs: DataFrame, block: int = BLOCK, seed: int = SEED, **targets) -> DataFrame:
    """The mix as documents: one row per document and pass that takes words of it,
    with the columns of ``docs``; ``text`` holds the words taken (the text as it
    was where all are), ``n_chars`` their length.

    Texts and runs meet by id, hash of the text and a row number, so the texts are shuffled
    once. The number is 0 where id and text name a single row; rows that a sieve of the repeated
    ones holds back are written once with numbers, and no repeated row makes a hot key."""
    names = ["doc_id", "key"]
    sizes = materialize(document_sizes(docs), "mix-sizes")
    repeated = Sieve(materialize(sizes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "mix-repeated"), names)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    marked = repeated.marked(rows, names, "many")
    many = materialize(marked.where("many").withColumn("row", F.monotonically_increasing_id() + 1).drop("many"), "mix-rows")
    whole = marked.where("NOT many").drop("many").withColumn("row", F.lit(0).cast("long")).unionByName(many)
    numbered = document_sizes(many.select("row", "doc_id", F.col("doc.text").alias("text"), F.col("doc.source").alias("source")), "row")
    single = repeated.marked(sizes, names, "many").where("NOT many").drop("many").withColumn("row", F.lit(0).cast("long"))
    _, placed, slots = _prepared(materialize(single.unionByName(numbered), "mix-numbered"), block, seed, targets)
    runs = (pieces(placed, slots, block).groupBy(*names, "row", "turn")
            .agg(F.sort_array(F.collect_list(F.struct("word_from", "word_to"))).alias("runs"),   # at most words / block + 2
                 F.sum(F.col("word_to") - F.col("word_from")).alias("taken")))
    by = lambda x: [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("key").alias("_key"),
                    F.col("row").alias("_row"), *x]
    met = whole.select(by(["doc"])).join(runs.select(by(["turn", "runs", "taken"])).hint("merge"), ["_id", "_none", "_key", "_row"])
    cut = let(words(F.col("doc.text").cast("string")), lambda w: F.when(F.col("taken") < F.size(w), F.array_join(F.transform(
        "runs", lambda x: F.array_join(F.slice(w, x["word_from"].cast("int") + 1, (x["word_to"] - x["word_from"]).cast("int")), " ")), " ")))
    new = met.withColumn("new_text", F.coalesce(cut, F.col("doc.text").cast("string")))
    swap = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return new.select(*[swap.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
