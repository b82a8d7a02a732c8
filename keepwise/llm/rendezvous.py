"""Sharding by rendezvous hashing.

Every pair of record key and shard gets a number drawn by hashing both (MD5, so
any engine can repeat it); a record goes to the shard with the highest weighted
draw ``weight / -ln(u)``. A shard receives its share of the weights, and a shard
more takes records only into itself: the draws of the others do not change. Key
and list of shards decide alone, whatever the other records are.

``write_shards`` writes whole records as Parquet, a folder per shard, in key order:
one range partitioning by (shard, key, text hash) spreads a large shard, and a key
that many records share, over as many tasks as its size needs. A record's slot is
its place in that order; it comes from the rows each task wrote per shard (one
row per task and shard touched, so its broadcast is bounded by tasks plus shards).

Edge cases: a null key is a key of its own (all its records go to one shard, as the
law demands, over many tasks); records with one key go together, ordered by a hash
of their text; a null text has size 1 and the checksum of the empty text; an empty
table writes nothing and reads back empty; extra columns travel along inside the
record and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: shard number -> weight
SHARDS = {k: 1.0 for k in range(8)}
ROWS_PER_FILE = 1_000_000
DRAW_BITS = 52


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) from key and shard."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"|{shard}"))
    digits = F.substring(F.md5(text), 1, DRAW_BITS // 4)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << DRAW_BITS)


def shard_of(key: Column, shards: dict[int, float] | None = None) -> Column:
    """The shard with the highest weighted draw (the smallest number among equals)."""
    shards = SHARDS if shards is None else shards
    if not shards or min(shards.values()) <= 0:
        raise ValueError("shards need a weight above zero")
    waits = [F.struct((-F.ln(draw(key, s)) / w).alias("wait"), F.lit(s).alias("shard")) for s, w in sorted(shards.items())]
    return F.array_min(F.array(*waits))["shard"]


def assign(docs: DataFrame, shards: dict[int, float] | None = None, key: str = "doc_id",
           grown_weight: float | None = None) -> DataFrame:
    """(doc, shard, grown_shard): whole records, their shard and where they are with one shard more."""
    shards = SHARDS if shards is None else shards
    extra = {max(shards) + 1: grown_weight if grown_weight is not None else sum(shards.values()) / len(shards)}
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    at = F.col(f"doc.`{key}`")
    return whole.select("doc", shard_of(at, shards).alias("shard"), shard_of(at, {**shards, **extra}).alias("grown_shard"))


def write_shards(docs: DataFrame, folder: str, shards: dict[int, float] | None = None, key: str = "doc_id",
                 rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``folder``/shard=<k>/ and return what was written: doc, shard, grown_shard, slot."""
    order = ["shard", F.col(f"doc.`{key}`").asc_nulls_first(), "_text", "_row"]
    rows = assign(docs, shards, key).withColumn("_text", F.xxhash64(F.col("doc.text").cast("string"))) \
        .withColumn("_row", F.xxhash64(F.monotonically_increasing_id()))    # parts rows that are alike in all else
    placed = (rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_text", "_row")
              .withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))
    placed.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(folder)
    kept = [f for f in placed.schema.fields if f.name != "shard"]
    written = docs.sparkSession.read.schema(type(placed.schema)([*kept, placed.schema["shard"]])).parquet(folder)
    return _with_slots(written)


def _with_slots(written: DataFrame) -> DataFrame:
    per = written.groupBy("shard", "task").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("shard", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return (written.join(F.broadcast(base), ["shard", "task"])      # a row per task and shard it wrote
            .select("doc", "shard", "grown_shard", (F.col("place") + F.col("base")).alias("slot")))


def sharded(docs: DataFrame, folder: str, shards: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every record, read back from its shard."""
    back = write_shards(docs, folder, shards)
    text = F.encode(F.coalesce(F.col("doc.text").cast("string"), F.lit("")), "UTF-8")
    return back.select(F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
