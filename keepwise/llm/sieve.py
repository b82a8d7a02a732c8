"""Bit sieves: telling rows apart by their keys where they stand.

A table of verdicts and a table of texts meet in a join, which shuffles the texts as
soon as the verdicts are too many to broadcast. A sieve holds one bit per hash of a
wanted key, so it can be broadcast however many are wanted: a row whose bit is not set
has no wanted key for certain and stays where it is. A row whose bit is set most likely
has one; the exact join is left to those rows alone.

Nulls in a key are part of it; keys and wanted columns must agree in order and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import materialize

#: Most bits of a sieve: a broadcast of at most SIEVE / 8 bytes (very many wanted keys just leave little to sift).
SIEVE = 1 << 27
#: Bits per wanted key up to there: one row in so many is held back without need.
PER_KEY = 64


class Sieve:
    """The bits of the wanted keys (columns ``names`` of ``wanted``); without ``bits``, as many as their count asks for."""

    def __init__(self, wanted: DataFrame, names: list[str], bits: int | None = None):
        self.bits = bits or min(SIEVE, 1 << (PER_KEY * wanted.count()).bit_length())
        place = wanted.select(self._place(names).alias("h"))
        # dealt by bucket first: a task sends its hashes, not a bitmap of every bucket
        dealt = place.select(F.bitmap_bucket_number("h").alias("_bucket"), F.bitmap_bit_position("h").alias("_at")).repartition("_bucket")
        self.table = materialize(dealt.groupBy("_bucket").agg(F.bitmap_construct_agg("_at").alias("_bits")), "sieve")

    def _place(self, cols: list) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(self.bits))

    def marked(self, rows: DataFrame, keys: list, name: str) -> DataFrame:
        """``rows`` and a boolean column: false where ``keys`` are no wanted ones for certain."""
        at = F.bitmap_bit_position(self._place(keys))
        byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = rows.join(F.broadcast(self.table), F.bitmap_bucket_number(self._place(keys)) == F.col("_bucket"), "left")
        hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
        return met.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias(name))
