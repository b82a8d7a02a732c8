"""Exact, reproducible stratified train / validation / test split.

Within each class, rows are ordered by ``md5(seed | id)`` (then id) and cut at
fixed per-class counts, so the class ratio is the same in every split up to one
row, and the same seed always gives the same split in any engine. The per-class
order is a ``hash_rank``: digest-prefix buckets ranked in parallel plus bucket
offsets, never a one-task window per class and no global sort.

Per class with ``n_c`` rows: ``train_c = floor(n_c * train_ratio)``, the rest is
split ``test_c = ceil(rest_c * test / (val + test))``, ``val_c = rest_c - test_c``
(exact decimal arithmetic).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.operators.rank import hash_rank
from keepwise.schema import ID_COL, TARGET_COL


def _dec(x: float) -> Decimal:
    return Decimal(repr(float(x)))


def split_cuts(train_ratio: float, val_ratio: float, test_ratio: float) -> tuple[Decimal, Decimal]:
    shares = [_dec(r) for r in (train_ratio, val_ratio, test_ratio)]
    if sum(shares) != 1 or min(shares) < 0:
        raise ValueError(f"the shares of the three splits have to add up to one: {shares}")
    return _dec(train_ratio), _dec(test_ratio / (val_ratio + test_ratio))


def stratified_split(df: DataFrame, target: str = TARGET_COL,
                     train_ratio: float = fixed.SPLIT_RATIOS[0],
                     val_ratio: float = fixed.SPLIT_RATIOS[1],
                     test_ratio: float = fixed.SPLIT_RATIOS[2],
                     seed: int = fixed.SPLIT_SEED, id_col: str = ID_COL) -> DataFrame:
    """Add ``split`` in {'train', 'validation', 'test'} to every row."""
    tr, te = split_cuts(train_ratio, val_ratio, test_ratio)
    if target not in df.columns:
        raise ValueError(f"no column {target!r} to stratify by")
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    ranked = hash_rank(df.withColumn("_h", h), "_h", id_col, partition_by=[target], rank_col="_r", size_col="_nc")
    n_train = F.floor(F.col("_nc") * F.lit(tr))
    rest = F.col("_nc") - n_train
    n_test = F.ceil(rest * F.lit(te))
    n_val = rest - n_test
    split = (F.when(F.col("_r") <= n_train, F.lit("train"))
             .when(F.col("_r") <= n_train + n_val, F.lit("validation"))
             .otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("_h", "_r", "_nc")


def split_distribution(split_df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """Per split and class: ``n`` and ``pct`` of the split (2 dp, half-even)."""
    counts = split_df.groupBy("split", target).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("split").agg(F.sum("n").alias("_tot"))
    return (counts.join(F.broadcast(totals), "split")   # at most 3 rows
            .select("split", F.col(target).alias("label"), F.col("n").cast("bigint"),
                    F.bround(F.lit(100.0) * F.col("n") / F.col("_tot"), 2).alias("pct")))


def class_weights(train: DataFrame, target: str = TARGET_COL) -> DataFrame:
    """Balanced weights ``n / (n_classes * n_c)`` per class present."""
    counts = train.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n, k = int(tot["n"] or 0), int(tot["k"] or 0)
    return counts.select(F.col(target).cast("int").alias("label"), F.col("n_c").cast("bigint").alias("n"),
                         (F.lit(float(n)) / (F.lit(float(k)) * F.col("n_c"))).alias("weight"))
