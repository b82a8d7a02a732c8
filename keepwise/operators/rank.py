"""Exact global order without a one-task window.

``row_number() over (order by ...)`` with no ``partition by`` moves every row to
a single task. ``global_rank`` instead

1. sorts with ``orderBy`` - a range-partitioned shuffle whose boundaries come
   from a sample; with a unique sort key (score, then id) no partition can hold
   more than its share even when one score value covers a third of the rows;
2. tags each row with its partition and its position inside the partition
   (``monotonically_increasing_id`` = partition << 33 | position);
3. writes that result to the shared checkpoint folder (``materialize``), so
   counts and rows come from the same materialised order and a lost executor
   re-reads instead of re-sorting;
4. adds the row counts of all earlier partitions: a table with one row per
   partition, so its broadcast is bounded by the partition count.

Grouped ranks subtract the group's first global rank. The sort key should be
unique (append an id): range partitions split between distinct keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwise.plans.materialize import materialize

def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def global_rank(df: DataFrame, order_by: list, partition_by: list[str] | None = None,
                rank_col: str = "rn", size_col: str | None = None) -> DataFrame:
    """Add a 1-based, gap-free ``rank_col`` in ``order_by`` order (optionally per
    ``partition_by`` group). Ties in ``order_by`` get distinct ranks in an
    arbitrary order, so pass a unique key for a reproducible result.
    ``size_col`` adds each group's row count."""
    partition_by = list(partition_by or [])
    keys = [F.col(c).asc() for c in partition_by] + [_as_col(c) for c in order_by]
    tagged = (df.orderBy(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(tagged, "rank")

    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # one row per sort partition: bounded by the shuffle partition count
    offsets = F.broadcast(offsets)

    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    ranked = (tagged.join(offsets, "_pid")
              .withColumn(rank_col, F.col("_off") + local + 1)
              .drop("_pid", "_mid", "_off"))
    if not partition_by and not size_col:
        return ranked

    if partition_by:
        starts = ranked.groupBy(*partition_by).agg(F.min(rank_col).alias("_g0"),
                                                   F.count(F.lit(1)).alias("_gn"))
        # one row per group; AQE broadcasts it when its measured size is small
        starts = starts.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(partition_by)], "_g0", "_gn")
        same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(partition_by)]
        out = ranked.join(starts, same).drop(*[f"_s{i}" for i in range(len(partition_by))]).withColumn(rank_col, F.col(rank_col) - F.col("_g0") + 1)
    else:
        # whole-table size: a scalar from the per-partition counts
        total = sizes.agg(F.sum("_n")).first()[0] or 0
        out = ranked.withColumn("_g0", F.lit(1)).withColumn("_gn", F.lit(int(total)).cast("bigint"))
    if size_col:
        out = out.withColumnRenamed("_gn", size_col)
    return out.drop("_g0", "_gn")


def score_histogram(scored: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """``(score, pos, neg)`` per distinct non-NULL score (at most one row per input row)."""
    y = F.col(label).cast("bigint")
    return (scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score)
            .agg(F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")))


def running_sums(df: DataFrame, order_by: list, sums: list[str], following: list[str] | None = None) -> DataFrame:
    """Add ``index`` (1-based place in ``order_by`` order) and, per column ``c`` of
    ``sums``, ``c_before`` (its sum over all earlier rows); per column ``c`` of
    ``following`` also ``c_next`` (its value in the next row, NULL in the last).

    One path at every size: a range-partitioned sort, written once; inside a
    partition a window, and from partition to partition the totals of a table with
    one row per partition. Pass a unique key.
    """
    following = list(following or [])
    tagged = materialize(df.orderBy(*[_as_col(c) for c in order_by]).withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()), "running")
    ones = F.count(F.lit(1)).alias("_n")
    per = tagged.groupBy("_pid").agg(ones, *[F.sum(c).alias(f"_s_{c}") for c in sums],
                                     F.min_by(F.struct(F.lit(0).alias("_0"), *following), "_mid").alias("_first"))
    parts = Window.orderBy("_pid")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("_pid", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
                         *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums],
                         F.lead("_first").over(parts).alias("_after"))
    inside = Window.partitionBy("_pid").orderBy("_mid")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (tagged.join(F.broadcast(offsets), "_pid")   # one row per sort partition
            .select(*df.columns, (F.col("_rows") + F.row_number().over(inside)).alias("index"),
                    *[(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(f"{c}_before") for c in sums],
                    *[F.when(F.lead("_mid").over(inside).isNotNull(), F.lead(c).over(inside))
                      .otherwise(F.col(f"_after.{c}")).alias(f"{c}_next") for c in following]))


def exact_quantiles(df: DataFrame, value: str, probs: list[float],
                    group_by: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Linear-interpolation quantiles, exact, per group.

    For a group of ``n`` sorted values ``v1..vn`` and probability ``q``:
    ``h = (n-1) q``, result ``v[floor h] + (v[ceil h] - v[floor h]) * (h - floor h)``
    (0-based positions). Equal values are counted first (map-side), so a column of
    few values stays small however often they repeat; the counts are summed up in
    value order and the rows that hold the needed positions are picked. NULL is a
    group like any other; NULL and NaN values are left out.
    """
    group_by = list(group_by or [])
    names = names or [f"q{i}" for i in range(len(probs))]
    hist = (df.select(*group_by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
            .groupBy(*group_by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    ordered = running_sums(hist, [*[F.col(g).asc() for g in group_by], F.col("_v").asc()], ["_c"])
    ordered = ordered.select(*group_by, "_v", "_c", F.col("_c_before").alias("_b"))
    spans = (ordered.groupBy(*group_by) if group_by else ordered.groupBy()).agg(F.min("_b").alias("_g0"), F.sum("_c").alias("_n"))
    if group_by:
        same = [F.col(f"_k{i}").eqNullSafe(F.col(g)) for i, g in enumerate(group_by)]
        spans = spans.select(*[F.col(g).alias(f"_k{i}") for i, g in enumerate(group_by)], "_g0", "_n")
        placed = ordered.join(spans, same)
    else:
        first = spans.first()
        placed = ordered.withColumn("_g0", F.lit(first["_g0"] or 0)).withColumn("_n", F.lit(first["_n"] or 0))
    start = F.col("_b") - F.col("_g0")
    aggs, needed = [], F.lit(False)
    for q, nm in zip(probs, names):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(q))
        for side, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            here = (start <= pos) & (pos < start + F.col("_c"))
            needed = needed | here
            aggs.append(F.max(F.when(here, F.col("_v"))).alias(f"{nm}__{side}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"{nm}__d"))
    picked = placed.filter(needed)
    agg = picked.groupBy(*group_by).agg(*aggs) if group_by else picked.agg(*aggs)
    lo, hi, d = (lambda nm, k=k: F.col(f"{nm}__{k}") for k in ("lo", "hi", "d"))
    return agg.select(*group_by, *[F.when(d(nm) == 0, lo(nm)).otherwise(lo(nm) + (hi(nm) - lo(nm)) * d(nm)).alias(nm) for nm in names])


MAX_COUNT_ROWS = 1_000_000   # bucket counts that every task may hold


def hash_rank(df: DataFrame, hash_col: str, id_col: str, partition_by: list[str] | None = None,
              rank_col: str = "rn", size_col: str | None = None, digits: int = 4,
              then: list[str] | None = None, bucket_rows: int = 1_000_000) -> DataFrame:
    """Exact rank by ``(hash_col, id_col, *then)`` when ``hash_col`` is a uniform hex
    digest (md5): no sort of the whole table.

    Rows are bucketed by the first ``digits`` hex characters (16**digits buckets
    per group, equally full where ids differ), ranked with ``row_number`` inside
    their bucket, and shifted by the rows of all earlier buckets (a count table).
    The order by bucket then digest equals the order by digest, so the rank is the
    same as a global ``row_number``. A bucket of more than ``bucket_rows`` rows (a
    very large table, or an id that very many rows share) is split by more digits
    and, where one digest alone is that frequent, by row position: rows of one
    digest are a tie, so any order of its parts is exact. NULL groups and NULL ids
    are ranked too (all joins are NULL-safe).

    The rows are ranked in their buckets before they meet the counts, which come from
    one window without a group: rows broadcast to that side would all be sorted by its
    one task.
    """
    partition_by = list(partition_by or [])
    keys = [*partition_by, "_b", "_part"]
    b = df.withColumn("_b", F.substring(F.col(hash_col), 1, digits)).withColumn("_part", F.lit(0))

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))

    def beside(rows: DataFrame, table: DataFrame, columns: list[str], how: str = "inner", small: bool = False) -> DataFrame:
        table = table.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], *columns)
        same = [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)]
        return rows.join(F.broadcast(table) if small else table.hint("merge"), same, how).drop(*[f"_o{i}" for i in range(len(keys))])

    counts = materialize(sizes(b), "hash-sizes")      # a row per bucket
    for step, length in enumerate((2 * digits, 32, None)):
        over = counts.where(F.col("_c") > bucket_rows)
        if over.isEmpty():
            break
        if step == 0:       # row positions have to stay the same from here on
            b = materialize(b.withColumn("_row", F.monotonically_increasing_id()), "hash-rank")
        # a row per bucket_rows rows at most
        b = beside(b, over, ["_c"], "left", small=True)
        full = F.col("_c").isNotNull()
        if length:
            b = b.withColumn("_b", F.when(full, F.substring(F.col(hash_col), 1, length)).otherwise(F.col("_b")))
        else:
            share = F.pmod(F.xxhash64("_row"), F.ceil(F.col("_c") / bucket_rows)).cast("int")
            b = b.withColumn("_part", F.when(full, share).otherwise(F.col("_part")))
        b = b.drop("_c")
        counts = materialize(sizes(b), "hash-sizes")

    before = Window.partitionBy(*partition_by).orderBy("_b", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                         F.sum("_c").over(Window.partitionBy(*partition_by)).alias("_gn"))
    within = Window.partitionBy(*keys).orderBy(F.col(hash_col).asc(), F.col(id_col).asc(), *[F.col(c).asc() for c in then or []])
    ranked = b.withColumn("_in", F.row_number().over(within))
    out = (beside(ranked, offs, ["_off", "_gn"], small=counts.count() <= MAX_COUNT_ROWS)
           .withColumn(rank_col, F.col("_off") + F.col("_in")))
    if size_col:
        out = out.withColumnRenamed("_gn", size_col)
    return out.drop("_b", "_part", "_row", "_in", "_off", "_gn")
