"""Descriptive tables behind the dashboard: KPIs, filters, distributions.

Medians and quartiles are exact (``exact_quantiles``: sorted ranks, no group of
values gathered in one task); modes and option lists are grouped counts with
map-side combine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.functions.scoring import label_name
from keepwise.operators.encode import numbered_within
from keepwise.operators.rank import exact_quantiles
from keepwise.schema import CATEGORICAL_FEATURES, TARGET_COL

MONEY = "decimal(28,10)"   # exact sums that do not depend on the order


def hero_kpis(clean: DataFrame) -> DataFrame:
    """Churn rate in percent, mean monthly charge, monthly revenue at risk
    (charges of churned customers) and the row count."""
    y = F.col(TARGET_COL).cast("bigint")
    money = F.col("MonthlyCharges").cast(MONEY)
    agg = clean.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("c"), F.sum(money).alias("m"),
                    F.count("MonthlyCharges").alias("nm"),
                    F.sum(F.when(y == 1, money)).alias("r"))
    return agg.select(
        F.when(F.col("n") > 0, F.lit(100.0) * F.col("c").cast("double") / F.col("n")).alias("churn_pct"),
        F.when(F.col("nm") > 0, F.col("m").cast("double") / F.col("nm")).alias("avg_monthly_charge"),
        F.coalesce(F.col("r"), F.lit(0)).cast("double").alias("revenue_at_risk"),
        F.col("n").cast("bigint").alias("n_customers"))


def with_label(clean: DataFrame, labels: dict | None = None) -> DataFrame:
    return clean.withColumn("ChurnLabel", label_name(F.col(TARGET_COL), labels))


def filter_segments(df: DataFrame, contracts: list[str] | None = None,
                    payments: list[str] | None = None) -> DataFrame:
    """``Contract IN (...) AND PaymentMethod IN (...)``; an empty or missing list
    means no filter on that column (pushed down when ``df`` is a scan)."""
    if contracts:
        df = df.filter(F.col("Contract").isin(list(contracts)))
    if payments:
        df = df.filter(F.col("PaymentMethod").isin(list(payments)))
    return df


def filtered_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


def churn_counts(labelled: DataFrame) -> DataFrame:
    """Rows per label, sorted by label."""
    return (labelled.groupBy("ChurnLabel").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy("ChurnLabel"))


def _long_numeric(df: DataFrame, columns, keep: list[str]) -> DataFrame:
    cols = list(columns)
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        keep, cols, "column", "value")


def box_stats(labelled: DataFrame, columns=("tenure", "MonthlyCharges"), by: str = "ChurnLabel") -> DataFrame:
    """Per label and column: min, q1, median, q3, max (linear interpolation);
    all columns in one quantile pass over the unpivoted values."""
    long = _long_numeric(labelled, columns, [by])
    return exact_quantiles(long, "value", [0.0, 0.25, 0.5, 0.75, 1.0], group_by=[by, "column"],
                           names=["min", "q1", "median", "q3", "max"])


SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """By how much the rank of a sketched quantile may be off, as a share of the rows (99 % confidence):
    the published error of KLL sketches for single quantiles."""
    return 2.296 / k**0.9723


def quantile_sketch(df: DataFrame, value: str, group_by: list[str], k: int = SKETCH_K) -> DataFrame:
    """``(*group_by, sketch)``: a KLL sketch per group, a few kilobytes whatever the number of rows.

    The declared approximate operator beside ``exact_quantiles``; neither stands in for the other.
    NULL and NaN are left out. Sketches of batches merge into that of all (``merge_sketches``)."""
    v = F.col(value).cast("double")
    return (df.select(*group_by, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
            .groupBy(*group_by).agg(F.kll_sketch_agg_double("_v", k).alias("sketch")))


def merge_sketches(sketches: DataFrame, group_by: list[str], k: int = SKETCH_K) -> DataFrame:
    """One sketch per group from those of several batches."""
    return sketches.groupBy(*group_by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: list[float], group_by: list[str]) -> DataFrame:
    """``(*group_by, n, prob, value)`` of every sketch."""
    at = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias("value")) for p in probs])
    return sketches.select(*group_by, F.kll_sketch_get_n_double("sketch").alias("n"), F.explode(at).alias("q")).select(*group_by, "n", "q.*")


def box_sketch(labelled: DataFrame, columns=("tenure", "MonthlyCharges"), by: str = "ChurnLabel", k: int = SKETCH_K) -> DataFrame:
    """The sketches behind sketched box statistics: per label and column."""
    return quantile_sketch(_long_numeric(labelled, columns, [by]), "value", [by, "column"], k)


def sketch_ranks(labelled: DataFrame, quantiles: DataFrame, by: str = "ChurnLabel") -> DataFrame:
    """``quantiles`` with ``off``: how far the asked rank lies outside the ranks its value has, as a share of
    the rows. Counted in one pass: the few quantiles of a group are an array beside its rows."""
    asked = quantiles.groupBy(by, "column").agg(F.collect_list(F.struct("prob", "value")).alias("_q"))      # as many as were asked for
    columns = [r["column"] for r in quantiles.select("column").distinct().collect()]
    rows = _long_numeric(labelled, columns, [by]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    met = rows.join(F.broadcast(asked), [by, "column"]).select(by, "column", "value", F.explode("_q").alias("q"))
    ranks = met.groupBy(by, "column", "q").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < F.col("q.value")).alias("low"),
                                               F.count_if(F.col("value") <= F.col("q.value")).alias("high"))
    want = F.col("q.prob")
    off = F.greatest(F.col("low") / F.col("n") - want, want - F.col("high") / F.col("n"), F.lit(0.0))
    return ranks.select(by, "column", F.col("q.prob").alias("prob"), F.col("q.value").alias("value"), "n", off.alias("off"))


def column_profile(clean: DataFrame, columns=("tenure", "MonthlyCharges", "TotalCharges"),
                   lower_bounds: dict | None = None) -> DataFrame:
    """Per column: min, max, median (the form pins the TotalCharges minimum at 0);
    min and max are the 0 and 1 quantiles of the same single pass."""
    lower_bounds = {"TotalCharges": 0.0} if lower_bounds is None else lower_bounds
    q = exact_quantiles(_long_numeric(clean, columns, []), "value", [0.0, 1.0, 0.5], group_by=["column"],
                        names=["min", "max", "median"])
    lo = F.col("min")
    for c, v in lower_bounds.items():
        lo = F.when(F.col("column") == c, F.lit(float(v))).otherwise(lo)
    return q.select("column", "min", lo.alias("slider_min"), "max", "median")


def _long_values(df: DataFrame, columns) -> DataFrame:
    cols = list(columns)
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")


def column_mode(clean: DataFrame, columns=tuple(CATEGORICAL_FEATURES)) -> DataFrame:
    """Most frequent non-NULL value per column; ties go to the smallest value."""
    counts = (_long_values(clean, columns).filter(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("value").alias("value")))
    return counts.groupBy("column").agg(best.alias("b")).select(
        "column", F.col("b.value").alias("mode"), (-F.col("b.neg_n")).cast("bigint").alias("n"))


def distinct_options(clean: DataFrame, columns=tuple(CATEGORICAL_FEATURES)) -> DataFrame:
    """Sorted distinct non-NULL values per column with their position."""
    vals = _long_values(clean, columns).filter(F.col("value").isNotNull()).distinct()
    return numbered_within(vals, "column", "value", "position", first=1)


def global_median(df: DataFrame, column: str) -> float | None:
    """The exact median as a driver scalar (one small result row)."""
    r = exact_quantiles(df, column, [0.5], names=["median"]).first()
    return None if r is None else r["median"]
