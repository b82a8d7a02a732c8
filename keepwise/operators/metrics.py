"""Ranking and classification metrics over ``(customerID, score, y)``.

Shapes used for scale:

* threshold metrics: one aggregate pass; the sweep assigns each row the number
  of thresholds it clears (an expression), aggregates 14 groups, then takes
  suffix sums - no cross join with the threshold list;
* AUC, ROC and sweep read one ordered histogram of unrounded scores, with running
  sums carried from range partition to range partition (one path at every size);
  histograms of batches merge into that of the whole;
* top-N, deciles: one aggregate of conditional sums over the global rank.

Ratios that are reported rounded use half-even rounding (``bround``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.functions.text import fill
from keepwise.operators.rank import running_sums, score_histogram
from keepwise.plans.materialize import materialize


def _safe_div(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def confusion_matrix(scores: DataFrame, threshold: float = fixed.DEFAULT_THRESHOLD,
                     score: str = "score", label: str = "y") -> DataFrame:
    """One row ``(tn, fp, fn, tp)``; actual in rows, predicted in columns."""
    pred = F.col(score) >= F.lit(float(threshold))
    y = F.col(label) == 1
    return scores.agg(F.count_if(~y & ~pred).alias("tn"), F.count_if(~y & pred).alias("fp"),
                      F.count_if(y & ~pred).alias("fn"), F.count_if(y & pred).alias("tp"))


def with_rates(counts: DataFrame, dp: int | None = None) -> DataFrame:
    """Precision, recall and F1 from ``tn, fp, fn, tp`` (0 on a zero denominator)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    cols = {"precision": _safe_div(tp, tp + fp), "recall": _safe_div(tp, tp + fn),
            "f1_score": _safe_div(2 * tp, 2 * tp + fp + fn)}
    for k, v in cols.items():
        counts = counts.withColumn(k, F.bround(v, dp) if dp is not None else v)
    return counts


def binary_metrics(scores: DataFrame, threshold: float = fixed.DEFAULT_THRESHOLD, **kw) -> DataFrame:
    """``threshold, precision, recall, f1_score, accuracy, tn, fp, fn, tp``."""
    cm = with_rates(confusion_matrix(scores, threshold, **kw))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return cm.select(F.lit(float(threshold)).alias("threshold"), "precision", "recall", "f1_score",
                     _safe_div(F.col("tn") + F.col("tp"), total).alias("accuracy"),
                     "tn", "fp", "fn", "tp")


HISTOGRAM = ["index", "pos", "neg", "pos_before", "neg_before", "pos_next", "neg_next"]
CHUNK = 100_000     # points numbered together


def ordered_histogram(scores: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """The table that AUC, ROC curve and threshold sweep all read, written once: per distinct
    score, highest first, ``pos`` and ``neg``, their sums over all higher scores (``_before``)
    and their values at the next lower one (``_next``). A table that is one already is taken as it is."""
    if set(HISTOGRAM) <= set(scores.columns):
        return scores
    return materialize(histogram_rows(scores, score, label), "histogram")


def histogram_rows(scores: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """The rows of :func:`ordered_histogram`, for a caller that keeps them in a place of its own."""
    return running_sums(score_histogram(scores, score, label), [F.col(score).desc()], ["pos", "neg"], ["pos", "neg"])


def merge_histograms(a: DataFrame, b: DataFrame, score: str = "score") -> DataFrame:
    """The ordered histogram of two batches together, from theirs: no score is read again."""
    both = a.select(score, "pos", "neg").unionByName(b.select(score, "pos", "neg")).groupBy(score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return materialize(running_sums(both, [F.col(score).desc()], ["pos", "neg"], ["pos", "neg"]), "histogram")


def roc_auc(scores: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Exact AUC with ties counted half: sum over distinct scores of
    ``neg * (pos above + pos/2)`` / (P * N). NULL when a class is absent; rows
    without a score are left out, as in every threshold metric. ``scores`` may be
    an ordered histogram."""
    h = ordered_histogram(scores, score, label)
    term = (F.col("neg").cast("decimal(38,0)")
            * (F.lit(2) * F.col("pos_before") + F.col("pos")).cast("decimal(38,0)"))
    agg = h.agg(F.sum(term).alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    den = F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")
    return agg.select(F.when(den > 0, F.col("num").cast("double") / den).alias("roc_auc"),
                      F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"))


def roc_curve(scores: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """``(point, fpr, tpr, threshold)``: cumulative rates at each distinct score,
    highest first; points on a straight segment are dropped (kept are both ends
    and every score whose counts differ from the next one's); ``(0, 0)`` is
    prepended with an infinite threshold. Exact and distributed at every size;
    ``scores`` may be an ordered histogram."""
    h = ordered_histogram(scores, score, label)
    totals = h.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    P, N = int(totals["P"] or 0), int(totals["N"] or 0)
    bend = (F.col("pos") != F.col("pos_next")) | (F.col("neg") != F.col("neg_next"))
    kept = h.filter((F.col("index") == 1) | F.col("pos_next").isNull() | bend).withColumn("_c", F.floor((F.col("index") - 1) / CHUNK))
    # the order is known: kept points are counted per stretch of the histogram and numbered inside it
    counts = kept.groupBy("_c").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_c").orderBy("index")
    rate = lambda c, n: (F.col(f"{c}_before") + F.col(c)) / F.lit(n) if n else F.lit(None).cast("double")
    body = (kept.withColumn("_at", F.row_number().over(inside)).join(base, "_c")
            .select((F.col("_base") + F.col("_at")).cast("int").alias("point"), rate("neg", N).alias("fpr"),
                    rate("pos", P).alias("tpr"), F.col(score).cast("double").alias("threshold")))
    origin = scores.sparkSession.range(1).select(F.lit(0).alias("point"), F.lit(0.0).alias("fpr"),
                                                 F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return origin.unionByName(body)


def threshold_sweep(scores: DataFrame, thresholds: list[float] | None = None,
                    score: str = "score", label: str = "y", dp: int = 4) -> DataFrame:
    """One row per threshold: ``threshold, precision, recall, f1_score`` (4 dp)
    and ``tn, fp, fn, tp, n_pred_pos``; every threshold in one pass over the rows, or
    over their ordered histogram."""
    ts = sorted(thresholds if thresholds is not None else fixed.sweep_thresholds())
    spark = scores.sparkSession
    cleared = sum((F.col(score) >= F.lit(float(t))).cast("int") for t in ts)
    pos, neg = ((F.col("pos"), F.col("neg")) if set(HISTOGRAM) <= set(scores.columns)
                else (F.col(label).cast("bigint"), 1 - F.col(label).cast("bigint")))
    per_k = scores.groupBy(cleared.alias("k")).agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))
    # all 0..len(ts) levels present, then suffix sums over at most 14 rows
    levels = spark.range(len(ts) + 1).select(F.col("id").cast("int").alias("k"))
    full = levels.join(per_k, "k", "left").fillna(0, ["pos", "neg"])
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(F.lit(1))
    s = (full.withColumn("tp", F.sum("pos").over(suffix)).withColumn("fp", F.sum("neg").over(suffix))
         .withColumn("P", F.sum("pos").over(tot)).withColumn("N", F.sum("neg").over(tot))
         .filter(F.col("k") >= 1))
    t_arr = F.array(*[F.lit(float(t)) for t in ts])
    s = s.select(F.element_at(t_arr, F.col("k")).alias("threshold"),
                 (F.col("N") - F.col("fp")).cast("bigint").alias("tn"), F.col("fp").cast("bigint").alias("fp"),
                 (F.col("P") - F.col("tp")).cast("bigint").alias("fn"), F.col("tp").cast("bigint").alias("tp"))
    s = with_rates(s, dp)
    return s.select("threshold", "precision", "recall", "f1_score", "tn", "fp", "fn", "tp",
                    (F.col("fp") + F.col("tp")).alias("n_pred_pos"))


def recommend_threshold(sweep: DataFrame, min_recall: float = fixed.MIN_RECALL) -> DataFrame:
    """Among rows with recall >= ``min_recall`` the best (f1, recall); if none,
    the best (recall, f1); first (lowest) threshold wins ties. One row with the
    written justification; an empty sweep gives 0.5 and a fixed sentence."""
    elig = F.col("recall") >= F.lit(float(min_recall))
    k1 = F.when(elig, F.col("f1_score")).otherwise(F.col("recall"))
    k2 = F.when(elig, F.col("recall")).otherwise(F.col("f1_score"))
    any_elig = F.max(elig.cast("int")).over(Window.partitionBy(F.lit(1)))
    ranked = (sweep.withColumn("eligible", elig).withColumn("_any", any_elig)
              .filter(F.col("eligible") | (F.col("_any") == 0))
              .orderBy(k1.desc(), k2.desc(), F.col("threshold").asc()).limit(1))
    four = lambda c: F.format_string("%.4f", F.col(c))
    values = {"recall_min": F.lit(f"{min_recall:.0%}"), "threshold": F.format_string("%.2f", F.col("threshold")),
              "f1": four("f1_score"), "recall": four("recall"), "precision": four("precision")}
    yes, no = fill(fixed.RECOMMEND_BEST, values), fill(fixed.RECOMMEND_NONE, values)
    rec = ranked.select("threshold", "precision", "recall", "f1_score", "eligible",
                        F.when(F.col("eligible"), yes).otherwise(no).alias("justification"))
    spark = sweep.sparkSession
    fallback = spark.range(1).select(
        F.lit(fixed.DEFAULT_THRESHOLD).alias("threshold"), F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"), F.lit(None).cast("double").alias("f1_score"),
        F.lit(False).alias("eligible"), F.lit(fixed.RECOMMEND_EMPTY).alias("justification"))
    has_rows = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    both = rec.withColumn("_pri", F.lit(0)).unionByName(fallback.withColumn("_pri", F.lit(1)))
    return (both.withColumn("_rows", F.sum(1 - F.col("_pri")).over(Window.partitionBy(F.lit(1))))
            .filter((F.col("_pri") == 0) | (F.col("_rows") == 0)).drop("_pri", "_rows")
            .withColumn("threshold_label", F.format_string("%.2f", F.col("threshold"))))


def _rank_totals(ranked: DataFrame, label: str = "y") -> tuple[int, int]:
    r = ranked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label)).alias("c")).first()
    return int(r["n"] or 0), int(r["c"] or 0)


def topn_k(n: int, pct: float) -> int:
    """Rows in the top ``pct`` percent: half-even rounding, at least one."""
    return max(1, int(round(n * pct / 100)))


def topn_capture(ranked: DataFrame, pcts: list[int] | None = None, rank: str = "rn",
                 label: str = "y") -> DataFrame:
    """Per ``top_pct``: churners among the top ``k`` ranked rows and their share
    of all churners (2 dp). Empty when there are no rows or no churners."""
    pcts = list(pcts or fixed.TOP_PCTS)
    n, churners = _rank_totals(ranked, label)
    schema = "top_pct INT, capture_pct DOUBLE, n_captured BIGINT"
    spark = ranked.sparkSession
    if n == 0 or churners == 0:
        return spark.createDataFrame([], schema)
    ks = {p: topn_k(n, p) for p in pcts}
    y = F.col(label).cast("bigint")
    row = ranked.agg(*[F.coalesce(F.sum(F.when(F.col(rank) <= k, y)), F.lit(0)).alias(f"c{p}")
                       for p, k in ks.items()])
    long = row.unpivot([], [f"c{p}" for p in pcts], "_k", "n_captured")
    return long.select(F.regexp_extract("_k", r"(\d+)", 1).cast("int").alias("top_pct"),
                       F.bround(F.lit(100.0) * F.col("n_captured") / F.lit(float(churners)), 2).alias("capture_pct"),
                       F.col("n_captured").cast("bigint"))


def decile_of(rank_col, n: int, n_deciles: int = fixed.N_DECILES):
    size = max(1, n // n_deciles)
    return F.least(F.lit(n_deciles), F.floor((rank_col - 1) / F.lit(size)).cast("int") + 1)


def decile_gain(ranked: DataFrame, rank: str = "rn", label: str = "y",
                n_deciles: int = fixed.N_DECILES) -> DataFrame:
    """Deciles of ``max(1, n div 10)`` rows, the last taking the remainder (not
    ``ntile``); churners per decile, their share and the cumulative share
    (2 dp). All deciles appear, even empty ones; empty without churners."""
    n, churners = _rank_totals(ranked, label)
    schema = ("decile INT, pct_contacted INT, churn_in_decile BIGINT, pct_churn_decile DOUBLE, "
              "cumulative_pct_churn DOUBLE")
    spark = ranked.sparkSession
    if n == 0 or churners == 0:
        return spark.createDataFrame([], schema)
    d = decile_of(F.col(rank), n, n_deciles)
    y = F.col(label).cast("bigint")
    aggs = []
    for j in range(1, n_deciles + 1):
        aggs.append(F.coalesce(F.sum(F.when(d == j, y)), F.lit(0)).alias(f"c{j}"))
        aggs.append(F.coalesce(F.sum(F.when(d <= j, y)), F.lit(0)).alias(f"cum{j}"))
    row = ranked.agg(*aggs)
    stack = F.explode(F.array(*[F.struct(F.lit(j).alias("decile"), F.col(f"c{j}").alias("c"),
                                          F.col(f"cum{j}").alias("cum")) for j in range(1, n_deciles + 1)]))
    long = row.select(stack.alias("s")).select("s.*")
    tot = F.lit(float(churners))
    return long.select(F.col("decile").cast("int"), (F.col("decile") * 10).cast("int").alias("pct_contacted"),
                       F.col("c").cast("bigint").alias("churn_in_decile"),
                       F.bround(F.lit(100.0) * F.col("c") / tot, 2).alias("pct_churn_decile"),
                       F.bround(F.lit(100.0) * F.col("cum") / tot, 2).alias("cumulative_pct_churn"))
