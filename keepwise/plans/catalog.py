"""Registered queries: one per operator of the inventory, each with the DuckDB
SQL that recomputes it (or none, for trained / randomised results).

Every query reads the parquet tables of a scale-factor folder and derives the
customer table from ``customer`` and ``orders``, so its work grows with them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.functions.text import fill_sql
from keepwise.functions.scoring import high_risk_flag, label_name, predict_label
from keepwise.operators import campaign, clean, metrics, profile, score, split
from keepwise.plans import oracle as O
from keepwise.plans.reuse import reuse_or_write
from keepwise.schema import FEATURES, ID_COL, TARGET_COL
from keepwise.session import scratch_path
from keepwise.sources import fixture, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


class Tables:
    """The derived tables one query needs, built from ``sf_dir``.

    The customer table is an aggregate of ``orders``; a query that makes
    several passes (fitting parameters, counting, then the result) must not
    re-scan ``orders`` for each, and neither should the next report. So
    ``clean``, ``split`` and the risk ranking are written once to the shared
    checkpoint folder and reused while every input file is unchanged
    (``plans.reuse``); every later pass reads those compact tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        base = sf_dir.rstrip("/")
        self.inputs = [f"{base}/customer.parquet", f"{base}/orders.parquet"]

    def _reuse(self, name: str, build) -> DataFrame:
        return reuse_or_write(self.spark, name, self.inputs, build)

    @cached_property
    def raw(self) -> DataFrame:
        return fixture.raw_customers(self.spark, self.sf_dir)

    @cached_property
    def file(self) -> DataFrame:
        """The customers as a CSV file with cells that need cleaning, through the reader."""
        cells = {c: F.when(F.col(ID_COL).endswith(d), F.lit(text)).otherwise(F.col(c)) for c, d, text, _ in O.DIRTY}
        path = scratch_path(self.spark, "customers_csv")
        (self.raw.withColumns(cells).write.option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
        return readers.scan_customers(self.spark, path)

    @cached_property
    def clean_lazy(self) -> DataFrame:
        """The cleaned table for one-pass reports, derived on the fly."""
        return clean.clean_customers(self.raw)

    @cached_property
    def split(self) -> DataFrame:
        """Cleaned customers with their split label, from the written cleaned table
        (the split counts rows and then labels them: two passes, neither over orders)."""
        return self._reuse("customers_split", lambda: split.stratified_split(self.clean))

    @cached_property
    def clean(self) -> DataFrame:
        """Cleaned customers, written: for reports that make several passes."""
        return self._reuse("customers_clean", lambda: clean.clean_customers(self.raw))

    @cached_property
    def test_scores(self) -> DataFrame:
        return score.scored_outcomes(self.split.filter(F.col("split") == "test"))

    @cached_property
    def histogram(self) -> DataFrame:
        """The ordered histogram of the test scores that area, curve and sweep read."""
        return self._reuse("test_histogram", lambda: metrics.histogram_rows(self.test_scores))

    @cached_property
    def ranked(self) -> DataFrame:
        return self._reuse("test_ranked_fixed", lambda: score.rank_by_risk(self.test_scores))

    @cached_property
    def preds(self) -> DataFrame:
        return score.predictions(self.clean_lazy)   # one pass; the rank materialises


# Report parameters used by the registered queries.
FILTER_CONTRACTS = ["Month-to-month", "One year"]
FILTER_PAYMENTS: list[str] = []   # empty selection = no filter
CAPACITIES = [None, 50, 300]       # None = the default rule min(100, max(1, n div 5))
SCENARIOS = [
    dict(fixed.DEFAULT_CAMPAIGN),
    {"pct_contacted": 0.0, "success_rate": 25.0, "cost_per_contact": 15.0, "avg_discount": 10.0},
    {"pct_contacted": 100.0, "success_rate": 40.0, "cost_per_contact": 5.0, "avg_discount": 30.0},
]


# ---------------------------------------------------------------------------
# 2.1 sources
# ---------------------------------------------------------------------------
@query("scan_customers", O.w(O.FILE, "SELECT * FROM file"))
def q_scan_customers(spark, sf):
    """Written as CSV (quotes, missing tokens, bad cells), read through the reader."""
    return Tables(spark, sf).file


@query("scan_quarantine", O.w(O.CLEAN, r"""SELECT 'record' AS part, customerID FROM clean WHERE customerID LIKE '%7'
UNION ALL SELECT 'row', customerID || CASE WHEN customerID LIKE '%3' THEN chr(10) || 'second line' ELSE '' END FROM clean WHERE customerID NOT LIKE '%7'"""))
def q_scan_quarantine(spark, sf):
    """A file whose records with ids on 7 have a cell too many and whose ids on 3 hold a quoted line break."""
    raw = Tables(spark, sf).raw
    cells = [F.when(F.col(ID_COL).endswith("3"), F.concat(F.lit('"'), ID_COL, F.lit('\nsecond line"'))).otherwise(F.col(ID_COL)),
             *[F.coalesce(F.concat(F.lit('"'), F.col(c), F.lit('"')), F.lit("")) for c in raw.columns if c != ID_COL]]
    line = F.concat(F.concat_ws(",", *cells), F.when(F.col(ID_COL).endswith("7"), F.lit(",")).otherwise(F.lit("")))
    path, aside = scratch_path(spark, "customers_wide"), scratch_path(spark, "quarantine")
    header = ",".join([ID_COL, *[c for c in raw.columns if c != ID_COL]])

    def with_header(batches):      # one file per task, each with its header line
        import pyarrow as pa

        for i, batch in enumerate(batches):
            if i == 0:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    raw.select(line.alias("value")).mapInArrow(with_header, "value STRING").write.text(path)
    good = readers.scan_customers(spark, path, quarantine=aside)
    bad = spark.read.parquet(aside).select(F.lit("record").alias("part"), F.split("record", ",")[0].alias(ID_COL))
    return bad.unionByName(good.select(F.lit("row").alias("part"), ID_COL))


@query("require_columns", O.w(O.FILE, "SELECT customerID FROM file"))
def q_require_columns(spark, sf):
    """The check passes on the file and names what a narrower table lacks."""
    df = Tables(spark, sf).file
    readers.require_columns(df, [ID_COL, TARGET_COL, *FEATURES])
    try:
        readers.require_columns(df.drop("tenure", "gender"), [ID_COL, *FEATURES])
    except ValueError as err:
        if "['gender', 'tenure']" in str(err):
            return df.select(ID_COL)
    raise AssertionError("absent columns were not reported")


@query("scan_inference", O.w(O.CLEAN, f"SELECT customerID, {', '.join(FEATURES)} FROM clean"))
def q_scan_inference(spark, sf):
    return readers.scan_inference(Tables(spark, sf).raw.drop(TARGET_COL))


# ---------------------------------------------------------------------------
# 2.2 cleaning and validation
# ---------------------------------------------------------------------------
def _missing_sql(src: str, cols: list[str], blank: bool) -> str:
    parts = []
    for c in cols:
        cond = f"{c} IS NULL" + (f" OR {O.strip(c)} = ''" if blank else "")
        parts.append(f"SELECT '{c}' AS \"column\", CAST(count_if({cond}) AS BIGINT) AS n_missing FROM {src}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_missing > 0"


@query("missing_before", O.w(O.FILE, _missing_sql("file", O.RAW_COLS, True)))
def q_missing_before(spark, sf):
    return clean.missing_before(Tables(spark, sf).file)


_MA_SQL = O.w(O.FILE_CLEAN, "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} IS NULL"
    + (f" OR isnan({c})" if c in ("MonthlyCharges", "TotalCharges") else "")
    + f") AS BIGINT) AS n_missing FROM clean" for c in O.RAW_COLS) + ") WHERE n_missing > 0")


@query("missing_after", _MA_SQL)
def q_missing_after(spark, sf):
    return clean.missing_after(clean.clean_customers(Tables(spark, sf).file))


@query("coerce_total_charges", O.w(O.CLEAN, "SELECT customerID, TotalCharges FROM clean"))
def q_coerce_total_charges(spark, sf):
    t = Tables(spark, sf)
    return t.raw.select(ID_COL, clean.coerce_total_charges(F.col("TotalCharges")).alias("TotalCharges"))


@query("coerce_numeric", O.w(O.CLEAN, "SELECT customerID, tenure, SeniorCitizen, MonthlyCharges FROM clean"))
def q_coerce_numeric(spark, sf):
    return Tables(spark, sf).clean_lazy.select(ID_COL, "tenure", "SeniorCitizen", "MonthlyCharges")


@query("encode_target", O.w(O.CLEAN, "SELECT customerID, Churn FROM clean"))
def q_encode_target(spark, sf):
    t = Tables(spark, sf)
    return t.raw.select(ID_COL, clean.encode_target(F.col(TARGET_COL)).alias(TARGET_COL))


@query("invalid_target_values", O.w(O.FILE, f"""
SELECT DISTINCT lower({O.strip('Churn')}) AS value FROM file
WHERE Churn IS NULL OR lower({O.strip('Churn')}) NOT IN ('yes', 'no')"""))
def q_invalid_target_values(spark, sf):
    return clean.invalid_target_values(Tables(spark, sf).file)


# a numeric target column: how often a customer's charges fill a thousand
@query("invalid_numeric_target", O.w(O.CLEAN, """
SELECT DISTINCT CAST(floor(MonthlyCharges / 1000) AS INTEGER) AS value FROM clean
WHERE CAST(floor(MonthlyCharges / 1000) AS INTEGER) NOT IN (0, 1)"""))
def q_invalid_numeric_target(spark, sf):
    numeric = F.floor(F.col("MonthlyCharges") / 1000).cast("int")
    return clean.invalid_numeric_target(Tables(spark, sf).clean_lazy.withColumn(TARGET_COL, numeric))


@query("negative_values", O.w(O.FILE_CLEAN, " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if({c} < 0) AS BIGINT) AS n_negative FROM clean"
    for c in ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"])))
def q_negative_values(spark, sf):
    return clean.negative_values(clean.clean_customers(Tables(spark, sf).file))


@query("project_features", O.w(O.CLEAN, f"SELECT customerID, {', '.join(FEATURES)} FROM clean"))
def q_project_features(spark, sf):
    return clean.project_features(Tables(spark, sf).clean_lazy)


@query("cleaning_summary", O.w(O.CLEAN, f"""
SELECT 'missing_before' AS section, "column", n_missing AS n FROM ({_missing_sql('raw', O.RAW_COLS, True)})
UNION ALL
SELECT 'missing_after', "column", n_missing FROM ({_missing_sql('clean', O.RAW_COLS, False)})
UNION ALL SELECT 'rows', 'n_rows', CAST(count(*) AS BIGINT) FROM clean
UNION ALL SELECT 'rows', 'rows_dropped', CAST(0 AS BIGINT)"""))
def q_cleaning_summary(spark, sf):
    _, summary = clean.clean_and_summarise(Tables(spark, sf).raw)
    return summary


@query("label_name", O.w(O.CLEAN, """
SELECT customerID, Churn, CASE Churn WHEN 0 THEN 'Sem churn' WHEN 1 THEN 'Churn' END AS ChurnLabel FROM clean"""))
def q_label_name(spark, sf):
    return Tables(spark, sf).clean_lazy.select(ID_COL, TARGET_COL, label_name(F.col(TARGET_COL)).alias("ChurnLabel"))


@query("filter_segments", O.w(O.CLEAN, """
SELECT customerID, Contract, PaymentMethod FROM clean WHERE Contract IN ('Month-to-month', 'One year')"""))
def q_filter_segments(spark, sf):
    df = profile.filter_segments(Tables(spark, sf).clean_lazy, FILTER_CONTRACTS, FILTER_PAYMENTS)
    return df.select(ID_COL, "Contract", "PaymentMethod")


@query("filtered_count", O.w(O.CLEAN, """
SELECT CAST(count(*) AS BIGINT) AS n_rows FROM clean WHERE Contract IN ('Month-to-month', 'One year')"""))
def q_filtered_count(spark, sf):
    return profile.filtered_count(profile.filter_segments(Tables(spark, sf).clean_lazy, FILTER_CONTRACTS, FILTER_PAYMENTS))


@query("predict_label", O.w(O.TEST, f"""
SELECT customerID, CAST(score >= {O.dbl(0.5)} AS INTEGER) AS y_pred FROM test"""))
def q_predict_label(spark, sf):
    return Tables(spark, sf).test_scores.select(ID_COL, predict_label(F.col("score"), 0.5).alias("y_pred"))


@query("risk_band", O.w(O.SCORED, "SELECT customerID, churn_probability, risk_level FROM scored"))
def q_risk_band(spark, sf):
    return Tables(spark, sf).preds


@query("high_risk_flag", O.w(O.SCORED, f"""
SELECT customerID, p_raw >= {O.dbl(0.3)} AS is_high_risk FROM scored"""))
def q_high_risk_flag(spark, sf):
    s = score.score_customers(Tables(spark, sf).clean_lazy)
    return s.select(ID_COL, high_risk_flag(F.col("p_raw")).alias("is_high_risk"))


# ---------------------------------------------------------------------------
# 2.9 scoring (fixed weights) and ranked export
# ---------------------------------------------------------------------------
@query("score_customers", O.w(O.SCORED, "SELECT customerID, churn_probability FROM scored"))
def q_score_customers(spark, sf):
    return Tables(spark, sf).preds.select(ID_COL, "churn_probability")


@query("ranked_predictions", O.w(O.SCORED, """
SELECT customerID, churn_probability, risk_level,
       row_number() OVER (ORDER BY churn_probability DESC, customerID) AS rank FROM scored"""))
def q_ranked_predictions(spark, sf):
    return score.ranked_predictions(Tables(spark, sf).preds)


@query("risk_distribution", O.w(O.SCORED, """
SELECT risk_level, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY risk_level ORDER BY risk_level"""))
def q_risk_distribution(spark, sf):
    return score.risk_distribution(Tables(spark, sf).preds).withColumn("n", F.col("n").cast("bigint"))


@query("test_scores", O.w(O.TEST, "SELECT customerID, score, y, charge FROM test"))
def q_test_scores(spark, sf):
    return Tables(spark, sf).test_scores


@query("rank_by_risk", O.w(O.TEST, "SELECT customerID, score, rn FROM ranked"))
def q_rank_by_risk(spark, sf):
    return Tables(spark, sf).ranked.select(ID_COL, "score", "rn")


# ---------------------------------------------------------------------------
# 2.7 split
# ---------------------------------------------------------------------------
@query("stratified_split", O.w(O.SPLIT, "SELECT customerID, Churn, split FROM split"))
def q_stratified_split(spark, sf):
    return Tables(spark, sf).split.select(ID_COL, TARGET_COL, "split")


@query("split_distribution", O.w(O.SPLIT, """
SELECT split, Churn AS label, CAST(n AS BIGINT) AS n, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY split), 2) AS pct
FROM (SELECT split, Churn, count(*) AS n FROM split GROUP BY split, Churn)"""))
def q_split_distribution(spark, sf):
    return split.split_distribution(Tables(spark, sf).split)


@query("class_weights", O.w(O.SPLIT, """
SELECT Churn AS label, CAST(n_c AS BIGINT) AS n,
       CAST(sum(n_c) OVER () AS DOUBLE) / (CAST(count(*) OVER () AS DOUBLE) * n_c) AS weight
FROM (SELECT Churn, count(*) AS n_c FROM split WHERE split = 'train' GROUP BY Churn)"""))
def q_class_weights(spark, sf):
    return split.class_weights(Tables(spark, sf).split.filter(F.col("split") == "train"))


# ---------------------------------------------------------------------------
# 2.4 / 2.5 evaluation on the test split
# ---------------------------------------------------------------------------
_CM = f"""SELECT CAST(count_if(y = 0 AND score < {O.dbl(0.5)}) AS BIGINT) AS tn,
       CAST(count_if(y = 0 AND score >= {O.dbl(0.5)}) AS BIGINT) AS fp,
       CAST(count_if(y = 1 AND score < {O.dbl(0.5)}) AS BIGINT) AS fn,
       CAST(count_if(y = 1 AND score >= {O.dbl(0.5)}) AS BIGINT) AS tp FROM test"""


@query("confusion_matrix", O.w(O.TEST, _CM))
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(Tables(spark, sf).test_scores)


def _rate(num, den):
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0::DOUBLE END"


@query("precision_recall_f1", O.w(O.TEST, f"""
SELECT {O.dbl(0.5)} AS threshold, {_rate('tp', 'tp + fp')} AS precision, {_rate('tp', 'tp + fn')} AS recall,
       {_rate('2 * tp', '2 * tp + fp + fn')} AS f1_score FROM ({_CM})"""))
def q_precision_recall_f1(spark, sf):
    return metrics.binary_metrics(Tables(spark, sf).test_scores).select("threshold", "precision", "recall", "f1_score")


@query("precision", O.w(O.TEST, f"SELECT {_rate('tp', 'tp + fp')} AS precision FROM ({_CM})"))
def q_precision(spark, sf):
    return metrics.binary_metrics(Tables(spark, sf).test_scores).select("precision")


@query("recall", O.w(O.TEST, f"SELECT {_rate('tp', 'tp + fn')} AS recall FROM ({_CM})"))
def q_recall(spark, sf):
    return metrics.binary_metrics(Tables(spark, sf).test_scores).select("recall")


@query("f1_score", O.w(O.TEST, f"SELECT {_rate('2 * tp', '2 * tp + fp + fn')} AS f1_score FROM ({_CM})"))
def q_f1_score(spark, sf):
    return metrics.binary_metrics(Tables(spark, sf).test_scores).select("f1_score")


@query("score_histogram", O.w(O.TEST, """
SELECT score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM test GROUP BY score"""))
def q_score_histogram(spark, sf):
    from keepwise.operators.rank import score_histogram

    h = score_histogram(Tables(spark, sf).test_scores)
    return h.select("score", F.col("pos").cast("bigint"), F.col("neg").cast("bigint"))


@query("accuracy", O.w(O.TEST, f"SELECT {_rate('tn + tp', 'tn + fp + fn + tp')} AS accuracy FROM ({_CM})"))
def q_accuracy(spark, sf):
    return metrics.binary_metrics(Tables(spark, sf).test_scores).select("accuracy")


@query("roc_auc", O.w(O.TEST, """
SELECT CASE WHEN P > 0 AND N > 0 THEN CAST(num AS DOUBLE) / (2.0::DOUBLE * CAST(P AS DOUBLE) * CAST(N AS DOUBLE)) END AS roc_auc,
       CAST(P AS BIGINT) AS n_pos, CAST(N AS BIGINT) AS n_neg
FROM (SELECT sum(CAST(a.y AS HUGEINT) * (2 * (SELECT count(*) FROM test b WHERE b.y = 0 AND b.score < a.score)
                 + (SELECT count(*) FROM test b WHERE b.y = 0 AND b.score = a.score))) AS num,
             sum(a.y) AS P, sum(1 - a.y) AS N FROM test a)"""))
def q_roc_auc(spark, sf):
    return metrics.roc_auc(Tables(spark, sf).histogram)


@query("roc_curve", O.w(O.TEST, """,
h AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM test GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tps, sum(neg) OVER (ORDER BY score DESC) AS fps,
             row_number() OVER (ORDER BY score DESC) AS i FROM h),
d AS (SELECT *, lag(tps) OVER (ORDER BY i) AS tps_p, lead(tps) OVER (ORDER BY i) AS tps_n,
             lag(fps) OVER (ORDER BY i) AS fps_p, lead(fps) OVER (ORDER BY i) AS fps_n FROM c),
k AS (SELECT i, fps, tps, score FROM d
      WHERE tps_p IS NULL OR tps_n IS NULL OR fps_n - 2 * fps + fps_p <> 0 OR tps_n - 2 * tps + tps_p <> 0),
t AS (SELECT max(tps) AS P, max(fps) AS N FROM c),
u AS (SELECT 0 AS i, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold
      UNION ALL SELECT i, fps / N, tps / P, score FROM k, t)
SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS point, fpr, tpr, threshold FROM u"""))
def q_roc_curve(spark, sf):
    return metrics.roc_curve(Tables(spark, sf).histogram)


def _sweep_sql() -> str:
    vals = " UNION ALL ".join(
        f"SELECT {i} AS i, {O.dbl(fixed.SWEEP_START)} + {i} * (({O.dbl(fixed.SWEEP_START)} + {O.dbl(fixed.SWEEP_STEP)}) - {O.dbl(fixed.SWEEP_START)}) AS t"
        for i in range(len(fixed.sweep_thresholds())))
    return f""",
th AS ({vals}),
cm AS (SELECT t AS threshold,
         CAST(count_if(test.y = 0 AND test.score < t) AS BIGINT) AS tn, CAST(count_if(test.y = 0 AND test.score >= t) AS BIGINT) AS fp,
         CAST(count_if(test.y = 1 AND test.score < t) AS BIGINT) AS fn, CAST(count_if(test.y = 1 AND test.score >= t) AS BIGINT) AS tp
       FROM th, test GROUP BY t),
sw AS (SELECT threshold, round_even({_rate('tp', 'tp + fp')}, 4) AS precision, round_even({_rate('tp', 'tp + fn')}, 4) AS recall,
         round_even({_rate('2 * tp', '2 * tp + fp + fn')}, 4) AS f1_score, tn, fp, fn, tp, fp + tp AS n_pred_pos FROM cm)"""


@query("threshold_sweep", O.w(O.TEST + _sweep_sql(), "SELECT * FROM sw"))
def q_threshold_sweep(spark, sf):
    return metrics.threshold_sweep(Tables(spark, sf).histogram)


@query("threshold_cross", O.w(O.TEST + _sweep_sql(), "SELECT threshold, tp, fp, n_pred_pos FROM sw"))
def q_threshold_cross(spark, sf):
    return metrics.threshold_sweep(Tables(spark, sf).test_scores).select("threshold", "tp", "fp", "n_pred_pos")


_REC = {"recall_min": "'60%'", "threshold": "printf('%.2f', threshold)", "f1": "printf('%.4f', f1_score)",
        "recall": "printf('%.4f', recall)", "precision": "printf('%.4f', precision)"}


@query("recommend_threshold", O.w(O.TEST + _sweep_sql() + """,
rec_e AS (SELECT *, recall >= 0.6::DOUBLE AS eligible, max(CAST(recall >= 0.6::DOUBLE AS INTEGER)) OVER () AS any_e FROM sw),
rec_b AS (SELECT * FROM rec_e WHERE eligible OR any_e = 0
      ORDER BY CASE WHEN eligible THEN f1_score ELSE recall END DESC,
               CASE WHEN eligible THEN recall ELSE f1_score END DESC, threshold LIMIT 1)""",
       """SELECT threshold, precision, recall, f1_score, eligible,
  CASE WHEN eligible THEN """ + fill_sql(fixed.RECOMMEND_BEST, _REC) + """
  ELSE """ + fill_sql(fixed.RECOMMEND_NONE, _REC) + """
  END AS justification,
  printf('%.2f', threshold) AS threshold_label
FROM rec_b"""))
def q_recommend_threshold(spark, sf):
    return metrics.recommend_threshold(metrics.threshold_sweep(Tables(spark, sf).test_scores))


_PCTS = " UNION ALL ".join(f"SELECT {p} AS top_pct" for p in fixed.TOP_PCTS)


@query("topn_capture", O.w(O.TEST, f""",
p AS ({_PCTS}),
k AS (SELECT top_pct, greatest(1, CAST(round_even(n * top_pct / 100, 0) AS BIGINT)) AS k, churners
      FROM p, (SELECT count(*) AS n, sum(y) AS churners FROM test) WHERE n > 0 AND churners > 0)
SELECT CAST(k.top_pct AS INTEGER) AS top_pct,
       round_even(100.0::DOUBLE * sum(ranked.y) / k.churners, 2) AS capture_pct,
       CAST(sum(ranked.y) AS BIGINT) AS n_captured
FROM k JOIN ranked ON ranked.rn <= k.k GROUP BY k.top_pct, k.churners"""))
def q_topn_capture(spark, sf):
    return metrics.topn_capture(Tables(spark, sf).ranked)


@query("decile_gain", O.w(O.TEST, """,
dz AS (SELECT greatest(1, n // 10) AS size FROM (SELECT count(*) AS n FROM test)),
dd AS (SELECT least(10, (rn - 1) // size + 1) AS decile, y FROM ranked, dz),
dl AS (SELECT range AS decile FROM range(1, 11)),
dc AS (SELECT dl.decile, coalesce(sum(dd.y), 0) AS c FROM dl LEFT JOIN dd ON dd.decile = dl.decile GROUP BY dl.decile),
tot AS (SELECT sum(y) AS churners FROM test)
SELECT CAST(decile AS INTEGER) AS decile, CAST(decile * 10 AS INTEGER) AS pct_contacted, CAST(c AS BIGINT) AS churn_in_decile,
       round_even(100.0::DOUBLE * c / churners, 2) AS pct_churn_decile,
       round_even(100.0::DOUBLE * sum(c) OVER (ORDER BY decile) / churners, 2) AS cumulative_pct_churn
FROM dc, tot WHERE churners > 0"""))
def q_decile_gain(spark, sf):
    return metrics.decile_gain(Tables(spark, sf).ranked)


@query("capacity_topn", O.w(O.TEST, """,
nn AS (SELECT count(*) AS n FROM test),
caps AS (SELECT 1 AS request, least(100, greatest(1, n // 5)) AS requested, least(n, least(100, greatest(1, n // 5))) AS capacity FROM nn
         UNION ALL SELECT 2, 50, least(n, 50) FROM nn UNION ALL SELECT 3, 300, least(n, 300) FROM nn)
SELECT request, CAST(requested AS BIGINT) AS requested, CAST(capacity AS BIGINT) AS capacity,
       coalesce(min(score), 0.0::DOUBLE) AS implied_threshold,
       CAST(coalesce(sum(y), 0) AS BIGINT) AS churners_captured,
       CAST(coalesce(sum(CAST(charge * y AS DECIMAL(28,10))), 0) AS DOUBLE) AS revenue_covered
FROM caps LEFT JOIN ranked ON ranked.rn <= caps.capacity GROUP BY request, requested, capacity"""))
def q_capacity_topn(spark, sf):
    t = Tables(spark, sf)
    n = int(t.ranked.count())
    caps = [campaign.default_capacity(n) if c is None else c for c in CAPACITIES]
    return campaign.capacity_topn(t.ranked, caps)


def _campaign_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i + 1} AS scenario, {O.dbl(s['pct_contacted'])} AS pct_contacted, {O.dbl(s['success_rate'])} AS success_rate, "
        f"{O.dbl(s['cost_per_contact'])} AS cost_per_contact, {O.dbl(s['avg_discount'])} AS avg_discount"
        for i, s in enumerate(SCENARIOS))
    return O.w(O.TEST, f""",
sc AS ({rows}),
pl AS (SELECT sc.*, greatest(1, CAST(round_even(n * 20 / 100, 0) AS BIGINT)) AS pool_size FROM sc, (SELECT count(*) AS n FROM test)),
pk AS (SELECT *, greatest(0, CAST(round_even(pct_contacted / 100 * pool_size, 0) AS BIGINT)) AS n_contacted FROM pl),
ag AS (SELECT pk.scenario, CAST(coalesce(sum(ranked.y), 0) AS BIGINT) AS ch,
              CAST(coalesce(sum(CAST(ranked.charge * ranked.y AS DECIMAL(28,10))), 0) AS DOUBLE) AS m
       FROM pk LEFT JOIN ranked ON ranked.rn <= pk.n_contacted GROUP BY pk.scenario),
v AS (SELECT pk.*, ag.ch, ch * (success_rate / 100) AS avoided, m / greatest(1, ch) AS avg_c,
             greatest(0.0::DOUBLE, m / greatest(1, ch) - avg_discount) AS monthly FROM pk JOIN ag USING (scenario))
SELECT CAST(scenario AS INTEGER) AS scenario, pct_contacted, success_rate, cost_per_contact, avg_discount,
  CAST(pool_size AS BIGINT) AS pool_size, CAST(n_contacted AS BIGINT) AS n_contacted,
  CAST(CASE WHEN n_contacted > 0 THEN ch ELSE 0 END AS BIGINT) AS churners_contacted,
  CASE WHEN n_contacted > 0 THEN avoided ELSE 0.0::DOUBLE END AS churn_avoided,
  CASE WHEN n_contacted > 0 THEN avg_c ELSE 0.0::DOUBLE END AS avg_charge_churners,
  CASE WHEN n_contacted > 0 THEN avoided * monthly * 12 ELSE 0.0::DOUBLE END AS revenue_preserved,
  CASE WHEN n_contacted > 0 THEN CAST(n_contacted AS DOUBLE) * cost_per_contact ELSE 0.0::DOUBLE END AS total_cost,
  CASE WHEN n_contacted > 0 THEN avoided * monthly * 12 - CAST(n_contacted AS DOUBLE) * cost_per_contact ELSE 0.0::DOUBLE END AS net_benefit
FROM v""")


@query("campaign_roi", _campaign_sql())
def q_campaign_roi(spark, sf):
    return campaign.campaign_roi(Tables(spark, sf).ranked, SCENARIOS)


# ---------------------------------------------------------------------------
# 2.4 descriptive aggregates on the whole customer table
# ---------------------------------------------------------------------------
@query("hero_kpis", O.w(O.CLEAN, """
SELECT 100.0::DOUBLE * CAST(sum(Churn) AS DOUBLE) / count(*) AS churn_pct,
       CAST(sum(CAST(MonthlyCharges AS DECIMAL(28,10))) AS DOUBLE) / count(MonthlyCharges) AS avg_monthly_charge,
       CAST(coalesce(sum(CASE WHEN Churn = 1 THEN CAST(MonthlyCharges AS DECIMAL(28,10)) END), 0) AS DOUBLE) AS revenue_at_risk,
       CAST(count(*) AS BIGINT) AS n_customers FROM clean"""))
def q_hero_kpis(spark, sf):
    return profile.hero_kpis(Tables(spark, sf).clean_lazy)


@query("churn_counts", O.w(O.CLEAN, """
SELECT CASE Churn WHEN 0 THEN 'Sem churn' WHEN 1 THEN 'Churn' END AS ChurnLabel, CAST(count(*) AS BIGINT) AS n
FROM clean WHERE Contract IN ('Month-to-month', 'One year') GROUP BY 1 ORDER BY 1"""))
def q_churn_counts(spark, sf):
    df = profile.filter_segments(Tables(spark, sf).clean_lazy, FILTER_CONTRACTS, FILTER_PAYMENTS)
    return profile.churn_counts(profile.with_label(df))


def _register_all() -> None:
    from keepwise.plans import catalog_io, catalog_model  # noqa: F401  (registers parts 2 and 3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _register_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _register_all()
    return dict(ORACLE)
