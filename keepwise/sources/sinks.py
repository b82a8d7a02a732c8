"""Sinks: id lists, ranked predictions, the metrics document, threshold table,
recommendation text.

Row-level outputs are written by the executors as part files (CSV with a
header per part, or JSON Lines); a globally ordered export is a range-partitioned
sort, so part files are in rank order. Only the one-row reports are coalesced
to a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.functions import fixed
from keepwise.functions.text import fill
from keepwise.operators import metrics
from keepwise.plans.combine import side_by_side
from keepwise.schema import ID_COL


def write_customer_ids(df: DataFrame, path: str) -> str:
    df.select(ID_COL).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_predictions_csv(preds: DataFrame, path: str) -> str:
    """Ranked predictions: probability descending, then id; no index column."""
    (preds.select(ID_COL, "churn_probability", "risk_level")
     .orderBy(F.col("churn_probability").desc(), F.col(ID_COL).asc())
     .write.mode("overwrite").option("header", True).csv(path))
    return path


def write_predictions_json(preds: DataFrame, path: str) -> str:
    """JSON Lines, one record per customer (an indented array does not scale)."""
    (preds.select(ID_COL, F.col("churn_probability").cast("double"), "risk_level")
     .orderBy(F.col("churn_probability").desc(), F.col(ID_COL).asc())
     .write.mode("overwrite").json(path))
    return path


PREDICTION_SCHEMA = T.StructType([T.StructField(ID_COL, T.StringType()),
                                  T.StructField("churn_probability", T.DoubleType()),
                                  T.StructField("risk_level", T.StringType())])


def read_predictions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(PREDICTION_SCHEMA)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)


def metrics_document(scores: DataFrame, ranked: DataFrame, threshold: float = 0.5, histogram: DataFrame | None = None) -> DataFrame:
    """One row: ``roc_auc, precision, recall, f1_score, confusion_matrix, threshold,
    accuracy, top_n_capture, decile_gain``: report tables of fixed length only."""
    bm = metrics.binary_metrics(scores, threshold)
    auc = metrics.roc_auc(scores if histogram is None else histogram).select("roc_auc")
    top = metrics.topn_capture(ranked).agg(
        F.sort_array(F.collect_list(F.struct("top_pct", "capture_pct", "n_captured"))).alias("top_n_capture"))
    dec = metrics.decile_gain(ranked).agg(
        F.sort_array(F.collect_list(F.struct("decile", "pct_contacted", "churn_in_decile", "pct_churn_decile",
                                             "cumulative_pct_churn"))).alias("decile_gain"))
    row = side_by_side(bm, auc, top, dec)   # all single-row aggregates
    cm = F.array(F.array(F.col("tn"), F.col("fp")), F.array(F.col("fn"), F.col("tp")))
    return row.select("roc_auc", "precision", "recall", "f1_score", cm.alias("confusion_matrix"), "threshold", "accuracy",
                      F.coalesce("top_n_capture", F.array().cast("array<struct<top_pct:int,capture_pct:double,n_captured:bigint>>")).alias("top_n_capture"),
                      F.coalesce("decile_gain", F.array().cast(
                          "array<struct<decile:int,pct_contacted:int,churn_in_decile:bigint,"
                          "pct_churn_decile:double,cumulative_pct_churn:double>>")).alias("decile_gain"))


def write_metrics(scores: DataFrame, ranked: DataFrame, path: str, threshold: float = 0.5) -> str:
    """The document as one JSON record under ``path/document``, the ROC points (as
    many as the scores need) as JSON Lines under ``path/roc``."""
    histogram = metrics.ordered_histogram(scores)      # one sort for the area and the curve
    metrics_document(scores, ranked, threshold, histogram).coalesce(1).write.mode("overwrite").json(f"{path}/document")
    metrics.roc_curve(histogram).select("point", "fpr", "tpr").write.mode("overwrite").json(f"{path}/roc")
    return path


def metrics_rows(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_metrics`` wrote, one number per row: section, position, name, value."""
    doc = spark.read.schema(METRICS_SCHEMA).json(f"{path}/document")
    num = lambda section, position, name, value: F.struct(
        F.lit(section).alias("section"), position.cast("int").alias("position"), F.lit(name).alias("name"), value.cast("double").alias("value"))
    scalars = [num("summary", F.lit(0), c, F.col(c)) for c in ("roc_auc", "precision", "recall", "f1_score", "accuracy", "threshold")]
    cells = [num("confusion_matrix", F.lit(2 * i + j), n, F.col("confusion_matrix")[i][j])
             for n, i, j in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    listed = lambda column, key, fields: F.flatten(F.transform(column, lambda r: F.array(
        *[num(column, r[key], f, r[f]) for f in fields])))
    every = F.concat(F.array(*scalars, *cells), listed("top_n_capture", "top_pct", ["capture_pct", "n_captured"]),
                     listed("decile_gain", "decile", ["pct_contacted", "churn_in_decile", "pct_churn_decile", "cumulative_pct_churn"]))
    roc = spark.read.schema("point INT, fpr DOUBLE, tpr DOUBLE").json(f"{path}/roc")
    points = roc.select(F.explode(F.array(num("roc", F.col("point"), "fpr", F.col("fpr")), num("roc", F.col("point"), "tpr", F.col("tpr")))).alias("x"))
    return doc.select(F.explode(every).alias("x")).unionByName(points).select("x.*")


METRICS_SCHEMA = T.StructType([
    T.StructField("roc_auc", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1_score", T.DoubleType()),
    T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("top_n_capture", T.ArrayType(T.StructType([
        T.StructField("top_pct", T.IntegerType()), T.StructField("capture_pct", T.DoubleType()),
        T.StructField("n_captured", T.LongType())]))),
    T.StructField("decile_gain", T.ArrayType(T.StructType([
        T.StructField("decile", T.IntegerType()), T.StructField("pct_contacted", T.IntegerType()),
        T.StructField("churn_in_decile", T.LongType()), T.StructField("pct_churn_decile", T.DoubleType()),
        T.StructField("cumulative_pct_churn", T.DoubleType())]))),
])


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Headline numbers from a metrics document: scalars (absent -> 0), the
    top-10 % capture and the cumulative churn at 20 % and 30 % contacted."""
    doc = spark.read.schema(METRICS_SCHEMA).json(f"{path}/document")
    top10 = F.filter("top_n_capture", lambda r: r["top_pct"] == 10)
    at = lambda pct: F.filter("decile_gain", lambda r: r["pct_contacted"] == pct)
    first = lambda arr, field: F.when(F.size(arr) > 0, F.element_at(arr, 1)[field])
    return doc.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c)
                        for c in ("roc_auc", "precision", "recall", "f1_score", "accuracy")],
                      first(top10, "capture_pct").alias("top10_capture_pct"),
                      first(at(20), "cumulative_pct_churn").alias("cum_pct_at_20"),
                      first(at(30), "cumulative_pct_churn").alias("cum_pct_at_30"))


def write_threshold_table(sweep: DataFrame, path: str) -> str:
    sweep.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def recommendation_text(rec: DataFrame) -> DataFrame:
    """The recommendation file body as one STRING column ``value``."""
    header = fill(fixed.RECOMMEND_HEADER, {"threshold": F.format_string("%.2f", F.col("threshold"))})
    return rec.select(F.concat(header, F.lit("\n\n"), F.col("justification")).alias("value"))


def write_recommendation(rec: DataFrame, path: str) -> str:
    recommendation_text(rec).coalesce(1).write.mode("overwrite").text(path)
    return path
