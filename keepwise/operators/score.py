"""Batch scoring: probability, risk band, ranked export.

Scoring is row-local (a Column expression, or Arrow batches for the neural
scorer), so it never shuffles; only the final ranked order does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.functions import scoring
from keepwise.operators.rank import global_rank
from keepwise.schema import ID_COL, TARGET_COL

PROB_DP = 6


def score_customers(clean: DataFrame, scorer=None, keep: list[str] | None = None) -> DataFrame:
    """``(id, p_raw, churn_probability, risk_level, *keep)``.

    ``scorer`` is a Column or any object whose ``transform(df)`` adds ``p_raw``
    (fixed weights, linear, neural). The band is taken from the unrounded
    probability, the exported value is rounded half-even to 6 dp.
    """
    scorer = scorer if scorer is not None else scoring.fixed_scorer()
    keep = [c for c in (keep or []) if c != ID_COL]
    df = clean.withColumn("p_raw", scorer) if isinstance(scorer, Column) else scorer.transform(clean)
    return df.select(ID_COL, "p_raw",
                     F.bround(F.col("p_raw"), PROB_DP).alias("churn_probability"),
                     scoring.risk_band(F.col("p_raw")).alias("risk_level"), *keep)


def predictions(clean: DataFrame, scorer=None) -> DataFrame:
    """The exported prediction table ``(customerID, churn_probability, risk_level)``."""
    return score_customers(clean, scorer).select(ID_COL, "churn_probability", "risk_level")


def ranked_predictions(preds: DataFrame) -> DataFrame:
    """Predictions with ``rank``: rounded probability descending, then id."""
    return global_rank(preds, [F.col("churn_probability").desc(), F.col(ID_COL).asc()], rank_col="rank")


def scored_outcomes(clean: DataFrame, scorer=None) -> DataFrame:
    """``(customerID, score, y, charge)``: the table every ranking metric reads.
    ``score`` is the unrounded probability."""
    s = score_customers(clean, scorer, keep=[TARGET_COL, "MonthlyCharges"])
    return s.select(ID_COL, F.col("p_raw").alias("score"),
                    F.col(TARGET_COL).cast("int").alias("y"),
                    F.col("MonthlyCharges").alias("charge"))


def rank_by_risk(scores: DataFrame, score: str = "score") -> DataFrame:
    """Global risk order: score descending, ties by id ascending."""
    return global_rank(scores, [F.col(score).desc(), F.col(ID_COL).asc()], rank_col="rn")


def risk_distribution(preds: DataFrame) -> DataFrame:
    """Rows per band, sorted by band name."""
    return preds.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")).orderBy("risk_level")
