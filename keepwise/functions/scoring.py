"""Scoring expressions: sigmoid, bands, labels and linear scorers.

A scorer is a Column expression, so scoring stays inside whole-stage codegen;
only the neural scorer needs Python (Arrow batches, see ``operators.model``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.functions import fixed


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def rational_share(z: Column) -> Column:
    """``1/2 + z / (2 (1 + |z|))``: a sigmoid-shaped link of basic operations only, so
    that every engine computes the same bits (``exp`` may differ in the last one)."""
    return F.lit(0.5) + F.lit(0.5) * (z / (F.lit(1.0) + F.abs(z)))


def risk_band(p: Column, labels: tuple[str, str, str] = fixed.RISK_LABELS) -> Column:
    """Low below 0.3, Medium up to and including 0.6, High above."""
    low, med, high = labels
    return (F.when(p < fixed.RISK_LOW_MAX, F.lit(low))
            .when(p <= fixed.RISK_MEDIUM_MAX, F.lit(med))
            .when(p.isNotNull(), F.lit(high)))


def predict_label(p: Column, threshold: float = fixed.DEFAULT_THRESHOLD) -> Column:
    """1 when ``p >= threshold`` (inclusive), else 0."""
    return (p >= F.lit(float(threshold))).cast("int")


def high_risk_flag(p: Column) -> Column:
    return p >= F.lit(fixed.HIGH_RISK_MIN)


def label_name(y: Column, labels: dict[int, str] | None = None) -> Column:
    labels = labels or fixed.CHURN_LABELS
    out = None
    for k, v in labels.items():
        out = F.when(y == k, F.lit(v)) if out is None else out.when(y == k, F.lit(v))
    return out


@dataclass(frozen=True)
class TermLogit:
    """``z = intercept + w1*t1 + w2*t2 + ...`` over named column terms, summed
    left to right in the given order; ``p = link(z)``."""

    intercept: float
    terms: list = field(default_factory=list)   # [(name, Column-builder, weight)]
    link: Callable[[Column], Column] = sigmoid

    def z(self) -> Column:
        acc = F.lit(float(self.intercept))
        for _, term, w in self.terms:
            acc = acc + F.lit(float(w)) * term().cast("double")
        return acc

    def probability(self) -> Column:
        return self.link(self.z())

    def transform(self, clean: DataFrame) -> DataFrame:
        return clean.withColumn("p_raw", self.probability())


def fixed_scorer() -> TermLogit:
    """The fixed-weight scorer the oracle recomputes to the last bit: weights are
    multiples of 1/64 and the link is rational, so no operation rounds differently.

    ``z = 2 - 3/64 tenure + 26/64 [Contract = Month-to-month]
        + 19/64 [PaymentMethod is a manual check] + 13/64 [InternetService = Fiber optic]``
    """
    return TermLogit(2.0, [
        ("tenure", lambda: F.col("tenure"), -3 / 64),
        ("month_to_month", lambda: F.col("Contract") == "Month-to-month", 26 / 64),
        ("manual_payment", lambda: F.col("PaymentMethod").isin("Electronic check", "Mailed check"), 19 / 64),
        ("fiber", lambda: F.col("InternetService") == "Fiber optic", 13 / 64),
    ], rational_share)


def linear_vector_score(features: Column, weights: list[float], intercept: float) -> Column:
    """``intercept + sum_j w_j * x_j`` over an ARRAY<DOUBLE>, folded left to right.

    Zero weights are skipped, so a sparse weight vector costs only its non-zeros.
    """
    acc = F.lit(float(intercept))
    for j, w in enumerate(weights):
        if w != 0.0:
            acc = acc + F.lit(float(w)) * F.get(features, j)
    return acc


def sig_round(x: Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (half-even on the scaled mantissa).

    Used to report fitted floating parameters whose last bits depend on the
    summation order."""
    k = F.floor(F.log10(F.abs(x)))
    p = F.pow(F.lit(10.0), F.abs(k))
    m = F.when(k >= 0, x / p).otherwise(x * p)
    mr = F.bround(m, digits - 1)
    return F.when((x == 0) | x.isNull() | F.isnan(x), x).otherwise(F.when(k >= 0, mr * p).otherwise(mr / p))
