"""Customer table layout: key, target and the 19 model features."""

from __future__ import annotations

from pyspark.sql import types as T

ID_COL = "customerID"
TARGET_COL = "Churn"

# Fixed values that must equal the reference: column names and their order.
NUMERIC_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"]
CATEGORICAL_FEATURES = [
    "gender",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
]
# End of fixed values.

FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
RAW_COLUMNS = [ID_COL] + FEATURES + [TARGET_COL]


def raw_schema(with_target: bool = True) -> T.StructType:
    """All-STRING read schema: nothing is inferred, casts happen in ``clean``."""
    cols = [ID_COL] + FEATURES + ([TARGET_COL] if with_target else [])
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def clean_types() -> dict[str, str]:
    """Column -> Spark SQL type after cleaning."""
    out = {ID_COL: "string", "tenure": "int", "MonthlyCharges": "double",
           "TotalCharges": "double", "SeniorCitizen": "int"}
    out.update({c: "string" for c in CATEGORICAL_FEATURES})
    out[TARGET_COL] = "int"
    return out
