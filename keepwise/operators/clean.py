"""Cleaning and validation: one narrow projection plus single-pass profiles.

Every profile here is one aggregate over the table (partial aggregation on the
map side, a single row per task to the final stage), then an ``unpivot`` of that
one row into a long ``(column, n)`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from keepwise.functions.text import strip, to_number
from keepwise.plans.materialize import materialize
from keepwise.schema import (CATEGORICAL_FEATURES, ID_COL, NUMERIC_FEATURES,
                             TARGET_COL)

VALID_TARGET = ("yes", "no")


def _long_counts(df: DataFrame, exprs: dict, name: str) -> DataFrame:
    """One aggregate row of per-column counts, unpivoted to (column, name)."""
    row = df.agg(*[e.cast("bigint").alias(c) for c, e in exprs.items()])
    return row.unpivot([], list(exprs), "column", name)


def missing_before(raw: DataFrame) -> DataFrame:
    """Per column: NULL cells plus text cells that are blank after strip;
    only columns with a count above zero."""
    return _long_counts(raw, _blank_cells(raw), "n_missing").filter(F.col("n_missing") > 0)


def _blank_cells(raw: DataFrame) -> dict:
    return {c: F.count_if(F.col(c).isNull() | (strip(F.col(c)) == "") if t == "string" else F.col(c).isNull()) for c, t in raw.dtypes}


def _null_cells(clean: DataFrame) -> dict:
    return {c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c)) if t in ("double", "float") else F.col(c).isNull()) for c, t in clean.dtypes}


def missing_after(clean: DataFrame) -> DataFrame:
    """Per column NULL (or NaN) cells after cleaning, above zero only."""
    return _long_counts(clean, _null_cells(clean), "n_missing").filter(F.col("n_missing") > 0)


def coerce_total_charges(c, fill: float = 0.0):
    """Text to number; blank, non-numeric and NaN become ``fill``."""
    return F.coalesce(to_number(c), F.lit(float(fill)))


def coerce_numeric(c):
    """Text to number, bad values stay NULL (no fill)."""
    return to_number(c)


def encode_target(c):
    """``yes`` (any case, padded) or the number 1 -> 1, anything else -> 0."""
    return F.coalesce((F.lower(strip(c)) == "yes") | F.coalesce(to_number(c) == 1, F.lit(False)), F.lit(False)).cast("int")


def clean_customers(raw: DataFrame, fill: float = 0.0, with_target: bool = True) -> DataFrame:
    """Typed table: id STRING, tenure INT, MonthlyCharges/TotalCharges DOUBLE,
    SeniorCitizen INT, categoricals unchanged, Churn INT 0/1.

    Fractional tenure or SeniorCitizen values are truncated toward zero.
    """
    cols = [F.col(ID_COL).cast("string").alias(ID_COL)]
    for c in NUMERIC_FEATURES:
        if c == "TotalCharges":
            e = coerce_total_charges(F.col(c), fill)
        else:
            e = coerce_numeric(F.col(c))
        if c in ("tenure", "SeniorCitizen"):
            e = e.try_cast("int")
        cols.append(e.alias(c))
    cols += [F.col(c).cast("string").alias(c) for c in CATEGORICAL_FEATURES]
    if with_target and TARGET_COL in raw.columns:
        cols.append(encode_target(F.col(TARGET_COL).cast("string")).alias(TARGET_COL))
    return raw.select(*cols)


def invalid_target_values(raw: DataFrame) -> DataFrame:
    """Distinct stripped, lower-cased target values that are neither yes or no nor
    the numbers 0 or 1; NULL counts as invalid."""
    v = F.lower(strip(F.col(TARGET_COL).cast("string")))
    return (raw.select(v.alias("value"))
            .filter(F.col("value").isNull() | ~(F.col("value").isin(*VALID_TARGET)
                                                | F.coalesce(to_number(F.col("value")).isin(0.0, 1.0), F.lit(False))))
            .distinct())


def invalid_numeric_target(df: DataFrame) -> DataFrame:
    """Distinct non-NULL numeric target values outside {0, 1}."""
    y = F.col(TARGET_COL)
    return df.select(y.alias("value")).filter(y.isNotNull() & ~y.isin(0, 1)).distinct()


def negative_values(clean: DataFrame) -> DataFrame:
    """Count of negative values for each numeric column present, in list order."""
    present = [c for c in NUMERIC_FEATURES if c in clean.columns]
    exprs = {c: F.count_if(F.col(c) < 0) for c in present}
    return _long_counts(clean, exprs, "n_negative")


def validate(raw: DataFrame, clean: DataFrame) -> None:
    """Strict mode: raise on an invalid target (if there is one) or the first negative column.

    Only the violations reach the driver: distinct target values, a count per column.
    """
    if TARGET_COL in raw.columns:
        bad = sorted(str(r.value) for r in invalid_target_values(raw).collect())
        if bad:
            raise ValueError(f"{TARGET_COL} holds values other than yes and no: {bad}")
    for r in negative_values(clean).collect():
        if r.n_negative > 0:
            raise ValueError(f"{r.n_negative} rows are below zero in {r.column}")


def project_features(clean: DataFrame) -> DataFrame:
    """Id plus the 19 features (the id rides along instead of being dropped)."""
    from keepwise.schema import FEATURES

    return clean.select(ID_COL, *FEATURES)


def clean_and_summarise(raw: DataFrame, fill: float = 0.0, with_target: bool = True) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, written, and a long table ``(section, column, n)``: missing before,
    missing after, negative, rows, rows dropped (always 0: cleaning never drops rows).

    All counts are observed while the table is written, so the input is read once."""
    seen, done = Observation("before"), Observation("after")
    rows = F.count(F.lit(1)).alias("n_rows")
    clean = clean_customers(raw.observe(seen, rows, *[e.alias(f"c_{c}") for c, e in _blank_cells(raw).items()]), fill, with_target)
    after = [e.alias(f"c_{c}") for c, e in _null_cells(clean).items()]
    below = [F.count_if(F.col(c) < 0).alias(f"n_{c}") for c in NUMERIC_FEATURES]
    written = materialize(clean.observe(done, rows, *after, *below), "customers")
    one, two = seen.get, done.get
    found = ([("missing_before", c, one[f"c_{c}"]) for c in raw.columns] + [("missing_after", c, two[f"c_{c}"]) for c in clean.columns]
             + [("negative", c, two[f"n_{c}"]) for c in NUMERIC_FEATURES])
    found = [x for x in found if x[2]] + [("rows", "n_rows", two["n_rows"]), ("rows", "rows_dropped", one["n_rows"] - two["n_rows"])]
    return written, raw.sparkSession.createDataFrame(found, "section STRING, column STRING, n BIGINT")


def cleaning_summary(raw: DataFrame, fill: float = 0.0) -> DataFrame:
    """The summary alone."""
    return clean_and_summarise(raw, fill)[1]
