"""Customer readers: CSV or parquet with an explicit all-STRING schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepwise.plans.materialize import materialize
from keepwise.schema import FEATURES, ID_COL, TARGET_COL, raw_schema


#: Text that stands for a missing cell in a CSV file.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
                  "NULL", "NaN", "None", "n/a", "nan", "null"]


def require_columns(df: DataFrame, required) -> None:
    """Raise with the sorted list of absent names (schema only, no job)."""
    _require(df.columns, required)


def _require(present, required) -> None:
    absent = sorted(set(required) - set(present))
    if absent:
        raise ValueError(f"the customer table lacks {absent}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.globStatus(jpath) is not None and len(fs.globStatus(jpath)) > 0


RECORD = "_record"       # the text of a record that has not as many cells as the header


def _parsed(spark: SparkSession, path: str, multi_line: bool) -> tuple[list[str], DataFrame]:
    """Header names and all records as text cells, with ``RECORD`` for those of another width."""
    options = {"header": True, "escape": '"', "multiLine": multi_line,         # "" inside quotes is one quote
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    head = spark.read.options(**options).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*head, RECORD]])
    # without pruning every cell is parsed, so that a record's width is seen whatever is selected
    return head, (spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD, columnPruning=False)
                  .schema(schema).csv(path))


def _too_wide(record: Column, width: int) -> Column:
    """More cells than the header has: separators outside quotes are counted."""
    bare = F.regexp_replace(record, r'"(?:[^"]|"")*+"', "")
    return record.isNotNull() & (F.size(F.split(bare, ",", -1)) > width)


def scan_customers(spark: SparkSession, path: str, fmt: str = "csv", with_target: bool = True,
                   multi_line: bool = True, quarantine: str | None = None) -> DataFrame:
    """Read a customer table with every column as STRING.

    CSV needs a header; parquet columns are cast to STRING so both formats feed
    the same cleaning. A missing path is an error, as is a missing column.

    A quoted cell may hold line breaks (``multi_line``: a file is then read by one
    task; switch it off for few, very large files without such cells). A record with
    too few cells lacks the last ones. One with too many is never cut: it is an error,
    or, with ``quarantine``, a row (record) of a table written there. The parsed cells
    are written once, so that the check does not parse the files again.
    """
    if not _exists(spark, path):
        raise FileNotFoundError(f"customer table not found: {path}")
    if fmt == "csv":
        head, parsed = _parsed(spark, path, multi_line)
        _require(head, [ID_COL] + FEATURES + ([TARGET_COL] if with_target else []))
        parsed = materialize(parsed, "customers-parsed")
        wide = parsed.where(_too_wide(F.col(RECORD), len(head))).select(F.col(RECORD).alias("record"))
        if quarantine:
            wide.write.mode("overwrite").parquet(quarantine)
        else:
            n = wide.count()
            if n:
                raise ValueError(f"{n} records have more cells than the header's {len(head)}")
        df = parsed.where(~_too_wide(F.col(RECORD), len(head)))
        # cells that a CSV reader of data frames takes for missing
        df = df.select(*[F.when(F.col(f"`{c}`").isin(MISSING_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in head])
    else:
        df = spark.read.format(fmt).load(path)
    schema = raw_schema(with_target and TARGET_COL in df.columns)
    require_columns(df, schema.fieldNames())
    return df.select(*[F.col(f.name).cast("string").alias(f.name) for f in schema.fields])


def scan_inference(raw: DataFrame, fill: float = 0.0) -> DataFrame:
    """Inference input: id plus the 19 cleaned features; the target is optional
    and ignored."""
    from keepwise.operators.clean import clean_customers

    require_columns(raw, [ID_COL] + FEATURES)
    return clean_customers(raw.select(ID_COL, *FEATURES), fill=fill, with_target=False)
