"""Structured Streaming scorer: new customer files in, scored rows out.

Cleaning, scoring and banding are row-local, so the batch operators apply to a
streaming DataFrame unchanged: no state, no watermark, exactly-once through the
file sink's commit log and the checkpoint folder (which must be on shared
storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keepwise.operators.clean import clean_customers
from keepwise.operators.score import score_customers
from keepwise.schema import ID_COL, TARGET_COL, raw_schema


def scored_stream(spark: SparkSession, input_dir: str, fmt: str = "parquet", scorer=None,
                  with_target: bool = True, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame ``(customerID, churn_probability, risk_level)``."""
    reader = spark.readStream.schema(raw_schema(with_target)).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(input_dir)
    clean = clean_customers(raw, with_target=with_target and TARGET_COL in raw.columns)
    return score_customers(clean, scorer).select(ID_COL, "churn_probability", "risk_level")


def start_scoring(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str,
                  fmt: str = "parquet", scorer=None, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append scored rows to parquet under ``output_dir``."""
    writer = (scored_stream(spark, input_dir, fmt, scorer, max_files_per_trigger=max_files_per_trigger)
              .writeStream.format("parquet")
              .option("path", output_dir).option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
