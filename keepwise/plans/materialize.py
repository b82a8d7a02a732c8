"""Lineage cuts.

A materialised result is written as a parquet table under the shared
checkpoint folder (``spark.checkpoint.dir``) and read back: one job, columnar,
and a lost executor re-reads files instead of recomputing a sort. Never a local
checkpoint: those live on executor disks and die with them. (A reliable
``DataFrame.checkpoint`` would compute its input twice unless cached.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from keepwise.session import scratch_path


def materialize_at(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared checkpoint folder; return the re-read table and its path."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return the re-read table."""
    return materialize_at(df, name)[0]
