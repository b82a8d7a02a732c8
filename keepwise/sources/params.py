"""Fitted parameters as parquet tables (encoder, linear model, neural model).

A saved artifact is a folder of small parquet tables, readable by any engine;
nothing is pickled.
"""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np

    from keepwise.operators.encode import Encoder


def save_encoder(enc: Encoder, spark: SparkSession, path: str) -> str:
    enc.scaler_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    enc.onehot_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/onehot")
    order = spark.createDataFrame([(json.dumps({"numeric": [c for c, _, _ in enc.numeric],
                                                "categorical": [c for c, _ in enc.categories]}),)], "layout STRING")
    order.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
    return path


def load_encoder(spark: SparkSession, path: str) -> Encoder:
    from keepwise.operators.encode import Encoder

    layout = json.loads(spark.read.parquet(f"{path}/layout").first()["layout"])
    scaler = spark.read.parquet(f"{path}/scaler")
    onehot = spark.read.parquet(f"{path}/onehot")
    return Encoder.from_tables(scaler, onehot, layout["numeric"], layout["categorical"])


def model_table(spark: SparkSession, layers: list[tuple[str, str, list[list[float]] | list[float]]],
                version: int = 1) -> DataFrame:
    """``(version, layer, kind, rows, cols, values ARRAY<DOUBLE>)``, row-major."""
    rows = []
    for name, kind, arr in layers:
        if arr and isinstance(arr[0], (list, tuple)):
            r, c = len(arr), len(arr[0])
            flat = [float(v) for row in arr for v in row]
        else:
            r, c = 1, len(arr)
            flat = [float(v) for v in arr]
        rows.append((version, name, kind, r, c, flat))
    return spark.createDataFrame(rows, "version INT, layer STRING, kind STRING, rows INT, cols INT, values ARRAY<DOUBLE>")


def save_model(table: DataFrame, path: str) -> str:
    table.coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_model(spark: SparkSession, path: str, version: int | None = None) -> list[tuple[str, str, list]]:
    """Layers of the newest (or the given) version, as nested lists."""
    t = spark.read.parquet(path)
    v = version if version is not None else t.agg(F.max("version")).first()[0]
    out = []
    for r in t.filter(F.col("version") == v).orderBy("layer").collect():
        vals = list(r["values"])
        if r["rows"] > 1 or r["kind"] == "matrix":
            vals = [vals[i * r["cols"]:(i + 1) * r["cols"]] for i in range(r["rows"])]
        out.append((r["layer"], r["kind"], vals))
    return out


# ---------------------------------------------------------------------------
# versions of a model in training
# ---------------------------------------------------------------------------
def _folders(spark: SparkSession, path: str) -> list[str]:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []


def save_checkpoint(spark: SparkSession, path: str, version: int, arrays: dict[str, "np.ndarray"], facts: dict) -> None:
    """Write one version (named arrays and a JSON of facts), then its commit marker: a version
    without a marker was not finished and counts for nothing; writing it again replaces it."""
    rows = [(n, [float(x) for x in a], None) for n, a in arrays.items()] + [("facts", [], json.dumps(facts))]
    table = spark.createDataFrame(rows, "name STRING, values ARRAY<DOUBLE>, facts STRING")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{version:08d}")
    marker = spark.createDataFrame([(version, len(rows))], "version INT, entries INT")
    marker.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/{version:08d}")


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose marker is written to the end, oldest first."""
    return sorted(int(n) for n in _folders(spark, f"{path}/commits")
                  if n.isdigit() and "_SUCCESS" in _folders(spark, f"{path}/commits/{n}"))


def load_checkpoint(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict, dict] | None:
    """(arrays, facts) of the newest committed version, or of the one asked for; None if there is none."""
    import numpy as np

    have = committed_versions(spark, path)
    if version is None and not have:
        return None
    if version is not None and version not in have:
        raise ValueError(f"version {version} is not committed")
    rows = spark.read.parquet(f"{path}/versions/{have[-1] if version is None else version:08d}").collect()
    return ({r["name"]: np.array(r["values"], dtype=float) for r in rows if r["facts"] is None},
            json.loads(next(r["facts"] for r in rows if r["facts"] is not None)))
