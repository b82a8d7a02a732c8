"""Reuse of written intermediate tables across queries of one session.

The customer table is an aggregate of ``orders``; deriving it again for every
report would re-scan the largest table each time. A derived table is written
once under the shared checkpoint folder and reused while its inputs are
unchanged: the key holds the application id and path, length and modification
time of every input file (read through the Hadoop FileSystem API, so it works on
HDFS/S3/ABFS alike). A missing table (a cleaned folder) is simply derived again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepwise.plans.materialize import materialize_at

_REGISTRY: dict[tuple, str] = {}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def input_signature(spark: SparkSession, paths: list[str]) -> tuple:
    """Path, length and modification time of every file below the inputs."""
    sig = []
    for p in paths:
        jpath, fs = _fs(spark, p)
        if not fs.exists(jpath):
            sig.append((p, -1, -1))
            continue
        files = fs.listFiles(jpath, True)
        while files.hasNext():
            f = files.next()
            sig.append((f.getPath().toString(), int(f.getLen()), int(f.getModificationTime())))
    return tuple(sorted(sig))


def _exists(spark: SparkSession, path: str) -> bool:
    jpath, fs = _fs(spark, path)
    return bool(fs.exists(jpath))


def reuse_or_write(spark: SparkSession, name: str, inputs: list[str],
                   build: Callable[[], DataFrame]) -> DataFrame:
    """The written table for ``name`` over ``inputs``, writing it if needed."""
    key = (spark.sparkContext.applicationId, name, input_signature(spark, inputs))
    path = _REGISTRY.get(key)
    if path and _exists(spark, path):
        return spark.read.parquet(path)
    df, path = materialize_at(build(), name)
    _REGISTRY[key] = path
    return df


def clear() -> None:
    _REGISTRY.clear()
