"""Session construction and the shared checkpoint folder.

The library never picks a machine-local folder on a cluster: the folder for
``DataFrame.checkpoint`` comes from ``spark.checkpoint.dir`` (a shared path the
cluster names). Only a local-mode session without that setting gets a scratch
folder of its own, which is what tests and the local bench use.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings every entry point shares. AQE re-plans joins and partition
# counts at run time; skew-join splitting is on for hot keys.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app: str = "keepwise",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Return a session with the library defaults (existing settings win)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, configuring it from the session if needed.

    Order: a folder already set on the context; else ``spark.checkpoint.dir``;
    else, in local mode only, a fresh scratch folder. A cluster session without
    the setting is an error: a node-local folder would not survive the loss of
    that node.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="keepwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp")))
        return sc.getCheckpointDir()
    raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder (HDFS/S3/ABFS)")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for written tables."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on the executors: a zip of its sources, added
    once per context (a cluster where it is installed just gets the same code again)."""
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_keepwise_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="keepwise-src-"), "keepwise_src.zip")   # read by the driver only
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("keepwise", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    sc._keepwise_shipped = True
