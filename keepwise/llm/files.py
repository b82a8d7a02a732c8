"""Binary files in the shared folder, written by tasks.

A task writes under a name of its own attempt and renames at the end; the final
name depends only on the partition, so a repeated or speculative attempt
replaces the same file with the same bytes. Paths are URIs (file, hdfs, s3,
gs), resolved with pyarrow's file systems.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import SparkSession

from keepwise.session import scratch_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` as a URI."""
    path = scratch_path(spark, name)
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return path if "://" in path else "file://" + path


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def writing(uri: str):
    """Open ``uri`` for writing; it appears whole or not at all."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, path)


@contextlib.contextmanager
def reading(uri: str):
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as source:
        yield source
