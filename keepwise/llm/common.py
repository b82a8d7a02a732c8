"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.plans.materialize import materialize  # noqa: F401  (re-exported)

#: Words are maximal runs of anything but these six ASCII characters.
ASCII_SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN, -1), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Bind ``value`` once: a column named inside a lambda is otherwise evaluated
    again for every element the lambda visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small_batches(batches, size: int = 512):
    """Arrow record batches cut into views of a few rows, so that Python objects of
    only those rows are alive at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


#: Most bytes of an Arrow batch. Spark by itself allows 64 MB, or 10,000 rows: whole row groups of texts.
BATCH_BYTES, _BYTES_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def lean_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from here on cuts the Arrow batches for Python at ``BATCH_BYTES``, unless
    it has a setting of its own. A batch is held by the executor and by the Python worker at a
    time; a row longer than that is a batch of its own."""
    conf = df.sparkSession.conf
    if _BYTES_SETTING not in conf.getAll:
        conf.set(_BYTES_SETTING, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """Return a Python worker's freed memory to the system. Workers serve one stage after another,
    and stay for a minute after the last; what they keep counts beside the next stage's heap."""
    import pyarrow as pa

    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


_ARROW = {"long": "int64", "int": "int32", "double": "float64", "boolean": "bool_", "binary": "binary", "string": "string"}


def map_columns(df: DataFrame, fn, schema: str, size: int | None = None) -> DataFrame:
    """``mapInArrow`` with batches as plain columns: ``fn`` takes an iterator of
    {name: values} (a NumPy array for numbers without nulls, else a list) and yields
    {name: values} in the columns of ``schema``. No data frame library is loaded in
    the workers, which stay small. ``size`` cuts the batches first."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))

    def columns(batch):
        import pyarrow as pa

        return {n: c.to_numpy(zero_copy_only=False) if c.null_count == 0
                and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type) or pa.types.is_boolean(c.type)) else c.to_pylist()
                for n, c in zip(batch.schema.names, batch.columns)}

    def run(batches):
        import pyarrow as pa

        types = [getattr(pa, _ARROW[k])() for k in kinds]
        parts = small_batches(batches, size) if size else (b for b in batches if b.num_rows)
        for out in fn(map(columns, parts)):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, types)], list(names))
        give_back()

    return lean_batches(df).mapInArrow(run, schema)


def rows_of(cols: dict, at) -> dict:
    """The rows of a slice or of an index array or mask."""
    if isinstance(at, slice):
        return {k: v[at] for k, v in cols.items()}
    import numpy as np

    at = np.flatnonzero(at) if at.dtype == bool else at
    return {k: v[at] if isinstance(v, np.ndarray) else [v[i] for i in at] for k, v in cols.items()}


def whole_groups(frames: Iterator[dict], keys: list[str]) -> Iterator[dict]:
    """Re-cut batches of a key-sorted partition so that no group is divided.
    Callers bound the size of a group, so a carried tail stays small."""
    import numpy as np

    tail = None
    for cols in frames:
        if tail is not None:
            cols = {k: np.concatenate([tail[k], v]) if isinstance(v, np.ndarray) else tail[k] + v for k, v in cols.items()}
        same = np.logical_and.reduce([cols[k] == cols[k][-1] for k in keys])
        cut = 0 if same.all() else len(same) - int(same[::-1].argmin())
        tail = rows_of(cols, slice(cut, None))
        if cut:
            yield rows_of(cols, slice(0, cut))
    if tail is not None:
        yield tail
