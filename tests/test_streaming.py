"""File-stream scoring: new files are picked up incrementally and, with the
checkpoint, each is scored exactly once across restarts."""

from pyspark.sql import functions as F

from keepwise.session import scratch_path
from keepwise.sources import fixture
from keepwise.streaming import scoring
from tests.conftest import SF_SMALL


def test_incremental_exactly_once(spark):
    raw = fixture.raw_customers(spark, SF_SMALL)
    src, out, ck = (scratch_path(spark, n) for n in ("s_in", "s_out", "s_ck"))
    first = raw.filter(F.col("customerID").cast("int") % 2 == 0)
    second = raw.filter(F.col("customerID").cast("int") % 2 == 1)
    first.write.mode("append").parquet(src)
    scoring.start_scoring(spark, src, out, ck).awaitTermination()
    n1 = spark.read.parquet(out).count()
    assert n1 == first.count()
    second.write.mode("append").parquet(src)
    scoring.start_scoring(spark, src, out, ck).awaitTermination()      # restart on the same checkpoint
    res = spark.read.parquet(out)
    assert res.count() == raw.count() == res.select("customerID").distinct().count()
    assert set(r.risk_level for r in res.select("risk_level").distinct().collect()) <= {"Low", "Medium", "High"}
