"""Physical plans: pruning and pushdown reach the parquet scans; ranks use a
range-partitioned sort; no single-partition exchange over row-level data."""

from pyspark.sql import functions as F

from keepwise.operators import profile
from keepwise.operators.score import predictions
from keepwise.session import scratch_path
from keepwise.sources import fixture, readers
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fixture_scans_read_only_needed_columns(spark):
    plan = _plan(fixture.customer_base(spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double,c_mktsegment:string>" in plan
    assert "c_name" not in plan and "o_orderkey" not in plan


def test_segment_filter_pushed_to_parquet(spark):
    path = scratch_path(spark, "raw_customers")
    fixture.raw_customers(spark, SF_SMALL).write.mode("overwrite").parquet(path)
    raw = readers.scan_customers(spark, path, fmt="parquet")
    df = profile.filter_segments(raw, ["Month-to-month"], ["Mailed check"]).select("customerID")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "Contract" in plan.split("PushedFilters")[1].split("]")[0]


def test_sort_is_range_partitioned(spark):
    preds = predictions(fixture.raw_customers(spark, SF_SMALL).transform(
        lambda d: __import__("keepwise.operators.clean", fromlist=["x"]).clean_customers(d)))
    plan = _plan(preds.orderBy(F.col("churn_probability").desc(), "customerID"))
    assert "rangepartitioning" in plan


def test_range_partitions_balanced_under_hot_score(spark):
    """A third of the rows share one score; the unique (score, id) key still
    spreads them over the range partitions."""
    df = spark.range(300_000).select(
        F.col("id").cast("string").alias("customerID"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.rand(1)).alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in df.orderBy(F.col("p").desc(), F.col("customerID").asc())
                 .select(F.spark_partition_id().alias("pid")).groupBy("pid").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * (300_000 / 8)
