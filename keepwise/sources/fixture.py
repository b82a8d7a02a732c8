"""``customer_base``: a customer table in the churn schema built from
``customer`` and ``orders``.

The test tables hold no telecom customers, so every one of the 19 features and
the target is derived from a customer's own row and the aggregate of their
orders. One partial+final aggregation of ``orders`` on ``o_custkey`` (map-side
combine, so a hot customer costs one row per task), then an equi-join with
``customer``; the aggregate is already hash-partitioned on the key, so only
``customer`` is shuffled. A customer without orders has no months, no charges and
no services that orders stand for, and has not churned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.schema import RAW_COLUMNS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _count_if(cond):
    return F.sum(F.when(cond, 1).otherwise(0))


def customer_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed customer table: tenure/SeniorCitizen INT, MonthlyCharges DOUBLE,
    everything else STRING (``TotalCharges`` is text and blank for tenure 0)."""
    orders = read_table(spark, sf_dir, "orders")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")

    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    o = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("f"),
        F.max("o_orderdate").alias("l"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("tot"),
        F.max("o_totalprice").alias("mx"),
        _count_if(st == "F").alias("nf"),
        _count_if(st == "P").alias("np"),
        _count_if(st == "O").alias("no"),
        _count_if(pr == "1-URGENT").alias("p1"),
        _count_if(pr == "2-HIGH").alias("p2"),
        _count_if(pr == "3-MEDIUM").alias("p3"),
        _count_if(pr == "4-NOT SPECIFIED").alias("p4"),
        _count_if(pr == "5-LOW").alias("p5"),
    )
    b = (cust.join(o, cust.c_custkey == o.o_custkey, "left")
         .withColumn("tot", F.coalesce("tot", F.lit(0).cast("decimal(18,2)")))
         .withColumn("cents", (F.col("tot") * 100).cast("bigint"))
         .withColumn("ten", F.coalesce(F.floor(F.datediff(F.col("l"), F.col("f")) / 30), F.lit(0)).cast("int"))
         .withColumn("inet", F.when(F.col("c_nationkey") % 3 == 0, "Fiber optic")
                     .when(F.col("c_nationkey") % 3 == 1, "DSL").otherwise("No"))
         .withColumn("phone", F.when(F.col("nf") >= 2, "Yes").otherwise("No")))

    def addon(counter: str, limit: int):
        return (F.when(F.col("inet") == "No", "No internet service")
                .when(F.col(counter) >= limit, "Yes").otherwise("No"))

    months = F.col("ten") + 1
    seg = F.col("c_mktsegment")
    return b.select(
        F.col("c_custkey").cast("string").alias("customerID"),
        F.col("ten").alias("tenure"),
        # whole cents per month, so the charge is exact in any engine
        ((F.col("cents") - F.col("cents") % months) / months / 100).alias("MonthlyCharges"),
        F.when(F.col("ten") == 0, F.lit(" ")).otherwise(F.col("tot").cast("string")).alias("TotalCharges"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("SeniorCitizen"),
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.when(F.col("n_orders") >= 10, "Yes").otherwise("No").alias("Partner"),
        F.when(F.col("mx") > 300000, "Yes").otherwise("No").alias("Dependents"),
        F.col("phone").alias("PhoneService"),
        F.when(F.col("phone") == "No", "No phone service")
        .when(F.col("np") >= 4, "Yes").otherwise("No").alias("MultipleLines"),
        F.col("inet").alias("InternetService"),
        addon("p1", 2).alias("OnlineSecurity"),
        addon("p2", 2).alias("OnlineBackup"),
        addon("p3", 2).alias("DeviceProtection"),
        addon("p4", 2).alias("TechSupport"),
        addon("p5", 2).alias("StreamingTV"),
        addon("no", 4).alias("StreamingMovies"),
        F.when(F.col("c_custkey") % 3 == 0, "Month-to-month")
        .when(F.col("c_custkey") % 3 == 1, "One year").otherwise("Two year").alias("Contract"),
        F.when(F.col("c_acctbal") >= 5000, "Yes").otherwise("No").alias("PaperlessBilling"),
        F.when(seg == "MACHINERY", "Electronic check").when(seg == "BUILDING", "Mailed check")
        .when(seg == "AUTOMOBILE", "Bank transfer (automatic)")
        .otherwise("Credit card (automatic)").alias("PaymentMethod"),
        F.when(F.col("l") < F.lit("2000-10-01").cast("timestamp"), "Yes").otherwise("No").alias("Churn"),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer_base`` as the all-STRING table a CSV read would give."""
    base = customer_base(spark, sf_dir)
    return base.select(*[F.col(c).cast("string").alias(c) for c in RAW_COLUMNS])
