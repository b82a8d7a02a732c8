"""Sieves lose no wanted key, and the stages of the pipeline that drop or mark rows leave the other texts where they are."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL


def test_no_wanted_key_is_lost_and_few_others_are_held_back(spark):
    from keepwise.llm.sieve import Sieve

    rows = spark.range(4000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("a"), F.col("id").cast("string").alias("b"))
    wanted = rows.where("b % 5 = 0").toDF("x", "y")
    for bits in (None, 1 << 10):
        got = Sieve(wanted, ["x", "y"], bits).marked(rows, ["a", "b"], "hit")
        assert got.count() == 4000 and got.where("b % 5 = 0 AND NOT hit").count() == 0
        assert bits or got.where("hit").count() < 1.1 * 800
    assert Sieve(wanted.limit(0), ["x", "y"]).marked(rows, ["a", "b"], "hit").where("hit").count() == 0


def texts_moved(df):
    """Rows with a document in them that the shuffles of an executed query wrote."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        out, below = p.output(), p.children()
        whole = kind == "ShuffleExchangeExec" and any(out.apply(i).dataType().typeName() == "struct" for i in range(out.size()))
        own = p.metrics().apply("shuffleRecordsWritten").value() if whole else 0
        return own + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["quality_rules", "near_duplicates", "personal_data"])
def test_texts_stay_where_verdicts_are_too_many_to_broadcast(spark, name):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = texts_moved(dict(corpus_pipeline.STAGES)[name](spark, docs, SF_SMALL))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved < docs.count() / 2
