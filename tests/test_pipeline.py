"""The four end-to-end runs on a customer CSV (the reference's input format)."""

from pyspark.sql import functions as F

from keepwise.plans import pipeline
from keepwise.session import scratch_path
from keepwise.sources import fixture
from tests.conftest import SF_MID


def test_train_score_evaluate_explain_from_csv(spark):
    csv = scratch_path(spark, "customers_csv")
    fixture.raw_customers(spark, SF_MID).write.mode("overwrite").option("header", True).csv(csv)
    raw = pipeline.load_customers(spark, csv)
    assert raw.count() == 1500 and set(raw.dtypes) == {(c, "string") for c in raw.columns}

    for kind in ("logit", "mlp"):
        out = scratch_path(spark, f"run_{kind}")
        info = pipeline.run_training(spark, raw, out, kind=kind, epochs=15, patience=5)
        dist = {r.risk_level: r.n for r in pipeline.run_scoring(spark, raw.drop("Churn"), out, out).collect()}
        assert sum(dist.values()) == 1500
        preds = spark.read.option("header", True).csv(f"{out}/predictions_csv")
        assert preds.count() == 1500
        m = pipeline.run_evaluation(spark, raw, out, out).first()
        assert 0.6 < m.roc_auc <= 1.0 and m.top10_capture_pct is not None
        rec = spark.read.text(f"{out}/threshold_recommendation", wholetext=True).first().value
        assert rec.startswith("Recommended threshold (churn prevention): ")
        hints = pipeline.run_explain(spark, raw, out, out, top_k=5, n_repeats=2).collect()
        assert len(hints) == 5 and all(h.hint for h in hints)
        if kind == "mlp":
            assert info["best_epoch"] >= 1


def test_missing_path_and_columns(spark):
    import pytest

    with pytest.raises(FileNotFoundError):
        pipeline.load_customers(spark, "/nonexistent/customers.csv")
    p = scratch_path(spark, "bad_csv")
    spark.createDataFrame([("1", "2")], "customerID STRING, tenure STRING").write.option("header", True).csv(p)
    with pytest.raises(ValueError, match="lacks"):
        pipeline.load_customers(spark, p)
