"""The encoding queries give every cell of the encoded table, zeros included."""

from pyspark.sql import functions as F

from keepwise.operators import encode
from keepwise.plans import catalog
from keepwise.plans.catalog import Tables
from keepwise.plans.catalog_model import _encoder, _test, _train
from tests.conftest import SF_SMALL


def test_encode_onehot_gives_every_cell(spark):
    t = Tables(spark, SF_SMALL)
    rows = catalog.QUERIES["encode_onehot"](spark, SF_SMALL)
    fitted = encode.fit_onehot(_train(t)).count()
    assert rows.columns == ["customerID", "feature", "category", "value"]
    assert rows.count() == t.clean.count() * fitted
    assert {r["value"] for r in rows.select("value").distinct().collect()} == {0.0, 1.0}
    ones = rows.groupBy("customerID", "feature").agg(F.sum("value").alias("n"))
    assert {r["n"] for r in ones.select("n").distinct().collect()} <= {0.0, 1.0}


def test_onehot_of_unseen_and_missing_values(spark):
    fitted = spark.createDataFrame([("c", "a", 0), ("c", "b", 1), ("c", None, 2)], "feature STRING, category STRING, position INT")
    df = spark.createDataFrame([("1", "b"), ("2", None), ("3", "new")], "customerID STRING, c STRING")
    got = {(r["customerID"], r["category"]): r["value"] for r in encode.encode_onehot_long(df, fitted).collect()}
    assert got == {("1", "a"): 0.0, ("1", "b"): 1.0, ("1", None): 0.0, ("2", "a"): 0.0, ("2", "b"): 0.0, ("2", None): 1.0,
                   ("3", "a"): 0.0, ("3", "b"): 0.0, ("3", None): 0.0}


def test_assemble_features_gives_every_cell(spark):
    t = Tables(spark, SF_SMALL)
    rows = catalog.QUERIES["assemble_features"](spark, SF_SMALL)
    enc = _encoder(t)
    want = enc.transform(_test(t)).select("customerID", F.posexplode("features").alias("idx", "value"))
    want = {(r["customerID"], r["idx"]): round(r["value"], 9) for r in want.collect()}
    got = {(r["customerID"], r["idx"]): r["value"] for r in rows.collect()}
    assert len(got) == rows.count() == _test(t).count() * enc.width
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in got)
