"""Trainers, parameter tables and scoring paths (quality and round trips; trained
numbers are never compared bit for bit)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.operators import metrics, model, score
from keepwise.plans.catalog import Tables
from keepwise.plans.catalog_io import _design
from keepwise.plans.catalog_model import _encoder
from keepwise.session import scratch_path
from keepwise.sources import params
from tests.conftest import SF_MID


def test_mlp_learns_and_round_trips(spark):
    t = Tables(spark, SF_MID)
    enc = _encoder(t)
    design = _design(t, enc)
    p, log = model.train_mlp(design, epochs=25, patience=5)
    losses = [h[1] for h in log.history]
    assert all(0 < acc <= 1 and 0 < val_acc <= 1 for _, _, acc, _, val_acc in log.history)
    assert losses[-1] < losses[0]
    assert 1 <= log.best_epoch <= log.epochs_run <= 25
    scorer = model.MLPScorer(p, enc)
    test = t.split.filter(F.col("split") == "test")
    auc = metrics.roc_auc(score.scored_outcomes(test, scorer)).first().roc_auc
    assert auc > 0.6

    path = params.save_model(params.model_table(spark, p.layers()), scratch_path(spark, "mlp"))
    p2 = model.MLPParams.from_layers(params.load_model(spark, path))
    X = np.random.default_rng(0).normal(size=(50, enc.width))
    assert np.allclose(p.forward(X), p2.forward(X))


def test_logit_and_encoder_round_trip(spark):
    t = Tables(spark, SF_MID)
    enc = _encoder(t)
    design = _design(t, enc)
    m = model.train_logit(design.filter(F.col("split") == "train"))
    m.encoder = enc
    test = t.split.filter(F.col("split") == "test")
    auc = metrics.roc_auc(score.scored_outcomes(test, m)).first().roc_auc
    assert auc > 0.6
    path = params.save_encoder(enc, spark, scratch_path(spark, "enc"))
    enc2 = params.load_encoder(spark, path)
    assert enc2.feature_names == enc.feature_names
    assert np.allclose([s for _, _, s in enc2.numeric], [s for _, _, s in enc.numeric])


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(0,)] * 75 + [(1,)] * 25, "y INT")
    _, w = model.class_weight_column(df, "y")
    assert w == {0: 100 / 150, 1: 100 / 50}


def test_mlp_full_batch_mode_learns(spark):
    t = Tables(spark, SF_MID)
    enc = _encoder(t)
    p, log = model.train_mlp(_design(t, enc), epochs=8, patience=3, batch_size=None)
    assert log.epochs_run >= 1 and log.history[-1][1] < log.history[0][1] * 1.5
    test = t.split.filter(F.col("split") == "test")
    auc = metrics.roc_auc(score.scored_outcomes(test, model.MLPScorer(p, enc))).first().roc_auc
    assert auc > 0.6


def test_fitted_weights_do_not_depend_on_partitions(spark):
    t = Tables(spark, SF_MID)
    design = _design(t, _encoder(t))
    for rows, batch in ((100_000, 32), (300, 32), (300, None)):       # one worker, five workers, full batch over five
        two, eight = (model.train_mlp(design.repartition(n), epochs=3, worker_rows=rows, batch_size=batch)[0].flat() for n in (2, 8))
        assert np.array_equal(two, eight), (rows, batch)


def test_training_resumes_where_it_was_cut(spark):
    t = Tables(spark, SF_MID)
    design = _design(t, _encoder(t))
    whole, log = model.train_mlp(design, epochs=6, patience=3)
    folder = scratch_path(spark, "checkpoints")

    def cut(so_far):
        if len(so_far.history) == 3:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        model.train_mlp(design, epochs=6, patience=3, checkpoint=folder, after_epoch=cut)
    versions = params.committed_versions(spark, folder)
    assert versions and versions == sorted({h[0] for h in log.history[:3] if h[3] == min(x[3] for x in log.history[:h[0]])})
    # a version without its marker was not finished
    params.save_checkpoint(spark, folder, 9, {"theta": np.zeros(3)}, {"epoch": 9})
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/{9:08d}/_SUCCESS")
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, False)
    assert params.committed_versions(spark, folder) == versions
    again, log2 = model.train_mlp(design, epochs=6, patience=3, checkpoint=folder, resume=True)
    assert np.array_equal(whole.flat(), again.flat()) and log2.history == log.history and log2.best_epoch == log.best_epoch
    assert params.load_checkpoint(spark, scratch_path(spark, "none")) is None
    with pytest.raises(ValueError):
        params.load_checkpoint(spark, folder, 9)


@pytest.mark.parametrize("losses,patience,want", [([3, 2, 1], 2, (3, 1, 3)), ([1, 2, 3, 0], 2, (1, 1, 3)), ([2, 1, 1, 1, 0], 3, (5, 0, 5)), ([2, 1, 1, 1, 1, 0], 3, (2, 1, 5)),
                                                  ([2, 1, 1, 0.5, 1, 1], 3, (4, 0.5, 6)), ([5], 1, (1, 5, 1))])
def test_early_stopping(spark, losses, patience, want):
    h = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)], "epoch INT, val_loss DOUBLE")
    assert tuple(model.early_stopping(h, patience).first()) == want


def test_logit_against_a_plain_solver(spark):
    """Newton's method on the class-weighted likelihood."""
    rng = np.random.default_rng(2)
    X = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(X @ [1.0, -0.5, 0.2] - 1)))).astype(int)
    design = spark.createDataFrame([(int(b), [float(v) for v in a]) for a, b in zip(X, y)], "y INT, features ARRAY<DOUBLE>")
    m = model.train_logit(design)
    w = np.where(y == 1, 400 / (2 * y.sum()), 400 / (2 * (400 - y.sum())))
    A, beta = np.column_stack([X, np.ones(400)]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-A @ beta))
        beta += np.linalg.solve((A * (w * p * (1 - p))[:, None]).T @ A, A.T @ (w * (y - p)))
    assert np.allclose([*m.weights, m.intercept], beta, atol=1e-4)


def test_every_scorer_serves_whatif_drivers_and_scoring(spark):
    """Fixed, linear and neural scorers share one contract: ``transform`` adds ``p_raw``."""
    from keepwise.functions.scoring import fixed_scorer
    from keepwise.operators import explain, profile

    t = Tables(spark, SF_MID)
    enc = _encoder(t)
    linear = model.LinearModel([0.0] * enc.width, 0.25, enc)
    linear.weights[enc.feature_names.index("tenure")] = -1.0
    neural = model.MLPScorer(model.MLPParams.init(enc.width, (4, 2), 1, 0.0), enc)
    clean = t.clean.limit(60)
    median = profile.global_median(clean, "MonthlyCharges")
    for scorer in (fixed_scorer(), linear, neural):
        p = {r.customerID: r.p_raw for r in score.score_customers(clean, scorer).collect()}
        rows = explain.whatif_scores(clean, [{"tenure": 0}, {"Contract": "Two year"}], scorer).collect()
        assert len(rows) == 120
        for r in rows:
            assert abs(r.base_probability - p[r.customerID]) <= 1e-6
            assert abs(r.delta - (r.whatif_probability - r.base_probability)) < 1e-12
        if scorer is linear:
            assert all(r.delta >= 0 if r.scenario == 1 else r.delta == 0 for r in rows)
        ids = {r.customerID for r in explain.top3_drivers(clean, median, scorer).collect()}
        assert all(p[i] >= 0.3 for i in ids)


def test_importance_takes_any_scorer(spark):
    """One result from a linear scorer, a NumPy model, a ``pandas_udf`` and a Column function of the array."""
    import pandas as pd

    from keepwise.functions.scoring import sigmoid
    from keepwise.operators import importance

    d, rng = 45, np.random.default_rng(3)      # as wide as a trained model: the expression must not grow with d * d
    rows = [(str(i), int(rng.random() < 0.3), [float(v) for v in rng.integers(0, 5, d)]) for i in range(120)]
    design = spark.createDataFrame(rows, "customerID string, y int, features array<double>")
    w = [float(v or 7) / 64 for v in rng.integers(-20, 20, d)]

    class Plain:
        def forward(self, X):
            return 1 / (1 + np.exp(-(X @ np.array(w) + 0.5)))

    @F.pandas_udf("double")
    def batch(x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-(np.vstack(x.to_numpy()) @ np.array(w) + 0.5))))

    column = lambda x: sigmoid(F.aggregate(F.arrays_zip(x.alias("x"), F.array(*[F.lit(v) for v in w]).alias("w")),
                                           F.lit(0.5), lambda z, t: z + t["x"] * t["w"]))
    names = [f"f{j}" for j in range(d)]
    results = [{r.idx: (r.importance_mean, r.importance_std, r.baseline_auc)
                for r in importance.permutation_importance(design, s, names, n_repeats=2).collect()}
               for s in (importance.linear_scorer(w, 0.5), Plain(), batch, column)]
    assert len(results[0]) == d and any(v[0] != 0 for v in results[0].values())
    for other in results[1:]:
        assert all(other[j] == pytest.approx(results[0][j], abs=1e-12) for j in range(d))
    with pytest.raises(TypeError):
        importance.as_scorer(3, d)


def test_hash_rank_splits_a_hot_id(spark):
    """A third of all rows under one id, another part under NULL: every row ranked, no bucket above its bound."""
    from keepwise.operators import rank
    from keepwise.operators.split import stratified_split

    rows = [("hot", i) for i in range(4000)] + [(None, i) for i in range(2000)] + [(f"c{i}", i) for i in range(6000)]
    df = spark.createDataFrame(rows, "customerID STRING, k INT").withColumn("Churn", F.col("k") % 2)
    h = F.md5(F.concat(F.lit("42|"), "customerID"))
    out = rank.hash_rank(df.withColumn("_h", h), "_h", "customerID", partition_by=["Churn"], size_col="n", digits=1, bucket_rows=300)
    got = out.collect()
    assert len(got) == len(rows)
    for y in (0, 1):
        mine = sorted(got, key=lambda r: r.rn)
        mine = [r for r in mine if r.Churn == y]
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1)) and {r.n for r in mine} == {len(mine)}
        digests = [r._h or "" for r in mine]
        assert digests == sorted(digests)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Window")[0]
    sizes = {r.split: r["count"] for r in stratified_split(df.withColumn("k", F.col("k"))).groupBy("split").count().collect()}
    assert sizes == {"train": 8400, "validation": 1800, "test": 1800}


@pytest.mark.parametrize("group", [[], ["y"]])
def test_hash_rank_never_broadcasts_its_rows(spark, group):
    """The written design is small enough to be broadcast to its bucket counts, which lie in one task:
    there all rows were sorted."""
    from keepwise.operators import rank

    t = Tables(spark, SF_MID)
    rows = _design(t, _encoder(t)).withColumn("_h", F.md5(F.concat(F.lit("42|"), F.col("customerID"))))
    out = rank.hash_rank(rows, "_h", "customerID", partition_by=group, size_col="_n")
    got = out.select("y", "_h", "rn", "_n", "features").collect()
    for y in ((0, 1) if group else (None,)):
        mine = [r for r in sorted(got, key=lambda r: r.rn) if y in (None, r.y)]
        assert [r.rn for r in mine] == list(range(1, len(mine) + 1)) and {r._n for r in mine} == {len(mine)}
        assert [r._h for r in mine] == sorted(r._h for r in mine)
    shown = out.select("y", "_h", "rn", "_n", "features")
    shown.collect()
    final = shown._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BuildLeft" not in final


def test_every_worker_is_a_task_of_its_own(spark):
    t = Tables(spark, SF_MID)
    dealt, workers, _ = model._numbered(_design(t, _encoder(t)), "y", "split", 42, worker_rows=160)
    where = dealt.groupBy("worker", F.spark_partition_id().alias("p")).count().collect()
    assert workers == 8 and len(where) == 8
    assert len({r["p"] for r in where}) == 8 and max(r["count"] for r in where) <= 160
