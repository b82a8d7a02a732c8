"""End-to-end runs: train, score, evaluate, explain.

Each run reads a customer table (CSV with a header, or parquet), chains the
operators and writes its artifacts under ``out_dir`` as tables: encoder and
model parameter tables, ranked predictions, the metrics document, the threshold
table, the recommendation, the importance and hint tables. Models of both kinds
are stored as layer tables (a logistic regression is a one-layer network).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.operators import clean as clean_ops
from keepwise.operators import explain, importance, metrics, model, score
from keepwise.operators.encode import Encoder
from keepwise.operators.split import stratified_split
from keepwise.plans.materialize import materialize
from keepwise.schema import TARGET_COL
from keepwise.sources import params, readers, sinks


def load_customers(spark: SparkSession, path: str, fmt: str = "csv", with_target: bool = True) -> DataFrame:
    return readers.scan_customers(spark, path, fmt=fmt, with_target=with_target)


def _prepared(raw: DataFrame, fill: float = 0.0) -> DataFrame:
    clean = clean_ops.clean_customers(raw, fill=fill)
    clean = materialize(clean, "customers")           # several passes follow
    clean_ops.validate(raw, clean)
    return materialize(stratified_split(clean), "customers_split")


def _design(enc: Encoder, split_df: DataFrame) -> DataFrame:
    return enc.transform(split_df, keep=[TARGET_COL, "split"]).withColumnRenamed(TARGET_COL, "y")


def run_training(spark: SparkSession, raw: DataFrame, out_dir: str, kind: str = "mlp",
                 epochs: int = 200, patience: int = 10, seed: int = 42, batch_size: int | None = 32,
                 total_charges_fill: float = 0.0, resume: bool = False) -> dict:
    """Clean, validate, split, fit the encoder on train, train, save.

    The network leaves a committed version at every better epoch under
    ``checkpoints``; ``resume`` goes on from the last one."""
    split_df = _prepared(raw, total_charges_fill)
    sinks.write_customer_ids(split_df, f"{out_dir}/customer_ids")
    enc = Encoder.fit(split_df.filter(F.col("split") == "train"))
    params.save_encoder(enc, spark, f"{out_dir}/encoder")
    design = _design(enc, split_df)
    if kind == "mlp":
        p, log = model.train_mlp(design, epochs=epochs, patience=patience, seed=seed, batch_size=batch_size,
                                 checkpoint=f"{out_dir}/checkpoints", resume=resume)
        layers = p.layers()
        log.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/history")
        info = {"best_epoch": log.best_epoch, "epochs_run": log.epochs_run}
    elif kind == "logit":
        m = model.train_logit(design.filter(F.col("split") == "train"))
        layers = [("dense_0_kernel", "matrix", [[w] for w in m.weights]), ("dense_0_bias", "vector", [m.intercept])]
        info = {}
    else:
        raise ValueError(f"unknown model kind: {kind}")
    params.save_model(params.model_table(spark, layers), f"{out_dir}/model")
    dist = split_df.groupBy("split", TARGET_COL).count()
    dist.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/split_distribution")
    return {"model": f"{out_dir}/model", "encoder": f"{out_dir}/encoder", **info}


def load_scorer(spark: SparkSession, model_dir: str):
    """The saved model as a scorer: a linear one stays a Column expression."""
    enc = params.load_encoder(spark, f"{model_dir}/encoder")
    p = model.MLPParams.from_layers(params.load_model(spark, f"{model_dir}/model"))
    if len(p.mats) == 1:
        return model.LinearModel([float(w) for w in p.mats[0][:, 0]], float(p.biases[0][0]), enc)
    return model.MLPScorer(p, enc)


def run_scoring(spark: SparkSession, raw: DataFrame, model_dir: str, out_dir: str,
                total_charges_fill: float = 0.0) -> DataFrame:
    """Score new customers (no negative amounts): ranked CSV and JSON Lines; returns the band counts."""
    clean = materialize(readers.scan_inference(raw, total_charges_fill), "customers")
    clean_ops.validate(raw.drop(TARGET_COL), clean)
    preds = score.predictions(clean, load_scorer(spark, model_dir))
    preds = materialize(preds, "predictions")
    sinks.write_predictions_csv(preds, f"{out_dir}/predictions_csv")
    sinks.write_predictions_json(preds, f"{out_dir}/predictions_json")
    return score.risk_distribution(preds)


def run_evaluation(spark: SparkSession, raw: DataFrame, model_dir: str, out_dir: str,
                   threshold: float = fixed.DEFAULT_THRESHOLD, total_charges_fill: float = 0.0) -> DataFrame:
    """Metrics document, threshold table and recommendation on the test split."""
    split_df = _prepared(raw, total_charges_fill)
    test = split_df.filter(F.col("split") == "test")
    scores = materialize(score.scored_outcomes(test, load_scorer(spark, model_dir)), "test_scores")
    ranked = score.rank_by_risk(scores)
    sinks.write_metrics(scores, ranked, f"{out_dir}/metrics", threshold)
    sweep = materialize(metrics.threshold_sweep(scores), "sweep")
    sinks.write_threshold_table(sweep, f"{out_dir}/threshold_analysis")
    sinks.write_recommendation(metrics.recommend_threshold(sweep), f"{out_dir}/threshold_recommendation")
    return sinks.read_metrics(spark, f"{out_dir}/metrics")


def run_explain(spark: SparkSession, raw: DataFrame, model_dir: str, out_dir: str,
                top_k: int = fixed.TOP_K, n_repeats: int = fixed.N_REPEATS, seed: int = 42,
                total_charges_fill: float = 0.0) -> DataFrame:
    """Permutation importance on the test split, top features with labels and hints."""
    split_df = _prepared(raw, total_charges_fill)
    scorer = load_scorer(spark, model_dir)
    enc = scorer.encoder
    design = enc.transform(split_df.filter(F.col("split") == "test"), keep=[TARGET_COL]).withColumnRenamed(
        TARGET_COL, "y")
    fn = (importance.linear_scorer(scorer.weights, scorer.intercept) if isinstance(scorer, model.LinearModel)
          else scorer.params)
    pi = importance.permutation_importance(design, fn, enc.feature_names, n_repeats, seed)
    pi = materialize(pi, "importance")
    pi.write.mode("overwrite").parquet(f"{out_dir}/importance")
    hints = explain.business_hints(explain.top_k_features(pi, top_k))
    hints.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out_dir}/top_features")
    return hints
