"""Registered queries, part 3: sinks read back, parameter persistence, trained
models, streaming. Writes go under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.functions.scoring import fixed_scorer, rational_share, sig_round
from keepwise.operators import importance, metrics, model, score
from keepwise.plans import oracle as O
from keepwise.plans.catalog import Tables, query
from keepwise.plans.catalog_model import ENC, PI_INTERCEPT, PI_WEIGHTS, _encoder, _test
from keepwise.plans.combine import side_by_side
from keepwise.plans.reuse import input_signature
from keepwise.schema import ID_COL, TARGET_COL
from keepwise.session import scratch_path
from keepwise.sources import params, sinks
from keepwise.streaming import scoring as streaming


# ---------------------------------------------------------------------------
# sinks, read back
# ---------------------------------------------------------------------------
@query("write_customer_ids", O.w(O.CLEAN, "SELECT customerID FROM clean"))
def q_write_customer_ids(spark, sf):
    path = sinks.write_customer_ids(Tables(spark, sf).clean, scratch_path(spark, "customer_ids"))
    return spark.read.schema(f"{ID_COL} STRING").option("header", True).csv(path)


@query("write_predictions_csv", O.w(O.SCORED, "SELECT customerID, churn_probability, risk_level FROM scored"))
def q_write_predictions_csv(spark, sf):
    path = sinks.write_predictions_csv(Tables(spark, sf).preds, scratch_path(spark, "predictions_csv"))
    return sinks.read_predictions(spark, path, "csv")


@query("write_predictions_json", O.w(O.SCORED, "SELECT customerID, churn_probability, risk_level FROM scored"))
def q_write_predictions_json(spark, sf):
    path = sinks.write_predictions_json(Tables(spark, sf).preds, scratch_path(spark, "predictions_json"))
    return sinks.read_predictions(spark, path, "json")


_READ_METRICS_SQL = O.w(O.TEST + f""",
cm AS (SELECT count_if(y = 0 AND score < 0.5::DOUBLE) AS tn, count_if(y = 0 AND score >= 0.5::DOUBLE) AS fp,
              count_if(y = 1 AND score < 0.5::DOUBLE) AS fn, count_if(y = 1 AND score >= 0.5::DOUBLE) AS tp FROM test),
au AS (SELECT CAST(sum(CAST(a.y AS HUGEINT) * (2 * (SELECT count(*) FROM test b WHERE b.y = 0 AND b.score < a.score)
                 + (SELECT count(*) FROM test b WHERE b.y = 0 AND b.score = a.score))) AS DOUBLE)
              / (2.0::DOUBLE * CAST(sum(a.y) AS DOUBLE) * CAST(sum(1 - a.y) AS DOUBLE)) AS roc_auc FROM test a),
k10 AS (SELECT greatest(1, CAST(round_even(n * 10 / 100, 0) AS BIGINT)) AS k, churners FROM (SELECT count(*) AS n, sum(y) AS churners FROM test)),
t10 AS (SELECT round_even(100.0::DOUBLE * sum(ranked.y) / max(k10.churners), 2) AS top10 FROM ranked, k10 WHERE ranked.rn <= k10.k),
dz AS (SELECT greatest(1, n // 10) AS size FROM (SELECT count(*) AS n FROM test)),
dd AS (SELECT least(10, (rn - 1) // size + 1) AS decile, y FROM ranked, dz),
cum AS (SELECT round_even(100.0::DOUBLE * sum(CASE WHEN decile <= 2 THEN y ELSE 0 END) / sum(y), 2) AS c20,
               round_even(100.0::DOUBLE * sum(CASE WHEN decile <= 3 THEN y ELSE 0 END) / sum(y), 2) AS c30 FROM dd)""",
    """SELECT au.roc_auc, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE 0.0::DOUBLE END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0::DOUBLE END AS f1_score,
  CAST(tn + tp AS DOUBLE) / CAST(tn + fp + fn + tp AS DOUBLE) AS accuracy,
  t10.top10 AS top10_capture_pct, cum.c20 AS cum_pct_at_20, cum.c30 AS cum_pct_at_30
FROM cm, au, t10, cum""")


@query("read_metrics", _READ_METRICS_SQL)
def q_read_metrics(spark, sf):
    t = Tables(spark, sf)
    return sinks.read_metrics(spark, sinks.write_metrics(t.test_scores, t.ranked, scratch_path(spark, "metrics")))


def _write_metrics_sql() -> str:
    """The rows of the document from the SQL of its parts."""
    from keepwise.plans.catalog import ORACLE

    head = f"WITH {O.TEST}"
    body = lambda name: ORACLE[name][len(head):] if ORACLE[name].startswith(head) else None
    parts = {name: body(name) for name in ("roc_auc", "precision_recall_f1", "accuracy", "confusion_matrix", "topn_capture", "decile_gain", "roc_curve")}
    # each part is ", more AS (...) SELECT ..." or "\nSELECT ...": a subquery of its own over the same CTEs
    nested = {k: f"(WITH {v.lstrip(chr(10)).lstrip(',').lstrip()})" if v.lstrip().startswith(",") else f"({v})" for k, v in parts.items()}
    wide = lambda src, section, pos, names: [
        f"SELECT '{section}' AS section, CAST({pos if isinstance(pos, str) else pos[i]} AS INTEGER) AS position, '{n}' AS name, "
        f"CAST({n} AS DOUBLE) AS value FROM {nested[src]}" for i, n in enumerate(names)]
    rows = (wide("roc_auc", "summary", "0", ["roc_auc"]) + wide("precision_recall_f1", "summary", "0", ["precision", "recall", "f1_score", "threshold"])
            + wide("accuracy", "summary", "0", ["accuracy"]) + wide("confusion_matrix", "confusion_matrix", [0, 1, 2, 3], ["tn", "fp", "fn", "tp"])
            + wide("topn_capture", "top_n_capture", "top_pct", ["capture_pct", "n_captured"])
            + wide("decile_gain", "decile_gain", "decile", ["pct_contacted", "churn_in_decile", "pct_churn_decile", "cumulative_pct_churn"])
            + wide("roc_curve", "roc", "point", ["fpr", "tpr"]))
    return O.w(O.TEST, " UNION ALL ".join(rows))


@query("write_metrics", _write_metrics_sql())
def q_write_metrics(spark, sf):
    """The whole metrics document and its ROC points, written, read back and listed."""
    t = Tables(spark, sf)
    return sinks.metrics_rows(spark, sinks.write_metrics(t.test_scores, t.ranked, scratch_path(spark, "metrics_doc")))


def _sweep_readback_sql() -> str:
    from keepwise.plans.catalog import _sweep_sql

    return O.w(O.TEST + _sweep_sql(), "SELECT * FROM sw")


@query("write_threshold_table", _sweep_readback_sql())
def q_write_threshold_table(spark, sf):
    sweep = metrics.threshold_sweep(Tables(spark, sf).test_scores)
    path = sinks.write_threshold_table(sweep, scratch_path(spark, "threshold_table"))
    return spark.read.schema(sweep.schema).option("header", True).csv(path)


def _rec_text_sql() -> str:
    from keepwise.plans.catalog import ORACLE

    rec = ORACLE["recommend_threshold"]
    head, tail = rec.rsplit("\nSELECT threshold, precision, recall, f1_score, eligible,", 1)
    inner = "SELECT threshold, precision, recall, f1_score, eligible," + tail
    return f"{head}\nSELECT '{fixed.RECOMMEND_HEADER.split('{threshold}')[0]}' || printf('%.2f', threshold) || chr(10) || chr(10) || justification AS value FROM ({inner})"


@query("write_recommendation", _rec_text_sql())
def q_write_recommendation(spark, sf):
    rec = metrics.recommend_threshold(metrics.threshold_sweep(Tables(spark, sf).test_scores))
    path = sinks.write_recommendation(rec, scratch_path(spark, "recommendation"))
    txt = spark.read.text(path, wholetext=True)
    return txt.select(F.regexp_replace("value", "\n$", "").alias("value"))


# ---------------------------------------------------------------------------
# parameter persistence
# ---------------------------------------------------------------------------
@query("save_encoder", O.w(ENC, "SELECT feature, category, position FROM cats"))
def q_save_encoder(spark, sf):
    enc = _encoder(Tables(spark, sf))
    path = params.save_encoder(enc, spark, scratch_path(spark, "encoder"))
    return spark.read.parquet(f"{path}/onehot")


@query("load_encoder", O.w(ENC, f"""SELECT feature, {O.sig_round('mean')} AS mean,
  {O.sig_round('CASE WHEN std = 0 OR std IS NULL THEN 1.0::DOUBLE ELSE std END')} AS scale FROM scaler"""))
def q_load_encoder(spark, sf):
    enc = _encoder(Tables(spark, sf))
    path = params.save_encoder(enc, spark, scratch_path(spark, "encoder"))
    loaded = params.load_encoder(spark, path)
    return loaded.scaler_table(spark).select("feature", sig_round(F.col("mean")).alias("mean"),
                                             sig_round(F.col("scale")).alias("scale"))


# ---------------------------------------------------------------------------
# trained models (rows-only checks: results depend on the optimiser)
# ---------------------------------------------------------------------------
_TRAINED: dict = {}   # by application, kind and the state of every input file


def _model_key(spark, sf, kind):
    return spark.sparkContext.applicationId, kind, input_signature(spark, Tables(spark, sf).inputs)



def _design(t: Tables, enc):
    return enc.transform(t.split, keep=[TARGET_COL, "split"]).withColumnRenamed(TARGET_COL, "y")


def trained_logit(spark, sf):
    key = _model_key(spark, sf, "logit")
    if key not in _TRAINED:
        t = Tables(spark, sf)
        enc = _encoder(t)
        design = _design(t, enc)
        m = model.train_logit(design.filter(F.col("split") == "train"))
        m.encoder = enc
        _TRAINED[key] = m
    return _TRAINED[key]


def trained_mlp(spark, sf):
    key = _model_key(spark, sf, "mlp")
    if key not in _TRAINED:
        t = Tables(spark, sf)
        enc = _encoder(t)
        p, log = model.train_mlp(_design(t, enc))
        _TRAINED[key] = (model.MLPScorer(p, enc), log)
    return _TRAINED[key]


@query("train_logit")
def q_train_logit(spark, sf):
    m = trained_logit(spark, sf)
    return m.table(m.encoder.feature_names, spark)


def _weights_sql() -> str:
    cases = " ".join(f"WHEN '{n}' THEN {O.dbl(w)}" for n, w in PI_WEIGHTS.items())
    return f"CASE name {cases} ELSE {O.dbl(0.0)} END"


def _saved_literal(spark, sf) -> tuple[str, list[str]]:
    """The fixed weights as a one-layer network over this table's encoded columns, saved; its path and the column names."""
    names = _encoder(Tables(spark, sf)).feature_names
    layers = [("dense_0_kernel", "matrix", [[PI_WEIGHTS.get(n, 0.0)] for n in names]), ("dense_0_bias", "vector", [PI_INTERCEPT])]
    return params.save_model(params.model_table(spark, layers), scratch_path(spark, "model")), names


@query("save_model", O.w(ENC, f"""SELECT 'dense_0_kernel' AS layer, 'matrix' AS kind, CAST(idx AS INTEGER) AS idx, {_weights_sql()} AS value FROM names
UNION ALL SELECT 'dense_0_bias', 'vector', 0, {O.dbl(PI_INTERCEPT)}"""))
def q_save_model(spark, sf):
    path, _ = _saved_literal(spark, sf)
    table = spark.read.parquet(path)
    return table.select("layer", "kind", F.posexplode("values").alias("idx", "value"))


@query("load_model", O.w(O.TEST, "SELECT customerID, score FROM test"))
def q_load_model(spark, sf):
    """A saved model loaded back and scored over the encoded test rows, numbers unscaled."""
    path, _ = _saved_literal(spark, sf)
    net = model.MLPParams.from_layers(params.load_model(spark, path))
    scorer = importance.linear_scorer(net.mats[0][:, 0].tolist(), float(net.biases[0][0]), rational_share)
    t = Tables(spark, sf)
    design = _encoder(t).transform(_test(t), scale=False)
    return design.select(ID_COL, scorer.score(F.col("features")).alias("score"))


@query("mlp_permutation_importance")
def q_mlp_permutation_importance(spark, sf):
    scorer, _ = trained_mlp(spark, sf)
    t = Tables(spark, sf)
    design = scorer.encoder.transform(_test(t), keep=[TARGET_COL]).withColumnRenamed(TARGET_COL, "y")
    return importance.permutation_importance(design, scorer.params, scorer.encoder.feature_names)


@query("train_mlp")
def q_train_mlp(spark, sf):
    _, log = trained_mlp(spark, sf)
    return log.table(spark)


@query("early_stopping")
def q_early_stopping(spark, sf):
    _, log = trained_mlp(spark, sf)
    return log.table(spark).filter("is_best")


PATH_EPOCHS, PATH_PATIENCE = 12, 3
_PATH_Z = f"z + ({O.dbl(9.0)} - CAST(epoch AS DOUBLE)) / {O.dbl(4.0)}"


@query("best_epoch", O.w(O.SPLIT, f"""SELECT best_epoch, best_val_loss, epochs_run FROM (
  SELECT *, max(CASE WHEN epoch <= epochs_run THEN epoch END) OVER () AS last FROM (
    SELECT *, coalesce(min(CASE WHEN epoch - best_epoch >= {PATH_PATIENCE} THEN epoch END) OVER (), max(epoch) OVER ()) AS epochs_run FROM (
      SELECT epoch, val_loss, min(val_loss) OVER so_far AS best_val_loss, arg_min(epoch, (val_loss, epoch)) OVER so_far AS best_epoch FROM (
        SELECT epoch, round_even(avg(pow(y - (0.5::DOUBLE + 0.5::DOUBLE * (s / (1.0::DOUBLE + abs(s))))  , 2)), 10) AS val_loss
        FROM (SELECT CAST(epoch AS INTEGER) AS epoch, y, {_PATH_Z} AS s
              FROM (SELECT CAST(Churn AS DOUBLE) AS y, {O.Z} AS z FROM split WHERE split = 'validation'), range(1, {PATH_EPOCHS + 1}) r(epoch))
        GROUP BY epoch)
      WINDOW so_far AS (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))) WHERE epoch = last"""))
def q_best_epoch(spark, sf):
    """Early stopping over the validation losses of a path of scorers whose intercept falls from epoch to epoch."""
    val = Tables(spark, sf).split.filter(F.col("split") == "validation")
    rows = val.select(F.col(TARGET_COL).cast("double").alias("y"), fixed_scorer().z().alias("z"),
                      F.explode(F.sequence(F.lit(1), F.lit(PATH_EPOCHS))).alias("epoch"))
    p = rational_share(F.col("z") + (F.lit(9.0) - F.col("epoch")) / F.lit(4.0))
    losses = rows.groupBy("epoch").agg(F.bround(F.avg(F.pow(F.col("y") - p, 2)), 10).alias("val_loss"))
    return model.early_stopping(losses, PATH_PATIENCE)


@query("mlp_scores")
def q_mlp_scores(spark, sf):
    scorer, _ = trained_mlp(spark, sf)
    return score.predictions(Tables(spark, sf).clean, scorer)


@query("mlp_test_metrics")
def q_mlp_test_metrics(spark, sf):
    scorer, _ = trained_mlp(spark, sf)
    scores = score.scored_outcomes(_test(Tables(spark, sf)), scorer)
    return side_by_side(metrics.roc_auc(scores), metrics.binary_metrics(scores))


@query("logit_test_metrics")
def q_logit_test_metrics(spark, sf):
    m = trained_logit(spark, sf)
    scores = score.scored_outcomes(_test(Tables(spark, sf)), m)
    return side_by_side(metrics.roc_auc(scores), metrics.binary_metrics(scores))


# ---------------------------------------------------------------------------
# streaming: the same scorer over a file stream
# ---------------------------------------------------------------------------
@query("stream_scores", O.w(O.SCORED, "SELECT customerID, churn_probability, risk_level FROM scored"))
def q_stream_scores(spark, sf):
    src, out, ck = (scratch_path(spark, n) for n in ("stream_in", "stream_out", "stream_ck"))
    Tables(spark, sf).raw.write.mode("overwrite").parquet(src)     # the arriving customer files
    q = streaming.start_scoring(spark, src, out, ck, max_files_per_trigger=2)
    q.awaitTermination()
    return spark.read.parquet(out)
