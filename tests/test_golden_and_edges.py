"""Golden numbers from the published evaluation run, and edge inputs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.operators import clean, metrics, profile, rank, split
from keepwise.operators.campaign import campaign_plan, campaign_roi, capacity_topn
from keepwise.operators.encode import Encoder
from keepwise.schema import CATEGORICAL_FEATURES, NUMERIC_FEATURES

# The published 13-row threshold table (threshold, precision, recall, f1, tn, fp, fn, tp, n_pred_pos).
GOLDEN_SWEEP = [
    (0.2, 0.3866, 0.9644, 0.5519, 346, 430, 10, 271, 701),
    (0.25, 0.4049, 0.9466, 0.5672, 385, 391, 15, 266, 657),
    (0.3, 0.4228, 0.9253, 0.5804, 421, 355, 21, 260, 615),
    (0.35, 0.4442, 0.8932, 0.5934, 462, 314, 30, 251, 565),
    (0.39999999999999997, 0.4621, 0.8683, 0.6032, 492, 284, 37, 244, 528),
    (0.44999999999999996, 0.484, 0.8078, 0.6053, 534, 242, 54, 227, 469),
    (0.49999999999999994, 0.5204, 0.7722, 0.6218, 576, 200, 64, 217, 417),
    (0.5499999999999999, 0.5487, 0.7011, 0.6156, 614, 162, 84, 197, 359),
    (0.5999999999999999, 0.5915, 0.6441, 0.6167, 651, 125, 100, 181, 306),
    (0.6499999999999999, 0.61, 0.5623, 0.5852, 675, 101, 123, 158, 259),
    (0.7, 0.675, 0.4804, 0.5613, 711, 65, 146, 135, 200),
    (0.7499999999999998, 0.6712, 0.3488, 0.459, 728, 48, 183, 98, 146),
    (0.7999999999999998, 0.7353, 0.2669, 0.3916, 749, 27, 206, 75, 102),
]
SWEEP_SCHEMA = ("threshold DOUBLE, precision DOUBLE, recall DOUBLE, f1_score DOUBLE, tn BIGINT, fp BIGINT, "
                "fn BIGINT, tp BIGINT, n_pred_pos BIGINT")


def test_sweep_thresholds_bit_equal():
    assert fixed.sweep_thresholds() == [r[0] for r in GOLDEN_SWEEP]


def test_golden_sweep_is_consistent(spark):
    sw = spark.createDataFrame(GOLDEN_SWEEP, SWEEP_SCHEMA)
    recomputed = metrics.with_rates(sw.select("threshold", "tn", "fp", "fn", "tp"), 4).collect()
    for r, g in zip(sorted(recomputed, key=lambda r: r.threshold), GOLDEN_SWEEP):
        assert (r.precision, r.recall, r.f1_score) == g[1:4]
        assert r.tn + r.fp == 776 and r.fn + r.tp == 281


def test_golden_recommendation(spark):
    rec = metrics.recommend_threshold(spark.createDataFrame(GOLDEN_SWEEP, SWEEP_SCHEMA)).collect()
    assert len(rec) == 1
    r = rec[0]
    assert r.threshold_label == "0.50" and r.f1_score == 0.6218 and r.eligible
    assert r.justification.endswith("Recommended threshold: 0.50.")
    assert "best F1 (0.6218) while keeping recall 0.7722 and precision 0.5204" in r.justification


def test_recommendation_fallback_and_empty(spark):
    low = [(0.5, 0.9, 0.3, 0.45, 1, 1, 1, 1, 2), (0.6, 0.95, 0.5, 0.6, 1, 1, 1, 1, 2)]
    r = metrics.recommend_threshold(spark.createDataFrame(low, SWEEP_SCHEMA)).collect()[0]
    assert r.threshold == 0.6 and not r.eligible and r.justification.startswith("No threshold reached recall >= 60%")
    e = metrics.recommend_threshold(spark.createDataFrame([], SWEEP_SCHEMA)).collect()
    assert len(e) == 1 and e[0].threshold == 0.5 and e[0].justification == "Insufficient data for recommendation."


def _ranked(spark, scores_labels):
    df = spark.createDataFrame([(f"c{i:05d}", float(s), int(y), 10.0) for i, (s, y) in enumerate(scores_labels)],
                               "customerID STRING, score DOUBLE, y INT, charge DOUBLE")
    from keepwise.operators.score import rank_by_risk

    return df, rank_by_risk(df)


def test_golden_decile_sizes_and_topn(spark):
    # n = 1057 rows: deciles of 105 x 9 then 112 (not ntile), top 5 % = 53 rows
    rng = np.random.default_rng(1)
    pairs = [(round(float(s), 6), int(rng.random() < 0.27)) for s in rng.random(1057)]
    _, ranked = _ranked(spark, pairs)
    d = metrics.decile_of(F.col("rn"), 1057)
    sizes = [r["n"] for r in ranked.groupBy(d.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()]
    assert sizes == [105] * 9 + [112]
    assert metrics.topn_k(1057, 5) == 53
    dg = metrics.decile_gain(ranked).orderBy("decile").collect()
    assert sum(r.churn_in_decile for r in dg) == sum(y for _, y in pairs)
    assert dg[-1].cumulative_pct_churn == 100.0


def test_small_n_deciles_and_no_churners(spark):
    _, ranked = _ranked(spark, [(0.9 - i / 10, i % 2) for i in range(7)])
    dg = metrics.decile_gain(ranked).orderBy("decile").collect()
    assert [r.churn_in_decile for r in dg] == [0, 1, 0, 1, 0, 1, 0, 0, 0, 0]
    assert dg[-1].cumulative_pct_churn == 100.0
    _, none = _ranked(spark, [(0.5, 0)] * 5)
    assert metrics.decile_gain(none).count() == 0 and metrics.topn_capture(none).count() == 0


def test_equal_scores_auc_half_and_pairwise(spark):
    df, _ = _ranked(spark, [(0.4, i % 3 == 0) for i in range(30)])
    assert metrics.roc_auc(df).collect()[0].roc_auc == 0.5
    rng = np.random.default_rng(7)
    pairs = [(round(float(rng.integers(0, 20)) / 20, 6), int(rng.random() < 0.4)) for _ in range(400)]
    df, _ = _ranked(spark, pairs)
    s = np.array([p for p, _ in pairs])
    y = np.array([t for _, t in pairs])
    pos, neg = s[y == 1], s[y == 0]
    pairwise = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert math.isclose(metrics.roc_auc(df).collect()[0].roc_auc, pairwise, rel_tol=1e-12)


def test_roc_curve_trapezoid_equals_auc(spark):
    rng = np.random.default_rng(3)
    pairs = [(round(float(rng.integers(0, 40)) / 40, 6), int(rng.random() < 0.3)) for _ in range(500)]
    df, _ = _ranked(spark, pairs)
    pts = metrics.roc_curve(df).orderBy("point").collect()
    fpr, tpr = [p.fpr for p in pts], [p.tpr for p in pts]
    area = sum((fpr[i] - fpr[i - 1]) * (tpr[i] + tpr[i - 1]) / 2 for i in range(1, len(pts)))
    assert (fpr[0], tpr[0]) == (0.0, 0.0) and (fpr[-1], tpr[-1]) == (1.0, 1.0)
    assert math.isclose(area, metrics.roc_auc(df).collect()[0].roc_auc, rel_tol=1e-12)


def test_campaign_zero_contacts_and_capacity(spark):
    _, ranked = _ranked(spark, [(1 - i / 100, int(i % 4 == 0)) for i in range(100)])
    rows = campaign_roi(ranked, [{"pct_contacted": 0.0, "success_rate": 25.0, "cost_per_contact": 15.0,
                                  "avg_discount": 10.0}]).collect()
    assert rows[0].n_contacted == 0 and rows[0].net_benefit == 0.0 and rows[0].churn_avoided == 0.0
    assert campaign_plan(100, {"pct_contacted": 50.0}) == (20, 10)
    cap = capacity_topn(ranked, [10]).collect()[0]
    assert cap.capacity == 10 and cap.churners_captured == 3 and cap.implied_threshold == 1 - 9 / 100


def test_cleaning_edges(spark):
    raw = spark.createDataFrame(
        [("a", "1", "10.5", "", "0", " yes "), ("b", "2", "3", " ", "1", "NO"), ("c", "x", "1", "abc", "0", "maybe"),
         ("d", "3", "nan", "nan", "0", None), ("e", "4", "2", None, "0", "Yes"), ("f", "5", "-1", "12", "0", "no")],
        "customerID STRING, tenure STRING, MonthlyCharges STRING, TotalCharges STRING, SeniorCitizen STRING, Churn STRING")
    for c in CATEGORICAL_FEATURES:
        raw = raw.withColumn(c, F.lit("x"))
    c = clean.clean_customers(raw)
    got = {r.customerID: r for r in c.collect()}
    assert [got[k].TotalCharges for k in "abcdef"] == [0.0, 0.0, 0.0, 0.0, 0.0, 12.0]
    assert [got[k].Churn for k in "abcdef"] == [1, 0, 0, 0, 1, 0]
    assert got["c"].tenure is None and got["d"].MonthlyCharges is None
    bad = sorted((r.value or "<null>") for r in clean.invalid_target_values(raw).collect())
    assert bad == ["<null>", "maybe"]
    neg = {r.column: r.n_negative for r in clean.negative_values(c).collect()}
    assert neg["MonthlyCharges"] == 1 and neg["tenure"] == 0
    with pytest.raises(ValueError, match="yes and no"):
        clean.validate(raw, c)
    mb = {r.column: r.n_missing for r in clean.missing_before(raw).collect()}
    assert mb == {"TotalCharges": 3, "Churn": 1}


def test_require_columns_sorted_message(spark):
    from keepwise.sources.readers import require_columns

    df = spark.createDataFrame([(1,)], "a INT")
    with pytest.raises(ValueError, match=r"\['b', 'c'\]"):
        require_columns(df, ["c", "a", "b"])


def test_unknown_category_and_constant_numeric(spark):
    cols = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    rows = [tuple([5, 1.0, 2.0, 0] + ["A" if c == "Contract" else "x" for c in CATEGORICAL_FEATURES]) for _ in range(3)]
    schema = ", ".join(f"{c} {'INT' if c in ('tenure', 'SeniorCitizen') else 'DOUBLE' if c in NUMERIC_FEATURES else 'STRING'}"
                       for c in cols)
    train = spark.createDataFrame(rows, schema).withColumn("customerID", F.lit("t"))
    enc = Encoder.fit(train)
    test = train.withColumn("Contract", F.lit("B"))
    x = enc.transform(test).first().features
    assert x[:4] == [0.0, 0.0, 0.0, 0.0]              # constant numerics scale to 0
    k = enc.feature_names.index("Contract_A")
    assert x[k] == 0.0 and len(x) == enc.width          # unseen category -> zeros


def test_filters_empty_means_all(spark):
    df = spark.createDataFrame([("Month-to-month", "Mailed check"), ("One year", "x")], "Contract STRING, PaymentMethod STRING")
    assert profile.filter_segments(df, [], []).count() == 2
    assert profile.filter_segments(df, ["One year"], None).count() == 1


def test_global_rank_matches_row_number_with_heavy_ties(spark):
    rng = np.random.default_rng(11)
    data = [(f"id{i:06d}", float(rng.integers(0, 5))) for i in range(5000)]
    df = spark.createDataFrame(data, "customerID STRING, p DOUBLE").repartition(7)
    r = rank.global_rank(df, [F.col("p").desc(), F.col("customerID").asc()], rank_col="rn")
    got = {row.customerID: row.rn for row in r.collect()}
    exp = {cid: i + 1 for i, (cid, _) in enumerate(sorted(data, key=lambda t: (-t[1], t[0])))}
    assert got == exp


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=333).round(3)
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(vals)], "g INT, v DOUBLE")
    q = {r.g: r for r in rank.exact_quantiles(df, "v", [0.25, 0.5, 0.9], ["g"], ["a", "b", "c"]).collect()}
    for g in (0, 1):
        ref = np.percentile(vals[g::2], [25, 50, 90])
        assert np.allclose([q[g].a, q[g].b, q[g].c], ref, rtol=0, atol=1e-12)


def test_split_is_disjoint_complete_and_stratified(spark):
    df = spark.createDataFrame([(f"c{i}", int(i % 10 < 3)) for i in range(1000)], "customerID STRING, Churn INT")
    s = split.stratified_split(df).collect()
    assert len(s) == 1000 and len({r.customerID for r in s}) == 1000
    counts = {}
    for r in s:
        counts[(r.split, r.Churn)] = counts.get((r.split, r.Churn), 0) + 1
    assert counts[("train", 1)] == 210 and counts[("train", 0)] == 490
    assert counts[("test", 1)] == 45 and counts[("validation", 1)] == 45
    with pytest.raises(ValueError):
        split.stratified_split(df, train_ratio=0.8)


@pytest.mark.parametrize("seed", [1, 50])
def test_exact_quantiles_with_heavy_ties(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([np.full(4000, 7.0), rng.integers(0, 50, 8000).astype(float), rng.normal(size=3000)])
    groups = rng.integers(0, 3, len(vals))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g INT, v DOUBLE")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {r.g: r for r in rank.exact_quantiles(df, "v", probs, ["g"], [f"p{i}" for i in range(7)]).collect()}
    for g in range(3):
        ref = np.percentile(vals[groups == g], [p * 100 for p in probs])
        assert np.allclose([got[g][f"p{i}"] for i in range(7)], ref, rtol=0, atol=1e-9)


def test_exact_quantiles_many_groups(spark):
    rng = np.random.default_rng(9)
    vals = rng.integers(0, 30, 3000).astype(float)
    groups = rng.integers(0, 5, len(vals))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g INT, v DOUBLE")
    got = {r.g: r for r in rank.exact_quantiles(df, "v", [0.3, 0.5], ["g"], ["a", "b"]).collect()}
    for g in range(5):
        assert np.allclose([got[g].a, got[g].b], np.percentile(vals[groups == g], [30, 50]), atol=1e-12)


def _wide(spark, n, values):
    """A customer table of n rows whose gender column holds values(i)."""
    rows = spark.range(n).select(F.col("id").cast("string").alias("customerID"), F.col("id"))
    return rows.select("customerID", (F.col("id") % 7).cast("int").alias("tenure"), F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("double")).alias("MonthlyCharges"),
                       F.lit(1.0).alias("TotalCharges"), (F.col("id") % 2).cast("int").alias("SeniorCitizen"),
                       *[values(F.col("id")).alias(c) if c == "gender" else F.when(F.col("id") % 3 > 0, (F.col("id") % 4).cast("string")).alias(c)
                         for c in CATEGORICAL_FEATURES])


def test_sparse_encoder_of_100_000_categories(spark):
    from keepwise.operators.encode import SparseEncoder, sparse_dot

    train = _wide(spark, 100_000, lambda i: F.concat(F.lit("v"), F.reverse(i.cast("string"))))
    test = _wide(spark, 3000, lambda i: F.when(i % 10 == 0, F.lit("unseen")).otherwise(F.concat(F.lit("v"), F.reverse((i * 31 % 100_000).cast("string")))))
    enc = SparseEncoder.fit(train)
    out = enc.transform(test)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "v4321" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    con = duckdb.connect()
    con.execute("CREATE TABLE train AS SELECT 'v' || reverse(CAST(i AS VARCHAR)) AS g FROM range(100000) t(i)")
    place = dict(con.execute("SELECT g, row_number() OVER (ORDER BY g) - 1 FROM train").fetchall())
    assert enc.width == 4 + 100_000 + 5 * (len(CATEGORICAL_FEATURES) - 1)
    names = {r.idx: r.name for r in enc.names().where("idx < 6 or idx % 9999 = 0").collect()}
    shift = enc.offsets["gender"]
    assert names[0] == "tenure" and all(names[i] == f"gender_{g}" for g, p in place.items() if (i := p + shift) in names)
    rows = {r.customerID: r for r in out.collect()}
    assert len(rows) == 3000
    for k, r in rows.items():
        i = int(k)
        g = [x - shift for x in r.indices if shift <= x < shift + 100_000]
        assert g == ([] if i % 10 == 0 else [place["v" + str(i * 31 % 100_000)[::-1]]])
        assert list(r.indices) == sorted(r.indices) and len(r.indices) == len(r["values"]) == 4 + len(g) + len(CATEGORICAL_FEATURES) - 1
    w = [0.0] * enc.width
    w[0], w[shift + 5] = 2.0, 3.0
    z = out.select("customerID", sparse_dot(w, F.col("indices"), F.col("values")).alias("z")).where("customerID = '1'").first().z
    r = rows["1"]
    assert z == 2.0 * r["values"][0] + (3.0 if shift + 5 in r.indices else 0.0)


def test_dense_encoder_beyond_its_literals(spark, monkeypatch):
    from keepwise.operators import encode

    df = _wide(spark, 200, lambda i: F.when(i % 6 > 0, (i % 20).cast("string")))
    enc = Encoder.fit(df)
    want = {r.customerID: r.features for r in enc.transform(df, keep=["tenure"]).collect()}
    monkeypatch.setattr(encode, "LITERAL_CATEGORIES", 3)
    got = enc.transform(df, keep=["tenure"])
    assert got.columns == ["customerID", "tenure", "features"] and {r.customerID: r.features for r in got.collect()} == want


def test_missing_numbers_scale_to_the_mean(spark):
    from keepwise.operators.encode import fit_scaler, scale_numeric

    df = _wide(spark, 50, lambda i: F.lit("x"))
    out = scale_numeric(df.withColumn("TotalCharges", F.lit(float("nan"))), fit_scaler(df)).collect()
    assert all(r.TotalCharges == 0.0 for r in out) and sum(r.MonthlyCharges == 0.0 for r in out) >= 10
    empty = df.limit(0)
    assert scale_numeric(empty, fit_scaler(empty)).count() == 0


def test_auc_and_curve_are_exact_on_raw_scores(spark):
    rng = np.random.default_rng(21)
    rows = [(f"c{i}", float(rng.random()), int(rng.random() < 0.3), 1.0) for i in range(20000)]
    rows += [(f"t{i}", 0.5, i % 2, 1.0) for i in range(3000)]          # a hot tie
    rows += [(f"n{i}", None, i % 2, 1.0) for i in range(8)]            # not scored: in no metric
    df = spark.createDataFrame(rows, "customerID STRING, score DOUBLE, y INT, charge DOUBLE").repartition(5)
    s, y = (np.array([r[k] for r in rows if r[1] is not None], dtype=float) for k in (1, 2))
    pos, neg = np.sort(s[y == 1]), np.sort(s[y == 0])
    below, upto = np.searchsorted(neg, pos, "left"), np.searchsorted(neg, pos, "right")
    got = metrics.roc_auc(df).first()
    assert (got.n_pos, got.n_neg) == (len(pos), len(neg))
    assert got.roc_auc == float((below + upto).sum()) / (2.0 * len(pos) * len(neg))
    cm = metrics.confusion_matrix(df).first()
    assert sum(cm) == len(s)
    curve = sorted(metrics.roc_curve(df).collect())
    assert [r.point for r in curve] == list(range(len(curve))) and curve[-1].fpr == curve[-1].tpr == 1.0
    for r in curve[1:200]:
        assert r.tpr == (pos >= r.threshold).sum() / len(pos) and r.fpr == (neg >= r.threshold).sum() / len(neg)
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(curve, curve[1:]))
    assert abs(area - got.roc_auc) < 1e-9                               # dropped points lie on segments


def test_scores_closer_than_the_export_stay_apart(spark):
    rows = [("a", 0.4999997, 0, 1.0), ("b", 0.4999998, 1, 1.0), ("c", 0.5000001, 1, 1.0), ("d", 0.2, 0, 1.0)]
    df = spark.createDataFrame(rows, "customerID STRING, score DOUBLE, y INT, charge DOUBLE")
    cm = metrics.confusion_matrix(df).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (2, 0, 1, 1)
    assert metrics.roc_auc(df).first().roc_auc == 1.0
    assert len(metrics.roc_curve(df).collect()) == 4


def test_split_and_rank_keep_rows_without_id_or_class(spark):
    rows = [(None if i == 3 else f"c{i}", None if i == 7 else i % 2) for i in range(400)] + [("c9", 1)] * 50
    df = spark.createDataFrame(rows, "customerID STRING, Churn INT")
    assert split.stratified_split(df).count() == 450
    ranked = rank.global_rank(df, ["customerID"], partition_by=["Churn"], rank_col="r", size_col="n")
    assert ranked.count() == 450


def test_quantiles_of_null_group_and_empty(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g STRING, v DOUBLE")
    got = {r.g: r.m for r in rank.exact_quantiles(df, "v", [0.5], ["g"], ["m"]).collect()}
    assert got == {None: 2.0, "a": 2.0}
    assert rank.exact_quantiles(df.limit(0), "v", [0.5], ["g"], ["m"]).count() == 0


def test_numeric_target_and_violations_in_full(spark):
    from keepwise.operators import clean

    df = spark.createDataFrame([("1",), ("0",), ("1.0",), (" YES ",), ("no",)], "Churn STRING")
    assert [r[0] for r in df.select(clean.encode_target(F.col("Churn"))).collect()] == [1, 0, 1, 1, 0]
    assert clean.invalid_target_values(df).count() == 0
    bad = spark.createDataFrame([(f"v{i}",) for i in range(40)], "Churn STRING")
    with pytest.raises(ValueError, match="v39"):
        clean.validate(bad, bad.select(F.lit(1).alias("tenure")))


def test_reuse_sees_a_rewritten_file_of_equal_size(spark, tmp_path):
    import os

    from keepwise.plans import reuse

    path = str(tmp_path / "t")
    spark.range(4).coalesce(1).write.parquet(path)
    one = reuse.input_signature(spark, [path])
    part = next(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part"))
    os.utime(part, (1, 1))
    assert reuse.input_signature(spark, [path]) != one


def test_csv_quotes_and_missing_tokens(spark, tmp_path):
    from keepwise.schema import RAW_COLUMNS
    from keepwise.sources import readers

    cells = {c: "x" for c in RAW_COLUMNS} | {"customerID": '"a ""x"" b"', "gender": "NA", "Churn": "Yes"}
    (tmp_path / "c.csv").write_text(",".join(RAW_COLUMNS) + "\n" + ",".join(cells[c] for c in RAW_COLUMNS) + "\n")
    r = readers.scan_customers(spark, f"file://{tmp_path}/c.csv").first()
    assert r.customerID == 'a "x" b' and r.gender is None and r.Churn == "Yes"


def test_missing_numbers_stand_at_the_training_mean(spark):
    cols = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    schema = ", ".join(f"{c} {'INT' if c in ('tenure', 'SeniorCitizen') else 'DOUBLE' if c in NUMERIC_FEATURES else 'STRING'}" for c in cols)
    rows = [tuple([k, float(k), 2.0 * k, k % 2] + ["x"] * len(CATEGORICAL_FEATURES)) for k in (1, 3, 8)]
    train = spark.createDataFrame(rows, schema).withColumn("customerID", F.lit("t"))
    enc = Encoder.fit(train)
    gone = train.withColumn("tenure", F.lit(None).cast("int")).withColumn("MonthlyCharges", F.lit(float("nan")))
    x = enc.transform(gone).first().features
    assert all(v is not None and v == v for v in x)
    names = enc.feature_names
    assert x[names.index("tenure")] == 0.0 and x[names.index("MonthlyCharges")] == 0.0


def test_histograms_of_two_halves_equal_the_whole(spark):
    rng = np.random.default_rng(8)
    rows = [(f"c{i}", round(float(rng.random()), 2), int(rng.random() < 0.4)) for i in range(4000)]
    df = spark.createDataFrame(rows, "customerID STRING, score DOUBLE, y INT")
    half = lambda k: df.where(F.col("customerID").endswith("1") == k)
    whole = metrics.ordered_histogram(df)
    merged = metrics.merge_histograms(metrics.ordered_histogram(half(True)), metrics.ordered_histogram(half(False)))
    assert sorted(map(tuple, merged.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    for fn in (metrics.roc_auc, metrics.roc_curve, metrics.threshold_sweep):
        assert sorted(map(tuple, fn(merged).collect())) == sorted(map(tuple, fn(df).collect()))


def test_curve_points_are_numbered_over_stretches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"c{i}", float(rng.random()), int(rng.random() < 0.4)) for i in range(900)], "customerID STRING, score DOUBLE, y INT")
    want = sorted(map(tuple, metrics.roc_curve(df).collect()))
    monkeypatch.setattr(metrics, "CHUNK", 37)
    got = sorted(map(tuple, metrics.roc_curve(df).collect()))
    assert got == want and [r[0] for r in got] == list(range(len(got)))


def test_ten_thousand_scenarios_and_capacities(spark):
    """Requests as tables: results equal DuckDB, and the plan has one size."""
    from keepwise.operators.campaign import SCENARIO

    rng = np.random.default_rng(6)
    ranked = spark.createDataFrame([(f"c{i}", i + 1, 1 - i / 3000, int(rng.random() < 0.3), round(float(rng.random()) * 100, 2)) for i in range(3000)],
                                   "customerID STRING, rn BIGINT, score DOUBLE, y INT, charge DOUBLE")
    asked = [(i, float(rng.integers(0, 121)), float(rng.integers(0, 100)), float(rng.integers(0, 50)), float(rng.integers(0, 60))) for i in range(10_000)]
    table = spark.createDataFrame(asked, SCENARIO)
    out = campaign_roi(ranked, table)
    size = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(out) == size(campaign_roi(ranked, table.limit(3))) - size(table.limit(3)) + size(table)
    con = duckdb.connect()
    con.register("r", ranked.toPandas())
    con.register("s", table.toPandas())
    want = con.execute("""WITH c AS (SELECT rn, sum(y) OVER w AS churners, sum(CAST(charge * y AS DECIMAL(28,10))) OVER w AS money FROM r
          WINDOW w AS (ORDER BY rn)), p AS (SELECT *, CAST(round_even(pct_contacted / 100 * 600, 0) AS BIGINT) AS k FROM s)
        SELECT scenario, k, CAST(coalesce(churners, 0) AS BIGINT), coalesce(churners * (success_rate / 100)
          * greatest(0, CAST(money AS DOUBLE) / greatest(1, churners) - avg_discount) * 12, 0) FROM p LEFT JOIN c ON rn = k""").fetchall()
    got = {r.scenario: r for r in out.collect()}
    assert len(got) == len(want) == 10_000
    for i, k, churners, preserved in want:
        assert (got[i].n_contacted, got[i].churners_contacted) == (k, churners) and math.isclose(got[i].revenue_preserved, preserved, rel_tol=1e-12, abs_tol=1e-9)
    caps = spark.createDataFrame([(i, int(k)) for i, k in enumerate(rng.integers(-5, 4000, 10_000))], "request INT, requested BIGINT")
    for r in capacity_topn(ranked, caps).collect():
        assert r.capacity == max(0, min(r.requested, 3000)) and r.implied_threshold == (1 - (r.capacity - 1) / 3000 if r.capacity else 0.0)


def test_cleaning_summary_reads_its_input_once(spark, tmp_path):
    from keepwise.sources import fixture

    raw = fixture.raw_customers(spark, "/root/testdata/sf0.001")
    written, summary = clean.clean_and_summarise(raw.withColumn("TotalCharges", F.when(F.col("customerID") == "3", "-4").otherwise(F.col("TotalCharges"))))
    got = {(r.section, r.column): r.n for r in summary.collect()}
    n = raw.count()
    assert written.count() == n == got["rows", "n_rows"] and got["rows", "rows_dropped"] == 0 and got["negative", "TotalCharges"] == 1
    assert {(c, v) for (s, c), v in got.items() if s == "missing_before"} == {tuple(r) for r in clean.missing_before(raw).collect()}
    assert "orders" not in summary._jdf.queryExecution().executedPlan().toString()     # counted while the table was written


def test_csv_records_of_another_width_and_quoted_line_breaks(spark):
    from keepwise.schema import RAW_COLUMNS
    from keepwise.session import scratch_path
    from keepwise.sources import readers

    cells = lambda i, *more: ",".join([f"c{i}", "1", *["x"] * (len(RAW_COLUMNS) - 3), "Yes", *more])
    lines = [",".join(RAW_COLUMNS), cells(1), cells(2, ""), cells(3, "more", "cells"), cells(4).replace("x", '"a, ""b""\nc"', 1),
             "c5,2,short", cells(6).replace("x", '"quoted, comma"'), cells(7, '"a, b"')]
    path, aside = scratch_path(spark, "csv"), scratch_path(spark, "aside")
    spark.createDataFrame([("\n".join(lines),)], "value STRING").coalesce(1).write.text(path)
    with pytest.raises(ValueError, match="3 records"):
        readers.scan_customers(spark, path)
    got = {r.customerID: r for r in readers.scan_customers(spark, path, quarantine=aside).collect()}
    assert set(got) == {"c1", "c4", "c5", "c6"} and got["c4"][2] == 'a, "b"\nc' and got["c5"][2] == "short" and got["c5"].Churn is None
    assert got["c6"][2] == "quoted, comma"
    assert {r.record.split(",")[0] for r in spark.read.parquet(aside).collect()} == {"c2", "c3", "c7"}


def test_sketches_merge_and_keep_their_bound(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=40_000), np.full(20_000, 0.25)])
    rng.shuffle(vals)
    df = spark.createDataFrame([(int(i % 2), int(i % 5), float(v)) for i, v in enumerate(vals)] + [(0, 1, None), (1, 1, float("nan"))], "g INT, batch INT, v DOUBLE")
    parts = [profile.quantile_sketch(df.where(F.col("batch") == b), "v", ["g"]) for b in range(5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    merged = profile.merge_sketches(every, ["g"])
    probs = [0.0, 0.01, 0.3, 0.5, 0.9, 1.0]
    for r in profile.sketch_quantiles(merged, probs, ["g"]).collect():
        mine = np.sort(vals[r.g::2])
        low, high = np.searchsorted(mine, r.value, "left") / len(mine), np.searchsorted(mine, r.value, "right") / len(mine)
        assert r.n == len(mine) and max(low - r.prob, r.prob - high, 0) <= profile.rank_error()
    assert merged.selectExpr("max(length(sketch)) AS n").first().n < 20_000


def test_hints_from_a_table_of_50_000_keys(spark):
    from keepwise.operators import explain

    rng = np.random.default_rng(2)
    letters = list("abcde")
    word = lambda a, b: "".join(rng.choice(letters, rng.integers(a, b)))
    keys = list({word(5, 10) for _ in range(60_000)})[:49_990] + ["ab", "c", "zzz", "xyxy", "q" * 30]
    hints = spark.createDataFrame([(i, k, f"hint {k}") for i, k in enumerate(keys)], "priority INT, key STRING, hint STRING")
    names = [word(3, 25) for _ in range(400)] + ["Cat_ab-c d", "X Y_xy", "", "none", None, "Z-z_Z", "zzz", "zzz"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id INT, name STRING")
    out = explain.hint_lookup(df, hints)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    con = duckdb.connect()
    con.register("k", hints.toPandas())
    con.register("n", df.toPandas())
    want = dict(con.execute("""SELECT id, coalesce(arg_min(hint, priority), '') FROM n LEFT JOIN k
        ON contains(replace(replace(replace(lower(name), ' ', ''), '-', ''), '_', ''), key) GROUP BY id""").fetchall())
    got = {r.id: r.hint for r in out.collect()}
    assert len(got) == len(names) and all(got[i] == (want[i] or fixed.DEFAULT_HINT) for i in got)
    assert {r.hint for r in explain.hint_lookup(df, hints.limit(0)).collect()} == {fixed.DEFAULT_HINT}
