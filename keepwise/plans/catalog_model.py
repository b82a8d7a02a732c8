"""Registered queries, part 2: encoding, explanation, importance, profiles and
the id joins. Imported by ``catalog`` (registration happens at import)."""

from __future__ import annotations

from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.functions.scoring import rational_share, sig_round
from keepwise.functions.text import humanize_feature
from keepwise.operators import clean as clean_ops
from keepwise.operators import encode, explain, importance, profile, score
from keepwise.plans import oracle as O
from keepwise.plans.catalog import Tables, query
from keepwise.schema import CATEGORICAL_FEATURES, ID_COL, NUMERIC_FEATURES, TARGET_COL

DP = 9   # fitted floating parameters are reported at 9 dp (sums differ in the last bits across engines)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _train(t: Tables):
    return t.split.filter(F.col("split") == "train")


def _test(t: Tables):
    return t.split.filter(F.col("split") == "test")


def _encoder(t: Tables) -> encode.Encoder:
    return encode.Encoder.fit(_train(t))


# ---------------------------------------------------------------------------
# SQL pieces shared by the encoding queries
# ---------------------------------------------------------------------------
TRAIN = ",\ntrain AS (SELECT * FROM split WHERE split = 'train'),\ntst AS (SELECT * FROM split WHERE split = 'test')"
SCALER = ",\nscaler AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {i} AS idx, avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std FROM train"
    for i, c in enumerate(NUMERIC_FEATURES)) + ")"
CATS = ",\ncats AS (SELECT feature, category, CAST(row_number() OVER (PARTITION BY feature ORDER BY category NULLS LAST) - 1 AS INTEGER) AS position FROM (" + \
    " UNION ".join(f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS category FROM train" for c in CATEGORICAL_FEATURES) + "))"
FORDER = ",\nforder AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS ord" for i, c in enumerate(CATEGORICAL_FEATURES)) + ")"
NAMES = FORDER + """,
foff AS (SELECT f.feature, f.ord, coalesce(sum(k.cnt) OVER (ORDER BY f.ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
         FROM forder f JOIN (SELECT feature, count(*) AS cnt FROM cats GROUP BY feature) k USING (feature)),
names AS (SELECT idx, feature AS name, feature AS src, NULL AS category FROM scaler
          UNION ALL SELECT CAST(""" + str(len(NUMERIC_FEATURES)) + """ + off + position AS INTEGER), c.feature || '_' || c.category, c.feature, c.category
          FROM cats c JOIN foff USING (feature))"""
ENC = O.SPLIT + TRAIN + SCALER + CATS + NAMES


def _scaled(c: str) -> str:
    return (f"(CAST({c} AS DOUBLE) - (SELECT mean FROM scaler WHERE feature = '{c}')) / "
            f"(SELECT CASE WHEN std = 0 OR std IS NULL THEN 1.0::DOUBLE ELSE std END FROM scaler WHERE feature = '{c}')")


# ---------------------------------------------------------------------------
# 2.9 encoding
# ---------------------------------------------------------------------------
@query("fit_scaler", O.w(ENC, f"""SELECT feature, {O.sig_round('mean')} AS mean, {O.sig_round('std')} AS std,
  {O.sig_round('CASE WHEN std = 0 OR std IS NULL THEN 1.0::DOUBLE ELSE std END')} AS scale FROM scaler"""))
def q_fit_scaler(spark, sf):
    s = encode.fit_scaler(_train(Tables(spark, sf)))
    return s.select("feature", *[sig_round(F.col(c)).alias(c) for c in ("mean", "std", "scale")])


@query("scale_numeric", O.w(ENC, "SELECT customerID, " + ", ".join(
    f"round_even({_scaled(c)}, {DP}) AS {c}" for c in NUMERIC_FEATURES) + " FROM tst"))
def q_scale_numeric(spark, sf):
    t = Tables(spark, sf)
    s = encode.scale_numeric(_test(t), encode.fit_scaler(_train(t)))
    return s.select(ID_COL, *[F.bround(c, DP).alias(c) for c in NUMERIC_FEATURES])


@query("fit_onehot", O.w(ENC, "SELECT feature, category, position FROM cats"))
def q_fit_onehot(spark, sf):
    return encode.fit_onehot(_train(Tables(spark, sf)))


@query("encode_onehot", O.w(ENC, f""",
lv AS (UNPIVOT (SELECT customerID, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in CATEGORICAL_FEATURES)} FROM clean)
       ON {', '.join(CATEGORICAL_FEATURES)} INTO NAME feature VALUE val)
SELECT lv.customerID, cats.feature, cats.category,
       CAST(coalesce(lv.val = cats.category, lv.val IS NULL AND cats.category IS NULL) AS DOUBLE) AS value
FROM lv JOIN cats ON lv.feature = cats.feature"""))
def q_encode_onehot(spark, sf):
    t = Tables(spark, sf)
    return encode.encode_onehot_long(t.clean, encode.fit_onehot(_train(t)))


@query("assemble_features", O.w(ENC, " UNION ALL ".join(
    f"SELECT customerID, CAST({i} AS INTEGER) AS idx, round_even({_scaled(c)}, {DP}) AS value FROM tst" for i, c in enumerate(NUMERIC_FEATURES))
    + f""" UNION ALL
SELECT lv.customerID, CAST(nm.idx AS INTEGER) AS idx, CAST(coalesce(lv.val = nm.category, false) AS DOUBLE) AS value FROM (
  UNPIVOT (SELECT customerID, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in CATEGORICAL_FEATURES)} FROM tst)
  ON {', '.join(CATEGORICAL_FEATURES)} INTO NAME src VALUE val) lv
JOIN (SELECT idx, src, category FROM names WHERE category IS NOT NULL) nm ON lv.src = nm.src"""))
def q_assemble_features(spark, sf):
    """Every cell of the encoded table, zeros included, one line per index."""
    t = Tables(spark, sf)
    x = encode.SparseEncoder.fit(_train(t)).transform(_test(t))
    cells = x.select(ID_COL, F.posexplode(encode.dense("size", "indices", "values")).alias("idx", "value"))
    return cells.select(ID_COL, F.col("idx").cast("int").alias("idx"), F.bround("value", DP).alias("value"))


@query("feature_names", O.w(ENC, "SELECT CAST(idx AS INTEGER) AS idx, name FROM names"))
def q_feature_names(spark, sf):
    return encode.feature_names_table(_encoder(Tables(spark, sf)), spark)


# ---------------------------------------------------------------------------
# 2.8 / 2.9 labels and hints
# ---------------------------------------------------------------------------
def _title_sql(x: str) -> str:
    s = f"lower({x})"
    return (f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substring({s}, i - 1, 1), '\\p{{L}}') THEN upper(substring({s}, i, 1)) "
            f"ELSE substring({s}, i, 1) END), '')")


def _humanize_sql(name: str) -> str:
    s = O.strip(f"replace(regexp_replace(regexp_replace({O.strip(name)}, '^num__', ''), '^cat__', ''), '_', ' ')")
    return f"CASE WHEN length({s}) > 0 THEN {_title_sql(s)} ELSE {name} END"


def _hint_sql(name: str) -> str:
    key = f"replace(replace(replace(lower({name}), ' ', ''), '-', ''), '_', '')"
    whens = " ".join(f"WHEN contains({key}, {_q(k)}) THEN {_q(t)}" for k, t in fixed.HINTS)
    return f"CASE {whens} ELSE {_q(fixed.DEFAULT_HINT)} END"


@query("humanize_feature", O.w(ENC, f"SELECT CAST(idx AS INTEGER) AS idx, name, {_humanize_sql('name')} AS label FROM names"))
def q_humanize_feature(spark, sf):
    names = encode.feature_names_table(_encoder(Tables(spark, sf)), spark)
    return names.select("idx", "name", humanize_feature(F.col("name")).alias("label"))


@query("hint_lookup", O.w(ENC, f"SELECT CAST(idx AS INTEGER) AS idx, name, {_hint_sql('name')} AS hint FROM names"))
def q_hint_lookup(spark, sf):
    names = encode.feature_names_table(_encoder(Tables(spark, sf)), spark)
    return explain.hint_lookup(names, explain.hint_table(spark)).select("idx", "name", "hint")


# ---------------------------------------------------------------------------
# 2.4 permutation importance (fixed weights on the unscaled design)
# ---------------------------------------------------------------------------
PI_WEIGHTS = {"tenure": -3 / 64, "InternetService_Fiber optic": 13 / 64, "Contract_Month-to-month": 26 / 64,
              "PaymentMethod_Electronic check": 19 / 64, "PaymentMethod_Mailed check": 19 / 64}
PI_INTERCEPT = 2.0


def importance_table(t: Tables):
    enc = _encoder(t)
    design = enc.transform(_test(t), keep=[TARGET_COL], scale=False).withColumnRenamed(TARGET_COL, "y")
    w = [PI_WEIGHTS.get(nm, 0.0) for nm in enc.feature_names]
    pi = importance.permutation_importance(design, importance.linear_scorer(w, PI_INTERCEPT, rational_share), enc.feature_names,
                                           n_repeats=fixed.N_REPEATS, seed=fixed.SPLIT_SEED)
    return pi.select("idx", "feature", *[F.bround(c, DP).alias(c)
                                         for c in ("importance_mean", "importance_std", "baseline_auc")])


def _pi_sql() -> str:
    cols = {"t": "CAST(tenure AS DOUBLE)",
            "fib": "CAST(coalesce(CAST(InternetService AS VARCHAR) = 'Fiber optic', false) AS DOUBLE)",
            "m2m": "CAST(coalesce(CAST(Contract AS VARCHAR) = 'Month-to-month', false) AS DOUBLE)",
            "ec": "CAST(coalesce(CAST(PaymentMethod AS VARCHAR) = 'Electronic check', false) AS DOUBLE)",
            "mc": "CAST(coalesce(CAST(PaymentMethod AS VARCHAR) = 'Mailed check', false) AS DOUBLE)"}
    feat = {"t": "tenure", "fib": "InternetService_Fiber optic", "m2m": "Contract_Month-to-month",
            "ec": "PaymentMethod_Electronic check", "mc": "PaymentMethod_Mailed check"}
    wts = {"t": -3 / 64, "fib": 13 / 64, "m2m": 26 / 64, "ec": 19 / 64, "mc": 19 / 64}

    def score(src) -> str:
        z = O.dbl(PI_INTERCEPT) + "".join(f" + {O.dbl(wts[k])} * {src(k)}" for k in ["t", "fib", "m2m", "ec", "mc"])
        return f"({O.dbl(0.5)} + {O.dbl(0.5)} * (({z}) / ({O.dbl(1.0)} + abs({z}))))"

    perm = score(lambda k: f"(CASE WHEN nm.name = '{feat[k]}' THEN b.{k} ELSE a.{k} END)")
    return O.w(ENC + f""",
des AS (SELECT customerID, Churn AS y, {', '.join(f'{v} AS {k}' for k, v in cols.items())},
               row_number() OVER (ORDER BY md5('42|' || customerID), customerID) - 1 AS i FROM tst),
nn AS (SELECT count(*) AS n FROM des),
reps AS (SELECT r, min(a) AS a, (104729 * (r + 1)) % max(n) AS b
         FROM range(0, {fixed.N_REPEATS}) rr(r), range(7919, 7919 * {fixed.N_REPEATS} + 100000) t(a), nn
         WHERE a >= 7919 * (r + 1) AND gcd(a, n) = 1 GROUP BY r),
pairs AS (SELECT d.*, reps.r, (reps.a * d.i + reps.b) % nn.n AS j FROM des d, reps, nn),
perm AS (SELECT a.r, nm.idx AS f, a.y, {perm} AS s FROM pairs a JOIN des b ON b.i = a.j, names nm),
hist AS (SELECT r, f, s, sum(y) AS pos, sum(1 - y) AS neg FROM perm GROUP BY r, f, s),
auc AS (SELECT r, f, CAST(sum(CAST(pos AS HUGEINT) * (2 * nb + neg)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc
        FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY r, f ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM hist)
        GROUP BY r, f),
bh AS (SELECT {score(lambda k: k)} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM des GROUP BY 1),
pib AS (SELECT CAST(sum(CAST(pos AS HUGEINT) * (2 * nb + neg)) AS DOUBLE) / (2.0::DOUBLE * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS base_auc
         FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM bh)),
pim AS (SELECT f, avg(base_auc - auc) AS m, stddev_pop(base_auc - auc) AS sd, max(base_auc) AS b FROM auc, pib GROUP BY f)""",
        f"""SELECT CAST(f AS INTEGER) AS idx, nm.name AS feature, round_even(m, {DP}) AS importance_mean,
  round_even(sd, {DP}) AS importance_std, round_even(b, {DP}) AS baseline_auc FROM pim JOIN names nm ON nm.idx = pim.f""")


PI_SQL = _pi_sql()


@query("permutation_importance", PI_SQL)
def q_permutation_importance(spark, sf):
    return importance_table(Tables(spark, sf))


_PI_CTES = PI_SQL[len("WITH "):PI_SQL.rindex("\nSELECT CAST(f AS INTEGER)")]
_PI_BODY = f""",
pit AS (SELECT CAST(f AS INTEGER) AS idx, nm.name AS feature, round_even(m, {DP}) AS importance_mean
        FROM pim JOIN names nm ON nm.idx = pim.f),
topk AS (SELECT *, CAST(row_number() OVER (ORDER BY importance_mean DESC, idx) AS INTEGER) AS rank FROM pit
         ORDER BY importance_mean DESC, idx LIMIT {fixed.TOP_K})"""


@query("top_k_features", O.w(_PI_CTES + _PI_BODY, "SELECT rank, idx, feature, importance_mean FROM topk"))
def q_top_k_features(spark, sf):
    top = explain.top_k_features(importance_table(Tables(spark, sf)))
    return top.select(F.col("rank").cast("int"), "idx", "feature", "importance_mean")


@query("business_hints", O.w(_PI_CTES + _PI_BODY,
       f"SELECT rank, feature, {_humanize_sql('feature')} AS label, {_hint_sql('feature')} AS hint FROM topk"))
def q_business_hints(spark, sf):
    top = explain.top_k_features(importance_table(Tables(spark, sf)))
    return explain.business_hints(top).withColumn("rank", F.col("rank").cast("int"))


# ---------------------------------------------------------------------------
# 2.9 risk drivers, playbook, what-if (whole customer table)
# ---------------------------------------------------------------------------
def _drivers_sql() -> str:
    t = fixed.DRIVER_TEXTS
    seg = fixed.DRIVER_SEGMENTS
    drv = [_q(t[0][0]),
           _q(t[1][0].split("{tenure}")[0]) + " || CAST(tenure AS VARCHAR) || " + _q(t[1][0].split("{tenure}")[1]),
           _q(t[2][0]),
           _q(t[3][0].split("{charge}")[0]) + " || printf('%.1f', MonthlyCharges) || " + _q(t[3][0].split("{charge}")[1]),
           _q(t[4][0])]
    conds = ["Contract = 'Month-to-month'", "tenure < 12",
             "contains(coalesce(PaymentMethod, 'None'), 'Electronic check') OR contains(coalesce(PaymentMethod, 'None'), 'Mailed check')",
             "MonthlyCharges > med.m * 1.2::DOUBLE",
             "contains(coalesce(InternetService, 'None'), 'Fiber') OR lower(coalesce(InternetService, 'None')) = 'fiber optic'"]
    parts = [f"SELECT customerID, {i + 1} AS rule, {_q(seg[i])} AS segment, {drv[i]} AS driver, {_q(t[i][1])} AS why, "
             f"{_q(t[i][2])} AS action FROM clean, med WHERE {conds[i]}" for i in range(5)]
    return (",\nmed AS (SELECT median(MonthlyCharges) AS m FROM clean),\nrules AS (" + " UNION ALL ".join(parts) + "),\n"
            "drv AS (SELECT customerID, CAST(row_number() OVER (PARTITION BY customerID ORDER BY rule) AS INTEGER) AS position, "
            "rule, segment, driver, why, action FROM rules)")


DRIVERS = O.SCORED + _drivers_sql()


def _median(t: Tables):
    return profile.global_median(t.clean, "MonthlyCharges")


@query("risk_drivers", O.w(DRIVERS, "SELECT * FROM drv"))
def q_risk_drivers(spark, sf):
    t = Tables(spark, sf)
    return explain.risk_drivers(t.clean, _median(t))


@query("top3_drivers", O.w(DRIVERS, f"""SELECT drv.customerID, drv.position, drv.driver, drv.action FROM drv
JOIN scored USING (customerID) WHERE drv.position <= 3 AND scored.p_raw >= {O.dbl(fixed.HIGH_RISK_MIN)}"""))
def q_top3_drivers(spark, sf):
    t = Tables(spark, sf)
    return explain.top3_drivers(t.clean, _median(t))


_PB = " UNION ALL ".join(f"SELECT {_q(a)} AS segment, {_q(b)} AS risk_signal, {_q(c)} AS playbook_action"
                         for a, b, c in fixed.PLAYBOOK)


@query("playbook_join", O.w(DRIVERS + f",\npb AS ({_PB})", """SELECT drv.customerID, drv.position, drv.segment, drv.driver,
  pb.risk_signal, pb.playbook_action FROM drv LEFT JOIN pb USING (segment)"""))
def q_playbook_join(spark, sf):
    t = Tables(spark, sf)
    j = explain.playbook_join(explain.risk_drivers(t.clean, _median(t)))
    return j.select(ID_COL, "position", "segment", "driver", "risk_signal", "playbook_action")


@query("median_broadcast", O.w(DRIVERS, """SELECT customerID, MonthlyCharges, med.m AS median_charge,
  MonthlyCharges > med.m * 1.2::DOUBLE AS high_charge FROM clean, med"""))
def q_median_broadcast(spark, sf):
    t = Tables(spark, sf)
    return explain.median_compare(t.clean, _median(t))


WHATIF = [{"Contract": "Two year"}, {"PaymentMethod": "Credit card (automatic)"},
          {"tenure": 24, "InternetService": "DSL"}]


def _whatif_sql() -> str:
    parts = []
    for i, o in enumerate(WHATIF):
        repl = {c: (_q(v) if isinstance(v, str) else str(v)) for c, v in o.items()}
        cols = ", ".join(f"{v} AS {c}" for c, v in repl.items())
        parts.append(f"SELECT {i + 1} AS scenario, * REPLACE ({cols}), p_raw AS base_p FROM scored")
    z = O.P_RAW
    return O.w(O.SCORED + ",\nwi AS (" + " UNION ALL ".join(parts) + ")",
               f"""SELECT customerID, scenario, round_even(base_p, 6) AS base_probability, round_even({z}, 6) AS whatif_probability,
  round_even({z}, 6) - round_even(base_p, 6) AS delta,
  {O.BAND.replace('p_raw', 'base_p')} AS base_risk, {O.BAND.replace('p_raw', z)} AS whatif_risk,
  {O.BAND.replace('p_raw', z).replace("'Low'", "'Baixo'").replace("'Medium'", "'Médio'").replace("'High'", "'Alto'")} AS whatif_label
FROM wi""")


@query("whatif_scores", _whatif_sql())
def q_whatif_scores(spark, sf):
    return explain.whatif_scores(Tables(spark, sf).clean_lazy, WHATIF)


# ---------------------------------------------------------------------------
# 2.4 descriptive profiles of the whole customer table
# ---------------------------------------------------------------------------
_LBL = "CASE Churn WHEN 0 THEN 'Sem churn' WHEN 1 THEN 'Churn' END"


@query("box_stats", O.w(O.CLEAN, " UNION ALL ".join(
    f"""SELECT {_LBL} AS ChurnLabel, '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min,
  quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, CAST(max({c}) AS DOUBLE) AS max FROM clean GROUP BY 1"""
    for c in ("tenure", "MonthlyCharges"))))
def q_box_stats(spark, sf):
    return profile.box_stats(profile.with_label(Tables(spark, sf).clean))


PROBS = [0.0, 0.25, 0.5, 0.75, 1.0]


@query("quantile_sketch", O.w(O.CLEAN, """SELECT ChurnLabel, "column", prob, n, true AS within_bound FROM (
  SELECT CASE Churn WHEN 0 THEN 'Sem churn' WHEN 1 THEN 'Churn' END AS ChurnLabel, "column", CAST(count(*) AS BIGINT) AS n FROM (
    UNPIVOT (SELECT Churn, CAST(tenure AS DOUBLE) AS tenure, CAST(MonthlyCharges AS DOUBLE) AS MonthlyCharges FROM clean)
    ON tenure, MonthlyCharges INTO NAME "column" VALUE value) GROUP BY ALL), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS prob)"""))
def q_quantile_sketch(spark, sf):
    """Sketched box statistics, each held against the rank its value has in the data."""
    labelled = profile.with_label(Tables(spark, sf).clean)
    sketches = profile.box_sketch(labelled)
    q = profile.sketch_quantiles(sketches, PROBS, ["ChurnLabel", "column"])
    return profile.sketch_ranks(labelled, q).select(
        "ChurnLabel", "column", "prob", "n", (F.abs(F.col("off")) <= profile.rank_error()).alias("within_bound"))


@query("column_profile", O.w(O.CLEAN, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(min({c}) AS DOUBLE) AS min, {'0.0::DOUBLE' if c == 'TotalCharges' else f'CAST(min({c}) AS DOUBLE)'} AS slider_min,
  CAST(max({c}) AS DOUBLE) AS max, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median FROM clean"""
    for c in ("tenure", "MonthlyCharges", "TotalCharges"))))
def q_column_profile(spark, sf):
    return profile.column_profile(Tables(spark, sf).clean)


_LONG = "UNPIVOT (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in CATEGORICAL_FEATURES) + \
    " FROM clean) ON " + ", ".join(CATEGORICAL_FEATURES) + ' INTO NAME "column" VALUE value'


@query("column_mode", O.w(O.CLEAN, f"""
SELECT "column", value AS mode, CAST(n AS BIGINT) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS k
  FROM (SELECT "column", value, count(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE k = 1"""))
def q_column_mode(spark, sf):
    return profile.column_mode(Tables(spark, sf).clean_lazy)


@query("distinct_options", O.w(O.CLEAN, f"""
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) AS INTEGER) AS position
FROM (SELECT DISTINCT "column", value FROM ({_LONG}) WHERE value IS NOT NULL)"""))
def q_distinct_options(spark, sf):
    return profile.distinct_options(Tables(spark, sf).clean_lazy)


# ---------------------------------------------------------------------------
# 2.3 id joins
# ---------------------------------------------------------------------------
@query("attach_ids", O.w(O.SCORED, "SELECT customerID, churn_probability FROM scored"))
def q_attach_ids(spark, sf):
    t = Tables(spark, sf)
    # the id rides along with the features, so the scores already carry it
    return score.predictions(clean_ops.project_features(t.clean)).select(ID_COL, "churn_probability")


@query("attach_outcomes", O.w(O.TEST, "SELECT customerID, score, y, charge FROM test"))
def q_attach_outcomes(spark, sf):
    t = Tables(spark, sf)
    return score.scored_outcomes(_test(t))   # outcomes are columns of the scored rows
