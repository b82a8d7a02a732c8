"""DuckDB SQL that recomputes each registered query from the raw tables.

Written independently of the Spark plans: window functions and plain
aggregates over the same parquet tables, so a match means the distributed plan
(sorted ranks, conditional sums, histograms) equals the textbook definition.
"""

from __future__ import annotations

from keepwise.functions import fixed

NUM_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])$"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def num(x: str) -> str:
    s = strip(f"CAST({x} AS VARCHAR)")
    return f"(CASE WHEN regexp_matches({s}, '{NUM_RE}') THEN TRY_CAST({s} AS DOUBLE) END)"


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


# ---------------------------------------------------------------------------
# customer_base: customer x aggregated orders (same rules as sources.fixture)
# ---------------------------------------------------------------------------
BASE = """
o AS (
  SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, count(*) AS n_orders,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS tot, max(o_totalprice) AS mx,
         sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS nf,
         sum(CASE WHEN o_orderstatus='P' THEN 1 ELSE 0 END) AS np,
         sum(CASE WHEN o_orderstatus='O' THEN 1 ELSE 0 END) AS no,
         sum(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS p1,
         sum(CASE WHEN o_orderpriority='2-HIGH' THEN 1 ELSE 0 END) AS p2,
         sum(CASE WHEN o_orderpriority='3-MEDIUM' THEN 1 ELSE 0 END) AS p3,
         sum(CASE WHEN o_orderpriority='4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS p4,
         sum(CASE WHEN o_orderpriority='5-LOW' THEN 1 ELSE 0 END) AS p5
  FROM orders GROUP BY o_custkey),
b AS (
  SELECT c_custkey, c_acctbal, c_mktsegment, c_nationkey, o.* EXCLUDE (tot), coalesce(o.tot, 0::DECIMAL(18,2)) AS tot,
         CAST(coalesce(o.tot, 0)*100 AS BIGINT) AS cents,
         CAST(coalesce(floor(date_diff('day', f, l)/30), 0) AS INTEGER) AS ten,
         CASE c_nationkey % 3 WHEN 0 THEN 'Fiber optic' WHEN 1 THEN 'DSL' ELSE 'No' END AS inet,
         CASE WHEN nf >= 2 THEN 'Yes' ELSE 'No' END AS phone
  FROM customer LEFT JOIN o ON c_custkey = o_custkey),
base AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customerID, ten AS tenure,
    (cents - cents % (ten+1)) / (ten+1) / 100 AS MonthlyCharges,
    CASE WHEN ten = 0 THEN ' ' ELSE CAST(tot AS VARCHAR) END AS TotalCharges,
    CAST(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS INTEGER) AS SeniorCitizen,
    CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
    CASE WHEN n_orders >= 10 THEN 'Yes' ELSE 'No' END AS Partner,
    CASE WHEN mx > 300000 THEN 'Yes' ELSE 'No' END AS Dependents,
    phone AS PhoneService,
    CASE WHEN phone='No' THEN 'No phone service' WHEN np >= 4 THEN 'Yes' ELSE 'No' END AS MultipleLines,
    inet AS InternetService,
    CASE WHEN inet='No' THEN 'No internet service' WHEN p1 >= 2 THEN 'Yes' ELSE 'No' END AS OnlineSecurity,
    CASE WHEN inet='No' THEN 'No internet service' WHEN p2 >= 2 THEN 'Yes' ELSE 'No' END AS OnlineBackup,
    CASE WHEN inet='No' THEN 'No internet service' WHEN p3 >= 2 THEN 'Yes' ELSE 'No' END AS DeviceProtection,
    CASE WHEN inet='No' THEN 'No internet service' WHEN p4 >= 2 THEN 'Yes' ELSE 'No' END AS TechSupport,
    CASE WHEN inet='No' THEN 'No internet service' WHEN p5 >= 2 THEN 'Yes' ELSE 'No' END AS StreamingTV,
    CASE WHEN inet='No' THEN 'No internet service' WHEN no >= 4 THEN 'Yes' ELSE 'No' END AS StreamingMovies,
    CASE c_custkey % 3 WHEN 0 THEN 'Month-to-month' WHEN 1 THEN 'One year' ELSE 'Two year' END AS Contract,
    CASE WHEN c_acctbal >= 5000 THEN 'Yes' ELSE 'No' END AS PaperlessBilling,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'Electronic check' WHEN 'BUILDING' THEN 'Mailed check'
         WHEN 'AUTOMOBILE' THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS PaymentMethod,
    CASE WHEN l < TIMESTAMP '2000-10-01' THEN 'Yes' ELSE 'No' END AS Churn
  FROM b)"""

CATS = list(__import__("keepwise.schema", fromlist=["x"]).CATEGORICAL_FEATURES)
RAW_COLS = ["customerID", "tenure", "MonthlyCharges", "TotalCharges", "SeniorCitizen"] + CATS + ["Churn"]

RAW = BASE + ",\nraw AS (SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in RAW_COLS) + " FROM base)"

# cells that need cleaning, by the last digits of the id: (column, digits, text in the file, value read)
DIRTY = [("gender", "7", "NA", None), ("Churn", "13", "maybe", "maybe"), ("MonthlyCharges", "21", "-5.25", "-5.25"),
         ("tenure", "5", "abc", "abc"), ("PaymentMethod", "9", 'Mailed "check"', 'Mailed "check"')]
FILE = RAW + ",\nfile AS (SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN ends_with(customerID, '{d}') THEN " + ("NULL" if v is None else f"'{v}'") + f" ELSE {c} END AS {c}"
    for c, d, _, v in DIRTY) + ") FROM raw)"

CLEAN = RAW + f""",
clean AS (
  SELECT customerID,
    TRY_CAST(trunc({num('tenure')}) AS INTEGER) AS tenure,
    {num('MonthlyCharges')} AS MonthlyCharges,
    coalesce({num('TotalCharges')}, {dbl(0.0)}) AS TotalCharges,
    TRY_CAST(trunc({num('SeniorCitizen')}) AS INTEGER) AS SeniorCitizen,
    {", ".join(CATS)},
    CAST(coalesce(lower({strip('Churn')}) = 'yes', false) AS INTEGER) AS Churn
  FROM raw)"""

FILE_CLEAN = FILE + CLEAN[len(RAW):].replace("FROM raw)", "FROM file)")

# z = 2 - 3/64 tenure + 26/64 [m2m] + 19/64 [manual check] + 13/64 [fiber]: exact in doubles
Z = (f"{dbl(2.0)} + {dbl(-3 / 64)} * CAST(tenure AS DOUBLE)"
     f" + {dbl(26 / 64)} * CAST(Contract = 'Month-to-month' AS DOUBLE)"
     f" + {dbl(19 / 64)} * CAST(PaymentMethod IN ('Electronic check', 'Mailed check') AS DOUBLE)"
     f" + {dbl(13 / 64)} * CAST(InternetService = 'Fiber optic' AS DOUBLE)")
P_RAW = f"({dbl(0.5)} + {dbl(0.5)} * (({Z}) / ({dbl(1.0)} + abs({Z}))))"
BAND = (f"CASE WHEN p_raw < {dbl(fixed.RISK_LOW_MAX)} THEN 'Low' "
        f"WHEN p_raw <= {dbl(fixed.RISK_MEDIUM_MAX)} THEN 'Medium' "
        f"WHEN p_raw IS NOT NULL THEN 'High' END")

SCORED = CLEAN + f""",
scored AS (
  SELECT *, round_even(p_raw, 6) AS churn_probability, {BAND} AS risk_level
  FROM (SELECT *, {P_RAW} AS p_raw FROM clean))"""

SPLIT = SCORED + """,
split_r AS (
  SELECT *, row_number() OVER (PARTITION BY Churn ORDER BY md5('42|' || customerID), customerID) AS r,
         count(*) OVER (PARTITION BY Churn) AS nc
  FROM scored),
split_n AS (
  SELECT *, floor(nc * 0.7) AS nt, nc - floor(nc * 0.7) AS rest, ceil((nc - floor(nc * 0.7)) * 0.5) AS ntest
  FROM split_r),
split AS (
  SELECT * EXCLUDE (r, nc, nt, rest, ntest),
         CASE WHEN r <= nt THEN 'train' WHEN r <= nt + (rest - ntest) THEN 'validation' ELSE 'test' END AS split
  FROM split_n)"""

TEST = SPLIT + """,
test AS (
  SELECT customerID, p_raw AS score, Churn AS y, MonthlyCharges AS charge
  FROM split WHERE split = 'test'),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, customerID) AS rn,
         count(*) OVER () AS n, sum(y) OVER () AS churners
  FROM test)"""


def w(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def sig_round(x: str, digits: int = 10) -> str:
    k = f"floor(log10(abs({x})))"
    p = f"pow(10.0::DOUBLE, abs({k}))"
    m = f"(CASE WHEN {k} >= 0 THEN {x} / {p} ELSE {x} * {p} END)"
    mr = f"round_even({m}, {digits - 1})"
    return (f"(CASE WHEN {x} = 0 OR {x} IS NULL OR isnan({x}) THEN {x} "
            f"WHEN {k} >= 0 THEN {mr} * {p} ELSE {mr} / {p} END)")
