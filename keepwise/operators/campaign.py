"""Capacity-driven prioritisation and campaign ROI over the global risk rank.

Each request (a capacity, a scenario) is a cut ``rn <= k`` of the ranking. The
ranking gets running sums once (churners, their charges), so a cut is one row of
that table: requests are a table too and meet it by ``rn = k``. The plan is the
same for three scenarios and for a million. Money is summed as DECIMAL (exact
cents) and reported as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.operators.rank import running_sums

MONEY = "decimal(28,10)"   # exact sums that do not depend on the order


def default_capacity(n: int) -> int:
    return min(fixed.CAPACITY_DEFAULT_MAX, max(1, n // 5))


def cut_sums(ranked: DataFrame, rank: str = "rn", score: str = "score", label: str = "y", charge: str = "charge") -> DataFrame:
    """``(k, score_k, churners, money)``: the k-th row's score, and sums over the top k, for every k."""
    y = F.col(label).cast("bigint")
    rows = ranked.select(F.col(rank).cast("bigint").alias("k"), F.col(score).alias("score_k") if score in ranked.columns else F.lit(None).cast("double").alias("score_k"),
                         F.coalesce(y, F.lit(0)).alias("_y"), F.coalesce((F.col(charge) * y).cast(MONEY), F.lit(0).cast(MONEY)).alias("_m"))
    sums = running_sums(rows, ["k"], ["_y", "_m"])
    return sums.select("k", "score_k", (F.col("_y_before") + F.col("_y")).alias("churners"), (F.col("_m_before") + F.col("_m")).alias("money"))


def _facts(ranked: DataFrame, score: str | None = None) -> tuple[int, float | None]:
    """Rows, and the lowest score."""
    low = F.min(score) if score else F.lit(None).cast("double")
    r = ranked.agg(F.count(F.lit(1)).alias("n"), low.alias("low")).first()
    return int(r["n"]), r["low"]


def capacity_topn(ranked: DataFrame, capacities: list[int] | DataFrame | None = None, rank: str = "rn",
                  score: str = "score", label: str = "y", charge: str = "charge") -> DataFrame:
    """Per capacity ``N`` (clamped to the row count): the implied threshold (score
    of the N-th row), churners captured and monthly revenue covered
    (``sum(charge * y)``) among the top ``N``. ``capacities`` is a list or a table
    ``(request, requested)``."""
    n, low = _facts(ranked, score)
    spark = ranked.sparkSession
    if not isinstance(capacities, DataFrame):
        wanted = capacities if capacities is not None else [default_capacity(n)]
        capacities = spark.createDataFrame([(i + 1, int(c)) for i, c in enumerate(wanted)], "request INT, requested BIGINT")
    asked = capacities.select("request", F.col("requested").cast("bigint").alias("requested"),
                              F.greatest(F.lit(0), F.least(F.col("requested"), F.lit(n))).cast("bigint").alias("capacity"))
    sums = cut_sums(ranked, rank, score, label, charge)
    return asked.join(sums, asked.capacity == sums.k, "left").select(
        "request", "requested", "capacity",
        F.when(F.col("capacity") > 0, F.coalesce("score_k", F.lit(low).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("implied_threshold"),
        F.coalesce("churners", F.lit(0)).cast("bigint").alias("churners_captured"),
        F.coalesce(F.col("money").cast("double"), F.lit(0.0)).alias("revenue_covered"))


def campaign_plan(n: int, scenario: dict) -> tuple[int, int]:
    """(pool size, contacted) for a scenario: the pool is the top 20 % (at least
    one), the contacted share of it is rounded half-even."""
    pool = max(1, int(round(n * fixed.HIGH_RISK_POOL_PCT / 100)))
    contacted = max(0, int(round(scenario["pct_contacted"] / 100 * pool)))
    return pool, contacted


SCENARIO = "scenario INT, pct_contacted DOUBLE, success_rate DOUBLE, cost_per_contact DOUBLE, avg_discount DOUBLE"


def campaign_roi(ranked: DataFrame, scenarios: list[dict] | DataFrame | None = None, rank: str = "rn",
                 label: str = "y", charge: str = "charge") -> DataFrame:
    """One row per scenario (``pct_contacted, success_rate, cost_per_contact,
    avg_discount``): contacted, churners reached, churn avoided, average charge
    of those churners, 12-month revenue preserved, cost and net benefit.
    Zero contacts give zero impact. ``scenarios`` is a list or a table ``SCENARIO``."""
    n, _ = _facts(ranked)
    if not isinstance(scenarios, DataFrame):
        rows = [(i + 1, *(float(s[c]) for c in ("pct_contacted", "success_rate", "cost_per_contact", "avg_discount")))
                for i, s in enumerate(scenarios or [dict(fixed.DEFAULT_CAMPAIGN)])]
        scenarios = ranked.sparkSession.createDataFrame(rows, SCENARIO)
    pool = max(1, int(round(n * fixed.HIGH_RISK_POOL_PCT / 100)))
    # rint rounds half to even, as Python's round
    planned = scenarios.withColumn("n_contacted", F.greatest(F.lit(0), F.rint(F.col("pct_contacted") / 100 * pool).cast("bigint")))
    sums = cut_sums(ranked, rank, "", label, charge)
    # more contacts than rows reach all of them
    met = planned.withColumn("_k", F.least("n_contacted", F.lit(n).cast("bigint"))).join(sums, F.col("_k") == sums.k, "left")
    churners = F.coalesce("churners", F.lit(0)).cast("bigint")
    avoided = churners * (F.col("success_rate") / 100)
    avg_charge = F.coalesce(F.col("money").cast("double"), F.lit(0.0)) / F.greatest(F.lit(1), churners)
    preserved = avoided * F.greatest(F.lit(0.0), avg_charge - F.col("avg_discount")) * fixed.MONTHS_HORIZON
    cost = F.col("n_contacted").cast("double") * F.col("cost_per_contact")
    live = lambda v, zero=0.0: F.when(F.col("n_contacted") > 0, v).otherwise(F.lit(zero))
    return met.select("scenario", "pct_contacted", "success_rate", "cost_per_contact", "avg_discount",
                      F.lit(pool).cast("bigint").alias("pool_size"), "n_contacted",
                      live(churners, 0).cast("bigint").alias("churners_contacted"), live(avoided).alias("churn_avoided"),
                      live(avg_charge).alias("avg_charge_churners"), live(preserved).alias("revenue_preserved"),
                      live(cost).alias("total_cost"), live(preserved - cost).alias("net_benefit"))
