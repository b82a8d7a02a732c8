"""Explanations: readable feature labels, plain-language hints, per-customer
risk drivers with playbook actions, what-if rescoring.

Per-row expressions over fixed small tables: the built-in hint dictionary is a
CASE chain (first contained key wins, in dictionary order), the driver rules an
array of structs filtered per row, the playbook a 5-row broadcast. A dictionary of
any size is a table (``hint_lookup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.functions.scoring import fixed_scorer, high_risk_flag, risk_band
from keepwise.functions.text import hint_key, humanize_feature
from keepwise.schema import ID_COL


def hint_for(name: Column) -> Column:
    """Hint text of the first dictionary key contained in the normalised name."""
    key = hint_key(name)
    out = None
    for k, text in fixed.HINTS:
        cond = key.contains(k)
        out = F.when(cond, F.lit(text)) if out is None else out.when(cond, F.lit(text))
    return out.otherwise(F.lit(fixed.DEFAULT_HINT))


GRAM = 4      # a key is met by names that hold its first characters, so many at most


def hint_table(spark) -> DataFrame:
    """The built-in dictionary as a table ``(priority, key, hint)``."""
    return spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(fixed.HINTS)], "priority INT, key STRING, hint STRING")


def _pieces(text: Column, n: int) -> Column:
    """Every stretch of n characters."""
    every = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, every).otherwise(F.array().cast("array<string>"))


def hint_lookup(names: DataFrame, hints: DataFrame, name_col: str = "name", default: str = fixed.DEFAULT_HINT) -> DataFrame:
    """``names`` with ``hint``: that of the key with the lowest priority among those the normalised
    name contains, or ``default``.

    A name that contains a key contains the key's first characters: names are taken apart into
    their distinct pieces of the lengths the dictionary has (1 to ``GRAM``), and pieces meet keys
    in an equi-join; what meets is tested in full. An empty key fits every name."""
    keys = hints.select("priority", "key", "hint", F.substring("key", 1, GRAM).alias("_gram"))
    lengths = [r[0] for r in keys.select(F.length("_gram")).distinct().collect()]      # at most GRAM + 1
    distinct = names.select(F.col(name_col).alias("_name")).distinct().where(F.col("_name").isNotNull())
    norm = hint_key(F.col("_name"))
    pieces = [F.array(F.lit(""))] if 0 in lengths else []
    pieces += [_pieces(F.col("_norm"), n) for n in lengths if n]
    if not pieces:
        return names.withColumn("hint", F.lit(default))
    cut = distinct.withColumn("_norm", norm).select("_name", "_norm", F.explode(F.array_distinct(F.concat(*pieces))).alias("_gram"))
    met = cut.join(keys, "_gram").where(F.contains("_norm", "key"))
    best = met.groupBy("_name").agg(F.min_by("hint", "priority").alias("_hint"))
    return (names.join(best, F.col(name_col) == F.col("_name"), "left")
            .withColumn("hint", F.coalesce("_hint", F.lit(default))).drop("_name", "_hint"))


def label_and_hint(names: DataFrame, name_col: str = "name") -> DataFrame:
    return names.withColumn("label", humanize_feature(F.col(name_col))).withColumn("hint", hint_for(F.col(name_col)))


def top_k_features(importances: DataFrame, k: int = fixed.TOP_K, value: str = "importance_mean") -> DataFrame:
    """The ``k`` largest importances, descending (ties by feature index)."""
    top = importances.orderBy(F.col(value).desc(), F.col("idx").asc()).limit(k)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(value).desc(), F.col("idx").asc())))


def business_hints(top: DataFrame) -> DataFrame:
    """Top features with their readable label and hint."""
    return label_and_hint(top, "feature").select("rank", "feature", "label", "hint")


def _fmt_one_decimal(x: Column) -> Column:
    # format_number rounds the exact binary value half-even, like Python's .1f
    return F.regexp_replace(F.format_number(x, 1), ",", "")


def _driver_rules(median_charge: float | None) -> list[tuple[Column, Column]]:
    """(hit, driver text) per rule, in rule order."""
    texts = fixed.DRIVER_TEXTS
    contract, tenure = F.col("Contract"), F.col("tenure")
    pay, inet, charge = F.col("PaymentMethod").cast("string"), F.col("InternetService").cast("string"), F.col("MonthlyCharges")
    med = F.lit(None).cast("double") if median_charge is None else F.lit(float(median_charge))
    conds = [
        contract == F.lit(fixed.DRIVER_MONTH_TO_MONTH),
        tenure < F.lit(fixed.DRIVER_SHORT_TENURE_MONTHS),
        F.coalesce(pay, F.lit("None")).contains(fixed.DRIVER_MANUAL_PAYMENTS[0])
        | F.coalesce(pay, F.lit("None")).contains(fixed.DRIVER_MANUAL_PAYMENTS[1]),
        charge > med * F.lit(fixed.DRIVER_HIGH_CHARGE_FACTOR),
        F.coalesce(inet, F.lit("None")).contains(fixed.DRIVER_FIBER_TOKEN)
        | (F.lower(F.coalesce(inet, F.lit("None"))) == F.lit(fixed.DRIVER_FIBER_NAME)),
    ]

    def driver_text(i: int) -> Column:
        label = texts[i][0]
        if "{tenure}" in label:
            a, b = label.split("{tenure}")
            return F.concat(F.lit(a), tenure.cast("string"), F.lit(b))
        if "{charge}" in label:
            a, b = label.split("{charge}")
            return F.concat(F.lit(a), _fmt_one_decimal(charge), F.lit(b))
        return F.lit(label)

    return [(F.coalesce(c, F.lit(False)), driver_text(i)) for i, c in enumerate(conds)]


def _driver_rows(df: DataFrame, median_charge: float | None, keep: list[str] | None = None) -> DataFrame:
    """One row per (customer, matched rule). A rule's position is one plus the
    number of earlier rules matched: column arithmetic, then ``explode`` of the
    five candidates and a filter - no per-row lambda, no window."""
    rules = _driver_rules(median_charge)
    texts = fixed.DRIVER_TEXTS
    items, seen = [], F.lit(0)
    for i, (hit, text) in enumerate(rules):
        items.append(F.struct(hit.alias("hit"), (seen + 1).cast("int").alias("position"),
                              F.lit(i + 1).alias("rule"), F.lit(fixed.DRIVER_SEGMENTS[i]).alias("segment"),
                              text.alias("driver"), F.lit(texts[i][1]).alias("why"),
                              F.lit(texts[i][2]).alias("action")))
        seen = seen + hit.cast("int")
    keep = keep or []
    return (df.select(ID_COL, *keep, F.explode(F.array(*items)).alias("_s")).filter("_s.hit")
            .select(ID_COL, *keep, "_s.position", "_s.rule", "_s.segment", "_s.driver", "_s.why", "_s.action"))


def risk_drivers(clean: DataFrame, median_charge: float | None) -> DataFrame:
    """One row per (customer, matched rule) with its 1-based position."""
    return _driver_rows(clean, median_charge)


def top3_drivers(clean: DataFrame, median_charge: float | None, scorer=None,
                 gate: bool = True) -> DataFrame:
    """First three rules per customer; with ``gate`` only customers whose
    probability is at least 0.3 (the others get no list)."""
    df = clean
    if gate:
        df = (scorer or fixed_scorer()).transform(df).filter(high_risk_flag(F.col("p_raw"))).select(*clean.columns)
    return _driver_rows(df, median_charge).filter(F.col("position") <= 3).select(
        ID_COL, "position", "driver", "action")


def playbook_table(spark) -> DataFrame:
    return spark.createDataFrame(fixed.PLAYBOOK, "segment STRING, risk_signal STRING, playbook_action STRING")


def playbook_join(drivers: DataFrame) -> DataFrame:
    """Drivers with the playbook's risk signal and action (5-row broadcast)."""
    pb = F.broadcast(playbook_table(drivers.sparkSession))
    return drivers.join(pb, "segment", "left")


def median_compare(clean: DataFrame, median_charge: float | None) -> DataFrame:
    """Each monthly charge against 1.2 x the global median."""
    med = F.lit(None).cast("double") if median_charge is None else F.lit(float(median_charge))
    return clean.select(ID_COL, "MonthlyCharges", med.alias("median_charge"),
                        (F.col("MonthlyCharges") > med * F.lit(fixed.DRIVER_HIGH_CHARGE_FACTOR)).alias("high_charge"))


def whatif_scores(clean: DataFrame, overrides: list[dict], scorer=None) -> DataFrame:
    """Re-score every customer under each override profile.

    ``overrides`` is a short parameter list such as ``[{"Contract": "Two year"}]``;
    the rows x profiles expansion is a generator (``explode`` of a literal array),
    not a join. Output: base and altered probability (6 dp), delta, both bands.
    """
    scorer = scorer or fixed_scorer()
    cols = sorted({c for o in overrides for c in o})
    types = dict(clean.dtypes)
    profiles = F.array(*[F.struct(F.lit(i + 1).alias("scenario"),
                                  *[F.lit(o.get(c)).cast(types[c]).alias(c) for c in cols])
                         for i, o in enumerate(overrides)])
    base = scorer.transform(clean).withColumnRenamed("p_raw", "_base")
    x = base.withColumn("_o", F.explode(profiles))
    x = x.select(ID_COL, "_base", F.col("_o.scenario").alias("scenario"),
                 *[c for c in clean.columns if c not in cols and c != ID_COL],
                 *[F.coalesce(F.col(f"_o.{c}"), F.col(c)).alias(c) for c in cols])
    x = scorer.transform(x).withColumnRenamed("p_raw", "_new")
    b6, n6 = F.bround("_base", 6), F.bround("_new", 6)
    return x.select(ID_COL, "scenario", b6.alias("base_probability"), n6.alias("whatif_probability"),
                    (n6 - b6).alias("delta"), risk_band(F.col("_base")).alias("base_risk"),
                    risk_band(F.col("_new")).alias("whatif_risk"),
                    risk_band(F.col("_new"), fixed.RISK_LABELS_DASHBOARD).alias("whatif_label"))
