"""Feature encoding: standard scaling + one-hot, fitted on the training split.

Fitting is one row of means / population deviations, and the distinct categories
per column, numbered by a range-partitioned sort with carried counts, so a column
of any number of categories is no task's burden.

* scale: ``(x - mean) / std`` with the population deviation; a zero deviation
  acts as 1 (Spark ML's scaler uses the sample deviation, so it is not used);
* a missing number (NULL or NaN) stands at the training mean everywhere;
* one-hot: one 0/1 column per category seen at fit, sorted; a category unseen at
  fit encodes to all zeros; NULL is a category of its own when it was seen;
* layout: numeric features first, then categoricals in list order.

``SparseEncoder`` writes (indices, values) per row: categories meet the rows in an
equi-join on (feature, category), so no expression grows with their number.
``Encoder`` gives ``ARRAY<DOUBLE>``: of up to ``LITERAL_CATEGORIES`` categories by
one projection of literals, which never shuffles, of more by way of the sparse form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.operators.rank import running_sums
from keepwise.plans.materialize import materialize
from keepwise.schema import CATEGORICAL_FEATURES, ID_COL, NUMERIC_FEATURES


def fit_scaler(train: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """``(feature, mean, std, scale)`` per numeric feature, NULLs ignored."""
    numeric = list(numeric or NUMERIC_FEATURES)
    row = train.agg(*[F.struct(F.avg(F.col(c).cast("double")).alias("mean"),
                               F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c) for c in numeric])
    long = row.unpivot([], numeric, "feature", "s")
    std = F.col("s.std")
    return long.select("feature", F.col("s.mean").alias("mean"), std.alias("std"),
                       F.when((std == 0) | std.isNull(), F.lit(1.0)).otherwise(std).alias("scale"))


def fit_onehot(train: DataFrame, categorical: list[str] | None = None) -> DataFrame:
    """``(feature, category, position)``: sorted distinct values per feature,
    0-based positions, NULL last when present."""
    categorical = list(categorical or CATEGORICAL_FEATURES)
    long = (train.select(*[F.col(c).cast("string").alias(c) for c in categorical])
            .unpivot([], categorical, "feature", "category").distinct())
    return numbered_within(long, "feature", "category", "position")


def numbered_within(distinct: DataFrame, group: str, value: str, name: str, first: int = 0) -> DataFrame:
    """Distinct (group, value) rows with the value's place in its group, NULL last."""
    order = running_sums(distinct, [F.col(group).asc(), F.col(value).asc_nulls_last()], [])
    starts = order.groupBy(group).agg(F.min("index").alias("_start"))
    return order.join(F.broadcast(starts), group).select(     # a row per group: columns of one table
        group, value, (F.col("index") - F.col("_start") + first).cast("int").alias(name))


LITERAL_CATEGORIES = 10_000   # up to so many the dense encoder is one projection without a join


@dataclass
class Encoder:
    """Fitted parameters, small enough to live in the driver and in closures."""

    numeric: list[tuple[str, float, float]]            # (feature, mean, scale)
    categories: list[tuple[str, list]]                 # (feature, [categories in order])

    @classmethod
    def fit(cls, train: DataFrame, numeric: list[str] | None = None,
            categorical: list[str] | None = None) -> "Encoder":
        numeric = list(numeric or NUMERIC_FEATURES)
        categorical = list(categorical or CATEGORICAL_FEATURES)
        return cls.from_tables(fit_scaler(train, numeric), fit_onehot(train, categorical), numeric, categorical)

    @classmethod
    def from_tables(cls, scaler: DataFrame, onehot: DataFrame, numeric: list[str],
                    categorical: list[str]) -> "Encoder":
        sc = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
        cats: dict[str, list] = {c: [] for c in categorical}
        for r in onehot.orderBy("feature", "position").collect():
            cats[r["feature"]].append(r["category"])
        return cls([(c, *sc[c]) for c in numeric], [(c, cats[c]) for c in categorical])

    @property
    def feature_names(self) -> list[str]:
        names = [c for c, _, _ in self.numeric]
        for c, values in self.categories:
            names += [f"{c}_{v}" for v in values]
        return names

    @property
    def width(self) -> int:
        return len(self.feature_names)

    def scaled(self, c: str, mean: float, scale: float) -> Column:
        return _scaled(c, mean, scale)

    def columns(self, scale: bool = True) -> list[Column]:
        """One Column per encoded feature, in layout order."""
        out = [self.scaled(c, m, s) if scale else _filled(c, m) for c, m, s in self.numeric]
        for c, values in self.categories:
            x = F.col(c).cast("string")
            for v in values:
                hit = x.isNull() if v is None else (x == F.lit(v))
                out.append(F.coalesce(hit, F.lit(False)).cast("double"))
        return out

    def transform(self, df: DataFrame, out_col: str = "features", keep: list[str] | None = None,
                  scale: bool = True) -> DataFrame:
        """``(id, *keep, features ARRAY<DOUBLE>)``. ``scale=False`` keeps raw
        numerics (the unscaled design used where an exact oracle is needed)."""
        keep = [c for c in (keep or []) if c != ID_COL]
        if self.width > LITERAL_CATEGORIES:
            wide = SparseEncoder.of(self, df.sparkSession).transform(df, keep, scale)
            return wide.select(ID_COL, *keep, dense("size", "indices", "values").alias(out_col))
        return df.select(ID_COL, *keep, F.array(*self.columns(scale)).alias(out_col))

    def scaler_table(self, spark) -> DataFrame:
        none = lambda x: None if x is None else float(x)  # noqa: E731   a column without a number
        return spark.createDataFrame([(c, none(m), none(s)) for c, m, s in self.numeric],
                                     "feature STRING, mean DOUBLE, scale DOUBLE")

    def onehot_table(self, spark) -> DataFrame:
        rows = [(c, v, i) for c, values in self.categories for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "feature STRING, category STRING, position INT")


def _filled(c: str, mean: float | None) -> Column:
    """A missing number stands at the training mean, in fitting, training and scoring alike."""
    m = F.lit(0.0 if mean is None else float(mean))
    return F.coalesce(F.nanvl(F.col(c).cast("double"), m), m)


def _scaled(c: str, mean: float | None, scale: float | None) -> Column:
    m = F.lit(0.0 if mean is None else float(mean))
    return (_filled(c, mean) - m) / F.lit(1.0 if scale is None else float(scale))


def dense(size: str, indices: str, values: str) -> Column:
    """``ARRAY<DOUBLE>`` of a sparse row."""
    at = lambda i: F.array_position(indices, i)  # noqa: E731   few indices a row
    return F.transform(F.sequence(F.lit(0), F.col(size) - 1), lambda i: F.coalesce(F.get(values, (at(i) - 1).cast("int")), F.lit(0.0)))


def sparse_dot(weights: list[float], indices: Column, values: Column) -> Column:
    """``sum_j w_j x_j`` of a sparse row, left to right over its indices; the weights are one array literal."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.arrays_zip(indices.alias("i"), values.alias("x")), F.lit(0.0), lambda z, t: z + F.get(w, t["i"]) * t["x"])


@dataclass
class SparseEncoder:
    """Scaled numbers and category indices as sparse rows; the categories stay a table."""

    numeric: list[tuple[str, float, float]]       # (feature, mean, scale)
    onehot: DataFrame                             # feature, category, position
    offsets: dict[str, int]                       # categorical feature -> index of its first category
    width: int

    @classmethod
    def fit(cls, train: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None) -> "SparseEncoder":
        numeric, categorical = list(numeric or NUMERIC_FEATURES), list(categorical or CATEGORICAL_FEATURES)
        sc = {r["feature"]: (r["mean"], r["scale"]) for r in fit_scaler(train, numeric).collect()}
        return cls._placed([(c, *sc[c]) for c in numeric], materialize(fit_onehot(train, categorical), "onehot"), categorical)

    @classmethod
    def of(cls, enc: Encoder, spark) -> "SparseEncoder":
        return cls._placed(enc.numeric, enc.onehot_table(spark), [c for c, _ in enc.categories])

    @classmethod
    def _placed(cls, numeric, onehot: DataFrame, categorical: list[str]) -> "SparseEncoder":
        sizes = {r["feature"]: r["n"] for r in onehot.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}   # a row per column
        offsets, at = {}, len(numeric)
        for c in categorical:
            offsets[c], at = at, at + sizes.get(c, 0)
        return cls(numeric, onehot, offsets, at)

    def names(self) -> DataFrame:
        """``(idx, name)`` of every encoded column, as a table."""
        spark = self.onehot.sparkSession
        first = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(self.numeric)], "idx INT, name STRING")
        base = F.element_at(F.create_map(*[x for c, o in self.offsets.items() for x in (F.lit(c), F.lit(o))]), F.col("feature"))
        return first.unionByName(self.onehot.select((base + F.col("position")).cast("int").alias("idx"), F.concat("feature", F.lit("_"), F.coalesce("category", F.lit("None"))).alias("name")))

    def transform(self, df: DataFrame, keep: list[str] | None = None, scale: bool = True) -> DataFrame:
        """``(id, *keep, size, indices ARRAY<INT>, values ARRAY<DOUBLE>)``, indices ascending.

        Rows are numbered and written once, since they are read twice; each meets its
        categories by (feature, category) and gets at most one index per column back."""
        keep, cats = [c for c in (keep or []) if c != ID_COL], list(self.offsets)
        numbers = [_scaled(c, m, s) if scale else _filled(c, m) for c, m, s in self.numeric]
        rows = materialize(df.select(ID_COL, *keep, F.array(*numbers).cast("array<double>").alias("_numbers"), F.monotonically_increasing_id().alias("_row"),
                                     F.array(*[F.col(c).cast("string") for c in cats]).cast("array<string>").alias("_cells")), "encode-rows")
        names = F.array(*[F.lit(c) for c in cats])
        cells = rows.select("_row", F.posexplode("_cells").alias("_k", "category")).select("_row", F.get(names, F.col("_k")).alias("feature"), "category")
        base = F.element_at(F.create_map(*[x for c, o in self.offsets.items() for x in (F.lit(c), F.lit(o))]), F.col("feature"))
        # plain keys: a NULL category is an empty text with a flag
        keyed = lambda t: t.withColumn("_none", F.col("category").isNull()).withColumn("category", F.coalesce("category", F.lit("")))
        hits = keyed(cells).join(keyed(self.onehot), ["feature", "category", "_none"]).select("_row", (base + F.col("position")).cast("int").alias("i"))
        found = hits.groupBy("_row").agg(F.sort_array(F.collect_list("i")).alias("_hits"))      # one per column at most
        none = F.array().cast("array<int>")
        every = rows.join(found, "_row", "left").withColumn("_hits", F.coalesce("_hits", none))
        n = len(self.numeric)
        first = F.array(*[F.lit(i) for i in range(n)]).cast("array<int>")
        return every.select(ID_COL, *keep, F.lit(self.width).alias("size"), F.concat(first, "_hits").alias("indices"),
                            F.concat("_numbers", F.transform("_hits", lambda _: F.lit(1.0))).alias("values"))


def scale_numeric(df: DataFrame, scaler: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """Scaled numeric columns next to the id (parameters collected, applied as
    column arithmetic); a missing number stands at the mean, so it scales to 0."""
    numeric = list(numeric or NUMERIC_FEATURES)
    sc = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.collect()}
    return df.select(ID_COL, *[_scaled(c, *sc[c]).alias(c) for c in numeric])


def encode_onehot_long(df: DataFrame, onehot: DataFrame) -> DataFrame:
    """``(id, feature, category, value)`` for every fitted category, 1 or 0: an unseen
    value gives 0.0 in every column of its feature."""
    feats = [r["feature"] for r in onehot.select("feature").distinct().collect()]
    long = df.select(ID_COL, *[F.col(c).cast("string").alias(c) for c in feats]).unpivot(
        [ID_COL], feats, "feature", "_v")
    return (long.join(onehot, "feature")   # AQE broadcasts the fitted categories when small
            .select(ID_COL, "feature", "category", F.col("_v").eqNullSafe(F.col("category")).cast("double").alias("value")))


def feature_names_table(enc: Encoder, spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(enc.feature_names)), "idx INT, name STRING")
