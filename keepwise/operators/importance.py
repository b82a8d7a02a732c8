"""Permutation importance: mean and (population) deviation, over repeats, of the
AUC lost when one encoded column is shuffled.

Distributed shape:

* row index ``i`` in 0..n-1 from ``hash_rank`` on ``md5(seed|id)``;
* each repeat ``r`` shuffles with the bijection ``i -> (a_r * i + b_r) mod n``
  (``gcd(a_r, n) = 1``), so "the shuffled value of row i" is an equi-join on
  that key: one join for all repeats, no row gathered anywhere;
* every (row, repeat) emits one permuted score per feature (only that feature
  taken from the partner row), and AUCs come from score histograms partitioned
  by (feature, repeat) - many small windows instead of one big one.

``a_r`` is the smallest integer >= 7919 (r+1) coprime with ``n``; ``b_r`` is
``104729 (r+1) mod n``. The SQL oracle derives the same numbers.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.functions import fixed
from keepwise.functions.scoring import sigmoid
from keepwise.operators.rank import hash_rank, running_sums
from keepwise.plans.materialize import materialize
from keepwise.schema import ID_COL

A_STEP = 7919
B_STEP = 104729


def shuffle_params(n: int, n_repeats: int) -> list[tuple[int, int, int]]:
    """``(repeat, a, b)`` per repeat for a table of ``n`` rows."""
    out = []
    for r in range(n_repeats):
        a = A_STEP * (r + 1)
        while n > 1 and gcd(a, n) != 1:
            a += 1
        out.append((r, a, (B_STEP * (r + 1)) % max(n, 1)))
    return out


class ArrayScorer:
    """What importance, scoring and what-if ask of a scorer of encoded rows.

    ``score(arr)`` is the probability as a Column over an ``ARRAY<DOUBLE>``;
    ``permuted(x, xp)`` is ``[(f, s)]``, the scores with one feature at a time taken
    from the partner row; ``still`` names the features that change no score."""

    still: frozenset = frozenset()

    def score(self, arr: Column) -> Column:
        raise NotImplementedError

    def permuted(self, x: Column, xp: Column) -> Column:
        raise NotImplementedError


class LinearArrayScorer(ArrayScorer):
    """``p = link(intercept + sum_j w_j x_j)``.

    The weights are one array literal, so the expression has the same size for any
    number of features. The logit is summed left to right from the intercept over
    the weights that are not zero and bound once; the score with feature ``f``
    permuted is then ``link(z + w_f (x'_f - x_f))``, O(1) instead of a new sum."""

    def __init__(self, weights: list[float], intercept: float, link=sigmoid):
        self.weights, self.intercept, self.link = [float(w) for w in weights], float(intercept), link
        self.still = frozenset(j for j, w in enumerate(self.weights) if w == 0.0)
        self._used = [(j, w) for j, w in enumerate(self.weights) if w != 0.0]

    def _literal(self) -> Column:
        return F.array(*[F.struct(F.lit(j).alias("f"), F.lit(w).alias("w")) for j, w in self._used])

    def logit(self, arr: Column) -> Column:
        if not self._used:
            return F.lit(self.intercept)
        return F.aggregate(self._literal(), F.lit(self.intercept), lambda z, t: z + t["w"] * F.get(arr, t["f"]))

    def score(self, arr: Column) -> Column:
        return self.link(self.logit(arr))

    def permuted(self, x: Column, xp: Column) -> Column:
        if not self._used:
            return F.array().cast("array<struct<f:int,s:double>>")
        each = lambda z: F.transform(self._literal(), lambda t: F.struct(
            t["f"].alias("f"), self.link(z + t["w"] * (F.get(xp, t["f"]) - F.get(x, t["f"]))).alias("s")))
        return F.element_at(F.transform(F.array(self.logit(x)), each), 1)


class ColumnArrayScorer(ArrayScorer):
    """Any Column function of the array, built from functions that Spark evaluates itself."""

    def __init__(self, fn, width: int):
        self.fn, self.width = fn, width

    def score(self, arr: Column) -> Column:
        return self.fn(arr)

    def permuted(self, x: Column, xp: Column) -> Column:
        swapped = lambda f: F.transform(x, lambda v, i: F.when(i == f, F.get(xp, i)).otherwise(v))
        return F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)),
                           lambda f: F.struct(f.alias("f"), self.fn(swapped(f)).alias("s")))


class ForwardScorer(ArrayScorer):
    """A NumPy function ``forward(X) -> p``, in Arrow batches: each batch of
    (row, partner) pairs is scored once per feature with that column swapped."""

    def __init__(self, forward, width: int):
        self.forward, self.width = forward, width

    def _matrix(self, arrays):
        return np.vstack(arrays.to_numpy()) if len(arrays) else np.zeros((0, self.width))

    def score(self, arr: Column) -> Column:
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(self.forward(self._matrix(x)), dtype="float64")

        return F.pandas_udf(scored, "double")(arr)

    def permuted(self, x: Column, xp: Column) -> Column:
        def swapped(x: pd.Series, xp: pd.Series) -> pd.Series:
            at, to = self._matrix(x), self._matrix(xp)
            out = np.empty((len(at), self.width))
            for f in range(self.width):
                held = at[:, f].copy()
                at[:, f] = to[:, f]
                out[:, f] = self.forward(at)
                at[:, f] = held
            return pd.Series(list(out))

        return F.transform(F.pandas_udf(swapped, "array<double>")(x, xp),
                           lambda s, f: F.struct(f.alias("f"), s.alias("s")))


class PandasUdfScorer(ArrayScorer):
    """A ``pandas_udf`` from ``ARRAY<DOUBLE>`` to the probability. Spark cannot call
    one inside a lambda, so the permuted rows are scored by its plain function."""

    def __init__(self, udf, width: int):
        self.udf, self.width = udf, width
        inner = udf.func

        def forward(X):
            return np.asarray(inner(pd.Series(list(X))), dtype="float64")

        self._rows = ForwardScorer(forward, width)

    def score(self, arr: Column) -> Column:
        return self.udf(arr)

    def permuted(self, x: Column, xp: Column) -> Column:
        return self._rows.permuted(x, xp)


def as_scorer(fn, width: int) -> ArrayScorer:
    """A scorer from whatever a caller has: an ``ArrayScorer``, a ``pandas_udf``, an
    object with ``forward(X)`` (the neural model) or a Column function of the array."""
    if isinstance(fn, ArrayScorer):
        return fn
    if hasattr(fn, "evalType"):
        return PandasUdfScorer(fn, width)
    if hasattr(fn, "forward"):
        return ForwardScorer(fn.forward, width)
    if callable(fn):
        return ColumnArrayScorer(fn, width)
    raise TypeError(f"no scorer: {fn!r}")


def linear_scorer(weights: list[float], intercept: float, link=sigmoid) -> LinearArrayScorer:
    return LinearArrayScorer(weights, intercept, link)


def _auc_by(hist: DataFrame, keys: list[str]) -> DataFrame:
    """AUC per key group from ``(keys..., s, pos, neg)``: running sums over all
    groups in order, from which each group takes off what lies before it."""
    h = running_sums(hist, [*keys, F.col("s").asc()], ["neg"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    agg = h.groupBy(*keys).agg(F.sum(wide("pos") * (2 * wide("neg_before") + wide("neg"))).alias("num"),
                               F.min("neg_before").alias("b"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    num = F.col("num") - 2 * wide("b") * wide("P")
    den = F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")
    return agg.select(*keys, F.when(den > 0, num.cast("double") / den).alias("auc"))


def permutation_importance(design: DataFrame, score_fn, names: list[str],
                           n_repeats: int = fixed.N_REPEATS, seed: int = 42,
                           label: str = "y", features: str = "features") -> DataFrame:
    """``(idx, feature, importance_mean, importance_std, baseline_auc)`` for each
    encoded column of ``design`` (``id, label, features ARRAY<DOUBLE>``).

    ``score_fn`` is anything :func:`as_scorer` takes. The unpermuted scores are one
    more group (repeat -1) of the same histogram: one sort, one written table."""
    scorer = as_scorer(score_fn, len(names))
    idx, joined = _join_partners(design, n_repeats, seed, label, features)

    x, xp = F.col("x"), F.col("xp")
    # scores first: what is expanded and shuffled is (repeat, feature, label, score), never the arrays
    scores = joined.select("r", "y", scorer.permuted(x, xp).alias("fs"))
    long = scores.select("r", "y", F.explode("fs").alias("p")).select("r", F.col("p.f").alias("f"), "y", F.col("p.s").alias("s"))
    base = idx.select(F.lit(-1).alias("r"), F.lit(-1).alias("f"), "y", scorer.score(x).alias("s"))
    hist = (long.unionByName(base).groupBy("r", "f", "s")
            .agg(F.sum("y").cast("bigint").alias("pos"), F.sum(1 - F.col("y")).cast("bigint").alias("neg")))
    aucs = materialize(_auc_by(hist, ["r", "f"]), "aucs")     # a row per feature and repeat
    first = aucs.where("r = -1").first()
    base_auc = first["auc"] if first else None
    drops = aucs.where("r >= 0").withColumn("drop", F.lit(base_auc).cast("double") - F.col("auc"))
    names_df = design.sparkSession.createDataFrame(
        [(j, n, j in scorer.still) for j, n in enumerate(names)], "f INT, feature STRING, still BOOLEAN")
    out = drops.groupBy("f").agg(F.avg("drop").alias("importance_mean"),
                                 F.stddev_pop("drop").alias("importance_std"))
    still = lambda c: F.when(F.col("still") & F.lit(base_auc is not None), F.lit(0.0)).otherwise(F.col(c)).alias(c)
    return (names_df.join(out, "f", "left")   # one row per encoded column; a weight of zero moves nothing
            .select(F.col("f").cast("int").alias("idx"), "feature", still("importance_mean"), still("importance_std"),
                    F.lit(base_auc).cast("double").alias("baseline_auc")))


def _join_partners(design: DataFrame, n_repeats: int, seed: int, label: str, features: str):
    """Rows with their shuffled partner's features for every repeat."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(ID_COL).cast("string")))
    idx = hash_rank(design.select(ID_COL, label, features).withColumn("_h", h), "_h", ID_COL,
                    rank_col="_rn", size_col="_n")
    # the index feeds both join sides and the baseline: write it once
    idx = materialize(idx.select((F.col("_rn") - 1).alias("i"), F.col(label).cast("int").alias("y"),
                                 F.col(features).alias("x")), "pi_index")
    n = int(idx.count())
    pairs = F.array(*[F.struct(F.lit(r).alias("r"),
                               ((F.lit(a).cast("bigint") * F.col("i") + F.lit(b)) % F.lit(max(n, 1))).alias("j"))
                      for r, a, b in shuffle_params(n, n_repeats)])
    left = idx.select("i", "y", "x", F.explode(pairs).alias("_rj")).select(
        "i", "y", "x", F.col("_rj.r").alias("r"), F.col("_rj.j").alias("j"))
    right = idx.select(F.col("i").alias("j"), F.col("x").alias("xp"))
    return idx, left.join(right, "j")
