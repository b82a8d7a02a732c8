"""Classifiers with the reference's contract: weighted binary cross-entropy,
sigmoid probability out.

* ``train_logit``: Spark ML ``LogisticRegression`` with a per-row class weight.
* ``train_mlp``: Dense 64 ReLU -> dropout 0.3 -> Dense 32 ReLU -> dropout 0.3 ->
  sigmoid, Adam on batches of 32, class-weighted loss, early stopping on the
  (unweighted) validation loss with the best weights restored.

Training rows are numbered once in hash order and dealt to virtual workers of at
most ``WORKER_ROWS`` rows each: one worker for a table as small as the reference's,
more as it grows, whatever the number of tasks. An epoch is one job: every worker
runs through its rows in batches, in an order and with dropout masks seeded by
epoch and worker, from the weights and optimiser state the epoch began with; their
end states are averaged by rows, in worker order. So the fitted model depends on
the data and the seed alone, not on partitions. Rows never leave the executors.
(A synchronous exchange of gradients for every batch, by a barrier stage's
``allGather``, takes about a second per batch and was not kept.)
Built-in ``MultilayerPerceptronClassifier`` has no row weights, dropout or early
stopping, hence this trainer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepwise.functions.scoring import linear_vector_score, sigmoid
from keepwise.operators.encode import Encoder
from keepwise.operators.rank import hash_rank
from keepwise.plans.materialize import materialize
from keepwise.schema import ID_COL
from keepwise.sources import params as store

EPS = 1e-7
WORKER_ROWS = 100_000    # rows that one virtual worker goes through in an epoch


def class_weight_column(train: DataFrame, label: str = "y"):
    """Balanced weight per row as a CASE expression over the (two) classes."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(counts.values()), len(counts)
    expr = None
    for c, nc in counts.items():
        w = float(n) / (k * nc)
        expr = F.when(F.col(label) == c, F.lit(w)) if expr is None else expr.when(F.col(label) == c, F.lit(w))
    return expr.otherwise(F.lit(1.0)), {int(c): float(n) / (k * nc) for c, nc in counts.items()}


# ---------------------------------------------------------------------------
# linear model
# ---------------------------------------------------------------------------
@dataclass
class LinearModel:
    weights: list[float]
    intercept: float
    encoder: Encoder | None = None

    def probability_from(self, features) -> "F.Column":
        return sigmoid(linear_vector_score(features, self.weights, self.intercept))

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != ID_COL]
        x = self.encoder.transform(df, keep=keep)
        return x.withColumn("p_raw", self.probability_from(F.col("features"))).drop("features")

    def table(self, names: list[str], spark) -> DataFrame:
        rows = [("(intercept)", float(self.intercept))] + list(zip(names, map(float, self.weights)))
        return spark.createDataFrame(rows, "name STRING, weight DOUBLE")


def train_logit(train_design: DataFrame, label: str = "y", reg: float = 0.0,
                max_iter: int = 100) -> LinearModel:
    """Class-weighted logistic regression on an ``ARRAY<DOUBLE>`` design."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    wcol, _ = class_weight_column(train_design, label)
    data = train_design.select(array_to_vector("features").alias("fv"),
                               F.col(label).cast("double").alias("label"), wcol.alias("w"))
    lr = LogisticRegression(featuresCol="fv", labelCol="label", weightCol="w", regParam=reg,
                            maxIter=max_iter, standardization=False)
    m = lr.fit(data)
    return LinearModel([float(v) for v in m.coefficients.toArray()], float(m.intercept))


# ---------------------------------------------------------------------------
# neural model
# ---------------------------------------------------------------------------
@dataclass
class MLPParams:
    mats: list[np.ndarray]            # W1 (d x h1), W2 (h1 x h2), W3 (h2 x 1)
    biases: list[np.ndarray]
    dropout: float = 0.3

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.mats + self.biases])

    def shapes(self):
        return [a.shape for a in self.mats + self.biases]

    @classmethod
    def unflat(cls, v: np.ndarray, shapes, dropout: float) -> "MLPParams":
        out, i = [], 0
        for s in shapes:
            n = int(np.prod(s))
            out.append(v[i:i + n].reshape(s))
            i += n
        k = len(shapes) // 2
        return cls(out[:k], out[k:], dropout)

    @classmethod
    def init(cls, d: int, hidden=(64, 32), seed: int = 42, dropout: float = 0.3) -> "MLPParams":
        rng = np.random.default_rng(seed)
        sizes = [d, *hidden, 1]
        mats = []
        for a, b in zip(sizes[:-1], sizes[1:]):
            lim = np.sqrt(6.0 / (a + b))           # Glorot uniform
            mats.append(rng.uniform(-lim, lim, size=(a, b)))
        return cls(mats, [np.zeros(b) for b in sizes[1:]], dropout)

    def forward(self, X: np.ndarray) -> np.ndarray:
        h = X
        for W, b in zip(self.mats[:-1], self.biases[:-1]):
            h = np.maximum(h @ W + b, 0.0)
        z = h @ self.mats[-1] + self.biases[-1]
        return 1.0 / (1.0 + np.exp(-z[:, 0]))

    def layers(self) -> list[tuple[str, str, list]]:
        out = []
        for i, (W, b) in enumerate(zip(self.mats, self.biases)):
            out.append((f"dense_{i}_kernel", "matrix", W.tolist()))
            out.append((f"dense_{i}_bias", "vector", b.tolist()))
        return out

    @classmethod
    def from_layers(cls, layers, dropout: float = 0.3) -> "MLPParams":
        d = {name: np.asarray(v, dtype=float) for name, _, v in layers}
        k = len([n for n in d if n.endswith("_kernel")])
        return cls([d[f"dense_{i}_kernel"] for i in range(k)], [d[f"dense_{i}_bias"].ravel() for i in range(k)],
                   dropout)


def _bce(p, y):
    p = np.clip(p, EPS, 1 - EPS)
    return -(y * np.log(p) + (1 - y) * np.log(1 - p))


def _right(p, y) -> float:
    return float(np.sum((p > 0.5) == (y > 0.5)))


def _grad_sums(params: MLPParams, X, y, w, rng):
    """Sum over rows of d(w * loss)/d(theta) with dropout, sum(w * loss) and how many rows are right."""
    keep = 1.0 - params.dropout
    acts, masks, pres = [X], [], []
    h = X
    for W, b in zip(params.mats[:-1], params.biases[:-1]):
        pre = h @ W + b
        m = (rng.random(pre.shape) < keep) / keep if params.dropout > 0 else np.ones_like(pre)
        h = np.maximum(pre, 0.0) * m
        pres.append(pre)
        masks.append(m)
        acts.append(h)
    z = h @ params.mats[-1] + params.biases[-1]
    p = 1.0 / (1.0 + np.exp(-z[:, 0]))
    loss = float(np.sum(w * _bce(p, y)))
    dz = (w * (np.clip(p, EPS, 1 - EPS) - y))[:, None]
    gm, gb = [None] * len(params.mats), [None] * len(params.mats)
    gm[-1], gb[-1] = acts[-1].T @ dz, dz.sum(axis=0)
    delta = dz
    for i in range(len(params.mats) - 2, -1, -1):
        delta = (delta @ params.mats[i + 1].T) * masks[i] * (pres[i] > 0)
        gm[i], gb[i] = acts[i].T @ delta, delta.sum(axis=0)
    return np.concatenate([g.ravel() for g in gm + gb]), loss, _right(p, y)


@dataclass
class TrainLog:
    history: list[tuple[int, float, float, float, float]] = field(default_factory=list)   # epoch, loss, accuracy, val_loss, val_accuracy
    best_epoch: int = 0
    epochs_run: int = 0

    def table(self, spark) -> DataFrame:
        rows = [(int(e), *map(float, rest), e == self.best_epoch) for e, *rest in self.history]
        return spark.createDataFrame(rows, "epoch INT, loss DOUBLE, accuracy DOUBLE, val_loss DOUBLE, val_accuracy DOUBLE, is_best BOOLEAN")


def early_stopping(history: DataFrame, patience: int = 10) -> DataFrame:
    """``(best_epoch, best_val_loss, epochs_run)`` of a table ``(epoch, val_loss)``: training stops at the
    first epoch whose loss has not fallen below the best one for ``patience`` epochs; the first best counts."""
    so_far = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)      # a row per epoch
    best = F.min(F.struct("val_loss", "epoch")).over(so_far)
    h = history.select("epoch", "val_loss", best.alias("b"), F.max("epoch").over(Window.partitionBy(F.lit(0))).alias("last"))
    stop = F.min(F.when(F.col("epoch") - F.col("b.epoch") >= patience, F.col("epoch")))
    ends = h.agg(F.coalesce(stop, F.max("last")).alias("epochs_run"))
    return (h.join(ends, F.col("epoch") == F.col("epochs_run"))
            .select(F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("best_val_loss"), "epochs_run"))


def _adam(theta, m, v, g, t, lr, beta1, beta2):
    m = beta1 * m + (1 - beta1) * g
    v = beta2 * v + (1 - beta2) * g * g
    mh, vh = m / (1 - beta1 ** t), v / (1 - beta2 ** t)
    return theta - lr * mh / (np.sqrt(vh) + 1e-7), m, v


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for every 64-bit number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbered(design: DataFrame, label: str, split_col: str, seed: int, worker_rows: int) -> tuple[DataFrame, int, int]:
    """(worker, i, x, y, w, is_train) of the train and validation rows, written once and dealt by worker;
    how many workers, and how many features."""
    rows = design.filter(F.col(split_col).isin("train", "validation")).select(
        F.col(ID_COL), F.col("features").alias("x"), F.col(label).cast("double").alias("y"), (F.col(split_col) == "train").alias("is_train"))
    _, cw = class_weight_column(rows.filter("is_train").withColumn("_c", F.col("y").cast("int")), "_c")
    weight = F.when(~F.col("is_train"), 1.0).when(F.col("y") == 1.0, F.lit(cw.get(1, 1.0))).otherwise(F.lit(cw.get(0, 1.0)))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(ID_COL).cast("string")))
    ranked = hash_rank(rows.withColumn("_h", digest), "_h", ID_COL, rank_col="_i", size_col="_n", then=["is_train", "y", "x"])
    ranked = materialize(ranked.select((F.col("_i") - 1).alias("i"), "_n", "x", "y", weight.alias("w"), "is_train"), "design")
    first = ranked.select("_n", F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to train on")
    workers = max(1, -(-int(first["_n"]) // worker_rows))
    dealt = ranked.select((F.col("i") % workers).alias("worker"), "i", "x", "y", "w", "is_train")
    # a worker is a task of its own: hashed numbers would put several behind one another
    return dealt.repartitionById(workers, F.col("worker").cast("int")), workers, int(first["d"])


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _in_order(parts: DataFrame, workers: int) -> np.ndarray:
    """Element-wise sum over workers, on the executors and in worker order, so that it is the same every time."""
    if workers == 1:
        return np.array(parts.first()["part"])
    each = parts.select("worker", F.posexplode("part").alias("k", "v")).groupBy("k").agg(
        F.sort_array(F.collect_list(F.struct("worker", "v"))).alias("vs"))      # a value per worker
    rows = each.select("k", F.aggregate("vs", F.lit(0.0), lambda a, x: a + x["v"]).alias("v")).toArrow()
    out = np.zeros(rows.num_rows)
    out[rows.column("k").to_numpy()] = rows.column("v").to_numpy()
    return out


def train_mlp(design: DataFrame, label: str = "y", split_col: str = "split", hidden=(64, 32),
              dropout: float = 0.3, lr: float | None = None, epochs: int = 200, patience: int = 10,
              seed: int = 42, beta1: float = 0.9, beta2: float = 0.999, batch_size: int | None = 32,
              worker_rows: int = WORKER_ROWS, checkpoint: str | None = None, resume: bool = False,
              after_epoch=None) -> tuple[MLPParams, TrainLog]:
    """Train on rows with ``split == 'train'``; stop on the validation rows.

    ``batch_size=32`` with learning rate 0.001 is the reference's training;
    ``batch_size=None`` takes one full-batch Adam step per epoch (rate 0.01), whose
    gradient is a sum over all workers: for tables where a pass over the rows costs
    more than many steps are worth.

    ``checkpoint`` names a folder that gets a committed version of weights, optimiser
    state and history at every epoch that is better than all before. ``resume`` goes
    on from the last committed version; as an epoch depends on its state and seed
    alone, the end is the same as without the break. ``after_epoch(log)`` is called
    with the history so far."""
    lr = lr if lr is not None else (0.01 if batch_size is None else 0.001)
    dealt, workers, d = _numbered(design, label, split_col, seed, worker_rows)
    # kept in executor memory/disk for the epochs; a lost executor re-reads its part of the written table
    data = dealt.persist(StorageLevel.MEMORY_AND_DISK)
    spark = design.sparkSession
    counts = {r["is_train"]: r["count"] for r in data.groupBy("is_train").count().collect()}
    n_train, n_val = counts.get(True, 0), counts.get(False, 0)

    start = MLPParams.init(d, hidden, seed, dropout)
    shapes, theta = start.shapes(), start.flat()
    size = len(theta)
    m, v, steps = np.zeros(size), np.zeros(size), 0
    best, best_loss, wait, log, first = theta.copy(), np.inf, 0, TrainLog(), 1
    saved = store.load_checkpoint(spark, checkpoint) if checkpoint and resume else None
    if saved:
        arrays, facts = saved
        theta, m, v, steps = arrays["theta"], arrays["m"], arrays["v"], facts["steps"]
        log.history, log.best_epoch = [tuple(h) for h in facts["history"]], facts["epoch"]
        best, best_loss, first = theta.copy(), facts["val_loss"], facts["epoch"] + 1

    # Job j computes the validation loss at the weights it begins with (the end of epoch j-1, as
    # in Keras: after that epoch's updates) and then trains epoch j; a last job only closes the final epoch.
    pending = None                       # (epoch, training loss, accuracy) awaiting its validation loss
    for job in range(first, epochs + 2):
        theta0, m0, v0, t0 = theta, m, v, steps

        def run(batches):     # shipped at once, so that it sees this epoch's state
            here = list(batches)
            table = pa.Table.from_batches(here) if here else None
            for worker in sorted(table.column("worker").unique().to_pylist()) if here else []:      # one, as they are dealt
                yield from train(worker, table.filter(pc.equal(table.column("worker"), worker))).to_batches()

        def train(worker, table):
            order = np.argsort(table.column("i").to_numpy(), kind="stable")
            X, y, w, tr, i = (c[order] for c in (_matrix(table.column("x"), d), *(table.column(n).to_numpy() for n in ("y", "w", "is_train", "i"))))
            here = MLPParams.unflat(theta0, shapes, dropout)
            p = here.forward(X[~tr])
            tail = [0.0, float(np.sum(_bce(p, y[~tr]))), float(tr.sum()), 0.0, 0.0, _right(p, y[~tr])]
            X, y, w, i = X[tr], y[tr], w[tr], i[tr]
            rng = np.random.default_rng([seed, job, worker])
            if batch_size is None:
                g, tail[0], tail[4] = _grad_sums(here, X, y, w, rng)
                body = g
            else:
                th, mm, vv, t = theta0, m0, v0, t0
                shuffle = np.argsort(_mix(i.astype(np.uint64) + _mix(np.array([seed * 1_000_003 + job], dtype=np.uint64))), kind="stable")
                th = th.copy()
                net = MLPParams.unflat(th, shapes, dropout)      # views of the weights
                for b in range(0, len(y), batch_size):
                    sel = shuffle[b:b + batch_size]
                    g, loss, right = _grad_sums(net, X[sel], y[sel], w[sel], rng)
                    t += 1
                    th[:], mm, vv = _adam(th, mm, vv, g / len(sel), t, lr, beta1, beta2)
                    tail[0] += loss
                    tail[4] += right
                tail[3] = float(t - t0) * len(y)
                body = np.concatenate([th, mm, vv]) * len(y)
            return pa.table({"worker": pa.array([worker], pa.int64()),
                             "part": pa.array([np.concatenate([body, tail])], pa.list_(pa.float64()))})

        vec = _in_order(data.mapInArrow(run, "worker LONG, part ARRAY<DOUBLE>"), workers)
        loss_sum, val_sum, rows, stepped, right, val_right = vec[-6:]
        loss, val_loss = loss_sum / max(1, n_train), val_sum / max(1, n_val)
        if not np.isfinite(loss) or not np.isfinite(val_loss):
            raise ValueError(f"training loss {loss} and validation loss {val_loss} have to be finite")
        if pending is not None:
            epoch = pending[0]
            log.history.append((*pending, float(val_loss), float(val_right / max(1, n_val))))
            if val_loss < best_loss:
                best, best_loss, wait, log.best_epoch = theta.copy(), float(val_loss), 0, epoch
                if checkpoint:
                    store.save_checkpoint(spark, checkpoint, epoch, {"theta": theta, "m": m, "v": v},
                                          {"epoch": epoch, "steps": steps, "val_loss": best_loss, "history": log.history})
            else:
                wait += 1
            if after_epoch:
                after_epoch(log)
            if wait >= patience:
                break
        if job == epochs + 1:
            break
        pending = (job, float(loss), float(right / max(1, n_train)))
        if batch_size is None:
            steps += 1
            theta, m, v = _adam(theta, m, v, vec[:size] / max(1, n_train), steps, lr, beta1, beta2)
        else:                       # the workers' end states, averaged by rows
            theta, m, v = (vec[k * size:(k + 1) * size] / max(1.0, rows) for k in range(3))
            steps += int(round(stepped / max(1.0, rows)))
    log.epochs_run = len(log.history)
    data.unpersist()
    return MLPParams.unflat(best, shapes, dropout), log


@dataclass
class MLPScorer:
    """Arrow-batched scoring: weights travel in the task closure (a few
    thousand floats), each batch is one matrix product chain."""

    params: MLPParams
    encoder: Encoder

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != ID_COL]
        x = self.encoder.transform(df, keep=keep)
        params = self.params
        out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in x.schema.fields
                               if f.name != "features") + ", p_raw DOUBLE"

        def score(it):
            for pdf in it:
                if pdf.empty:
                    yield pdf.drop(columns=["features"]).assign(p_raw=pd.Series(dtype=float))
                    continue
                X = np.vstack(pdf["features"].to_numpy())
                out = pdf.drop(columns=["features"])
                out["p_raw"] = params.forward(X)
                yield out

        return x.mapInPandas(score, out_schema)
