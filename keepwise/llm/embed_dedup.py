"""Embedding near-dedup by int8 tile products with proven error bounds.

Vectors are scaled to length 1 and quantised to int8 with a scale of their own, and
each keeps the exact length of its rounding error. For two of them
``|x.y - sx sy qx.qy| <= |ex| |sy qy| + |ey|`` (Cauchy-Schwarz), so a pair whose
quantised product plus that bound is below the threshold cannot be a link. Products
of whole tiles are matrix products; only the pairs that may pass are recomputed in
double precision.

Tiles are cells around centres taken from the data, each vector at home in the
nearest one. A pair at or above the threshold lies within a chord of
``sqrt(2 - 2 t)``, so a vector must visit another cell only if it lies no farther
than that from the plane between the two centres; every pair then meets at least
once, in the lower of the two cells. Cells with more than ``TILE`` vectors are dealt
into several tiles that visit each other. A task holds one tile and streams its
visitors; the visitors of a tile that has many are dealt over several tasks, each with
a copy of the tile, whose own pairs the first of them counts.

Equal vectors are one class first, so copies cost nothing. A tile gives back a link
count per vector and enough links to join what is joined, never all pairs.

Edge cases: null vectors, vectors of length 0 or with null or non-finite components
link with nothing; vectors of different dimension never link; repeated vec_ids are
separate rows of one id; an empty table gives an empty result; other columns (labels
among them) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import materialize
from keepwise.llm.graph import components, tile_labels

THRESHOLD = 0.9
CELL, TILE, MAX_CENTRES = 2048, 4096, 2048
VISITORS = 1.0    # a task streams about this many times ``TILE`` visitors
BATCH = 1024
_SLACK = 1e-6     # over every rounding of the float32 geometry of cells


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1. A power of two first brings the largest component near 1, which
    rounds nothing and keeps the squares of very large and very small ones in range."""
    if v.size:
        v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, exact in products), scale, |error|, |scale * q| of unit rows."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None])
    back = q * scale[:, None]
    return q.astype(np.float32), scale, np.linalg.norm(u - back, axis=1) + 1e-12, np.linalg.norm(back, axis=1)


def classes_of(vectors: DataFrame) -> DataFrame:
    """cls, low (smallest vec_id), n, dim, v (double array) of every distinct usable vector."""
    v = F.col("embedding").cast("array<double>")
    usable = (vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(
        F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)))
    usable = usable.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))   # -0.0 becomes 0.0
    return (usable.withColumn("row", F.monotonically_increasing_id()).groupBy("v")
            .agg(F.min("row").alias("cls"), F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
            .select("cls", "low", "n", F.size("v").alias("dim"), "v"))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, v in enumerate(column):
        out[k, : len(v)] = v
    return out


def _visits(classes: DataFrame, centres: np.ndarray, chord: float) -> DataFrame:
    """cls, n, dim, v, cell and the lower cells the vector has to visit."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = unit(centres)
        gap = np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 256 else None
        for pdf in frames:
            for at in range(0, len(pdf), BATCH):
                p = pdf.iloc[at:at + BATCH]
                x = unit(_matrix(p["v"], c.shape[1]))[:, : c.shape[1]] if len(p) else np.zeros((0, c.shape[1]))
                dots = x @ c.T
                home = dots.argmax(axis=1)
                near = dots[np.arange(len(p)), home][:, None] - dots
                apart = gap[home] if gap is not None else np.sqrt(np.maximum(0, 2 - 2 * c[home] @ c.T))
                must = (near <= chord * apart + _SLACK) & (np.arange(len(c))[None, :] < home[:, None])
                yield p.assign(cell=home.astype("int32"), visits=[np.flatnonzero(m).astype("int32").tolist() for m in must])

    return classes.select("cls", "n", "dim", "v").mapInPandas(
        run, "cls long, n long, dim int, v array<double>, cell int, visits array<int>")


class _Tile:
    """One tile's home vectors, their link counts and what is joined so far."""

    def __init__(self, pdf: pd.DataFrame, threshold: float, own_pairs: bool = True):
        self.cls, self.n, self.dim = (pdf[c].to_numpy() for c in ("cls", "n", "dim"))
        self.t, self.width = threshold, int(self.dim.max())
        self.u = unit(_matrix(pdf["v"], self.width))
        self.q = quantise(self.u)
        self.links = np.zeros(len(pdf), dtype=np.int64)
        self.label = np.arange(len(pdf))
        for at in range(0, len(pdf) if own_pairs else 0, BATCH):
            i, j = self._linked(self.u[at:at + BATCH], self.dim[at:at + BATCH], at)
            self.links += np.bincount(i, self.n[j], len(pdf)).astype(np.int64) + np.bincount(j, self.n[i], len(pdf)).astype(np.int64)
            self._join(i, j, 0)

    def _linked(self, u: np.ndarray, dim: np.ndarray, at: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (batch, home) at or above the threshold; with ``at`` the batch is the home rows from there, each pair once."""
        q, scale, err, length = quantise(u)
        hq, hs, he, hl = self.q
        bound = (q @ hq.T).astype(np.float64) * scale[:, None] * hs[None, :] + err[:, None] * hl[None, :] + he[None, :]
        may = (bound >= self.t - 1e-9) & (dim[:, None] == self.dim[None, :])
        if at is not None:
            may &= np.arange(len(hs))[None, :] > at + np.arange(len(u))[:, None]
        i, j = np.nonzero(may)
        parts = 1 + len(i) // 65536
        ok = np.concatenate([np.einsum("ij,ij->i", u[a], self.u[b]) >= self.t
                             for a, b in zip(np.array_split(i, parts), np.array_split(j, parts))])
        i, j = i[ok], j[ok]
        return (i, j) if at is None else (i + at, j)

    def _join(self, i: np.ndarray, j: np.ndarray, guests: int) -> None:
        home = len(self.label)
        every = np.arange(home)
        self.label = tile_labels(home + guests, np.concatenate([i, every]), np.concatenate([j, self.label]))[:home]

    def visit(self, g: pd.DataFrame) -> pd.DataFrame:
        """Link counts of a batch of visitors and one joining link for each that has any."""
        dim, n, cls = g["dim"].to_numpy(), g["n"].to_numpy(), g["cls"].to_numpy()
        u = unit(_matrix(g["v"], max(self.width, int(dim.max()))))[:, : self.width]
        u = np.where(u.any(axis=1, keepdims=True), u, 1e-30)   # rows of another dimension, masked out below
        i, j = self._linked(u, dim, None)
        self.links += np.bincount(j, n[i], len(self.cls)).astype(np.int64)
        self._join(i + len(self.cls), j, len(g))
        lead, first = np.unique(i, return_index=True)
        return _result(cls, np.bincount(i, self.n[j], len(g)).astype(np.int64), cls[lead], self.cls[j[first]])

    def close(self) -> pd.DataFrame:
        hung = np.flatnonzero(self.label != np.arange(len(self.label)))
        return _result(self.cls, self.links, self.cls[hung], self.cls[self.label[hung]])


def _result(cls: np.ndarray, links: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Rows (a, null, links) with a link count, then rows (a, b, null) that join."""
    hit = links > 0
    return pd.DataFrame({"a": np.concatenate([cls[hit], a]),
                         "b": pd.array([pd.NA] * int(hit.sum()) + b.tolist(), dtype="Int64"),
                         "links": pd.array(links[hit].tolist() + [pd.NA] * len(a), dtype="Int64")})


def _tiles(rows: DataFrame, threshold: float) -> DataFrame:
    """Link counts and joining links of every tile: its home rows come first, its visitors are streamed."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, home, tile = None, [], None
        opened = lambda: tile or _Tile(pd.concat(home, ignore_index=True), threshold, key[2] == 0)
        for pdf in frames:
            for k, part in pdf.groupby(["cell", "tile", "part"], sort=False):
                if k != key:
                    if home:
                        yield opened().close()
                    key, home, tile = k, [], None
                if (part["visitor"] == 0).any():
                    home.append(part[part["visitor"] == 0])
                guests = part[part["visitor"] == 1]
                if len(guests) and home:
                    tile = opened()
                    for at in range(0, len(guests), BATCH):
                        yield tile.visit(guests.iloc[at:at + BATCH])
        if home:
            yield opened().close()

    dealt = rows.repartition("cell", "tile", "part").sortWithinPartitions("cell", "tile", "part", "visitor", "cls")
    return dealt.mapInPandas(run, "a long, b long, links long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, tile: int = TILE,
                           visitors: float = VISITORS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``."""
    classes = materialize(classes_of(vectors), "vec-classes")
    count = classes.count()
    # centres: a bounded sample, those with the smallest hash
    k = min(MAX_CENTRES, max(1, count // cell))
    picked = [r.v for r in classes.orderBy(F.xxhash64("v"), "cls").limit(k).select("v").collect()]
    width = max(map(len, picked), default=1)
    centres = _matrix(picked, width) if picked else np.ones((1, 1))
    wide = classes.agg(F.max("dim")).first()[0] or 1
    centres = np.pad(centres, ((0, 0), (0, max(0, wide - width))))
    placed = materialize(_visits(classes, centres, float(np.sqrt(2 - 2 * threshold))), "vec-cells")
    # a cell of more than ``tile`` vectors is dealt into several tiles; a row per centre from here to the driver
    guests = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("g"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(guests, "cell", "left").collect()
    facts = {int(r.cell): (-(-r.n // tile), r.n, r.g or 0) for r in cells} or {0: (1, 0, 0)}
    known = lambda k: F.create_map(*[F.lit(x) for c, f in facts.items() for x in (c, int(f[k]))])
    many, size, came = known(0), known(1), known(2)
    own = F.pmod(F.xxhash64("cls"), many[F.col("cell")]).cast("int")
    placed = placed.withColumn("own", own)

    def parts(cell: Column, k: Column) -> Column:
        """Tasks for a tile: its visitors are those of the cell and the cell's later tiles."""
        within = size[cell] * (many[cell] - 1 - k) / many[cell]
        return F.greatest(F.lit(1), F.ceil((came[cell] + within) / (visitors * tile))).cast("int")

    take = lambda rows, cell, visitor, part: rows.select("cls", "n", "dim", "v", cell.alias("cell"), "tile", F.lit(visitor).alias("visitor"), part.alias("part"))
    in_part = lambda cell: F.pmod(F.xxhash64("cls", F.lit(1)), parts(cell, F.col("tile"))).cast("int")
    here, there = F.col("cell"), F.col("to")
    home = take(placed.withColumn("tile", F.col("own")).withColumn("part", F.explode(F.sequence(F.lit(0), parts(here, F.col("own")) - 1))), here, 0, F.col("part"))
    within = take(placed.where("own > 0").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("own") - 1))), here, 1, in_part(here))
    across = take(placed.withColumn("to", F.explode("visits")).withColumn("tile", F.explode(F.sequence(F.lit(0), many[F.col("to")] - 1))),
                  there, 1, in_part(there))
    found = materialize(_tiles(home.unionByName(within).unionByName(across), threshold), "vec-links")
    comp = components(found.where("b is not null").select("a", "b"))
    links = found.where("links is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("linked"))
    rooted = (classes.select("cls", "low", "n", "v").join(links, "cls", "left").join(comp, F.col("cls") == F.col("id"), "left")
              .select("cls", "low", "n", "v", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("component", "cls").alias("root")))
    rooted = materialize(rooted, "vec-rooted")
    heads = materialize(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "vec-heads")
    label = materialize(rooted.join(heads, "root").select(F.col("v").alias("lv"), (F.col("linked") + F.col("n") - 1).alias("n_links"),
                                                          "component_id"), "vec-labels")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    return (vectors.select(F.col("vec_id").cast("long"), v.alias("v")).join(label, F.col("v") == F.col("lv"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
