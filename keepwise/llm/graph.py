"""Connected components of a link table, and of the links inside one tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwise.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): component is the smallest id reachable; ids that are
    themselves the smallest of their component have no row.

    Alternating large-star and small-star steps: every vertex hangs its larger
    neighbours, then its smaller ones, onto its smallest neighbour, until the links
    form stars. Each step is an aggregation (a minimum per vertex, combined
    map-side) and an equi-join; both sides of the join are written tables, so a
    vertex with very many links is split by AQE. Only whether they are stars comes
    to the driver.
    """
    edges = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large, "large-star")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "star-min")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _are_stars(edges: DataFrame) -> bool:
    """Every larger end hangs on one smaller end, which hangs on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return roles.where("up > 1 OR (up = 1 AND down > 0)").isEmpty()


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links (a, b): their stars and the new links, if there are any."""
    links = materialize(links.select("a", "b"), "links")
    if links.isEmpty():
        return comp
    return components(comp.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))


def tile_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For n places and links i-j between them: the smallest place of each component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        label = new[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label
