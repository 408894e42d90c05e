"""Topology of small graphs: degrees and triangles as joins, components and shortest paths within each graph.

A graph has at most a few hundred nodes, so a grouped pandas function may hold one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    return edges.select("graph_id", F.explode(F.array(pair("src", "dst"), pair("dst", "src"))).alias("e")).select("graph_id", "e.a", "e.b").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    own = both_ways(edges).groupBy("graph_id", F.col("a").alias("idx")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("graph_id", "idx").join(own, ["graph_id", "idx"], "left").na.fill({"degree": 0})


def degree_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    per = degrees(nodes, edges).groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.round(F.avg("degree"), 6).alias("deg_mean"),
        F.round(F.stddev_pop("degree"), 6).alias("deg_std"), F.min("degree").alias("deg_min"), F.max("degree").alias("deg_max"),
    )
    return per.withColumn("density", F.round(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1) / 2), 6))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean clustering coefficient of each graph; nodes with fewer than two neighbours count as 0."""
    e = both_ways(edges)
    ab = e.select("graph_id", "a", F.col("b").alias("x"))
    ac = e.select("graph_id", "a", F.col("b").alias("y"))
    closed = ab.join(ac, ["graph_id", "a"]).where("x < y").join(e.select("graph_id", F.col("a").alias("x"), F.col("b").alias("y")), ["graph_id", "x", "y"])
    triangles = closed.groupBy("graph_id", F.col("a").alias("idx")).agg(F.count(F.lit(1)).alias("t"))
    per = degrees(nodes, edges).join(triangles, ["graph_id", "idx"], "left").na.fill({"t": 0})
    own = F.when(F.col("degree") > 1, 2.0 * F.col("t") / (F.col("degree") * (F.col("degree") - 1))).otherwise(F.lit(0.0))
    return per.groupBy("graph_id").agg(F.round(F.avg(own), 6).alias("clustering"))


def _paths(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Steps between all nodes, -1 where there is no path."""
    link = np.zeros((n, n), bool)
    link[src, dst] = link[dst, src] = True
    out = np.where(np.eye(n, dtype=bool), 0, -1)
    reach, step = np.eye(n, dtype=bool), 0
    while True:
        step += 1
        new = (reach.astype(np.int32) @ link) > 0
        new &= out < 0
        if not new.any():
            return out
        out[new] = step
        reach = new


def _links(edges: DataFrame) -> DataFrame:
    """Edges with columns of their own, so that they can stand beside nodes of the same lineage."""
    return edges.select(F.struct("graph_id", "src", "dst").alias("e")).select(F.col("e.graph_id").alias("graph_id"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, idx and component, its least idx."""

    def run(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        idx = np.sort(own["idx"].to_numpy())
        d = _paths(len(idx), np.searchsorted(idx, links["src"]), np.searchsorted(idx, links["dst"]))
        least = idx[np.argmax(d >= 0, axis=1)] if len(idx) else idx
        return pd.DataFrame({"graph_id": key[0], "idx": idx, "component": least})

    return nodes.select("graph_id", "idx").groupBy("graph_id").cogroup(_links(edges).groupBy("graph_id")).applyInPandas(run, "graph_id long, idx int, component int")


def path_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """components, and for connected graphs diameter and mean shortest path; the sizes of the components, falling."""

    def run(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        idx = np.sort(own["idx"].to_numpy())
        n = len(idx)
        d = _paths(n, np.searchsorted(idx, links["src"]), np.searchsorted(idx, links["dst"]))
        sizes = sorted(np.unique(np.argmax(d >= 0, axis=1), return_counts=True)[1].tolist(), reverse=True) if n else []
        whole = len(sizes) == 1
        return pd.DataFrame({
            "graph_id": [key[0]], "n_components": [len(sizes)], "sizes": [",".join(map(str, sizes))],
            "diameter": pd.array([int(d.max()) if whole else None], "Int64"), "mean_path": pd.array([round(float(d.sum()) / (n * (n - 1)), 6) if whole and n > 1 else None], "Float64"),
        })

    return nodes.select("graph_id", "idx").groupBy("graph_id").cogroup(_links(edges).groupBy("graph_id")).applyInPandas(run, "graph_id long, n_components long, sizes string, diameter long, mean_path double")


def graph_level(edges: DataFrame) -> DataFrame:
    """Components, mean clustering, the largest eccentricity within a component, and the degrees' mean, deviation and maximum.

    A graph consists of the ends of its edges; one without edges gives no row.
    """

    def run(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        idx, ends = np.unique(links[["src", "dst"]].to_numpy(), return_inverse=True)
        src, dst = ends.reshape(-1, 2).T
        n = len(idx)
        link = np.zeros((n, n), np.int64)
        link[src, dst] = link[dst, src] = 1
        np.fill_diagonal(link, 0)
        d, degree = _paths(n, src, dst), link.sum(axis=1)
        closed = np.einsum("ij,jk,ki->i", link, link, link, optimize=True)
        possible = degree * (degree - 1)
        own = np.where(possible > 0, closed / np.maximum(possible, 1), 0.0)
        return pd.DataFrame({
            "graph_id": [key[0]], "n_components": [len(np.unique(np.argmax(d >= 0, axis=1)))], "clustering": [round(float(own.mean()), 6)], "diameter": [int(d.max())],
            "deg_mean": [round(float(degree.mean()), 6)], "deg_std": [round(float(degree.std()), 6)], "deg_max": [int(degree.max())],
        })

    return edges.select("graph_id", "src", "dst").groupBy("graph_id").applyInPandas(run, "graph_id long, n_components long, clustering double, diameter long, deg_mean double, deg_std double, deg_max long")
