"""Curation: schema checks, one-hot repair, capped and stratified samples, splits, shards and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.ranking import hash_rank
from residua.session import checkpointed


def violations(edges: DataFrame, onehot: list[str]) -> DataFrame:
    """For each graph its edges, and those with a wrong one-hot code, a negative distance or a strength outside 0..1."""
    code = sum((F.col(c) for c in onehot), F.lit(0.0))
    return edges.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count_if(F.abs(code - 1) > 1e-6).alias("bad_onehot"), F.count_if(F.col("distance") < 0).alias("bad_distance"),
        F.count_if(~F.col("strength").between(0, 1)).alias("bad_strength"),
    )


def file_verdict(checked: DataFrame, file: str, valid: Column, first: int = 5) -> DataFrame:
    """Whether the first few samples of each file are valid."""
    n = F.row_number().over(Window.partitionBy(file).orderBy("graph_id"))
    return checked.withColumn("_n", n).where(F.col("_n") <= first).groupBy(file).agg(F.bool_and(valid).alias("is_valid"))


def capped(rows: DataFrame, stratum: str, order: list[Column], cap: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= cap).drop("_n")


def split(rows: DataFrame, hashed: Column, tie: Column, ratios: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """rows with split: floor(n * ratio) to train and val in the order of the hash, the rest to test."""
    total = sum(ratios)
    train, val = (round(r / total, 9) if abs(total - 1) > 0.001 else r for r in ratios[:2])
    n = rows.count()
    a = int(train * n)
    b = a + int(val * n)
    ranked = hash_rank(rows, hashed, tie, name="_rank")
    return ranked.withColumn("split", F.when(F.col("_rank") <= a, "train").when(F.col("_rank") <= b, "val").otherwise("test")).drop("_rank")


def stratified(rows: DataFrame, stratum: str, hashed: Column, tie: Column, size: int) -> DataFrame:
    """Exactly min(size, n) rows: of each stratum max(1, floor(size * share)) in the order of the hash, then topped up, or
    trimmed, in that order."""
    n = rows.count()
    size = min(size, n)
    own = rows.groupBy(stratum).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * size / n)).alias("_quota"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(hashed, tie))
    marked = rows.join(F.broadcast(own), stratum).withColumn("_first", (rank <= F.col("_quota")).cast("int"))
    picked = hash_rank(marked, F.concat((1 - F.col("_first")).cast("string"), hashed), tie, name="_rank")
    return picked.where(F.col("_rank") <= size).drop("_rank", "_first", "_quota")


def report(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))


def subset(rows: DataFrame, hashed: Column, tie: Column, ratio: float | None = None, most: int | None = None, least: int = 10) -> DataFrame:
    """A seeded subset in the order of the hash: floor(n * ratio) rows but `least` at least, or `most`."""
    n = rows.count()
    size = max(int(n * ratio), least) if ratio is not None else n if most is None else most
    return hash_rank(rows, hashed, tie, name="_rank").where(F.col("_rank") <= min(size, n)).drop("_rank")


def curated(graphs: DataFrame, size: str, hashed: Column, tie: Column, cap: int = 10_000, lengths: tuple[int, int] = (5, 50), ratios: tuple[float, float, float] = (0.7, 0.2, 0.1)) -> DataFrame:
    """graphs of a size within the lengths, at most `cap` of each size, with their split. The split reads its rows several times,
    so they are computed once."""
    checkpointed(graphs.sparkSession)
    return split(capped(graphs.where(F.col(size).between(*lengths)), size, [hashed, tie], cap).checkpoint(), hashed, tie, ratios)


def split_report(rows: DataFrame, nodes: str, edges: str) -> DataFrame:
    """For each split its graphs, and mean, deviation and range of their nodes and edges."""
    fine = lambda c: F.round(c + 1e-9, 4)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), fine(F.avg(nodes)).alias("nodes_mean"), fine(F.stddev_pop(nodes)).alias("nodes_std"), fine(F.avg(edges)).alias("edges_mean"),
        fine(F.stddev_pop(edges)).alias("edges_std"), F.min(nodes).alias("nodes_least"), F.max(nodes).alias("nodes_most"),
    )
