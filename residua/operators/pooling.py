"""Pooling, message passing and contrastive losses as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.vectors import dot, sigmoid


def pooled(long: DataFrame, group: str) -> DataFrame:
    """Mean, maximum and sum of each dimension of each group."""
    return long.groupBy(group, "dim").agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.sum("value").alias("total"))


def ends_and_mean(long: DataFrame, group: str, order: str) -> DataFrame:
    """(first + last + mean) / 3 of each dimension."""
    return long.groupBy(group, "dim").agg(((F.min_by("value", order) + F.max_by("value", order) + F.avg("value")) / 3).alias("pooled"))


def softmax_pooled(long: DataFrame, group: str, weight: str) -> DataFrame:
    """Sum of values by the softmax of the weights within the group."""
    # exp(w - max) / sum, with both sums in one aggregation behind the group's maximum
    top = F.max(weight).over(Window.partitionBy(group, "dim"))
    rows = long.withColumn("_e", F.exp(F.col(weight) - top))
    return rows.groupBy(group, "dim").agg((F.sum(F.col("_e") * F.col("value")) / F.sum("_e")).alias("pooled"))


def messages(edges: DataFrame, nodes: DataFrame, value: str, gate: Column) -> DataFrame:
    """graph_id, idx, degree and the sum of the gated values of each node's neighbours; edges go both ways."""
    pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("idx"))
    both = edges.select("graph_id", gate.alias("g"), F.explode(F.array(pair("src", "dst"), pair("dst", "src"))).alias("e")).select("graph_id", "g", "e.src", "e.idx")
    source = nodes.select("graph_id", F.col("idx").alias("src"), F.col(value).alias("v"))
    sent = both.join(source, ["graph_id", "src"]).groupBy("graph_id", "idx").agg(F.sum(sigmoid(F.col("g")) * F.col("v")).alias("message"), F.count(F.lit(1)).alias("degree"))
    return nodes.select("graph_id", "idx").join(sent, ["graph_id", "idx"], "left").na.fill({"message": 0.0, "degree": 0})


def info_nce(rows: DataFrame, temperature: float = 0.1) -> DataFrame:
    """batch, n and the mean cross entropy both ways. rows: batch, id, g and s, the two views; a batch is of bounded size."""
    a = rows.select("batch", F.col("id").alias("i"), F.col("g"))
    b = rows.select("batch", F.col("id").alias("j"), F.col("s"))
    pairs = a.join(b, "batch").withColumn("sim", dot(F.col("g"), F.col("s")) / temperature)
    own = F.max(F.when(F.col("i") == F.col("j"), F.col("sim")))
    lse = F.max("sim") + F.log(F.sum(F.exp(F.col("sim") - F.col("top"))))

    def way(key: str) -> DataFrame:
        top = F.max("sim").over(Window.partitionBy("batch", key))
        return pairs.withColumn("top", top).groupBy("batch", key).agg((lse - own).alias("loss")).groupBy("batch").agg(F.avg("loss").alias(f"loss_{key}"), F.count(F.lit(1)).alias(f"n_{key}"))

    return way("i").join(way("j"), "batch").select("batch", F.col("n_i").alias("n"), ((F.col("loss_i") + F.col("loss_j")) / 2).alias("loss"))


def _both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    way = lambda a, b, sign: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(sign).alias("sign"))
    return edges.select("graph_id", *columns, F.explode(F.array(way("src", "dst", 1), way("dst", "src", -1))).alias("e")).select("graph_id", *columns, "e.*")


def with_self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, src and dst of the edges, and (i, i) for the nodes of graphs without any."""
    bare = nodes.select("graph_id", "idx").join(edges.select("graph_id").distinct(), "graph_id", "left_anti")
    return edges.select("graph_id", "src", "dst").unionByName(bare.select("graph_id", F.col("idx").alias("src"), F.col("idx").alias("dst")))


def edge_softmax(edges: DataFrame, score: Column) -> DataFrame:
    """graph_id, src, dst and weight: the softmax of the score over the edges that come into dst. Edges go both ways."""
    rows = _both_ways(edges.withColumn("_s", score), "_s")
    into = Window.partitionBy("graph_id", "dst")
    e = F.exp(F.col("_s") - F.max("_s").over(into))
    return rows.withColumn("_e", e).select("graph_id", "src", "dst", (F.col("_e") / F.sum("_e").over(into)).alias("weight"))


def mean_directions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, idx, degree and the mean unit vector along the edges that come into a node, noughts without any."""
    at = lambda c, p: nodes.select("graph_id", F.col("idx").alias(c), F.struct("x", "y", "z").alias(p))
    rows = _both_ways(edges).join(at("src", "a"), ["graph_id", "src"]).join(at("dst", "b"), ["graph_id", "dst"])
    step = {c: F.col(f"b.{c}") - F.col(f"a.{c}") for c in "xyz"}
    far = F.sqrt(sum((v**2 for v in step.values()), F.lit(0.0))) + 1e-6
    per = rows.groupBy("graph_id", F.col("dst").alias("idx")).agg(F.count(F.lit(1)).alias("degree"), *(F.avg(v / far).alias(f"u{c}") for c, v in step.items()))
    return nodes.select("graph_id", "idx").join(per, ["graph_id", "idx"], "left").na.fill(0)


def norm_attention(long: DataFrame, group: str, item: str) -> DataFrame:
    """group, item and weight: the softmax over a group of the lengths of its items' vectors. long: group, item, value."""
    norms = long.groupBy(group, item).agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("_n"))
    top = norms.groupBy(group).agg(F.max("_n").alias("_top"))
    e = norms.join(top, group).withColumn("_e", F.exp(F.col("_n") - F.col("_top")))
    return e.join(e.groupBy(group).agg(F.sum("_e").alias("_sum")), group).select(group, item, (F.col("_e") / F.col("_sum")).alias("weight"))
