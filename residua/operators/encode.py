"""Graphs as rows of arrays, sequences back from graphs, relaxed filters of short peptides, and a forward pass in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.vectors import doubles
from residua.operators.graphs import edge_one_hot


def sequence_of(nodes: DataFrame) -> DataFrame:
    """graph_id, sequence (residue codes in order) and n_nodes."""
    codes = F.transform(F.array_sort(F.collect_list(F.struct("idx", "aa"))), lambda s: s["aa"])
    return nodes.groupBy("graph_id").agg(F.array_join(codes, "").alias("sequence"), F.count(F.lit(1)).alias("n_nodes"))


def residue_by_substitution(nodes: DataFrame) -> DataFrame:
    """nodes with guess, the residue whose place in the substitution row is the largest."""
    row = F.array(*(F.col(f"f{k}") for k in range(20)))
    return nodes.withColumn("guess", F.substring(F.lit(C.SUBSTITUTION_ORDER), F.array_position(row, F.array_max(row)).cast("int"), F.lit(1)))


def encoded(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, x (n x 35), src, dst, edge_attr (e x 8), sequence, n_nodes and n_edges; graphs without nodes or edges go.

    A node's number is its place in the order of idx.
    """
    place = F.row_number().over(Window.partitionBy("graph_id").orderBy("idx")) - 1
    placed = nodes.withColumn("place", place)
    features = F.array(*(F.col(f"f{k}").cast("float") for k in range(35)))
    packed = placed.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("place", "aa", features.alias("f")))).alias("n"))
    at = lambda c: placed.select("graph_id", F.col("idx").alias(c), F.col("place").alias(f"p_{c}"))
    attributes = F.array(*(c.cast("float") for c in (*edge_one_hot(), F.col("distance"), F.col("strength"), F.col("dir_x"), F.col("dir_y"))))
    numbered = edges.join(at("src"), ["graph_id", "src"]).join(at("dst"), ["graph_id", "dst"])
    links = numbered.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("p_src", "p_dst", attributes.alias("f")))).alias("e"))
    of = lambda a, name: F.transform(a, lambda s: s[name])
    return packed.join(links, "graph_id").select(
        "graph_id", of("n", "f").alias("x"), of("e", "p_src").alias("src"), of("e", "p_dst").alias("dst"), of("e", "f").alias("edge_attr"),
        F.array_join(of("n", "aa"), "").alias("sequence"), F.size("n").alias("n_nodes"), F.size("e").alias("n_edges"),
    )


def relaxed(residues: DataFrame, confident: Column, placed: Column, short: int = 10) -> DataFrame:
    """The residues that a filter keeps: known, placed and confident ones. Where a fragment of at most `short` residues has
    fewer than two of them, it keeps the confident known ones, and where these are too few too, all confident ones."""
    g = Window.partitionBy("graph_id")
    known = F.col("aa") != "X"
    rows = residues.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_a", confident & known & placed).withColumn("_b", confident & known).withColumn("_c", confident)
    many = lambda c: F.count_if(c).over(g)
    rows = rows.withColumn("stage", F.when((F.col("_n") > short) | (many("_a") >= 2), 1).when(many("_b") >= 2, 2).otherwise(3))
    keep = F.when(F.col("stage") == 1, F.col("_a")).when(F.col("stage") == 2, F.col("_b")).otherwise(F.col("_c"))
    return rows.where(keep).drop("_n", "_a", "_b", "_c")


def looked_up(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """wanted (id, seq) with origin: the cache has the id, or else the sequence's hash, or else it must be computed."""
    by_hash = cache.select(F.md5("seq").alias("_h")).distinct().withColumn("_by_hash", F.lit(True))
    by_id = cache.select("id").distinct().withColumn("_by_id", F.lit(True))
    rows = wanted.withColumn("_h", F.md5("seq")).join(by_id, "id", "left").join(by_hash, "_h", "left")
    return rows.withColumn("origin", F.when(F.col("_by_id"), "id").when(F.col("_by_hash"), "hash").otherwise("compute")).drop("_h", "_by_id", "_by_hash")


def structure_loss(views: DataFrame, a: str, b: str) -> DataFrame:
    """batch and the mean squared difference of the two views' distances, each over its batch's largest."""
    from residua.functions.vectors import l2

    rows = views.select("batch", F.struct("id", a, b).alias("l"))
    pairs = rows.join(rows.select("batch", F.col("l").alias("r")), "batch").select("batch", l2(F.col(f"l.{a}"), F.col(f"r.{a}")).alias("da"), l2(F.col(f"l.{b}"), F.col(f"r.{b}")).alias("db"))
    top = Window.partitionBy("batch")
    scaled = pairs.withColumn("da", F.col("da") / (F.max("da").over(top) + 1e-8)).withColumn("db", F.col("db") / (F.max("db").over(top) + 1e-8))
    return scaled.groupBy("batch").agg(F.avg((F.col("da") - F.col("db")) ** 2).alias("structure_loss"))


def principal(vectors: DataFrame, id_: str, vector: str, k: int = 2) -> DataFrame:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(id_, array_to_vector(doubles(F.col(vector))).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(rows)
    return model.transform(rows).select(id_, vector_to_array("p").alias("components"))


class Encoder:
    """A forward pass over one graph: binned properties, a linear layer, typed gated messages, attention pooling and a latent
    vector of length one. Weights are drawn from a seed unless given."""

    def __init__(self, hidden: int = 16, latent: int = 8, layers: int = 2, types: int = 4, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.enter, self.edge, self.score, self.leave = draw(35, hidden), draw(8, hidden), draw(hidden), draw(hidden, latent)
        self.values, self.gates = [draw(types, hidden, hidden) for _ in range(layers)], [draw(types) for _ in range(layers)]

    def __call__(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray, edge: np.ndarray) -> np.ndarray:
        h = np.tanh(x @ self.enter)
        kind = edge[:, :4].argmax(axis=1)
        s, d, e, k = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([edge, edge]), np.concatenate([kind, kind])
        for value, gate in zip(self.values, self.gates):
            sent = np.einsum("eh,ehk->ek", h[s], value[k]) + e @ self.edge
            into = np.zeros_like(h)
            np.add.at(into, d, sent / (1 + np.exp(-gate[k]))[:, None])
            h = h + np.tanh(into)
        w = h @ self.score
        w = np.exp(w - w.max())
        z = (w / w.sum()) @ h @ self.leave
        n = np.linalg.norm(z)
        return z / n if n > 0 else z


def graph_latents(graphs: DataFrame, **options: int) -> DataFrame:
    """graph_id and latent of encoded graphs; the encoder is made once in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(**options)
        for batch in batches:
            made = [encoder(np.stack(x), np.asarray(s), np.asarray(d), np.stack(e)).tolist() for x, s, d, e in zip(batch["x"], batch["src"], batch["dst"], batch["edge_attr"])]
            yield pd.DataFrame({"graph_id": batch["graph_id"], "latent": made})

    return graphs.select("graph_id", "x", "src", "dst", "edge_attr").mapInPandas(run, "graph_id long, latent array<double>")
