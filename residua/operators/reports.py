"""Reports on encoded graphs: node slices, edges, topology, schema checks; and the plan and the index of an embedding run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators import graphs

# The slices of a node's 35 features, and the features whose correlations are reported.
NODE_SLICES = (("blosum62", 0, 20), ("spatial", 20, 23), ("physicochemical", 23, 29), ("secondary_structure", 29, 32), ("other", 32, 35))
CORRELATED = (0, 20, 23, 29, 32)


def _fine(c: Column, digits: int = 4) -> Column:
    return F.round(c + 1e-9, digits) + 0.0


def node_slices(nodes: DataFrame) -> DataFrame:
    """graph_id, slice, and mean, std, least and most over all values of the slice."""
    long = nodes.select("graph_id", F.explode(F.array(*(F.struct(F.lit(s).alias("slice"), F.array(*(F.col(f"f{k}") for k in range(lo, hi))).alias("v")) for s, lo, hi in NODE_SLICES))).alias("s"))
    long = long.select("graph_id", "s.slice", F.explode("s.v").alias("v"))
    return long.groupBy("graph_id", "slice").agg(_fine(F.avg("v")).alias("mean"), _fine(F.stddev_pop("v")).alias("std"), _fine(F.min("v")).alias("least"), _fine(F.max("v")).alias("most"))


def node_correlations(nodes: DataFrame) -> DataFrame:
    """graph_id, a, b and the correlation of two features; null where one of them doesn't vary."""
    pairs = [(a, b) for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1 :]]
    sd = lambda k: F.stddev_pop(f"f{k}")
    both = lambda a, b: F.when((sd(a) > 1e-9) & (sd(b) > 1e-9), _fine(F.try_divide(F.covar_pop(f"f{a}", f"f{b}"), sd(a) * sd(b))))
    wide = nodes.groupBy("graph_id").agg(*(both(a, b).alias(f"c{a}_{b}") for a, b in pairs))
    return wide.select("graph_id", F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{a}_{b}").alias("r")) for a, b in pairs))).alias("p")).select("graph_id", "p.*")


def edge_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Density, share of each type, and moments of distance, strength and the direction's length."""
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.col("dir_x") ** 2 + F.col("dir_y") ** 2)
    shares = [_fine(F.avg(c) * 100).alias(f"share{k}") for k, c in enumerate(graphs.edge_one_hot())]
    per = edges.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_edges"), *shares, _fine(F.avg("distance")).alias("distance_mean"), _fine(F.stddev_pop("distance")).alias("distance_std"),
        _fine(F.min("distance")).alias("distance_least"), _fine(F.max("distance")).alias("distance_most"), _fine(F.avg("strength")).alias("strength_mean"),
        _fine(F.stddev_pop("strength")).alias("strength_std"), _fine(F.avg(norm)).alias("direction_mean"), _fine(F.stddev_pop(norm), 3).alias("direction_std"),
    )
    density = F.try_divide(F.col("n_edges"), F.col("n") * (F.col("n") - 1) / 2)
    return n.join(per, "graph_id").withColumn("density", F.round(density, 6)).drop("n")


def structure_shares(nodes: DataFrame) -> DataFrame:
    """graph_id, residues by structure class and helices over strands (one at least)."""
    many = lambda k: F.count_if(F.col(f"f{29 + k}") == 1)
    per = nodes.groupBy("graph_id").agg(many(0).alias("helix"), many(1).alias("strand"), many(2).alias("coil"))
    return per.withColumn("helix_strand", F.round(F.col("helix") / F.greatest("strand", F.lit(1)), 4))


def schema_report(nodes: DataFrame, edges: DataFrame, ss: list[str], types: list[str]) -> DataFrame:
    """For each graph its nodes with a wrong structure code, its edges with a wrong type code or an end that isn't a node, and
    the edges whose ends are both among the nodes 0..n-1."""
    one = lambda cs: F.round(sum((F.col(c) for c in cs), F.lit(0.0))) == 1
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(~one(ss)).alias("bad_structure"))
    rows = edges.join(n.select("graph_id", "n_nodes"), "graph_id")
    inside = F.col("src").between(0, F.col("n_nodes") - 1) & F.col("dst").between(0, F.col("n_nodes") - 1)
    per = rows.groupBy("graph_id").agg(F.count_if(~one(types)).alias("bad_type"), F.count_if(~inside).alias("bad_ends"), F.count_if(inside).alias("valid_edges"))
    return n.join(per, "graph_id", "left").na.fill(0)


# ---- an embedding run ----


def identified(rows: DataFrame, sequence: str, fields: list[str], dataset: str, index: str) -> DataFrame:
    """rows with seq_id, the first field that holds something, or else one made of the dataset, the index and the sequence's
    hash. Empty sequences go; of equal (sequence, seq_id) the first by index stays."""
    made = F.concat_ws("_", F.col(dataset), F.col(index).cast("string"), F.substring(F.md5(sequence), 1, 8))
    named = rows.where(F.coalesce(F.length(sequence), F.lit(0)) > 0).withColumn("seq_id", F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in fields), made))
    first = named.groupBy(sequence, "seq_id").agg(F.min_by(F.struct(*[c for c in named.columns if c not in (sequence, "seq_id")]), index).alias("_r"))
    return first.select(sequence, "seq_id", "_r.*")


def run_plan(sequences: DataFrame, key: str, dataset: str, index: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """For each dataset its sequences, those that the index or the checkpoint names, and those that are to be computed."""
    done = index.select(key).unionByName(checkpoint.select(key)).distinct().withColumn("_done", F.lit(True))
    rows = sequences.join(done, key, "left")
    return rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_done")).alias("cached"), F.count_if(F.col("_done").isNull()).alias("to_compute"))


def chunk_index(rows: DataFrame, key: str, dataset: str, order: str, per_chunk: int) -> DataFrame:
    """key, dataset, original_index and chunk: the rows of a dataset in order, so many to a chunk."""
    place = F.row_number().over(Window.partitionBy(dataset).orderBy(order, key)) - 1
    return rows.withColumn("original_index", place).withColumn("chunk", F.expr(f"original_index div {per_chunk}")).select(key, dataset, "original_index", "chunk")


def newest(rows: DataFrame, keys: list[str], changed: str, file: str) -> DataFrame:
    """Of the rows of a key the one from the file that changed last; of files as new as each other the first by name."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(changed)).alias("c"), F.col(file).alias("f")))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")
