"""From the residues of chains to fragments and their graphs, with the rules by which chains and fragments are skipped."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.operators import encode, fragmenter, graphs
from residua.session import checkpointed


class Extracted(NamedTuple):
    fragments: DataFrame  #: chain_id, frag_id, graph_id, start, end, sequence, length
    residues: DataFrame  #: graph_id, idx, aa, x, y, z, plddt of the nodes
    edges: DataFrame
    report: DataFrame  #: a row for each chain


def extracted(residues: DataFrame, longest: int = 50, least: int = 5, k: int = 8, within: float = 8.0, plddt: float = 70.0, by_structure: bool = True, by_domain: bool = True, structure: Column | None = None) -> Extracted:
    """residues: chain_id, idx, aa, x, y, z, plddt.

    A chain without contacts goes where domains count, one with fewer than `least` known residues always. A fragment fails
    with fewer than `least` known residues, or fewer than two behind the filter of its confident ones; for fragments of at
    most ten residues the threshold is 20 lower, 50 at least, and the filter is relaxed step by step.
    """
    checkpointed(residues.sparkSession)
    residues = residues.checkpoint()
    contacts = fragmenter.cell_contacts(residues, within).checkpoint()
    chains = fragmenter.chains_of(residues)
    n_contacts = contacts.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_contacts"))
    held = chains.join(n_contacts, "chain_id", "left").na.fill({"n_contacts": 0})
    eligible = held.where((F.col("known") >= least) & ((F.col("n_contacts") > 0) if by_domain else F.lit(True))).select("chain_id")
    own = residues.join(eligible, "chain_id", "left_semi")
    cut = fragmenter.cut_by_boundaries(own, contacts.join(eligible, "chain_id", "left_semi"), longest, least, by_structure, by_domain, structure)
    cut = cut.withColumn("graph_id", F.concat_ws("_", F.col("chain_id").cast("string"), "frag_id")).checkpoint()

    members = cut.select("chain_id", "graph_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("idx")).join(own, ["chain_id", "idx"])
    known = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", "aa"))), lambda s: s["aa"]), lambda a: a != "X")
    sequences = members.groupBy("graph_id").agg(F.array_join(known, "").alias("sequence"))
    named = cut.join(sequences, "graph_id", "left").withColumn("length", F.length(F.coalesce("sequence", F.lit(""))))

    long_enough = named.where(F.col("length") >= least).select("graph_id")
    size = F.count(F.lit(1)).over(Window.partitionBy("graph_id"))
    bound = F.when(size <= 10, F.greatest(F.lit(50.0), F.lit(plddt - 20))).otherwise(F.lit(plddt))
    confident = members.join(long_enough, "graph_id", "left_semi").withColumn("_ok", F.col("plddt") >= bound)
    kept = encode.relaxed(confident, F.col("_ok"), F.col("x").isNotNull()).drop("_ok", "stage")
    kept = kept.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("graph_id"))).where("_n >= 2").select("chain_id", "graph_id", "idx", "aa", "x", "y", "z", "plddt").checkpoint()
    placed = graphs.normalised(kept.select("graph_id", "idx", "aa", "x", "y", "z", "plddt"))
    edges = graphs.chain_edges(placed).unionByName(graphs.neighbour_edges(placed, k, within))

    nodes = kept.groupBy("chain_id").agg(F.countDistinct("graph_id").alias("successful"), F.count(F.lit(1)).alias("n_nodes"))
    links = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("e")).join(cut.select("graph_id", "chain_id"), "graph_id").groupBy("chain_id").agg(F.sum("e").alias("n_edges"))
    tried = cut.groupBy("chain_id").agg(F.count(F.lit(1)).alias("fragments"))
    report = held
    for part in (tried, nodes, links):
        report = report.join(part, "chain_id", "left")
    counted = ["fragments", "successful", "n_nodes", "n_edges"]
    report = report.na.fill(0, counted).withColumn("failed", F.col("fragments") - F.col("successful")).withColumnRenamed("n", "n_residues")
    fragments = named.select("chain_id", "frag_id", "graph_id", "start", "end", "sequence", "length")
    return Extracted(fragments, kept.drop("chain_id"), edges, report)


def older_graph_edges(members: DataFrame, k: int = 8, within: float = 8.0, plddt: float = 70.0) -> DataFrame:
    """graph_id, src, dst, type_name and distance by the older rules, in the coordinates as they are.

    members: graph_id, idx, aa, x, y, z, plddt. Known, placed and confident residues are nodes; neighbours by number are joined
    by a peptide edge of length 1, and each node with those of its k nearest that are within reach and not joined yet.
    """
    nodes = members.where((F.col("aa") != "X") & F.col("x").isNotNull() & (F.col("plddt") >= plddt))
    after = F.lead("idx").over(Window.partitionBy("graph_id").orderBy("idx"))
    peptide = nodes.select("graph_id", F.col("idx").alias("src"), after.alias("dst")).where("dst = src + 1").withColumn("type_name", F.lit("peptide")).withColumn("distance", F.lit(1.0))
    a, b = (nodes.select("graph_id", F.struct("idx", "x", "y", "z").alias(c)) for c in "ab")
    pairs = a.join(b, "graph_id").where("a.idx <> b.idx").select("graph_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), graphs.distance().alias("d"))
    near = F.row_number().over(Window.partitionBy("graph_id", "i").orderBy(F.round("d", 5), "j"))
    spatial = pairs.withColumn("r", near).where((F.col("r") <= k) & (F.col("d") <= within) & (F.abs(F.col("i") - F.col("j")) > 1))
    spatial = spatial.groupBy("graph_id", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(F.min("d").alias("distance"))
    return peptide.unionByName(spatial.withColumn("type_name", F.lit("spatial")))
