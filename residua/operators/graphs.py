"""Residue graphs: normalised nodes with their features, chain, contact and neighbour edges, and graph vectors.

A graph has at most a few hundred residues, so pairs are formed within graph_id alone and spread with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua import constants as C
from residua.functions.sequence import property_of


def normalised(residues: DataFrame) -> DataFrame:
    """Places around their centre, over the largest distance from it where that isn't nought."""
    g = Window.partitionBy("graph_id")
    for c in "xyz":
        residues = residues.withColumn(c, F.col(c) - F.avg(c).over(g))
    far = F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).over(g)
    residues = residues.withColumn("_far", far)
    for c in "xyz":
        residues = residues.withColumn(c, F.when(F.col("_far") > 1e-6, F.col(c) / F.col("_far")).otherwise(F.col(c)))
    return residues.drop("_far")


def ss_class(aa: Column) -> Column:
    """0 helix, 1 strand, 2 coil: the class that a residue favours, where no structure names one."""
    return F.when(aa.isin(*"AELMQKRH"), 0).when(aa.isin(*"VIYCWFT"), 1).otherwise(2)


def substitution_row(aa: Column) -> Column:
    table = F.create_map(*(x for a, row in C.SUBSTITUTION.items() for x in (F.lit(a), F.array(*map(F.lit, row)))))
    return F.coalesce(F.try_element_at(table, aa), F.array(*[F.lit(0)] * 20))


def nodes(residues: DataFrame) -> DataFrame:
    """graph_id, idx, aa and the 35 node features, f0 to f34."""
    aa, p = F.col("aa"), lambda name: property_of(F.col("aa"), name, None)
    rows = normalised(residues).withColumn("_s", substitution_row(aa)).withColumn("_c", ss_class(aa))
    values = [F.col("_s")[k].cast("double") for k in range(20)] + [F.col(c) for c in "xyz"]
    values += [p("hyd"), p("chg"), p("mw") / 200, p("vol") / 200, p("flex"), p("arom")]
    values += [(F.col("_c") == k).cast("double") for k in range(3)] + [F.lit(0.5), p("flex"), F.col("plddt") / 100]
    return rows.select("graph_id", "idx", "aa", *(v.alias(f"f{k}") for k, v in enumerate(values)))


def distance(a: str = "a", b: str = "b") -> Column:
    return F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))


def chain_edges(placed: DataFrame) -> DataFrame:
    """Edges between residues that follow each other."""
    w = Window.partitionBy("graph_id").orderBy("idx")
    rows = placed.withColumn("dst", F.lead("idx").over(w))
    for c in "xyz":
        rows = rows.withColumn(f"_{c}", F.lead(c).over(w))
    d = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    return rows.where("dst = idx + 1").select(
        "graph_id", F.col("idx").alias("src"), "dst", F.lit(1).alias("edge_type"), F.lit("peptide").alias("type_name"), d.alias("distance"),
        F.lit(1.0).alias("strength"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"),
    )


def contacts(residues: DataFrame, within: float = 8.0, gap: int = 2) -> DataFrame:
    """Pairs i + gap <= j of a graph within a distance."""
    a, b = (residues.select("graph_id", F.struct("idx", "x", "y", "z").alias(c)) for c in "ab")
    pairs = a.join(b, "graph_id").where(F.col("b.idx") >= F.col("a.idx") + gap).withColumn("d", distance())
    return pairs.where(F.col("d") <= within).select("graph_id", F.col("a.idx").alias("src"), F.col("b.idx").alias("dst"), F.col("d").alias("distance"))


def contact_type(a: Column, b: Column, d: Column, within: float = 8.0) -> Column:
    either = lambda s, t: (a.isin(*s) & b.isin(*t)) | (a.isin(*t) & b.isin(*s))
    return (
        F.when(either(C.POSITIVE, C.NEGATIVE) & (d < 6), 3).when(a.isin(*C.GREASY) & b.isin(*C.GREASY) & (d < 6), 4)
        .when(either(C.DONORS, C.ACCEPTORS) & (d < 5), 2).when(d <= within, 1).otherwise(0)
    )


def neighbour_edges(placed: DataFrame, k: int = 8, within: float = 8.0) -> DataFrame:
    """Typed edges between a residue and its k nearest that don't follow it in the chain.

    An edge that both ends list is held once, with the direction from the later one.
    """
    a, b = (placed.select("graph_id", F.struct("idx", "aa", "x", "y", "z").alias(c)) for c in "ab")
    pairs = a.join(b, "graph_id").where("a.idx <> b.idx").withColumn("d", distance())
    pairs = pairs.select("graph_id", F.col("a.idx").alias("i"), F.col("b.idx").alias("j"), F.col("a.aa").alias("p"), F.col("b.aa").alias("q"), "d", (F.col("b.x") - F.col("a.x")).alias("dx"), (F.col("b.y") - F.col("a.y")).alias("dy"))
    near = F.row_number().over(Window.partitionBy("graph_id", "i").orderBy(F.round("d", 5), "j"))
    n = F.count(F.lit(1)).over(Window.partitionBy("graph_id", "i")) + 1
    pairs = pairs.withColumn("near", near).withColumn("n", n).where(F.col("near") <= F.least(F.lit(k), F.greatest(F.lit(2), F.col("n") - 1)))
    pairs = pairs.withColumn("edge_type", contact_type(F.col("p"), F.col("q"), F.col("d"), within))
    pairs = pairs.where((F.col("d") <= within) & (F.abs(F.col("i") - F.col("j")) > 1) & (F.col("edge_type") > 0))
    unit = lambda c: F.when(F.col("d") > 0, F.col(c) / F.col("d")).otherwise(F.lit(0.0))
    last = F.max_by(F.struct("edge_type", "d", unit("dx").alias("dir_x"), unit("dy").alias("dir_y")), "i")
    once = pairs.groupBy("graph_id", F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst")).agg(last.alias("e"))
    name = F.create_map(*(F.lit(v) for t, (n_, _) in C.CONTACTS.items() for v in (t, n_)))
    strength = F.create_map(*(F.lit(v) for t, (_, s) in C.CONTACTS.items() for v in (t, s)))
    return once.select("graph_id", "src", "dst", "e.edge_type", F.element_at(name, F.col("e.edge_type")).alias("type_name"), F.col("e.d").alias("distance"), F.element_at(strength, F.col("e.edge_type")).alias("strength"), "e.dir_x", "e.dir_y")


def edges(residues: DataFrame) -> DataFrame:
    placed = normalised(residues)
    return chain_edges(placed).unionByName(neighbour_edges(placed))


def repaired(edges_: DataFrame, components: DataFrame) -> DataFrame:
    """edges_ and, where a graph has several components, an artificial edge between the first residues of the two largest.

    components: graph_id, idx, component.
    """
    sizes = components.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("idx"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("n"), "idx"))
    two = sizes.withColumn("r", rank).where("r <= 2").groupBy("graph_id").agg(F.min("idx").alias("src"), F.max("idx").alias("dst"), F.count(F.lit(1)).alias("c")).where("c = 2")
    new = two.select("graph_id", "src", "dst", F.lit(5).alias("edge_type"), F.lit("artificial").alias("type_name"), F.lit(5.0).alias("distance"), F.lit(0.2).alias("strength"), F.lit(0.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))
    return edges_.unionByName(new)


def path_graph(residues: DataFrame, n: int = 10) -> DataFrame:
    """The rescue of fragments of at most n residues: edges between neighbours by order, 3.8 long."""
    w = Window.partitionBy("graph_id").orderBy("idx")
    size = F.count(F.lit(1)).over(Window.partitionBy("graph_id"))
    rows = residues.withColumn("n", size).where(F.col("n") <= n).withColumn("dst", F.lead("idx").over(w))
    return rows.where("dst is not null").select("graph_id", F.col("idx").alias("src"), "dst", F.lit(1).alias("edge_type"), F.lit("peptide").alias("type_name"), F.lit(3.8).alias("distance"), F.lit(1.0).alias("strength"), F.lit(1.0).alias("dir_x"), F.lit(0.0).alias("dir_y"))


def edge_one_hot(edge_type: str = "edge_type", size: int = 4) -> list[Column]:
    """Compatible one-hot slots: types from `size` on have none."""
    return [(F.col(edge_type) == k).cast("double") for k in range(size)]


def graph_vectors(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """graph_id and v, 85 numbers: counts, means and population deviations of node slices, and statistics of the edges.

    Graphs without an edge have 73. The edge count is halved, as edges are held once and read as if held twice.
    """
    stats = []
    for lo, hi in ((0, 20), (20, 23), (23, 29), (29, 35)):
        stats += [F.avg(f"f{k}") for k in range(lo, hi)] + [F.stddev_pop(f"f{k}") for k in range(lo, hi)]
    clean = lambda c: F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    per_node = nodes_.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"), F.array(*map(clean, stats)).alias("nv"))
    own = [F.avg(c) for c in edge_one_hot()] + [F.avg("distance"), F.stddev_pop("distance"), F.min("distance"), F.max("distance"), F.avg("strength"), F.stddev_pop("strength"), F.avg("dir_x"), F.avg("dir_y")]
    per_edge = edges_.groupBy("graph_id").agg(F.count(F.lit(1)).alias("e"), F.array(*map(clean, own)).alias("ev"))
    both = per_node.join(per_edge, "graph_id", "left").withColumn("half", F.expr("coalesce(e, 0) div 2"))
    head = F.array(F.col("n").cast("double"), F.col("half").cast("double"), F.col("half") / F.greatest("n", F.lit(1)))
    return both.select("graph_id", F.concat(head, "nv", F.coalesce("ev", F.array().cast("array<double>"))).alias("v"))
