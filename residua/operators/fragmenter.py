"""Fragmenters of whole chains: cuts at domain, structure and flexibility boundaries, and an older one by structure runs.

Rows are residues: chain_id, idx (the place in the chain, from 0), aa, x, y, z (null without a place) and plddt.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residua.functions.sequence import property_of
from residua.operators import boundaries as B
from residua.operators.graphs import distance, ss_class


def cell_contacts(residues: DataFrame, within: float = 8.0, gap: int = 2) -> DataFrame:
    """chain_id, i and j of residues at most `within` apart and at least gap apart in the chain, i < j.

    They meet in cells as wide as the distance, so the work grows with a chain's length and not with its square. Of two
    neighbouring cells one looks into the other.
    """
    cells = [F.floor(F.col(c) / within).alias(f"c{c}") for c in "xyz"]
    rows = residues.where("x is not null and y is not null and z is not null").select("chain_id", F.struct("idx", "x", "y", "z").alias("p"), *cells)
    ahead = [s for s in product((-1, 0, 1), repeat=3) if s >= (0, 0, 0)]
    steps = F.array(*(F.struct(*((F.col(f"c{c}") + k).alias(f"c{c}") for c, k in zip("xyz", s)), F.lit(not any(s)).alias("own")) for s in ahead))
    looking = rows.select("chain_id", F.col("p").alias("a"), F.explode(steps).alias("s")).select("chain_id", "a", "s.*")
    pairs = looking.join(rows.withColumnRenamed("p", "b"), ["chain_id", "cx", "cy", "cz"])
    pairs = pairs.where((~F.col("own") | (F.col("a.idx") < F.col("b.idx"))) & (F.abs(F.col("a.idx") - F.col("b.idx")) >= gap) & (distance() <= within))
    return pairs.select("chain_id", F.least("a.idx", "b.idx").alias("i"), F.greatest("a.idx", "b.idx").alias("j"))


def contact_density(residues: DataFrame, contacts: DataFrame) -> DataFrame:
    """chain_id, idx and density, the number of a residue's contacts."""
    own = contacts.select("chain_id", F.explode(F.array("i", "j")).alias("idx")).groupBy("chain_id", "idx").agg(F.count(F.lit(1)).alias("density"))
    return residues.select("chain_id", "idx").join(own, ["chain_id", "idx"], "left").na.fill({"density": 0})


def domain_boundaries(density: DataFrame, least: int = 5) -> DataFrame:
    """chain_id and pos where the density of contacts changes most, each at least `least` behind the last one kept."""
    steep = B.gradient_boundaries(B.smoothed(density, ["chain_id"], ["idx"], "density", None), ["chain_id"]).where("boundary = 1")
    marked = steep.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.col("idx").cast("int"))).alias("p"))
    return marked.select("chain_id", F.explode(B.min_gap(F.col("p"), least)).alias("pos"))


def flexibility_boundaries(residues: DataFrame, value: str = "plddt") -> DataFrame:
    """chain_id and pos where the smoothed value changes most."""
    steep = B.smoothed(residues.select("chain_id", "idx", value), ["chain_id"], ["idx"], value, None)
    return B.gradient_boundaries(steep, ["chain_id"], 0.3, 0.5).where("boundary = 1").select("chain_id", F.col("idx").alias("pos"))


def structure_changes(residues: DataFrame, structure: Column | None = None) -> DataFrame:
    """chain_id and pos where the class of secondary structure changes; by residue where no structure is given."""
    classed = residues.select("chain_id", "idx", (ss_class(F.col("aa")) if structure is None else structure).alias("c"))
    return B.changes(classed, ["chain_id"], ["idx"], "c").where("changed = 1").select("chain_id", "pos")


def chains_of(residues: DataFrame) -> DataFrame:
    """chain_id, n and known, its residues that are not X."""
    return residues.groupBy("chain_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col("aa") != "X").alias("known"))


def cut_by_boundaries(residues: DataFrame, contacts: DataFrame, longest: int = 50, least: int = 5, by_structure: bool = True, by_domain: bool = True, structure: Column | None = None) -> DataFrame:
    """chain_id, start, end and frag_id: the gaps between all boundaries of a chain that are neither too short nor too long."""
    marks = flexibility_boundaries(residues)
    if by_domain:
        marks = marks.unionByName(domain_boundaries(contact_density(residues, contacts), least))
    if by_structure:
        marks = marks.unionByName(structure_changes(residues, structure))
    return B.fragments(chains_of(residues).select("chain_id", "n"), marks, longest, least)


def structure_runs(chains: DataFrame, changes: DataFrame, longest: int = 50, least: int = 10) -> DataFrame:
    """chain_id, start and end of one run of a structure class, or two that follow each other, of least to longest residues."""
    ends = chains.select("chain_id", F.explode(F.array(F.lit(0), F.col("n"))).alias("pos"))
    w = Window.partitionBy("chain_id").orderBy("pos")
    marks = ends.unionByName(changes.select("chain_id", F.col("pos").cast("int").alias("pos")).join(chains.select("chain_id"), "chain_id", "left_semi")).distinct()
    ahead = marks.withColumn("one", F.lead("pos", 1).over(w)).withColumn("two", F.lead("pos", 2).over(w))
    pairs = ahead.select("chain_id", F.col("pos").alias("start"), F.explode(F.array("one", "two")).alias("end"))
    return pairs.where((F.col("end") - F.col("start")).between(least, longest))


def peak_pieces(chains: DataFrame, residues: DataFrame, longest: int = 50, step: int = 25, least: int = 10) -> DataFrame:
    """chain_id, start and end of the pieces between peaks of the hydropathy's change; short ones join the next, long ones
    are cut by overlapping windows."""
    rows = residues.select("chain_id", "idx", property_of(F.col("aa"), "hyd").alias("hyd"))
    peaks = B.natural_peaks(rows, ["chain_id"], ["idx"], "hyd").where("boundary is not null").groupBy("chain_id").agg(F.array_sort(F.collect_list(F.col("boundary").cast("int"))).alias("p"))
    sorted_ = F.concat(F.array(F.lit(0)), F.coalesce("p", F.array().cast("array<int>")))
    marks = chains.join(peaks, "chain_id", "left").select("chain_id", F.array_union(B.min_gap(sorted_, least), F.array("n")).alias("m"))
    pairs = F.zip_with(F.slice("m", F.lit(1), F.size("m") - 1), F.slice("m", F.lit(2), F.size("m") - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    whole = marks.select("chain_id", F.explode(pairs).alias("w"))
    cut = F.transform(F.sequence(F.col("w.start"), F.col("w.end") - 1, F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(s + longest, F.col("w.end")).alias("end")))
    long_ = F.col("w.end") - F.col("w.start") > longest
    return whole.select("chain_id", F.explode(F.when(long_, cut).otherwise(F.array("w"))).alias("v")).select("chain_id", "v.start", "v.end")


def older_fragments(residues: DataFrame, longest: int = 50, step: int = 25, structure: Column | None = None) -> DataFrame:
    """chain_id, start, end and frag_id by the older rules, over known residues with a place.

    A chain that is short enough is one fragment, "full". Of the others those with structure runs give these; the rest are cut
    by random windows or at peaks, as a hash of the chain's name decides. Chains of fewer than 5 such residues give none.
    """
    known = _renumbered(residues)
    chains = chains_of(known).where("n >= 5").select("chain_id", "n")
    short, long_ = chains.where(F.col("n") <= longest), chains.where(F.col("n") > longest)
    runs = structure_runs(long_, structure_changes(known, structure), longest)
    rest = long_.join(runs.select("chain_id").distinct(), "chain_id", "left_anti")
    coin = F.conv(F.substring(F.md5(F.col("chain_id").cast("string")), 1, 1), 16, 10).cast("int") < 8
    windows = rest.where(coin).select("chain_id", F.explode(B.random_windows(F.col("n"), F.col("chain_id"), longest)).alias("w")).select("chain_id", "w.start", "w.end")
    at_peaks = rest.where(~coin)
    pieces = peak_pieces(at_peaks, known.join(at_peaks.select("chain_id"), "chain_id", "left_semi"), longest, step)
    named = runs.unionByName(windows).unionByName(pieces).withColumn("frag_id", F.concat((F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string")))
    return short.select("chain_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.lit("full").alias("frag_id")).unionByName(named)


def _renumbered(residues: DataFrame) -> DataFrame:
    """The known residues with a place, numbered anew from 0 in each chain."""
    place = F.row_number().over(Window.partitionBy("chain_id").orderBy("idx")) - 1
    return residues.where("aa <> 'X' and x is not null").withColumn("_p", place).drop("idx").withColumnRenamed("_p", "idx")
