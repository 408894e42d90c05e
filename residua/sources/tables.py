"""Input tables: parquet tables by name, and the sequences and residues that the analytics work on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.functions.sequence import residues_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq and len: all residue letters of each document's whole text; five at least."""
    letters = F.regexp_replace(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    return table(spark, sf_dir, "documents").select("doc_id", letters.alias("seq")).withColumn("len", F.length("seq")).where("len >= 5")


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq and len: a short peptide for each sequence, of 5 to 50 residues, as the graph operators take them."""
    rows = sequences(spark, sf_dir).select("doc_id", F.expr("substring(seq, 1, int(5 + doc_id % 46))").alias("seq"))
    return rows.withColumn("len", F.length("seq"))


def residues(spark: SparkSession, sf_dir: str, chains: DataFrame | None = None) -> DataFrame:
    """graph_id, idx, aa, x, y, z and plddt: each chain, a peptide by default, as an ideal helix."""
    rows = peptides(spark, sf_dir) if chains is None else chains
    rows = rows.select(F.col("doc_id").alias("graph_id"), F.posexplode(residues_of(F.col("seq"))).alias("idx", "aa"))
    aa = F.col("aa")
    angle = F.radians(100.0 * F.col("idx"))
    return rows.select(
        "graph_id", "idx", "aa", F.round(2.3 * F.cos(angle), 6).alias("x"), F.round(2.3 * F.sin(angle), 6).alias("y"),
        F.round(1.5 * F.col("idx"), 6).alias("z"), (50 + (F.ascii(aa) * 7 + F.col("idx") * 13) % 50).cast("double").alias("plddt"),
    )


def chain_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The residues of the whole chains, with chain_id for graph_id."""
    return residues(spark, sf_dir, sequences(spark, sf_dir)).withColumnRenamed("graph_id", "chain_id")


def helix(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places, a row of x, y and z for each residue, and the plddt of residues() for a chain's letters."""
    idx = np.arange(len(letters))
    angle = np.radians(100.0 * idx)
    places = np.stack([np.round(2.3 * np.cos(angle), 6), np.round(2.3 * np.sin(angle), 6), np.round(1.5 * idx, 6)], axis=1)
    return places, (50 + (letters.astype(np.int64) * 7 + idx * 13) % 50).astype(float)


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain_id and seq of the whole chains."""
    return sequences(spark, sf_dir).select(F.col("doc_id").alias("chain_id"), "seq")
