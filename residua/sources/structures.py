"""Structure files: recursive scan with one file for each stem, and parsers of PDB and CIF atom records in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from residua.functions.sequence import one_letter

SUFFIXES = r"\.(pdb|cif)(\.gz)?$"


def structure_files(spark: SparkSession, root: str) -> DataFrame:
    """stem and path of the files below root; of files with one stem the first path stays."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    found = found.where(F.col("path").rlike(SUFFIXES)).withColumn("stem", F.substring_index(F.substring_index("path", "/", -1), ".", 1))
    first = F.row_number().over(Window.partitionBy("stem").orderBy("path"))
    return found.withColumn("_n", first).where("_n = 1").drop("_n")


def _stem(path: Column) -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def atoms(spark: SparkSession, root: str, glob: str = "*.pdb*", recursive: bool = True) -> DataFrame:
    """One row for each atom record of the PDB files below root, plain or gzipped; model counts from 1, in files without models too.

    A file is read as one text, since a record's model is told by the lines before it alone. Hetero records are left out.
    """
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(root, wholetext=True)
    models = files.select(_stem(F.col("_metadata.file_path")).alias("protein_id"), F.posexplode(F.split("value", r"(?m)^(?=MODEL\b)")).alias("k", "body"))
    # what stands before the first of several models has no atoms, and so no row
    lines = models.select("protein_id", "k", F.explode(F.split("body", r"\r?\n")).alias("value")).where(F.col("value").startswith("ATOM"))
    at = lambda start, n: F.trim(F.substring("value", start, n))
    number = lambda start, n: F.expr("try_cast(trim(substring(value, {}, {})) as double)".format(start, n))
    return lines.select(
        "protein_id", at(22, 1).alias("chain_id"), F.expr("try_cast(trim(substring(value, 23, 4)) as int)").alias("res_idx"), at(18, 3).alias("residue_name"), at(13, 4).alias("atom"),
        number(31, 8).alias("x"), number(39, 8).alias("y"), number(47, 8).alias("z"), number(61, 6).alias("b_factor"), F.greatest(F.col("k"), F.lit(1)).alias("model"),
    )


# The atom table's items of a CIF file, and the columns that they give; of two items the first that is there.
CIF_ITEMS = {
    "chain_id": ("auth_asym_id", "label_asym_id"), "res_idx": ("auth_seq_id", "label_seq_id"), "residue_name": ("label_comp_id", "auth_comp_id"), "atom": ("label_atom_id", "auth_atom_id"),
    "x": ("Cartn_x",), "y": ("Cartn_y",), "z": ("Cartn_z",), "b_factor": ("B_iso_or_equiv",), "model": ("pdbx_PDB_model_num",),
}


def cif_atoms(spark: SparkSession, root: str, glob: str = "*.cif*", recursive: bool = True) -> DataFrame:
    """The columns of atoms() from the CIF files below root, plain or gzipped. Items may come in any order; `.` and `?` are null.

    The names of the atom table's items come first in its loop, so a value's place in a row is its name's place among them.
    """
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(root, wholetext=True)
    names = F.regexp_extract_all("value", F.lit(r"(?m)^_atom_site\.(\S+)"), F.lit(1))
    rows = F.regexp_extract_all("value", F.lit(r"(?m)^(ATOM\s.*)$"), F.lit(1))
    lines = files.select(_stem(F.col("_metadata.file_path")).alias("protein_id"), names.alias("names"), F.explode(rows).alias("row"))
    # a value in quotes may hold blanks and the other quote
    cells = lines.select("protein_id", "names", F.regexp_extract_all("row", F.lit(r"'(?:[^']|'(?=\S))*'|\"(?:[^\"]|\"(?=\S))*\"|\S+"), F.lit(0)).alias("cells"))

    def item(name: str) -> Column:
        found = [F.try_element_at("cells", F.nullif(F.array_position("names", n), F.lit(0)).cast("int")) for n in CIF_ITEMS[name]]
        value = F.regexp_replace(F.coalesce(*found), r"^(['\"])(.*)\1$", "$2")
        return F.when(value.isin(".", "?"), None).otherwise(value)

    kinds = {"res_idx": "int", "x": "double", "y": "double", "z": "double", "b_factor": "double", "model": "int"}
    out = cells.select("protein_id", *(item(n).alias(n) for n in CIF_ITEMS))
    cast = [F.expr(f"try_cast({c} as {kinds[c]})").alias(c) if c in kinds else F.col(c) for c in out.columns]
    return out.select(*cast).na.fill({"model": 1})


def last_model(atoms_: DataFrame) -> DataFrame:
    """Of a chain that several models hold, the atoms of the last."""
    last = atoms_.groupBy("protein_id", "chain_id").agg(F.max("model").alias("model"))
    return atoms_.join(last, ["protein_id", "chain_id", "model"], "left_semi")


def chain_residues(atoms_: DataFrame, least: int = 5) -> DataFrame:
    """Residues with a CA atom as the fragmenters take them: chain_id (protein, chain and model), idx from 0, aa, x, y, z, plddt;
    of chains with `least` such residues at least."""
    keys = ["protein_id", "chain_id", "model"]
    ca = lambda c: F.max(F.when(F.col("atom") == "CA", F.col(c))).alias(c)
    rows = atoms_.groupBy(*keys, "res_idx", "residue_name").agg(ca("x"), ca("y"), ca("z"), F.coalesce(F.avg("b_factor"), F.lit(70.0)).alias("plddt")).where("x is not null")
    chain = Window.partitionBy(*keys)
    rows = rows.withColumn("idx", F.row_number().over(chain.orderBy("res_idx", "residue_name")) - 1).withColumn("_n", F.count(F.lit(1)).over(chain)).where(F.col("_n") >= least)
    return rows.select(F.concat_ws("_", "protein_id", "chain_id", F.col("model").cast("string")).alias("chain_id"), "idx", one_letter(F.col("residue_name")).alias("aa"), "x", "y", "z", "plddt")


def residues_of(atoms_: DataFrame) -> DataFrame:
    """Residues with the place of their CA atom (null without one) and pLDDT, the mean B-factor (70 without any)."""
    ca = lambda c: F.max(F.when(F.col("atom") == "CA", F.col(c))).alias(c)
    rows = atoms_.groupBy("protein_id", "chain_id", "res_idx", "residue_name").agg(ca("x"), ca("y"), ca("z"), F.coalesce(F.avg("b_factor"), F.lit(70.0)).alias("plddt"))
    return rows.withColumn("residue_code", one_letter(F.col("residue_name")))


def chain_lengths(atoms_: DataFrame) -> DataFrame:
    """Standard residues of each chain; of its models the last counts."""
    known = residues_of(last_model(atoms_)).where("residue_code <> 'X'")
    return known.groupBy("protein_id", "chain_id").agg(F.count(F.lit(1)).alias("n_residues"))
