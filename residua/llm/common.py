"""Session, scratch-folder and row-identity helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, ROW = "_rsd_file", "_rsd_row"
KEY = [FILE, ROW]
#: A key with over 1 / SHARES of a join's rows is split.
SHARES = 1000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir, or the one set on the context.

    Only a local session without either gets a folder of its own; on a cluster that would be one machine's.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir() or getattr(context, "_residua_scratch", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = context._residua_scratch = "file://" + tempfile.mkdtemp(prefix="residua-")
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/residua-{name}-{uuid.uuid4().hex[:12]}"


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df to the shared scratch folder and read it again: the lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the two columns of KEY: a hash of the row's file and its index there.

    This names a row even where doc_id is null or repeated, and stays the same when a task runs again.
    A DataFrame that is not read from files is written to the scratch folder first.
    """

    def put(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(meta["file_path"]).alias(FILE), meta["row_index"].alias(ROW))

    docs = docs.drop(*KEY)
    try:
        return put(docs)
    except AnalysisException as e:
        if "_metadata" not in str(e):
            raise
        return put(settle(docs, "input")[0])


def guarded(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs whose columns don't clash with those of the operators, and the way back to their names."""
    names = docs.columns
    return docs.toDF(*(f"own{k}{c}" if c.lower().startswith("_rsd_") else c for k, c in enumerate(names))), lambda out: out.toDF(*names)


#: The keys of a join that hold very many rows: (bits of a key's hash, parts), at most SHARES of them.
Heavy = list[tuple[int, int]]


def heavy_keys(counts: DataFrame, on: list[str], n: str, shares: int = SHARES) -> tuple[Heavy, int]:
    """Keys that hold over 1 / shares of all rows, with the parts (a power of two) into which each is to be split, and the rows
    in all.

    counts has one row for each key and its number n of rows, so at most `shares` keys come out, whatever the data.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    share = max(1, total // shares)
    found = counts.where(F.col(n) > share).select(_bits(on).alias("bits"), F.ceil(F.col(n) / share).cast("int").alias("parts")).collect()
    return [(r.bits, 1 << (r.parts - 1).bit_length()) for r in found], total


def _bits(on: list[str]) -> Column:
    return F.shiftright(F.xxhash64(*on), 1)


def _parts(on: list[str], heavy: Heavy) -> Column:
    """The parts of a row's key. They follow from the key alone, so both sides of a join have the same and need no lookup."""
    sizes: dict[int, list[str]] = {}
    for bits, parts in heavy:
        sizes.setdefault(parts, []).append(f"{bits}L")
    key = f"shiftright(xxhash64({', '.join(f'`{c}`' for c in on)}), 1)"
    return F.expr("CASE " + " ".join(f"WHEN {key} IN ({', '.join(sizes[p])}) THEN {p}" for p in sorted(sizes, reverse=True)) + " ELSE 1 END") if sizes else F.lit(1)


def spread_join(large: DataFrame, small: DataFrame, on: list[str], heavy: Heavy) -> DataFrame:
    """Inner join of large with small, which has each key once. The rows of heavy keys are split, and their row in small goes to each part."""
    if kinds := [c for c in on if large.schema[c].dataType != small.schema[c].dataType]:
        raise TypeError(f"keys of different types: {kinds}")
    large = large.withColumn("_rsd_part", F.pmod(F.xxhash64(*large.columns), _parts(on, heavy)).cast("int"))
    small = small.withColumn("_rsd_part", F.explode(F.sequence(F.lit(0), _parts(on, heavy) - 1)))
    return large.join(small, [*on, "_rsd_part"]).drop("_rsd_part")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
