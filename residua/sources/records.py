"""JSON records and manifests: sequence maps of either shape, id lists of three shapes, chunked sinks with an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def batch_folders(spark: SparkSession, path: str) -> list[str]:
    """The folders batch_* in path, sorted; path itself where there are none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(f.getPath().toString() for f in found if f.isDirectory() and f.getPath().getName().startswith("batch_")) or [path]


def sequence_json(spark: SparkSession, path: str | list[str], prefixes: tuple[str, ...] = ()) -> DataFrame:
    """seq_id and sequence from files {id: {"sequence": ...}} or {id: "..."}; unreadable files give no rows. With prefixes
    only files whose names begin with one of them are read."""
    glob = "{" + ",".join(f"{p}*.json" for p in prefixes) + "}" if prefixes else "*.json"
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("seq_id", "value"), F.col("_metadata.file_path").alias("file"))
    return rows.select("seq_id", F.coalesce(F.get_json_object("value", "$.sequence"), F.col("value")).alias("sequence"), "file")


def retained_ids(spark: SparkSession, path: str) -> DataFrame:
    """retained_id from a JSON list, {"retained_ids": [...]} or a map of records."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", "array<string>")
    wrapped = F.from_json(F.get_json_object("value", "$.retained_ids"), "array<string>")
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    return whole.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(F.coalesce(wrapped, keys))).alias("retained_id")).distinct()


def last_wins(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """Of rows with one key the last in order stays."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def write_chunks(rows: DataFrame, path: str, per_file: int = 100_000, form: str = "parquet") -> DataFrame:
    """Write files of at most per_file rows; returns file and rows, read back from what was written."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).format(form).save(path)
    back = rows.sparkSession.read.schema(rows.schema).format(form).load(path)
    return back.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def merge_manifest(index: DataFrame, new: DataFrame, key: str = "seq_id", force: bool = False) -> DataFrame:
    """index with the entries of new; an entry that is there stays, unless force puts the new one in its place."""
    if force:
        return index.join(new.select(key), key, "left_anti").unionByName(new)
    return index.unionByName(new.join(index.select(key), key, "left_anti"))


def stored_graphs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The graphs of a folder of parquet files; files that are gone or broken give no rows."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).option("recursiveFileLookup", True).parquet(path)


def fetched(graphs: DataFrame, wanted: DataFrame, manifest: DataFrame, key: str, file: str) -> DataFrame:
    """The wanted graphs, read from files alone that the manifest names for them."""
    files = manifest.join(wanted.select(key), key, "left_semi").select(file).distinct()
    return graphs.join(files, file, "left_semi").join(wanted.select(key), key, "left_semi")


def cache_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, cached and expected of cache descriptions in JSON: a count of nought counts as missing, and a missing one is the
    number of graphs, or of those cached."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "cached_count long, total_graphs long, expected_graph_count long").alias("m"))
    cached = F.coalesce(F.nullif(F.col("m.cached_count"), F.lit(0)), "m.total_graphs", F.lit(0))
    return whole.select("file", cached.alias("cached"), F.coalesce(F.nullif(F.col("m.expected_graph_count"), F.lit(0)), cached).alias("expected"))


def write_indexed(rows: DataFrame, path: str, key: str, per_file: int = 50_000) -> DataFrame:
    """Write files of at most per_file rows; returns key and file of each row, and writes that index beside them."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(f"{path}/graphs")
    back = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/graphs").select(key, F.substring_index(F.input_file_name(), "/", -1).alias("file"))
    back.write.mode("overwrite").parquet(f"{path}/index")
    return rows.sparkSession.read.schema(back.schema).parquet(f"{path}/index")
