"""Incremental sequence intake: a stream over a folder of JSON records, each id taken once, written idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "seq_id string, sequence string, ts timestamp"


def new_sequences(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Records of files as they arrive; an id that was seen within the watermark is dropped."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq_id"]).withColumn("seq_hash", F.md5(F.coalesce(F.nullif("sequence", F.lit("")), F.lit("empty"))))


def write_new(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the ids that no other batch of target holds, so none comes back behind the watermark either; a batch that runs
    again replaces itself. Of target the ids alone are read."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            held = spark.read.schema("seq_id string, batch int").option("basePath", target).parquet(target).where(F.col("batch") != number)
            batch = batch.join(held.select("seq_id"), "seq_id", "left_anti")
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def length_counts(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """Sequences by hour and length bucket, for rows with a watermark."""
    return rows.groupBy(F.window("ts", window), F.expr("length(sequence) div 5").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
