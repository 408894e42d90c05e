"""Exact dedup by a stateful stream over content digests.

Each row's normalised text becomes a SHA-256 digest beside a locator (file, row). The digests run as a stream through a
keyed aggregation whose state lies on disk (RocksDB) and never expires: a digest keeps its smallest doc_id, the locator of
that row and the number of rows seen. The state is then read as a table. For every digest that was hit more than once the
full normalised bytes are compared; texts that only share a digest are told apart by their bytes.

Defined cases: a null text counts as empty; equal empty texts are one group. Null doc_ids sort after all others. Where equal
texts also share the doc_id, the row with the smaller locator stays, so exactly one row of a group is kept. An empty table
gives no rows. Very long texts are digested whole, and only those with a hit meet again. Other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, KEY, ROW, guarded, heavy_keys, keyed, scratch, settle, spread_join

BLANKS = r"[\x20\x09-\x0D]+"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: No preallocated files, each of which takes some MB of disk for every state partition. An executor's partitions share one bound
#: of native memory, however many they are; what is over it lies on disk.
_OPTION = "spark.sql.streaming.stateStore.rocksdb."
ROCKS_OPTIONS = {f"{_OPTION}allowFAllocate": "false", f"{_OPTION}boundedMemoryUsage": "true", f"{_OPTION}maxMemoryUsageMB": "128", f"{_OPTION}writeBufferCacheRatio": "0.5"}


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _first() -> Column:
    """Orders the rows of a group; nulls come last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(FILE).alias("file"), F.col(ROW).alias("row"))


def digest_state(spark: SparkSession, prints: str, schema, max_bytes: int) -> tuple[DataFrame, str]:
    """Run the digests through the keyed stream; returns (digest, first, n) and the checkpoint that holds the state."""
    at = scratch(spark, "exact-state")
    ours = {"spark.sql.streaming.stateStore.providerClass": ROCKS} | ROCKS_OPTIONS
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        (
            spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes)).parquet(prints)
            .groupBy("digest").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"))
            .writeStream.outputMode("update").format("noop").option("checkpointLocation", at).trigger(availableNow=True)
            .start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    state = spark.read.format("statestore").load(at)
    first, n = state.schema["value"].dataType.names[:2]
    return state.select(F.col("key.digest").alias("digest"), F.col("value")[first].alias("first"), F.col("value")[n].alias("n")), at


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, max_bytes: int = 8 << 30, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per row of docs: KEY, doc_id, digest, keep_id, group_size, kept.

    digest may be any function of the normalised text, even one that collides: hits are settled by full bytes.
    broadcast_rows bounds the digests that are broadcast to find the hits; beyond it the join shuffles.
    """
    spark = docs.sparkSession
    rows = keyed(docs).select("doc_id", normalise(F.col("text")).alias("body"), *KEY)
    prints, at_prints = settle(rows.select("doc_id", digest(F.col("body")).alias("digest"), *KEY), "exact-prints")
    state, _ = digest_state(spark, at_prints, prints.schema, max_bytes)
    state, _ = settle(state, "exact-groups")

    hits = state.where("n > 1").select(F.col("digest").alias("hit"))
    hits = F.broadcast(hits) if hits.count() <= broadcast_rows else hits
    texts = rows.withColumn("digest", digest(F.col("body"))).join(hits, F.col("digest") == F.col("hit"), "left_semi")
    texts = texts.groupBy("digest", "body").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"))
    # a digest's keeper is where its locator points; any other body under that digest is another text
    shared = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1").select("digest")
    shared, _ = settle(shared, "exact-shared")

    alone = prints
    if not shared.isEmpty():
        alone = prints.join(shared, "digest", "left_anti")
    heavy, _ = heavy_keys(state, ["digest"], "n")
    found = spread_join(alone, state, ["digest"], heavy).select(*KEY, "doc_id", "digest", "first", "n")
    if not shared.isEmpty():
        mixed = rows.withColumn("digest", digest(F.col("body"))).join(shared, "digest", "left_semi")
        split = mixed.groupBy("digest", "body").agg(F.min(_first()).alias("first"), F.count(F.lit(1)).alias("n"))
        found = found.unionByName(spread_join(mixed, split, ["digest", "body"], heavy_keys(split, ["digest", "body"], "n")[0]).select(*KEY, "doc_id", "digest", "first", "n"))
    return found.select(
        *KEY, "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        ((F.col("first.file") == F.col(FILE)) & (F.col("first.row") == F.col(ROW))).alias("kept"),
    )


def exact_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts."""
    docs, named = guarded(docs)
    rows = keyed(docs)
    gone = exact_groups(rows).where(~F.col("kept")).select(*KEY)
    return named(rows.join(gone, KEY, "left_anti").select(*docs.columns))
