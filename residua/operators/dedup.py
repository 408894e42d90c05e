"""Similar sequences within length buckets: exact Jaccard pairs, MinHash signatures, bands, and the greedy cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from residua.functions.sequence import kmers
from residua.operators import similar
from residua.session import checkpointed

BANDS, ROWS = 18, 7


def shingled(seqs: DataFrame, id_: str = "doc_id", k: int = 3) -> DataFrame:
    return seqs.select(F.col(id_).alias("id"), F.expr("len div 5").alias("bucket"), "len", F.array_distinct(kmers(F.col("seq"), k)).alias("grams"))


def jaccard_pairs(seqs: DataFrame, threshold: float = 0.6, coverage: float = 0.8, driver_grams: int = 20_000) -> DataFrame:
    """Pairs of a bucket with Jaccard similarity of their 3-mers and length ratio at the thresholds at least.

    A set is shuffled once to each part of its bucket, as bits where the 8000 possible grams are driver_grams at most, else as a
    list, and a task compares all sets of two parts. Rows without an id are in no pair, nor are two rows of one id.
    """
    checkpointed(seqs.sparkSession)
    sets = similar.gram_sets(seqs, "doc_id", similar.GRAMS <= driver_grams).checkpoint()
    return similar.similar_pairs(sets, threshold, coverage).withColumn("jaccard", F.round("jaccard", 6))


def md5_number(text: Column) -> Column:
    """The first 32 bits of an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def signatures(rows: DataFrame, size: int, portable: bool = False, broadcast_grams: int = 100_000) -> DataFrame:
    """rows of shingled() with sig, the MinHash signature; the portable family is MD5, the other one xxHash.

    Each distinct gram is hashed once. There are few (8000 of three residues), so their table is broadcast; beyond
    broadcast_grams it is joined by shuffle.
    """
    each = rows.select("id", "bucket", "len", F.explode_outer("grams").alias("gram"))
    one = (lambda p: md5_number(F.concat("gram", F.lit(f":{p}")))) if portable else (lambda p: F.xxhash64("gram", F.lit(p)))
    table = each.where("gram is not null").select("gram").distinct().select("gram", F.array(*(one(p) for p in range(size))).alias("h"))
    if table.select("gram").limit(broadcast_grams + 1).count() <= broadcast_grams:
        table = F.broadcast(table)
    least = F.array(*(F.coalesce(F.min(F.col("h")[p]), F.lit(None if portable else 0).cast("long")) for p in range(size)))
    return each.join(table, "gram", "left").groupBy("id", "bucket", "len").agg(least.alias("sig"))


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.concat(b.cast("string"), F.lit(":"), F.array_join(F.slice(sig, b * rows + 1, F.lit(rows)).cast("array<string>"), ",")))


def band_members(seqs: DataFrame, bands: int = BANDS, rows: int = ROWS, portable: bool = False) -> DataFrame:
    """id, bucket, len and band: one row for each band of each sequence."""
    sigs = signatures(shingled(seqs), bands * rows, portable)
    return sigs.select("id", "bucket", "len", F.explode(band_keys(F.col("sig"), bands, rows)).alias("band"))


def candidate_pairs(members: DataFrame) -> DataFrame:
    a = members.select(F.col("id").alias("id1"), "bucket", "band")
    b = members.select(F.col("id").alias("id2"), "bucket", "band")
    return a.join(b, ["bucket", "band"]).where("id1 < id2").select("id1", "id2").distinct()


def greedy_retained(members: DataFrame, coverage: float = 0.8) -> DataFrame:
    """Ids that a pass in order (longest first, then by id) keeps: a sequence goes if it meets kept ones in its bands and
    its length covers all of theirs.

    The pass is run in rounds over band groups, never over pairs. A sequence that is the first open one in all its groups is
    settled by what its groups have kept. One that meets a kept sequence goes at once if every earlier member of its groups,
    kept or open, is covered, as nothing that is still open can then change its fate.
    """
    order = F.struct((-F.col("len")).alias("n"), F.col("id"))
    open_ = members.select("id", "len", F.concat_ws("|", F.col("bucket").cast("string"), "band").alias("g")).withColumn("ord", order).checkpoint()
    kept = open_.where("false").select("id", "len", "g")
    retained = None
    while not open_.isEmpty():
        firsts = open_.groupBy("g").agg(F.min("ord").alias("first"), F.max("len").alias("open_max"))
        state = kept.groupBy("g").agg(F.min("len").alias("kept_min"), F.max("len").alias("kept_max"))
        seen = open_.join(firsts, "g").join(state, "g", "left").groupBy("id", "len").agg(
            F.bool_and(F.col("ord") == F.col("first")).alias("leads"), F.max("kept_max").alias("kept_max"), F.min("kept_min").alias("kept_min"), F.max("open_max").alias("open_max"),
        )
        covered = lambda other: F.least("len", other) / F.greatest("len", other) >= coverage
        meets = F.col("kept_max").isNotNull()
        goes = meets & covered("kept_max") & covered("kept_min") & (F.col("leads") | covered("open_max"))
        decided = seen.withColumn("goes", goes).where(F.col("goes") | F.col("leads")).select("id", "goes").checkpoint()
        wins = decided.where(~F.col("goes")).select("id")
        retained = wins if retained is None else retained.union(wins)
        kept = kept.union(open_.join(wins, "id").select("id", "len", "g")).checkpoint()
        open_ = open_.join(decided.select("id"), "id", "left_anti").checkpoint()
    return retained if retained is not None else members.select("id").where("false")
