"""Boundary detection along ordered rows, and the fragments between boundaries. Windows are per chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smoothed(rows: DataFrame, keys: list[str], order: list[str], value: str, window: int | None = 5) -> DataFrame:
    """rows with smooth (moving sum over window, zeros beyond the ends), grad (absolute central difference, one-sided at the
    ends) and norm (over the chain's largest). Without a window it is a fiftieth of the chain, from 3 to 5."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    mean = lambda k: F.sum(value).over(w.rowsBetween(-(k // 2), (k - 1) // 2)) / k
    n = F.count(F.lit(1)).over(whole)
    rows = rows.withColumn("smooth", mean(window) if window else F.when(n < 200, mean(3)).when(n < 250, mean(4)).otherwise(mean(5)))
    before, after = F.lag("smooth").over(w), F.lead("smooth").over(w)
    grad = F.when(before.isNull(), after - F.col("smooth")).when(after.isNull(), F.col("smooth") - before).otherwise((after - before) / 2)
    rows = rows.withColumn("grad", F.abs(F.coalesce(grad, F.lit(0.0))))
    top = F.max("grad").over(whole)
    return rows.withColumn("norm", F.when(top > 0, F.col("grad") / top).otherwise(F.lit(0.0)))


def gradient_boundaries(rows: DataFrame, keys: list[str], floor: float = 0.2, deviations: float = 1.0) -> DataFrame:
    whole = Window.partitionBy(*keys)
    bound = F.greatest(F.lit(floor), F.avg("norm").over(whole) + deviations * F.stddev_pop("norm").over(whole))
    return rows.withColumn("boundary", (F.col("norm") > bound).cast("int"))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with pos, the 0-based place in the chain, and changed: the value differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("pos", F.row_number().over(w) - 1).withColumn("changed", F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(False)).cast("int"))


def natural_peaks(rows: DataFrame, keys: list[str], order: list[str], value: str, window: int = 5) -> DataFrame:
    """Differences of the means of neighbouring windows; a boundary lies `window` behind a local maximum above the mean by
    half a deviation."""
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("pos", F.row_number().over(w) - 1)
    one, two = F.avg(value).over(w.rowsBetween(0, window - 1)), F.avg(value).over(w.rowsBetween(window, 2 * window - 1))
    full = F.count(F.lit(1)).over(whole) - 2 * window >= F.col("pos")
    rows = rows.withColumn("step", F.when(full, F.abs(one - two)))
    peak = (F.col("step") > F.lag("step").over(w)) & (F.col("step") > F.lead("step").over(w)) & (F.col("step") > F.avg("step").over(whole) + 0.5 * F.stddev_pop("step").over(whole))
    return rows.withColumn("boundary", F.when(F.coalesce(peak, F.lit(False)), F.col("pos") + window))


def min_gap(positions: Column, gap: int) -> Column:
    """Of sorted positions, those at least gap behind the last one kept."""
    keep = lambda kept, p: F.when(F.size(kept) == 0, F.array(p)).when(p - F.element_at(kept, -1) >= gap, F.concat(kept, F.array(p))).otherwise(kept)
    return F.aggregate(positions, F.array().cast("array<int>"), keep)


def windows(n: Column, longest: int = 50, least: int = 5) -> Column:
    """Overlapping windows (start, end) over 0..n: steps of half the length, a last one of `least` at least."""
    step = max(least, longest // 2)
    every = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: F.struct(s.alias("start"), F.least(s + longest, n).alias("end")))
    # a window that starts behind one that reached the end isn't there
    return F.filter(every, lambda w: (w["end"] - w["start"] >= least) & ((w["start"] == 0) | (w["start"] - step + longest < n)))


def right_aligned(n: Column, longest: int = 50, step: int = 25) -> Column:
    """Windows of one length each step, and one at the end where the steps miss it; the whole where it is no longer."""
    last = n - longest
    every = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)), lambda s: F.struct(s.alias("start"), (s + longest).alias("end")))
    tail = F.when(last % step != 0, F.array(F.struct(last.alias("start"), n.alias("end")))).otherwise(F.slice(every, F.lit(1), F.lit(0)))
    return F.when(n <= longest, F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))).otherwise(F.concat(every, tail))


def fragments(chains: DataFrame, boundaries: DataFrame, longest: int = 50, least: int = 5) -> DataFrame:
    """chain_id, start, end and frag_id. chains: chain_id and n; boundaries: chain_id and pos.

    Gaps between neighbouring boundaries (with 0, n and every multiple of longest) of least to longest residues are
    fragments; a chain without any is cut by windows.
    """
    fixed = chains.select("chain_id", F.explode(F.array_union(F.sequence(F.lit(0), "n", F.lit(longest)), F.array(F.lit(0), F.col("n")))).alias("pos"))
    every = fixed.unionByName(boundaries.select("chain_id", F.col("pos").cast("int").alias("pos"))).distinct()
    w = Window.partitionBy("chain_id").orderBy("pos")
    gaps = every.withColumn("end", F.lead("pos").over(w)).where((F.col("end") - F.col("pos")).between(least, longest)).select("chain_id", F.col("pos").alias("start"), "end")
    bare = chains.join(gaps.select("chain_id").distinct(), "chain_id", "left_anti").select("chain_id", F.explode(windows(F.col("n"), longest, least)).alias("w")).select("chain_id", "w.start", "w.end")
    out = gaps.unionByName(bare)
    return out.withColumn("frag_id", F.concat((F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string")))


def random_windows(n: Column, seed: Column, longest: int = 50, least: int = 20) -> Column:
    """Windows of seeded lengths from least to longest, at seeded steps of half of least to least, until the end is reached.

    The seeds are the first 32 bits of the MD5 of "seed:k:what".
    """
    drawn = lambda k, what, m: (F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), k.cast("string"), F.lit(what))), 1, 8), 16, 10).cast("long") % m).cast("int")

    def turn(done: Column, k: Column) -> Column:
        start = F.when(F.size(done) == 0, F.lit(0)).otherwise(F.element_at(done, -1)["start"] + F.lit(least // 2) + drawn(k, "step", least // 2 + 1))
        size = F.lit(least) + drawn(k, "size", longest - least + 1)
        ended = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= n)
        return F.when(ended | (start >= n), done).otherwise(F.concat(done, F.array(F.struct(start.alias("start"), F.least(start + size, n).alias("end")))))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(n / (least // 2)).cast("int")), F.array().cast("array<struct<start:int,end:int>>"), turn)
