"""Near-duplicate components by MinHash with tensored banding.

A row's set holds the distinct 5-word shingles of its whole text (words as in textkit.blank_words after lower-casing A-Z; a
shorter text is one shingle). Two small collections of `width` hashes, `bands` groups each, are computed; table key (i, j)
joins group i of the first with group j of the second. So bands**2 tables of 2 * width hashes come from 2 * bands * width
minimum hashes, a square root of the work. A pair at similarity s meets in some table with probability
(1 - (1 - s**width)**bands)**2. Where no bands are given, they are the least with which a pair at the threshold is missed with
a chance under MISS: 12 at 85 percent, 17 at 80. op2 links at PERCENT, the corpus pipeline's stage at STAGE_PERCENT.

Rows whose sets are equal form one class first, however many they are. Classes that meet in a table are candidates:

* Shingles that no other candidate has bound what a class can share. Classes that can't reach the threshold with anything, and
  pairs that can't with each other, are left out; the bound is exact.
* Each round, a class is held against one other class that it meets and isn't yet joined with: the centre of one of its
  tables. So a round checks at most one pair for each class, and a group of any size is joined to few centres without listing
  its pairs. Rounds go on while they halve what is left.
* What then is left, classes of different components that meet in a table, is compared with what most classes around it have.
  Two of them can be linked only if they differ from that in part alike, so a pair is checked if one of its rarest such
  differences is in both, in bounded blocks. The bound is exact, so no candidate that can be linked is dropped.

A pair is linked if 100 * intersection >= percent * union of the full sets (64-bit shingle hashes).

Defined cases: null, empty and blank texts have no shingle and are linked with nothing. Rows with equal sets are linked. A
null doc_id takes part, and is the component's id only if no row of it has an id. Repeated rows are linked with each other. An
empty table gives no rows. A very long text has all its shingles in one set. near_dedup passes other columns through, whatever
their names. doc_id is read as a long, which component_id needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import FILE, KEY, ROW, Heavy, drop, guarded, heavy_keys, keyed, settle, spread_join

U = np.uint64
WIDTH, PERCENT, STAGE_PERCENT, MISS = 4, 85, 80, 3e-4
_rng = np.random.Generator(np.random.PCG64(7))
_FACTORS = _rng.integers(0, 1 << 63, 4096, dtype=U) * U(2) + U(1)
_PLACES = (0x9AE16A3B2F90404F, 0xC949C7DEFE8B9F2B, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def bands_for(percent: int, width: int = WIDTH, miss: float = MISS) -> int:
    """The least bands with which a pair at percent is missed with a chance under miss."""
    met, bands = (percent / 100) ** width, 1
    while 1 - (1 - (1 - met) ** bands) ** 2 >= miss:
        bands += 1
    return bands


def shingles(column: pa.Array, size: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes ordered by text, bounds of each text among them)."""
    for at, end, data, offsets in tk.slices(column):
        low = tk.lower(data)
        starts, ends, before = tk.blank_words(low, offsets)
        words = tk.SpanHash(low).of(starts, ends)
        n = np.diff(before)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(end - at), count)
        first = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + before[:-1][text] if len(text) else np.zeros(0, np.int64)
        h = np.zeros(len(text), U)
        own = np.minimum(n, size)[text]
        for k in range(size):
            has = own > k
            h[has] += words[first[has] + k] * U(_PLACES[k % len(_PLACES)] + 2 * (k // len(_PLACES)))
        h = tk.mix(h + own.astype(U))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        yield at, end, h, np.searchsorted(text, np.arange(end - at + 1))


def groups_of(h: np.ndarray, bounds: np.ndarray, collection: int, bands: int, width: int) -> np.ndarray:
    """Group keys of one collection, a row for each text with a shingle."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(some), bands), U)
    at = bounds[:-1][some]
    for b in range(bands):
        for w in range(width):
            k = (collection * bands + b) * width + w
            x = (h ^ _FACTORS[2 * k % 4096]) * _FACTORS[(2 * k + 1) % 4096]
            out[:, b] = tk.mix(out[:, b] + np.minimum.reduceat(x, at)) if len(at) else out[:, b]
    return out


def _sets(rows: DataFrame, bands: int, width: int) -> DataFrame:
    """KEY, doc_id, n_shingles, the 128-bit name of the set (id) and the group keys a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, h, bounds in shingles(batch["text"]):
                n = np.diff(bounds)
                some = n > 0
                sums = [np.zeros(end - at, U), np.zeros(end - at, U)]
                keys = [np.zeros((end - at, bands), U) for _ in (0, 1)]
                for k in (0, 1):
                    if some.any():
                        sums[k][some] = tk.mix(np.add.reduceat(tk.mix(h * U(_PLACES[k])), bounds[:-1][some]) + n[some].astype(U))
                    keys[k][some] = groups_of(h, bounds, k, bands, width)
                sub = batch.slice(at, end - at)
                wide = np.arange(0, (end - at) * bands + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [sub["doc_id"], *(sub[c] for c in KEY), pa.array(n), pa.array([x.tobytes() for x in np.stack(sums, axis=1)], pa.binary()), *(pa.ListArray.from_arrays(wide, x.reshape(-1).view(np.int64)) for x in keys)],
                    names=["doc_id", *KEY, "n_shingles", "id", "a", "b"],
                )
        tk.release()

    return rows.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, n_shingles long, id binary, a array<long>, b array<long>")


def _shingle_rows(rows: DataFrame) -> DataFrame:
    """id, num and the set as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, h, bounds in shingles(batch["text"]):
                yield pa.RecordBatch.from_arrays([batch["id"].slice(at, end - at), batch["num"].slice(at, end - at), pa.ListArray.from_arrays(bounds.astype(np.int32), h.view(np.int64))], names=["id", "num", "shingles"])
        tk.release()

    return rows.select("id", "num", "text").mapInArrow(run, "id binary, num long, shingles array<long>")


def _with_sets(pairs: DataFrame, sets: DataFrame, broadcast_rows: int) -> DataFrame:
    """pairs (x, y, ...) with their full sets sx and sy. An id in very many pairs is split.

    Only the sets of ids in pairs are shuffled, as long as their names can be broadcast.
    """
    pairs, _ = settle(pairs, "near-pairs")
    ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    if ids.count() <= broadcast_rows:
        sets = sets.join(F.broadcast(ids), "id", "left_semi")
    heavy = {c: heavy_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("c")), [c], "c")[0] for c in ("x", "y")}
    left = sets.select(F.col("id").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("id").alias("y"), F.col("shingles").alias("sy"))
    return spread_join(spread_join(pairs, left, ["x"], heavy["x"]), right, ["y"], heavy["y"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, broadcast_rows: int) -> DataFrame:
    """Of pairs (x, y), those that are linked. Each pair is held against both full sets."""
    n = F.size(F.array_intersect("sx", "sy"))
    return _with_sets(pairs, sets, broadcast_rows).where(100 * n >= percent * (F.size("sx") + F.size("sy") - n)).select("x", "y")


def _left_over(open_: DataFrame, heavy: Heavy, full: DataFrame, percent: int, block: int, broadcast_rows: int) -> DataFrame:
    """The links (x, y) between classes of different roots that meet in a table. open_: t1, t2, id, r, root; heavy: its tables.

    A table's head is its class with fewest shingles of its own. Every class is held against the heads of its tables. For the
    classes of one head the reference is the set of what most of them have, and a class's difference is what of the reference
    and its own set isn't in both. With sizes n and d of set and difference, let w = (100 + percent) * d - (100 - percent) * n.
    Then two classes are linked if and only if their differences share at least (w + w') / (200 + 2 * percent). Those for which
    w and the head's least w are not above 0 together are linked with the class of that least w. In any other pair there is one
    that isn't among them, so the two must share part of their differences. Hence pairs are listed only where both have one of
    their rarest differences in common, so early in both orders that enough can follow: a group of variants of one text lists
    few, whatever its size.
    """
    table, more, less = ["t1", "t2"], 100 + percent, 100 - percent
    heads = open_.groupBy(*table).agg(F.min(F.struct("r", "id")).alias("m")).select(*table, F.col("m.id").alias("y"))
    held = spread_join(open_.select(*table, "root", F.col("id").alias("x")), heads, table, heavy).where("x != y").select("x", "y", "root").distinct()
    other = lambda a, b: F.concat(F.array_except(a, b), F.array_except(b, a))
    held = _with_sets(held, full, broadcast_rows).select("x", "y", "root", F.size("sx").alias("n"), F.size("sy").alias("m"), other("sx", "sy").alias("differ"))
    held, _ = settle(held, "near-differences")
    found = held.where(more * F.size("differ") <= less * (F.col("n") + F.col("m"))).select("x", "y")

    # from the head to the reference: what most classes have otherwise than the head
    counts = held.groupBy("y").agg(F.count(F.lit(1)).alias("g"))
    heavy_heads, _ = heavy_keys(counts, ["y"], "g")
    often = held.select("y", F.explode("differ").alias("s")).groupBy("y", "s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    often = spread_join(often, counts, ["y"], heavy_heads).withColumn("most", 2 * F.col("c") > F.col("g"))
    often, _ = settle(often.select("y", "s", "most", F.when(F.col("most"), F.col("g") - F.col("c")).otherwise(F.col("c")).alias("c")), "near-often")
    turned = counts.select("y").join(often.where("most").groupBy("y").agg(F.collect_list("s").alias("turned")), "y", "left")
    held = spread_join(held, turned.withColumn("turned", F.coalesce("turned", F.array().cast("array<long>"))), ["y"], heavy_heads)
    held = held.select("x", "y", "root", "n", other("differ", "turned").alias("differ")).withColumn("d", F.size("differ"))
    held, _ = settle(held.withColumn("w", (more * F.col("d") - less * F.col("n")).cast("long")), "near-differences")
    low = held.groupBy("y").agg(F.min("w").alias("low"), F.min_by("x", "w").alias("lowest"))
    held = spread_join(held, low, ["y"], heavy_heads).withColumn("near", F.col("w") + F.col("low") <= 0)
    found = found.unionByName(held.where(F.col("near") & (F.col("x") != F.col("lowest"))).select("x", F.col("lowest").alias("y")))
    far = held.where("not near").groupBy("y").agg(F.min("w").alias("far"))

    # a difference that no other class of the head has is shared with none; the others follow, the rarest first
    row = ["x", "y", "root", "d", "w", "near", "low", "far"]
    each = spread_join(held, far, ["y"], heavy_heads).select(*row, F.explode("differ").alias("s"))
    often = often.where("c > 1").select("y", "s", "c")
    each = spread_join(each, often, ["y", "s"], heavy_keys(often, ["y", "s"], "c")[0])
    each = each.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("order"))
    # with the least that can be shared with a class that isn't near, and with any, the last place of a first one
    last = lambda w: F.col("d") - F.greatest(F.lit(1), F.ceil((F.col("w") + F.col(w)) / (2 * more)))
    each = each.select(*row, (F.col("d") - F.size("order")).alias("own"), F.posexplode("order").alias("at", "e"))
    each = each.withColumn("at", F.col("own") + F.col("at")).withColumn("early", F.col("at") <= last("far"))
    each = each.where(F.col("early") | (~F.col("near") & (F.col("at") <= last("low"))))
    each, _ = settle(each.select("x", "y", "root", "w", "near", F.col("e.s").alias("s"), (F.col("d") - F.col("at")).alias("rest"), "early"), "near-early")

    sizes = each.groupBy("y", "s").agg(F.count_if("early").alias("a"), F.count_if(~F.col("near")).alias("b")).withColumn("pairs", F.col("a") * F.col("b")).where("pairs > 0")
    sizes, _ = settle(sizes, "near-sizes")
    heavy, listed = heavy_keys(sizes, ["y", "s"], "pairs")
    blocks = max(1, int(listed // block) + 1)
    side = lambda part, k: part.select("y", "s", *(F.col(c).alias(f"{c}{k}") for c in ("x", "root", "w", "near", "rest", "early")))
    enough = 2 * more * F.least("rest1", "rest2") >= F.col("w1") + F.col("w2")
    once = F.col("near1") | (F.col("early2") & (F.col("x1") < F.col("x2")))
    for k in range(blocks):
        part = each.where(F.pmod("s", F.lit(blocks)) == k)
        pairs = spread_join(side(part.where("early"), 1), side(part.where("not near"), 2), ["y", "s"], heavy).where((F.col("root1") != F.col("root2")) & once & enough)
        pairs = pairs.select(F.greatest("x1", "x2").alias("x"), F.least("x1", "x2").alias("y")).distinct()
        more_found, _ = settle(_verified(pairs, full, percent, broadcast_rows), "near-links")
        found = found.unionByName(more_found)
    return found


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(id, root) of every id in edges (x, y): large-star and small-star steps until nothing changes."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = e.select(F.col("x").alias("u"), F.col("y").alias("v"))
        if large:
            around = around.union(e.select(F.col("y").alias("u"), F.col("x").alias("v")))
        else:
            around = around.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = around.join(least, "u")
        if large:
            return joined.where("v > u and v != m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        return joined.select(F.explode(F.array(F.struct(F.col("v").alias("x"), F.col("m").alias("y")), F.struct(F.col("u").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").where("x != y").distinct()

    spark = edges.sparkSession
    edges, at = settle(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x != y").distinct(), name)
    mark = None
    while True:
        edges, new = settle(star(star(edges, True), False), name)
        drop(spark, at)
        at = new
        # a star forest: every x has one y, and no y is an x
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)"))).first()
        if now == mark:
            return edges.select(F.col("x").alias("id"), F.col("y").alias("root"))
        mark = now


def near_groups(docs: DataFrame, percent: int = PERCENT, bands: int | None = None, width: int = WIDTH, block: int = 2_000_000, broadcast_rows: int = 500_000) -> DataFrame:
    """KEY, doc_id, n_shingles, component_id and kept of every row of docs.

    block bounds the pairs that are listed at a time once rounds no longer help.
    """
    spark = docs.sparkSession
    bands = bands or bands_for(percent, width)
    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *KEY)
    sets, _ = settle(_sets(rows, bands, width), "near-sets")

    # classes of equal sets; the least row names a class, and its number orders classes by doc_id
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), *KEY)
    classes = sets.where("n_shingles > 0").groupBy("id", "n_shingles").agg(F.min(F.struct(first.alias("first"), F.col("a"), F.col("b"))).alias("m"))
    classes, _ = settle(classes.select("id", "n_shingles", "m.first", "m.a", "m.b"), "near-classes")

    # a table key meets only where both its halves do: halves that are alone go before pairs are formed. A class finds out by
    # its number which of its halves are alone, so the halves of a class go through shuffles one by one, without the others
    number = [F.col(f"first.{c}").alias(c) for c in KEY]
    alone = classes.select(*number, F.posexplode("a").alias("i", "ka")).groupBy("i", "ka").agg(F.count(F.lit(1)).alias("c"), *(F.bit_xor(c).alias(c) for c in KEY)).where("c = 1")
    alone = alone.groupBy(*KEY).agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("alone"))
    met = classes.select("id", "n_shingles", "a", "b", *number).join(alone, KEY, "left").withColumn("alone", F.coalesce("alone", F.lit(0).cast("long")))
    met, at_met = settle(met.where(F.col("alone") != (1 << bands) - 1).drop(*KEY), "near-halves")
    half = met.select("id", F.col("n_shingles").alias("n"), "alone", "b", F.posexplode("a").alias("i", "ka")).where(F.expr("(shiftright(alone, i) & 1L) = 0"))
    keys = half.select("id", "n", "i", "ka", F.posexplode("b").alias("j", "kb"))
    keys = keys.select("id", "n", "i", "j", F.xxhash64("i", "ka", "j", "kb").alias("t1"), F.hash("i", "ka", "j", "kb").alias("t2"))
    table = ["t1", "t2"]
    shared, _ = settle(keys.groupBy(*table).agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-shared")
    heavy, _ = heavy_keys(shared, table, "c")
    tables, at_tables = settle(spread_join(keys, shared.drop("c"), table, heavy), "near-tables")
    drop(spark, at_met)

    wanted = tables.select("id").distinct()
    wanted = wanted.join(classes.select("id", "first"), "id").select("id", F.monotonically_increasing_id().alias("num"), *number)
    wanted, _ = settle(wanted, "near-wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    full, _ = settle(_shingle_rows(rows.join(chosen, KEY).select("id", "num", "text")), "near-full")

    # a shingle that no other candidate has lies in no intersection: with r of them, at most min(n - r, n' - r') are shared
    lone = full.select("num", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.bit_xor("num").alias("num")).where("c = 1")
    own = full.select("id", "num", F.size("shingles").alias("n")).join(lone.groupBy("num").agg(F.count(F.lit(1)).alias("r")), "num", "left").select("id", "n", F.coalesce("r", F.lit(0)).alias("r"))
    own = own.where(100 * (F.col("n") - F.col("r")) >= percent * F.col("n")).drop("n")
    tables, new = settle(tables.join(own, "id"), "near-pruned")
    drop(spark, at_tables)

    def fits(n, r, m, q):
        most = F.least(F.col(n) - F.col(r), F.col(m) - F.col(q))
        return 100 * most >= percent * (F.col(n) + F.col(m) - most)

    roots = None  # (id, root) of the classes joined so far
    links = None
    open_, turn, before = tables.withColumn("root", F.col("id")), 0, None
    while True:
        # tables in which more than one component is left; the centre is first the class with fewest shingles of its own
        first_of = F.col("r").cast("long") if turn == 0 else F.xxhash64("id", F.lit(turn))
        mixed = open_.groupBy("t1", "t2").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct(first_of.alias("h"), "id", "n", "r", "root")).alias("centre"), F.count(F.lit(1)).alias("c")).where("lo != hi")
        mixed, _ = settle(mixed, "near-mixed")
        heavy, left = heavy_keys(mixed, table, "c")
        open_, _ = settle(spread_join(open_, mixed.select(*table, "centre"), table, heavy), "near-open")
        if not left or (before is not None and left > 0.5 * before):
            break
        before = left
        # one pair for each class: the centre of one of its tables
        pairs = open_.where(F.col("root") != F.col("centre.root")).where(fits("n", "r", "centre.n", "centre.r")).groupBy("id").agg(F.min(F.struct(F.col("centre.h").alias("h"), F.col("centre.id").alias("y"))).alias("m"))
        pairs = pairs.select(F.col("id").alias("x"), F.col("m.y").alias("y"))
        found, _ = settle(_verified(pairs, full, percent, broadcast_rows), "near-links")
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        open_ = open_.drop("root", "centre").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        turn += 1

    if left:
        found = _left_over(open_.drop("centre"), heavy, full, percent, block, broadcast_rows)
        links = found if links is None else links.unionByName(found)
        roots = components(links)

    named = classes.select("id", "first")
    if roots is not None:
        named = named.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        least = named.groupBy("root").agg(F.min("first").alias("least"))
        named = named.join(least, "root")
    else:
        named = named.withColumn("least", F.col("first"))
    out = sets.select(*KEY, "doc_id", "n_shingles", "id").join(named.select("id", "least"), "id", "left")
    alone = F.col("n_shingles") == 0
    lone = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), *KEY)
    out = out.withColumn("least", F.when(alone, lone).otherwise(F.col("least")))
    return out.select(
        *KEY, "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("least.doc_id"), F.lit(False)).alias("kept"),
        ((F.col(f"least.{FILE}") == F.col(FILE)) & (F.col(f"least.{ROW}") == F.col(ROW))).alias("stays"),
    )


def near_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return near_groups(docs, PERCENT).select("doc_id", "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame, percent: int = STAGE_PERCENT) -> DataFrame:
    """docs with one row of each component of rows linked at percent."""
    docs, named = guarded(docs)
    rows = keyed(docs)
    gone = near_groups(rows, percent).where(~F.col("stays")).select(*KEY)
    return named(rows.join(gone, KEY, "left_anti").select(*docs.columns))
