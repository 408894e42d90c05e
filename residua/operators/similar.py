"""Similar sets of grams: each set packed into bytes, and all sets of a group compared as matrices in a task.

Three residues make 8000 grams, so the set of a chain is 1000 bytes of bits, however long the chain is. Sets with grams of other
letters are sorted lists. A group is one part of a bucket, or two, and a part has a size bound, so a task holds little, the
comparisons are spread, and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residua import constants as C

K = 3
LETTERS = "".join(r[0] for r in C.RESIDUES)
GRAMS = len(LETTERS) ** K
_PLACE = np.full(256, len(LETTERS), np.int64)
_PLACE[list(LETTERS.encode())] = np.arange(len(LETTERS))
_POINTS = np.array([ord(c) for c in LETTERS], np.int64)
_TRIPLES = np.stack(np.unravel_index(np.arange(GRAMS), (len(LETTERS),) * K), axis=1)
BITS, LIST = b"\1", b"\0"
#: Sets and grams of a matrix, and pairs of a batch that comes out.
BLOCK, WIDTH, PAIRS = 1024, 8192, 500_000
#: A set's weight is its bytes, and this at least. A part holds a share of all, within the bounds.
LEAST, SHARES, PART_BYTES = 1000, 250, (1 << 20, 8 << 20)


def _numbers(points: np.ndarray) -> np.ndarray:
    """The number of each gram of three code points, the points in the last axis."""
    return (points[..., 0] << 42) | (points[..., 1] << 21) | points[..., 2]


_NUMBERS = _numbers(_POINTS[_TRIPLES])


def packed(seq: str, bits: bool = True) -> bytes:
    """The set of the grams of a sequence of K letters at least: equal sets have equal bytes."""
    if bits and seq.isascii():
        at = _PLACE[np.frombuffer(seq.encode(), np.uint8)]
        if at.max() < len(LETTERS):
            seen = np.zeros(GRAMS, bool)
            seen[(at[:-2] * len(LETTERS) + at[1:-1]) * len(LETTERS) + at[2:]] = True
            return BITS + np.packbits(seen).tobytes()
    points = np.frombuffer(seq.encode("utf-32-le"), np.uint32).astype(np.int64)
    return LIST + np.unique(_numbers(np.stack([points[:-2], points[1:-1], points[2:]], axis=1))).tobytes()


def gram_sets(seqs: DataFrame, id_: str, bits: bool) -> DataFrame:
    """id, bucket, len and grams, the packed set, of the sequences that have one."""
    rows = seqs.where(F.col(id_).isNotNull() & F.col("len").isNotNull() & (F.length("seq") >= K))
    rows = rows.select(F.col(id_).alias("id"), F.expr("len div 5").alias("bucket"), "len", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = pa.array([packed(s.as_py(), bits) for s in b.column("seq")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "bucket", "len")), grams], ["id", "bucket", "len", "grams"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, bucket {kinds['bucket']}, len {kinds['len']}, grams binary")


def in_parts(sets: DataFrame, bounds: tuple[int, int] = PART_BYTES) -> DataFrame:
    """sets with part, i and j: a row for each group, of parts i and j <= i of its bucket, that the set belongs to.

    Buckets of over one part are SHARES at most, or as many as all sets have parts of the upper bound.
    """
    weights = sets.groupBy("bucket").agg(F.sum(F.greatest(F.length("grams"), F.lit(LEAST))).alias("w"))
    share = min(max((weights.agg(F.sum("w")).first()[0] or 0) // SHARES, bounds[0]), bounds[1])
    heavy = weights.where(F.col("w") > share).select("bucket", F.ceil(F.col("w") / share).cast("int").alias("parts"))
    rows = sets.join(F.broadcast(heavy), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("bucket", F.greatest("part", "other").alias("i"), F.least("part", "other").alias("j"), "part", "id", "len", "grams")


def _numbered(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the sets' grams, and whose they are."""
    each = [_NUMBERS[np.unpackbits(np.frombuffer(s, np.uint8, offset=1)).view(bool)] if s[:1] == BITS else np.frombuffer(s[1:], np.int64) for s in sets]
    return np.concatenate(each), np.repeat(np.arange(len(sets)), [len(e) for e in each])


def _bits(sets: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(sets), np.uint8).reshape(len(sets), -1)
    return np.unpackbits(rows[:, 1:], axis=1).astype(np.float32)


class Block:
    """Up to BLOCK distinct sets, with the number of grams of each."""

    def __init__(self, sets: list[bytes]):
        self.plain = all(s[:1] == BITS for s in sets)
        if self.plain:
            self.matrix = _bits(sets)
            self.size = self.matrix.sum(axis=1, dtype=np.float64)
        else:
            self.grams, self.row = _numbered(sets)
            self.size = np.bincount(self.row, minlength=len(sets)).astype(float)
        self.sets = sets

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        return _numbered(self.sets) if self.plain else (self.grams, self.row)

    def shared(self, other: Block) -> np.ndarray:
        """How many grams each set has in common with each of the other block's; whole numbers, exact in 32 bits below 2 ** 24."""
        if self.plain and other.plain:
            return self.matrix @ other.matrix.T
        (g, r), (h, s) = self.numbered(), other.numbered()
        both = np.intersect1d(g, h)
        out = np.zeros((len(self.sets), len(other.sets)), np.float32)
        for lo in range(0, len(both), WIDTH):
            some = both[lo : lo + WIDTH]
            out += _matrix(g, r, some, len(self.sets)) @ _matrix(h, s, some, len(other.sets)).T
        return out


def _matrix(grams: np.ndarray, row: np.ndarray, some: np.ndarray, n: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(some, grams), len(some) - 1)
    met = some[at] == grams
    out = np.zeros((n, len(some)), np.float32)
    out[row[met], at[met]] = 1
    return out


class Side:
    """Rows of a part by distinct set: rows[first[u]:first[u] + n[u]] are those of set u."""

    def __init__(self, at: np.ndarray, grams: pa.Array):
        code = grams.take(pa.array(at)).dictionary_encode()
        of = code.indices.to_numpy()
        self.sets = code.dictionary
        self.rows = at[np.argsort(of, kind="stable")]
        self.n = np.bincount(of, minlength=len(self.sets))
        self.first = np.cumsum(self.n) - self.n

    def blocks(self, start: int = 0) -> Iterator[tuple[int, Block]]:
        for lo in range(start, len(self.sets), BLOCK):
            yield lo, Block(self.sets[lo : lo + BLOCK].to_pylist())

    def members(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of each of the sets in turn, and the place in sets that each belongs to."""
        n = self.n[sets]
        of = np.repeat(np.arange(len(sets)), n)
        return self.rows[np.arange(len(of)) + np.repeat(self.first[sets] - np.cumsum(n) + n, n)], of


def _alike(a: Side, b: Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sets of a and b, and their Jaccard similarity where it reaches the threshold; within one side each pair once, and each set with itself."""
    for lo, x in a.blocks():
        for at, y in [(lo, x)] if a is b else []:
            yield from _block(lo, x, at, y, threshold, True)
        for at, y in b.blocks(lo + BLOCK if a is b else 0):
            yield from _block(lo, x, at, y, threshold, False)


def _block(lo: int, x: Block, at: int, y: Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    both = x.shared(y).astype(np.float64)
    jaccard = both / (x.size[:, None] + y.size[None, :] - both)
    u, v = np.nonzero(np.triu(jaccard >= threshold) if same else jaccard >= threshold)
    if len(u):
        yield lo + u, at + v, jaccard[u, v]


def similar_rows(threshold: float, coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs x, y, jaccard of one group of in_parts()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        if len(t) < 2:
            return
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        part, n, ids = t["part"].to_numpy(), t["len"].to_numpy(), t["id"].combine_chunks()
        grams = t["grams"].combine_chunks()
        a = Side(np.flatnonzero(part == i), grams)
        b = a if i == j else Side(np.flatnonzero(part == j), grams)
        for u, v, jaccard in _alike(a, b, threshold):
            x, of = a.members(u)
            ends = np.cumsum(b.n[v[of]])
            lo = 0
            while lo < len(x):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
                y, within = b.members(v[of[lo:hi]])
                own, k = x[lo:hi][within], of[lo:hi][within]
                least, most = np.minimum(n[own], n[y]), np.maximum(n[own], n[y])
                ok = (least / most >= coverage) & ((u[k] != v[k]) | (own < y) if a is b else True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own[ok])), ids.take(pa.array(y[ok])), pa.array(jaccard[k[ok]])], ["x", "y", "jaccard"])
                lo = hi

    return run


def similar_pairs(sets: DataFrame, threshold: float, coverage: float, bounds: tuple[int, int] = PART_BYTES) -> DataFrame:
    """id1 < id2 and jaccard, unrounded, of the rows of gram_sets() in one bucket that reach the thresholds."""
    kind = dict(sets.dtypes)["id"]
    pairs = in_parts(sets, bounds).groupBy("bucket", "i", "j").applyInArrow(similar_rows(threshold, coverage), f"x {kind}, y {kind}, jaccard double")
    return pairs.where("x != y").select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), "jaccard")
