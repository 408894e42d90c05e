"""Best-fit packing of token sequences, planned by linear grouping on the histogram of lengths.

A document is its tokens and an end id; only one longer than a sequence is cut, into whole sequences behind a shorter first
piece. The number of pieces of each length (at most `size` numbers, however large the corpus) is all that the plan needs:

1. Lengths above size/4 count as large. In order of length they fall into groups of equal cardinality, and each is rounded up
   to its group's largest, so that few sizes remain. Lengths over half a sequence need no partner of their own group to be
   optimal, so the groups follow the pieces' number.
2. Over the few rounded sizes, configurations (multisets that fit a sequence) are generated by pricing: a covering linear
   programme is solved by the simplex method, a knapsack finds the next column, and the solution is rounded down; what is
   left over goes by best fit.
3. Actual lengths take the places of the rounded ones: a place takes the longest piece left that its group's size allows, the
   last place of a sequence the longest that fits what the others leave.
4. Small pieces, longest first, go where they fit best; sequences are opened only when no place is left.

Several group numbers are tried and the plan with fewest sequences is used. Pieces of a whole sequence are sequences by
themselves and need no rank. The others get their places by rank within (length, salt); a length that holds many
pieces, or over a thousandth of all, is split by as many salts as that needs, so a group stays small whatever the corpus.

Defined cases: a null text counts as empty and is one piece, the end id alone. Repeated rows are packed each. An empty table
gives no rows. Equal ids are told apart by their row.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .bpe import ByteBpe
from .common import KEY, SHARES, keyed, settle

SIZE = 2048
END = 0
#: Pieces of one length that a group of ranks holds, about.
PER_SALT = 1 << 18
GROUPS = (12, 24, 36)


# ---- the plan, on counts of lengths ----


class Bins:
    """Sequences under construction: kinds of content with a count, by free room."""

    def __init__(self, size: int):
        self.size = size
        self.by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]  # (count, lengths)

    def open(self, count: int, content: tuple[int, ...]) -> None:
        if count:
            self.by_room[self.size - sum(content)].append((count, content))

    def best_fit(self, length: int, count: int) -> None:
        """Put count pieces of a length where they leave least room."""
        room = length
        while count:
            while room <= self.size and not self.by_room[room]:
                room += 1
            if room > self.size:
                per = self.size // length
                self.open(count // per, (length,) * per)
                self.open(1 if count % per else 0, (length,) * (count % per))
                return
            n, content = self.by_room[room].pop()
            per = min(room // length, count)
            take = min(n, count // per)
            if take < n:
                self.by_room[room].append((n - take, content))
            self.open(take, content + (length,) * per)
            count -= take * per

    def kinds(self) -> list[tuple[int, tuple[int, ...]]]:
        return [x for room in self.by_room for x in room]

    def number(self) -> int:
        return sum(n for n, _ in self.kinds())


def best_fit_decreasing(counts: dict[int, int], size: int) -> Bins:
    bins = Bins(size)
    for length in sorted(counts, reverse=True):
        bins.best_fit(length, counts[length])
    return bins


def _knapsack(values: np.ndarray, sizes: list[int], size: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within size."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(min(sizes), size + 1):
        best[room], last[room] = best[room - 1], -1
        for k, s in enumerate(sizes):
            if s <= room and best[room - s] + values[k] > best[room] + 1e-12:
                best[room], last[room] = best[room - s] + values[k], k
    taken, room = np.zeros(len(sizes), int), size
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            taken[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[size]), taken


def configurations(sizes: list[int], need: np.ndarray, size: int, rounds: int = 200) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each size) from column generation on the covering programme; rounded down."""
    k = len(sizes)
    columns = np.diag([float(size // s) for s in sizes])
    basis_x = need / np.diag(columns)
    for _ in range(rounds):
        prices = np.linalg.solve(columns.T, np.ones(k))
        value, new = _knapsack(np.maximum(prices, 0), sizes, size)
        if value <= 1 + 1e-9:
            break
        direction = np.linalg.solve(columns, new.astype(float))
        up = direction > 1e-12
        if not up.any():
            break
        ratio = np.where(up, basis_x / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis_x = basis_x - ratio[out] * direction
        basis_x[out] = ratio[out]
        columns[:, out] = new
    return [(int(x + 1e-9), columns[:, j].astype(int)) for j, x in enumerate(basis_x) if x >= 1]


class _Longest:
    """Large pieces that are left, by length."""

    def __init__(self, counts: dict[int, int], lengths: list[int]):
        self.left = {n: counts[n] for n in lengths}
        self.order = sorted(lengths)

    def up_to(self, room: int, taken: list[int]) -> int:
        k = bisect.bisect_right(self.order, room) - 1
        while k >= 0 and self.left[self.order[k]] <= taken.count(self.order[k]):
            if not self.left[self.order[k]]:
                del self.order[k]
            k -= 1
        return self.order[k] if k >= 0 else 0


def linear_grouping(counts: dict[int, int], size: int, groups: int = 24) -> Bins:
    """Large lengths by rounded groups and configurations, then the small ones by best fit."""
    large = sorted((n for n in counts if n > size // 4), reverse=True)
    total = sum(counts[n] for n in large)
    bins, left = Bins(size), dict(counts)
    if total:
        per, members, at = -(-total // groups), [], 0
        for n in large:  # a length that several groups share is split among them
            rest = counts[n]
            while rest:
                if at % per == 0:
                    members.append({})
                put = min(rest, per - at % per)
                members[-1][n] = members[-1].get(n, 0) + put
                at, rest = at + put, rest - put
        need_of: Counter[int] = Counter()
        for m in members:
            need_of[max(m)] += sum(m.values())
        sizes = sorted(need_of, reverse=True)
        longest = _Longest(counts, large)
        for times, shape in configurations(sizes, np.array([need_of[s] for s in sizes], float), size):
            rooms = [s for s, c in zip(sizes, shape) for _ in range(c)]
            while times:
                # substitute actual lengths: a place takes the longest left of its group or below, the last place the
                # longest that fits what the others leave
                content: list[int] = []
                for k, s in enumerate(rooms):
                    n = longest.up_to(size - sum(content) if k == len(rooms) - 1 else s, content)
                    if n:
                        content.append(n)
                if not content:
                    break
                used = Counter(content)
                some = min(times, *(longest.left[n] // c for n, c in used.items()))
                for n, c in used.items():
                    longest.left[n] -= some * c
                    left[n] -= some * c
                bins.open(some, tuple(sorted(content, reverse=True)))
                times -= some
    for length in sorted(left, reverse=True):
        if left[length]:
            bins.best_fit(length, left[length])
    return bins


def plan(counts: dict[int, int], size: int) -> Bins:
    whole = counts.get(size, 0)
    rest = {n: c for n, c in counts.items() if c and n < size}
    best = min((linear_grouping(rest, size, g) for g in GROUPS), key=Bins.number) if rest else Bins(size)
    best.open(whole, (size,))
    return best


def places(bins: Bins) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): consecutive ranks take consecutive sequences."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for count, content in bins.kinds():
        offset = 0
        for n in content:
            out.setdefault(n, []).append((given.get(n, 0), sequence, offset))
            given[n] = given.get(n, 0) + count
            offset += n
        sequence += count
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


# ---- the pieces ----

PIECES = "doc_id long, _rsd_file long, _rsd_row long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece of each document, with the CRC-32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(vocabulary)
        for batch in batches:
            names, rows = batch["doc_id"], []
            for k, text in enumerate(batch["text"].to_pylist()):
                own = np.append(bpe.ids(text), np.uint32(end)).astype("<u4")
                head, i, p = len(own) % size, 0, 0
                while i < len(own):
                    to = i + (head if p == 0 and head else size)
                    rows.append((k, p, i, to - i, zlib.crc32(own[i:to].tobytes())))
                    i, p = to, p + 1
            own, p, i, n, crc = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            own = pa.array(own)
            yield pa.RecordBatch.from_arrays([names.take(own), *(batch[c].take(own) for c in KEY), pa.array(p, pa.int32()), pa.array(i), pa.array(n), pa.array(crc)], names=["doc_id", *KEY, "piece", "start", "length", "ids_crc32"])
        tk.release()

    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *KEY)
    return rows.mapInArrow(run, PIECES)


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, per_salt: int = PER_SALT) -> DataFrame:
    """Every piece with its sequence_id and offset. Planned sequences count from 0, those of one whole piece down from -1."""
    spark = docs.sparkSession
    pieces, _ = settle(cut(docs, vocabulary, size, end), "pack-pieces")
    whole = pieces.where(F.col("length") == size).drop(*KEY)
    whole = whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < size)
    # at most `size` rows
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    if not counts:
        return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    where = places(plan(counts, size))
    salts, total = np.zeros(size + 1, np.int64), sum(counts.values())
    for n, c in counts.items():
        salts[n] = 1 + max(c // per_salt, c * SHARES // total)
    first = np.cumsum(salts) - salts
    each = F.broadcast(spark.createDataFrame([(n, int(salts[n]), int(first[n])) for n in counts], "length long, salts long, first long"))
    salted = short.join(each, "length").withColumn("salt", F.col("first") + F.pmod(F.xxhash64(*KEY, "piece"), F.col("salts"))).drop("salts", "first")
    # a row for each length, another for each per_salt pieces and SHARES more at most; salts are numbered through all lengths
    counted = salted.groupBy("salt").count().toArrow()
    held = np.zeros(int(salts.sum()), np.int64)
    held[counted["salt"].to_numpy()] = counted["count"].to_numpy()
    before = np.append(0, np.cumsum(held))
    base = before[:-1] - before[np.repeat(first, salts)]

    ranked = salted.withColumn("rank", F.expr(f"row_number() over (partition by length, salt order by {', '.join(KEY)}, piece) - 1").cast("long"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            rank = rank + base[batch["salt"].to_numpy()]
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                runs = where[int(length[own[0]])]
                at = np.searchsorted(runs[:, 0], rank[own], side="right") - 1
                sequence[own] = runs[at, 1] + rank[own] - runs[at, 0]
                offset[own] = runs[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(put, PLACED).unionByName(whole)
