"""Repeated-substring dedup with sharded suffix arrays.

Every byte that lies in a string of `gram` bytes which also starts anywhere else, in any text, is removed; strings never cross
the ends of a text and are judged on the input.

1. Anchors. Each window of `gram` bytes picks its least `anchor`-byte hash (ties: the leftmost). Equal windows pick the same
   anchor at the same place, so equal windows meet under one anchor hash. Consecutive windows with one anchor form a context:
   the bytes that those windows cover. Anchor hashes that occur once can't lie in a repeat, and go.
2. Classes. Contexts that are equal by a 128-bit BLAKE2b digest of their bytes form a class; with two members all their windows
   repeat. Where an anchor has several classes, one context of each goes on.
3. Shards. Contexts are dealt out by anchor hash; a shard joins them with a separator into one text, whose suffix array is
   built by induced sorting: suffixes are classified, the leftmost-smaller (LMS) substrings sorted by induction and named, the
   reduced text is sorted recursively, and its order induces the shard's array. Permuted common prefixes come from the
   predecessors in that array: only irreducible ones are compared, the others are one less than their left neighbour's. A
   window repeats if it shares `gram` bytes with a neighbour in the array.
4. An anchor whose contexts would overfill a shard is split by more context: its windows fall into ranges by the place of the
   anchor in them, and the windows of a range have more bytes in common than the anchor, by which they are dealt out anew, as
   in 2 and 3. The ranges of WIDTHS narrow down to one window, which is a class by itself, so any number of contexts is settled
   in shards of bounded size.

Induction works bucket by bucket on whole arrays, so NumPy does in bulk what the scan does one by one; a reduced text whose
alphabet is about as large as itself is ranked by doubling, as buckets of one entry gain nothing.

Defined cases: null texts count as empty; texts shorter than `gram` are kept whole. Repeated rows repeat each other, whatever
their doc_id. An empty table gives no rows. A very long text is hashed whole, in arrays of its own length; its contexts are dealt
out like any others. Other columns, whatever their names, pass through. Removal works on bytes; where a text is needed again, bytes of a character that was cut in two are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import FILE, KEY, ROW, drop, guarded, heavy_keys, keyed, settle, spread_join

U = np.uint64
GRAM, ANCHOR, SHARD_BYTES = 200, 50, 1 << 20
#: Bytes of contexts that a task cuts at a time.
BATCH_BYTES = 4 << 20
#: Places of the anchor that a range of windows spans, where an anchor is split.
WIDTHS = (38, 10, 1)
_STEP, _MASK = 1 << 20, U((1 << 21) - 1)


# ---- the suffix array of a shard ----


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S-type); t ends with a least, single symbol."""
    rise = np.sign(t[1:].astype(np.int32) - t[:-1]).astype(np.int8)
    at = np.arange(len(rise), dtype=np.int32)
    at[rise == 0] = len(rise)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(rise[np.minimum(at, len(rise) - 1)] > 0, True)


def _deal(buckets: list[list[np.ndarray]], at: np.ndarray, symbol: np.ndarray) -> None:
    if len(at):
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for k, part in zip(symbol[np.append(0, cuts)].tolist(), np.split(at, cuts)):
            buckets[k].append(part)


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in the order that the given order of the LMS suffixes induces."""
    none = np.zeros(0, np.int32)
    cuts = np.searchsorted(t[lms], np.arange(symbols + 1))

    def spread(own: np.ndarray, c: int, want: bool, into: list[list[np.ndarray]]) -> np.ndarray:
        """Deal out the left neighbours of the wanted type; returns those that stay in bucket c."""
        left = own[own > 0] - 1
        left = left[s_type[left] == want]
        symbol = t[left]
        stay = symbol == c
        _deal(into, left[~stay], symbol[~stay])
        return left[stay]

    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols):
        turn = np.concatenate(larger[c]) if larger[c] else none
        larger[c] = []
        while len(turn):
            larger[c].append(turn)
            turn = spread(turn, c, False, larger)
        spread(lms[cuts[c] : cuts[c + 1]], c, False, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols - 1, -1, -1):
        turn = np.concatenate(smaller[c]) if smaller[c] else none
        smaller[c] = []
        while len(turn):
            smaller[c].append(turn)
            turn = spread(turn, c, True, smaller)
        for part in reversed(larger[c]):
            spread(part[::-1], c, True, smaller)
    last = np.array([len(t) - 1], np.int32)
    return np.concatenate([last, *(p for c in range(symbols) for p in (*larger[c], *(x[::-1] for x in reversed(smaller[c]))))])


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only what is still tied is sorted again."""
    n = len(names)
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    first = np.searchsorted(rank[order], rank[order])
    rank[order] = first  # a rank is the first place of its group
    step = 1
    sizes = np.bincount(rank, minlength=n)
    tied = order[sizes[rank[order]] > 1]
    while len(tied):
        ahead = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        key = rank[tied] * np.int64(n + 1) + ahead
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        group = rank[tied]
        new_group = np.append(True, group[1:] != group[:-1])
        new_key = np.append(True, key[1:] != key[:-1])
        i = np.arange(len(tied))
        start = np.maximum.accumulate(np.where(new_group, i, 0))
        inner = np.maximum.accumulate(np.where(new_key, i, 0))
        rank[tied] = group + (inner - start)
        size = np.bincount(np.cumsum(new_key) - 1)
        tied = tied[size[np.cumsum(new_key) - 1] > 1]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def induced_sort(t: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of t, whose last symbol is a single 0 and the others are below `symbols`."""
    n = len(t)
    if n < 3:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    s_type = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    by_symbol = lms[np.argsort(t[lms], kind="stable")]
    order = _induce(t, s_type, by_symbol, symbols)
    order = order[is_lms[order]]
    # name the LMS substrings: equal ones share a name
    follow = np.zeros(n, np.int32)
    follow[lms] = np.append(lms[1:], n - 1)
    size = follow[order] - order + 1
    differ = np.append(True, size[1:] != size[:-1])
    open_, k = np.flatnonzero(~differ), 0
    while len(open_):
        wrong = t[order[open_] + k] != t[order[open_ - 1] + k]
        differ[open_[wrong]] = True
        k += 1
        open_ = open_[~wrong & (size[open_] > k)]
    names = np.zeros(n, np.int32)
    names[order] = np.cumsum(differ) - 1
    reduced, kinds = names[lms], int(differ.sum())
    if kinds < len(lms):
        order = lms[induced_sort(reduced, kinds) if kinds <= 1024 else _doubled(reduced)]
    return _induce(t, s_type, order, symbols)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Of bytes."""
    t = np.zeros(len(data) + 1, np.int16)
    t[:-1] = data
    t[:-1] += 1
    return induced_sort(t, 257)[1:]


def permuted_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the length it shares with the suffix before it in the array."""
    n = len(data)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    free = before >= 0
    left_differs = np.ones(n, bool)
    both = (at > 0) & (before > 0)
    left_differs[both] = data[at[both] - 1] != data[before[both] - 1]
    compare = np.flatnonzero(free & left_differs).astype(np.int32)
    words = np.zeros(n + 16, np.uint8)
    words[:n] = data
    words = np.lib.stride_tricks.as_strided(words, (n + 8, 8), (1, 1))
    # eight bytes at a time; past the end two different zero runs can agree, so lengths are held to the text below
    shared = np.zeros(n, np.int32)
    a, b, own, k = compare, before[compare], compare, 0
    while len(own):
        x, y = np.minimum(a + k, n), np.minimum(b + k, n)
        same = words[x] == words[y]
        all_same = same.all(axis=1)
        run = np.where(all_same, 8, np.argmin(same, axis=1))
        shared[own] += run
        keep = all_same & (x + 8 <= n) & (y + 8 <= n)
        a, b, own, k = a[keep], b[keep], own[keep], k + 8
    shared[compare] = np.minimum(shared[compare], n - np.maximum(compare, before[compare]))
    # a reducible position shares one byte less than its left neighbour
    anchor = np.where(free & ~left_differs, 0, at)
    source = np.maximum.accumulate(anchor)
    out = np.maximum(shared[source] - (at - source), 0)
    out[~free] = 0
    return out


def repeated_starts(texts: list[bytes], gram: int) -> list[np.ndarray]:
    """For each text, whether the gram that starts at each place also starts at another place of any of the texts."""
    data = np.frombuffer(b"\xff".join(texts), np.uint8)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(data):
        return [np.zeros(max(0, len(t) - gram + 1), bool) for t in texts]
    order = suffix_array(data)
    shared = permuted_prefixes(data, order)
    most = shared.copy()
    most[order[:-1]] = np.maximum(most[order[:-1]], shared[order[1:]])
    hit = most >= gram
    return [hit[a : a + max(0, len(t) - gram + 1)] for a, t in zip(bounds.tolist(), texts)]


# ---- anchors ----


def digests(parts) -> np.ndarray:
    """128 bits for each (number, bytes), as two longs."""
    made = (hashlib.blake2b(body, digest_size=16, salt=b"%d" % k).digest() for k, body in parts)
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


def contexts(data: np.ndarray, offsets: np.ndarray, gram: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, place of the anchor in the first window, anchor hash, digests) of the contexts of some texts."""
    n = np.maximum(np.diff(offsets) - gram + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    if not len(text):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.view(U), np.zeros((0, 2), np.int64)
    marks = tk.SpanHash(data).windows(anchor)
    width = gram - anchor + 1
    picked = np.empty(len(data) - gram + 1, np.int64)
    for s in range(0, len(picked), _STEP):
        own = marks[s : s + _STEP + width - 1]
        key = (own & ~_MASK) | np.arange(len(own), dtype=U)
        size = 1
        while size * 2 <= width:
            key, size = np.minimum(key[:-size], key[size:]), size * 2
        if size < width:
            key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
        picked[s : s + _STEP] = s + (key & _MASK).astype(np.int64)
    start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + offsets[:-1][text]
    mark = picked[start]
    new = np.append(True, (mark[1:] != mark[:-1]) | (text[1:] != text[:-1]))
    head = np.flatnonzero(new)
    lo, span, mark = start[head], np.diff(np.append(head, len(start))), mark[head]
    raw = memoryview(np.ascontiguousarray(data))
    named = digests(zip(mark - lo, (raw[a:b] for a, b in zip(lo.tolist(), (lo + span - 1 + gram).tolist()))))
    return text[head], lo - offsets[:-1][text[head]], span, mark - lo, marks[mark], named


_NAMED = "h long, c long, d long"
_PLACE = f"{FILE} long, {ROW} long, lo int, span short, mark short"


def _contexts_of(rows: DataFrame, gram: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in tk.slices(batch["text"]):
                text, lo, span, mark, h, cd = contexts(data, offsets, gram, anchor)
                own = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), *(pa.array(np.ascontiguousarray(cd[:, k])) for k in (0, 1)), *(batch[k].take(own) for k in KEY), pa.array(lo.astype(np.int32)), pa.array(span.astype(np.int16)), pa.array(mark.astype(np.int16))],
                    names=["h", "c", "d", *KEY, "lo", "span", "mark"],
                )
        tk.release()

    return rows.select("text", *KEY).mapInArrow(run, f"{_NAMED}, {_PLACE}")


def _parts_of(sizes: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` bytes; a larger one is alone."""
    ends, a = np.cumsum(sizes), 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _cut_contexts(rows: DataFrame, gram: int) -> DataFrame:
    """rows: text, KEY and wanted, an array of (h, c, d, lo, span, mark, n, classes)."""
    carried = ("h", "c", "d", "lo", "span", "mark", "n", "classes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch["wanted"]
            flat = wanted.flatten()
            own = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            lo, span = flat.field("lo").to_numpy(), flat.field("span").to_numpy()
            data, offsets = tk.text_bytes(batch["text"])
            start = offsets[own] + lo
            end = start + span + (gram - 1)
            for a, b in _parts_of(end - start):
                body = [data[x:y].tobytes() for x, y in zip(start[a:b].tolist(), end[a:b].tolist())]
                take = pa.array(own[a:b])
                yield pa.RecordBatch.from_arrays([*(flat.field(c).slice(a, b - a) for c in carried), *(batch[k].take(take) for k in KEY), pa.array(body, pa.binary())], names=[*carried, *KEY, "body"])
        tk.release()

    return rows.mapInArrow(run, f"{_NAMED}, lo int, span short, mark short, n long, classes long, {FILE} long, {ROW} long, body binary")


def _pieces(bodies: DataFrame, gram: int, anchor: int, width: int) -> DataFrame:
    """Bodies cut into the windows of each range of places of the anchor, named by what the windows of a range share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, cores, bodies = [], [], [], []
            for k, (body, span, mark, lo) in enumerate(zip(*(batch[c].to_pylist() for c in ("body", "span", "mark", "lo")))):
                for r in range((mark - span + 1) // width, mark // width + 1):
                    # the anchor is at least `least` and at most `most` bytes behind the start of the range's windows
                    least, most = r * width, min(r * width + width - 1, gram - anchor)
                    first, last = max(0, mark - most), min(span - 1, mark - least)
                    own.append(k)
                    rows.append((lo + first, last - first + 1, mark - first))
                    cores.append((least, body[mark - least : mark - most + gram]))
                    bodies.append((mark - first, body[first : last + gram]))
            h, cd = digests(cores)[:, 0], digests(bodies)
            lo, span, mark = np.array(rows, np.int64).reshape(-1, 3).T
            take = pa.array(np.array(own, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(x)) for x in (h, cd[:, 0], cd[:, 1])] + [*(batch[k].take(take) for k in KEY), pa.array(lo.astype(np.int32)), pa.array(span.astype(np.int16)), pa.array(mark.astype(np.int16)), batch["n"].take(take), pa.array([b for _, b in bodies], pa.binary())],
                names=["h", "c", "d", *KEY, "lo", "span", "mark", "n", "body"],
            )

    return bodies.mapInArrow(run, f"{_NAMED}, {_PLACE}, n long, body binary")


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_SPAN = f"{FILE} long, {ROW} long, lo long, hi long"


def _shard_runs(bodies: DataFrame, gram: int, shard_bytes: int) -> DataFrame:
    """Repeated runs of window starts in contexts that occur once; bodies come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def solve() -> pa.RecordBatch:
            out: list[tuple[int, int, int, int]] = []
            for row, hit in zip(held, repeated_starts([r[5] for r in held], gram)):
                if row[1] == 1:
                    out += [(row[2], row[3], row[4] + int(a), row[4] + int(b)) for a, b in zip(*_runs(hit))]
            cols = np.array(out, np.int64).reshape(-1, 4).T
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[*KEY, "lo", "hi"])

        size = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("h", "n", *KEY, "lo", "body"))):
                if size >= shard_bytes and row[0] != held[-1][0]:
                    yield solve()
                    held, size = [], 0
                held.append(row)
                size += len(row[5]) + 1
        if held:
            yield solve()
        tk.release()

    return bodies.mapInArrow(run, _SPAN)


def _span() -> list[Column]:
    return [*map(F.col, KEY), F.col("lo").cast("long").alias("lo"), (F.col("lo") + F.col("span")).cast("long").alias("hi")]


NAME = ["h", "c", "d"]


def _decided(bodies: DataFrame, gram: int, anchor: int, shard_bytes: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """Repeated runs among bodies, one of each class, with the number of members n and that of the anchor's classes."""
    most = max(1, shard_bytes // (2 * gram))  # classes of an anchor that fit a shard
    size = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    # some MB for each task, until there are enough tasks; from there on tasks grow
    tasks = max(size // (256 << 20), min(size // (4 << 20), 2000)) + 1
    cold = bodies.where(F.col("classes") <= most).repartition(int(tasks), "h").sortWithinPartitions("h")
    spans = _shard_runs(cold, gram, shard_bytes)
    hot = bodies.where(F.col("classes") > most)
    if hot.isEmpty():
        return spans
    pieces, _ = settle(_pieces(hot, gram, anchor, widths[0]), "suffix-pieces")
    place = F.struct(*KEY, "lo", "span", "mark", "body")
    classes, _ = settle(pieces.groupBy(*NAME).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min(place).alias("one")), "suffix-piece-classes")
    heavy, _ = heavy_keys(classes, NAME, "k")
    whole = spread_join(pieces.where("n = 1").drop("body", "n"), classes.where("n > 1").select(*NAME), NAME, heavy).select(*_span())
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    heavy, _ = heavy_keys(several, ["h"], "classes")
    rest, _ = settle(spread_join(classes.select(*NAME, "n", "one.*"), several, ["h"], heavy), "suffix-piece-bodies")
    spans = spans.unionByName(whole)
    return spans if rest.isEmpty() else spans.unionByName(_decided(rest, gram, anchor, shard_bytes, widths[1:]))


def repeated_spans(docs: DataFrame, gram: int = GRAM, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, widths: tuple[int, ...] = WIDTHS, broadcast_rows: int = 500_000) -> DataFrame:
    """KEY and spans, an array of (lo, hi): the gram at each byte from lo to hi - 1 also starts elsewhere. docs is keyed.

    The last of widths is 1.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), *KEY)
    every, at_every = settle(_contexts_of(rows, gram, anchor), "suffix-contexts")
    again, _ = settle(every.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "suffix-anchors")
    heavy, _ = heavy_keys(again, ["h"], "k")
    some, at_some = settle(spread_join(every, again.select("h"), ["h"], heavy), "suffix-candidates")
    drop(spark, at_every)

    place = F.struct(*KEY, "lo", "span", "mark")
    classes = some.groupBy(*NAME).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    classes, _ = settle(classes, "suffix-classes")
    heavy, _ = heavy_keys(classes, NAME, "n")
    full = spread_join(some, classes.where("n > 1").select(*NAME), NAME, heavy).select(*_span())

    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    heavy, _ = heavy_keys(several, ["h"], "classes")
    # a class of one row stands for itself; a class of several for its equals
    picked = spread_join(classes.select(*NAME, "n", "one.*"), several, ["h"], heavy)
    picked = picked.groupBy(*KEY).agg(F.collect_list(F.struct(*NAME, "lo", "span", "mark", "n", "classes")).alias("wanted"))
    picked, _ = settle(picked, "suffix-picked")
    chosen = F.broadcast(picked.select(*KEY)) if picked.count() <= broadcast_rows else picked.select(*KEY)
    bodies, at_bodies = settle(_cut_contexts(rows.join(chosen, KEY, "left_semi").join(picked, KEY), gram), "suffix-bodies")

    spans = full.unionByName(_decided(bodies, gram, anchor, shard_bytes, widths))
    spans, _ = settle(spans.groupBy(*KEY).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "suffix-spans")
    drop(spark, at_some, at_bodies)
    return spans


def _kept(data: bytes, spans: np.ndarray, gram: int) -> tuple[bytes, int]:
    """(bytes that stay, runs removed); spans has rows (lo, hi) of window starts."""
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1] - 1 + gram, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), len(_runs(gone)[0])


def _cleaned(docs: DataFrame, gram: int, broadcast_rows: int, **options) -> DataFrame:
    """Keyed docs with _rsd_spans, null where nothing repeats."""
    spans = repeated_spans(docs, gram=gram, broadcast_rows=broadcast_rows, **options).withColumnRenamed("spans", "_rsd_spans")
    n, most = spans.agg(F.count(F.lit(1)), F.sum(F.size("_rsd_spans"))).first()
    spans = F.broadcast(spans) if n + (most or 0) <= broadcast_rows else spans
    return docs.join(spans, KEY, "left")


def _span_rows(column: pa.Array, k: int) -> np.ndarray:
    a, b = column.offsets[k].as_py(), column.offsets[k + 1].as_py()
    flat = column.values
    return np.stack([flat.field("lo")[a:b].to_numpy(), flat.field("hi")[a:b].to_numpy()], axis=1)


def suffix_report(docs: DataFrame, gram: int = GRAM, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    rows = keyed(docs).select("doc_id", "text", *KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_bytes(batch["text"])
            spans, out = batch["_rsd_spans"], []
            for k in range(batch.num_rows):
                own, runs = data[offsets[k] : offsets[k + 1]].tobytes(), 0
                kept = own
                if spans[k].is_valid:
                    kept, runs = _kept(own, _span_rows(spans, k), gram)
                out.append((len(own), len(own) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = _cleaned(rows, gram, broadcast_rows, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "text", "_rsd_spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame, gram: int = GRAM, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """docs with texts without their repeated bytes; n_chars, where there is one, is counted anew."""
    docs, named = guarded(docs)
    rows = keyed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch["_rsd_spans"], batch["text"].to_pylist()
            for k in range(batch.num_rows):
                if spans[k].is_valid:
                    texts[k] = _kept(texts[k].encode(), _span_rows(spans, k), gram)[0].decode(errors="ignore")
            names = batch.schema.names[:-1]
            cols = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    found = _cleaned(rows, gram, broadcast_rows, **options).select(*docs.columns, "_rsd_spans")
    out = found.mapInArrow(run, docs.schema)
    return named(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out)
