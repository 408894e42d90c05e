"""Lossless WebP (VP8L): a reader of every transform and code of the public format, and a writer.

Pixels are rows of 32-bit ARGB. The reader knows simple and canonical prefix codes, meta prefix codes, back-references with
two-dimensional distances, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. A picture
of green literals and back-references, as write_greens makes them, is read in bulk: what each bit position would stand for is
found for all at once. write_greens uses a palette and back-references where they make the file smaller.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

# Fixed values of the format: order of code length codes, and the neighbours (dx, dy) of the short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000


# ---- prefix codes ----


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in np.argsort(lengths, kind="stable")[int((lengths == 0).sum()) :].tolist():
        n = int(lengths[s])
        code <<= n - last
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return codes


_turns: dict[int, np.ndarray] = {}


def _turned(bits: int) -> np.ndarray:
    """Each number of so many bits, read backwards."""
    if bits not in _turns:
        n, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
        for k in range(bits):
            out |= ((n >> k) & 1) << (bits - 1 - k)
        _turns[bits] = out
    return _turns[bits]


class PrefixCode:
    """Looks up the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        some = np.flatnonzero(lengths)
        if len(some) <= 1:
            self.bits, self.single = 0, int(some[0]) if len(some) else 0
            return
        if sum(2.0 ** -int(lengths[s]) for s in some) != 1:
            raise ValueError("incomplete prefix code")
        self.single, self.bits = None, int(lengths.max())
        order = np.argsort(lengths, kind="stable")[-len(some) :]
        share = 1 << (self.bits - lengths[order])
        turned = _turned(self.bits)
        self.symbol, self.length = np.repeat(order, share)[turned], np.repeat(lengths[order], share)[turned]
        # plain lists are quicker for one look-up at a time, and short codes are looked up so
        self.pairs = list(zip(self.symbol.tolist(), self.length.tolist())) if self.bits <= 7 else None


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.held = data, 0, 0, 0

    def _fill(self, n: int) -> None:
        while self.held < n:
            self.value |= int.from_bytes(self.data[self.at : self.at + 8], "little") << self.held
            self.at += 8
            self.held += 64
            if self.at > len(self.data) + 64:
                raise ValueError("the picture ends early")

    def bits(self, n: int) -> int:
        self._fill(n)
        out = self.value & ((1 << n) - 1)
        self.value >>= n
        self.held -= n
        return out

    def symbol(self, code: PrefixCode) -> int:
        if code.single is not None:
            return code.single
        self._fill(code.bits)
        k = self.value & ((1 << code.bits) - 1)
        s, n = code.pairs[k] if code.pairs else (int(code.symbol[k]), int(code.length[k]))
        self.value >>= n
        self.held -= n
        return s

    def position(self) -> int:
        """Bits read so far."""
        return self.at * 8 - self.held


def _read_code(r: BitReader, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if r.bits(1):
        two = r.bits(1)
        first = r.bits(8) if r.bits(1) else r.bits(1)
        lengths[first] = 1
        if two:
            lengths[r.bits(8)] = 1
        return PrefixCode(np.array(lengths))
    own = np.zeros(19, np.int64)
    for k in range(4 + r.bits(4)):
        own[LENGTH_ORDER[k]] = r.bits(3)
    code = PrefixCode(own)
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        s = r.symbol(code)
        if s < 16:
            lengths[at] = s
            at, last = at + 1, s or last
        else:
            value, times = (last, 3 + r.bits(2)) if s == 16 else (0, 3 + r.bits(3)) if s == 17 else (0, 11 + r.bits(7))
            if at + times > alphabet:
                raise ValueError("too many code lengths")
            lengths[at : at + times] = [value] * times
            at += times
    return PrefixCode(np.array(lengths))


def _extended(r: BitReader, prefix: int) -> int:
    """The number that a length or distance prefix and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + r.bits(extra) + 1


def _extended_at(peek, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_extended for many places: the numbers, and where their extra bits end."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + (peek(at) & ((1 << extra) - 1)) + 1), at + extra


def _greens(r: BitReader, group: list[PrefixCode], n: int, width: int) -> np.ndarray | None:
    """All pixels at once, where only green varies and no cache is used; else None, and nothing is read."""
    green, red, blue, alpha, far = group
    if green.single is not None or None in (red.single, blue.single, alpha.single):
        return None
    start = r.position()
    data = np.frombuffer(r.data[start >> 3 :], np.uint8)
    wide = np.zeros(len(data) + 6, np.uint32)
    wide[: len(data)] = data
    wide = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
    window = (wide[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1) & ((1 << green.bits) - 1)
    # where the symbol after the one at each bit begins; then eight symbols at a step
    last = len(window) - 1
    one = np.minimum(np.arange(len(window)) + green.length[window], last)

    def peek(at: np.ndarray) -> np.ndarray:
        """25 bits and more from each place."""
        at = np.minimum(at, last)
        return (wide[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64)

    def copies(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lengths and distance codes of the back-references at these places, and where they end."""
        length, p = _extended_at(peek, at + green.length[window[at]], green.symbol[window[at]] - 256)
        if far.single is not None:
            prefix = np.full(len(at), far.single)
        else:
            k = peek(p) & ((1 << far.bits) - 1)
            prefix, p = far.symbol[k], p + far.length[k]
        return length, *_extended_at(peek, p, prefix)

    if has_copies := bool((green.symbol >= 256).any()):
        maybe = np.flatnonzero((green.symbol >= 256)[window])
        one[maybe] = np.minimum(copies(maybe)[2], last)
    two = one[one]
    four = two[two]
    eight = four[four]
    heads, p = [], start & 7
    for _ in range(-(-n // 8)):
        heads.append(p)
        p = eight[p]
        if p == last:
            break
    at = np.array(heads)
    for skip in (four, two, one):
        at = np.stack([at, skip[at]], axis=1).reshape(-1)
    symbols = green.symbol[window[at]]
    counts = np.ones(len(at), np.int64)
    if has_copies:
        copied = np.flatnonzero(symbols >= 256)
        lengths, codes, ends = copies(at[copied])
        counts[copied] = lengths
    past = np.cumsum(counts)
    k = int(np.searchsorted(past, n))
    if k == len(past):
        raise ValueError("the picture ends early")
    if past[k] != n:
        raise ValueError("a back-reference leaves the picture")
    p = int(at[k] + green.length[window[at[k]]])
    if symbols[k] >= 256:
        p = int(ends[np.searchsorted(copied, k)])
    if p > len(data) * 8:
        raise ValueError("the picture ends early")
    out = np.zeros(n, np.uint32)
    literal = np.flatnonzero(symbols[: k + 1] < 256)
    out[past[literal] - 1] = symbols[literal]
    if has_copies:
        own = copied <= k
        for to, length, code in zip((past - counts)[copied[own]].tolist(), lengths[own].tolist(), codes[own].tolist()):
            back = _distance(code, width)
            if back > to:
                raise ValueError("a back-reference leaves the picture")
            seed = out[to - back : to - back + min(back, length)]
            out[to : to + length] = seed if back >= length else np.resize(seed, length)
    r.at, r.value, r.held = (start >> 3) + (p >> 3), 0, 0
    r.bits(p & 7)
    return out << 8 | np.uint32(alpha.single << 24 | red.single << 16 | blue.single)


def _distance(code: int, width: int) -> int:
    """Pixels back."""
    if code > len(NEAR):
        return code - len(NEAR)
    dx, dy = NEAR[code - 1]
    return max(1, dx + dy * width)


def _read_pixels(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    meta, shift, groups = None, 0, 1
    if main and r.bits(1):
        shift = r.bits(3) + 2
        meta = (_read_pixels(r, (width + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift, False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    codes = [[_read_code(r, n) for n in (256 + 24 + len(cache), 256, 256, 256, 40)] for _ in range(groups)]
    n = width * height
    if not cache and groups == 1 and (plain := _greens(r, codes[0], n, width)) is not None:
        return plain.reshape(height, width)
    out, group = [], codes[0]
    while len(out) < n:
        if meta is not None:
            y, x = divmod(len(out), width)
            group = codes[int(meta[y >> shift, x >> shift])]
        s = r.symbol(group[0])
        if s < 256:
            red, blue, alpha = (r.symbol(c) for c in group[1:4])
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _extended(r, s - 256)
            back = _distance(_extended(r, r.symbol(group[4])), width)
            if back > len(out) or len(out) + length > n:
                raise ValueError("a back-reference leaves the picture")
            seed = out[len(out) - back : len(out) - back + min(back, length)]
            new = (seed * (length // len(seed) + 1))[:length]
        else:
            new = [cache[s - 280]]
        out += new
        for p in new if cache else ():
            cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32).reshape(height, width)


# ---- transforms ----


def _parts(p: np.ndarray) -> np.ndarray:
    """(..., 4): blue, green, red, alpha as 8 bits."""
    return np.ascontiguousarray(p.astype("<u4")).view(np.uint8).reshape(*p.shape, 4)


def _whole(parts: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(parts.astype(np.uint8)).view("<u4").reshape(parts.shape[:-1]).astype(np.uint32)


def _predict(mode: int, l: np.ndarray, t: np.ndarray, tl: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The prediction from 4 neighbours, each as int parts."""
    mean = lambda a, b: (a + b) // 2
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (l, t, tr, tl)[mode - 1]
    if mode == 5:
        return mean(mean(l, tr), t)
    if mode < 11:
        return mean(*((l, tl), (l, t), (tl, t), (t, tr), (mean(l, tl), mean(t, tr)))[mode - 6])
    if mode == 11:
        to_left = np.abs(t - tl).sum()
        to_top = np.abs(l - tl).sum()
        return l if to_left < to_top else t
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    half = mean(l, t)
    return np.clip(half + np.trunc((half - tl) / 2).astype(int), 0, 255)


def _predictor(p: np.ndarray, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    h, w = p.shape
    src = _parts(p).astype(int)
    out = np.zeros_like(src)
    known = out if inverse else src
    for y in range(h):
        for x in range(w):
            if not x and not y:
                guess = np.array([0, 0, 0, 255])
            elif not y:
                guess = known[0, x - 1]
            elif not x:
                guess = known[y - 1, 0]
            else:
                mode = int(modes[y >> bits, x >> bits] >> 8) & 15
                # the pixel right of the last one above is the first of this row
                tr = known[y - 1, x + 1] if x + 1 < w else known[y, 0]
                guess = _predict(mode, known[y, x - 1], known[y - 1, x], known[y - 1, x - 1], tr)
            out[y, x] = (src[y, x] + guess if inverse else src[y, x] - guess) & 255
    return _whole(out)


def _cross_colour(p: np.ndarray, marks: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    h, w = p.shape
    marks = _parts(marks).astype(np.int8).astype(int)[np.arange(h)[:, None] >> bits, np.arange(w) >> bits]
    parts = _parts(p).astype(int)
    signed = lambda a: (a & 255).astype(np.uint8).astype(np.int8).astype(int)
    delta = lambda mark, of: (mark * signed(of)) >> 5
    green, red, blue = parts[..., 1], parts[..., 2], parts[..., 0]
    sign = 1 if inverse else -1
    new_red = (red + sign * delta(marks[..., 0], green)) & 255
    blue = blue + sign * delta(marks[..., 1], green) + sign * delta(marks[..., 2], new_red if inverse else red)
    parts[..., 2], parts[..., 0] = new_red, blue & 255
    return _whole(parts)


def _subtract_green(p: np.ndarray, inverse: bool) -> np.ndarray:
    parts = _parts(p).astype(int)
    for c in (0, 2):
        parts[..., c] = (parts[..., c] + (parts[..., 1] if inverse else -parts[..., 1])) & 255
    return _whole(parts)


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _from_palette(p: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle(len(table))
    index = (p >> 8) & 255
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = ((index[:, :, None] >> (np.arange(per, dtype=np.uint32) * each)) & ((1 << each) - 1)).reshape(len(p), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def read(data: bytes) -> np.ndarray:
    """The pixels of a file, ARGB."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    r = BitReader(data[21 : 20 + struct.unpack("<I", data[16:20])[0]])
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while r.bits(1):
        kind = r.bits(2)
        if any(k == kind for k, *_ in undo):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            sub = _read_pixels(r, (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)
            undo.append((kind, sub, bits))
        elif kind == PALETTE:
            table = _whole(np.cumsum(_parts(_read_pixels(r, r.bits(8) + 1, 1, False)).astype(int), axis=1) & 255)[0]
            undo.append((kind, table, now))
            now = (now + (1 << _bundle(len(table))) - 1) >> _bundle(len(table))
        else:
            undo.append((kind, None, 0))
    p = _read_pixels(r, now, height, True)
    if r.position() > 8 * len(r.data):
        raise ValueError("the picture ends early")
    for kind, own, n in reversed(undo):
        if kind == PREDICTOR:
            p = _predictor(p, own, n, True)
        elif kind == CROSS_COLOUR:
            p = _cross_colour(p, own, n, True)
        elif kind == SUBTRACT_GREEN:
            p = _subtract_green(p, True)
        else:
            p = _from_palette(p, own, n)
    return p


# ---- the writer ----


class BitWriter:
    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.few: tuple[list[int], list[int]] = ([], [])

    def bits(self, value: int, n: int) -> None:
        if n:
            self.few[0].append(value)
            self.few[1].append(n)

    def _flush(self) -> None:
        self.values.append(np.array(self.few[0], np.int64))
        self.sizes.append(np.array(self.few[1], np.int64))
        self.few = ([], [])

    def many(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self._flush()
        self.values.append(values)
        self.sizes.append(sizes)

    def tobytes(self) -> bytes:
        self._flush()
        values, sizes = np.concatenate(self.values).astype(np.uint64), np.concatenate(self.sizes)
        values, sizes = values[sizes > 0], sizes[sizes > 0]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        word, shift = starts >> 5, (starts & 31).astype(np.uint64)
        out = np.zeros(int(ends[-1] >> 5) + 3, np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        # values have at most 32 bits, so a value ends in the next word at the latest, and no two overlap
        out[word[first]] |= np.add.reduceat(values << shift, first)
        low, high = out & np.uint64(0xFFFFFFFF), out >> np.uint64(32)
        low[1:] |= high[:-1]
        return low.astype("<u4").tobytes()[: (int(ends[-1]) + 7) >> 3]


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Lengths of a prefix code for symbols with counts, none longer than `most`."""
    lengths = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    if len(some) < 2:
        lengths[some] = 1
        return lengths
    weight = counts[some].astype(np.int64)
    while True:
        heap = [(w, k, k) for k, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        parent, new = [0] * (2 * len(some)), len(some)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            parent[a[2]] = parent[b[2]] = new
            heapq.heappush(heap, (a[0] + b[0], new, new))
            new += 1
        depth = [0] * new
        for k in range(new - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(some)]) <= most:
            lengths[some] = depth[: len(some)]
            return lengths
        weight = (weight + 1) // 2


def _write_code(w: BitWriter, lengths: np.ndarray) -> None:
    some = np.flatnonzero(lengths)
    if len(some) <= 1 and (not len(some) or some[0] < 256):
        w.bits(1, 1)
        w.bits(0, 1)
        w.bits(1, 1)
        w.bits(int(some[0]) if len(some) else 0, 8)
        return
    w.bits(0, 1)
    # lengths as symbols: runs of noughts by 17 and 18
    symbols: list[tuple[int, int, int]] = []
    lengths = lengths.tolist()
    at, n = 0, len(lengths)
    while at < n:
        end = at
        while end < n and lengths[end] == 0 and end - at < 138:
            end += 1
        run = end - at
        if run >= 11:
            symbols.append((18, run - 11, 7))
        elif run >= 3:
            symbols.append((17, run - 3, 3))
        else:
            run = 1
            symbols.append((lengths[at], 0, 0))
        at += run
    own = code_lengths(np.bincount([s for s, _, _ in symbols], minlength=19), 7)
    codes = canonical(own) if (own > 0).sum() > 1 else np.zeros(19, np.int64)
    last = max(k for k in range(19) if own[LENGTH_ORDER[k]] or k < 4)
    w.bits(last + 1 - 4, 4)
    for k in range(last + 1):
        w.bits(int(own[LENGTH_ORDER[k]]), 3)
    w.bits(0, 1)
    sizes = (own if (own > 0).sum() > 1 else own * 0).tolist()
    codes = codes.tolist()
    for s, value, extra in symbols:
        w.bits(codes[s], sizes[s])
        w.bits(value, extra)


def _prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, extra bits) of a length or distance."""
    if value < 5:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = (v >> (top - 1)) & 1
    return 2 * top + second, v & ((1 << (top - 1)) - 1), top - 1


Token = tuple


def _write_tokens(w: BitWriter, tokens: list[Token], cache_bits: int, main: bool) -> None:
    """tokens: ("pixel", argb), ("copy", length, distance code) or ("cache", index)."""
    w.bits(1 if cache_bits else 0, 1)
    if cache_bits:
        w.bits(cache_bits, 4)
    if main:
        w.bits(0, 1)
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    counts = [np.zeros(n, np.int64) for n in sizes]
    parts: list[tuple[int, int, int, int]] = []  # (code, symbol, extra value, extra bits)
    for t in tokens:
        if t[0] == "pixel":
            p = int(t[1])
            parts += [(0, p >> 8 & 255, 0, 0), (1, p >> 16 & 255, 0, 0), (2, p & 255, 0, 0), (3, p >> 24, 0, 0)]
        elif t[0] == "copy":
            a, b = _prefix_of(t[1]), _prefix_of(t[2])
            parts += [(0, 256 + a[0], a[1], a[2]), (4, *b)]
        else:
            parts.append((0, 280 + t[1], 0, 0))
    for c, s, _, _ in parts:
        counts[c][s] += 1
    lengths = [code_lengths(c) for c in counts]
    codes = [canonical(n) if (n > 0).sum() > 1 else np.zeros(len(n), np.int64) for n in lengths]
    for n in lengths:
        _write_code(w, n)
    for c, s, value, extra in parts:
        w.bits(int(codes[c][s]), int(lengths[c][s]) if (lengths[c] > 0).sum() > 1 else 0)
        w.bits(value, extra)


def _file(w: BitWriter) -> bytes:
    body = b"\x2f" + w.tobytes()
    body += b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def write_tokens(width: int, height: int, tokens: list[Token], transforms: list[tuple] = (), cache_bits: int = 0) -> bytes:
    """A file of given tokens behind given transforms: (kind, sub-picture, bits) in the order in which they were applied."""
    w = BitWriter()
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(0, 4)
    for kind, sub, bits in transforms:
        w.bits(1, 1)
        w.bits(kind, 2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            w.bits(bits - 2, 3)
            _write_tokens(w, [("pixel", p) for p in sub.reshape(-1)], 0, False)
        elif kind == PALETTE:
            w.bits(len(sub) - 1, 8)
            parts = _parts(sub).astype(int)
            _write_tokens(w, [("pixel", p) for p in _whole(np.diff(parts, axis=0, prepend=0) & 255)], 0, False)
    w.bits(0, 1)
    _write_tokens(w, tokens, cache_bits, True)
    return _file(w)


#: Fewer samples than this aren't looked through for repeats, and no copy is shorter than LEAST_COPY.
LEAST_SEARCHED, LEAST_COPY, MOST_COPY = 256, 24, 4096
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def repeats(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and distances of the copies that a pass from left to right takes, each from the last place with the same 24 samples."""
    none = (np.zeros(0, np.int64),) * 3
    n = len(flat)
    if n < LEAST_SEARCHED:
        return none
    w = flat.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | w[k:] << np.uint64(8 * k)
    m = n - LEAST_COPY + 1
    key = sum(w[8 * k : 8 * k + m] * np.uint64(_MIX[k]) for k in range(3))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return none
    # only the keys that occur again are put in order with their places
    again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key)
    order = again[np.argsort(key[again], kind="stable")]
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    before = np.full(m, -1, np.int64)
    before[order[same + 1]] = order[same]
    places = np.flatnonzero(before >= 0)
    found, at, k = [], 0, 0
    while (k := int(np.searchsorted(places, at))) < len(places):
        at = int(places[k])
        source = int(before[at])
        most = min(MOST_COPY, n - at)
        # short stretches first: most repeats end soon
        length = 0
        for size in (64, most):
            differ = np.flatnonzero(flat[at : at + min(size, most)] != flat[source : source + min(size, most)])
            length = int(differ[0]) if len(differ) else min(size, most)
            if len(differ):
                break
        if length >= LEAST_COPY and at - source <= (1 << 20) - len(NEAR):
            found.append((at, length, at - source))
            at += length
        else:
            at += 1
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


def _prefixes_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_prefix_of for many numbers."""
    v = value - 1
    extra = np.where(v < 4, 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) - 1)
    return np.where(v < 4, v, 2 * (extra + 1) + ((v >> extra) & 1)), v & ((1 << extra) - 1), extra


def _green_body(w: BitWriter, flat: np.ndarray, copies: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """Opaque pixels by their green samples: one group of codes, no cache; copies as repeats() gives them."""
    w.bits(0, 2)
    places, lengths, distances = copies
    kept = np.ones(len(flat), bool)
    if len(places):
        edge = np.zeros(len(flat) + 1, np.int64)
        np.add.at(edge, places, 1)
        np.add.at(edge, places + lengths, -1)
        kept = np.cumsum(edge[:-1]) == 0
    size, far = _prefixes_of(lengths), _prefixes_of(distances + len(NEAR))
    # one event for each literal and each copy, in order; a copy has four parts
    at = np.flatnonzero(kept)
    order = np.argsort(np.concatenate([at, places]), kind="stable") if len(places) else slice(None)
    events = np.concatenate([flat[at].astype(np.int64), 256 + size[0]])[order]
    greens = code_lengths(np.bincount(events, minlength=280), 12)
    fars = code_lengths(np.bincount(far[0], minlength=40))
    _write_code(w, greens)
    for only in (0, 0, 255):
        w.bits(1 | 4 | only << 3, 11)
    _write_code(w, fars)
    if (greens > 0).sum() < 2:
        return
    codes = canonical(greens)
    if not len(places):
        w.many(codes[events], greens[events])
        return
    several = (fars > 0).sum() > 1
    values, sizes = np.zeros((len(events), 4), np.int64), np.zeros((len(events), 4), np.int64)
    values[:, 0], sizes[:, 0] = codes[events], greens[events]
    copy = np.flatnonzero(events >= 256)
    values[copy, 1], sizes[copy, 1] = size[1], size[2]
    if several:
        values[copy, 2], sizes[copy, 2] = canonical(fars)[far[0]], fars[far[0]]
    values[copy, 3], sizes[copy, 3] = far[1], far[2]
    some = sizes.reshape(-1) > 0
    w.many(values.reshape(-1)[some], sizes.reshape(-1)[some])


def write_greens(samples: np.ndarray) -> bytes:
    """A file of 8-bit samples (rows, columns) in the green part of opaque pixels: with a palette where that is smaller, and with copies where they should pay."""
    height, width = samples.shape
    kinds = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256))

    def file(flat: np.ndarray, copies, palette: bool) -> bytes:
        w = BitWriter()
        w.bits((width - 1) | (height - 1) << 14, 32)
        if palette:
            table = np.uint32(BLACK) | kinds.astype(np.uint32) << np.uint32(8)
            w.bits(1 | PALETTE << 1, 3)
            w.bits(len(kinds) - 1, 8)
            _write_tokens(w, [("pixel", p) for p in _whole(np.diff(_parts(table).astype(int), axis=0, prepend=0) & 255)], 0, False)
        w.bits(0, 1)
        _green_body(w, flat, copies)
        return _file(w)

    forms = [(samples.reshape(-1), False)]
    if 1 < len(kinds) <= 16:
        bits = _bundle(len(kinds))
        per, each = 1 << bits, 8 >> bits
        index = np.zeros((height, -(-width // per) * per), np.int64)
        index[:, :width] = np.searchsorted(kinds, samples)
        forms.append(((index.reshape(height, -1, per) << (np.arange(per) * each)).sum(axis=2).astype(np.uint8).reshape(-1), True))
    files = []
    for flat, palette in forms:
        copies = repeats(flat)
        # a copy takes about 40 bits, its codes 256; a literal what the plain code would give it
        share = np.bincount(flat) / len(flat)
        literal = -(share[share > 0] * np.log2(share[share > 0])).sum()
        pays = (literal * copies[1] - 40).sum() > 256
        files.append(file(flat, copies if pays else (np.zeros(0, np.int64),) * 3, palette))
    return min(files, key=len)
