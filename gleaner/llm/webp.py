"""Lossless WebP (VP8L) images: a decoder for the whole bit stream and an encoder that can use all of it.

The decoder reads prefix codes, back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms; the frames of an animation are put on its canvas.  ``webp_grey`` does many
grey images at once; ``media`` has the columns of a table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
OPAQUE_BLACK = 0xFF000000

# Fixed values of the format: the order in which lengths of the length code come, and the near distances (dx, dy).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Bits of a byte string, the least significant of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        found = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("image data is cut short")
        return found


@lru_cache(maxsize=16)
def _reversed(width: int) -> np.ndarray:
    """Every number of so many bits, its bits in reverse."""
    out = np.zeros(1, np.int64)
    for k in range(width):
        out = np.r_[out, out | 1 << (width - 1 - k)]
    return out


class PrefixCode:
    """A canonical prefix code of at most 15 bits; a code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        if not any(lengths):
            lengths = [1]
        n = np.array(lengths, np.int64)
        used = np.flatnonzero(n)
        self.only = int(used[0]) if len(used) == 1 else None
        self.lengths = lengths
        if self.only is None:
            used = used[np.argsort(n[used], kind="stable")]
            n = n[used]
            self.width = int(n[-1])
            size = 1 << (self.width - n)
            if size.sum() != 1 << self.width:
                raise ValueError("prefix code is not complete")
            # symbol << 4 | bits: codes follow one another if their first bit is the highest; here it is the lowest
            self.table = np.repeat(used << 4 | n, size)[_reversed(self.width)]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        found = int(self.table[bits.peek(self.width)])
        bits.read(found & 15)
        return found >> 4


def codes_of(lengths: list[int]) -> dict[int, int]:
    """Symbol -> its canonical code, first bit in the lowest place."""
    code, last, found = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        found[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return found


@lru_cache(maxsize=256)
def _table_of_lengths(lengths: tuple[int, ...]) -> list[int]:
    """symbol << 4 | bits, by the next bits of the stream."""
    code = PrefixCode(list(lengths))
    return [code.only << 4] if code.only is not None else code.table.tolist()


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths = [0] * max(alphabet, 2)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    of_lengths = [0] * 19
    for k in range(4 + bits.read(4)):
        of_lengths[LENGTH_ORDER[k]] = bits.read(3)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, lengths, before = _table_of_lengths(tuple(of_lengths)), [], 8
    data, at, mask = bits.data, bits.at, len(table) - 1
    while len(lengths) < alphabet and most:
        most -= 1
        k = at >> 3
        window = int.from_bytes(data[k : k + 5], "little") >> (at & 7)
        e = table[window & mask]
        s, n = e >> 4, e & 15
        window >>= n
        if s < 16:
            lengths.append(s)
            before = s or before
        elif s == 16:
            lengths += [before] * (3 + (window & 3))
            n += 2
        elif s == 17:
            lengths += [0] * (3 + (window & 7))
            n += 3
        else:
            lengths += [0] * (11 + (window & 127))
            n += 7
        at += n
    bits.at = at
    if at > 8 * len(data):
        raise ValueError("image data is cut short")
    return PrefixCode((lengths + [0] * alphabet)[:alphabet])


def _extra(bits: Bits, symbol: int) -> int:
    """A length or distance from its symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def _blocks(side: int, bits: int) -> int:
    return -(-side // (1 << bits))


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """The ARGB values of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups_of, group_bits, groups_n = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        groups_of = read_pixels(bits, _blocks(width, group_bits), _blocks(height, group_bits), False) >> 8 & 0xFFFF
        groups_n = int(groups_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(groups_n)]
    n = width * height
    out, cache, at, per_row = [0] * n, [0] * cache_size, 0, _blocks(width, group_bits)
    shift = 32 - cache_bits
    while at < n:
        green, red, blue, alpha, far = groups[int(groups_of[(at // width >> group_bits) * per_row + (at % width >> group_bits)]) if groups_of is not None else 0]
        s, begin = green.read(bits), at
        if s < 256:
            out[at] = red.read(bits) << 16 | s << 8 | blue.read(bits) | alpha.read(bits) << 24
            at += 1
        elif s < 280:
            length, code = _extra(bits, s - 256), _extra(bits, far.read(bits))
            if code <= len(NEAR):
                dx, dy = NEAR[code - 1]
                distance = max(1, dx + dy * width)
            else:
                distance = code - len(NEAR)
            if distance > at or at + length > n:
                raise ValueError("back-reference beyond the image")
            for _ in range(length):
                out[at] = out[at - distance]
                at += 1
        else:
            out[at] = cache[s - 280]
            at += 1
        if cache_bits:
            for argb in out[begin:at]:
                cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> shift] = argb
    return np.array(out, dtype=np.uint32)


# Transforms, on (height, width) arrays of ARGB


def _channels(argb: np.ndarray) -> np.ndarray:
    """(blue, green, red, alpha) as the last axis."""
    return np.ascontiguousarray(argb, dtype="<u4").view(np.uint8).reshape(*argb.shape, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, dtype=np.uint8).view("<u4").reshape(channels.shape[:-1])


def _average(a, b):
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def predict(mode: int, left, top, top_right, top_left):
    """The predicted channels from those of the neighbours."""
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode <= 9:
        return _average(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        by_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        by_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if by_left < by_top else top
    clamp = lambda v: min(255, max(0, v))
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)]
    half = _average(left, top)
    # the quotient is cut towards zero
    return [clamp(a + int((a - b) / 2)) for a, b in zip(half, top_left, strict=True)]


def predictor(argb: np.ndarray, modes: np.ndarray, bits: int, invert: bool) -> np.ndarray:
    """Add (invert) or subtract the prediction of every pixel."""
    given = _channels(argb).astype(int)
    h, w = argb.shape
    flat_in, flat_out = given.reshape(-1, 4).tolist(), []
    known = flat_out if invert else flat_in
    for k, value in enumerate(flat_in):
        y, x = divmod(k, w)
        if not k:
            guess = [0, 0, 0, 255]
        elif not y:
            guess = known[k - 1]
        elif not x:
            guess = known[k - w]
        else:
            mode = int(modes[y >> bits, x >> bits]) >> 8 & 15
            guess = predict(mode, known[k - 1], known[k - w], known[k - w + 1], known[k - w - 1])
        flat_out.append([(v + g if invert else v - g) & 255 for v, g in zip(value, guess, strict=True)])
    return _packed(np.array(flat_out, np.uint8).reshape(h, w, 4))


def cross_colour(argb: np.ndarray, factors: np.ndarray, bits: int, invert: bool) -> np.ndarray:
    h, w = argb.shape
    c = _channels(argb).astype(np.int64)
    signed = lambda v: ((v & 255) ^ 128) - 128
    f = _channels(factors)[np.arange(h)[:, None] >> bits, np.arange(w) >> bits].astype(np.int64)
    delta = lambda t, v: signed(t) * signed(v) >> 5
    sign = 1 if invert else -1
    red = c[..., 2] + sign * delta(f[..., 0], c[..., 1])
    original_red = red if invert else c[..., 2]
    blue = c[..., 0] + sign * (delta(f[..., 1], c[..., 1]) + delta(f[..., 2], original_red))
    c[..., 2], c[..., 0] = red & 255, blue & 255
    return _packed(c)


def subtract_green(argb: np.ndarray, invert: bool) -> np.ndarray:
    c = _channels(argb).copy()
    green = c[..., 1] if invert else -c[..., 1]
    c[..., 2] += green
    c[..., 0] += green
    return _packed(c)


def palette_bits(colours: int) -> int:
    """log2 of how many indexes share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def from_palette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = palette_bits(len(palette))
    green = (argb >> 8 & 255).astype(np.int64)
    if bits:
        each = 8 >> bits
        green = (green[..., None] >> np.arange(0, 8, each) & (1 << each) - 1).reshape(len(argb), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[green]


def to_palette(argb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    palette, index = np.unique(argb, return_inverse=True)
    index, bits = index.reshape(argb.shape), palette_bits(len(palette))
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = np.pad(index, ((0, 0), (0, -argb.shape[1] % per))).reshape(len(argb), -1, per)
        index = (index << np.arange(0, 8, each)).sum(axis=2)
    return OPAQUE_BLACK | index.astype(np.uint32) << 8, palette.astype(np.uint32)


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, where its body begins, size) of the chunks between two places."""
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + size > len(data):
            raise ValueError("a chunk is cut short")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def _body(data: bytes) -> Iterator[tuple[bytes, int, int]]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    return _chunks(data, 12, len(data))


def _three(data: bytes, at: int) -> int:
    return int.from_bytes(data[at : at + 3], "little")


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(x, y, stream) of every lossless image of a file, as they lie on the canvas."""
    for kind, at, size in _body(data):
        if kind == b"VP8L":
            yield 0, 0, data[at : at + size]
        elif kind == b"ANMF":
            for inner, k, n in _chunks(data, at + 16, at + size):
                if inner == b"VP8L":
                    yield 2 * _three(data, at), 2 * _three(data, at + 3), data[k : k + n]


def canvas(data: bytes) -> tuple[int, int]:
    """Width and height of a file's canvas."""
    for kind, at, _ in _body(data):
        if kind == b"VP8X":
            return _three(data, at + 4) + 1, _three(data, at + 7) + 1
        if kind == b"VP8L" and data[at] == 0x2F:
            sides = int.from_bytes(data[at + 1 : at + 5], "little")
            return (sides & 0x3FFF) + 1, (sides >> 14 & 0x3FFF) + 1
    raise ValueError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """The RGBA samples of a lossless WebP file, as a (height, width, 4) array of bytes; of an animation, what all its
    frames leave on the canvas, later ones over earlier ones."""
    (width, height), parts = canvas(data), [(x, y, _decode_stream(stream)) for x, y, stream in frames(data)]
    if not parts:
        raise ValueError("no lossless image in the file")
    out = np.zeros((height, width, 4), np.uint8)
    for x, y, part in parts:
        h, w = part.shape[:2]
        if y + h > height or x + w > width:
            raise ValueError("a frame beyond the canvas")
        out[y : y + h, x : x + w] = part
    return out


def _decode_stream(data: bytes) -> np.ndarray:
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    now, todo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == t[0] for t in todo):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.read(3) + 2
            w, h = _blocks(now, b), _blocks(height, b)
            todo.append((kind, read_pixels(bits, w, h, False).reshape(h, w), b, now))
        elif kind == SUBTRACT_GREEN:
            todo.append((kind, None, 0, now))
        else:
            n = bits.read(8) + 1
            deltas = _channels(read_pixels(bits, n, 1, False))
            todo.append((kind, _packed(np.cumsum(deltas, axis=0, dtype=np.uint8)), 0, now))
            now = _blocks(now, palette_bits(n))
    argb = read_pixels(bits, now, height, True).reshape(height, now)
    for kind, table, b, w in reversed(todo):
        if kind == PREDICTOR:
            argb = predictor(argb, table, b, True)
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, table, b, True)
        elif kind == SUBTRACT_GREEN:
            argb = subtract_green(argb, True)
        else:
            argb = from_palette(argb, table, w)
    return _channels(argb)[..., [2, 1, 0, 3]]


# Encoder


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _limited_lengths(counts: np.ndarray, most: int) -> list[int]:
    """Prefix code lengths by merging the two rarest; counts are flattened until none is too long."""
    import heapq

    counts = [int(c) for c in counts]
    while True:
        heap = [(c, [s]) for s, c in enumerate(counts) if c]
        lengths = [0] * len(counts)
        if len(heap) < 2:
            for _, (s,) in heap:
                lengths[s] = 1
            return lengths
        heapq.heapify(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[1] + b[1]:
                lengths[s] += 1
            heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
        if max(lengths) <= most:
            return lengths
        counts = [c and c // 2 + 1 for c in counts]


def _write_code(out: Writer, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for s in used:
            out.put(s, 8)
        return
    counts = np.bincount(lengths, minlength=19)
    of_lengths = _limited_lengths(counts, 7)
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(of_lengths[s], 3)
    out.put(0, 1)
    codes = codes_of(of_lengths)
    for n in lengths:
        if sum(map(bool, of_lengths)) > 1:
            out.put(codes[n], of_lengths[n])


def _prefix(value: int) -> tuple[int, int, int]:
    """The symbol of a length or distance with its extra bits and how many there are."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    half = v >> (high - 1) & 1
    return 2 * high + half, v & (1 << (high - 1)) - 1, high - 1


def _write_pixels(out: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False) -> None:
    values = argb.ravel().tolist()
    tokens, cache, at, seen = [], [None] * (1 << cache_bits), 0, {}
    while at < len(values):
        v, length, distance = values[at], 0, 0
        if copies and at and (p := seen.get(tuple(values[at : at + 3]))) is not None and at + 3 <= len(values):
            distance = at - p
            while at + length < len(values) and values[p + length] == values[at + length] and length < 4096:
                length += 1
        slot = (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            tokens.append(("copy", length, distance + len(NEAR)))
        elif cache_bits and cache[slot] == v:
            tokens.append(("cache", slot, 0))
        else:
            tokens.append(("pixel", v, 0))
        for k in range(at, at + max(1, length)):
            seen[tuple(values[k : k + 3])] = k
            if cache_bits:
                cache[(0x1E35A7BD * values[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[k]
            at += 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [np.zeros(n, int) for n in sizes]
    stream: list[list[tuple[int, int, int, int]]] = []  # (code, symbol, extra, extra bits)
    for kind, a, b in tokens:
        if kind == "pixel":
            parts = [(c, a >> s & 255, 0, 0) for c, s in enumerate((8, 16, 0, 24))]
        elif kind == "cache":
            parts = [(0, 280 + a, 0, 0)]
        else:
            (ls, le, ln), (ds, de, dn) = _prefix(a), _prefix(b)
            parts = [(0, 256 + ls, le, ln), (4, ds, de, dn)]
        for c, s, _, _ in parts:
            counts[c][s] += 1
        stream.append(parts)
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    lengths = [_limited_lengths(c, 15) for c in counts]
    for n in lengths:
        _write_code(out, n)
    codes = [codes_of(n) for n in lengths]
    plain = [sum(map(bool, n)) > 1 for n in lengths]
    for parts in stream:
        for c, s, extra, n in parts:
            if plain[c]:
                out.put(codes[c][s], lengths[c][s])
            out.put(extra, n)


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def _head(width: int, height: int) -> Writer:
    out = Writer()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    return out


def encode(rgba: np.ndarray, transforms: tuple[int, ...] = (), modes: np.ndarray | None = None, factors: np.ndarray | None = None, block_bits: int = 2, cache_bits: int = 0, copies: bool = False) -> bytes:
    """A lossless WebP file of a (height, width, 4) array, with the transforms in the order given."""
    height, width = rgba.shape[:2]
    argb, out = _packed(rgba[..., [2, 1, 0, 3]]), _head(width, height)
    for kind in transforms:
        out.put(1, 1)
        out.put(kind, 2)
        h, w = argb.shape
        if kind in (PREDICTOR, CROSS_COLOUR):
            out.put(block_bits - 2, 3)
            shape = _blocks(h, block_bits), _blocks(w, block_bits)
            table = (modes if kind == PREDICTOR else factors)[: shape[0], : shape[1]].astype(np.uint32)
            _write_pixels(out, table, shape[1], False)
            argb = (predictor if kind == PREDICTOR else cross_colour)(argb, table, block_bits, False)
        elif kind == SUBTRACT_GREEN:
            argb = subtract_green(argb, False)
        else:
            argb, palette = to_palette(argb)
            out.put(len(palette) - 1, 8)
            c = _channels(palette)
            _write_pixels(out, _packed(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(palette), False)
    out.put(0, 1)
    _write_pixels(out, argb, argb.shape[1], True, cache_bits, copies)
    return _file(out.value.to_bytes((out.n + 7) // 8, "little"))
