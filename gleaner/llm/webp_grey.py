"""Many grey lossless WebP images at once: bytes as pixels, one frame of a bounded size after another.

A payload's bytes are the grey values of an image ``WIDTH`` pixels wide.  Green holds the value; red and blue are
what subtract-green makes of it, so their codes have one symbol and take no bits.  A frame is cut at spaces; a part that
occurred before in its frame is a back-reference; of the rest, a value is a literal when its frame has it first and a place in
the colour cache from then on.  Every frame has prefix codes of its own counts.
A payload of more than one frame is an animation whose frames lie one below the other on the canvas.

``encode_many`` and ``decode_many`` go through all frames of a block in step: each numpy operation does one symbol, or one
table entry, of every frame.  Frames that other writers made, with a cache, other transforms or several groups of codes, are
left to ``webp.decode``; so are those whose cache has another size, or is asked for what it doesn't hold.
"""

from __future__ import annotations

import struct

import numpy as np

from gleaner.llm import webp

WIDTH = 64
#: Bytes of a frame; also the most that one back-reference can reach, or twice what it can be long.
FRAME = 8192
LONGEST = 4096
#: A part shorter than this is cheaper as literals.
LEAST_COPY = 5
_LITERALS, _FAR = 280, 40
_CAP = 13


def _prefix_tables(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra bits' value, how many extra bits) of every length or distance code up to ``most``."""
    found = [(0, 0, 0)] + [webp._prefix(v) for v in range(1, most + 1)]
    return tuple(np.array(c, np.int64) for c in zip(*found, strict=True))


_LENGTHS, _FARS = _prefix_tables(LONGEST), _prefix_tables(FRAME + len(webp.NEAR))


def _symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """(least value, extra bits) of every length or distance symbol."""
    extra = np.array([0 if s < 4 else (s - 2) >> 1 for s in range(_FAR)], np.int64)
    return np.array([s + 1 if s < 4 else ((2 + (s & 1)) << e) + 1 for s, e in enumerate(extra.tolist())], np.int64), extra


_BASES, _EXTRAS = _symbol_tables()
_ODD = 0x9E3779B97F4A7C15


def _cache() -> tuple[int, np.ndarray, np.ndarray]:
    """(bits of the smallest cache in which every grey has a place of its own, each grey's place, each place's grey or -1)."""
    coded = np.arange(256, dtype=np.uint64) << np.uint64(8) | np.uint64(0xFF000000)
    hashed = coded * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)
    for bits in range(8, 12):
        place = (hashed >> np.uint64(32 - bits)).astype(np.int64)
        if len(np.unique(place)) == 256:
            grey = np.full(1 << bits, -1, np.int64)
            grey[place] = np.arange(256)
            return bits, place, grey
    raise AssertionError("greys share a place in every cache")


_CACHE_BITS, _PLACES, _GREYS = _cache()
_GREEN = _LITERALS + len(_GREYS)
#: Green symbols as the reader takes them: the low byte is a grey, a place in the cache has 256 more, a length is 512 and more.
_KINDS = np.r_[np.arange(256), 512 + np.arange(_LITERALS - 256), 256 + np.maximum(_GREYS, 0)]

# The code of code lengths, the same for every frame: thirteen symbols of four bits and six of five, a complete code.
_OF_LENGTHS = [4] * 13 + [5] * 6
_OF_CODES = [webp.codes_of(_OF_LENGTHS)[s] for s in range(19)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete prefix code lengths for every row of counts; a row with one symbol or none has none.

    Each length begins at the ceiling of its symbol's information; what room that leaves is given to the symbols in the
    order of their counts, until none is left.
    """
    every = np.asarray(counts, np.int64)
    used = np.flatnonzero(every.any(axis=0))  # of a cache's places most are never used
    counts = every[:, used]
    kinds = (counts > 0).sum(axis=1)
    order = np.argsort(-counts, axis=1, kind="stable")[:, : max(1, int(kinds.max(initial=1)))]
    c = np.take_along_axis(counts, order, 1)
    there = c > 0
    total = c.sum(axis=1, keepdims=True)
    c = np.where(there, c + (total >> (_CAP - 2)), 0)  # no symbol is so rare that its code is beyond the cap
    with np.errstate(divide="ignore"):
        n = np.where(there, np.ceil(np.log2(c.sum(axis=1, keepdims=True) / np.maximum(c, 1)) - 1e-12), 0).astype(np.int64)
    n = np.where(there, np.clip(n, 1, 15), 0)
    unit = np.where(there, np.int64(1) << (15 - n), 0)
    left = (1 << 15) - unit.sum(axis=1)
    many = kinds > 1
    while (left[many] > 0).any():
        for k in range(n.shape[1]):
            grow = many & there[:, k] & (unit[:, k] <= left) & (n[:, k] > 1)
            left -= np.where(grow, unit[:, k], 0)
            unit[:, k] <<= grow
            n[:, k] -= grow
    found = np.zeros(counts.shape, np.int64)
    np.put_along_axis(found, order, np.where(many[:, None], n, 0), 1)
    out = np.zeros(every.shape, np.int64)
    out[:, used] = found
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of every row of lengths, first bit in the lowest place."""
    every, used = lengths, np.flatnonzero(lengths.any(axis=0))
    lengths = every[:, used]
    f, m = lengths.shape
    per = np.stack([(lengths == n).sum(axis=1) for n in range(16)], axis=1)
    first, code = np.zeros((f, 16), np.int64), np.zeros(f, np.int64)
    for n in range(1, 16):
        code = (code + (per[:, n - 1] if n > 1 else 0)) << 1
        first[:, n] = code
    rank = np.zeros((f, m), np.int64)
    for n in range(1, 16):
        at = lengths == n
        rank += np.where(at, np.cumsum(at, axis=1) - 1, 0)
    code = np.take_along_axis(first, lengths, 1) + rank
    out = np.zeros_like(code)
    for b in range(15):
        out |= (code >> b & 1) << np.maximum(lengths - 1 - b, 0)
    codes = np.zeros(every.shape, np.int64)
    codes[:, used] = np.where(lengths > 0, out, 0)
    return codes


def _copies(data: np.ndarray, begins: np.ndarray, frame_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where a back-reference begins, its length, its distance): parts between spaces that their frame had before."""
    inside = np.arange(len(data)) - begins[frame_of]
    cut = np.r_[True, data[:-1] == 32] | (inside % LONGEST == 0)
    at = np.flatnonzero(cut)
    size = np.diff(np.r_[at, len(data)])
    with np.errstate(over="ignore"):
        odd = np.uint64(_ODD)
        inverse = np.uint64(pow(_ODD, -1, 1 << 64))
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, len(data) - 1), odd)])
        sums = np.r_[np.uint64(0), np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * power)]
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, len(data) - 1), inverse)])
        key = (sums[at + size] - sums[at]) * back[at]
        key = (key ^ key >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + frame_of[at].astype(np.uint64) * odd + size.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero((key[order][1:] == key[order][:-1])) + 1
    now, before = order[same], order[same - 1]
    keep = (size[now] >= LEAST_COPY) & (size[now] == size[before]) & (frame_of[at[now]] == frame_of[at[before]])
    now, before = now[keep], before[keep]
    n = size[now]
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    equal = data[np.repeat(at[now], n) + step] == data[np.repeat(at[before], n) + step]
    if len(now):
        whole = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        now, before = now[whole], before[whole]
    order = np.argsort(now)
    now, before = now[order], before[order]
    start, far = at[now], at[now] - at[before]
    # parts that go on at the same distance are one, but for its longest
    joined = np.r_[False, (now[1:] == now[:-1] + 1) & (far[1:] == far[:-1]) & (inside[start[1:]] % LONGEST != 0)] if len(now) else np.zeros(0, bool)
    head = np.flatnonzero(~joined)
    ends = start + size[now]
    return start[head], ends[np.r_[head[1:] - 1, len(now) - 1]] - start[head] if len(head) else start[head], far[head]


def _header_tokens(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frame, bits, how many) of the lengths of every frame's code, in order; runs of zeros are counted."""
    f, m = lengths.shape
    flat = lengths.ravel()
    place = np.flatnonzero(flat)
    value, n = np.array(_OF_CODES, np.int64)[flat[place]], np.array(_OF_LENGTHS, np.int64)[flat[place]]
    zero = np.r_[False, flat == 0, False]
    edge = np.zeros(len(flat) + 1, bool)
    edge[::m] = True
    begin = np.flatnonzero(zero[1:] & (~zero[:-1] | edge))
    end = np.flatnonzero(zero[:-1] & (~zero[1:] | edge))
    run = end - begin
    parts = [(place, value, n)]
    for k in range(-(-m // 138)):
        here = run > 138 * k
        b, r = begin[here] + 138 * k, np.minimum(run[here] - 138 * k, 138)
        kind = np.where(r >= 11, 18, np.where(r >= 3, 17, 0))
        code, bits = np.array(_OF_CODES, np.int64)[kind], np.array(_OF_LENGTHS, np.int64)[kind]
        extra, more = np.where(r >= 11, r - 11, np.where(r >= 3, r - 3, np.where(r == 2, code, 0))), np.where(r >= 11, 7, np.where(r >= 3, 3, np.where(r == 2, bits, 0)))
        parts.append((b, code | extra << bits, bits + more))
    place, value, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(place)
    return place[order] // m, value[order], n[order]


def _normal_code_start() -> int:
    out = webp.Writer()
    out.put(0, 1)
    out.put(15, 4)
    for s in webp.LENGTH_ORDER:
        out.put(_OF_LENGTHS[s], 3)
    return out.value  # of 62 bits; the bit after it says that all lengths follow


def frames_of(n: int) -> list[int]:
    """The sizes of a payload's frames."""
    return [FRAME] * (n // FRAME) + ([n % FRAME] if n % FRAME else [])


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload, whose length must be a positive multiple of ``WIDTH``."""
    if not payloads:
        return []
    sizes = [frames_of(len(p)) for p in payloads]
    if any(not s or s[-1] % WIDTH for s in sizes):
        raise ValueError(f"payloads must be whole rows of {WIDTH} bytes")
    data = np.frombuffer(b"".join(payloads), np.uint8)
    size = np.array([n for s in sizes for n in s], np.int64)
    begins, f = np.cumsum(size) - size, len(size)
    frame_of = np.repeat(np.arange(f), size)
    start, length, far = _copies(data, begins, frame_of)
    inner = np.zeros(len(data) + 1, np.int32)
    inner[start] += 1
    inner[start + length] -= 1
    covered = np.cumsum(inner[:-1]) > 0
    first = np.zeros(len(data), bool)
    first[start] = True
    at = np.flatnonzero(~covered | first)
    is_copy, frame = first[at], frame_of[at]
    green = data[at].astype(np.int64)
    # a grey's first pixel in its frame is a literal always, since a back-reference has what was there before
    grey, place = frame_of * 256 + data, np.arange(len(data))
    begun = np.zeros(f * 256, np.int64)
    begun[grey[::-1]] = place[::-1]
    cached = ~is_copy & (begun[grey[at]] != at)
    green[cached] = _LITERALS + _PLACES[green[cached]]
    green[is_copy] = 256 + _LENGTHS[0][length]
    far_code = far + len(webp.NEAR)
    counts = np.bincount(frame * _GREEN + green, minlength=f * _GREEN).reshape(f, _GREEN)
    far_counts = np.bincount(frame[is_copy] * _FAR + _FARS[0][far_code], minlength=f * _FAR).reshape(f, _FAR)
    lengths, far_lengths = code_lengths(counts), code_lengths(far_counts)
    codes, far_codes = canonical(lengths), canonical(far_lengths)
    value, bits = codes[frame, green], lengths[frame, green]
    c, cf = np.flatnonzero(is_copy), frame[is_copy]
    for v, n in ((_LENGTHS[1][length], _LENGTHS[2][length]), (far_codes[cf, _FARS[0][far_code]], far_lengths[cf, _FARS[0][far_code]]), (_FARS[1][far_code], _FARS[2][far_code])):
        value[c] |= v << bits[c]
        bits[c] += n
    every = np.arange(f)
    head = 0x2F | (WIDTH - 1) << 8 | (size // WIDTH - 1) << 22 | 1 << 36 | 0b101 << 40 | (1 | _CACHE_BITS << 1) << 44  # alpha, version 0; subtract green, no more; cache, one group
    one = lambda lens, cnt: (lens.max(axis=1) == 0, np.argmax(cnt, axis=1))
    pieces = [(every, head, np.full(f, 50))]
    for lens, cnt, after in ((lengths, counts, True), (far_lengths, far_counts, False)):
        single, symbol = one(lens, cnt)
        wide = single & (symbol > 1)
        # one symbol: a short code; it is a literal or a near symbol, so eight bits hold it
        short = 1 | wide << 2 | symbol << 3
        pieces.append((every, np.where(single, short, _normal_code_start()), np.where(single, np.where(wide, 11, 4), 62)))
        which, v, n = _header_tokens(lens)
        many = ~single[which]
        pieces.append((every[~single], np.zeros((~single).sum(), np.int64), np.ones((~single).sum(), np.int64)))
        pieces.append((which[many], v[many], n[many]))
        if after:  # red and blue have the symbol 0, alpha 255
            pieces.append((every, np.full(f, 1 | 1 << 4 | 0b101 << 8 | 255 << 11), np.full(f, 19)))
    pieces.append((frame, value, bits))
    owner, value, bits = (np.concatenate(x) for x in zip(*pieces, strict=True))
    order = np.argsort(owner, kind="stable")
    owner, value, bits = owner[order], value[order].astype(np.uint64), bits[order]
    total = np.bincount(owner, bits, f).astype(np.int64)
    words = -(-total // 64) + 1
    base = (np.cumsum(words) - words) * 64
    offset = np.cumsum(bits) - bits
    offset += (base - (np.cumsum(total) - total))[owner]
    word, shift = offset >> 6, (offset & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[new]] = np.bitwise_or.reduceat(value << shift, new)
    over = np.flatnonzero((shift.astype(np.int64) + bits > 64))
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    raw = out.astype("<u8").tobytes()
    streams = [raw[b // 8 : b // 8 + (t + 7) // 8] for b, t in zip(base.tolist(), total.tolist(), strict=True)]
    made, k = [], 0
    for s in sizes:
        made.append(webp._file(streams[k]) if len(s) == 1 else _animation(streams[k : k + len(s)], s))
        k += len(s)
    return made


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _animation(streams: list[bytes], sizes: list[int]) -> bytes:
    """Frames one below the other on one canvas."""
    three = lambda v: v.to_bytes(3, "little")
    parts = [_chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + three(WIDTH - 1) + three(sum(sizes) // WIDTH - 1)), _chunk(b"ANIM", bytes(6))]
    y = 0
    for stream, n in zip(streams, sizes, strict=True):
        parts.append(_chunk(b"ANMF", three(0) + three(y // 2) + three(WIDTH - 1) + three(n // WIDTH - 1) + three(0) + b"\2" + _chunk(b"VP8L", stream)))
        y += n // WIDTH
    body = b"WEBP" + b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class _Frame:
    """What a grey frame's head says; None in ``codes`` if it is of another kind."""

    def __init__(self, data: bytes):
        bits = webp.Bits(data)
        if bits.read(8) != 0x2F:
            raise ValueError("no lossless signature")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        self.codes = None
        if bits.read(3) or bits.read(4) != 0b0101:
            return
        cache = bits.read(4) if bits.read(1) else 0
        if cache not in (0, _CACHE_BITS) or bits.read(1):
            return
        codes = [webp.read_code(bits, n) for n in (_GREEN if cache else _LITERALS, 256, 256, 256, _FAR)]
        if [c.only for c in codes[1:4]] == [0, 0, 255]:
            self.codes, self.at = (codes[0], codes[4]), bits.at


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The grey values of each file, as (height, width) arrays; for a file that isn't grey, its red ones."""
    out: list[np.ndarray | None] = [None] * len(files)
    lanes: list[tuple[int, int, _Frame, bytes]] = []  # file, where in it, head, stream
    n = 0
    begins = []
    for k, file in enumerate(files):
        parts = list(webp.frames(file))
        heads = [_Frame(stream) for _, _, stream in parts]
        width, height = webp.canvas(file)
        ys = np.cumsum([0, *(h.height for h in heads)]).tolist()
        if any(h.codes is None or h.width != width or h.width * h.height > FRAME for h in heads) or [(x, y) for x, y, _ in parts] != [(0, y) for y in ys[:-1]] or ys[-1] != height:
            out[k] = webp.decode(file)[..., 0]
            begins.append(-1)
            continue
        begins.append(n)
        for head, (_, _, stream) in zip(heads, parts, strict=True):
            lanes.append((n, n + head.width * head.height, head, stream))
            n += head.width * head.height
    grey, odd = _in_step(lanes, n)
    for k, b in enumerate(begins):
        if b >= 0:
            width, height = webp.canvas(files[k])
            plain = not any(b <= place < b + width * height for place in odd)
            out[k] = grey[b : b + width * height].reshape(height, width) if plain else webp.decode(files[k])[..., 0]
    return out


def _tables(codes: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all entries symbol << 4 | bits, where each code's begin, its mask)."""
    parts, masks = [], []
    for c in codes:
        if c.only is not None:
            parts.append(np.array([c.only << 4], np.int64))
        else:
            parts.append(c.table)
        masks.append(len(parts[-1]) - 1)
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts, dtype=np.uint16, casting="unsafe"), np.cumsum(sizes) - sizes, np.array(masks, np.int64)


def _in_step(lanes: list, n: int) -> tuple[np.ndarray, list[int]]:
    """(the grey values of all frames, where frames begin whose cache is asked for what it doesn't hold)."""
    out = np.zeros(n, np.uint8)
    if not lanes:
        return out, []
    streams = [s for _, _, _, s in lanes]
    buffer = b"".join(streams) + bytes(16)
    window = np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))
    sizes = np.array([len(s) for s in streams], np.int64)
    starts = (np.cumsum(sizes) - sizes) * 8
    bit = starts + np.array([h.at for _, _, h, _ in lanes], np.int64)
    limit = starts + sizes * 8
    at, begin, end = (np.array([x[k] for x in lanes], np.int64) for k in (0, 0, 1))
    green, base, mask = _tables([h.codes[0] for _, _, h, _ in lanes])
    far, far_base, far_mask = _tables([h.codes[1] for _, _, h, _ in lanes])
    near = np.array([max(1, dx + dy * WIDTH) for dx, dy in webp.NEAR], np.int64)
    widths = np.array([h.width for _, _, h, _ in lanes], np.int64)
    copies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    literal = np.zeros(n, bool)
    while len(at):
        w = (window[bit >> 3] >> (bit & 7).astype(np.uint64)).astype(np.int64)  # 57 bits at least are the stream's
        e = green[base + (w & mask)]
        used, s = (e & 15).astype(np.int64), _KINDS[e >> 4]
        out[at] = s  # the low byte; where a back-reference begins, it comes later
        new = np.flatnonzero(s < 256)
        if len(new):
            literal[at[new]] = True
        copy = np.flatnonzero(s >= 512)
        if len(copy):
            v = w[copy] >> used[copy]
            ls = s[copy] - 512
            length = _BASES[ls] + (v & (1 << _EXTRAS[ls]) - 1)
            v >>= _EXTRAS[ls]
            e = far[far_base[copy] + (v & far_mask[copy])]
            v >>= e & 15
            ds = (e >> 4).astype(np.int64)
            code = _BASES[ds] + (v & (1 << _EXTRAS[ds]) - 1)
            used[copy] += _EXTRAS[ls] + (e & 15) + _EXTRAS[ds]
            distance = code - len(near)
            close = distance <= 0
            if close.any():
                k = code[close] - 1
                distance[close] = np.where(widths[copy][close] == WIDTH, near[k], [max(1, webp.NEAR[i][0] + webp.NEAR[i][1] * x) for i, x in zip(k.tolist(), widths[copy][close].tolist(), strict=True)])
            if (distance > at[copy] - begin[copy]).any() or (length > end[copy] - at[copy]).any() or (used[copy] > 57).any():
                raise ValueError("back-reference beyond the image")
            copies.append((at[copy].copy(), length, distance))
            at[copy] += length - 1
        at += 1
        bit += used
        going = at < end
        if not going.all():
            if (bit > limit).any():
                raise ValueError("image data is cut short")
            at, begin, end, bit, limit, base, mask, far_base, far_mask, widths = (x[going] for x in (at, begin, end, bit, limit, base, mask, far_base, far_mask, widths))
    if copies:
        place, length, distance = (np.concatenate(c) for c in zip(*copies, strict=True))
        total = int(length.sum())
        spot = np.repeat(place - (np.cumsum(length) - length), length) + np.arange(total)
        source = np.arange(n)
        source[spot] = spot - np.repeat(distance, length)
        # each goes to where its source came from, until all are literals
        while True:
            further = source[source[spot]]
            if np.array_equal(further, source[spot]):
                break
            source[spot] = further
        out[spot] = out[source[spot]]
    # a cache has what it is asked for if each grey's first pixel in its frame is a literal
    begins = np.array([x[0] for x in lanes], np.int64)
    frame = np.repeat(np.arange(len(lanes)), np.diff(np.r_[begins, n]))
    grey = frame * 256 + out
    first = np.full(len(lanes) * 256, -1, np.int64)
    first[grey[::-1]] = np.arange(n)[::-1]
    first = first[first >= 0]
    return out, begins[np.unique(frame[first[~literal[first]]])].tolist()
