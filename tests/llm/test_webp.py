import numpy as np
import pytest

from gleaner.llm import webp, webp_grey


def image(rng, h, w, colours=None):
    if colours:
        return rng.integers(0, 256, (colours, 4), dtype=np.uint8)[rng.integers(0, colours, (h, w))]
    base = np.linspace(0, 255, w)[None, :, None] + rng.integers(0, 9, (h, w, 4))
    return base.astype(np.uint8)


@pytest.mark.parametrize("size", [(1, 1), (1, 7), (5, 3), (9, 17)])
@pytest.mark.parametrize(
    "options",
    [
        {},
        {"cache_bits": 4},
        {"copies": True},
        {"copies": True, "cache_bits": 7},
        {"transforms": (webp.SUBTRACT_GREEN,)},
        {"transforms": (webp.PREDICTOR,)},
        {"transforms": (webp.CROSS_COLOUR,)},
        {"transforms": (webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN), "copies": True},
    ],
)
def test_round_trip(size, options):
    rng = np.random.default_rng(3)
    modes = rng.integers(0, 14, (9, 9)).astype(np.uint32) << 8 | 0xFF000000
    factors = rng.integers(0, 1 << 24, (9, 9)).astype(np.uint32) | 0xFF000000
    for colours in (None, 3):
        x = image(rng, *size, colours)
        assert np.array_equal(webp.decode(webp.encode(x, modes=modes, factors=factors, **options)), x)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(colours):
    x = image(np.random.default_rng(colours), 11, 23, colours)
    assert np.array_equal(webp.decode(webp.encode(x, (webp.PALETTE,), copies=True)), x)


def test_every_predictor_by_hand():
    left, top, top_right, top_left = [10, 20, 30, 40], [50, 60, 70, 80], [9, 8, 7, 6], [100, 0, 255, 3]
    assert webp.predict(0, left, top, top_right, top_left) == [0, 0, 0, 255]
    assert [webp.predict(k, left, top, top_right, top_left) for k in (1, 2, 3, 4)] == [left, top, top_right, top_left]
    assert webp.predict(7, left, top, top_right, top_left) == [30, 40, 50, 60]
    assert webp.predict(12, left, top, top_right, top_left) == [0, 80, 0, 117]
    assert webp.predict(13, left, top, top_right, top_left) == [0, 60, 0, 88]


def payloads():
    rng = np.random.default_rng(11)
    words = [bytes(rng.integers(97, 123, int(n), dtype=np.uint8)) for n in rng.integers(1, 12, 60)]
    text = lambda n: b" ".join(words[k] for k in rng.integers(0, 60, n))
    raw = [b"", b"a", b"ab" * 40, b"the the the " * 16, bytes(range(256)) * 4, rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), b"x" * 20_000, *(text(int(n)) for n in rng.integers(1, 6000, 12)), b"y" * 5000 + b" " + b"y" * 5000]
    return [p + bytes(-len(p) % 64 or (0 if p else 64)) for p in raw]


def test_grey_images_in_step_and_one_by_one():
    made = webp_grey.encode_many(payloads())
    for p, file, pixels in zip(payloads(), made, webp_grey.decode_many(made), strict=True):
        assert pixels.shape == (len(p) // 64, 64) and pixels.tobytes() == p
        plain = webp.decode(file)
        assert plain[..., 0].tobytes() == plain[..., 1].tobytes() == plain[..., 2].tobytes() == p and (plain[..., 3] == 255).all()
        assert file == webp_grey.encode_many([p])[0]  # whatever else is in the block
    sizes = [(len(m), len(p)) for m, p in zip(made, payloads(), strict=True) if len(p) > 2000]
    assert sum(m for m, _ in sizes) < 0.8 * sum(p for _, p in sizes)


def test_grey_images_go_through_the_cache(monkeypatch):
    """Of the pixels that aren't copied, a grey's first in its frame is a literal and the others are places in the cache."""
    found = []
    read = webp.PrefixCode.read
    monkeypatch.setattr(webp.PrefixCode, "read", lambda self, bits: (found.append(s := read(self, bits)), s)[1])
    payload = b"abcabdxyzw" * 6 + b"pqrs"
    (file,) = webp_grey.encode_many([payload])
    found.clear()
    assert webp.decode(file)[..., 1].tobytes() == payload
    assert sum(s >= 280 for s in found) >= 40


def test_cache_asked_for_what_it_lacks():
    """A frame whose first symbol is a place in the cache: black, without a literal before it."""
    out = webp._head(64, 1)
    for value, n in ((0b0101, 4), (1, 1), (webp_grey._CACHE_BITS, 4), (0, 1)):
        out.put(value, n)
    lengths = [0] * webp_grey._GREEN
    lengths[97] = lengths[280 + int(webp_grey._PLACES[97])] = 1
    webp._write_code(out, lengths)
    for symbol in (0, 0, 255, 0):
        webp._write_code(out, [int(k == symbol) for k in range(256)])
    out.put(1, 64)
    file = webp._file(out.value.to_bytes((out.n + 7) // 8, "little"))
    want = webp.decode(file)[..., 0]
    assert want[0, 0] == 0 and want[0, 1] == 97
    got = webp_grey.decode_many([webp_grey.encode_many([b"k" * 64])[0], file])
    assert got[0].tobytes() == b"k" * 64 and np.array_equal(got[1], want)


def test_grey_reader_takes_other_images():
    rng = np.random.default_rng(13)
    others = [image(rng, 5, 7), image(rng, 9, 64, 3)]
    files = [webp.encode(others[0], (webp.SUBTRACT_GREEN,), copies=True, cache_bits=3), webp.encode(others[1], (webp.PALETTE,), copies=True)]
    got = webp_grey.decode_many([files[0], webp_grey.encode_many([bytes(64)])[0], files[1]])
    assert np.array_equal(got[0], others[0][..., 0]) and not got[1].any() and np.array_equal(got[2], others[1][..., 0])


def test_code_lengths_are_complete():
    rng = np.random.default_rng(14)
    counts = (rng.zipf(1.4, (300, 280)) * (rng.random((300, 280)) < rng.random((300, 1)))).clip(0, 8192)
    counts[0], counts[1, :], counts[1, 5], counts[2, :], counts[2, :2] = 0, 0, 9, 0, (1, 8191)
    lengths = webp_grey.code_lengths(counts)
    room = np.where(lengths > 0, 2.0**-lengths, 0).sum(axis=1)
    many = (counts > 0).sum(axis=1) > 1
    assert (room[many] == 1).all() and (room[~many] == 0).all() and lengths.max() <= 15
    assert ((lengths > 0) == (counts > 0))[many].all()
    for row, codes in zip(lengths[many][:50], webp_grey.canonical(lengths)[many][:50], strict=True):
        assert {s: int(codes[s]) for s in np.flatnonzero(row).tolist()} == webp.codes_of(row.tolist())


def test_groups_of_codes():
    """A stream written by hand: an image of 4 x 8 pixels whose upper and lower halves have codes of their own."""
    out = webp._head(4, 8)
    out.put(0, 1)  # no transform
    out.put(0, 1)  # no cache
    out.put(1, 1)  # groups, of blocks of 4 x 4 pixels
    out.put(0, 3)
    out.put(0, 1)  # the image of groups has no cache; 1 x 2 pixels, green 0 and 1
    put = lambda *symbols: [out.put(v, n) for v, n in ((1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols))]
    for symbols in ((0, 1), (0,), (0,), (255,), (0,)):
        put(*symbols)
    out.put(0b10, 2)
    for green in ((7, 9), (100, 200)):
        for symbols in (green, (1,), (2,), (255,), (0,)):
            put(*symbols)
    bits = np.random.default_rng(1).integers(0, 2, 32)
    for b in bits.tolist():
        out.put(b, 1)
    file = webp._file(out.value.to_bytes((out.n + 7) // 8, "little"))
    want = np.where(np.arange(32) < 16, np.where(bits, 9, 7), np.where(bits, 200, 100)).reshape(8, 4)
    got = webp.decode(file)
    assert np.array_equal(got[..., 1], want) and (got[..., 0] == 1).all() and (got[..., 2] == 2).all()
    assert np.array_equal(webp_grey.decode_many([file])[0], got[..., 0])


def test_cut_short_grey_images():
    (good,) = webp_grey.encode_many([payloads()[9]])
    for bad in (good[:60], good[: len(good) // 2], good[:-40]):
        with pytest.raises((ValueError, IndexError)):
            webp_grey.decode_many([bad])


def test_bad_files():
    good = webp.encode(image(np.random.default_rng(0), 4, 4))
    for bad in (b"", b"RIFF", good[:30], good.replace(b"VP8L", b"VP8X")):
        with pytest.raises((ValueError, IndexError)):
            webp.decode(bad)
