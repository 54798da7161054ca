"""Codecs: round trips, fixed vectors, hand-made streams for what the encoder never sends, and broken files."""

import random

import numpy as np
import pytest

from lumenmill.codec import animation, lossless, lossy
from lumenmill.codec.bits import BitReader, BitWriter, PrefixCode, code_lengths, codes_of
from lumenmill.codec.boolean import BoolDecoder, BoolEncoder
from lumenmill.codec.container import build, build_animation, chunk, parse, riff
from lumenmill.codec.errors import CodecError
from lumenmill.sources.images import SAMPLES, encode_image

RNG = np.random.default_rng(4)


def raster(h, w, n, levels=256):
    return RNG.integers(0, levels, (h, w, n), dtype=np.uint8)


@pytest.mark.parametrize("kind", sorted(SAMPLES))
@pytest.mark.parametrize("predictor", [True, False])
@pytest.mark.parametrize("shape", [(1, 1), (2, 3), (31, 40), (1, 300)])
@pytest.mark.parametrize("levels", [1, 2, 256])
def test_lossless_round_trip(kind, predictor, shape, levels):
    data = raster(*shape, SAMPLES[kind], levels)
    px, alpha = lossless.decode_stream(lossless.encode_stream(data, kind, predictor))
    assert (px == lossless.to_rgba(data, kind)).all() and alpha == (kind in ("La8", "Rgba8"))


def test_long_runs():
    data = np.zeros((100, 200, 4), np.uint8)
    assert (lossless.decode_stream(lossless.encode_stream(data, "Rgba8"))[0] == data).all()


def test_bit_reader():
    r = BitReader(bytes([0x9C, 0x41, 0xE1]))
    assert [r.read(n) for n in (3, 2, 6, 10, 3)] == [4, 3, 12, 40, 7]
    with pytest.raises(CodecError, match="BitStreamError"):
        r.read(1)


def test_prefix_codes():
    for _ in range(30):
        counts = [random.randint(0, 1000) for _ in range(random.randint(2, 60))]
        lengths = code_lengths(counts, 15)
        if sum(n > 0 for n in counts) < 2:
            assert not any(lengths)
            continue
        code, w = PrefixCode(lengths), BitWriter()
        symbols = [s for s, n in enumerate(counts) if n]
        for s in symbols:
            w.write(codes_of(lengths)[s], lengths[s])
        r = BitReader(w.done())
        assert [code.read(r) for _ in symbols] == symbols
    assert max(code_lengths([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144], 7)) <= 7
    for bad in ([0, 0], [1, 1, 1], [2, 2, 2]):
        with pytest.raises(CodecError, match="HuffmanError"):
            PrefixCode(bad)


def singles(w, *symbols):
    for s in symbols:
        lossless.write_single(w, s)


def head(width, height, alpha=1):
    w = BitWriter()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        w.write(v, n)
    return w


def test_palette_function():
    palette = np.array([(10, 20, 30, 255), (15, 25, 35, 255), (16, 26, 36, 255)], np.uint8)
    px = np.zeros((1, 2, 4), np.uint8)
    px[0, :, 1] = [0b11100100, 0b00000001]
    out = lossless.inverse_palette(px, 2, palette, 5)
    assert out.tolist() == [[[10, 20, 30, 255], [15, 25, 35, 255], [16, 26, 36, 255], [0, 0, 0, 0], [15, 25, 35, 255]]]


def test_color_cache_and_backward_reference():
    """red, green by cache, a copy of both, twice over: an overlapping copy."""
    w = head(6, 1)
    w.write(0, 1)
    w.write(1, 1)
    w.write(2, 4)  # a cache of four colors
    w.write(0, 1)
    first = (9 << 16) | (7 << 8) | 5 | 255 << 24
    slot = (first * 0x1E35A7BD & 0xFFFFFFFF) >> 30
    # Green alphabet: literal 7, length symbol 256 + 3 (four pixels), cache slot.
    lengths = [0] * 284
    lengths[7], lengths[259], lengths[280 + slot] = 1, 2, 2
    kinds = code_lengths([lengths.count(n) for n in range(16)], 7)
    w.write(0, 1)
    w.write(15, 4)
    for k in lossless.LENGTH_ORDER:
        w.write(kinds[k] if k < 16 else 0, 3)
    w.write(0, 1)
    for n in lengths:
        w.write(codes_of(kinds)[n], kinds[n])
    singles(w, 9, 5, 255, 1)  # red, blue, alpha, distance code 1: one pixel back
    codes = codes_of(lengths)
    for s in (7, 280 + slot, 259):
        w.write(codes[s], lengths[s])
    px, _ = lossless.decode_stream(w.done())
    assert px.reshape(-1, 4).tolist() == [[9, 7, 5, 255]] * 6


@pytest.mark.parametrize("mode", range(14))
def test_predictors_against_definition(mode):
    h, w = 6, 7
    res, blocks = raster(h, w, 4), np.zeros((2, 2, 4), np.uint8)
    blocks[..., 1] = mode
    got = lossless.inverse_predictor(res, 2, blocks, w)
    flat = [[0] * 4 for _ in range(h * w)]
    for i in range(h * w):
        y, x = divmod(i, w)
        at = lambda k: flat[k]
        if i == 0:
            p = [0, 0, 0, 255]
        elif y == 0:
            p = at(i - 1)
        elif x == 0:
            p = at(i - w)
        else:
            left, top, right, corner = at(i - 1), at(i - w), at(i - w + 1), at(i - w - 1)
            floor = lambda a, b: [(u + v) // 2 for u, v in zip(a, b, strict=True)]
            four = list(zip(left, top, corner, strict=True))
            clip = lambda v: max(0, min(255, v))
            near_left = sum(abs(t - c) for _, t, c in four) < sum(abs(v - c) for v, _, c in four)
            means = floor(left, top)
            p = {
                0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: floor(floor(left, right), top), 6: floor(left, corner), 7: means, 8: floor(corner, top), 9: floor(top, right),
                10: floor(floor(left, corner), floor(top, right)), 11: left if near_left else top, 12: [clip(v + t - c) for v, t, c in four],
                13: [clip(m + int((m - c) / 2)) for m, (_, _, c) in zip(means, four, strict=True)],
            }[mode]
        flat[i] = [(a + int(b)) % 256 for a, b in zip(p, res[y, x], strict=True)]
    assert got.reshape(-1, 4).tolist() == flat


def test_boolean_coder():
    assert [BoolDecoder(b"hel").bit(p) for p in (128,)] == [0]
    rng = random.Random(2)
    for _ in range(50):
        script = [(int(rng.random() < 0.3), rng.randint(1, 255)) for _ in range(rng.randint(1, 400))]
        e = BoolEncoder()
        for b, p in script:
            e.bit(b, p)
        d = BoolDecoder(e.done())
        assert [d.bit(p) for _, p in script] == [b for b, _ in script]
    e = BoolEncoder()
    for v in (0, 5, -7):
        e.optional(v, 4)
    d = BoolDecoder(e.done())
    assert [d.optional(4) for _ in range(3)] == [0, 5, -7]
    with pytest.raises(CodecError, match="NotEnoughInitData"):
        BoolDecoder(b"")


def tables():
    """Made-up probabilities: the format's own are a parameter, and encoder and decoder agree on any."""
    r = np.random.default_rng(0)
    return lossy.Tables(r.integers(60, 200, (4, 8, 3, 11)).tolist(), r.integers(200, 256, (4, 8, 3, 11)).tolist(), r.integers(60, 200, (10, 10, 9)).tolist())


@pytest.mark.parametrize("kind,shape", [("Rgb8", (16, 16)), ("Rgb8", (40, 50)), ("L8", (33, 47)), ("Rgba8", (64, 64))])
def test_lossy_round_trip(kind, shape):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    data = np.stack([(yy * 3 + xx * 2 + 40 * k) % 200 + 20 for k in range(SAMPLES[kind])], -1).astype(np.uint8)
    last = 0
    for quality in (100, 60):
        planes = lossy.decode_planes(lossy.encode(data, kind, quality, tables()), tables())
        want = lossy.to_planes(data, kind)
        err = np.abs(planes.y[: shape[0] // 2 * 2, : shape[1] // 2 * 2].astype(int) - want.y[: shape[0] // 2 * 2, : shape[1] // 2 * 2]).mean()
        assert last <= err + 1 and err < (1.5 if quality == 100 else 8)
        last = err


def test_lossy_needs_tables():
    with pytest.raises(CodecError, match="TablesMissing"):
        lossy.encode(np.zeros((4, 4, 3), np.uint8), "Rgb8", 90, None)


RED = "524946463c000000574542505650382030000000d001009d012a{n:02x}00{n:02x}0002003425a00274ba01f80003b000fef0c40bff20b96175c8d7ff203fe407fc80fff8f2000000"


@pytest.mark.parametrize("n", [2, 3])
def test_lossy_files_of_another_encoder(n):
    """Red squares that another program wrote, with the format's own tables: all pixels the same red."""
    px = animation.decode(bytes.fromhex(RED.format(n=n)))
    assert px.shape[:2] == (n, n) and len(np.unique(px.reshape(n * n, -1), axis=0)) == 1
    assert px[0, 0, 0] > 240 and px[0, 0, 1:3].max() < 16


def test_lossy_without_tables_named():
    y, x = np.mgrid[:40, :40]
    data = np.stack([4 * x, 4 * y, 2 * (x + y)], -1).astype(np.uint8)
    out = animation.decode(encode_image(data.tobytes(), 40, 40, "Rgb8", use_lossy=True, quality=95))
    assert np.abs(out[:39, :39, :3].astype(int) - data[:39, :39]).mean() < 6


def test_block_transforms():
    p = RNG.integers(-255, 256, (50, 4, 4))
    assert np.abs(lossy.idct(lossy.dct(p)) - p).max() <= 2


def test_yuv_point():
    f = lossy.Planes(1, 1, *(np.array([[v]], np.uint8) for v in (203, 40, 42)))
    assert lossy.to_rgb(f).tolist() == [[[80, 255, 40]]]


def test_blending_is_close_to_real_numbers():
    src, dst = raster(1, 4000, 4), raster(1, 4000, 4)
    got = animation.blended(src, dst).astype(float)
    s, d = src / 255.0, dst / 255.0
    a = s[..., 3:] + d[..., 3:] * (1 - s[..., 3:])
    color = np.where(a > 0, (s[..., :3] * s[..., 3:] + d[..., :3] * d[..., 3:] * (1 - s[..., 3:])) / np.maximum(a, 1e-9), 0) * 255
    seen = (a[..., 0] > 0.25) & (src[..., 3] > 0)
    assert np.abs(got[..., :3] - color)[seen].max() <= 3 and np.abs(got[..., 3] - a[..., 0] * 255).max() <= 3


@pytest.mark.parametrize("method", range(4))
def test_alpha_filters(method):
    plane = raster(9, 7, 1)[..., 0]
    out = animation.unfiltered(plane.copy(), method).astype(int)
    for y in range(9):
        for x in range(7):
            left = out[y, x - 1] if x else None
            top = out[y - 1, x] if y else None
            if method == 0 or (x == 0 and y == 0):
                p = 0
            elif method == 1:
                p = left if x else top
            elif method == 2:
                p = top if y else left
            else:
                p = left if y == 0 else top if x == 0 else min(255, max(0, left + top - out[y - 1, x - 1]))
            assert out[y, x] == (p + int(plane[y, x])) % 256


def test_container_round_trip():
    data = raster(8, 5, 4)
    file = encode_image(data.tobytes(), 5, 8, "Rgba8", icc=b"icc", exif=b"exif!", xmp=b"<x/>")
    image = parse(file)
    assert (image.kind, image.width, image.height, image.has_alpha, image.error) == ("extended", 5, 8, True, None)
    assert (animation.decode(file) == data).all()
    plain = encode_image(data[..., :3].tobytes(), 5, 8, "Rgb8")
    assert parse(plain).kind == "lossless" and (animation.decode(plain) == data[..., :3]).all()


def test_lossy_with_alpha_round_trip():
    data = raster(16, 16, 4)
    file = encode_image(data.tobytes(), 16, 16, "Rgba8", use_lossy=True, tables=tables())
    out = animation.decode(file, animation.Options(tables=tables()))
    assert parse(file).is_lossy and (out[..., 3] == data[..., 3]).all()


@pytest.mark.parametrize("size", [(16383, 0), (0, 16383), (16383, 16383)])
def test_header_limits(size):
    head_ = (size[0] | size[1] << 14).to_bytes(4, "little")
    image = parse(riff(chunk(b"VP8L", b"\x2f" + head_ + bytes(5))))
    assert (image.width, image.height) == (size[0] + 1, size[1] + 1)


@pytest.mark.parametrize(
    "data,code",
    [
        (b"", "IoError"), (b"RIFF", "IoError"), (b"RIFX" + bytes(20), "ChunkHeaderInvalid"), (b"RIFF" + bytes(4) + b"WEBX" + bytes(20), "WebpSignatureInvalid"), (riff(chunk(b"ABCD", bytes(9))), "ChunkHeaderInvalid"),
        (riff(chunk(b"VP8L", b"\x2e" + bytes(9))), "LosslessSignatureInvalid"), (riff(chunk(b"VP8L", b"\x2f" + b"\xff" * 9)), "VersionNumberInvalid"), (riff(chunk(b"VP8 ", b"\x01" + bytes(9))), "UnsupportedFeature"),
        (riff(chunk(b"VP8 ", bytes(10))), "Vp8MagicInvalid"), (riff(chunk(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + bytes(4))), "InconsistentImageSizes"), (riff(chunk(b"VP8X", bytes(10))), "ChunkMissing"),
        (riff(chunk(b"VP8X", b"\x08" + bytes(9)) + chunk(b"VP8L", bytes(4))), "ChunkMissing"),
    ],
)
def test_errors(data, code):
    assert parse(data).error == code


def test_broken_bytes_never_crash():
    file = bytearray(encode_image(raster(20, 20, 4).tobytes(), 20, 20, "Rgba8"))
    rng = random.Random(1)
    for _ in range(300):
        bad = bytearray(file[: rng.randint(0, len(file))]) if rng.random() < 0.4 else bytearray(file)
        for _ in range(rng.randint(0, 4)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            if (i := parse(bytes(bad))).width * i.height <= 1 << 20:
                animation.decode(bytes(bad))
        except CodecError:
            pass


def test_animation_clear_and_offsets():
    """The second frame lies inside; the first one asks to be cleared, so only the second shows."""
    big, small = np.full((8, 8, 4), 255, np.uint8), raster(2, 4, 4)
    enc = lambda px: chunk(b"VP8L", lossless.encode_stream(px, "Rgba8"))
    file = build_animation(
        [
            {"x": 0, "y": 0, "width": 8, "height": 8, "duration": 40, "blend": False, "dispose": True, "chunks": enc(big)},
            {"x": 2, "y": 4, "width": 4, "height": 2, "duration": 60, "blend": False, "dispose": False, "chunks": enc(small)},
        ],
        8, 8, True, loops=3,
    )
    image = parse(file)
    assert (image.num_frames, image.loop_count, image.loop_ms, image.is_animated) == (2, 3, 100, True)
    shown = list(animation.frames(file))
    assert [d for _, d in shown] == [40, 60] and (shown[0][0] == 255).all()
    want = np.zeros((8, 8, 4), np.uint8)
    want[4:6, 2:6] = small
    assert (shown[1][0] == want).all()
    assert (animation.decode(file) == shown[0][0]).all()


def test_opaque_frame_on_alpha_canvas():
    canvas = np.full((4, 4, 4), 0xAA, np.uint8)
    animation.composite(canvas, animation.Frame(0, 0, 0, True, False, np.full((2, 2, 3), 0xFF, np.uint8), False), (0, 0, 0, 0), (2, 2, 2, 2))
    assert (canvas[:2, :2] == 255).all() and (canvas[2:, 2:] == 0).all() and (canvas[:2, 2:] == 0xAA).all()


def test_build_is_even():
    assert len(build(b"VP8L", b"abc", 1, 1, False)) % 2 == 0
