"""The lossless codec (VP8L streams): decoding of all features, and an encoder with subtract-green, an optional prediction from above, runs and prefix codes.

Pixels are numpy arrays (height, width, 4) of RGBA bytes. Transforms that touch whole rows are
vectorised; recurrences that average or clamp go pixel by pixel.
"""

from __future__ import annotations

from array import array

import numpy as np

from ..functions.pixel import distance_map
from .bits import BitReader, BitWriter, PrefixCode, code_lengths, codes_of
from .errors import CodecError

# The order in which lengths of code lengths are sent, and the alphabets of the five codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (280, 256, 256, 256, 40)
SIGNATURE, MAX_SIDE = 0x2F, 16384
NEAR = distance_map()


def reduced(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


# --- decoding -------------------------------------------------------------------------------


def read_lengths(r: BitReader, meta: list[int], n: int) -> list[int]:
    code = PrefixCode(meta)
    left = n
    if r.read(1):
        left = 2 + r.read(2 + 2 * r.read(3))
        if left > n:
            raise CodecError("BitStreamError")
    out: list[int] = []
    last = 8
    while len(out) < n and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            out.append(s)
            last = s or last
        else:
            bits, base, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
            out += [value] * (base + r.read(bits))
            if len(out) > n:
                raise CodecError("BitStreamError")
    return out + [0] * (n - len(out))


def read_code(r: BitReader, alphabet: int) -> PrefixCode:
    if r.read(1):
        two = r.read(1)
        symbols = [r.read(8 if r.read(1) else 1)]
        if two:
            symbols.append(r.read(8))
        if max(symbols) >= alphabet:
            raise CodecError("BitStreamError")
        return PrefixCode.of(*symbols)
    meta = [0] * 19
    for k in LENGTH_ORDER[: 4 + r.read(4)]:
        meta[k] = r.read(3)
    return PrefixCode(read_lengths(r, meta, alphabet))


def read_cache_bits(r: BitReader) -> int:
    if not r.read(1):
        return 0
    bits = r.read(4)
    if not 1 <= bits <= 11:
        raise CodecError("InvalidColorCacheBits", str(bits))
    return bits


def prefixed(r: BitReader, code: int) -> int:
    """A length or distance from its prefix code."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + r.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def read_image(r: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as (n, 4) RGBA. ``main``: the image proper, which may have several groups of codes."""
    cache_bits = read_cache_bits(r)
    groups, where, block = 1, None, 0
    if main and r.read(1):
        block = r.read(3) + 2
        wide = reduced(width, block)
        which = read_image(r, wide, reduced(height, block), False).astype(np.int64)
        where = (which[:, 0] * 256 + which[:, 1]).tolist()
        groups = max(where) + 1
    sizes = [ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), *ALPHABETS[1:]]
    codes = [[read_code(r, n) for n in sizes] for _ in range(groups)]
    total = width * height
    out = array("I")  # a pixel is one number, alpha highest and red lowest, so its bytes in memory are RGBA
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    group = codes[0]

    def remember(px):
        argb = px & 0xFF00FF00 | (px & 255) << 16 | px >> 16 & 255
        cache[(argb * 0x1E35A7BD & 0xFFFFFFFF) >> shift] = px

    while len(out) < total:
        at = len(out)
        if where is not None:
            group = codes[where[(at // width >> block) * wide + (at % width >> block)]]
        green, red, blue, alpha, far = group
        if cache is None and where is None and all(c.single is not None for c in group[:4]) and green.single < 256:
            out.extend(array("I", [red.single | green.single << 8 | blue.single << 16 | alpha.single << 24]) * (total - at))
            break
        s = green.read(r)
        if s < 256:
            px = red.read(r) | s << 8 | blue.read(r) << 16 | alpha.read(r) << 24
            out.append(px)
            if cache is not None:
                remember(px)
        elif s < 280:
            n = prefixed(r, s - 256)
            back = distance(prefixed(r, far.read(r)), width)
            if back > at or n > total - at:
                raise CodecError("BitStreamError")
            if back >= n:
                new = out[at - back : at - back + n]
            else:  # the copy reaches into itself: it repeats with that period
                period = out[at - back :]
                new = (period * (n // back + 1))[:n]
            out.extend(new)
            if cache is not None:
                for px in new:
                    remember(px)
        else:
            if cache is None or s - 280 >= len(cache):
                raise CodecError("BitStreamError")
            px = cache[s - 280]
            out.append(px)
            remember(px)
    return np.array(out, "<u4").view(np.uint8).reshape(-1, 4)


def decode_stream(data: bytes, width: int | None = None, height: int | None = None, headless: bool = False) -> tuple[np.ndarray, bool]:
    """Pixels (height, width, 4) and whether the header says that alpha is used. ``headless`` streams take the given size."""
    r = BitReader(data)
    alpha = True
    if not headless:
        if r.read(8) != SIGNATURE:
            raise CodecError("LosslessSignatureInvalid")
        w, h = r.read(14) + 1, r.read(14) + 1
        alpha = bool(r.read(1))
        if version := r.read(3):
            raise CodecError("VersionNumberInvalid", str(version))
        if (width is not None and width != w) or (height is not None and height != h):
            raise CodecError("InconsistentImageSizes")
        width, height = w, h
    transforms: list[tuple] = []
    coded = width
    while r.read(1):
        kind = r.read(2)
        if kind in [t[0] for t in transforms]:
            raise CodecError("TransformError")
        if kind in (0, 1):
            bits = r.read(3) + 2
            wide = reduced(coded, bits)
            transforms.append((kind, bits, read_image(r, wide, reduced(height, bits), False).reshape(-1, wide, 4), coded))
        elif kind == 2:
            transforms.append((kind,))
        else:
            n = r.read(8) + 1
            palette = np.cumsum(read_image(r, n, 1, False).astype(np.int64), axis=0).astype(np.uint8)
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, bits, palette, coded))
            coded = reduced(coded, bits)
    px = read_image(r, coded, height, True).reshape(height, coded, 4)
    for t in reversed(transforms):
        px = (inverse_predictor, inverse_color, inverse_green, inverse_palette)[t[0]](px, *t[1:])
    return np.ascontiguousarray(px), alpha


def inverse_green(px: np.ndarray) -> np.ndarray:
    px = px.copy()
    px[..., 0] += px[..., 1]
    px[..., 2] += px[..., 1]
    return px


def inverse_palette(px: np.ndarray, bits: int, palette: np.ndarray, width: int) -> np.ndarray:
    table = np.zeros((256, 4), np.uint8)
    table[: len(palette)] = palette
    index = px[..., 1]
    if bits:
        per, size = 1 << bits, 8 >> bits
        index = (index[..., None] >> (np.arange(per) * size).astype(np.uint8)) & np.uint8((1 << size) - 1)
        index = index.reshape(len(px), -1)[:, :width]
    return table[index]


def inverse_color(px: np.ndarray, bits: int, blocks: np.ndarray, width: int) -> np.ndarray:
    y, x = np.indices(px.shape[:2])
    mult = blocks[y >> bits, x >> bits].view(np.int8).astype(np.int64)  # stored as r2b, g2b, g2r in R, G, B
    byte = px.view(np.int8).astype(np.int64)
    out = px.copy()
    red = px[..., 0] + (mult[..., 2] * byte[..., 1] >> 5)
    out[..., 0] = red & 255
    signed = ((red & 255) + 128) % 256 - 128
    out[..., 2] = (px[..., 2] + (mult[..., 1] * byte[..., 1] >> 5) + (mult[..., 0] * signed >> 5)) & 255
    return out


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _toward_zero_half(v: int) -> int:
    return v // 2 if v >= 0 else -(-v // 2)


def predicted(mode: int, left, top, right, corner) -> list[int]:
    """The prediction of a pixel from its left, top, top right and top left neighbours."""
    pairs = zip(left, top, right, corner, strict=True)
    if mode == 5:
        return [((a + c >> 1) + b) >> 1 for a, b, c, _ in pairs]
    if mode == 6:
        return [a + d >> 1 for a, _, _, d in pairs]
    if mode == 7:
        return [a + b >> 1 for a, b, _, _ in pairs]
    if mode == 10:
        return [(a + d >> 1) + (b + c >> 1) >> 1 for a, b, c, d in pairs]
    if mode == 11:
        to_left = sum(abs(b - d) for b, d in zip(top, corner, strict=True))
        to_top = sum(abs(a - d) for a, d in zip(left, corner, strict=True))
        return list(left) if to_left < to_top else list(top)
    if mode == 12:
        return [_clamp(a + b - d) for a, b, _, d in pairs]
    if mode == 13:
        return [_clamp(m + _toward_zero_half(m - d)) for m, d in ((a + b >> 1, d) for a, b, _, d in pairs)]
    raise AssertionError(mode)


def inverse_predictor(px: np.ndarray, bits: int, blocks: np.ndarray, width: int) -> np.ndarray:
    out = px.copy()
    out[0, :1, 3] += 255
    out[0] = np.cumsum(out[0].astype(np.int64), axis=0).astype(np.uint8)
    out[:, 0] = np.cumsum(out[:, 0].astype(np.int64), axis=0).astype(np.uint8)
    for y in range(1, len(out)):
        row, above = out[y], out[y - 1]
        for b in range(blocks.shape[1]):
            x0, x1 = max(1, b << bits), min(width, (b + 1) << bits)
            if x0 >= x1:
                continue
            mode = int(blocks[y >> bits, b, 1])
            part = slice(x0, x1)
            if mode == 0:
                row[part, 3] += 255
            elif mode == 1:
                row[part] = (np.cumsum(row[part].astype(np.int64), axis=0) + row[x0 - 1]).astype(np.uint8)
            elif mode == 2:
                row[part] += above[part]
            elif mode in (3, 9):
                right = np.concatenate([above[x0 + 1 : x1 + 1], row[:1]])[: x1 - x0]  # past the last pixel: the row's own first
                row[part] += right if mode == 3 else ((above[part].astype(np.int64) + right) >> 1).astype(np.uint8)
            elif mode == 4:
                row[part] += above[x0 - 1 : x1 - 1]
            elif mode == 8:
                row[part] += ((above[x0 - 1 : x1 - 1].astype(np.int64) + above[part]) >> 1).astype(np.uint8)
            elif mode < 14:
                left = row[x0 - 1].tolist()
                tops, new = above[x0 - 1 : x1 + 1].tolist(), row[part].tolist()
                if x1 == width:
                    tops.append(row[0].tolist())
                for k in range(x1 - x0):
                    left = [(v + p) & 255 for v, p in zip(new[k], predicted(mode, left, tops[k + 1], tops[k + 2], tops[k]), strict=True)]
                    new[k] = left
                row[part] = new
    return out


# --- encoding -------------------------------------------------------------------------------


def to_rgba(data: np.ndarray, kind: str) -> np.ndarray:
    """L8, La8, Rgb8 or Rgba8 samples (height, width, n) as RGBA."""
    n = {"L8": 1, "La8": 2, "Rgb8": 3, "Rgba8": 4}[kind]
    if data.shape[-1] != n:
        raise CodecError("InvalidParameter", f"{kind} has {n} samples a pixel")
    gray = kind in ("L8", "La8")
    color = np.repeat(data[..., :1], 3, axis=-1) if gray else data[..., :3]
    alpha = data[..., -1:] if n in (2, 4) else np.full((*data.shape[:2], 1), 255, np.uint8)
    return np.ascontiguousarray(np.concatenate([color, alpha], axis=-1), dtype=np.uint8)


def length_symbol(n: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their value for a run of n pixels."""
    if n <= 4:
        return n - 1, 0, 0
    top = (n - 1).bit_length() - 1
    extra = top - 1
    return 2 * top + ((n - 1) >> extra & 1), extra, (n - 1) & ((1 << extra) - 1)


def write_single(w: BitWriter, symbol: int) -> None:
    w.write(1, 2)
    w.write(symbol > 1, 1)
    w.write(symbol, 8 if symbol > 1 else 1)


def write_code(w: BitWriter, counts: list[int]) -> tuple[list[int], list[int]]:
    """Sends a code for these counts: lengths and codes."""
    lengths = code_lengths(counts, 15)
    if not any(lengths):
        write_single(w, next((s for s, n in enumerate(counts) if n), 0))
        return lengths, [0] * len(counts)
    kinds = [lengths.count(n) for n in range(16)]
    meta = code_lengths(kinds, 7)
    alone = not any(meta)
    w.write(0, 1)
    w.write(15, 4)
    for k in LENGTH_ORDER:
        w.write(0 if k > 15 or not kinds[k] else 1 if alone else meta[k], 3)
    w.write(0, 1)
    if not alone:
        sent = codes_of(meta)
        for n in lengths:
            w.write(sent[n], meta[n])
    return lengths, codes_of(lengths)


def encode_stream(data: np.ndarray, kind: str, predictor: bool = True, headless: bool = False) -> bytes:
    """A stream for samples (height, width, n) of the color type ``kind``."""
    h, w_ = data.shape[:2]
    if not (1 <= w_ <= MAX_SIDE and 1 <= h <= MAX_SIDE):
        raise CodecError("InvalidDimensions")
    w = BitWriter()
    alpha, color = kind in ("La8", "Rgba8"), kind in ("Rgb8", "Rgba8")
    if not headless:
        for value, n in ((SIGNATURE, 8), (w_ - 1, 14), (h - 1, 14), (alpha, 1), (0, 3)):
            w.write(int(value), n)
    w.write(0b101, 3)  # subtract green
    if predictor:
        w.write(0b111001, 6)  # prediction in squares of 512
        w.write(0, 1)
        for mode in (2, 0, 0, 0, 0):
            write_single(w, mode)
    w.write(0, 3)  # no more transforms, no color cache, one group of codes
    px = to_rgba(data, kind)
    px[..., 0] -= px[..., 1]
    px[..., 2] -= px[..., 1]
    if predictor:
        px[1:] -= px[:-1].copy()
        px[0, 1:] -= px[0, :-1].copy()
        px[0, :1, 3] -= 255
    flat = px.reshape(-1, 4)
    same = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]).any(1)]))
    length = np.diff(np.append(same, len(flat)))
    literals, repeats = [], []  # a literal, then up to 4096 repeats of it
    for at, n in zip(same.tolist(), length.tolist(), strict=True):
        px4 = flat[at].tolist()
        while n > 0:
            m = min(n - 1, 4096)
            literals.append(px4)
            repeats.append(m)
            n -= m + 1
    lit = np.array(literals)
    symbols = {m: length_symbol(m) for m in set(repeats) if m}
    green = np.bincount(lit[:, 1], minlength=280)
    for m in repeats:
        if m:
            green[256 + symbols[m][0]] += 1
    one = lambda k: np.bincount(lit[:, k], minlength=256).tolist()
    g_len, g_code = write_code(w, green.tolist())
    none = ([0] * 256, [0] * 256)
    if color:
        r, b = write_code(w, one(0)), write_code(w, one(2))
    else:
        r = b = none
        write_single(w, 0)
        write_single(w, 0)
    a = none
    if alpha:
        a = write_code(w, one(3))
    else:
        write_single(w, 0 if predictor else 255)
    write_single(w, 1)  # distance code 1 is a distance of one: the pixel on the left
    for (pr, pg, pb, pa), m in zip(literals, repeats, strict=True):
        w.write(g_code[pg], g_len[pg])
        w.write(r[1][pr], r[0][pr])
        w.write(b[1][pb], b[0][pb])
        w.write(a[1][pa], a[0][pa])
        if m:
            s, extra, value = symbols[m]
            w.write(g_code[256 + s], g_len[256 + s])
            w.write(value, extra)
    return w.done()
