"""Whole images: stills and animations, from container bytes to pixels.

Frames decode independently; only compositing is in order, as a fold over one canvas (numpy).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from . import lossless, lossy
from .container import Image, chunk_at, little, parse
from .errors import CodecError

MAX_SIDE = 16384
OPAQUE = 255


@dataclass(frozen=True)
class Options:
    """``upsampling``: bilinear or simple. ``background``: what cleared canvas shows, RGBA, in place of transparency. ``tables``: see ``lossy``."""

    upsampling: str = "bilinear"
    background: tuple[int, int, int, int] | None = None
    tables: lossy.Tables | None = lossy.STANDARD


@dataclass
class Frame:
    x: int
    y: int
    duration: int
    blend: bool
    dispose: bool
    pixels: np.ndarray
    alpha: bool


def with_alpha(rgb: np.ndarray, data: bytes) -> np.ndarray:
    """RGBA of a lossy frame and its alpha chunk."""
    return np.concatenate([rgb, alpha_plane(data, rgb.shape[1], rgb.shape[0])[..., None]], -1)


def alpha_plane(data: bytes, width: int, height: int) -> np.ndarray:
    """The alpha samples of an alpha chunk, filter undone."""
    info = little(data, 0, 1)
    if info >> 4 & 3 > 1:
        raise CodecError("InvalidAlphaPreprocessing")
    if info & 3 > 1:
        raise CodecError("InvalidCompressionMethod")
    if info & 3:
        plane = lossless.decode_stream(data[1:], width, height, headless=True)[0][..., 1].copy()
    else:
        if len(data) - 1 < width * height:
            raise CodecError("IoError", "end of file")
        plane = np.frombuffer(data, np.uint8, width * height, 1).reshape(height, width).copy()
    return unfiltered(plane, info >> 2 & 3)


def unfiltered(plane: np.ndarray, method: int) -> np.ndarray:
    """Undoes filter 0 none, 1 horizontal, 2 vertical, 3 gradient. The first two are prefix sums modulo 256."""
    if method == 0:
        return plane
    total = lambda a, axis: np.cumsum(a.astype(np.int64), axis=axis).astype(np.uint8)
    if method == 1:
        plane[:, 0] = total(plane[:, 0], 0)
        return total(plane, 1)
    plane[0] = total(plane[0], 0)
    if method == 2:
        return total(plane, 0)
    rows = plane.tolist()
    for y in range(1, len(rows)):
        above, row = rows[y - 1], rows[y]
        left = row[0] = (row[0] + above[0]) & 255
        for x in range(1, len(row)):
            left = row[x] = (row[x] + max(0, min(255, left + above[x] - above[x - 1]))) & 255
    return np.array(rows, np.uint8).reshape(plane.shape)


def blended(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """``src`` over ``dst`` (RGBA, not premultiplied) in exact integers."""
    s, d = src.astype(np.int64), dst.astype(np.int64)
    sa = s[..., 3:]
    v = d[..., 3:] * (255 - sa) + 128
    under = ((v >> 8) + v) >> 8
    alpha = sa + under
    scale = (1 << 24) // np.maximum(alpha, 1)
    color = (s[..., :3] * sa + d[..., :3] * under) * scale >> 24 & 255
    return np.where(sa == 0, d, np.concatenate([color, alpha], -1)).astype(np.uint8)


def composite(canvas: np.ndarray, frame: Frame, clear: tuple | None, previous: tuple[int, int, int, int]) -> None:
    """Draws a frame on the canvas in place. ``previous``: x, y, width, height of the frame before, which ``clear`` fills first."""
    height, width = canvas.shape[:2]
    h, w = frame.pixels.shape[:2]
    whole = (frame.x, frame.y, w, h) == (0, 0, width, height)
    px = frame.pixels if frame.alpha else np.concatenate([frame.pixels[..., :3], np.full((h, w, 1), OPAQUE, np.uint8)], -1)
    if whole and not frame.blend:
        canvas[:] = px
        return
    if clear is not None:
        x, y, pw, ph = (0, 0, width, height) if whole else previous
        canvas[y : y + ph, x : x + pw] = clear
    part = canvas[frame.y : frame.y + h, frame.x : frame.x + w]
    px = px[: part.shape[0], : part.shape[1]]
    part[:] = blended(px, part) if frame.alpha and frame.blend else px


def read_frame(data: bytes, image: Image, at: int, size: int, options: Options) -> Frame:
    """The frame whose header is at ``at``."""
    if size < 32:
        raise CodecError("ChunkHeaderInvalid", "ANMF")
    x, y, w, h, duration = (little(data, at + 3 * k, 3) for k in range(5))
    x, y, w, h = 2 * x, 2 * y, w + 1, h + 1
    if max(w, h) > MAX_SIDE:
        raise CodecError("ImageTooLarge")
    if x + w > image.width or y + h > image.height:
        raise CodecError("FrameOutsideImage")
    info = little(data, at + 15, 1)
    name, n, even = chunk_at(data, at + 16)
    body = at + 24
    if even + 24 > size:
        raise CodecError("ChunkHeaderInvalid", name.hex())
    alpha = True
    if name == b"VP8L":
        px = lossless.decode_stream(data[body : body + n], w, h)[0]
    elif name == b"VP8 ":
        px, alpha = lossy.decode_rgb(data[body : body + n], options.tables, options.upsampling), False
    elif name == b"ALPH":
        if even + 32 > size:
            raise CodecError("ChunkHeaderInvalid", name.hex())
        next_name, next_n, _ = chunk_at(data, body + even)
        if n + next_n + 32 > size:
            raise CodecError("ChunkHeaderInvalid", next_name.hex())
        rgb = lossy.decode_rgb(data[body + even + 8 : body + even + 8 + next_n], options.tables, options.upsampling)
        px = with_alpha(rgb, data[body : body + n])
    else:
        raise CodecError("ChunkHeaderInvalid", name.hex())
    if px.shape[:2] != (h, w):
        raise CodecError("InconsistentImageSizes")
    return Frame(x, y, duration, not info & 2, bool(info & 1), px, alpha)


def frames(data: bytes, options: Options = Options()) -> Iterator[tuple[np.ndarray, int]]:
    """(canvas, duration) after each frame of an animation."""
    image = parse(data)
    if image.error:
        raise CodecError(image.error, image.detail)
    if not image.is_animated:
        raise CodecError("InvalidParameter", "not an animation")
    canvas = np.zeros((image.height, image.width, 4), np.uint8)
    if options.background is not None:
        canvas[:] = options.background
    dispose, previous = True, (0, 0, 0, 0)
    for at, size in image.frames:
        f = read_frame(data, image, at, size, options)
        clear = None
        if dispose:
            clear = options.background if options.background is not None else (0, 0, 0, 0) if f.alpha else None
        composite(canvas, f, clear, previous)
        previous, dispose = (f.x, f.y, f.pixels.shape[1], f.pixels.shape[0]), f.dispose
        yield (canvas if image.has_alpha else canvas[..., :3]).copy(), f.duration


def decode(data: bytes, options: Options = Options()) -> np.ndarray:
    """Pixels of a still image or of an animation's first frame: RGBA if it has alpha, else RGB."""
    image = parse(data)
    if image.error:
        raise CodecError(image.error, image.detail)
    if image.is_animated:
        return next(frames(data, options))[0]
    if b"VP8L" in image.chunks:
        at, end = image.chunks[b"VP8L"]
        px = lossless.decode_stream(data[at:end], image.width, image.height)[0]
        return px if image.has_alpha else px[..., :3]
    at, end = image.chunks[b"VP8 "]
    rgb = lossy.decode_rgb(data[at:end], options.tables, options.upsampling)
    if rgb.shape[:2] != (image.height, image.width):
        raise CodecError("InconsistentImageSizes")
    if not image.has_alpha:
        return rgb
    if b"ALPH" not in image.chunks:
        raise CodecError("ChunkMissing")
    at, end = image.chunks[b"ALPH"]
    return with_alpha(rgb, data[at:end])
