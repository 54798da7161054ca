"""The RIFF container: chunk table, headers, and a writer.

``parse`` never fails: what is wrong with a file is in ``error`` and ``detail``, so that bad rows
can be set aside without stopping a job. A size field in front is not enforced; the scan ends where
the bytes end. The first chunk of each known kind counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import CodecError

# The chunk names of the format.
KNOWN = (b"RIFF", b"WEBP", b"VP8 ", b"VP8L", b"VP8X", b"ANIM", b"ANMF", b"ALPH", b"ICCP", b"EXIF", b"XMP ")
FRAME_MARK = b"\x9d\x01\x2a"


@dataclass
class Image:
    """What the header and the chunk table tell of a file. Ranges are (start, end) of a chunk's contents."""

    kind: str | None = None
    width: int = 0
    height: int = 0
    has_alpha: bool = False
    is_lossy: bool = False
    is_animated: bool = False
    num_frames: int = 0
    loop_count: int | None = 1
    loop_ms: int = 0
    background: bytes | None = None
    flags: int = 0
    chunks: dict[bytes, tuple[int, int]] = field(default_factory=dict)
    frames: list[tuple[int, int]] = field(default_factory=list)
    error: str | None = None
    detail: str = ""

    @property
    def buffer_size(self) -> int:
        return self.width * self.height * (4 if self.has_alpha else 3)


def little(data: bytes, at: int, n: int) -> int:
    if at + n > len(data):
        raise CodecError("IoError", "end of file")
    return int.from_bytes(data[at : at + n], "little")


def chunk_at(data: bytes, at: int) -> tuple[bytes, int, int]:
    """Name, size and even size of the chunk whose header is at ``at``."""
    if at + 8 > len(data):
        raise CodecError("IoError", "end of file")
    size = little(data, at + 4, 4)
    return data[at : at + 4], size, min(size + (size & 1), 0xFFFFFFFF)


def scan(data: bytes, at: int, limit: int):
    """(name, start, size) of the chunks from ``at`` on; ends where the bytes do."""
    while at < limit:
        try:
            name, size, even = chunk_at(data, at)
        except CodecError:
            return
        yield name, at + 8, size
        at += 8 + even


def parse(data: bytes) -> Image:
    image = Image()
    try:
        _parse(data, image)
    except CodecError as e:
        image.error, image.detail = e.code, e.detail
    return image


def _parse(data: bytes, image: Image) -> None:
    name, riff_size, _ = chunk_at(data, 0)
    if name != b"RIFF":
        raise CodecError("ChunkHeaderInvalid", "RIFF")
    little(data, 8, 4)
    if data[8:12] != b"WEBP":
        raise CodecError("WebpSignatureInvalid", data[8:12].hex())
    name, size, even = chunk_at(data, 12)
    start = 20
    if name == b"VP8 ":
        if little(data, start, 3) & 1:
            raise CodecError("UnsupportedFeature", "frames that are no keyframes")
        little(data, start + 3, 3)
        if data[start + 3 : start + 6] != FRAME_MARK:
            raise CodecError("Vp8MagicInvalid", data[start + 3 : start + 6].hex())
        image.width, image.height = little(data, start + 6, 2) & 0x3FFF, little(data, start + 8, 2) & 0x3FFF
        if not image.width or not image.height:
            raise CodecError("InconsistentImageSizes")
        image.kind, image.is_lossy, image.chunks = "lossy", True, {name: (start, start + size)}
    elif name == b"VP8L":
        if (mark := little(data, start, 1)) != 0x2F:
            raise CodecError("LosslessSignatureInvalid", str(mark))
        head = little(data, start + 1, 4)
        if head >> 29:
            raise CodecError("VersionNumberInvalid", str(head >> 29))
        image.width, image.height = (head & 0x3FFF) + 1, (head >> 14 & 0x3FFF) + 1
        image.kind, image.has_alpha, image.chunks = "lossless", bool(head >> 28 & 1), {name: (start, start + size)}
    elif name == b"VP8X":
        _extended(data, image, start, even, riff_size)
    else:
        raise CodecError("ChunkHeaderInvalid", name.hex())


def _extended(data: bytes, image: Image, start: int, even: int, riff_size: int) -> None:
    flags = little(data, start, 1)
    image.width, image.height = little(data, start + 4, 3) + 1, little(data, start + 7, 3) + 1
    if image.width * image.height > 0xFFFFFFFF:
        raise CodecError("ImageTooLarge")
    exif, xmp, animated = flags >> 3 & 1, flags >> 2 & 1, flags >> 1 & 1
    image.flags, image.background = flags, bytes(4)
    lossy_frame = False
    for name, at, size in scan(data, start + even, start + even + max(riff_size - 12, 0)):
        if name in KNOWN:
            image.chunks.setdefault(name, (at, at + size))
        if name == b"ANMF":
            image.num_frames += 1
            if size < 24:
                raise CodecError("InvalidChunkSize")
            try:
                image.loop_ms += little(data, at + 12, 4) & 0xFFFFFF
                if not lossy_frame:
                    lossy_frame = chunk_at(data, at + 16)[0] in (b"VP8 ", b"ALPH")
            except CodecError:
                break
            image.frames.append((at, size))
    have = image.chunks.keys()
    image.is_lossy = lossy_frame or b"VP8 " in have
    if (animated and not (b"ANIM" in have and b"ANMF" in have)) or (exif and b"EXIF" not in have) or (xmp and b"XMP " not in have) or (not animated and (b"VP8 " in have) == (b"VP8L" in have)):
        raise CodecError("ChunkMissing")
    if animated:
        at, end = image.chunks[b"ANIM"]
        if end - at > 6:
            raise CodecError("InvalidChunkSize")
        if end - at < 6 or end > len(data):
            raise CodecError("IoError", "end of file")
        image.background = data[at : at + 4]
        image.loop_count = little(data, at + 4, 2) or None  # None: for ever
        image.is_animated = True
    if b"ANMF" in have:
        at, end = image.chunks[b"ANMF"]
        at += 16
        for _ in range(2):
            name, size, even = chunk_at(data, at)
            image.chunks.setdefault(name, (at + 8, at + 8 + size))
            at += 8 + even
            if at + 8 > end:
                break
    image.has_alpha, image.kind = bool(flags >> 4 & 1), "extended"


def payload(data: bytes, image: Image, name: bytes, limit: int | None = None) -> bytes | None:
    """A chunk's contents; None without it. More than ``limit`` bytes are an error."""
    if name not in image.chunks:
        return None
    at, end = image.chunks[name]
    if limit is not None and end - at > limit:
        raise CodecError("MemoryLimitExceeded")
    if end > len(data):
        raise CodecError("IoError", "end of file")
    return data[at:end]


def chunk(name: bytes, data: bytes) -> bytes:
    return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def riff(chunks: bytes) -> bytes:
    return chunk(b"RIFF", b"WEBP" + chunks)


def build(frame_name: bytes, frame: bytes, width: int, height: int, alpha: bool, alpha_chunk: bytes | None = None, icc: bytes = b"", exif: bytes = b"", xmp: bytes = b"") -> bytes:
    """A still image: the simple form if there is nothing but the frame, else the extended one."""
    body = chunk(frame_name, frame)
    if not (icc or exif or xmp or alpha_chunk is not None):
        return riff(body)
    flags = bool(xmp) << 2 | bool(exif) << 3 | alpha << 4 | bool(icc) << 5
    head = bytes([flags, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    parts = [chunk(b"VP8X", head), chunk(b"ICCP", icc) if icc else b"", chunk(b"ALPH", alpha_chunk) if alpha_chunk is not None else b"", body]
    return riff(b"".join([*parts, chunk(b"EXIF", exif) if exif else b"", chunk(b"XMP ", xmp) if xmp else b""]))


def build_animation(frames: list[dict], width: int, height: int, alpha: bool, loops: int = 0, background: bytes = bytes(4)) -> bytes:
    """An animation of encoded frames (chunks, x, y, width, height, duration, blend, dispose), for fixtures and tests."""
    three = lambda v: v.to_bytes(3, "little")
    out = chunk(b"VP8X", bytes([alpha << 4 | 2, 0, 0, 0]) + three(width - 1) + three(height - 1)) + chunk(b"ANIM", background + loops.to_bytes(2, "little"))
    for f in frames:
        head = three(f["x"] // 2) + three(f["y"] // 2) + three(f["width"] - 1) + three(f["height"] - 1) + three(f["duration"]) + bytes([(not f["blend"]) << 1 | f["dispose"]])
        out += chunk(b"ANMF", head + f["chunks"])
    return riff(out)
