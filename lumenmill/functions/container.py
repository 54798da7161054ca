"""Container headers as column expressions over BINARY content: only a prefix of the file is looked at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little(content: Column, at: int | Column, n: int) -> Column:
    """Unsigned little-endian integer of n bytes (BIGINT); null past the end."""
    start = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(content, start + 1, F.lit(n)))
    swapped = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))])
    return F.when(F.length(content) >= start + n, F.conv(swapped, 16, 10).cast("long"))


def name_at(content: Column, at: int) -> Column:
    return F.decode(F.substring(content, at + 1, 4), "ISO-8859-1")


def sent(value: Column, n: int) -> Column:
    """n little-endian bytes of a number."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))]))


def chunk(name: str | Column, payload: Column) -> Column:
    """A chunk: name, size, contents, padded to an even number of bytes."""
    size = F.length(payload).cast("long")
    return F.concat(F.encode(F.lit(name) if isinstance(name, str) else name, "UTF-8"), sent(size, 4), payload, F.when(size % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))


def riff(chunks: Column) -> Column:
    return chunk("RIFF", F.concat(F.encode(F.lit("WEBP"), "UTF-8"), chunks))


def bit(x: Column, n: int) -> Column:
    return F.shiftright(x, n) % 2


def fields(content: Column) -> Column:
    """What ``header`` looks at, as one struct. Projected before the header is judged, each field is read from the bytes once."""
    at = {"size": F.length(content), "outer": name_at(content, 0), "form": name_at(content, 8), "first": name_at(content, 12), "mark": F.hex(F.substring(content, 24, 3))}
    numbers = {"byte20": (20, 1), "head21": (21, 4), "at24": (24, 3), "at26": (26, 2), "at27": (27, 3), "at28": (28, 2)}
    return F.struct(*[c.alias(k) for k, c in at.items()], *[little(content, *place).alias(k) for k, place in numbers.items()])


def header(f: Column) -> dict[str, Column]:
    """kind, width, height, has_alpha and error_code (null if the header is sound) of a file, given its ``fields``."""
    lossy, plain, extended = (f["first"] == n for n in ("VP8 ", "VP8L", "VP8X"))
    head, size = f["head21"], f["size"]
    w16, h16 = f["at26"] % 16384, f["at28"] % 16384
    width = F.when(lossy, w16).when(plain, head % 16384 + 1).when(extended, f["at24"] + 1)
    height = F.when(lossy, h16).when(plain, F.shiftright(head, 14) % 16384 + 1).when(extended, f["at27"] + 1)
    alpha = F.when(plain, F.shiftright(head, 28) % 2).when(extended, F.shiftright(f["byte20"], 4) % 2).otherwise(0)
    error = (
        F.when(size < 8, "IoError").when(f["outer"] != "RIFF", "ChunkHeaderInvalid")
        .when(size < 12, "IoError").when(f["form"] != "WEBP", "WebpSignatureInvalid")
        .when(size < 20, "IoError").when(~(lossy | plain | extended), "ChunkHeaderInvalid")
        .when(size < F.when(plain, 25).otherwise(30), "IoError")
        .when(lossy & (f["byte20"] % 2 == 1), "UnsupportedFeature").when(lossy & (f["mark"] != "9D012A"), "Vp8MagicInvalid")
        .when(lossy & ((w16 == 0) | (h16 == 0)), "InconsistentImageSizes")
        .when(plain & (f["byte20"] != 47), "LosslessSignatureInvalid").when(plain & (F.shiftright(head, 29) != 0), "VersionNumberInvalid")
        .when(extended & (width * height > 4294967295), "ImageTooLarge")
    )
    kind = F.when(lossy, "lossy").when(plain, "lossless").when(extended, "extended")
    return {"kind": kind, "width": width, "height": height, "has_alpha": alpha, "error_code": error}


def buffer_size(width: Column, height: Column, has_alpha: Column) -> Column:
    return width * height * F.when(has_alpha == 1, 4).otherwise(3)


def reduced_size(size: Column, bits: Column) -> Column:
    """Ceiling of size / 2 ** bits."""
    return F.ceil(size / F.pow(F.lit(2), bits)).cast("long")


def frame_header(content: Column) -> dict[str, Column]:
    """Fields at the start of an animation frame's contents."""
    info = little(content, 15, 1)
    return {"x": 2 * little(content, 0, 3), "y": 2 * little(content, 3, 3), "width": little(content, 6, 3) + 1, "height": little(content, 9, 3) + 1, "duration": little(content, 12, 3), "blend": 1 - bit(info, 1), "dispose": bit(info, 0)}


def loop_header(content: Column) -> dict[str, Column]:
    """Background hint (its four bytes) and loop count (null: for ever) of an animation's header."""
    return {"background": F.substring(content, 1, 4), "loops": F.nullif(little(content, 4, 2), F.lit(0))}


def feature_flags(content: Column) -> dict[str, Column]:
    """The five flags of an extended header's first byte."""
    flags = little(content, 0, 1)
    return {name: bit(flags, n) for name, n in (("icc", 5), ("alpha", 4), ("exif", 3), ("xmp", 2), ("animation", 1))}
