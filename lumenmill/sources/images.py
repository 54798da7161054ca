"""Images as rows: readers, the chunk table, metadata, decoding, encoding and a file sink.

One image is one row with its bytes; a codec call touches one row, so images spread over all tasks
and a bad one costs only its own row (``error_code``). Nothing here shuffles but ``first_chunks``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..codec import lossless, lossy
from ..codec.animation import Options, decode, frames
from ..codec.container import build, parse, payload, scan
from ..codec.errors import CodecError
from ..functions import container as C

SOURCE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
METADATA = (
    "kind string, width int, height int, has_alpha boolean, is_lossy boolean, is_animated boolean, num_frames int, loop_count int, loop_duration_ms long, "
    "background_hint binary, buffer_size long, icc binary, exif binary, xmp binary, error_code string, error_detail string"
)


def read_images(spark: SparkSession, path: str, pattern: str = "*.webp") -> DataFrame:
    """Files below ``path``; Spark's own reader, so any file system that it knows will do. Unused content is not read."""
    return spark.read.format("binaryFile").schema(SOURCE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def stream_images(spark: SparkSession, path: str, pattern: str = "*.webp") -> DataFrame:
    """New files as a stream."""
    return spark.readStream.format("binaryFile").schema(SOURCE_SCHEMA).option("pathGlobFilter", pattern).load(path)


def with_header(images: DataFrame) -> DataFrame:
    """Adds kind, width, height, has_alpha and error_code, by column expressions."""
    read = images.withColumn("_fields", C.fields(F.col("content")))
    return read.withColumns(C.header(F.col("_fields"))).drop("_fields")


PART_ROWS, PART_BYTES = 64, 16 << 20


def _parts(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Lists of consecutive rows, of a bounded number and size."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(part) >= PART_ROWS or size >= PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _per_row(images: DataFrame, key: str, schema: str, rows) -> DataFrame:
    """``rows(content)`` gives tuples for ``schema``; each gets its image's key."""
    kind = images.select(key).schema[0].dataType.simpleString()
    full = f"{key} {kind}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_schema  # only the shape of the result is needed on the driver
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                # A long animation is never held whole: what it gives goes on after PART_ROWS rows or PART_BYTES of pixels.
                for part in _parts(rows(content.as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), arrow.field(0).type), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(zip(*part, strict=True)))], schema=arrow)

    return images.select(key, "content").mapInArrow(run, full)


def chunk_table(images: DataFrame, key: str = "path") -> DataFrame:
    """key, ordinal, parent (null at the top), fourcc, start, size, size_rounded of every chunk, known or not."""

    def rows(content: bytes | None):
        data, n = content or b"", 0
        for name, at, size in scan(data, 12, len(data)):
            yield n, None, name.decode("latin-1"), at, size, size + (size & 1)
            parent, n = n, n + 1
            if name == b"ANMF":
                for sub, sub_at, sub_size in scan(data, at + 16, min(at + size, len(data))):
                    yield n, parent, sub.decode("latin-1"), sub_at, sub_size, sub_size + (sub_size & 1)
                    n += 1

    return _per_row(images, key, "ordinal int, parent int, fourcc string, start long, size long, size_rounded long", rows)


def first_chunks(chunks: DataFrame, key: str = "path") -> DataFrame:
    """The first chunk of each kind: a partial aggregate, then one row for each image and kind."""
    return chunks.groupBy(key, "fourcc").agg(F.min_by(F.struct("start", "size"), "ordinal").alias("c")).select(key, "fourcc", "c.start", "c.size")


def metadata(images: DataFrame, key: str = "path", memory_limit: int | None = None) -> DataFrame:
    """One row of METADATA for each image; loop_count null: for ever. Profiles longer than ``memory_limit`` are an error."""

    def rows(content: bytes | None):
        data = content or b""
        image = parse(data)
        blobs: list[bytes | None] = [None] * 3
        if image.error is None:
            try:
                blobs = [payload(data, image, n, memory_limit) for n in (b"ICCP", b"EXIF", b"XMP ")]
            except CodecError as e:
                image.error, image.detail = e.code, e.detail
        yield (image.kind, image.width, image.height, image.has_alpha, image.is_lossy, image.is_animated, image.num_frames if image.is_animated else 0, image.loop_count, image.loop_ms, image.background, image.buffer_size, *blobs, image.error, image.detail)

    return _per_row(images, key, METADATA, rows)


def decode_images(images: DataFrame, options: Options = Options(), key: str = "path") -> DataFrame:
    """key, width, height, bpp (3 or 4), pixels (row by row), error_code, error_detail. Animations give their first frame."""

    def rows(content: bytes | None):
        try:
            px = decode(content or b"", options)
            yield px.shape[1], px.shape[0], px.shape[2], np.ascontiguousarray(px).tobytes(), None, None
        except CodecError as e:
            yield None, None, None, None, e.code, e.detail

    return _per_row(images, key, "width int, height int, bpp int, pixels binary, error_code string, error_detail string", rows)


def decode_vp8(frames: DataFrame, options: Options = Options(), key: str = "path") -> DataFrame:
    """As ``decode_images``, for rows whose content is a bare VP8 keyframe without a container."""

    def rows(content: bytes | None):
        try:
            px = lossy.decode_rgb(content or b"", options.tables, options.upsampling)
            yield px.shape[1], px.shape[0], px.shape[2], np.ascontiguousarray(px).tobytes(), None, None
        except CodecError as e:
            yield None, None, None, None, e.code, e.detail

    return _per_row(frames, key, "width int, height int, bpp int, pixels binary, error_code string, error_detail string", rows)


def decode_frames(images: DataFrame, options: Options = Options(), key: str = "path") -> DataFrame:
    """key, frame_no (from 0), duration_ms, width, height, bpp, pixels of the composited canvas after each frame; a fault ends an animation with a row that names it."""

    def rows(content: bytes | None):
        n = 0
        try:
            for px, duration in frames(content or b"", options):
                yield n, duration, px.shape[1], px.shape[0], px.shape[2], np.ascontiguousarray(px).tobytes(), None
                n += 1
        except CodecError as e:
            yield n, None, None, None, None, None, e.code

    return _per_row(images, key, "frame_no int, duration_ms int, width int, height int, bpp int, pixels binary, error_code string", rows)


SAMPLES = {"L8": 1, "La8": 2, "Rgb8": 3, "Rgba8": 4}


def encode_image(data: bytes, width: int, height: int, color: str, use_predictor: bool = True, use_lossy: bool = False, quality: int = 95, tables: lossy.Tables | None = lossy.STANDARD, icc: bytes = b"", exif: bytes = b"", xmp: bytes = b"") -> bytes:
    """A file for raw samples of a color type."""
    if color not in SAMPLES or len(data) != width * height * SAMPLES[color]:
        raise CodecError("InvalidParameter", "samples do not fit the size and color type")
    if not width or not height:
        raise CodecError("InvalidDimensions")
    px = np.frombuffer(data, np.uint8).reshape(height, width, SAMPLES[color])
    alpha, alpha_chunk = color in ("La8", "Rgba8"), None
    if use_lossy:
        name, frame = b"VP8 ", lossy.encode(px, color, quality, tables)
        if alpha:  # as a lossless gray image, unfiltered
            alpha_chunk = b"\x01" + lossless.encode_stream(px[..., -1:], "L8", use_predictor, headless=True)
    else:
        name, frame = b"VP8L", lossless.encode_stream(px, color, use_predictor)
    return build(name, frame, width, height, alpha, alpha_chunk, icc, exif, xmp)


def encode_images(pixels: DataFrame, key: str = "path", **params) -> DataFrame:
    """key, content, error_code for rows (key, pixels, width, height, color and, where there are such columns, icc, exif, xmp)."""
    blobs = [c for c in ("icc", "exif", "xmp") if c in pixels.columns]
    kind = pixels.select(key).schema[0].dataType.simpleString()

    def run(batches):
        for b in batches:
            out, errors = [], []
            for _, px, w, h, color, *extra in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    out.append(encode_image(px or b"", w or 0, h or 0, color or "", **params, **{n: v or b"" for n, v in zip(blobs, extra, strict=True)}))
                    errors.append(None)
                except CodecError as e:
                    out.append(None)
                    errors.append(e.code)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[key, "content", "error_code"])

    return pixels.select(key, "pixels", "width", "height", "color", *blobs).mapInArrow(run, f"{key} {kind}, content binary, error_code string")


# --- files ------------------------------------------------------------------------------------


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows) -> WriterCommitMessage:
        """Each file is written under a name of its own and then moved, so that a retried task leaves no half of one."""
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        store.create_dir(top, recursive=True)
        for name, content in rows:
            if content is None:
                continue
            part = f"{top}/.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(bytes(content))
            store.move(part, f"{top}/{name}")
        return WriterCommitMessage()


class ImageFiles(DataSource):
    """``df.select("name", "content").write.format("image_files").mode("append").save(path)``: a file for each row."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def write_images(named: DataFrame, path: str) -> None:
    """Files for rows (name, content); ``path`` must be one that all executors reach. Rows without content are left out."""
    named.sparkSession.dataSource.register(ImageFiles)
    named.select("name", "content").write.format("image_files").mode("append").save(path)
