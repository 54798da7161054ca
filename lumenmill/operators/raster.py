"""Raster operators as DataFrame transformations.

A pixel relation has one row for each pixel: img, y, x and channels. Storage stays one BINARY per
image (see ``sources``); these operators run on the exploded view. What is order-free is a
projection, a join with a small table or an aggregate; what is a prefix sum is a window keyed by
image and row, column or diagonal, so no task ever holds more than one line of one image. The
recurrences that clamp or average (and so are no prefix sums) are in ``codec``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pixel as P

CHANNELS = ("r", "g", "b", "a")


# --- lossless: forward ----------------------------------------------------------------------


def subtract_green(px: DataFrame, inverse: bool = False) -> DataFrame:
    sign = 1 if inverse else -1
    return px.withColumns({c: P.wrap(F.col(c) + sign * F.col("g")) for c in ("r", "b")})


def expand_color(px: DataFrame, kind: str) -> DataFrame:
    """L8, La8, Rgb8 or Rgba8 samples (columns r, g, b, a as far as the kind has them; gray in g) as RGBA."""
    gray, alpha = kind in ("L8", "La8"), kind in ("La8", "Rgba8")
    return px.withColumns(({"r": F.col("g"), "b": F.col("g")} if gray else {}) | ({} if alpha else {"a": F.lit(255).cast("long")}))


def predictor_residuals(px: DataFrame, channels=CHANNELS) -> DataFrame:
    """The encoder's residuals: the first row less its left neighbour, every other row less the row above, alpha of the first pixel less 255."""
    left, up = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    out = {}
    for c in channels:
        first = F.lit(255 if c == "a" else 0)
        before = F.when(F.col("y") > 0, F.lag(c).over(up)).when(F.col("x") > 0, F.lag(c).over(left)).otherwise(first)
        out[c] = P.wrap(F.col(c) - before)
    return px.withColumns(out)


def symbol_histogram(px: DataFrame, channels=CHANNELS) -> DataFrame:
    """img, channel, symbol, n: all channels in one pass, one partial aggregate before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("symbol")) for c in channels]))
    return px.select("img", pairs.alias("s")).groupBy("img", "s.channel", "s.symbol").agg(F.count("*").alias("n"))


def entropy(hist: DataFrame) -> DataFrame:
    """img, channel, total and the bits that an ideal code needs (rounded; float sums depend on their order)."""
    sums = hist.groupBy("img", "channel").agg(F.sum("n").alias("pixels"), F.count("*").alias("symbols"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    return sums.select("img", "channel", "pixels", "symbols", F.round(F.col("pixels") * F.log2("pixels") - F.col("nlogn"), 3).alias("bits"))


def runs(px: DataFrame, value: Column, cap: int = 4096) -> DataFrame:
    """Runs of equal values in raster order: img, first (pixel number), value, literal and repeats; a run is cut after a literal and ``cap`` repeats."""
    order = Window.partitionBy("img").orderBy("i")
    marked = px.select("img", "i", value.alias("v")).withColumn("new", F.coalesce((F.lag("v").over(order) != F.col("v")).cast("int"), F.lit(1)))
    island = marked.withColumn("island", F.sum("new").over(order)).groupBy("img", "island", "v").agg(F.min("i").alias("at"), F.count("*").alias("n"))
    piece = island.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / (cap + 1)))))
    return piece.select("img", (F.col("at") + F.col("k") * (cap + 1)).alias("first"), F.col("v").alias("value"), F.least(F.col("n") - F.col("k") * (cap + 1), F.lit(cap + 1)).alias("length")).select("img", "first", "value", (F.col("length") - 1).alias("repeats"))


# --- lossless: inverse ----------------------------------------------------------------------


def _borders(px: DataFrame, channel: str) -> DataFrame:
    """Adds row (the prefix sum of the first row) and column (that of the first column)."""
    row = F.sum(channel).over(Window.partitionBy("img", "y").orderBy("x"))
    column = F.sum(channel).over(Window.partitionBy("img", "x").orderBy("y"))
    return px.withColumn("row_sum", row).withColumn("column_sum", column)


def inverse_predictor(px: DataFrame, mode: str, channel: str, width: int) -> DataFrame:
    """Undoes a predictor that one mode covers: img, y, x, value.

    The first row adds up along x, the first column along y; the interior adds to what its mode
    names: left, top, topleft or topright (whose last pixel of a row has the row's own first pixel).
    """
    b = _borders(px, channel)
    if mode == "left":
        first = F.first("column_sum").over(Window.partitionBy("img", "y").orderBy("x"))
        value = first + F.col("row_sum") - F.first(channel).over(Window.partitionBy("img", "y").orderBy("x"))
    elif mode == "top":
        first = F.first("row_sum").over(Window.partitionBy("img", "x").orderBy("y"))
        value = first + F.col("column_sum") - F.first(channel).over(Window.partitionBy("img", "x").orderBy("y"))
    elif mode == "topleft":
        seed = F.when(F.col("y") == 0, F.col("row_sum")).when(F.col("x") == 0, F.col("column_sum")).otherwise(F.col(channel))
        b = b.withColumn("seed", seed).withColumn("line", F.col("x") - F.col("y"))
        value = F.sum("seed").over(Window.partitionBy("img", "line").orderBy("x"))
    elif mode == "topright":
        # A chain runs from the top right downwards to the left; one that starts in the last column starts from its row's first pixel.
        edge = F.first("column_sum").over(Window.partitionBy("img", "y").orderBy("x"))
        seed = F.when(F.col("y") == 0, F.col("row_sum")).when(F.col("x") == width - 1, F.col(channel) + edge).otherwise(F.col(channel))
        b = b.withColumn("seed", seed).withColumn("line", F.col("x") + F.col("y"))
        inner = (F.col("y") == 0) | (F.col("x") > 0)
        value = F.when(inner, F.sum(F.when(inner, F.col("seed"))).over(Window.partitionBy("img", "line").orderBy("y"))).otherwise(F.col("column_sum"))
    else:
        raise ValueError(f"no prefix sum undoes mode {mode!r}")
    return b.select("img", "y", "x", P.wrap(value).alias("value"))


def inverse_color(px: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """Undoes the color transform; ``blocks`` (img, by, bx, g2r, g2b, r2b) is small: one row for each 2 ** bits square."""
    placed = px.withColumns({"by": F.shiftright("y", bits), "bx": F.shiftright("x", bits)}).join(blocks, ["img", "by", "bx"])
    red = P.wrap(F.col("r") + P.color_delta(F.col("g2r"), F.col("g")))
    placed = placed.withColumn("red", red)
    blue = P.wrap(F.col("b") + P.color_delta(F.col("g2b"), F.col("g")) + P.color_delta(F.col("r2b"), F.col("red")))
    return placed.select("img", "y", "x", F.col("red").alias("r"), "g", blue.alias("b"), "a")


def palette_colors(px: DataFrame, palette: DataFrame, index: str) -> DataFrame:
    """Looks colors up in each image's own palette (img, idx, r, g, b, a); an index past it is transparent black."""
    colors = palette.select("img", F.col("idx").alias(index), *CHANNELS)
    wide = px.select("img", "y", "x", index).join(colors, ["img", index], "left")
    return wide.select("img", "y", "x", *[F.coalesce(c, F.lit(0)).alias(c) for c in CHANNELS])


def unpacked(px: DataFrame, byte: str, bits: int, width: int) -> DataFrame:
    """img, y, x, idx: the 8 / bits palette indices of each byte, the lowest bits first, cut at ``width``."""
    per = 8 // bits
    each = px.select("img", "y", "x", byte, F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k"))
    power = F.element_at(F.array(*[F.lit(1 << (bits * k)).cast("long") for k in range(per)]), (F.col("k") + 1).cast("int"))
    idx = F.floor(F.col(byte) / power).cast("long") % (1 << bits)
    return each.select("img", "y", (F.col("x") * per + F.col("k")).alias("x"), idx.alias("idx")).where(F.col("x") < width)


def palette_from_deltas(palette: DataFrame) -> DataFrame:
    """Colors from a palette whose entries are stored as differences."""
    w = Window.partitionBy("pal").orderBy("idx")
    return palette.select("pal", "idx", *[P.wrap(F.sum(c).over(w)).alias(c) for c in CHANNELS])


def _pixel_rows(images: DataFrame, undo, columns: str) -> DataFrame:
    """Rows img, y, x and ``columns`` of each image (img, pixels as RGBA, width, height), after ``undo`` of its (height, width, 4) array; one image at a time."""
    names = columns.split()

    def run(batches):
        for b in batches:
            for img, raw, w, h in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                flat = undo(np.frombuffer(raw, np.uint8).reshape(h, w, 4).copy()).reshape(h * w, -1).astype(np.int64)
                at = np.arange(h * w)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(h * w, img), at // w, at % w, *flat.T)], names=["img", "y", "x", *names])

    return images.select(F.col("img").cast("long").alias("img"), "pixels", "width", "height").mapInArrow(run, ", ".join(f"{c} long" for c in ("img", "y", "x", *names)))


def unpredicted(images: DataFrame, mode: int) -> DataFrame:
    """Undoes one predictor mode (0 to 13) of whole images (img, pixels, width, height): img, y, x, r, g, b, a. For the modes that are no prefix sums."""

    def undo(px):
        from ..codec.lossless import inverse_predictor as whole

        blocks = np.zeros((-(-px.shape[0] // 512), -(-px.shape[1] // 512), 4), np.uint8)
        blocks[..., 1] = mode
        return whole(px, 9, blocks, px.shape[1])

    return _pixel_rows(images, undo, "r g b a")


def ungraded(images: DataFrame) -> DataFrame:
    """Undoes the gradient filter of the alpha samples of whole images: img, y, x, value."""

    def undo(px):
        from ..codec.animation import unfiltered

        return unfiltered(px[..., 3].copy(), 3)

    return _pixel_rows(images, undo, "value")


# --- prefix codes ---------------------------------------------------------------------------


def kraft(lengths: DataFrame) -> DataFrame:
    """Whether code lengths (tree, symbol, len) make a complete code: a single symbol, or a Kraft sum of exactly one."""
    used = lengths.where("len > 0")
    room = F.sum(F.pow(F.lit(2), 15 - F.col("len")).cast("long"))
    return used.groupBy("tree").agg(F.count("*").alias("symbols"), room.alias("room")).withColumn("complete", F.when((F.col("symbols") == 1) | (F.col("room") == 32768), 1).otherwise(0))


def canonical_codes(lengths: DataFrame) -> DataFrame:
    """Codes by length, then symbol: tree, symbol, len, code (its value, first bit highest) and sent (its bits in stream order)."""
    order = Window.partitionBy("tree").orderBy("len", "symbol").rowsBetween(Window.unboundedPreceding, -1)
    used = lengths.where("len > 0").withColumn("before", F.coalesce(F.sum(F.pow(F.lit(2), 15 - F.col("len")).cast("long")).over(order), F.lit(0)))
    code = F.floor(F.col("before") / F.pow(F.lit(2), 15 - F.col("len"))).cast("long")
    return used.select("tree", "symbol", "len", code.alias("code")).withColumn("sent", F.reverse(F.lpad(F.bin("code"), F.col("len").cast("int"), "0")))


def near_distances(codes: DataFrame, width: Column) -> DataFrame:
    """``codes`` (code) with the distance in pixels: the 120 short codes by a broadcast map, others less 120."""
    spark = codes.sparkSession
    near = F.broadcast(spark.createDataFrame([(i + 1, x, y) for i, (x, y) in enumerate(P.distance_map())], "near long, dx long, dy long"))
    wide = codes.withColumn("w", width).join(near, F.col("code") == F.col("near"), "left")
    return wide.withColumn("distance", F.when(F.col("near").isNull(), F.col("code") - 120).otherwise(F.greatest(F.lit(1), F.col("dx") + F.col("dy") * F.col("w")))).drop("near", "dx", "dy", "w")


# --- lossy ----------------------------------------------------------------------------------


def to_yuv420(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Luma of every pixel that lies in a full pair of rows and columns, and chroma of every full 2 x 2 square."""
    u, v = P.chroma_raw(F.col("r"), F.col("g"), F.col("b"))
    cell = px.select("img", F.shiftright("y", 1).alias("cy"), F.shiftright("x", 1).alias("cx"), u.alias("u"), v.alias("v"))
    chroma = cell.groupBy("img", "cy", "cx").agg(F.count("*").alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v")).where("n = 4")
    chroma = chroma.select("img", "cy", "cx", F.shiftright("u", 18).alias("u"), F.shiftright("v", 18).alias("v"))
    return px.select("img", "y", "x", P.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma")), chroma


def to_rgb_simple(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Each pixel takes its square's chroma."""
    wide = luma.withColumns({"cy": F.shiftright("y", 1), "cx": F.shiftright("x", 1)}).join(chroma, ["img", "cy", "cx"])
    r, g, b = P.yuv_to_rgb(F.col("luma"), F.col("u"), F.col("v"))
    return wide.select("img", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def to_rgb_bilinear(luma: DataFrame, chroma: DataFrame) -> DataFrame:
    """Chroma weighted 9, 3, 3, 1 with the neighbours that a pixel leans to; beyond an edge the sample itself stands in.

    Neighbours come from lag and lead over chroma rows and columns, so there is one join, with luma.
    """
    row, column = Window.partitionBy("img", "cy").orderBy("cx"), Window.partitionBy("img", "cx").orderBy("cy")
    c = chroma
    for k in ("u", "v"):
        c = c.withColumn(f"{k}0", F.coalesce(F.lag(k).over(row), k)).withColumn(f"{k}1", F.coalesce(F.lead(k).over(row), k))
    for k in ("u", "v"):
        for s in ("", "0", "1"):
            c = c.withColumn(f"{k}{s}_up", F.coalesce(F.lag(f"{k}{s}").over(column), f"{k}{s}")).withColumn(f"{k}{s}_down", F.coalesce(F.lead(f"{k}{s}").over(column), f"{k}{s}"))
    wide = luma.withColumns({"cy": F.shiftright("y", 1), "cx": F.shiftright("x", 1)}).join(c, ["img", "cy", "cx"])

    def sample(k: str) -> Column:
        even_x, even_y = F.col("x") % 2 == 0, F.col("y") % 2 == 0
        side = F.when(even_x, F.col(f"{k}0")).otherwise(F.col(f"{k}1"))
        over = F.when(even_y, F.col(f"{k}_up")).otherwise(F.col(f"{k}_down"))
        corner = F.when(even_x & even_y, F.col(f"{k}0_up")).when(even_x, F.col(f"{k}0_down")).when(even_y, F.col(f"{k}1_up")).otherwise(F.col(f"{k}1_down"))
        return P.upsampled(F.col(k), side, over, corner)

    wide = wide.select("img", "y", "x", "luma", sample("u").alias("su"), sample("v").alias("sv"))
    r, g, b = P.yuv_to_rgb(F.col("luma"), F.col("su"), F.col("sv"))
    return wide.select("img", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def transformed(blocks: DataFrame, transform, names: list[str]) -> DataFrame:
    """A 4 x 4 transform of 16 columns, with the result of its first pass materialised between, as each output uses four of them."""
    half = blocks.withColumns(dict(zip(names, transform([F.col(n) for n in names], 1), strict=True)))
    return half.withColumns(dict(zip(names, transform([F.col(n) for n in names], 2), strict=True)))


# --- alpha and animation ----------------------------------------------------------------------


def alpha_unfiltered(px: DataFrame, method: str, channel: str = "a") -> DataFrame:
    """Undoes the horizontal or vertical alpha filter: the same prefix sums as predictors of left and top."""
    return inverse_predictor(px, {"horizontal": "left", "vertical": "top"}[method], channel, 0)


def last_writer(frames: DataFrame) -> DataFrame:
    """Canvas of each animation (anim) after each frame where frames are copied, not blended: the latest frame that covers the pixel."""
    order = Window.partitionBy("anim", "y", "x").orderBy("frame")
    return frames.withColumn("shown", F.last("value", ignorenulls=True).over(order))


def blended_canvas(frames: DataFrame) -> DataFrame:
    """Canvas of each animation (anim) after all its frames, each blended over what is there, as an ordered fold for each pixel.

    A pixel's list is as long as the animation; for long ones ``codec.animation`` folds whole frames.
    """
    order = F.array_sort(F.collect_list(F.struct("frame", *CHANNELS)))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in CHANNELS])

    def step(canvas, top):
        out = P.blend({c: top[c] for c in CHANNELS}, {c: canvas[c] for c in CHANNELS})
        return F.struct(*[out[c].cast("long").alias(c) for c in CHANNELS])

    folded = frames.groupBy("anim", "y", "x").agg(order.alias("layers"))
    return folded.select("anim", "y", "x", F.aggregate("layers", zero, step).alias("px")).select("anim", "y", "x", "px.*")


def timeline(frames: DataFrame) -> DataFrame:
    """For each frame: when it starts, whether its predecessor disposes, and the rectangle to clear before it."""
    order = Window.partitionBy("img").orderBy("frame")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = frames.withColumn("starts_ms", F.coalesce(F.sum("duration").over(before), F.lit(0))).withColumn("clears", F.lag("dispose", 1, 1).over(order))
    return out.withColumns({f"previous_{c}": F.coalesce(F.lag(c).over(order), F.lit(0)) for c in ("fx", "fy", "fw", "fh")})


def cleared(px: DataFrame, rects: DataFrame) -> DataFrame:
    """Pixels inside their image's rectangle (img, fx, fy, fw, fh) become transparent; one rectangle an image, so an equi-join and a test."""
    wide = px.join(rects, "img", "left")
    inside = F.coalesce(F.col("x").between(F.col("fx"), F.col("fx") + F.col("fw") - 1) & F.col("y").between(F.col("fy"), F.col("fy") + F.col("fh") - 1), F.lit(False))
    return wide.select("img", "y", "x", *[F.when(inside, 0).otherwise(F.col(c)).alias(c) for c in CHANNELS])


# --- intra prediction, given the samples around a square ------------------------------------------


def _around(px: DataFrame, channel: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Of n x n squares: the line above (img, by, x, above) and the column on the left (img, y, bx, left)."""
    last = n - 1
    above = px.where(F.col("y") % n == last).select("img", (F.floor(F.col("y") / n) + 1).alias("by"), "x", F.col(channel).alias("above"))
    left = px.where(F.col("x") % n == last).select("img", "y", (F.floor(F.col("x") / n) + 1).alias("bx"), F.col(channel).alias("left"))
    return above, left


def intra_dc(px: DataFrame, channel: str, n: int = 16) -> DataFrame:
    """img, by, bx, value: the rounded mean of what lies above and on the left of each square; 128 without either."""
    above, left = _around(px, channel, n)
    parts = above.select("img", "by", F.floor(F.col("x") / n).alias("bx"), F.col("above").alias("v")).unionByName(left.select("img", F.floor(F.col("y") / n).alias("by"), "bx", F.col("left").alias("v")))
    sums = parts.groupBy("img", "by", "bx").agg(F.sum("v").alias("total"), F.count("*").alias("k"))
    squares = px.select("img", F.floor(F.col("y") / n).alias("by"), F.floor(F.col("x") / n).alias("bx")).distinct()
    mean = F.floor((F.col("total") + F.floor(F.col("k") / 2)) / F.col("k"))
    return squares.join(sums, ["img", "by", "bx"], "left").select("img", "by", "bx", F.coalesce(mean, F.lit(128)).alias("value"))


def intra_copied(px: DataFrame, channel: str, mode: str, n: int = 16) -> DataFrame:
    """img, y, x, value: the line above each square (mode vertical; 127 at the top) or the column on its left (horizontal; 129 at the side)."""
    above, left = _around(px, channel, n)
    cell = px.select("img", "y", "x", F.floor(F.col("y") / n).alias("by"), F.floor(F.col("x") / n).alias("bx"))
    if mode == "vertical":
        return cell.join(above, ["img", "by", "x"], "left").select("img", "y", "x", F.coalesce("above", F.lit(127)).alias("value"))
    return cell.join(left, ["img", "y", "bx"], "left").select("img", "y", "x", F.coalesce("left", F.lit(129)).alias("value"))


def intra_true_motion(px: DataFrame, channel: str, n: int = 16) -> DataFrame:
    """img, y, x, value: left + above - corner of each square, clamped; beyond the image 129 on the left, 127 above and in the top corners."""
    above, left = _around(px, channel, n)
    corner = above.where(F.col("x") % n == n - 1).select("img", "by", (F.floor(F.col("x") / n) + 1).alias("bx"), F.col("above").alias("corner"))
    cell = px.select("img", "y", "x", F.floor(F.col("y") / n).alias("by"), F.floor(F.col("x") / n).alias("bx"))
    wide = cell.join(above, ["img", "by", "x"], "left").join(left, ["img", "y", "bx"], "left").join(corner, ["img", "by", "bx"], "left")
    edge = F.when(F.col("by") == 0, 127).when(F.col("bx") == 0, 129).otherwise(F.col("corner"))
    return wide.select("img", "y", "x", P.clamp(F.coalesce("left", F.lit(129)) + F.coalesce("above", F.lit(127)) - edge).alias("value"))


def quantizer_steps(indices: DataFrame, index: str) -> DataFrame:
    """Adds the DC and AC steps of each plane for a quantizer index (clamped to 0..127), by a broadcast join with the 128 steps."""
    from ..codec.lossy import AC_STEPS, DC_STEPS

    table = F.broadcast(indices.sparkSession.createDataFrame([(i, d, a) for i, (d, a) in enumerate(zip(DC_STEPS, AC_STEPS, strict=True))], "q long, dc long, ac long"))
    wide = indices.withColumn("q", P.clamp(F.col(index), 0, 127)).join(table, "q")
    y2_ac, uv_dc = F.greatest(F.floor(F.col("ac") * 155 / 100), F.lit(8)), F.least(F.col("dc"), F.lit(132))
    return wide.withColumns({"y_dc": F.col("dc"), "y_ac": F.col("ac"), "y2_dc": 2 * F.col("dc"), "y2_ac": y2_ac, "uv_dc": uv_dc, "uv_ac": F.col("ac")}).drop("q", "dc", "ac")


def dequantized(tokens: DataFrame, dc: Column, ac: Column) -> DataFrame:
    """Coefficients at their places from levels in zigzag order: (blk, k, level) to (blk, place, value)."""
    from ..codec.lossy import ZIGZAG

    place = F.element_at(F.array(*[F.lit(z) for z in ZIGZAG]), (F.col("k") + 1).cast("int")).cast("long")
    return tokens.withColumn("place", place).withColumn("value", F.col("level") * F.when(F.col("place") > 0, ac).otherwise(dc)).drop("k", "level")
