"""Images that keep arriving: decoding needs no state; counts over time windows use a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codec.animation import Options
from ..sources.images import decode_images, stream_images, with_header


def decoded(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """Pixels of new files below ``path``, one row each, as ``sources.images.decode_images`` gives them."""
    return decode_images(stream_images(spark, path), options)


def arrivals(files: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Files and bytes by kind and time window; what comes later than ``late`` is left out, and state older than that goes."""
    timed = with_header(files).withWatermark("modificationTime", late)
    return timed.groupBy(F.window("modificationTime", width), "kind").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.count("error_code").alias("unsound"))
