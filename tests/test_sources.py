"""Images as rows: files in and out, decoding, error rows, frames, and the stream of new files."""

import numpy as np
from pyspark.sql import functions as F

from lumenmill.sources import images as I


def made(spark, n=3):
    rng = np.random.default_rng(1)
    rows = [(f"{k}.webp", bytearray(rng.integers(0, 256, 6 * 4 * 4, dtype=np.uint8).tobytes()), 6, 4, "Rgba8") for k in range(n)]
    return spark.createDataFrame(rows, "path string, pixels binary, width int, height int, color string"), {r[0]: bytes(r[1]) for r in rows}


def test_files_round_trip(spark, tmp_path):
    px, want = made(spark)
    files = I.encode_images(px).withColumnRenamed("path", "name")
    I.write_images(files, str(tmp_path))
    read = I.read_images(spark, str(tmp_path))
    assert read.select("length").count() == 3
    got = {r["path"].rsplit("/", 1)[1]: bytes(r["pixels"]) for r in I.decode_images(read).collect()}
    assert got == want
    heads = I.with_header(read).select("kind", "width", "height", "error_code").distinct().collect()
    assert [tuple(h) for h in heads] == [("lossless", 6, 4, None)]
    names = {r["fourcc"] for r in I.chunk_table(read).collect()}
    assert names == {"VP8L"}


def test_bad_rows_are_set_aside(spark):
    rows = [("a", None), ("b", bytearray(b"")), ("c", bytearray(b"RIFF\0\0\0\0WEBPVP8L\x05\0\0\0\x2f\0\0\0\0\0"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    out = {r["path"]: r["error_code"] for r in I.decode_images(df).collect()}
    assert out["a"] == out["b"] == "IoError" and out["c"] == "BitStreamError" or out["c"] is not None
    meta = {r["path"]: r["error_code"] for r in I.metadata(df).collect()}
    assert meta["a"] == "IoError" and meta["c"] is None
    bad = spark.createDataFrame([("x", bytearray(b"123"), 2, 2, "Rgb8")], "path string, pixels binary, width int, height int, color string")
    assert I.encode_images(bad).first()["error_code"] == "InvalidParameter"


def test_unused_content_is_not_read(spark, tmp_path):
    I.write_images(I.encode_images(made(spark, 1)[0]).withColumnRenamed("path", "name"), str(tmp_path))
    plan = I.read_images(spark, str(tmp_path)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.rsplit("ReadSchema", 1)[1]


def test_stream_of_files(spark, tmp_path):
    px, want = made(spark)
    I.write_images(I.encode_images(px).withColumnRenamed("path", "name"), str(tmp_path / "in"))
    decoded = I.decode_images(I.stream_images(spark, str(tmp_path / "in"))).select(F.element_at(F.split("path", "/"), -1).alias("name"), "pixels")
    q = decoded.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["name"]: bytes(r["pixels"]) for r in spark.table("decoded").collect()} == want


def test_arrivals(spark, tmp_path):
    from lumenmill.streaming import images as S

    px, _ = made(spark)
    I.write_images(I.encode_images(px).withColumnRenamed("path", "name"), str(tmp_path / "in"))
    q = S.arrivals(I.stream_images(spark, str(tmp_path / "in"))).writeStream.format("memory").outputMode("complete").queryName("arrivals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["files"] for r in spark.table("arrivals").collect()) == 3
