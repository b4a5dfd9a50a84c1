"""Media, images, outboxes and partitions."""

import numpy as np
from pyspark.sql import functions as F

from wardloom.operators import images
from wardloom.sources import io


def test_images(spark, tmp_path):
    noise = np.random.default_rng(1).integers(0, 256, (20, 30, 3), dtype=np.uint8)
    (tmp_path / "a.ppm").write_bytes(b"P6\n30 20\n255\n" + noise.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5 4 4 255\n" + bytes(16))
    (tmp_path / "c.ppm").write_bytes(b"no image")
    files = io.read_media(spark, str(tmp_path), kinds=("ppm",), most=1000)
    assert {r["path"][-5:]: r["accepted"] for r in files.collect()} == {"a.ppm": False, "b.pgm": False, "c.ppm": True}
    got = {r["path"][-5:]: r for r in images.measured(files).withColumn("band", images.quality_band()).collect()}
    assert (got["a.ppm"]["width"], got["a.ppm"]["height"], got["a.ppm"]["band"]) == (30, 20, "GOOD")
    assert got["b.pgm"]["brightness"] == 0 and got["b.pgm"]["band"] == "POOR" and got["c.ppm"]["band"] == "UNREADABLE"


def test_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(6).withColumn("w", (F.col("id") % 2).cast("int"))
    io.write_partition(rows, path, "w")
    io.write_partition(spark.createDataFrame([(100, 1)], "id long, w int"), path, "w")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 2, 4, 100]


def test_outbox(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "event_id long")
    sent = spark.createDataFrame([(0, True), (1, False), (1, True), (2, False)], "event_id long, ok boolean")
    got = {r["event_id"]: (r["status"], r["attempts"]) for r in io.outbox(rows, sent).collect()}
    assert got == {0: ("PUBLISHED", 1), 1: ("PUBLISHED", 2), 2: ("FAILED", 1), 3: ("PENDING", 0)}
