"""Streams give what the batch forms give."""

from proofsheet.sources import images as files
from proofsheet.streaming import feeds


def test_dropped_pictures_and_files(spark, tmp_path):
    import numpy as np

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.png").write_bytes(files.encode_png(np.full((2, 3), k)))
    (folder / "note.txt").write_text("no picture")
    seen = feeds.run_once(feeds.dropped_images(spark, str(folder)).select("image.height", "image.width"), "pictures", str(tmp_path / "c1"))
    assert [tuple(r) for r in seen.filter("height > 0").collect()] == [(2, 3)] * 3
    seen = feeds.run_once(feeds.dropped_files(spark, str(folder)), "files", str(tmp_path / "c2"))
    assert seen.count() == 3 and seen.select("sha256").distinct().count() == 3


def test_request_lines(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"image_path": "a.png", "regions": [[1, 2, 3, 4]]}\nnot json\n{"image_path": "b.png", "regions": [], "batch_size": 0}\n')
    got = feeds.run_once(feeds.request_lines(spark, str(folder)), "requests", str(tmp_path / "c")).collect()
    assert sorted((r["image_path"] or "", r["batch_size"], r["error"]) for r in got) == [("", 32, "no image_path"), ("a.png", 32, None), ("b.png", 0, "bad batch_size")]


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "events")
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_id", "event_type AS stage", "value AS elapsed_s", "ts")
    df.repartition(3).write.parquet(folder)
    stream = feeds.windowed_peaks(spark.readStream.schema(df.schema).parquet(folder), "1 day")
    got = feeds.run_once(stream, "peaks", str(tmp_path / "c"), "complete")
    rows = lambda d: sorted((str(r["start"]), r["stage"], r["peak"], r["samples"]) for r in d.collect())
    assert rows(got) == rows(feeds.windowed_peaks(df, "1 day"))
