"""Reading and writing pictures and run files."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the built-in image source: interleaved blue, green, red bytes.
IMAGE_SCHEMA = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """origin, height, width, channels, data and an error for each file: unreadable files have height -1 there."""
    i = F.col("image")
    df = spark.read.format("image").option("dropInvalid", False).load(path)
    bad = i["height"] < 0
    return df.select(i["origin"].alias("origin"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"), F.when(bad, "undecodable").alias("error"))


def gray(blue: Column, green: Column, red: Column) -> Column:
    """Luma, rounded."""
    return F.floor(0.299 * red + 0.587 * green + 0.114 * blue + 0.5).cast("long")


def gray_rows(images: DataFrame) -> DataFrame:
    """origin, y, v: grey levels of one row of a picture as an array, in one Arrow pass; one-channel pictures as they are, an
    alpha channel is left out."""

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                v = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels).astype(float)
                v = v[..., 0] if r.channels == 1 else np.floor(0.299 * v[..., 2] + 0.587 * v[..., 1] + 0.114 * v[..., 0] + 0.5)
                yield pd.DataFrame({"origin": r.origin, "y": range(r.height), "v": list(v.astype(np.int32))})

    good = images.filter(F.col("error").isNull() & F.col("channels").isin(1, 3, 4))
    return good.select("origin", "height", "width", "channels", "data").mapInPandas(run, "origin string, y long, v array<int>")


def pixels_of(images: DataFrame) -> DataFrame:
    """origin, y, x, v: grey levels, one row a pixel."""
    df = gray_rows(images).select("origin", "y", F.posexplode("v").alias("x", "v"))
    return df.select("origin", "y", F.col("x").cast("long").alias("x"), F.col("v").cast("long").alias("v"))


def encode_png(samples: np.ndarray) -> bytes:
    """PNG of (height, width) grey or (height, width, 3) blue-green-red samples."""
    v = np.asarray(samples, np.uint8)
    colour = 2 if v.ndim == 3 else 0
    rows = (v[:, :, ::-1] if colour else v).reshape(len(v), -1)
    raw = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", v.shape[1], v.shape[0], 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encoded(images: DataFrame, plane: str) -> DataFrame:
    """image_id and the PNG file of a plane of image rows (height, width, plane), made in Arrow batches."""

    def run(frames):
        for f in frames:
            f["png"] = [encode_png(np.asarray(v, float).reshape(h, w)) for v, h, w in zip(f[plane], f["height"], f["width"], strict=True)]
            yield f[["image_id", "png"]]

    return images.select("image_id", "height", "width", plane).mapInPandas(run, "image_id long, png binary")


def write_report(lines: DataFrame, path: str) -> None:
    """One text file a partition, lines (column value) in order."""
    lines.select("value").write.mode("errorifexists").text(path)


def write_run_config(spark: SparkSession, path: str, config: dict, identity: str) -> dict:
    """Write a run's configuration once. A second call gives back what is there; another identity is an error."""
    try:
        found = spark.read.text(path).first()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = None
    if found is not None:
        there = json.loads(found["value"])
        if there["identity"] != identity:
            raise ValueError("another configuration is stored here: choose a new folder")
        return there
    payload = {"config": config, "identity": identity}
    row = [(json.dumps(payload, sort_keys=True, ensure_ascii=False),)]
    spark.createDataFrame(row, "value string").coalesce(1).write.mode("errorifexists").text(path)
    return payload
