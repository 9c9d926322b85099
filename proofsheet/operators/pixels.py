"""Operators on pixel rows that built-in aggregates and windows express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import images

#: Fixed values of the checks' rules: area ratio and similarity at which a level begins.
AREA_LEVELS = ((0.0005, "low"), (0.005, "medium"), (0.02, "high"))
SSIM_LEVELS = ((0.50, "critical"), (0.75, "high"), (0.90, "medium"), (0.95, "low"))
LARGE_AREA = 0.01


def ladder(value: Column, steps: tuple[tuple[float, str], ...], rest: str) -> Column:
    """Name of the first step that value is below."""
    out = F.when(value < steps[0][0], steps[0][1])
    for limit, name in steps[1:]:
        out = out.when(value < limit, name)
    return out.otherwise(rest)


def area_severity(ratio: Column) -> Column:
    return ladder(ratio, AREA_LEVELS, "critical")


def ssim_severity(value: Column) -> Column:
    return ladder(value, SSIM_LEVELS, "ok")


def difference_rate(pairs: DataFrame, threshold: int) -> DataFrame:
    """image_id, changed, total, rate and mean absolute difference. One partial aggregate a task, then a row an image."""
    d = F.abs(F.col("a") - F.col("b"))
    df = pairs.groupBy("image_id").agg(F.count(F.when(d > threshold, 1)).alias("changed"), F.count("*").alias("total"), F.avg(d).alias("mean_abs"))
    return df.withColumn("rate", F.col("changed") / F.col("total"))


def equalized(pixels: DataFrame) -> DataFrame:
    """image_id, v, n and the level v is mapped to, so that levels are spread evenly. Works on 256 rows an image."""
    counts = pixels.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("image_id")
    upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    df = counts.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(upto), "first": F.min_by("n", "v").over(whole)})
    spread = F.col("total") - F.col("first")
    level = F.when(spread == 0, F.col("v")).otherwise(F.rint((F.col("upto") - F.col("first")) * (255.0 / spread)))
    return df.select("image_id", "v", "n", level.cast("long").alias("level"))


def sliding(pixels: DataFrame, value: str, size: int, best=F.max) -> DataFrame:
    """Sliding maximum (or minimum) over a square as two one-dimensional frames; appends column best."""
    r = size // 2
    rows = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-r, r)
    columns = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-r, r)
    return pixels.withColumn("in_row", best(value).over(rows)).withColumn("best", best("in_row").over(columns)).drop("in_row")


def union_area(boxes: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """keys, covered, rate: area covered by at least one box of the key, clipped to width x height.

    Boxes are cut into rows; in a row intervals are merged in order of their left edge. Rows made follow the boxes'
    heights, not their areas.
    """
    left, top = F.greatest(F.col("x"), F.lit(0)), F.greatest(F.col("y"), F.lit(0))
    right, bottom = F.least(F.col("x") + F.greatest("width", F.lit(0)), F.lit(width)), F.least(F.col("y") + F.greatest("height", F.lit(0)), F.lit(height))
    df = boxes.select(*keys, left.alias("x1"), right.alias("x2"), top.alias("y1"), bottom.alias("y2")).filter("x2 > x1 AND y2 > y1")
    df = df.withColumn("row", F.explode(F.sequence("y1", F.col("y2") - 1)))
    before = Window.partitionBy(*keys, "row").orderBy("x1", "x2").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("x2") - F.greatest("x1", F.coalesce(F.max("x2").over(before), F.lit(0))))
    df = df.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("covered"))
    return df.withColumn("rate", F.col("covered") / F.lit(width * height))


def box_features(boxes: DataFrame, marked: DataFrame) -> DataFrame:
    """boxes(image_id, x, y, width, height, ...) with the share (density) and spread of marked(image_id, y, on as arrays of 0
    and 1). Equal boxes are one."""
    df = images.box_sums(boxes, marked, "on")
    df = df.withColumn("density", F.col("total") / F.col("n"))
    return df.withColumns({"spread": F.sqrt(F.col("density") * (1 - F.col("density"))) * 255, "balance": F.least(F.col("density"), 1 - F.col("density"))})


def gradient_marks(rows: DataFrame, plane: str, threshold: int) -> DataFrame:
    """image_id, y, on: 1 where the step to the next sample of the row is over the threshold; a stand-in for edges."""
    step = lambda v, x: F.when(F.abs(F.get(plane, x + 1) - v) > threshold, 1).otherwise(0)
    return rows.select("image_id", "y", F.transform(plane, step).alias("on"))
