"""Raw output of recognition models, and requests as lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_SCHEMA = "doc_id long, texts array<string>, scores array<double>, boxes array<array<double>>, polygons array<array<array<double>>>"
REQUEST = "image_path string, regions array<array<double>>, batch_size int"


def box_at(box: Column, polygon: Column) -> list[Column]:
    """Corners of a line: its box, rounded half to even; else its polygon's extent, rounded outwards; else zeros."""
    usable, shaped = F.size(box) >= 4, F.size(polygon) > 0

    def extent(i: int, low: bool) -> Column:
        along = F.transform(polygon, lambda p: p[i])
        return F.floor(F.array_min(along)) if low else F.ceil(F.array_max(along))

    ends = (extent(0, True), extent(1, True), extent(0, False), extent(1, False))
    return [F.when(usable, F.rint(F.get(box, F.lit(i)))).when(shaped, e).otherwise(0).cast("long") for i, e in enumerate(ends)]


def records(results: DataFrame) -> DataFrame:
    """doc_id, pos, text, confidence, x1, y1, x2, y2 of each line with text; a missing score is 0."""
    df = results.select("doc_id", "scores", "boxes", "polygons", F.posexplode("texts").alias("pos", "raw")).withColumn("text", F.trim("raw")).filter("text <> ''")
    pick = lambda c: F.get(F.col(c), F.col("pos"))
    x1, y1, x2, y2 = box_at(pick("boxes"), pick("polygons"))
    return df.select("doc_id", F.col("pos").cast("long").alias("pos"), "text", F.coalesce(pick("scores"), F.lit(0.0)).alias("confidence"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def region_of(text: Column) -> tuple[list[Column], Column]:
    """Box and validity of "X,Y,W,H"."""
    parts = F.split(text, ",")
    numbers = F.transform(parts, lambda p: F.rint(F.try_to_number(F.trim(p), F.lit("S999999D999")).cast("double")).cast("long"))
    box = [F.get(numbers, F.lit(i)) for i in range(4)]
    good = (F.size(parts) == 4) & F.forall(numbers, lambda n: n.isNotNull()) & (box[2] > 0) & (box[3] > 0)
    return box, F.coalesce(good, F.lit(False))


def requests(lines: DataFrame) -> DataFrame:
    """Requests parsed from lines (column value) with a status: a line that isn't a request has an error, none is lost."""
    df = lines.withColumn("r", F.from_json("value", REQUEST))
    bad = F.when(F.col("r.image_path").isNull(), "no image_path").when(F.col("r.regions").isNull(), "no regions").when(F.col("r.batch_size") <= 0, "bad batch_size")
    return df.select(*lines.columns, "r.image_path", "r.regions", F.coalesce("r.batch_size", F.lit(32)).alias("batch_size"), bad.alias("error"))


def responses(answered: DataFrame, columns: list[str]) -> DataFrame:
    """Lines of JSON (column response) for requests with an error or with results in these columns: one line each, the error
    alone where there is one. Works on a stream as on a table."""
    failed = F.to_json(F.struct(F.col("error")))
    return answered.withColumn("response", F.when(F.col("error").isNotNull(), failed).otherwise(F.to_json(F.struct(*columns))))


def output_image(results: DataFrame) -> Column:
    """The picture that a model read its lines from, where its result has one."""
    field = next((f for f in results.schema if f.name == "doc_preprocessor_res"), None)
    if field is None or "output_img" not in field.dataType.names:
        return F.lit(None).cast("binary")
    return F.col("doc_preprocessor_res")["output_img"]
