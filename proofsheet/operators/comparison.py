"""Whole comparisons: what was found in pictures and texts, decided and put into one nested result a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import decisions as de

# Fixed values of the result.
SCHEMA_VERSION, FUSION = "1.0", "legacy_rule_OR_with_movement_warning"
NO_RECORDS = "One or more panels have no OCR records; text equality is not proof of defect absence."
REJECTED = "One or more ROI registrations rejected; see regions. Legacy downstream decision retained."


def detections(samples: DataFrame, boxes: DataFrame, lines: DataFrame) -> DataFrame:
    """sample_id, detections: picture differences that the sample's mode asks for, then text differences, numbered through.

    boxes(sample_id, region, x, y, width, height) and lines(sample_id, region, at, line), where at is anything that puts a
    sample's lines in order, are the differences of each region of a sample.
    """
    mode = samples.select("sample_id", "mode")
    at = lines.schema["at"].dataType
    seen = boxes.join(mode, "sample_id").filter("mode <> 'ocr'").select("sample_id", F.lit("visual").alias("check"), "region", F.lit(None).cast(at).alias("at"), F.array("x", "y", "width", "height").alias("bbox"), F.lit(None).cast("string").alias("description"))
    read = lines.join(mode, "sample_id").filter("mode <> 'visual'").select("sample_id", F.lit("ocr").alias("check"), "region", "at", F.lit(None).cast("array<long>").alias("bbox"), F.col("line").alias("description"))
    place = [F.get("bbox", F.lit(i)) for i in (1, 0, 2, 3)]
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("check"), "region", "at", *place))
    df = seen.unionByName(read).withColumn("k", number)
    kind = F.when(F.col("check") == "visual", "visual_difference").otherwise("ocr_text_difference")
    row = F.struct("k", F.struct(F.concat_ws("-", "check", F.col("region").cast("string"), F.col("k").cast("string")).alias("detection_id"), kind.alias("type"), "bbox", F.col("region").alias("region_index"), "description").alias("d"))
    return df.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["d"]).alias("detections"))


def compared_samples(samples: DataFrame, boxes: DataFrame, lines: DataFrame, records: DataFrame, movements: DataFrame) -> DataFrame:
    """samples(sample_id, mode) -> sample_id, final_status, result (nested).

    records(sample_id, panel, n): recognised lines of each panel; movements(sample_id, region, success, status). A sample
    without differences has an empty list. An error of a sample (column error, if there is one) gives a result that is not
    completed.
    """
    found = detections(samples, boxes, lines)
    moved = movements.groupBy("sample_id").agg(F.bool_and("success").alias("aligned"), F.bool_or(F.col("status") != "not_moved").alias("moved"))
    read = records.groupBy("sample_id").agg(F.min("n").alias("least"))
    error = F.col("error") if "error" in samples.columns else F.lit(None).cast("string")
    df = samples.withColumn("c_error", error).join(found, "sample_id", "left").join(moved, "sample_id", "left").join(read, "sample_id", "left")
    found_any = lambda kind: F.exists("detections", lambda d: d["type"] == kind)
    nothing = F.array().cast(df.schema["detections"].dataType)
    df = df.withColumns({"detections": F.coalesce("detections", nothing), "aligned": F.coalesce("aligned", F.lit(True)), "moved": F.coalesce("moved", F.lit(False)), "least": F.coalesce("least", F.lit(0))})
    decided = de.by_mode(F.col("mode"), found_any("ocr_text_difference"), found_any("visual_difference"), F.col("moved"))
    final = F.when(F.col("c_error").isNull(), decided)
    return df.withColumn("final_status", final).select("sample_id", "final_status", result_of().alias("result"))


def result_of() -> Column:
    """The nested result from a row's mode, detections, aligned, least, c_error and final_status."""
    reads = F.col("mode") != "visual"
    failed, rejected = F.col("c_error").isNotNull(), ~F.col("aligned")
    silent = reads & (F.col("least") == 0)
    warnings = F.when(silent, F.array(F.lit(NO_RECORDS))).otherwise(F.array().cast("array<string>"))
    status = F.struct(
        (~failed).alias("completed"), F.when(~failed, F.col("aligned")).alias("alignment_success"), F.when(reads & ~failed, F.when(~silent, F.lit(True))).alias("ocr_success"),
        F.coalesce("c_error", F.when(rejected, "alignment_failure")).alias("error_type"), F.when(failed, "load").when(rejected, "alignment").alias("error_stage"), F.when(rejected & ~failed, REJECTED).alias("error_message"),
    )
    summary = F.struct(F.size("detections").alias("detection_count"), "final_status", F.when(F.col("mode") == "fusion", FUSION).alias("fusion_method"))
    return F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("sample_id").cast("string").alias("sample_id"), "mode", status.alias("status"), "detections", warnings.alias("warnings"), summary.alias("summary"))


def as_json(column: str) -> Column:
    """A nested result as one line of JSON, fields without a value included."""
    return F.to_json(column, {"ignoreNullFields": "false"})
