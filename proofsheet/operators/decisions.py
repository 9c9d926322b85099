"""Scores, severity levels and the final PASS / WARNING / ERROR decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the checks' rules.
LEVELS = ("none", "low", "medium", "high", "critical")
LEVEL_SCORES = {"none": 1.0, "low": 0.90, "medium": 0.70, "high": 0.40, "critical": 0.0}
METRIC_LEVELS = ((0.05, 0.50, "critical"), (0.02, 0.70, "high"), (0.005, 0.85, "medium"))
WEIGHTS = {"global": 0.30, "local": 0.30, "area": 0.25, "severity": 0.15}
AREA_WEIGHTS = (0.70, 0.30)


def rank(level: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(LEVELS):
        out = out.when(level == name, i)
    return out


def named(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def overall_severity(region_rank: Column, difference_rate: Column, local_ssim: Column) -> Column:
    """The worse of the worst region and of what rate and similarity say; none without regions (null rank)."""
    metric = F.when(F.lit(False), "")
    for rate, ssim, name in METRIC_LEVELS:
        metric = metric.when((difference_rate >= rate) | (local_ssim < ssim), name)
    return F.when(region_rank.isNull(), "none").otherwise(named(F.greatest(region_rank, rank(metric.otherwise("low")))))


def image_score(global_ssim: Column, local_ssim: Column, difference_rate: Column, box_rate: Column, severity: Column) -> Column:
    """0 to 100."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    area = 1 - (AREA_WEIGHTS[0] * unit(difference_rate) + AREA_WEIGHTS[1] * unit(box_rate))
    level = F.when(F.lit(False), 0.0)
    for name, s in LEVEL_SCORES.items():
        level = level.when(severity == name, s)
    parts = WEIGHTS["global"] * unit(global_ssim) + WEIGHTS["local"] * unit(local_ssim) + WEIGHTS["area"] * area + WEIGHTS["severity"] * level
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * parts))


def fused(regions: DataFrame, keys: list[str]) -> DataFrame:
    """regions(keys, n_text, n_boxes, status, text_ratio, image_score): one decision for each key.

    Text or picture differences are errors; movement, or movement that can't be told, is a warning.
    """
    text, picture = F.sum("n_text") > 0, F.sum("n_boxes") > 0
    doubtful = F.bool_or(F.col("status").isin("moved", "uncertain"))
    return regions.groupBy(*keys).agg(
        F.when(text | picture, "ERROR").when(doubtful, "WARNING").otherwise("PASS").alias("final_status"),
        F.when(text, "ERROR").otherwise("PASS").alias("ocr_status"),
        F.when(picture, "ERROR").when(doubtful, "WARNING").otherwise("PASS").alias("image_status"),
        (F.min("text_ratio") * 100).alias("ocr_score"), F.min("image_score").alias("image_score"), F.sum("n_text").alias("text_differences"), F.sum("n_boxes").alias("picture_differences"), F.count("*").alias("regions"),
    )


def by_mode(mode: Column, has_text: Column, has_boxes: Column, moved: Column) -> Column:
    """Decision of one check alone (visual or ocr) or of both (fusion)."""
    visual = F.when(has_boxes, "ERROR").when(moved, "WARNING").otherwise("PASS")
    return F.when(mode == "visual", visual).when(mode == "ocr", F.when(has_text, "ERROR").otherwise("PASS")).otherwise(F.when(has_text | has_boxes, "ERROR").when(moved, "WARNING").otherwise("PASS"))


def error_kind(message: Column, raised: Column, given: Column, stage: Column) -> Column:
    """Kind of a failed run: memory first, then what the input said, then the stage it failed in."""
    return (
        F.when((raised == "MemoryError") | F.lower(message).contains("out of memory"), "out_of_memory")
        .when(raised == "InputError", given).when(stage == "validation", "unsupported_input").when(stage == "ocr", "ocr_failure").when(stage == "alignment", "alignment_failure").otherwise("algorithm_exception")
    )
