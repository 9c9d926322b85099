"""Input and configuration checks, and identities of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted formats and the settings with their defaults and ranges.
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".webp", ".tif", ".tiff")
MAX_PIXELS = 20_000_000
MODES = ("visual", "ocr", "fusion")
DEFAULTS = {
    "mode": "fusion", "dpi_scale": 3.0, "ocr_low_confidence": 0.90, "difference_threshold": 25, "blur_kernel": 5, "morphology_kernel": 3, "morphology_iterations": 1, "min_area": 30.0, "merge_gap": 5,
    "orb_max_features": 3000, "orb_keep_match_ratio": 0.25, "orb_min_matches": 8, "ransac_threshold": 3.0, "orb_min_inlier_ratio": 0.20, "max_rotation_degrees": 10.0, "min_scale": 0.85, "max_scale": 1.15,
    "max_roi_pixels": MAX_PIXELS, "ocr_batch_size": 8,
}
POSITIVE = ("dpi_scale", "min_area", "ransac_threshold", "max_rotation_degrees", "min_scale", "max_scale")
LEAST = {"difference_threshold": 0, "blur_kernel": 1, "morphology_kernel": 1, "morphology_iterations": 0, "merge_gap": 0, "orb_max_features": 100, "orb_min_matches": 3, "max_roi_pixels": 1, "ocr_batch_size": 1}
SHARES = ("orb_keep_match_ratio", "orb_min_inlier_ratio")
EDGE = 1e-6


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def input_error(path: Column, page: Column, selection: list[Column], width: Column, height: Column, pages: Column, selected: Column | None = None) -> Column:
    """First rule that an input breaks, or null. A null selection means the whole page, a null page the first one.

    selected: whether this is the side that the comparison starts from; of a document with pages it must name its page and
    its selection.
    """
    asked = F.lit(False) if selected is None else selected & (page.isNull() | selection[0].isNull())
    page = F.coalesce(page, F.lit(0))
    x1, y1, x2, y2 = selection
    finite = F.lit(True)
    for c in selection:
        finite = finite & ~F.isnan(c) & (F.abs(c) < float("inf"))
    given = x1.isNotNull()
    pdf = suffix(path) == ".pdf"
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "empty_path").when(page < 0, "negative_page")
        .when(given & (~finite | (x1 < 0) | (y1 < 0) | (x2 <= x1) | (y2 <= y1)), "bad_selection")
        .when(~suffix(path).isin(*SUFFIXES), "unsupported_format").when(pdf & asked, "selection_required").when(~pdf & (page != 0), "image_page").when(pdf & (page >= pages), "page_outside")
        .when(~pdf & (width.cast("long") * height > MAX_PIXELS), "over_budget")
        .when(given & ((x2 > width + EDGE) | (y2 > height + EDGE)), "selection_outside")
    )


def config_errors() -> Column:
    """Names of the settings (columns) out of range, joined in a fixed order."""
    checks = [(~F.col("mode").isin(*MODES), "mode")]
    checks += [(F.isnan(c) | (F.col(c) <= 0) | (F.abs(F.col(c)) == float("inf")), c) for c in POSITIVE]
    for c, least in LEAST.items():
        bad = F.col(c) < least
        if c == "difference_threshold":
            bad = bad | (F.col(c) > 255)
        if c in ("blur_kernel", "morphology_kernel"):
            bad = bad | (F.col(c) % 2 != 1)
        checks.append((bad, c))
    checks += [(F.isnan(c) | (F.col(c) <= 0) | (F.col(c) > 1), c) for c in SHARES]
    checks += [(F.col("min_scale") > F.col("max_scale"), "scale_order"), (F.col("ocr_low_confidence") != 0.90, "ocr_low_confidence")]
    return F.concat_ws(",", *[F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in checks])


def environment(spark: SparkSession) -> DataFrame:
    """name, value: versions of what a run depends on."""
    import platform
    from importlib import metadata

    found = {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "java": spark._jvm.System.getProperty("java.version")}
    for package in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            found[package] = metadata.version(package)
        except metadata.PackageNotFoundError:
            found[package] = None
    return spark.createDataFrame(list(found.items()), "name string, value string")


def identity(columns: list[str]) -> Column:
    """sha256 of the columns as compact JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def fingerprint(files: DataFrame, keys: list[str], name: str, content: str) -> DataFrame:
    """keys, sha256 of the map from file names to the hashes of their contents."""
    row = F.struct(F.col(name).alias("n"), F.sha2(F.col(content), 256).alias("h"))
    pairs = F.transform(F.array_sort(F.collect_set(row)), lambda r: F.concat(F.lit('"'), r["n"], F.lit('":"'), r["h"], F.lit('"')))
    return files.groupBy(*keys).agg(F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), 256).alias("fingerprint"), F.countDistinct(name).alias("files"))
