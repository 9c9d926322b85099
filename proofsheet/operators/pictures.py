"""Pictures of a comparison: coloured differences, boxes drawn into pictures, and the files a comparison leaves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..sources.images import encode_png
from . import images, regions

# Colours (blue, green, red) and the width of a drawn edge.
LEVEL_COLOURS = {"low": (0, 200, 0), "medium": (0, 255, 255), "high": (0, 128, 255), "critical": (0, 0, 255)}
KIND_COLOURS = {"text": (0, 200, 0), "picture": (255, 0, 0)}
EDGE = 2
AREA_LEVELS = ((0.0005, "low"), (0.005, "medium"), (0.02, "high"))
NAMES = ("original", "aligned", "difference_heatmap", "difference_pixels", "mask", "result")


def coloured(v: np.ndarray) -> np.ndarray:
    """(height, width, 3) of grey levels."""
    return np.repeat(v[..., None], 3, axis=2).astype(float)


def level(ratio: float) -> str:
    return next((name for limit, name in AREA_LEVELS if ratio < limit), "critical")


def drawn(v: np.ndarray, boxes: list[tuple], colours: list[tuple]) -> np.ndarray:
    """Colour picture with the edges of boxes (x, y, width, height) drawn in their colours, clipped to the picture."""
    out = v.copy() if v.ndim == 3 else coloured(v)
    for (x, y, w, h), colour in zip(boxes, colours, strict=True):
        x1, y1, x2, y2 = max(0, x), max(0, y), min(out.shape[1], x + w), min(out.shape[0], y + h)
        for rows, columns in ((slice(y1, min(y1 + EDGE, y2)), slice(x1, x2)), (slice(max(y1, y2 - EDGE), y2), slice(x1, x2)), (slice(y1, y2), slice(x1, min(x1 + EDGE, x2))), (slice(y1, y2), slice(max(x1, x2 - EDGE), x2))):
            out[rows, columns] = colour
    return out


def of_comparison(a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """The pictures of a comparison by name."""
    mask = images.difference_mask(a, b)
    found = images.difference_boxes(mask)
    marked = coloured(b)
    marked[mask > 0] = (0, 0, 255)
    boxes = list(zip(found["x"], found["y"], found["width"], found["height"], strict=True))
    result = drawn(b, boxes, [LEVEL_COLOURS[level(r)] for r in found["area_ratio"]])
    return dict(zip(NAMES, (a, b, images.heat(b, np.abs(a - b), mask), marked, mask * 255, result), strict=True))


def comparison_files(pairs: DataFrame) -> DataFrame:
    """pairs (gathered, planes a and b) -> image_id, name, png: every picture of a comparison as a file's content."""

    def kernel(a, b):
        found = of_comparison(a, b)
        return {"name": list(found), "png": [encode_png(v) for v in found.values()]}

    return images.map_images(pairs, kernel, "name string, png binary", "a", "b")


def region_files(pictures: DataFrame, plane: str) -> DataFrame:
    """pictures (gathered) -> image_id, n_text, n_picture, png: each picture with its text and picture regions drawn in."""

    def kernel(v):
        found = regions.separated(v)
        boxes = list(zip(*(found[c].tolist() for c in ("x", "y", "width", "height")), strict=True))
        shown = drawn(v, boxes, [KIND_COLOURS[k] for k in found["kind"]])
        return {"n_text": [found["kind"].count(regions.TEXT)], "n_picture": [found["kind"].count(regions.PICTURE)], "png": [encode_png(shown)]}

    return images.map_images(pictures, kernel, "n_text long, n_picture long, png binary", plane)
