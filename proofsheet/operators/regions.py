"""Candidate regions of a picture: characters to text lines, contours to picture regions, one kernel an image.

All work on an image happens in its task; what is shuffled is the gathering of its rows. Detectors of stable regions are
a seam: a function from grey levels to boxes, none by default.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plane
from . import boxes, images, models

# Fixed values of the rules: shares of the picture's area and sides, densities of edges, sides of kernels.
COMPONENT_LEAST, COMPONENT_MOST = 0.000005, 0.65
CHARACTER_AREA, CHARACTER_HEIGHT, CHARACTER_ASPECT, CHARACTER_SPREAD = 0.04, 0.12, (0.08, 12), 20
TEXT_EDGES, BALANCE, TEXT_AREA, TEXT_ASPECT, TEXT_HEIGHT = 0.015, 0.008, 0.02, (0.08, 60.0), 0.30
LONG, TALL, TINY = 2.5, 0.5, 0.005
PICTURE_AREAS, PICTURE_ASPECT, PICTURE_EDGES, PICTURE_LARGE, IN_TEXT = (0.001, 0.45), (0.05, 20.0), 0.008, 0.02, 0.65
PADDING, CLOSING = 0.003, 0.012
TEXT, PICTURE = "text", "picture"


class Picture:
    """A picture's levels, its dark and light foregrounds and edges, and sums of them over boxes (corners, one a row)."""

    def __init__(self, v: np.ndarray):
        self.v, self.size = v, v.size
        self.foregrounds = images.adaptive_foreground(np.floor(images.blur(v, images.gaussian(3)) + 0.5))
        self.edges = images.edges(v)
        self._sums = {k: np.pad(m.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1) for k, m in (("edges", self.edges), ("dark", self.foregrounds[0]), ("v", v.astype(np.int64)), ("vv", v.astype(np.int64) ** 2))}

    def mean(self, what: str, b: np.ndarray) -> np.ndarray:
        t, (x1, y1, x2, y2) = self._sums[what], b.astype(np.int64).T
        return (t[y2, x2] - t[y1, x2] - t[y2, x1] + t[y1, x1]) / np.maximum((x2 - x1) * (y2 - y1), 1)

    def shape(self, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(width, height, share of the area, aspect, balance of fore- and background) of boxes."""
        w, h = (b[:, 2:] - b[:, :2]).T
        dark = self.mean("dark", b)
        return w, h, w * h / self.size, w / np.maximum(h, 1), np.minimum(dark, 1 - dark)

    def components(self) -> np.ndarray:
        """Boxes of the components of both foregrounds whose pixels are a sensible share of the picture."""
        found = []
        for mask in self.foregrounds:
            c = images.component_boxes(mask)
            good = (c["area"] >= max(2, round(self.size * COMPONENT_LEAST))) & (c["area"] <= round(self.size * COMPONENT_MOST))
            found.append(np.column_stack([c["x"], c["y"], c["x"] + c["width"], c["y"] + c["height"]])[good])
        return np.concatenate(found)

    def characters(self, b: np.ndarray) -> np.ndarray:
        w, h, area, aspect, balance = self.shape(b)
        mean = self.mean("v", b)
        spread = np.sqrt(np.maximum(self.mean("vv", b) - mean * mean, 0))
        good = (w >= 2) & (h >= 3) & (h <= self.v.shape[0] * CHARACTER_HEIGHT) & (area <= CHARACTER_AREA) & between(aspect, CHARACTER_ASPECT)
        return b[good & (self.mean("edges", b) >= TEXT_EDGES) & ((balance >= BALANCE) | (spread >= CHARACTER_SPREAD))]

    def texts(self, b: np.ndarray) -> np.ndarray:
        _, h, area, aspect, balance = self.shape(b)
        lines = (aspect >= LONG) | (aspect <= TALL) | (area <= TINY)
        good = (area <= TEXT_AREA) & between(aspect, TEXT_ASPECT) & (h <= self.v.shape[0] * TEXT_HEIGHT) & lines
        return distinct(b[good & (self.mean("edges", b) >= TEXT_EDGES) & (balance >= BALANCE)])

    def pictures(self, components: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Boxes of what hangs together once the edges of texts are gone, and of large components, united and filtered."""
        height, width = self.v.shape
        left, pad = self.edges.copy(), max(2, round(min(width, height) * PADDING))
        for x1, y1, x2, y2 in texts.astype(int).tolist():
            left[max(0, y1 - pad) : y2 + pad + 1, max(0, x1 - pad) : x2 + pad + 1] = False
        closed = left.astype(float)
        sides = [max(3, round(n * CLOSING)) for n in (height, width)]
        for best, outside in ((np.maximum, -np.inf), (np.maximum, -np.inf), (np.minimum, np.inf), (np.minimum, np.inf)):
            closed = images.slide_box(closed, *sides, best, outside)
        c = images.component_boxes(images.dilate(closed, 3) > 0)
        found = np.concatenate((np.column_stack([c["x"], c["y"], c["x"] + c["width"], c["y"] + c["height"]]), components))
        found = found[between(self.shape(found)[2], PICTURE_AREAS)]
        found = boxes.united_pictures(found, width, height)
        w, h, area, aspect, _ = self.shape(found)
        in_text = np.array([any(plane.containment(b, t) >= IN_TEXT for t in texts.tolist()) for b in found.tolist()], bool)
        good = ~in_text & between(area, PICTURE_AREAS) & between(aspect, PICTURE_ASPECT)
        return distinct(found[good & ((self.mean("edges", found) >= PICTURE_EDGES) | (area >= PICTURE_LARGE))])


def between(v: np.ndarray, limits: tuple[float, float]) -> np.ndarray:
    return (v >= limits[0]) & (v <= limits[1])


def distinct(b: np.ndarray) -> np.ndarray:
    """Larger boxes first, without what lies in a kept one or is nearly the same."""
    b = b[np.argsort(-(b[:, 2:] - b[:, :2]).prod(1), kind="stable")] if len(b) else b.reshape(0, 4)
    kept = plane.Kept(boxes.same_place)
    return b[[kept.take(tuple(r)) for r in b.tolist()]] if len(b) else b


def _lines(picture: Picture, components: np.ndarray, detector: Callable | None) -> np.ndarray:
    every = components if detector is None else np.concatenate((np.asarray(detector(picture.v), float).reshape(-1, 4), components))
    characters = distinct(picture.characters(every))
    both = [plane.lines(characters, axis) for axis in (0, 1)]
    return np.concatenate([g[n >= 2] for g, n in both])


def separated(v: np.ndarray, detector: Callable | None = None) -> dict:
    """Text and picture regions of a picture, each from top to bottom, as columns."""
    picture = Picture(v)
    components = picture.components()
    texts = picture.texts(_lines(picture, components, detector))
    return _columns([(TEXT, texts), (PICTURE, picture.pictures(components, texts))])


def candidates(v: np.ndarray, detector: Callable | None = None) -> dict:
    """Text lines and picture regions that are still to be classified; of nearly equal ones the first in reading order."""
    picture = Picture(v)
    components = picture.components()
    found = np.concatenate((_lines(picture, components, detector), picture.pictures(components, np.zeros((0, 4)))))
    found = found[np.lexsort(((found[:, 2:] - found[:, :2]).prod(1), found[:, 0], found[:, 1]))]
    kept = plane.Kept(lambda b, k: plane.iou(b, k) >= boxes.SAME_IOU)
    return _columns([("candidate", found[[kept.take(tuple(r)) for r in found.tolist()]] if len(found) else found)])


def _columns(kinds: list[tuple[str, np.ndarray]]) -> dict:
    kind, b = [], []
    for name, found in kinds:
        found = found[np.lexsort((found[:, 0], found[:, 1]))]
        kind += [name] * len(found)
        b.append(found)
    b = np.concatenate(b).astype(np.int64)
    return {"kind": kind, "number": np.arange(1, len(b) + 1), "x": b[:, 0], "y": b[:, 1], "width": b[:, 2] - b[:, 0], "height": b[:, 3] - b[:, 1]}


SCHEMA = "kind string, number long, x long, y long, width long, height long"


def classified(pictures: DataFrame, plane_name: str, factory: Callable = models.stand_in) -> DataFrame:
    """pictures (gathered) -> image_id, number, x, y, width, height, class_id, class_name, confidence, error of each candidate.

    A picture without any candidate has one row with the error no_regions; one that can't be read keeps its own error.
    """
    found = images.map_images(pictures, candidates, SCHEMA, plane_name)
    df = models.predicted(found.filter("error IS NULL"), ["width", "height"], factory).drop("error")
    df = df.withColumn("p", models.softmax(F.col("logits"))).withColumn("class_id", models.chosen(F.col("p")))
    df = df.withColumns({"class_name": F.element_at(F.array(*map(F.lit, models.CLASSES)), (F.col("class_id") + 1).cast("int")), "confidence": F.array_max("p")})
    df = df.withColumn("error", models.routing_error())
    out = ["image_id", "number", "x", "y", "width", "height", "class_id", "class_name", "confidence", "error"]
    none = pictures.select("image_id", F.coalesce("error", F.lit("no_regions")).alias("error")).join(df.select("image_id"), "image_id", "left_anti")
    return df.select(*out).unionByName(none, allowMissingColumns=True)
