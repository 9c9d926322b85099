"""Search for a selected part of one picture on the pages of another: rotations, sizes, scores, selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import images

# Fixed values of the search's rules.
ROTATIONS = (0, 90, 180, 270)
SCALES = (0.82, 0.90, 0.96, 1.0, 1.04, 1.10, 1.18)
LEAST_SIDE, GRAY_SHARE, EDGE_SHARE, BEST_OF_EACH = 20, 0.65, 0.35, 12


def grid(searches: DataFrame) -> DataFrame:
    """searches(..., width, height, page_width, page_height): a row for each rotation and scale the template is tried in, with
    the size it then has. width and height are the upright template's on the page, in pixels; sizes that don't fit go."""
    df = searches.withColumn("rotation", F.explode(F.array(*[F.lit(r).cast("long") for r in ROTATIONS])))
    df = df.withColumn("scale", F.explode(F.array(*map(F.lit, SCALES))))
    turned = F.col("rotation") % 180 == 90
    side = lambda upright, other: F.greatest(F.lit(LEAST_SIDE), F.rint(F.when(turned, F.col(other)).otherwise(F.col(upright)) * F.col("scale"))).cast("long")
    df = df.withColumns({"out_width": side("width", "height"), "out_height": side("height", "width")})
    return df.filter((F.col("out_width") < F.col("page_width")) & (F.col("out_height") < F.col("page_height")))


def scores(page: np.ndarray, page_edges: np.ndarray, template: np.ndarray, rotation: int, height: int, width: int) -> np.ndarray:
    """Score of a turned and resized template at each place of the page: correlation of grey levels and of edges."""
    turned = np.rot90(template, rotation // 90)
    shown = images.equalised(images.resized(turned, height, width, "area" if width < turned.shape[1] else "cubic"))
    gray = images.match_scores(page, shown)
    return GRAY_SHARE * gray + EDGE_SHARE * images.match_scores(page_edges, images.edges(shown).astype(float))


def search(pages: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of every template on the pages of its key.

    pages(keys, image_id, height, width, error, a) are gathered images; templates(keys, t_height, t_width, t, on_width,
    on_height) have the size that they would have on a page. Result: keys, image_id, rotation, scale, x, y, width, height,
    score, rank (best of each rotation and scale: greatest score, then greatest x and y). A page is searched for one
    template in one task, one rotation and scale at a time; memory is that of the page.
    """
    both = pages.filter("error IS NULL").join(templates, keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                page = np.asarray(r["a"], float).reshape(r["height"], r["width"])
                template = np.asarray(r["t"], float).reshape(r["t_height"], r["t_width"])
                yield found(page, template, r["on_width"], r["on_height"]).assign(**{k: r[k] for k in [*keys, "image_id"]})

    def found(page: np.ndarray, template: np.ndarray, on_width: float, on_height: float) -> pd.DataFrame:
        marks, rows = images.edges(page).astype(float), []
        for rotation in ROTATIONS:
            w, h = (on_height, on_width) if rotation % 180 else (on_width, on_height)
            for scale in SCALES:
                width, height = max(LEAST_SIDE, round(w * scale)), max(LEAST_SIDE, round(h * scale))
                if width < page.shape[1] and height < page.shape[0]:
                    best = images.local_maxima(scores(page, marks, template, rotation, height, width))
                    ranked = sorted(zip(best["score"].tolist(), best["x"].tolist(), best["y"].tolist(), strict=True), reverse=True)[:BEST_OF_EACH]
                    rows += [(rotation, scale, x, y, width, height, s, k) for k, (s, x, y) in enumerate(ranked, 1)]
        return pd.DataFrame(rows, columns=["rotation", "scale", "x", "y", "width", "height", "score", "rank"])

    kinds = ", ".join(f"{k} {both.schema[k].dataType.simpleString()}" for k in keys)
    return both.mapInPandas(run, f"rotation long, scale double, x long, y long, width long, height long, score double, rank long, {kinds}, image_id long")
