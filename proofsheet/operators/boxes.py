"""Greedy, order-dependent and grouping operators on boxes of a page.

Where the outcome depends on order, a page's boxes are sorted by the shuffle and stream through a task, which holds the
kept boxes of one page in a grid and compares a box with those near it only; pages are the unit of parallel work. Pair
predicates that need no order are joins on the page with a residual condition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import plane

# Fixed values of the checks' rules.
DEDUP_IOU, DEDUP_CONTAINMENT = 0.72, 0.88
SAME_IOU = 0.88
MATCH_LEAST, MATCH_FLOOR, MATCH_SHARE, MATCH_OVERLAP, MATCH_LIMIT = 0.38, 0.45, 0.76, 0.30, 8
NESTED_CONTAINMENT, NESTED_IOU, PANEL_AREA = 0.82, 0.55, 0.45
PICTURE_GAP, PICTURE_LEAST_GAP, PICTURE_AREA, UNITED_AREA = 0.008, 3, 0.45, 0.35
# Which lines and regions belong together: axis (0 is x), common share, distance in sides (of which axis), likeness.
LINES_STACKED = plane.Neighbours(axis=1, share=0.15, reach=0.90, measured=1, pick=max, alike=2.5)
LINE_FRAGMENTS = plane.Neighbours(axis=0, share=0.35, reach=2.2, measured=1, pick=max)
REGIONS_STACKED = plane.Neighbours(axis=1, share=0.20, reach=0.90, measured=1, pick=max, alike=2.5)
REGIONS_BESIDE = plane.Neighbours(axis=0, share=0.20, reach=0.35, measured=0, pick=min, alike=2.5)


XYWH = ("x", "y", "x + width", "y + height")
CORNERS = ("x1", "y1", "x2", "y2")


def by_page(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows dealt by keys, so that a key is in one partition, and sorted there by keys and order.

    The keys are dealt as one value: rows that a join left dealt by the same keys would be taken as they are, and adaptive
    execution may then cut a large partition of that join, and with it a key, in parts.
    """
    return rows.repartition(F.struct(*keys)).sortWithinPartitions(*keys, *order)


def greedy(boxes: DataFrame, keys: list[str], order: list[Column], fields: list[str], seen: tuple[str, ...], clash: Callable[[tuple, tuple], bool], limit: int | None = None) -> DataFrame:
    """Per key, take boxes in order and keep each that clashes with none kept before; up to limit of them.

    order: columns to sort by, ascending; fields: what is kept. clash(box, kept) is a predicate on the numbers that the
    expressions seen give, corners first; boxes that don't overlap must not clash.
    """
    out = [*keys, *[c for c in fields if c not in keys]]
    df = boxes.select(*[F.col(c) for c in out], F.struct(*[F.expr(e).alias(f"e{i}") for i, e in enumerate(seen)]).alias("b_seen"), *[c.alias(f"b_order{i}") for i, c in enumerate(order)])
    df = by_page(df, keys, *[f"b_order{i}" for i in range(len(order))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, None
        for batch in batches:
            taken = []
            names = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for name, box in zip(names, zip(*[c.to_pylist() for c in batch.column("b_seen").flatten()], strict=True), strict=True):
                if name != now:
                    now, kept = name, plane.Kept(clash, limit)
                taken.append(kept.take(box))
            yield batch.select(out).filter(pa.array(taken, pa.bool_()))

    return df.mapInArrow(run, ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in out))


def same_place(a: tuple, b: tuple) -> bool:
    return plane.iou(a, b) >= DEDUP_IOU or plane.containment(a, b) >= DEDUP_CONTAINMENT


def deduplicated(boxes: DataFrame, keys: list[str], fields: list[str], tie: str) -> DataFrame:
    """Larger boxes first; drop what overlaps a kept box or lies in it."""
    return greedy(boxes, keys, [-(F.col("width") * F.col("height")), F.col(tie)], fields, XYWH, same_place)


def distinct_in_order(boxes: DataFrame, keys: list[str], fields: list[str], tie: str) -> DataFrame:
    """Reading order; drop only what is nearly the same as a kept box."""
    order = [F.col("y"), F.col("x"), F.col("width") * F.col("height"), F.col(tie)]
    return greedy(boxes, keys, order, fields, XYWH, lambda b, k: plane.iou(b, k) >= SAME_IOU)


def selected_matches(candidates: DataFrame, keys: list[str], fields: list[str], tie: str, anchor: Column | None = None) -> DataFrame:
    """Per key, up to MATCH_LIMIT matches that do not overlap, best first, above a floor set by the best score.

    anchor: the score that sets the floor instead of the best one (null: the best one). Keys whose best score is under
    MATCH_LEAST give no rows. Only candidates above the floor are sorted.
    """
    best = candidates.groupBy(*keys).agg(F.max("score").alias("best"), *([F.max(anchor).alias("anchor")] if anchor is not None else []))
    top = F.coalesce("anchor", "best") if anchor is not None else F.col("best")
    floor = best.filter(F.col("best") >= MATCH_LEAST).select(*keys, F.greatest(F.lit(MATCH_FLOOR), top * MATCH_SHARE).alias("floor"))
    df = candidates.join(floor, keys).filter(F.col("score") >= F.col("floor"))
    # Matches of different pages do not overlap.
    clash = lambda b, k: b[4] == k[4] and plane.iou(b, k) >= MATCH_OVERLAP
    return greedy(df, keys, [-F.col("score"), F.col(tie)], fields, (*CORNERS, "page_index"), clash, MATCH_LIMIT)


def paragraph_rule(a: tuple, b: tuple) -> bool:
    """Two recognised lines (x1, y1, x2, y2) belong to one paragraph: stacked lines, or fragments of one line."""
    a, b = ((x[0], x[1], max(x[2], x[0] + 1.0), max(x[3], x[1] + 1.0)) for x in (a, b))
    return LINES_STACKED(a, b) or LINE_FRAGMENTS(a, b)


def region_rule(a: tuple, b: tuple) -> bool:
    """Two text regions (x1, y1, x2, y2) belong together: stacked lines, or neighbours of like width."""
    return REGIONS_STACKED(a, b) or REGIONS_BESIDE(a, b)


def joined_groups(rows: DataFrame, keys: list[str], tie: str, rule: Callable[[tuple, tuple], bool], reach: float) -> DataFrame:
    """rows(keys, tie, x1, y1, x2, y2, ...) with column root: the least tie of the box's group under rule.

    Boxes of a page are swept from top to bottom; only boxes whose vertical distance is within reach times the greatest
    height can be joined, so the sweep compares neighbours instead of all pairs.
    """
    def sweep(boxes: list[tuple], ties: list) -> list:
        up = list(range(len(boxes)))
        most = reach * max(max(b[3] - b[1], 1.0) for b in boxes)

        def find(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        open_: list[int] = []
        for i, b in enumerate(boxes):
            open_ = [j for j in open_ if boxes[j][3] + most >= b[1]]
            for j in open_:
                x, z = find(i), find(j)
                if x != z and rule(boxes[j], b):
                    if ties[z] < ties[x]:
                        x, z = z, x
                    up[z] = x
            open_.append(i)
        return [ties[find(i)] for i in range(len(boxes))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pages come one after the other; the parts of a page are put together once."""
        now, held = None, []
        for frame in frames:
            pages = list(zip(*[frame[k].map(repr) for k in keys], strict=True))
            cuts = [0, *[i for i in range(1, len(pages)) if pages[i] != pages[i - 1]], len(pages)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and pages[a] != now:
                    yield work(held)
                    held = []
                now = pages[a] if b > a else now
                held.append(frame.iloc[a:b])
        if held:
            yield work(held)

    def work(parts: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        boxes = list(zip(*[frame[c].astype(float) for c in CORNERS], strict=True))
        return frame.assign(root=sweep(boxes, frame[tie].tolist()) if boxes else [])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", root {rows.schema[tie].dataType.simpleString()}"
    return by_page(rows, keys, "y1", tie).mapInPandas(run, schema)


def without_panels(boxes: DataFrame, keys: list[str], tie: str, page_area: float) -> DataFrame:
    """Drop boxes that cover much of the page and hold two or more others."""
    big = boxes.filter(F.col("width") * F.col("height") >= PANEL_AREA * page_area)
    pair = big.alias("p").join(boxes.alias("c"), [F.col(f"p.{k}") == F.col(f"c.{k}") for k in keys])
    inside = g.containment(g.xywh(_named("c")), g.xywh(_named("p"))) >= NESTED_CONTAINMENT
    pair = pair.filter((F.col(f"p.{tie}") != F.col(f"c.{tie}")) & inside)
    panels = pair.groupBy(*[F.col(f"p.{k}").alias(k) for k in keys], F.col(f"p.{tie}").alias(tie)).agg(F.count("*").alias("held")).filter("held >= 2")
    return boxes.join(panels.select(*keys, tie), [*keys, tie], "left_anti")


class _named:
    """Columns of a DataFrame alias by name."""

    def __init__(self, alias: str):
        self.alias = alias

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.alias}.{name}")


def consolidated(regions: DataFrame, keys: list[str], tie: str, fields: list[str], page_area: float) -> DataFrame:
    """Text regions to paragraphs: whole-panel and nested boxes go, neighbours are joined and their boxes united."""
    df = without_panels(regions, keys, tie, page_area)
    nested = lambda b, k: plane.containment(b, k) >= NESTED_CONTAINMENT or plane.iou(b, k) >= NESTED_IOU
    df = greedy(df, keys, [-(F.col("width") * F.col("height")), F.col(tie)], fields, XYWH, nested)
    df = df.withColumns({"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height")})
    df = joined_groups(df, keys, tie, region_rule, 1.0)
    df = df.groupBy(*keys, "root").agg(*[f(c).alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max), ("confidence", F.max))], F.count("*").alias("members"))
    return df.select(*keys, "root", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), "confidence", "members")


def merged_along(boxes: DataFrame, keys: list[str], tie: str, horizontal: bool) -> DataFrame:
    """Character boxes to text lines along one axis. The boxes of a page are one frame; groups of two or more boxes are returned."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        b = frame.sort_values(tie)[["x", "y", "width", "height"]].to_numpy(float)
        groups, members = plane.lines(np.column_stack((b[:, :2], b[:, :2] + b[:, 2:])), 0 if horizontal else 1)
        groups, members = groups[members >= 2], members[members >= 2]
        out = pd.DataFrame(np.column_stack((groups[:, :2], groups[:, 2:] - groups[:, :2])).astype(np.int64), columns=["x", "y", "width", "height"])
        return out.assign(members=members, **{k: frame[k].iloc[0] for k in keys})

    kinds = ", ".join(f"{k} {boxes.schema[k].dataType.simpleString()}" for k in keys)
    return boxes.groupBy(*keys).applyInPandas(work, f"x long, y long, width long, height long, members long, {kinds}")


def absorbed(box: np.ndarray, others: np.ndarray, gap: np.ndarray, fits: Callable) -> tuple[np.ndarray, np.ndarray]:
    """(box grown by those of the others that it takes, which others are left). The others (corners, one a row) are looked
    at once, in order, always against the box as it is by then."""
    left, at = np.ones(len(others), bool), 0
    while at < len(others):
        low, high = np.minimum(box[:2], others[at:, :2]), np.maximum(box[2:], others[at:, 2:])
        meets = (np.minimum(box[2:] + gap, others[at:, 2:]) > np.maximum(box[:2] - gap, others[at:, :2])).all(1)
        found = np.flatnonzero(meets & fits((high - low).prod(1)))
        if not len(found):
            break
        k = found[0]
        box, at = np.concatenate((low[k], high[k])), at + k + 1
        left[at - 1] = False
    return box, left


def united_pictures(b: np.ndarray, width: int, height: int) -> np.ndarray:
    """Picture boxes (corners) that meet within a small gap are united, again and again, while the union stays small; then what
    lies in a larger one goes, the largest first. The last box comes first."""
    gap = np.array([max(PICTURE_LEAST_GAP, round(n * PICTURE_GAP)) for n in (width, height)])
    whole = max(width * height, 1)
    todo = b[(b[:, 2:] - b[:, :2]).prod(1) / whole <= PICTURE_AREA]
    while True:
        done, rest = [], todo
        while len(rest):
            box, left = absorbed(rest[-1], rest[:-1], gap, lambda area: area / whole <= UNITED_AREA)
            done.append(box)
            rest = rest[:-1][left]
        found = np.array(done).reshape(-1, 4)
        if len(found) == len(todo):
            break
        todo = found
    found = found[np.argsort(-(found[:, 2:] - found[:, :2]).prod(1), kind="stable")]
    kept = plane.Kept(same_place)
    return found[np.array([kept.take(tuple(r)) for r in found.tolist()], bool)]


def merged_pictures(boxes: DataFrame, keys: list[str], tie: str, width: int, height: int) -> DataFrame:
    """united_pictures of each page, numbered. The outcome depends on order, so a page is worked on as one frame."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        b = frame.sort_values(tie)[["x", "y", "width", "height"]].to_numpy()
        found = united_pictures(np.column_stack((b[:, :2], b[:, :2] + b[:, 2:])), width, height)
        out = pd.DataFrame(np.column_stack((found[:, :2], found[:, 2:] - found[:, :2])), columns=["x", "y", "width", "height"])
        return out.assign(**{k: frame[k].iloc[0] for k in keys}, number=range(len(out)))

    schema = "x long, y long, width long, height long, " + ", ".join(f"{k} long" for k in keys) + ", number long"
    return boxes.groupBy(*keys).applyInPandas(work, schema)


def batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Parts of at most size rows, for models with bounded batches."""
    for frame in frames:
        for i in range(0, len(frame), size):
            yield frame.iloc[i : i + size]
