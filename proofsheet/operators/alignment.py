"""Keypoint matching, similarity transforms and what they say about movement."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import images

# Fixed values of the checks' rules.
KEEP_RATIO, MIN_MATCHES = 0.25, 8
MIN_INLIERS, MAX_ROTATION, MIN_SCALE, MAX_SCALE = 0.20, 10.0, 0.85, 1.15
MOVED_RATIO, MOVED_PIXELS, MOVED_ROTATION, MOVED_SCALE = 0.005, 3.0, 0.5, 0.01
REACH = 3.0
MAX_FEATURES = 3000
#: Side of the square around a corner that its descriptor looks at, halved.
AROUND = 8
#: Points or hypotheses that are worked on together.
ROWS = 512
FEW_INLIERS, TURNED, SCALED, JOINED = "RANSAC 内点比例过低: %.1f%% < 20.0%%", "旋转角度异常: %.2f°", "缩放比例异常: %.4f", "；"


def _of_keys(df: DataFrame, keys: list[str], schema: str, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """work on all rows of a key as one frame; keys are put first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = work(frame)
        for i, k in enumerate(keys):
            out.insert(i, k, frame[k].iloc[0])
        return out

    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    return df.groupBy(*keys).applyInPandas(run, kinds + schema)


def each_others_nearest(xa: np.ndarray, xb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of the descriptors (rows of 64-bit numbers) xa[i] and xb[j] that are each other's nearest."""
    if not len(xa) or not len(xb):
        return (np.zeros(0, np.int64),) * 3
    of_a, how_far = np.zeros(len(xa), np.int64), np.zeros(len(xa), np.int64)
    of_b, least = np.zeros(len(xb), np.int64), np.full(len(xb), 1 << 30)
    for k in range(0, len(xa), ROWS):
        d = np.bitwise_count(xa[k : k + ROWS, None] ^ xb[None]).sum(2, dtype=np.int64)
        of_a[k : k + ROWS], how_far[k : k + ROWS] = d.argmin(1), d.min(1)
        nearer = d.min(0) < least
        of_b[nearer], least[nearer] = k + d.argmin(0)[nearer], d.min(0)[nearer]
    i = np.flatnonzero(of_b[of_a] == np.arange(len(xa)))
    return i, of_a[i], how_far[i]


def mutual_nearest(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, distance: points of side 0 and 1 of the same image pair that are each other's nearest.

    An image pair holds a bounded number of points; its distances are worked out ROWS points at a time, and no pair of
    points is ever a row. Ties go to the smaller id.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("kp_id")
        (ia, xa), (ib, xb) = ((f["kp_id"].to_numpy(), f[["d0", "d1"]].to_numpy().astype(np.uint64)) for f in (frame[frame["side"] == s] for s in (0, 1)))
        i, j, distance = each_others_nearest(xa, xb)
        return pd.DataFrame({"a": ia[i], "b": ib[j], "distance": distance})

    return _of_keys(points.select(*keys, "kp_id", "side", "d0", "d1"), keys, "a long, b long, distance long", work)


def keep_best(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest matches: a share of them, MIN_MATCHES at least; rank by distance."""
    whole = Window.partitionBy(*keys)
    df = matches.withColumns({"rank": F.row_number().over(whole.orderBy("distance", "a", "b")), "n": F.count("*").over(whole)})
    return df.filter(F.col("rank") <= F.greatest(F.lit(MIN_MATCHES), F.rint(F.col("n") * KEEP_RATIO)))


def decomposed(a: Column, b: Column) -> tuple[Column, Column]:
    """Scale and rotation (degrees) of the matrix [a -b; b a]."""
    return F.sqrt(a * a + b * b), F.degrees(F.atan2(b, a))


def nearest_turn(rotation: Column, expected: Column) -> Column:
    """The rotation (degrees) with as many whole turns, which a transform does not tell, as bring it nearest to an expected one."""
    return rotation + 360 * F.rint((expected - rotation) / 360)


def rejection(inlier_ratio: Column, rotation: Column, scale: Column) -> Column:
    """Reasons why a transform is not trusted, joined; empty if it is."""
    reasons = (
        F.when(inlier_ratio < MIN_INLIERS, F.format_string(FEW_INLIERS, inlier_ratio * 100)),
        F.when(F.abs(rotation) > MAX_ROTATION, F.format_string(TURNED, rotation)),
        F.when((scale < MIN_SCALE) | (scale > MAX_SCALE), F.format_string(SCALED, scale)),
    )
    return F.concat_ws(JOINED, *reasons)


def movement(x: Column, y: Column, rotation: Column, scale: Column, success: Column, width: Column, height: Column) -> dict[str, Column]:
    """Status and amounts of a region's movement; a failed alignment is uncertain and moves nothing."""
    shift = F.sqrt(x * x + y * y)
    diagonal = F.sqrt(width * width + height * height)
    share = F.when(diagonal > 0, shift / diagonal).otherwise(0.0)
    far = F.when(diagonal > 0, share >= MOVED_RATIO).otherwise(shift >= MOVED_PIXELS)
    turn, change = F.abs(rotation), F.abs(scale - 1)
    moved = success & (far | (turn >= MOVED_ROTATION) | (change >= MOVED_SCALE))
    amount = lambda c: F.when(success, c).otherwise(0.0)
    return {
        "status": F.when(~success, "uncertain").when(moved, "moved").otherwise("not_moved"), "movement_detected": moved, "translation_pixels": amount(F.round(shift, 3)),
        "translation_ratio": amount(share), "rotation": amount(turn), "scale_change": amount(change),
    }


def best_transform(a: np.ndarray, b: np.ndarray) -> tuple[complex, complex, np.ndarray] | None:
    """(turn, shift, which pairs agree) of the similarity a = turn * b + shift that most pairs of points (complex numbers)
    agree with, refitted to them; None without two distinct points. Of equal hypotheses the first one wins."""
    best, votes = None, 0
    for i in range(len(a) - 1):
        d = b[i + 1 :] - b[i]
        turn = (a[i + 1 :] - a[i])[d != 0] / d[d != 0]
        for k in range(0, len(turn), ROWS):
            near = np.abs(turn[k : k + ROWS, None] * (b - b[i]) + a[i] - a) <= REACH
            count = near.sum(1)
            if len(count) and count.max() > votes:
                best, votes = near[count.argmax()], int(count.max())
    if best is None or np.ptp(b[best].real) + np.ptp(b[best].imag) == 0:
        return None
    ca, cb = a[best].mean(), b[best].mean()
    turn = ((a[best] - ca) * (b[best] - cb).conj()).sum() / (np.abs(b[best] - cb) ** 2).sum()
    return turn, ca - turn * cb, best


def fitted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Similarity transform of point pairs (keys, pair_id, ax, ay, bx, by) from b to a, in closed form with one refit.

    A hypothesis comes from every two pairs of a key; the one with most inliers wins (ties: the first by pair_id), and least
    squares over its inliers gives the result. Deterministic. A key's pairs, which keep_best holds few, are one array; its
    hypotheses are tried ROWS points' worth at a time. Keys without two distinct points give no row.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pair_id")
        a, b = (frame[c].to_numpy(float) @ np.array([1, 1j]) for c in (["ax", "ay"], ["bx", "by"]))
        found = best_transform(a, b)
        if found is None:
            return pd.DataFrame({c: [] for c in ("scale", "rotation", "x", "y", "inliers", "matched")})
        turn, at, near = found
        return pd.DataFrame({"scale": [abs(turn)], "rotation": [np.degrees(np.angle(turn))], "x": [at.real], "y": [at.imag], "inliers": [int(near.sum())], "matched": [len(a)]})

    return _of_keys(pairs.select(*keys, "pair_id", "ax", "ay", "bx", "by"), keys, "scale double, rotation double, x double, y double, inliers long, matched long", work)


def corners(v: np.ndarray, most: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(places as complex numbers, descriptors) of a picture's strongest corners: a detector where no other one is given.

    A descriptor compares 64 fixed pairs of places around the corner in the blurred picture.
    """
    smooth = images.blur(v, images.gaussian(7, 2.0))
    gy, gx = np.gradient(smooth)
    xx, yy, xy = (images.blur(m, images.gaussian(5)) for m in (gx * gx, gy * gy, gx * gy))
    strength = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
    inner = np.zeros(v.shape, bool)
    inner[AROUND:-AROUND, AROUND:-AROUND] = True
    y, x = np.nonzero(inner & (strength > 1e-3) & (strength >= images.dilate(strength, 5)))
    order = np.lexsort((x, y, -strength[y, x]))[:most]
    y, x = y[order], x[order]
    at = np.random.default_rng(64).integers(-AROUND, AROUND + 1, (4, 64))
    bits = smooth[y[:, None] + at[0], x[:, None] + at[1]] < smooth[y[:, None] + at[2], x[:, None] + at[3]]
    return x + 1j * y, np.packbits(bits, axis=1).view(np.uint64)


def aligned(a: np.ndarray, b: np.ndarray, detector: Callable = corners) -> tuple[np.ndarray, dict]:
    """(b in a's size and place, record): corners of both, each other's nearest, the best share of them, the transform that
    most agree with. One that is not found or not trusted leaves b as it is, with the reason."""
    b = images.resized_to(b, *a.shape)[0]
    (pa, da), (pb, db) = detector(a), detector(b)
    i, j, distance = each_others_nearest(db, da)
    kept = np.lexsort((j, i, distance))[: max(MIN_MATCHES, round(len(i) * KEEP_RATIO))]
    i, j = i[kept], j[kept]
    record = {"x": 0.0, "y": 0.0, "rotation_degrees": 0.0, "scale": 1.0, "matched_features": len(i), "inlier_features": 0, "inlier_ratio": 0.0, "success": False, "reason": ""}
    found = best_transform(pa[j], pb[i]) if len(i) >= MIN_MATCHES else None
    if found is None:
        return b, record | {"reason": "too few matches" if len(i) < MIN_MATCHES else "no transform"}
    turn, at, near = found
    record |= {"inlier_features": int(near.sum()), "inlier_ratio": round(float(near.mean()), 4)}
    scale, rotation = abs(turn), float(np.degrees(np.angle(turn)))
    reasons = [t % v for bad, t, v in ((near.mean() < MIN_INLIERS, FEW_INLIERS, near.mean() * 100), (abs(rotation) > MAX_ROTATION, TURNED, rotation), (not MIN_SCALE <= scale <= MAX_SCALE, SCALED, scale)) if bad]
    if reasons:
        return b, record | {"reason": JOINED.join(reasons)}
    moved = images.warped(b, scale, rotation, at.real, at.imag, *a.shape)
    return moved, record | {"x": round(at.real, 3), "y": round(at.imag, 3), "rotation_degrees": round(rotation, 4), "scale": round(float(scale), 6), "success": True}


def identity_result(reason: Column, matched: Column, inliers: Column) -> dict[str, Column]:
    """What stands for a transform that was not found or not trusted: no movement, with the reason and the counts."""
    zero = F.lit(0.0)
    share = F.when(matched > 0, F.round(inliers / matched, 4)).otherwise(zero)
    return {"x": zero, "y": zero, "rotation_degrees": zero, "scale": F.lit(1.0), "matched_features": matched, "inlier_features": inliers, "inlier_ratio": share, "success": F.lit(False), "reason": reason}
