"""Dense image kernels: one row an image, NumPy inside Arrow batches.

An image is (image_id, height, width, error, plane...) where a plane is its samples row by row. A single image is bounded
by the pixel budget (MAX_PIXELS, checked before samples are gathered), so a task holds few of them; the number of images
is not bounded and needs no shuffle beyond the one that gathers rows of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIXELS = 20_000_000

# Fixed values of the checks' rules.
DIFFERENCE_THRESHOLD = 25
SSIM_KERNEL, SSIM_SIGMA, DYNAMIC_RANGE, K1, K2 = 11, 1.5, 255, 0.01, 0.03
GRID, WORST_FRACTION, ANOMALY = 4, 0.25, 0.95
#: Rows of a picture that are summed together.
BAND = 256
MIN_AREA, MERGE_GAP = 30, 5
MAXIMA_SIZE, MIN_MATCH = 17, 0.38


def sizes(rows: DataFrame, plane: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """image_id, height, width and an error for images over the pixel budget, from rows (image_id, y, planes as arrays)."""
    df = rows.groupBy("image_id").agg((F.max("y") + 1).alias("height"), F.max(F.size(plane)).cast("long").alias("width"))
    return df.withColumn("error", F.when(F.col("height") * F.col("width") > max_pixels, "over_budget"))


def gather(rows: DataFrame, *planes: str, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Rows of images (image_id, y, planes as arrays) to one row an image: height, width, error, planes.

    Sizes come first, from partial aggregates; an image over the budget is never gathered and keeps its row, with an
    error and without samples.
    """
    found = sizes(rows, planes[0], max_pixels)
    good = rows.join(found.filter("error IS NULL").select("image_id"), "image_id", "left_semi")
    df = good.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", *planes))).alias("p"))
    return found.join(df.select("image_id", *[F.flatten(F.col(f"p.{c}")).alias(c) for c in planes]), "image_id", "left")


def map_images(images: DataFrame, kernel: Callable, schema: str, *planes: str) -> DataFrame:
    """kernel(*planes as 2-D arrays) gives a dict of equally long columns for each image; image_id is put first and the
    image's error last. An image with an error gives one row without values."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                error = getattr(r, "error", None)
                if error is None:
                    shape = (int(r.height), int(r.width))
                    found = pd.DataFrame(kernel(*[np.asarray(getattr(r, c), float).reshape(shape) for c in planes]))
                else:
                    found = pd.DataFrame({c: [None] for c in names})
                found.insert(0, "image_id", r.image_id)
                found["error"] = error
                yield found

    return images.mapInPandas(run, f"image_id long, {schema}, error string")


def gaussian(size: int, sigma: float = 0) -> np.ndarray:
    """Normalised kernel; without a sigma small sizes have the usual binomial one."""
    if sigma <= 0:
        if size in (1, 3, 5):
            return {1: np.array([1.0]), 3: np.array([1.0, 2, 1]) / 4, 5: np.array([1.0, 4, 6, 4, 1]) / 16}[size]
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def blur(v: np.ndarray, kernel: np.ndarray, border: str = "reflect") -> np.ndarray:
    """Separable filter; border reflect (without the edge) or edge."""
    r = len(kernel) // 2
    out = np.pad(v, ((0, 0), (r, r)), border)
    out = sum(w * out[:, i : i + v.shape[1]] for i, w in enumerate(kernel))
    out = np.pad(out, ((r, r), (0, 0)), border)
    return sum(w * out[i : i + v.shape[0]] for i, w in enumerate(kernel))


def slide(v: np.ndarray, size: int, best: Callable, outside: float) -> np.ndarray:
    """Sliding minimum or maximum over a square; places outside the image don't count."""
    return slide_box(v, size, size, best, outside)


def slide_box(v: np.ndarray, height: int, width: int, best: Callable, outside: float) -> np.ndarray:
    """Sliding minimum or maximum over a rectangle around each place (of even sides the middle is the later one)."""
    p = np.pad(v, ((height // 2, (height - 1) // 2), (width // 2, (width - 1) // 2)), constant_values=outside)
    rows = best.reduce([p[:, i : i + v.shape[1]] for i in range(width)])
    return best.reduce([rows[i : i + v.shape[0]] for i in range(height)])


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    return slide(mask, size, np.maximum, -np.inf)


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    return slide(mask, size, np.minimum, np.inf)


def opened_closed(mask: np.ndarray, size: int = 3, iterations: int = 1) -> np.ndarray:
    """Opening, then closing, each with its steps repeated."""
    for first, second in ((erode, dilate), (dilate, erode)):
        for step in (first, second):
            for _ in range(iterations):
                mask = step(mask, size)
    return mask


def difference_mask(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return opened_closed((np.abs(a - b) > DIFFERENCE_THRESHOLD).astype(float))


def ssim_map(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = gaussian(SSIM_KERNEL, SSIM_SIGMA)
    c1, c2 = (K1 * DYNAMIC_RANGE) ** 2, (K2 * DYNAMIC_RANGE) ** 2
    ma, mb = blur(a, k), blur(b, k)
    va, vb, both = blur(a * a, k) - ma * ma, blur(b * b, k) - mb * mb, blur(a * b, k) - ma * mb
    low = (ma * ma + mb * mb + c1) * (va + vb + c2)
    return (2 * ma * mb + c1) * (2 * both + c2) / np.maximum(low, np.finfo(float).eps)


def cells(height: int, width: int, grid: int = GRID) -> list[tuple[int, int, int, int]]:
    """(top, bottom, left, right) of a grid with evenly spaced integer edges; empty cells are left out."""
    rows, columns = np.linspace(0, height, grid + 1, dtype=int), np.linspace(0, width, grid + 1, dtype=int)
    return [(t, b, le, r) for t, b in zip(rows, rows[1:], strict=False) for le, r in zip(columns, columns[1:], strict=False) if b > t and r > le]


def ssim_cells(a: np.ndarray, b: np.ndarray) -> dict:
    m = ssim_map(a, b)
    at = cells(*m.shape)
    mean = [float(np.clip(m[t:bo, le:r].mean(), -1, 1)) for t, bo, le, r in at]
    return {"x": [c[2] for c in at], "y": [c[0] for c in at], "width": [c[3] - c[2] for c in at], "height": [c[1] - c[0] for c in at], "ssim": mean}


def labelled(mask: np.ndarray) -> np.ndarray:
    """Number of each set pixel's 8-connected component, from 1, by runs of each row and a union of touching runs."""
    up: list[int] = []

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    runs: list[tuple[int, int, int]] = []
    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask > 0):
        edge = np.diff(row.astype(np.int8), prepend=0, append=0)
        now, first = [], 0
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            k = len(up)
            up.append(k)
            runs.append((y, a, b))
            now.append((a, b, k))
            while first < len(before) and before[first][1] < a:  # ends left of all runs to come
                first += 1
            for at in range(first, len(before)):
                if before[at][0] > b:
                    break
                x, z = find(before[at][2]), find(k)
                up[max(x, z)] = min(x, z)
        before = now
    out = np.zeros(mask.shape, np.int64)
    names: dict[int, int] = {}
    for k, (y, a, b) in enumerate(runs):
        out[y, a:b] = names.setdefault(find(k), len(names) + 1)
    return out


def component_boxes(mask: np.ndarray) -> dict:
    """Bounding box and size of each component, in one pass over the set pixels."""
    found = labelled(mask)
    y, x = np.nonzero(found)
    k, n = found[y, x] - 1, int(found.max(initial=0))
    low, high = np.full((2, n), max(mask.shape)), np.full((2, n), -1)
    for axis, v in enumerate((x, y)):
        np.minimum.at(low[axis], k, v)
        np.maximum.at(high[axis], k, v)
    return {"x": low[0], "y": low[1], "width": high[0] - low[0] + 1, "height": high[1] - low[1] + 1, "area": np.bincount(k, minlength=n)}


def difference_boxes(mask: np.ndarray, min_area: float = MIN_AREA, gap: int = MERGE_GAP) -> dict:
    """Boxes of changed places: components of the mask widened by gap, narrowed again, with the mask's own pixels counted.

    A component's area is its number of pixels, not the polygon area of its outline; components inside holes count too.
    """
    height, width = mask.shape
    wide = component_boxes(dilate(mask, 2 * gap + 1) if gap else mask)
    out = {"x": [], "y": [], "width": [], "height": [], "area": [], "area_ratio": []}
    for x, y, w, h, area in zip(*wide.values(), strict=True):
        if area < min_area:
            continue
        box = (max(0, x + gap), max(0, y + gap), min(width, x + w - gap), min(height, y + h - gap))
        if box[2] <= box[0] or box[3] <= box[1]:
            box = (max(0, x), max(0, y), min(width, x + w), min(height, y + h))
        changed = int((mask[box[1] : box[3], box[0] : box[2]] > 0).sum())
        if changed >= min_area:
            for name, v in zip(out, (box[0], box[1], box[2] - box[0], box[3] - box[1], changed, changed / mask.size), strict=True):
                out[name].append(v)
    return out


def local_maxima(score: np.ndarray, size: int = MAXIMA_SIZE, least: float = MIN_MATCH) -> dict:
    y, x = np.nonzero((score >= dilate(score, size)) & (score >= least))
    return {"x": x, "y": y, "score": score[y, x]}


def window_sums(v: np.ndarray, height: int, width: int) -> np.ndarray:
    """Sums of all windows of this size, by a table of sums."""
    t = np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return t[height:, width:] - t[:-height, width:] - t[height:, :-width] + t[:-height, :-width]


def band_sums(boxes: np.ndarray, y: np.ndarray, lengths: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, sum) of the whole-numbered samples in each box (x, y, width, height, one a row); samples are those of the rows y,
    one after the other, lengths of them in each. Rows may be missing or of different lengths."""
    first, height, width = y.min(), int(np.ptp(y)) + 1, int(lengths.max())
    at = np.repeat((y - first) * width - np.concatenate(([0], lengths.cumsum()[:-1])), lengths) + np.arange(len(samples))
    x1, y1, x2, y2 = (np.clip(v, 0, most) for v, most in ((boxes[:, 0], width), (boxes[:, 1] - first, height), (boxes[:, 0] + boxes[:, 2], width), (boxes[:, 1] + boxes[:, 3] - first, height)))
    out = []
    for weights_ in (None, samples):
        v = np.bincount(at, weights_, height * width).astype(np.int64).reshape(height, width)
        t = np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        out.append(t[y2, x2] - t[y1, x2] - t[y2, x1] + t[y1, x1])
    return out[0], out[1]


def box_sums(boxes: DataFrame, rows: DataFrame, plane: str) -> DataFrame:
    """boxes (image_id, x, y, width, height, ...) with n and total: the number and the sum of the samples of rows (image_id, y,
    plane as arrays of whole numbers) in each. Equal boxes are one; boxes without samples are left out.

    Pictures and boxes are cut into bands of rows, and a task holds one band of a picture with its boxes. The work follows the
    samples and the number of boxes, not the boxes' areas, and nothing is broadcast.
    """
    out = boxes.columns
    band = lambda c: F.floor(c / BAND)
    some = boxes.filter("width > 0 AND height > 0").withColumn("band", F.explode(F.sequence(band(F.col("y")), band(F.col("y") + F.col("height") - 1))))

    def work(part: pa.Table, picture: pa.Table) -> pa.Table:
        lists = picture[plane].combine_chunks()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = total = np.zeros(len(part), np.int64)
        if len(part) and lengths.any():
            corners = np.column_stack([part[c].to_numpy() for c in ("x", "y", "width", "height")])
            n, total = band_sums(corners, picture["y"].to_numpy(), lengths, lists.flatten().to_numpy(zero_copy_only=False))
        return part.select(out).append_column("n", pa.array(n)).append_column("total", pa.array(total)).filter(pa.array(n > 0))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema) + ", n long, total long"
    pictures = rows.select("image_id", "y", plane, band(F.col("y")).alias("band")).groupBy("image_id", "band")
    df = some.groupBy("image_id", "band").cogroup(pictures).applyInArrow(work, schema)
    return df.groupBy(*out).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def match_scores(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation of the template with each place of the image; flat places have 0.

    Products by Fourier transforms, means and spreads by tables of sums: the work does not grow with the template.
    """
    h, w = template.shape
    shape = [n + m - 1 for n, m in zip(image.shape, template.shape, strict=True)]
    t = template - template.mean()
    around = np.fft.irfft2(np.fft.rfft2(image - image.mean(), shape) * np.fft.rfft2(t[::-1, ::-1], shape), shape)
    top = around[h - 1 : image.shape[0], w - 1 : image.shape[1]]
    total = window_sums(image, h, w)
    spread = window_sums(image * image, h, w) - total * total / template.size
    flat = spread <= 1e-9 * np.maximum(1.0, total * total / template.size)
    low = np.sqrt(np.maximum(spread, 0) * (t * t).sum())
    return np.where(flat | (low <= 1e-9), 0.0, top / np.where(low > 1e-9, low, 1))


def weights(n: int, m: int, how: str) -> np.ndarray:
    """(m, n) weights that resample n samples to m: area (means of what a new sample covers), linear or cubic."""
    out = np.zeros((m, n))
    if how == "area" and m < n:
        edge = np.arange(m + 1) * (n / m)
        cover = np.minimum(edge[1:, None], np.arange(1, n + 1)) - np.maximum(edge[:-1, None], np.arange(n))
        return np.maximum(cover, 0) * (m / n)
    at = (np.arange(m) + 0.5) * (n / m) - 0.5
    low = np.floor(at).astype(int)
    d = (at - low)[:, None]
    if how == "cubic":
        k = np.abs(d - np.arange(-1, 3))
        w = np.where(k <= 1, (1.25 * k - 2.25) * k * k + 1, ((-0.75 * k + 3.75) * k - 6) * k + 3)
        near = low[:, None] + np.arange(-1, 3)
    else:
        w, near = np.concatenate((1 - d, d), axis=1), low[:, None] + np.arange(2)
    np.add.at(out, (np.arange(m)[:, None], np.clip(near, 0, n - 1)), w)
    return out


def resized(v: np.ndarray, height: int, width: int, how: str) -> np.ndarray:
    """Levels resampled to another size, rounded; samples outside repeat the edge."""
    return np.clip(np.floor(weights(v.shape[0], height, how) @ v @ weights(v.shape[1], width, how).T + 0.5), 0, 255)


def resized_to(v: np.ndarray, height: int, width: int) -> tuple[np.ndarray, float, float]:
    """(v in another picture's size, factors of width and height); by area if a side shrinks, else linearly."""
    h, w = v.shape
    factors = round(width / w, 6), round(height / h, 6)
    return (v if (h, w) == (height, width) else resized(v, height, width, "area" if h > height or w > width else "linear")), *factors


def equalised(v: np.ndarray) -> np.ndarray:
    """Levels spread so that all are about equally frequent; a picture of one level stays."""
    counts = np.bincount(v.astype(int).ravel(), minlength=256)
    first = counts[np.flatnonzero(counts)[0]]
    if first == v.size:
        return v
    return np.rint((np.cumsum(counts) - first) * (255.0 / (v.size - first)))[v.astype(int)]


def warped(v: np.ndarray, scale: float, rotation: float, x: float, y: float, height: int, width: int) -> np.ndarray:
    """A picture moved by the similarity transform that takes its places to those of a (height, width) picture; linear, and
    places from outside repeat the edge."""
    turn = scale * np.exp(1j * np.radians(rotation))
    at = ((np.arange(width)[None] + 1j * np.arange(height)[:, None]) - (x + 1j * y)) / turn
    px, py = np.clip(at.real, 0, v.shape[1] - 1), np.clip(at.imag, 0, v.shape[0] - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, v.shape[1] - 1), np.minimum(y0 + 1, v.shape[0] - 1)
    fx, fy = px - x0, py - y0
    top, low = v[y0, x0] * (1 - fx) + v[y0, x1] * fx, v[y1, x0] * (1 - fx) + v[y1, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5)


def contrasted(v: np.ndarray, tiles: int = 8, clip: float = 2.0, sigma: float = 1.0, amount: float = 0.45) -> np.ndarray:
    """A picture made easier to read: levels equalised by tile with a limit, tiles blended, then sharpened."""
    height, width = v.shape
    rows, columns = (np.linspace(0, n, min(tiles, n) + 1).astype(int) for n in (height, width))
    tables = np.empty((len(rows) - 1, len(columns) - 1, 256))
    for i, (t, b) in enumerate(zip(rows, rows[1:], strict=False)):
        for j, (le, r) in enumerate(zip(columns, columns[1:], strict=False)):
            counts = np.bincount(v[t:b, le:r].astype(int).ravel(), minlength=256).astype(float)
            most = max(1.0, clip * counts.sum() / 256)
            over = np.maximum(counts - most, 0).sum()
            tables[i, j] = np.cumsum(np.minimum(counts, most) + over / 256) * (255.0 / counts.sum())

    def between(n: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        middle = (edges[:-1] + edges[1:] - 1) / 2
        hi = np.clip(np.searchsorted(middle, np.arange(n)), 0, len(middle) - 1)
        lo = np.maximum(hi - 1, 0)
        span = np.where(hi > lo, middle[hi] - middle[lo], 1)
        return lo, hi, np.clip((np.arange(n) - middle[lo]) / span, 0, 1)

    (i0, i1, fi), (j0, j1, fj) = between(height, rows), between(width, columns)
    level, y = v.astype(int), np.ix_(np.arange(height), np.arange(width))
    pick = lambda i, j: tables[i[:, None], j[None], level[y]]
    top = pick(i0, j0) * (1 - fj) + pick(i0, j1) * fj
    low = pick(i1, j0) * (1 - fj) + pick(i1, j1) * fj
    even = np.floor(top * (1 - fi)[:, None] + low * fi[:, None] + 0.5)
    return np.clip(np.floor((1 + amount) * even - amount * blur(even, gaussian(7, sigma)) + 0.5), 0, 255)


def adaptive_foreground(v: np.ndarray, offset: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(dark, light) foreground: below, or not below, the local Gaussian mean less offset."""
    block = max(15, round(min(v.shape) / 30))
    block += block % 2 == 0
    level = np.floor(blur(v, gaussian(block), "edge") + 0.5)
    dark = v - level <= -offset
    return dark, ~dark


def edges(v: np.ndarray, low: float = 60, high: float = 160) -> np.ndarray:
    """Canny edges: Sobel gradient, thinning along its direction, and weak edges kept where they touch strong ones."""
    p = np.pad(v, 1, "edge")
    smooth = lambda m: m[:-2] + 2 * m[1:-1] + m[2:]
    gx, gy = smooth(p[:, 2:] - p[:, :-2]), smooth((p[2:] - p[:-2]).T).T
    size = np.abs(gx) + np.abs(gy)
    q = np.pad(size, 1)
    turn = (np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int)) % 4
    thin = np.zeros(v.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ahead = q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
        behind = q[1 - dy : q.shape[0] - 1 - dy, 1 - dx : q.shape[1] - 1 - dx]
        thin |= (turn == k) & (size > behind) & (size >= ahead)
    weak = labelled((thin & (size > low)).astype(float))
    strong = np.unique(weak[thin & (size > high)])
    return np.isin(weak, strong[strong > 0])


# The 256 colours of a heat map are a rule: a polynomial for each channel, as published for the Turbo map.
TURBO = {
    "r": (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    "g": (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    "b": (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
}


def heat(b: np.ndarray, difference: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(height, width, 3) BGR heat map over b: 0.45 of the image and 0.55 of the colour where the mask is set."""
    span = difference.max() - difference.min()
    t = np.floor((difference - difference.min()) * (255 / span if span else 0)) / 255
    colour = np.stack([np.clip(sum(c * t**i for i, c in enumerate(TURBO[k])), 0, 1) * 255 for k in "bgr"], axis=-1)
    out = np.repeat(b[..., None], 3, axis=2).astype(float)
    on = mask > 0
    out[on] = np.round(0.45 * out[on] + 0.55 * colour[on])
    return out
