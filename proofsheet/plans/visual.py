"""Queries of the visual check: differences, similarity, morphology, template search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import images, pixels
from ..sources.relations import SIDE, Relations
from .registry import query

_LEVEL = "CASE WHEN {0} < 0.0005 THEN 'low' WHEN {0} < 0.005 THEN 'medium' WHEN {0} < 0.02 THEN 'high' ELSE 'critical' END"
_SSIM_LEVEL = "CASE WHEN {0} < 0.5 THEN 'critical' WHEN {0} < 0.75 THEN 'high' WHEN {0} < 0.9 THEN 'medium' WHEN {0} < 0.95 THEN 'low' ELSE 'ok' END"


def _kernel(name: str, weights) -> str:
    r = len(weights) // 2
    return f"{name}(k, w) AS (VALUES {', '.join(f'({i - r}, {w!r}::DOUBLE)' for i, w in enumerate(map(float, weights)))})"


def _at(i: str, border: str) -> str:
    last = SIDE - 1
    return f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} > {last} THEN {2 * last} - ({i}) ELSE {i} END" if border == "reflect" else f"least({last}, greatest(0, {i}))"


def _blur(name: str, source: str, columns: list[str], kernel: str, border: str = "reflect") -> str:
    """CTEs that filter columns of source by rows, then by columns."""
    sums = ", ".join(f"sum(w * q.{c}) AS {c}" for c in columns)
    return f"""{name}_h AS (SELECT p.image_id, p.y, p.x, {sums} FROM {source} p CROSS JOIN {kernel} JOIN {source} q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {_at('p.x + k', border)} GROUP BY ALL),
    {name} AS (SELECT p.image_id, p.y, p.x, {sums} FROM {name}_h p CROSS JOIN {kernel} JOIN {name}_h q ON q.image_id = p.image_id AND q.x = p.x AND q.y = {_at('p.y + k', border)} GROUP BY ALL)"""


_SSIM = f"""WITH {_kernel('g', images.gaussian(11, 1.5))},
    s AS (SELECT image_id, y, x, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM pixel_pair),
    {_blur('m', 's', ['a', 'b', 'aa', 'bb', 'ab'], 'g')},
    ssim AS (SELECT image_id, y, x, (2 * a * b + 6.5025) * (2 * (ab - a * b) + 58.5225) / ((a * a + b * b + 6.5025) * (aa - a * a + bb - b * b + 58.5225)) AS v FROM m),
    cell AS (SELECT image_id, x // 16 * 16 AS x, y // 16 * 16 AS y, least(1, greatest(-1, avg(v))) AS ssim FROM ssim GROUP BY ALL)"""


def _slide(name: str, source: str, column: str, size: int, best: str) -> str:
    r = size // 2
    return f"""{name}_h AS (SELECT image_id, y, x, {best}({column}) OVER (PARTITION BY image_id, y ORDER BY x RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {column} FROM {source}),
    {name} AS (SELECT image_id, y, x, {best}({column}) OVER (PARTITION BY image_id, x ORDER BY y RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {column} FROM {name}_h)"""


_MASK = f"""WITH RECURSIVE raw AS (SELECT image_id, y, x, CASE WHEN abs(a - b) > 25 THEN 1 ELSE 0 END AS m FROM pixel_pair),
    {_slide('e1', 'raw', 'm', 3, 'min')}, {_slide('d1', 'e1', 'm', 3, 'max')}, {_slide('d2', 'd1', 'm', 3, 'max')}, {_slide('mask', 'd2', 'm', 3, 'min')}"""


def _components(name: str, source: str) -> str:
    """Least place of each set pixel's 8-connected component."""
    return f"""{name}_on AS (SELECT image_id, y, x FROM {source} WHERE m = 1),
    {name}_run AS (SELECT image_id, y, min(x) AS x1, max(x) AS x2 FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM {name}_on) GROUP BY image_id, y, g),
    {name}_link AS (SELECT a.image_id, a.y AS y1, a.x1 AS xa, b.y AS y2, b.x1 AS xb FROM {name}_run a JOIN {name}_run b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND a.x1 <= b.x2 + 1 AND b.x1 <= a.x2 + 1),
    {name}_reach(image_id, y, x, ry, rx) AS (SELECT image_id, y, x1, y, x1 FROM {name}_run UNION SELECT r.image_id, r.y, r.x, l.y2, l.xb FROM {name}_reach r JOIN {name}_link l ON l.image_id = r.image_id AND l.y1 = r.ry AND l.xa = r.rx),
    {name}_root AS (SELECT image_id, y, x, min(ry * 1000 + rx) AS root FROM {name}_reach GROUP BY ALL),
    {name} AS (SELECT r.image_id, root, min(x1) AS x, min(r.y) AS y, max(x2) - min(x1) + 1 AS width, max(r.y) - min(r.y) + 1 AS height, sum(x2 - x1 + 1) AS area
      FROM {name}_run r JOIN {name}_root t ON r.image_id = t.image_id AND r.y = t.y AND r.x1 = t.x GROUP BY r.image_id, root)"""


def pair_images(t: Relations) -> DataFrame:
    return images.gather(t.image_row, "a", "b")


@query(
    "image_id long, changed long, total long, rate double, mean_abs double, severity string",
    f"""SELECT *, {_LEVEL.format('rate')} AS severity FROM (SELECT image_id, count(*) FILTER (abs(a - b) > 25) AS changed, count(*) AS total,
        count(*) FILTER (abs(a - b) > 25) / count(*) AS rate, avg(abs(a - b)) AS mean_abs FROM pixel_pair GROUP BY image_id)""",
)
def visual_difference_rate(t: Relations) -> DataFrame:
    df = pixels.difference_rate(t.pixel_pair, images.DIFFERENCE_THRESHOLD)
    return df.withColumn("severity", pixels.area_severity(F.col("rate")))


@query("image_id long, y long, x long, blurred double", f"WITH {_kernel('g', images.gaussian(5))}, {_blur('m', 'pixel', ['v'], 'g')} SELECT image_id, y, x, floor(v + 0.5) AS blurred FROM m")
def gray_gaussian_blur(t: Relations) -> DataFrame:
    import numpy as np

    def kernel(v):
        y, x = np.indices(v.shape)
        return {"y": y.ravel(), "x": x.ravel(), "blurred": np.floor(images.blur(v, images.gaussian(5)) + 0.5).ravel()}

    return images.map_images(images.gather(t.image_row, "a"), kernel, "y long, x long, blurred double", "a")


@query("image_id long, ssim double", f"{_SSIM} SELECT image_id, avg(v) AS ssim FROM ssim GROUP BY image_id")
def ssim_global(t: Relations) -> DataFrame:
    return images.map_images(pair_images(t), lambda a, b: {"ssim": [images.ssim_map(a, b).mean()]}, "ssim double", "a", "b")


def _cells(t: Relations) -> DataFrame:
    return images.map_images(pair_images(t), images.ssim_cells, "x long, y long, width long, height long, ssim double", "a", "b")


@query("image_id long, x long, y long, width long, height long, ssim double, severity string", f"{_SSIM} SELECT image_id, x, y, 16 AS width, 16 AS height, ssim, {_SSIM_LEVEL.format('ssim')} AS severity FROM cell")
def ssim_local_cells(t: Relations) -> DataFrame:
    return _cells(t).withColumn("severity", pixels.ssim_severity(F.col("ssim")))


@query(
    "image_id long, local_ssim double, anomalies long",
    f"""{_SSIM} SELECT image_id, avg(ssim) FILTER (r <= ceil(n * 0.25)) AS local_ssim, count(*) FILTER (ssim < 0.95) AS anomalies FROM
        (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ssim, y, x) AS r, count(*) OVER (PARTITION BY image_id) AS n FROM cell) GROUP BY image_id""",
)
def ssim_local_worst(t: Relations) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("ssim", "y", "x"))
    n = F.count("*").over(Window.partitionBy("image_id"))
    df = _cells(t).withColumns({"r": rank, "n": n})
    worst = F.avg(F.when(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * images.WORST_FRACTION)), F.col("ssim")))
    return df.groupBy("image_id").agg(worst.alias("local_ssim"), F.count(F.when(F.col("ssim") < images.ANOMALY, 1)).alias("anomalies"))


@query("image_id long, y long, x long, m long", f"{_MASK} SELECT image_id, y, x, m FROM mask WHERE m = 1")
def morph_open_close(t: Relations) -> DataFrame:
    """Opening and closing as sliding minima and maxima over window frames."""
    df = t.pixel_pair.select("image_id", "y", "x", F.when(F.abs(F.col("a") - F.col("b")) > images.DIFFERENCE_THRESHOLD, 1).otherwise(0).alias("m"))
    for best in (F.min, F.max, F.max, F.min):
        df = pixels.sliding(df, "m", 3, best).withColumn("m", F.col("best")).drop("best")
    return df.filter("m = 1")


@query("image_id long, x long, y long, width long, height long, area long", f"{_MASK}, {_components('c', 'mask')} SELECT image_id, x, y, width, height, area FROM c")
def mask_components(t: Relations) -> DataFrame:
    return images.map_images(pair_images(t), lambda a, b: images.component_boxes(images.difference_mask(a, b)), "x long, y long, width long, height long, area long", "a", "b")


_BOXES = f"""{_MASK}, {_slide('wide', 'mask', 'm', 11, 'max')}, {_components('c', 'wide')},
    narrow AS (SELECT image_id, CASE WHEN width > 10 AND height > 10 AND least(64, x + width - 5) > x + 5 AND least(64, y + height - 5) > y + 5 THEN 5 ELSE 0 END AS g, x, y, width, height FROM c WHERE area >= 30),
    box AS (SELECT image_id, greatest(0, x + g) AS x, greatest(0, y + g) AS y, least(64, x + width - g) - greatest(0, x + g) AS width, least(64, y + height - g) - greatest(0, y + g) AS height FROM narrow),
    counted AS (SELECT b.image_id, b.x, b.y, b.width, b.height, count(*) AS area FROM box b JOIN mask m ON m.image_id = b.image_id AND m.m = 1 AND m.x >= b.x AND m.x < b.x + b.width AND m.y >= b.y AND m.y < b.y + b.height GROUP BY ALL)"""


def boxes_of(t: Relations) -> DataFrame:
    df = images.map_images(pair_images(t), lambda a, b: images.difference_boxes(images.difference_mask(a, b)), "x long, y long, width long, height long, area long, area_ratio double", "a", "b")
    return df.withColumns({
        "region_type": F.when(F.col("area_ratio") < pixels.LARGE_AREA, "small").otherwise("large"),
        "severity": pixels.area_severity(F.col("area_ratio")),
        "number": F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", "width", "height")),
    })


@query(
    "image_id long, x long, y long, width long, height long, area long, area_ratio double, region_type string, severity string, number long",
    f"""{_BOXES} SELECT *, area / 4096 AS area_ratio, CASE WHEN area / 4096 < 0.01 THEN 'small' ELSE 'large' END AS region_type, {_LEVEL.format('(area / 4096)')} AS severity,
        row_number() OVER (PARTITION BY image_id ORDER BY y, x, width, height) AS number FROM counted WHERE area >= 30""",
)
def difference_boxes(t: Relations) -> DataFrame:
    return boxes_of(t)


@query("image_id long, y long, x long, score double", f"WITH f AS (SELECT image_id, y, x, v / 255.0::DOUBLE AS s FROM pixel), {_slide('best', 'f', 's', 17, 'max')} SELECT f.image_id, f.y, f.x, f.s AS score FROM f JOIN best b ON f.image_id = b.image_id AND f.y = b.y AND f.x = b.x WHERE f.s >= b.s AND f.s >= 0.38")
def local_maxima_17(t: Relations) -> DataFrame:
    df = pixels.sliding(t.pixel.withColumn("score", F.col("v") / F.lit(255.0)), "score", images.MAXIMA_SIZE)
    return df.filter((F.col("score") >= F.col("best")) & (F.col("score") >= images.MIN_MATCH))


@query("page_index long, rotation long, cand_id long, score double, rank long", "SELECT page_index, rotation, cand_id, score, row_number() OVER (PARTITION BY page_index, rotation ORDER BY score DESC, x1 DESC, y1 DESC, cand_id) AS rank FROM match_candidate WHERE score >= 0.38 QUALIFY rank <= 12")
def template_topk(t: Relations) -> DataFrame:
    order = Window.partitionBy("page_index", "rotation").orderBy(F.desc("score"), F.desc("x1"), F.desc("y1"), "cand_id")
    return t.match_candidate.filter(F.col("score") >= images.MIN_MATCH).withColumn("rank", F.row_number().over(order)).filter("rank <= 12")


@query(
    "image_id long, v long, n long, level long",
    """SELECT image_id, v, n, CASE WHEN total = first THEN v ELSE round_even((upto - first) * (255.0::DOUBLE / (total - first)), 0) END AS level FROM
        (SELECT image_id, v, n, sum(n) OVER (PARTITION BY image_id) AS total, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS upto, first_value(n) OVER (PARTITION BY image_id ORDER BY v) AS first
         FROM (SELECT image_id, v, count(*) AS n FROM pixel GROUP BY ALL))""",
)
def histogram_equalize(t: Relations) -> DataFrame:
    return pixels.equalized(t.pixel)


@query(
    "image_id long, dark long, light long",
    f"""WITH {_kernel('g', images.gaussian(15))}, {_blur('m', 'pixel', ['v'], 'g', 'edge')}
        SELECT p.image_id, count(*) FILTER (p.v - floor(m.v + 0.5) <= -7) AS dark, count(*) FILTER (p.v - floor(m.v + 0.5) > -7) AS light FROM pixel p JOIN m ON p.image_id = m.image_id AND p.y = m.y AND p.x = m.x GROUP BY p.image_id""",
)
def adaptive_threshold(t: Relations) -> DataFrame:
    def kernel(v):
        dark, light = images.adaptive_foreground(v)
        return {"dark": [dark.sum()], "light": [light.sum()]}

    return images.map_images(images.gather(t.image_row, "a"), kernel, "dark long, light long", "a")


@query(
    "image_id long, y long, x long, score double",
    """WITH tpl AS (SELECT image_id, y - 20 AS ty, x - 24 AS tx, v - avg(v) OVER (PARTITION BY image_id) AS tv FROM pixel WHERE y >= 20 AND y < 28 AND x >= 24 AND x < 32),
    place AS (SELECT image_id, y, x FROM pixel WHERE y <= 56 AND x <= 56),
    s AS (SELECT p.image_id, p.y, p.x, sum(t.tv * q.v) AS top, sum(q.v * q.v) - 64 * avg(q.v) * avg(q.v) AS spread, sum(t.tv * t.tv) AS own FROM place p JOIN tpl t ON t.image_id = p.image_id
      JOIN pixel q ON q.image_id = p.image_id AND q.y = p.y + t.ty AND q.x = p.x + t.tx GROUP BY ALL)
    SELECT image_id, y, x, CASE WHEN spread * own > 1e-18 THEN top / sqrt(spread * own) ELSE 0 END AS score FROM s""",
)
def template_ncc(t: Relations) -> DataFrame:
    """Correlation of a patch of each image with every place of it."""
    import numpy as np

    def kernel(v):
        s = images.match_scores(v, v[20:28, 24:32])
        y, x = np.indices(s.shape)
        return {"y": y.ravel(), "x": x.ravel(), "score": s.ravel()}

    return images.map_images(images.gather(t.image_row, "a"), kernel, "y long, x long, score double", "a")


@query("image_id long, edge_pixels long, edge_share double")
def edge_share(t: Relations) -> DataFrame:
    """Canny edges of each image (rows only: hysteresis is not expressed in SQL here)."""

    def kernel(v):
        e = images.edges(v)
        return {"edge_pixels": [e.sum()], "edge_share": [e.mean()]}

    return images.map_images(images.gather(t.image_row, "a"), kernel, "edge_pixels long, edge_share double", "a")


@query(
    "image_id long, y long, x long, level double",
    f"""{_MASK}, d AS (SELECT image_id, y, x, abs(a - b) AS d, min(abs(a - b)) OVER (PARTITION BY image_id) AS lo, max(abs(a - b)) OVER (PARTITION BY image_id) AS hi FROM pixel_pair)
        SELECT d.image_id, d.y, d.x, floor((d - lo) * CASE WHEN hi > lo THEN 255.0::DOUBLE / (hi - lo) ELSE 0 END) AS level FROM d JOIN mask m ON m.image_id = d.image_id AND m.y = d.y AND m.x = d.x WHERE m.m = 1""",
)
def difference_heatmap(t: Relations) -> DataFrame:
    """Normalised difference under the mask, before colouring."""
    import numpy as np

    def kernel(a, b):
        d = np.abs(a - b)
        y, x = np.nonzero(images.difference_mask(a, b))
        span = d.max() - d.min()
        return {"y": y, "x": x, "level": np.floor((d[y, x] - d.min()) * (255 / span if span else 0))}

    return images.map_images(pair_images(t), kernel, "y long, x long, level double", "a", "b")


@query("image_id long, y long, x long, blue long, green long, red long", f"{_MASK} SELECT p.image_id, p.y, p.x, CASE WHEN m = 1 THEN 0 ELSE b END AS blue, CASE WHEN m = 1 THEN 0 ELSE b END AS green, CASE WHEN m = 1 THEN 255 ELSE b END AS red FROM pixel_pair p JOIN mask USING (image_id, y, x)")
def difference_pixel_map(t: Relations) -> DataFrame:
    """The second image with pure red where a difference is confirmed."""
    on = morph_open_close(t).select("image_id", "y", "x", F.lit(True).alias("on"))
    df = t.pixel_pair.join(on, ["image_id", "y", "x"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    flat = F.when(F.col("on"), 0).otherwise(F.col("b"))
    return df.select("image_id", "y", "x", flat.alias("blue"), flat.alias("green"), F.when(F.col("on"), 255).otherwise(F.col("b")).alias("red"))


@query(
    "image_id long, x_scale double, y_scale double, method string",
    """SELECT DISTINCT image_id, round(64.0::DOUBLE / (48 + image_id % 40), 6) AS x_scale, round(64.0::DOUBLE / (80 - image_id % 40), 6) AS y_scale,
        CASE WHEN 48 + image_id % 40 = 64 AND 80 - image_id % 40 = 64 THEN 'none' WHEN 48 + image_id % 40 > 64 OR 80 - image_id % 40 > 64 THEN 'area' ELSE 'linear' END AS method FROM pixel""",
)
def resize_scale(t: Relations) -> DataFrame:
    """Factors that bring a second image to the first one's size, and how it would be resampled."""
    w, h = 48 + F.col("image_id") % 40, 80 - F.col("image_id") % 40
    df = t.pixel.select("image_id").distinct()
    method = F.when((w == SIDE) & (h == SIDE), "none").when((w > SIDE) | (h > SIDE), "area").otherwise("linear")
    return df.select("image_id", F.round(F.lit(float(SIDE)) / w, 6).alias("x_scale"), F.round(F.lit(float(SIDE)) / h, 6).alias("y_scale"), method.alias("method"))
