"""Queries of sources, sinks and whole comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import decisions as de
from ..operators import images, pixels
from ..sources import images as files
from ..sources import recognition
from ..sources.relations import Relations
from ..streaming import feeds
from . import visual
from .registry import query


def results(t: Relations) -> DataFrame:
    """Model output built from documents: lines as texts, fewer scores than texts, some boxes empty, polygons for some."""
    texts = F.split("text", "\n")
    n = F.size("texts")
    k = F.col("doc_id").cast("double")
    df = t.table("documents").withColumn("texts", texts)
    scores = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i % 10) / 10.0)
    box = lambda i: F.when(i % 3 == 1, F.array().cast("array<double>")).otherwise(F.array(k % 50 + i / 4.0, i * 24.0, k % 50 + 80.5, i * 24.0 + 18.5))
    polygon = lambda i: F.when(i % 6 == 1, F.array().cast("array<array<double>>")).otherwise(F.array(F.array(k + 0.3, i * 24.0), F.array(k + 90.2, i * 24.0 + 1.5), F.array(k + 90.0, i * 24.0 + 18.1), F.array(k - 0.2, i * 24.0 + 17.0)))
    places = F.sequence(F.lit(0), n - 1)
    return df.select("doc_id", "texts", F.slice(scores, 1, F.greatest(F.lit(1), n - 2)).alias("scores"), F.transform(places, box).alias("boxes"), F.transform(places, polygon).alias("polygons"))


@query(
    "doc_id long, pos long, text string, confidence double, x1 long, y1 long, x2 long, y2 long",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n, doc_id::DOUBLE AS k FROM documents)
    SELECT doc_id, i AS pos, trim(raw) AS text, CASE WHEN i < greatest(1, n - 2) THEN (i % 10) / 10.0::DOUBLE ELSE 0 END AS confidence,
      CASE WHEN i % 3 <> 1 THEN round_even(k % 50 + i / 4.0, 0) WHEN i % 6 <> 1 THEN floor(k - 0.2) ELSE 0 END AS x1, CASE WHEN i % 3 <> 1 OR i % 6 <> 1 THEN i * 24 ELSE 0 END AS y1,
      CASE WHEN i % 3 <> 1 THEN round_even(k % 50 + 80.5, 0) WHEN i % 6 <> 1 THEN ceil(k + 90.2) ELSE 0 END AS x2, CASE WHEN i % 3 <> 1 THEN round_even(i * 24 + 18.5, 0) WHEN i % 6 <> 1 THEN ceil(i * 24 + 18.1) ELSE 0 END AS y2
    FROM l WHERE trim(raw) <> ''""",
)
def ocr_records(t: Relations) -> DataFrame:
    return recognition.records(results(t))


#: Boxes as typed by a user, good and bad ones, from the values of a part.
_TYPED = """CASE p_partkey % 9 WHEN 0 THEN concat(p_size, ',', p_partkey % 50, ',', 1 + p_size, ',40') WHEN 1 THEN concat(' ', p_size, ' , 6 ,', p_partkey % 70, ' , 8 ') WHEN 2 THEN concat(p_size, '.5,2.5,', p_size, '.5,4.5')
    WHEN 3 THEN concat(p_size, ',2,3') WHEN 4 THEN concat('a,b,', p_size, ',d') WHEN 5 THEN concat('1,2,0,', p_size) WHEN 6 THEN concat('-', p_size, ',4,10,10') WHEN 7 THEN concat(p_size, ',2,3,4,5') ELSE p_name END"""


@query(
    "region_id long, valid boolean, x long, y long, width long, height long",
    f"""WITH v AS (SELECT p_partkey AS region_id, {_TYPED} AS s FROM part), n AS (SELECT region_id, list_transform(string_split(s, ','), lambda p: round_even(TRY_CAST(trim(p) AS DOUBLE), 0)) AS b FROM v),
    g AS (SELECT *, coalesce(len(b) = 4 AND len(list_filter(b, lambda q: q IS NULL)) = 0 AND b[3] > 0 AND b[4] > 0, false) AS valid FROM n)
    SELECT region_id, valid, CASE WHEN valid THEN b[1] END AS x, CASE WHEN valid THEN b[2] END AS y, CASE WHEN valid THEN b[3] END AS width, CASE WHEN valid THEN b[4] END AS height FROM g""",
)
def typed_regions(t: Relations) -> DataFrame:
    df = t.table("part").select(F.col("p_partkey").alias("region_id"), F.expr(_TYPED).alias("s"))
    box, valid = recognition.region_of(F.col("s"))
    df = df.withColumn("valid", valid)
    return df.select("region_id", "valid", *[F.when(F.col("valid"), b).alias(c) for b, c in zip(box, ("x", "y", "width", "height"), strict=True)])


@query(
    "event_id long, image_path string, n_regions long, batch_size long, error string",
    """SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_type || '.png' END AS image_path, CASE WHEN event_id % 7 > 0 AND event_id % 5 > 0 THEN event_id % 4 END AS n_regions, CASE WHEN event_id % 7 > 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) - 5 ELSE 32 END AS batch_size,
    CASE WHEN event_id % 7 = 0 THEN 'no image_path' WHEN event_id % 5 = 0 THEN 'no regions' WHEN CAST(json_extract(props, '$.k') AS BIGINT) - 5 <= 0 THEN 'bad batch_size' END AS error FROM events""",
)
def json_requests(t: Relations) -> DataFrame:
    """Lines of JSON as a worker gets them, one in seven damaged."""
    k = F.get_json_object("props", "$.k").cast("int") - 5
    regions = F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), 1, (F.col("event_id") % 4).cast("int")), lambda i: F.array(i, i, F.lit(10), F.lit(10)))
    fields = F.struct(F.concat("event_type", F.lit(".png")).alias("image_path"), F.when(F.col("event_id") % 5 > 0, regions).alias("regions"), k.alias("batch_size"))
    line = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(fields))
    df = recognition.requests(t.table("events").select("event_id", line.alias("value")))
    return df.withColumn("n_regions", F.when(F.col("regions").isNotNull(), F.size("regions")))


@query(
    "event_id long, response string",
    """WITH q AS (SELECT event_id, event_type || '.png' AS image_path, event_id % 4 AS n, CAST(json_extract(props, '$.k') AS BIGINT) - 5 AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"error":"no image_path"}' WHEN event_id % 5 = 0 THEN '{"error":"no regions"}' WHEN k <= 0 THEN '{"error":"bad batch_size"}'
      ELSE '{"image_path":"' || image_path || '","n_regions":' || n || ',"batches":' || CAST(ceil(n / k::DOUBLE) AS BIGINT) || '}' END AS response FROM q""",
)
def json_responses(t: Relations) -> DataFrame:
    """What a worker answers to each request: the error, or how it would go through the regions."""
    df = json_requests(t).withColumn("batches", F.ceil(F.col("n_regions") / F.col("batch_size")))
    return recognition.responses(df, ["image_path", "n_regions", "batches"])


@query(
    "doc_id long, pos long, x1 long, y1 long, x2 long, y2 long, number long",
    "SELECT doc_id, pos, x1 + doc_id % 7 * 100 AS x1, y1 + doc_id % 5 * 50 AS y1, x2 + doc_id % 7 * 100 AS x2, y2 + doc_id % 5 * 50 AS y2, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY y1 + doc_id % 5 * 50, x1 + doc_id % 7 * 100, doc_id, pos) AS number FROM ocr_line",
)
def patch_translation(t: Relations) -> DataFrame:
    """Lines read in patches, moved to their place on a panel of twenty documents and put in reading order there."""
    dx, dy = F.col("doc_id") % 7 * 100, F.col("doc_id") % 5 * 50
    df = t.ocr_line.select("doc_id", "pos", (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))
    return df.withColumn("number", F.row_number().over(Window.partitionBy(F.floor(F.col("doc_id") / 20)).orderBy("y1", "x1", "doc_id", "pos")))


@query(
    "doc_id long, pos long, left_edge long, top_edge long, right_edge long, bottom_edge long, out_width long, out_height long",
    """WITH p AS (SELECT doc_id, pos, greatest(0, x1 - greatest(3, round_even((x2 - x1) * 0.04, 0))) AS l, greatest(0, y1 - greatest(3, round_even((y2 - y1) * 0.16, 0))) AS t, least(1200, x2 + greatest(3, round_even((x2 - x1) * 0.04, 0))) AS r, least(2000, y2 + greatest(3, round_even((y2 - y1) * 0.16, 0))) AS b FROM ocr_line),
    s AS (SELECT *, CASE WHEN greatest(r - l, b - t) < 1200 THEN least(2.0, 1200.0::DOUBLE / greatest(r - l, b - t, 1)) ELSE 1 END AS s FROM p WHERE r > l AND b > t)
    SELECT doc_id, pos, l AS left_edge, t AS top_edge, r AS right_edge, b AS bottom_edge, greatest(1, round_even((r - l) * s, 0)) AS out_width, greatest(1, round_even((b - t) * s, 0)) AS out_height FROM s""",
)
def line_crop_geometry(t: Relations) -> DataFrame:
    """Crops of lines with some margin, clipped to a page of 1200 x 2000, and the size they are enlarged to."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    mx, my = F.greatest(F.lit(3), F.rint(w * 0.04)), F.greatest(F.lit(3), F.rint(h * 0.16))
    df = t.ocr_line.select("doc_id", "pos", F.greatest(F.lit(0), F.col("x1") - mx).alias("left_edge"), F.greatest(F.lit(0), F.col("y1") - my).alias("top_edge"), F.least(F.lit(1200), F.col("x2") + mx).alias("right_edge"), F.least(F.lit(2000), F.col("y2") + my).alias("bottom_edge"))
    df = df.filter("right_edge > left_edge AND bottom_edge > top_edge").withColumns({"w": F.col("right_edge") - F.col("left_edge"), "h": F.col("bottom_edge") - F.col("top_edge")})
    longest = F.greatest("w", "h")
    s = F.when(longest < 1200, F.least(F.lit(2.0), F.lit(1200.0) / F.greatest(longest, F.lit(1)))).otherwise(1.0)
    return df.withColumn("s", s).withColumns({"out_width": F.greatest(F.lit(1), F.rint(F.col("w") * F.col("s"))), "out_height": F.greatest(F.lit(1), F.rint(F.col("h") * F.col("s")))})


@query("start string, stage string, peak double, mean double, samples long", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, stage, max(elapsed_s) AS peak, avg(elapsed_s) AS mean, count(*) AS samples FROM run_log GROUP BY ALL")
def resource_windows(t: Relations) -> DataFrame:
    """Peaks in tumbling windows of event time (an extension); the same function runs on a stream."""
    return feeds.windowed_peaks(t.run_log).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("image_id long, y long, x long, v long", "SELECT image_id, y, x, floor(0.299 * ((v * 13) % 256) + 0.587 * ((v * 7) % 256) + 0.114 * v + 0.5) AS v FROM pixel")
def gray_levels(t: Relations) -> DataFrame:
    return t.pixel.select("image_id", "y", "x", files.gray(F.col("v"), F.col("v") * 7 % 256, F.col("v") * 13 % 256).alias("v"))


@query("image_id long, bytes long, sha256 string")
def saved_images(t: Relations) -> DataFrame:
    """Pictures encoded as PNG files, by size and hash (rows only)."""
    df = files.encoded(images.gather(t.image_row, "a"), "a")
    return df.select("image_id", F.octet_length("png").alias("bytes"), F.sha2("png", 256).alias("sha256"))


_COMPARED = f"""{visual._SSIM.replace('WITH ', 'WITH RECURSIVE ', 1)}, {visual._BOXES.replace('WITH RECURSIVE ', '', 1)},
    good AS (SELECT * FROM counted WHERE area >= 30),
    worst AS (SELECT image_id, avg(ssim) FILTER (r <= 4) AS local_ssim FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ssim, y, x) AS r FROM cell) GROUP BY image_id),
    whole AS (SELECT image_id, avg(v) AS global_ssim FROM ssim GROUP BY image_id),
    rate AS (SELECT image_id, sum(m) / 4096 AS rate FROM mask GROUP BY image_id),
    box_rate AS (SELECT image_id, count(*) / 4096 AS box_rate FROM (SELECT DISTINCT m.image_id, m.y, m.x FROM mask m JOIN good g ON m.image_id = g.image_id AND m.x >= g.x AND m.x < g.x + g.width AND m.y >= g.y AND m.y < g.y + g.height) GROUP BY image_id),
    region AS (SELECT image_id, count(*) AS boxes, max(CASE WHEN area / 4096 < 0.0005 THEN 1 WHEN area / 4096 < 0.005 THEN 2 WHEN area / 4096 < 0.02 THEN 3 ELSE 4 END) AS worst FROM good GROUP BY image_id),
    j AS (SELECT whole.image_id, global_ssim, local_ssim, rate, coalesce(box_rate, 0) AS box_rate, coalesce(boxes, 0) AS boxes, worst FROM whole JOIN worst USING (image_id) JOIN rate USING (image_id) LEFT JOIN box_rate USING (image_id) LEFT JOIN region USING (image_id)),
    sev AS (SELECT *, CASE WHEN worst IS NULL THEN 'none' ELSE ['none', 'low', 'medium', 'high', 'critical'][greatest(worst, CASE WHEN rate >= 0.05 OR local_ssim < 0.5 THEN 4 WHEN rate >= 0.02 OR local_ssim < 0.7 THEN 3 WHEN rate >= 0.005 OR local_ssim < 0.85 THEN 2 ELSE 1 END) + 1] END AS severity FROM j)"""


@query(
    "image_id long, global_ssim double, local_ssim double, rate double, boxes long, severity string, score double, status string",
    f"""{_COMPARED} SELECT *, 100 * (0.3 * greatest(0, global_ssim) + 0.3 * greatest(0, local_ssim) + 0.25 * (1 - (0.7 * rate + 0.3 * box_rate)) + 0.15 * CASE severity WHEN 'none' THEN 1.0 WHEN 'low' THEN 0.9 WHEN 'medium' THEN 0.7 WHEN 'high' THEN 0.4 ELSE 0.0 END) AS score,
    CASE WHEN boxes > 0 THEN 'ERROR' ELSE 'PASS' END AS status FROM sev""",
)
def compare_images(t: Relations) -> DataFrame:
    """A whole comparison of image pairs in one pass over the images: similarity, differences, severity, score, verdict."""
    return compared(visual.pair_images(t))


def compared(pairs: DataFrame) -> DataFrame:
    """pairs(image_id, height, width, error, a, b) -> one row each; images with an error have FAILED. One Arrow pass; nothing is shuffled but the gathered rows."""
    import numpy as np

    def kernel(a, b):
        mask = images.difference_mask(a, b)
        cells = np.sort(images.ssim_cells(a, b)["ssim"])
        boxes = images.difference_boxes(mask)
        covered = np.zeros(mask.shape, bool)
        for x, y, w, h in zip(boxes["x"], boxes["y"], boxes["width"], boxes["height"], strict=True):
            covered[y : y + h, x : x + w] = True
        worst = max(1, int(np.ceil(len(cells) * images.WORST_FRACTION)))
        return {"global_ssim": [images.ssim_map(a, b).mean()], "local_ssim": [cells[:worst].mean()], "rate": [mask.mean()], "box_rate": [covered.mean()], "boxes": [len(boxes["x"])], "largest": [max(boxes["area_ratio"], default=0.0)]}

    df = images.map_images(pairs, kernel, "global_ssim double, local_ssim double, rate double, box_rate double, boxes long, largest double", "a", "b")
    region = F.when(F.col("boxes") > 0, de.rank(pixels.area_severity(F.col("largest"))))
    df = df.withColumn("severity", de.overall_severity(region, F.col("rate"), F.col("local_ssim")))
    df = df.withColumn("score", de.image_score(*[F.col(c) for c in ("global_ssim", "local_ssim", "rate", "box_rate", "severity")]))
    return df.withColumn("status", F.when(F.col("error").isNotNull(), "FAILED").when(F.col("boxes") > 0, "ERROR").otherwise("PASS"))
