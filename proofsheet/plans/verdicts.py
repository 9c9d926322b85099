"""Queries of alignment, decisions, provenance and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import decisions as de
from ..operators import inputs, models
from ..sources.relations import Relations
from . import visual
from .registry import query

# ---------------------------------------------------------------- alignment


def points(t: Relations) -> DataFrame:
    """Keypoints of image pairs of a hundred points each."""
    return t.keypoint.withColumn("image_pair", F.floor(F.col("kp_id") / 100).cast("long"))


_MUTUAL = """kp AS (SELECT *, kp_id // 100 AS image_pair FROM keypoint),
    p AS (SELECT a.image_pair, a.kp_id AS a, b.kp_id AS b, bit_count(xor(a.d0, b.d0)) + bit_count(xor(a.d1, b.d1)) AS distance FROM kp a JOIN kp b ON a.image_pair = b.image_pair AND a.side = 0 AND b.side = 1),
    mutual AS (SELECT image_pair, a, b, distance FROM (SELECT *, row_number() OVER (PARTITION BY image_pair, a ORDER BY distance, b) AS ra, row_number() OVER (PARTITION BY image_pair, b ORDER BY distance, a) AS rb FROM p) WHERE ra = 1 AND rb = 1)"""


@query("image_pair long, a long, b long, distance long", f"WITH {_MUTUAL} SELECT * FROM mutual")
def mutual_nearest_neighbors(t: Relations) -> DataFrame:
    return al.mutual_nearest(points(t), ["image_pair"])


@query("image_pair long, a long, b long, distance long, rank long", f"WITH {_MUTUAL} SELECT image_pair, a, b, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_pair ORDER BY distance, a, b) AS rank, count(*) OVER (PARTITION BY image_pair) AS n FROM mutual) WHERE rank <= greatest(8, round_even(n * 0.25, 0))")
def keep_best_matches(t: Relations) -> DataFrame:
    return al.keep_best(al.mutual_nearest(points(t), ["image_pair"]), ["image_pair"])


_MATRIX = "m AS (SELECT region_id, x, y, scale * cos(radians(rotation_degrees * 19)) AS a, scale * sin(radians(rotation_degrees * 19)) AS b, (region_id % 10) / 20.0::DOUBLE AS inlier_ratio FROM alignment)"


@query(
    "region_id long, scale double, rotation double, accepted boolean, reason string",
    f"""WITH {_MATRIX}, d AS (SELECT *, sqrt(a * a + b * b) AS scale, degrees(atan2(b, a)) AS rotation FROM m),
    r AS (SELECT *, concat_ws('；', CASE WHEN inlier_ratio < 0.2 THEN printf('RANSAC 内点比例过低: %.1f%% < 20.0%%', inlier_ratio * 100) END, CASE WHEN abs(rotation) > 10 THEN printf('旋转角度异常: %.2f°', rotation) END,
      CASE WHEN scale < 0.85 OR scale > 1.15 THEN printf('缩放比例异常: %.4f', scale) END) AS reason FROM d) SELECT region_id, scale, rotation, reason = '' AS accepted, reason FROM r""",
)
def alignment_accept(t: Relations) -> DataFrame:
    """Transforms from their matrix, and why they are not trusted."""
    turn = F.radians(F.col("rotation_degrees") * 19)
    df = t.alignment.select("region_id", (F.col("scale") * F.cos(turn)).alias("a"), (F.col("scale") * F.sin(turn)).alias("b"), (F.col("region_id") % 10 / 20.0).alias("inlier_ratio"))
    scale, rotation = al.decomposed(F.col("a"), F.col("b"))
    df = df.withColumns({"scale": scale, "rotation": rotation})
    reason = al.rejection(F.col("inlier_ratio"), F.col("rotation"), F.col("scale"))
    return df.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


_MOVEMENT = """mv AS (SELECT *, sqrt(x * x + y * y) AS shift, sqrt(w * w + h * h) AS diagonal, abs(rotation_degrees) AS turn, abs(scale - 1) AS change FROM alignment),
    moved AS (SELECT region_id, success, CASE WHEN NOT success THEN 'uncertain' WHEN shift / diagonal >= 0.005 OR turn >= 0.5 OR change >= 0.01 THEN 'moved' ELSE 'not_moved' END AS status,
      success AND (shift / diagonal >= 0.005 OR turn >= 0.5 OR change >= 0.01) AS movement_detected, CASE WHEN success THEN round(shift, 3) ELSE 0 END AS translation_pixels, CASE WHEN success THEN shift / diagonal ELSE 0 END AS translation_ratio,
      CASE WHEN success THEN turn ELSE 0 END AS rotation, CASE WHEN success THEN change ELSE 0 END AS scale_change FROM mv)"""


def movements(t: Relations) -> DataFrame:
    return t.alignment.select("region_id", "success", *[c.alias(k) for k, c in al.movement(*[F.col(c) for c in ("x", "y", "rotation_degrees", "scale", "success", "w", "h")]).items()])


@query("region_id long, status string, movement_detected boolean, translation_pixels double, translation_ratio double, rotation double, scale_change double", f"WITH {_MOVEMENT} SELECT * FROM moved")
def movement_analysis(t: Relations) -> DataFrame:
    return movements(t)


@query("regions long, aligned boolean, moved long, uncertain long", f"WITH {_MOVEMENT} SELECT count(*) AS regions, bool_and(success) AS aligned, count(*) FILTER (status = 'moved') AS moved, count(*) FILTER (status = 'uncertain') AS uncertain FROM moved")
def alignment_success(t: Relations) -> DataFrame:
    return movements(t).agg(F.count("*").alias("regions"), F.bool_and("success").alias("aligned"), F.count(F.when(F.col("status") == "moved", 1)).alias("moved"), F.count(F.when(F.col("status") == "uncertain", 1)).alias("uncertain"))


_PLANTED = """SELECT kp_id // 100 AS image_pair, kp_id AS pair_id, x AS bx, y AS by,
      CASE WHEN kp_id % 9 = 4 THEN x + 200.0 ELSE (1 + kp_id // 100 / 100.0) * (cos(radians(kp_id // 100)) * x - sin(radians(kp_id // 100)) * y) + 5 + kp_id // 100 END AS ax,
      CASE WHEN kp_id % 9 = 4 THEN y - 150.0 ELSE (1 + kp_id // 100 / 100.0) * (sin(radians(kp_id // 100)) * x + cos(radians(kp_id // 100)) * y) - 3 END AS ay FROM keypoint"""


@query(
    "image_pair long, scale double, rotation double, x double, y double, inliers long, matched long",
    f"""WITH q AS ({_PLANTED}) SELECT image_pair, 1 + image_pair / 100.0::DOUBLE AS scale, image_pair AS rotation, 5 + image_pair AS x, -3 AS y, count(*) FILTER (pair_id % 9 <> 4) AS inliers, count(*) AS matched FROM q GROUP BY image_pair""",
)
def similarity_fit(t: Relations) -> DataFrame:
    """Planted transforms with one outlier in nine: the fit must give the planted values. Pairs are turned by a degree more each,
    over a whole turn if there are many."""
    k = F.floor(F.col("kp_id") / 100)
    scale, turn, out = 1 + k / 100.0, F.radians(k.cast("double")), F.col("kp_id") % 9 == 4
    ax = F.when(out, F.col("x") + 200.0).otherwise(scale * (F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y")) + 5 + k)
    ay = F.when(out, F.col("y") - 150.0).otherwise(scale * (F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y")) - 3)
    pairs = t.keypoint.select(k.cast("long").alias("image_pair"), F.col("kp_id").alias("pair_id"), F.col("x").alias("bx"), F.col("y").alias("by"), ax.alias("ax"), ay.alias("ay"))
    found = al.fitted(pairs, ["image_pair"])
    return found.withColumn("rotation", al.nearest_turn(F.col("rotation"), F.col("image_pair")))


@query(
    "region_id long, x double, y double, rotation_degrees double, scale double, matched_features long, inlier_features long, inlier_ratio double, success boolean, reason string",
    """SELECT region_id, CASE WHEN ok THEN x ELSE 0 END AS x, CASE WHEN ok THEN y ELSE 0 END AS y, CASE WHEN ok THEN rotation_degrees ELSE 0 END AS rotation_degrees, CASE WHEN ok THEN scale ELSE 1 END AS scale, m AS matched_features, i AS inlier_features,
        CASE WHEN m > 0 THEN round(i / m::DOUBLE, 4) ELSE 0 END AS inlier_ratio, ok AS success, CASE WHEN ok THEN '' ELSE 'rejected' END AS reason FROM (SELECT *, region_id % 40 AS m, region_id % 40 * 3 // 7 AS i, success AS ok FROM alignment)""",
)
def alignment_record(t: Relations) -> DataFrame:
    """The record of each alignment; one that failed moves nothing and keeps its counts."""
    m = F.col("region_id") % 40
    i = F.floor(m * 3 / 7)
    failed = al.identity_result(F.lit("rejected"), m, i)
    found = {**{c: F.col(c) for c in ("x", "y", "rotation_degrees", "scale")}, "matched_features": m, "inlier_features": i, "inlier_ratio": failed["inlier_ratio"], "success": F.lit(True), "reason": F.lit("")}
    return t.alignment.select("region_id", *[F.when(F.col("success"), found[c]).otherwise(v).alias(c) for c, v in failed.items()])


# ---------------------------------------------------------------- decisions

_RANKS = "CASE {0} WHEN 'none' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 END"
_REGION = f"""region AS (SELECT page_index, region_id, {visual._LEVEL.format('area_ratio')} AS level, area_ratio FROM (SELECT page_index, region_id, area_ratio / pow(10.0::DOUBLE, page_index % 7 + 2) AS area_ratio FROM diff_box) WHERE area_ratio >= 0.00001),
    page AS (SELECT p.page_index, max({_RANKS.format('level')}) AS worst, p.page_index / 250.0::DOUBLE AS rate, 1 - p.page_index / 40.0::DOUBLE AS local_ssim, 1 - p.page_index / 50.0::DOUBLE AS global_ssim, coalesce(sum(area_ratio), 0) / 100 AS box_rate
      FROM (SELECT DISTINCT page_index FROM region_candidate) p LEFT JOIN region r ON r.page_index = p.page_index GROUP BY p.page_index),
    severity AS (SELECT *, CASE WHEN worst IS NULL THEN 'none' ELSE ['none', 'low', 'medium', 'high', 'critical'][greatest(worst, CASE WHEN rate >= 0.05 OR local_ssim < 0.5 THEN 4 WHEN rate >= 0.02 OR local_ssim < 0.7 THEN 3 WHEN rate >= 0.005 OR local_ssim < 0.85 THEN 2 ELSE 1 END) + 1] END AS severity FROM page),
    scored AS (SELECT *, 100 * (0.3 * global_ssim + 0.3 * local_ssim + 0.25 * (1 - (0.7 * rate + 0.3 * least(1, box_rate))) + 0.15 * CASE severity WHEN 'none' THEN 1.0 WHEN 'low' THEN 0.9 WHEN 'medium' THEN 0.7 WHEN 'high' THEN 0.4 ELSE 0.0 END) AS score FROM severity)"""


def scored_pages(t: Relations) -> DataFrame:
    """Pages with their worst region, measures, severity and score. Pages differ in size, so that the same boxes are a larger
    or smaller part of them; boxes of less than a hundred-thousandth of a page are no differences."""
    from ..operators.pixels import area_severity

    share = F.col("area_ratio") / F.pow(F.lit(10.0), F.col("page_index") % 7 + 2)
    regions = t.diff_box.withColumn("area_ratio", share).filter("area_ratio >= 0.00001").withColumn("rank", de.rank(area_severity(F.col("area_ratio"))))
    worst = regions.groupBy("page_index").agg(F.max("rank").alias("worst"), (F.sum("area_ratio") / 100).alias("box_rate"))
    p = F.col("page_index")
    df = t.region_candidate.select("page_index").distinct().join(worst, "page_index", "left").na.fill(0, ["box_rate"])
    df = df.withColumns({"rate": p / 250.0, "local_ssim": 1 - p / 40.0, "global_ssim": 1 - p / 50.0})
    df = df.withColumn("severity", de.overall_severity(F.col("worst"), F.col("rate"), F.col("local_ssim")))
    return df.withColumn("score", de.image_score(*[F.col(c) for c in ("global_ssim", "local_ssim", "rate", "box_rate", "severity")]))


@query("page_index long, rate double, local_ssim double, severity string", f"WITH {_REGION} SELECT * FROM severity")
def overall_severity(t: Relations) -> DataFrame:
    return scored_pages(t)


@query("page_index long, severity string, score double", f"WITH {_REGION} SELECT * FROM scored")
def image_score(t: Relations) -> DataFrame:
    return scored_pages(t)


_PARTS = f"""{_REGION}, {_MOVEMENT}, part AS (SELECT v.region_id, CASE WHEN status = 'not_moved' THEN v.region_id % 60 ELSE v.region_id % 45 END AS sample_id, v.region_id % 20 AS page_index, status, CASE WHEN v.region_id % 60 < 20 THEN (v.region_id // 60) % 3 ELSE 0 END AS n_text,
    CASE WHEN v.region_id % 60 BETWEEN 15 AND 30 THEN (v.region_id // 60) % 2 ELSE 0 END AS n_boxes, 1 - (v.region_id % 9) / 20.0::DOUBLE AS text_ratio FROM moved v)"""


def parts(t: Relations) -> DataFrame:
    """Regions of samples with counts of text and picture differences and their movement; the last samples have no moved ones."""
    k = F.col("region_id")
    df = movements(t).select(
        "region_id", F.when(F.col("status") == "not_moved", k % 60).otherwise(k % 45).alias("sample_id"), (k % 20).alias("page_index"), "status", F.when(k % 60 < 20, F.floor(k / 60) % 3).otherwise(0).alias("n_text"),
        F.when((k % 60).between(15, 30), F.floor(k / 60) % 2).otherwise(0).alias("n_boxes"), (1 - k % 9 / 20.0).alias("text_ratio"),
    )
    return df


@query(
    "sample_id long, final_status string, ocr_status string, image_status string, ocr_score double, image_score double, text_differences long, picture_differences long, regions long",
    f"""WITH {_PARTS} SELECT sample_id, CASE WHEN sum(n_text) > 0 OR sum(n_boxes) > 0 THEN 'ERROR' WHEN bool_or(status IN ('moved', 'uncertain')) THEN 'WARNING' ELSE 'PASS' END AS final_status,
    CASE WHEN sum(n_text) > 0 THEN 'ERROR' ELSE 'PASS' END AS ocr_status, CASE WHEN sum(n_boxes) > 0 THEN 'ERROR' WHEN bool_or(status IN ('moved', 'uncertain')) THEN 'WARNING' ELSE 'PASS' END AS image_status,
    min(text_ratio) * 100 AS ocr_score, min(score) AS image_score, sum(n_text) AS text_differences, sum(n_boxes) AS picture_differences, count(*) AS regions FROM part JOIN scored USING (page_index) GROUP BY sample_id""",
)
def rule_decision_fusion(t: Relations) -> DataFrame:
    scores = scored_pages(t).select("page_index", F.col("score").alias("image_score"))
    return de.fused(parts(t).join(scores, "page_index"), ["sample_id"])


@query(
    "sample_id long, mode string, final_status string",
    f"""WITH {_PARTS}, s AS (SELECT sample_id, sum(n_text) > 0 AS t, sum(n_boxes) > 0 AS b, bool_or(status <> 'not_moved') AS m FROM part GROUP BY sample_id)
    SELECT sample_id, mode, CASE WHEN mode <> 'visual' AND t THEN 'ERROR' WHEN mode <> 'ocr' AND b THEN 'ERROR' WHEN mode <> 'ocr' AND m THEN 'WARNING' ELSE 'PASS' END AS final_status FROM s CROSS JOIN (VALUES ('visual'), ('ocr'), ('fusion')) AS v(mode)""",
)
def mode_decision(t: Relations) -> DataFrame:
    s = parts(t).groupBy("sample_id").agg((F.sum("n_text") > 0).alias("t"), (F.sum("n_boxes") > 0).alias("b"), F.bool_or(F.col("status") != "not_moved").alias("m"))
    return s.withColumn("mode", F.explode(F.array(*map(F.lit, inputs.MODES)))).withColumn("final_status", de.by_mode(F.col("mode"), F.col("t"), F.col("b"), F.col("m")))


@query(
    "sample_id long, detection_id string, type string, region_id long",
    f"""WITH {_PARTS}, d AS (SELECT sample_id, region_id, 0 AS o, 'visual_difference' AS type, unnest(range(n_boxes)) AS k FROM part UNION ALL SELECT sample_id, region_id, 1, 'ocr_text_difference', unnest(range(n_text)) FROM part)
    SELECT sample_id, CASE o WHEN 0 THEN 'visual-' ELSE 'ocr-' END || region_id || '-' || row_number() OVER (PARTITION BY sample_id ORDER BY o, region_id, k) AS detection_id, type, region_id FROM d""",
)
def detections_union(t: Relations) -> DataFrame:
    """All detections of a sample, picture differences first, numbered through."""
    p = parts(t)
    def of(order: int, kind: str, count: str) -> DataFrame:
        return p.filter(F.col(count) > 0).select("sample_id", "region_id", F.lit(order).alias("o"), F.lit(kind).alias("type"), F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("k"))

    d = of(0, "visual_difference", "n_boxes").unionByName(of(1, "ocr_text_difference", "n_text"))
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("o", "region_id", "k"))
    prefix = F.when(F.col("o") == 0, "visual").otherwise("ocr")
    return d.withColumn("detection_id", F.concat_ws("-", prefix, F.col("region_id").cast("string"), number.cast("string")))


@query("sample_id long, type string, detections long, pages long", f"WITH {_PARTS} SELECT sample_id, CASE grouping(type) WHEN 1 THEN 'all' ELSE type END AS type, sum(n) AS detections, count(DISTINCT page_index) AS pages FROM (SELECT sample_id, page_index, 'visual' AS type, n_boxes AS n FROM part WHERE n_boxes > 0 UNION ALL SELECT sample_id, page_index, 'text', n_text FROM part WHERE n_text > 0) GROUP BY GROUPING SETS ((sample_id, type), (sample_id))")
def detection_counts(t: Relations) -> DataFrame:
    """Counts by sample and type, and for each sample as a whole (an extension: grouping sets)."""
    p = parts(t)
    d = p.filter("n_boxes > 0").select("sample_id", "page_index", F.lit("visual").alias("type"), F.col("n_boxes").alias("n"))
    d = d.unionByName(p.filter("n_text > 0").select("sample_id", "page_index", F.lit("text").alias("type"), F.col("n_text").alias("n")))
    df = d.groupingSets([["sample_id", "type"], ["sample_id"]], "sample_id", "type").agg(F.sum("n").alias("detections"), F.countDistinct("page_index").alias("pages"), F.grouping("type").alias("whole"))
    return df.withColumn("type", F.when(F.col("whole") == 1, "all").otherwise(F.col("type")))


# ---------------------------------------------------------------- provenance

#: Inputs of all kinds from the values of an order: path, page, selection, size, pages, and whether the side is the selected one.
_SPECS = {
    "path": "CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN concat('c', o_orderkey, '.txt') WHEN 2 THEN concat('d', o_orderkey, '.PDF') WHEN 3 THEN '  ' WHEN 4 THEN concat('e', o_orderkey, '.webp') WHEN 5 THEN concat('f.', o_orderkey, '.tiff') WHEN 6 THEN 'noformat' WHEN 7 THEN concat('g', o_orderkey, '.JPEG') ELSE concat('h', o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '.png' ELSE '.pdf' END) END",
    "page": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 12) AS BIGINT) % 5 - 1 END",
    "width": "CASE WHEN o_custkey % 13 = 0 THEN 5000 ELSE 10 + o_custkey % 90 END", "height": "CASE WHEN o_orderkey % 5 = 0 THEN 4001 ELSE 4000 END", "pages": "1 + o_custkey % 4", "selected": "o_orderkey % 2 = 0",
}
_CORNERS = {"x1": ("0.0", "5.0", "0.0", "-1.0", "0.0"), "y1": ("0.0", "0.0", "0.0", "0.0", "0.0"), "x2": ("5.0", "5.0", "width + 1.0", "5.0", "width + 0.0000001"), "y2": ("5.0", "9.0", "9.0", "5.0", "9.0")}


def _corner(name: str, kind: str) -> str:
    return f"CASE o_custkey % 6 {' '.join(f'WHEN {k} THEN CAST({v} AS {kind})' for k, v in enumerate(_CORNERS[name], 1))} END"


@query(
    "id long, error string",
    f"""WITH v AS (SELECT *, {', '.join(f'{_corner(c, "DOUBLE")} AS {c}' for c in _CORNERS)} FROM (SELECT o_orderkey AS id, o_custkey, {', '.join(f'{e} AS {c}' for c, e in _SPECS.items())} FROM orders)),
    e AS (SELECT * REPLACE (coalesce(page, 0) AS page), page IS NULL OR x1 IS NULL AS asked, lower(regexp_extract(path, '\\.[^.]+$')) AS suffix FROM v)
    SELECT id, CASE WHEN trim(path) = '' THEN 'empty_path' WHEN page < 0 THEN 'negative_page' WHEN x1 < 0 OR y1 < 0 OR x2 <= x1 OR y2 <= y1 THEN 'bad_selection' WHEN suffix NOT IN ({', '.join(f"'{x}'" for x in inputs.SUFFIXES)}) THEN 'unsupported_format'
      WHEN suffix = '.pdf' AND selected AND asked THEN 'selection_required' WHEN suffix <> '.pdf' AND page <> 0 THEN 'image_page' WHEN suffix = '.pdf' AND page >= pages THEN 'page_outside' WHEN suffix <> '.pdf' AND width * height > 20000000 THEN 'over_budget'
      WHEN x2 > width + 1e-6 OR y2 > height + 1e-6 THEN 'selection_outside' END AS error FROM e""",
)
def input_validation(t: Relations) -> DataFrame:
    df = t.table("orders").select(F.col("o_orderkey").alias("id"), "o_custkey", *[F.expr(e).alias(c) for c, e in _SPECS.items()])
    df = df.withColumns({c: F.expr(_corner(c, "DOUBLE")) for c in _CORNERS})
    return df.withColumn("error", inputs.input_error(F.col("path"), F.col("page"), [F.col(c) for c in _CORNERS], F.col("width"), F.col("height"), F.col("pages"), F.col("selected")))


@query("name string, value string")
def environment(t: Relations) -> DataFrame:
    """Versions that a run depends on (rows only)."""
    return inputs.environment(t.spark)


_CHANGED = {"mode": "CASE p_size % 7 WHEN 0 THEN 'both' ELSE 'fusion' END", "blur_kernel": "p_size % 6", "difference_threshold": "p_size * 6", "min_scale": "0.85 + (p_partkey % 5) / 10.0", "orb_keep_match_ratio": "(p_partkey % 4) / 2.0 - 0.25"}


def configs(t: Relations) -> DataFrame:
    """Settings with some values taken from parts, in and out of range."""
    part = t.table("part")
    changed = {k: F.expr(e).cast("double" if k in ("min_scale", "orb_keep_match_ratio") else "string" if k == "mode" else "long") for k, e in _CHANGED.items()}
    return part.select(F.col("p_partkey").alias("config_id"), *[changed.get(k, F.lit(v)).alias(k) for k, v in inputs.DEFAULTS.items()])


@query(
    "config_id long, errors string",
    """WITH c AS (SELECT p_partkey AS config_id, CASE p_size % 7 WHEN 0 THEN 'both' ELSE 'fusion' END AS mode, p_size % 6 AS blur, p_size * 6 AS threshold, 0.85::DOUBLE + (p_partkey % 5) / 10.0::DOUBLE AS lo, (p_partkey % 4) / 2.0::DOUBLE - 0.25 AS ratio FROM part)
    SELECT config_id, concat_ws(',', CASE WHEN mode = 'both' THEN 'mode' END, CASE WHEN threshold > 255 THEN 'difference_threshold' END, CASE WHEN blur < 1 OR blur % 2 = 0 THEN 'blur_kernel' END, CASE WHEN ratio <= 0 OR ratio > 1 THEN 'orb_keep_match_ratio' END, CASE WHEN lo > 1.15 THEN 'scale_order' END) AS errors FROM c""",
)
def config_validation(t: Relations) -> DataFrame:
    return configs(t).withColumn("errors", inputs.config_errors())


@query(
    "config_id long, identity string, common_identity string, same boolean",
    """WITH c AS (SELECT p_partkey AS config_id, CASE p_size % 7 WHEN 0 THEN 'both' ELSE 'fusion' END AS mode, p_size % 6 AS blur, p_size * 6 AS threshold FROM part),
    j AS (SELECT config_id, '{"blur_kernel":' || blur || ',"difference_threshold":' || threshold AS head, ',"mode":"' || mode || '"}' AS tail FROM c),
    h AS (SELECT config_id, sha256(head || tail) AS identity, sha256(head || '}') AS common_identity FROM j) SELECT *, common_identity = (SELECT common_identity FROM h WHERE config_id = 1) AS same FROM h""",
)
def config_identity_hash(t: Relations) -> DataFrame:
    """Hashes of the settings with and without the mode, and whether a run may go on beside that of the first setting."""
    df = configs(t).select("config_id", "mode", "blur_kernel", "difference_threshold")
    df = df.select("config_id", inputs.identity(["mode", "blur_kernel", "difference_threshold"]).alias("identity"), inputs.identity(["blur_kernel", "difference_threshold"]).alias("common_identity"))
    first = df.filter("config_id = 1").agg(F.max("common_identity")).scalar()
    return df.withColumn("same", F.col("common_identity") == first)


@query(
    "conv_id long, fingerprint string, files long",
    """SELECT conv_id, sha256('{' || string_agg('"turn' || turn || '.py":"' || sha256(text) || '"', ',' ORDER BY 'turn' || turn || '.py') || '}') AS fingerprint, count(*) AS files FROM conversations GROUP BY conv_id""",
)
def source_fingerprint(t: Relations) -> DataFrame:
    files = t.table("conversations").withColumn("name", F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".py")))
    return inputs.fingerprint(files.withColumn("content", F.col("text").cast("binary")), ["conv_id"], "name", "content")


#: Failures of all kinds from the values of an event: message, what was raised, the kind that an input error gives, stage.
_FAILURES = {
    "message": "CASE event_id % 5 WHEN 0 THEN 'boom' WHEN 1 THEN 'CUDA Out Of Memory' ELSE concat(event_type, ' failed') END", "raised": "CASE event_id % 4 WHEN 0 THEN 'MemoryError' WHEN 1 THEN 'InputError' WHEN 2 THEN 'RuntimeError' ELSE 'ValueError' END",
    "given": "CASE WHEN user_id % 3 = 0 THEN 'pdf_load_error' ELSE 'unsupported_input' END", "stage": "CASE user_id % 5 WHEN 0 THEN 'validation' WHEN 1 THEN 'ocr' WHEN 2 THEN 'alignment' WHEN 3 THEN 'report' ELSE event_type END",
}


@query(
    "event_id long, kind string",
    f"""WITH v AS (SELECT event_id, {', '.join(f'{e} AS {c}' for c, e in _FAILURES.items())} FROM events)
    SELECT event_id, CASE WHEN raised = 'MemoryError' OR contains(lower(message), 'out of memory') THEN 'out_of_memory' WHEN raised = 'InputError' THEN given WHEN stage = 'validation' THEN 'unsupported_input' WHEN stage IN ('ocr', 'alignment') THEN stage || '_failure' ELSE 'algorithm_exception' END AS kind FROM v""",
)
def error_classification(t: Relations) -> DataFrame:
    df = t.table("events").select("event_id", *[F.expr(e).alias(c) for c, e in _FAILURES.items()])
    return df.withColumn("kind", de.error_kind(F.col("message"), F.col("raised"), F.col("given"), F.col("stage")))


@query("run_id long, stage string, seconds double, calls long", "SELECT run_id, stage, sum(elapsed_s) AS seconds, count(*) AS calls FROM run_log GROUP BY run_id, stage")
def stage_timing_rollup(t: Relations) -> DataFrame:
    return t.run_log.groupBy("run_id", "stage").agg(F.sum("elapsed_s").alias("seconds"), F.count("*").alias("calls"))


@query("run_id long, peak double, samples long", "SELECT run_id, max(elapsed_s) AS peak, count(*) AS samples FROM run_log GROUP BY run_id")
def resource_peak(t: Relations) -> DataFrame:
    return t.run_log.groupBy("run_id").agg(F.max("elapsed_s").alias("peak"), F.count("*").alias("samples"))


@query("event_id long, run_id long, running_peak double", "SELECT event_id, run_id, max(elapsed_s) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS running_peak FROM run_log")
def resource_running_peak(t: Relations) -> DataFrame:
    so_far = Window.partitionBy("run_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.run_log.withColumn("running_peak", F.max("elapsed_s").over(so_far))


@query(
    "conv_id long, turn long, source string, x1 double, x2 double",
    """SELECT conv_id, turn, CASE WHEN role = 'user' AND length(text) % 2 = 0 THEN 'original' WHEN role = 'assistant' AND length(text) % 3 > 0 THEN 'rearranged' WHEN length(text) % 2 = 0 THEN 'original' WHEN length(text) % 3 > 0 THEN 'rearranged' END AS source,
    (least(turn * 7, 90) - 10) / 200.0::DOUBLE * 595 AS x1, (greatest(turn * 7, 90) - 10) / 200.0::DOUBLE * 595 AS x2 FROM conversations""",
)
def selection_source(t: Relations) -> DataFrame:
    """The side that a comparison starts from: the one last selected if its selection is still there, else the first that has one; and a drag on screen as page coordinates."""
    left, right = F.length("text") % 2 == 0, F.length("text") % 3 > 0
    wanted = F.when((F.col("role") == "user") & left, "original").when((F.col("role") == "assistant") & right, "rearranged")
    x = [f(F.col("turn") * 7, F.lit(90)) for f in (F.least, F.greatest)]
    page = [(c - 10) / 200.0 * 595 for c in x]
    return t.table("conversations").select("conv_id", "turn", F.coalesce(wanted, F.when(left, "original").when(right, "rearranged")).alias("source"), page[0].alias("x1"), page[1].alias("x2"))


@query("image_id long, heat_path string, pixel_path string, mask_path string", "SELECT DISTINCT image_id, stem || '_difference_heatmap.jpg' AS heat_path, stem || '_difference_pixels.png' AS pixel_path, 'page' || image_id || '_diff_result_mask.png' AS mask_path FROM (SELECT image_id, 'page' || image_id AS stem FROM pixel)")
def artifact_paths(t: Relations) -> DataFrame:
    """Names of the pictures of a comparison, from the name of its result."""
    stem = F.concat(F.lit("page"), F.col("image_id").cast("string"), F.lit("_diff_result"))
    base = F.regexp_replace(stem, "_diff_result$", "")
    return t.pixel.select("image_id").distinct().select("image_id", F.concat(base, F.lit("_difference_heatmap.jpg")).alias("heat_path"), F.concat(base, F.lit("_difference_pixels.png")).alias("pixel_path"), F.concat(stem, F.lit("_mask.png")).alias("mask_path"))


# ---------------------------------------------------------------- models


@query(
    "region_id long, class_id long, class_name string, confidence double",
    """WITH l AS (SELECT region_id, width / 100.0::DOUBLE - height / 50.0::DOUBLE AS a, height / 50.0::DOUBLE - width / 200.0::DOUBLE AS b FROM region_candidate)
    SELECT region_id, CASE WHEN a >= b THEN 0 ELSE 1 END AS class_id, CASE WHEN a >= b THEN 'document_text' ELSE 'image_content' END AS class_name, greatest(exp(a), exp(b)) / (exp(a) + exp(b)) AS confidence FROM l""",
)
def softmax_argmax(t: Relations) -> DataFrame:
    """Class and confidence of regions by the stand-in model."""
    df = models.predicted(t.region_candidate.select("region_id", "width", "height"), ["width", "height"])
    df = df.withColumn("p", models.softmax(F.col("logits"))).withColumn("class_id", models.chosen(F.col("p")))
    return df.select("region_id", "class_id", F.element_at(F.array(*map(F.lit, models.CLASSES)), (F.col("class_id") + 1).cast("int")).alias("class_name"), F.array_max("p").alias("confidence"))


@query("region_id long, out_width long, out_height long, left_edge long, top_edge long", "SELECT region_id, w AS out_width, h AS out_height, floor((224 - w) / 2) AS left_edge, floor((224 - h) / 2) AS top_edge FROM (SELECT region_id, greatest(1, round_even(width * least(224.0::DOUBLE / width, 224.0::DOUBLE / height), 0)) AS w, greatest(1, round_even(height * least(224.0::DOUBLE / width, 224.0::DOUBLE / height), 0)) AS h FROM region_candidate)")
def letterbox_geometry(t: Relations) -> DataFrame:
    w, h, left, top = models.letterbox(F.col("width"), F.col("height"))
    return t.region_candidate.select("region_id", w.alias("out_width"), h.alias("out_height"), left.alias("left_edge"), top.alias("top_edge"))


@query(
    "region_id long, route string",
    "SELECT region_id, CASE WHEN c NOT IN (0, 1) THEN 'unknown_class' WHEN (c = 0) <> (n = 'document_text') THEN 'name_mismatch' ELSE n END AS route FROM (SELECT region_id, CASE WHEN region_id % 97 = 0 THEN 2 ELSE class_id END AS c, CASE WHEN (class_id = 0) <> (region_id % 89 = 0) THEN 'document_text' ELSE 'image_content' END AS n FROM region_candidate)",
)
def route_predictions(t: Relations) -> DataFrame:
    """Predictions by class name, with those whose number and name disagree marked."""
    text = (F.col("class_id") == 0) != (F.col("region_id") % 89 == 0)
    df = t.region_candidate.select("region_id", F.when(F.col("region_id") % 97 == 0, 2).otherwise(F.col("class_id")).alias("class_id"), F.when(text, "document_text").otherwise("image_content").alias("class_name"))
    return df.withColumn("route", F.coalesce(models.routing_error(), F.col("class_name")))
