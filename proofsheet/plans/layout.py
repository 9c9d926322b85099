"""Queries on boxes: matches, regions, paragraphs, geometry of selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import boxes, images, pixels
from ..sources.relations import Relations
from .registry import query

PAGE = 1100  #: side of the test pages


def _common(a: str, b: str, kind: str = "xywh") -> str:
    if kind == "xywh":
        return f"(greatest(0, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y)))"
    return f"(greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def _iou(a: str, b: str, kind: str = "xywh") -> str:
    size = (lambda t: f"{t}.width * {t}.height") if kind == "xywh" else (lambda t: f"({t}.x2 - {t}.x1) * ({t}.y2 - {t}.y1)")
    return f"({_common(a, b, kind)}::DOUBLE / greatest({size(a)} + {size(b)} - {_common(a, b, kind)}, 1))"


def _inside(a: str, b: str) -> str:
    return f"({_common(a, b)}::DOUBLE / greatest({a}.width * {a}.height, 1))"


def greedy_sql(name: str, source: str, key: str, order: str, fields: dict[str, str], clash: str, limit: int | None = None) -> str:
    """CTEs that take source's rows in order, one a step, and keep those without a clash between b and k."""
    kind = "STRUCT(" + ", ".join(f"{n} {t}" for n, t in fields.items()) + ")[]"
    row = "{" + ", ".join(f"'{n}': b.{n}" for n in fields) + "}"
    full = f" OR len(f.kept) >= {limit}" if limit else ""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS r FROM {source}),
    {name}_f({key}, r, kept) AS (SELECT DISTINCT {key}, 0::BIGINT, CAST([] AS {kind}) FROM {name}_r UNION ALL
      SELECT f.{key}, b.r, CASE WHEN len(list_filter(f.kept, lambda k: {clash})) > 0{full} THEN f.kept ELSE list_append(f.kept, CAST({row} AS {kind[:-2]})) END
      FROM {name}_f f JOIN {name}_r b ON b.{key} = f.{key} AND b.r = f.r + 1),
    {name} AS (SELECT {key}, unnest(kept, recursive := true) FROM (SELECT {key}, kept FROM {name}_f QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY r DESC) = 1))"""


_REGION = {"region_id": "BIGINT", "x": "BIGINT", "y": "BIGINT", "width": "BIGINT", "height": "BIGINT"}
_MATCH = {"cand_id": "BIGINT", "page_index": "BIGINT", "score": "DOUBLE", "x1": "BIGINT", "y1": "BIGINT", "x2": "BIGINT", "y2": "BIGINT"}
_CLASH = f"k.page_index = b.page_index AND {_iou('b', 'k', 'xyxy')} >= 0.3"


@query(
    "page_index long, region_id long, x long, y long, width long, height long",
    f"WITH RECURSIVE {greedy_sql('n', 'region_candidate', 'page_index', 'width * height DESC, region_id', _REGION, f'{_iou("b", "k")} >= 0.72 OR {_inside("b", "k")} >= 0.88')} SELECT * FROM n",
)
def box_dedup_nms(t: Relations) -> DataFrame:
    return boxes.deduplicated(t.region_candidate, ["page_index"], list(_REGION), "region_id")


_TIGHT = "SELECT * REPLACE (x // 40 * 40 AS x, y // 40 * 40 AS y) FROM region_candidate"


@query(
    "page_index long, region_id long, x long, y long, width long, height long",
    f"WITH RECURSIVE tight AS ({_TIGHT}), {greedy_sql('n', 'tight', 'page_index', 'y, x, width * height, region_id', _REGION, f'{_iou("b", "k")} >= 0.88')} SELECT * FROM n",
)
def ordered_iou_dedup(t: Relations) -> DataFrame:
    snap = lambda c: F.floor(F.col(c) / 40) * 40
    return boxes.distinct_in_order(t.region_candidate.withColumns({"x": snap("x"), "y": snap("y")}), ["page_index"], list(_REGION), "region_id")


@query(
    "region_id long, x long, y long, width long, height long, rx long, ry long, rw long, rh long",
    """SELECT region_id, greatest(0, least(x - 20, 1000)) AS x, greatest(0, least(y - 20, 1000)) AS y, x2 - x1 AS width, y2 - y1 AS height,
        round_even((x - 20) / 4.0, 0) AS rx, round_even((y - 20) / 4.0, 0) AS ry, round_even(width / 4.0, 0) AS rw, round_even(height / 4.0, 0) AS rh FROM
        (SELECT *, greatest(0, least(x - 20, 1000)) AS x1, greatest(0, least(x - 20 + width, 1000)) AS x2, greatest(0, least(y - 20, 1000)) AS y1, greatest(0, least(y - 20 + height, 1000)) AS y2 FROM region_candidate)
        WHERE x2 > x1 AND y2 > y1 AND round_even(width / 4.0, 0) > 0 AND round_even(height / 4.0, 0) > 0""",
)
def clip_normalize_boxes(t: Relations) -> DataFrame:
    """Boxes moved over the page's edge, clipped to it, and their coordinates at a quarter, rounded half to even."""
    x, y = F.col("x") - 20, F.col("y") - 20
    clip = lambda c: F.greatest(F.lit(0), F.least(c, F.lit(1000)))
    near = lambda c: F.rint(c / 4)
    df = t.region_candidate.select(
        "region_id", clip(x).alias("x"), clip(y).alias("y"), (clip(x + F.col("width")) - clip(x)).alias("width"), (clip(y + F.col("height")) - clip(y)).alias("height"),
        near(x).alias("rx"), near(y).alias("ry"), near(F.col("width")).alias("rw"), near(F.col("height")).alias("rh"),
    )
    return df.filter("width > 0 AND height > 0 AND rw > 0 AND rh > 0")


@query(
    "page_index long, covered long, rate double",
    f"SELECT page_index, count(*) AS covered, count(*) / {PAGE * PAGE} AS rate FROM (SELECT DISTINCT page_index, px, unnest(range(y, y + height)) AS py FROM (SELECT page_index, y, height, unnest(range(x, x + width)) AS px FROM region_candidate)) WHERE px < {PAGE} AND py < {PAGE} GROUP BY page_index",
)
def box_union_area(t: Relations) -> DataFrame:
    return pixels.union_area(t.region_candidate, ["page_index"], PAGE, PAGE)


_TEMPLATES = "cand AS (SELECT *, page_index % 10 AS template FROM match_candidate)"


def candidates(t: Relations) -> DataFrame:
    return t.match_candidate.withColumn("template", F.col("page_index") % 10)


_SELECTED = "template long, cand_id long, page_index long, score double, x1 long, y1 long, x2 long, y2 long, number long"
_NUMBER = "row_number() OVER (PARTITION BY template ORDER BY page_index, y1, x1, cand_id) AS number"


def numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("number", F.row_number().over(Window.partitionBy("template").orderBy("page_index", "y1", "x1", "cand_id")))


@query(
    _SELECTED,
    f"""WITH RECURSIVE {_TEMPLATES}, good AS (SELECT c.* FROM cand c JOIN (SELECT template, greatest(0.45, max(score) * 0.76) AS least FROM cand GROUP BY template HAVING max(score) >= 0.38) f ON c.template = f.template AND c.score >= f.least),
    {greedy_sql('n', 'good', 'template', 'score DESC, cand_id', _MATCH, _CLASH, 8)} SELECT *, {_NUMBER} FROM n""",
)
def match_select(t: Relations) -> DataFrame:
    return numbered(boxes.selected_matches(candidates(t), ["template"], list(_MATCH), "cand_id"))


@query(
    _SELECTED,
    f"""WITH RECURSIVE {_TEMPLATES}, seed AS (SELECT template, -template - 1 AS cand_id, template AS page_index, 0 AS rotation, 1.0::DOUBLE AS score, 100 AS x1, 100 AS y1, 180 AS x2, 160 AS y2 FROM cand GROUP BY template),
    every AS (SELECT cand_id, page_index, rotation, score, x1, y1, x2, y2, template FROM cand UNION ALL SELECT cand_id, page_index, rotation, score, x1, y1, x2, y2, template FROM seed),
    other AS (SELECT b.template, max(b.score) AS top FROM every b JOIN seed k ON b.template = k.template WHERE NOT (b.page_index = k.page_index AND {_iou('b', 'k', 'xyxy')} >= 0.3) GROUP BY b.template),
    good AS (SELECT e.* FROM every e LEFT JOIN other o ON e.template = o.template WHERE e.score >= greatest(0.45, coalesce(o.top, 1.0) * 0.76)),
    {greedy_sql('n', 'good', 'template', 'score DESC, cand_id', _MATCH, _CLASH, 8)} SELECT *, {_NUMBER} FROM n""",
)
def match_select_seeded(t: Relations) -> DataFrame:
    """The user's own selection is a match of score 1; the floor comes from the best match elsewhere."""
    found = candidates(t)
    fixed = {"x1": 100, "y1": 100, "x2": 180, "y2": 160}
    seeds = found.select("template").distinct().select(
        (-F.col("template") - 1).alias("cand_id"), F.col("template").alias("page_index"), F.lit(0).cast("long").alias("rotation"), F.lit(1.0).alias("score"),
        *[F.lit(v).cast("long").alias(c) for c, v in fixed.items()], "template",
    )
    every = found.unionByName(seeds)
    seed = tuple(F.lit(v) for v in fixed.values())
    on_seed = (F.col("page_index") == F.col("template")) & (g.iou(tuple(F.col(c) for c in fixed), seed) >= boxes.MATCH_OVERLAP)
    return numbered(boxes.selected_matches(every, ["template"], list(_MATCH), "cand_id", F.when(~on_seed, F.col("score"))))


@query("template long, cand_id long, score double", f"WITH {_TEMPLATES} SELECT template, cand_id, score FROM cand QUALIFY row_number() OVER (PARTITION BY template ORDER BY score DESC, cand_id) = 1")
def best_original_mapping(t: Relations) -> DataFrame:
    best = F.min_by(F.struct("cand_id", "score"), F.struct((-F.col("score")).alias("s"), "cand_id")).alias("b")
    return candidates(t).groupBy("template").agg(best).select("template", "b.cand_id", "b.score")


_PANELS = "SELECT CASE WHEN region_id % 50 = 0 THEN 0 ELSE x END AS x, CASE WHEN region_id % 50 = 0 THEN 0 ELSE y END AS y, CASE WHEN region_id % 50 = 0 THEN 900 ELSE width * 2 END AS width, CASE WHEN region_id % 50 = 0 THEN 700 ELSE height * 2 END AS height, page_index, region_id, confidence FROM region_candidate WHERE class_id = 0"


def panels(t: Relations) -> DataFrame:
    """Text regions, every fiftieth as large as a panel."""
    big = F.col("region_id") % 50 == 0
    df = t.region_candidate.filter("class_id = 0")
    wide = {"x": (0, F.col("x")), "y": (0, F.col("y")), "width": (900, F.col("width") * 2), "height": (700, F.col("height") * 2)}
    return df.select("page_index", "region_id", "confidence", *[F.when(big, a).otherwise(b).cast("long").alias(c) for c, (a, b) in wide.items()])


_NO_PANELS = f"""panel AS ({_PANELS}), small AS (SELECT p.* FROM panel p WHERE NOT (p.width * p.height >= 0.45 * {PAGE * PAGE}
    AND (SELECT count(*) FROM panel c WHERE c.page_index = p.page_index AND c.region_id <> p.region_id AND {_inside('c', 'p')} >= 0.82) >= 2))"""


@query("page_index long, region_id long", f"WITH {_NO_PANELS} SELECT page_index, region_id FROM small")
def panel_filter(t: Relations) -> DataFrame:
    return boxes.without_panels(panels(t), ["page_index"], "region_id", PAGE * PAGE)


def groups_sql(name: str, source: str, key: str, tie: str, rule: str) -> str:
    """CTEs that give each row of source the least tie of its group under rule between a and b."""
    return f"""{name}_l AS (SELECT a.{key}, a.{tie} AS i, b.{tie} AS j FROM {source} a JOIN {source} b ON a.{key} = b.{key} AND a.{tie} <> b.{tie} WHERE {rule}),
    {name}_c({key}, i, root) AS (SELECT {key}, {tie}, {tie} FROM {source} UNION SELECT c.{key}, l.j, c.root FROM {name}_c c JOIN {name}_l l ON l.{key} = c.{key} AND l.i = c.i),
    {name} AS (SELECT s.*, m.root FROM {source} s JOIN (SELECT {key}, i, min(root) AS root FROM {name}_c GROUP BY ALL) m ON m.{key} = s.{key} AND m.i = s.{tie})"""


def _rule_sql(across_share: float, beside: str) -> str:
    h, w = [f"greatest({t}.y2 - {t}.y1, 1)" for t in "ab"], [f"greatest({t}.x2 - {t}.x1, 1)" for t in "ab"]
    tall, low, thin = f"greatest({h[0]}, {h[1]})", f"least({h[0]}, {h[1]})", f"least({w[0]}, {w[1]})"
    across, down = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))", "greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
    gap_x, gap_y = "greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2))", "greatest(0, greatest(a.y1, b.y1) - least(a.y2, b.y2))"
    stacked = f"{tall} / {low} <= 2.5 AND {across} / {thin} >= {across_share} AND {gap_y} <= {tall} * 0.9"
    other = beside.format(tall=tall, low=low, thin=thin, wide=f"greatest({w[0]}, {w[1]})", down=down, gap_x=gap_x)
    return f"(({stacked}) OR ({other}))"


_FIELDS = {**_REGION, "confidence": "DOUBLE"}


@query(
    "page_index long, root long, x long, y long, width long, height long, confidence double, members long",
    f"""WITH RECURSIVE {_NO_PANELS}, {greedy_sql('n', 'small', 'page_index', 'width * height DESC, region_id', _FIELDS, f'{_inside("b", "k")} >= 0.82 OR {_iou("b", "k")} >= 0.55')},
    e AS (SELECT page_index, region_id, confidence, x AS x1, y AS y1, x + width AS x2, y + height AS y2 FROM n),
    {groups_sql('c', 'e', 'page_index', 'region_id', _rule_sql(0.20, '{wide} / {thin} <= 2.5 AND {down} / {low} >= 0.2 AND {gap_x} <= {thin} * 0.35'))}
    SELECT page_index, root, min(x1) AS x, min(y1) AS y, max(x2) - min(x1) AS width, max(y2) - min(y1) AS height, max(confidence) AS confidence, count(*) AS members FROM c GROUP BY page_index, root""",
)
def text_region_consolidate(t: Relations) -> DataFrame:
    return boxes.consolidated(panels(t), ["page_index"], "region_id", list(_FIELDS), PAGE * PAGE)


@query(
    "doc_id long, root long, x long, y long, width long, height long, confidence double, lines long",
    f"""WITH RECURSIVE {groups_sql('c', 'ocr_line', 'doc_id', 'pos', _rule_sql(0.15, '{down} / {low} >= 0.35 AND {gap_x} <= {tall} * 2.2'))}
    SELECT doc_id, root, min(x1) AS x, min(y1) AS y, max(x2) - min(x1) AS width, max(y2) - min(y1) AS height, min(confidence) AS confidence, count(*) AS lines FROM c GROUP BY doc_id, root""",
)
def ocr_paragraphs(t: Relations) -> DataFrame:
    """Recognised lines to paragraphs, with the least confidence of their lines."""
    df = boxes.joined_groups(t.ocr_line.select("doc_id", "pos", "confidence", "x1", "y1", "x2", "y2"), ["doc_id"], "pos", boxes.paragraph_rule, 1.0)
    df = df.groupBy("doc_id", "root").agg(F.min("x1").alias("x"), F.min("y1").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.min("confidence").alias("confidence"), F.count("*").alias("lines"))
    return df.withColumns({"width": F.col("x2") - F.col("x"), "height": F.col("y2") - F.col("y")})


_CHARS = "SELECT page_index, region_id, x // 2 AS x, y // 8 * 4 AS y, 8 + width % 9 AS width, 6 + height % 5 AS height FROM region_candidate"


def characters(t: Relations) -> DataFrame:
    """Character-sized boxes, many on a line."""
    return t.region_candidate.select("page_index", "region_id", F.floor(F.col("x") / 2).alias("x"), (F.floor(F.col("y") / 8) * 4).alias("y"), (8 + F.col("width") % 9).alias("width"), (6 + F.col("height") % 5).alias("height"))


def _axis_sql(name: str, lo: str, hi: str, olo: str, ohi: str) -> str:
    fits = f"""greatest(0, least(k.{ohi}, b.{ohi}) - greatest(k.{olo}, b.{olo}))::DOUBLE / greatest(least(k.{ohi} - k.{olo}, b.{ohi} - b.{olo}), 1) >= 0.3
      AND greatest(0, greatest(k.{lo}, b.{lo}) - least(k.{hi}, b.{hi})) <= greatest(3, least(k.{ohi} - k.{olo}, b.{ohi} - b.{olo})) * 2.2
      AND greatest(k.{ohi}, b.{ohi}) - least(k.{olo}, b.{olo}) <= greatest(k.{ohi} - k.{olo}, b.{ohi} - b.{olo}) * 1.6"""
    kind = "STRUCT(x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, n BIGINT)"
    near = f"list_min(list_transform(list_filter(f.kept, lambda k: {fits}), lambda k: greatest(0, greatest(k.{lo}, b.{lo}) - least(k.{hi}, b.{hi}))))"
    place = f"list_position(list_transform(f.kept, lambda k: CASE WHEN {fits} THEN greatest(0, greatest(k.{lo}, b.{lo}) - least(k.{hi}, b.{hi})) ELSE -1 END), {near})"
    wider = "{'x1': least(k.x1, b.x1), 'y1': least(k.y1, b.y1), 'x2': greatest(k.x2, b.x2), 'y2': greatest(k.y2, b.y2), 'n': k.n + 1}"
    alone = "{'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 'n': 1}"
    return f"""{name}_r AS (SELECT page_index, x AS x1, y AS y1, x + width AS x2, y + height AS y2, row_number() OVER (PARTITION BY page_index ORDER BY {lo[0]}, {olo[0]}, region_id) AS r FROM ch),
    {name}_f(page_index, r, kept) AS (SELECT DISTINCT page_index, 0::BIGINT, CAST([] AS {kind}[]) FROM {name}_r UNION ALL
      SELECT f.page_index, b.r, CASE WHEN {near} IS NULL THEN list_append(f.kept, CAST({alone} AS {kind}))
        ELSE list_transform(f.kept, lambda k, i: CASE WHEN i = {place.replace('lambda k', 'lambda k2').replace('k.', 'k2.').replace('f.k2ept', 'f.kept')} THEN CAST({wider} AS {kind}) ELSE k END) END
      FROM {name}_f f JOIN {name}_r b ON b.page_index = f.page_index AND b.r = f.r + 1),
    {name} AS (SELECT page_index, unnest(kept, recursive := true) FROM (SELECT page_index, kept FROM {name}_f QUALIFY row_number() OVER (PARTITION BY page_index ORDER BY r DESC) = 1))"""


@query(
    "page_index long, axis string, x long, y long, width long, height long, members long",
    f"""WITH RECURSIVE ch AS ({_CHARS}), {_axis_sql('h', 'x1', 'x2', 'y1', 'y2')}, {_axis_sql('v', 'y1', 'y2', 'x1', 'x2')}
    SELECT page_index, axis, x1 AS x, y1 AS y, x2 - x1 AS width, y2 - y1 AS height, n AS members FROM (SELECT *, 'horizontal' AS axis FROM h UNION ALL SELECT *, 'vertical' AS axis FROM v) WHERE n >= 2""",
)
def merge_text_axis(t: Relations) -> DataFrame:
    ch = characters(t)
    across = boxes.merged_along(ch, ["page_index"], "region_id", True).withColumn("axis", F.lit("horizontal"))
    return across.unionByName(boxes.merged_along(ch, ["page_index"], "region_id", False).withColumn("axis", F.lit("vertical")))


@query("page_index long, number long, x long, y long, width long, height long")
def image_region_merge(t: Relations) -> DataFrame:
    return boxes.merged_pictures(t.region_candidate.filter("class_id = 1"), ["page_index"], "region_id", PAGE, PAGE)


_FEATURES = """edge AS (SELECT image_id, y, x, CASE WHEN abs(lead(v) OVER (PARTITION BY image_id, y ORDER BY x) - v) > 60 THEN 1 ELSE 0 END AS e FROM pixel),
    feat AS (SELECT b.image_id, region_id, b.x, b.y, width, height, avg(e) AS density, stddev_pop(e) * 255 AS spread, least(avg(e), 1 - avg(e)) AS balance FROM feature_box b
      JOIN edge p ON p.image_id = b.image_id AND p.x >= b.x AND p.x < b.x + b.width AND p.y >= b.y AND p.y < b.y + b.height GROUP BY ALL)"""


def features(t: Relations, found: DataFrame | None = None) -> DataFrame:
    return pixels.box_features(t.feature_box if found is None else found, pixels.gradient_marks(t.image_row, "a", 60))


@query("image_id long, region_id long, density double, spread double, balance double", f"WITH {_FEATURES} SELECT * FROM feat")
def region_box_features(t: Relations) -> DataFrame:
    return features(t)


@query(
    "image_id long, region_id long",
    f"WITH {_FEATURES} SELECT image_id, region_id FROM feat WHERE width >= 2 AND height >= 3 AND height <= 64 * 0.12 AND width * height / 4096 <= 0.04 AND width / height BETWEEN 0.08 AND 12 AND density >= 0.015 AND (balance >= 0.008 OR spread >= 20)",
)
def character_candidates(t: Relations) -> DataFrame:
    area, aspect = F.col("width") * F.col("height") / 4096, F.col("width") / F.greatest("height", F.lit(1))
    shape = (F.col("width") >= 2) & F.col("height").between(3, 64 * 0.12) & (area <= 0.04) & aspect.between(0.08, 12)
    return features(t).filter(shape & (F.col("density") >= 0.015) & ((F.col("balance") >= 0.008) | (F.col("spread") >= 20)))


_TEXT_LIKE = "width * height / 4096 <= 0.02 AND width / height BETWEEN 0.08 AND 60 AND height <= 64 * 0.3 AND density >= 0.015 AND balance >= 0.008 AND (width / height >= 2.5 OR width / height <= 0.5 OR width * height / 4096 <= 0.005)"


def _text_like(df: DataFrame) -> DataFrame:
    area, aspect = F.col("width") * F.col("height") / 4096, F.col("width") / F.greatest("height", F.lit(1))
    return df.filter((area <= 0.02) & aspect.between(0.08, 60) & (F.col("height") <= 64 * 0.3) & (F.col("density") >= 0.015) & (F.col("balance") >= 0.008) & ((aspect >= 2.5) | (aspect <= 0.5) | (area <= 0.005)))


@query(
    "image_id long, region_id long, x long, y long, width long, height long",
    f"WITH RECURSIVE {_FEATURES}, ok AS (SELECT * FROM feat WHERE {_TEXT_LIKE}), {greedy_sql('n', 'ok', 'image_id', 'width * height DESC, region_id', _REGION, f'{_iou("b", "k")} >= 0.72 OR {_inside("b", "k")} >= 0.88')} SELECT * FROM n",
)
def text_region_filter(t: Relations) -> DataFrame:
    return boxes.deduplicated(_text_like(features(t)), ["image_id"], list(_REGION), "region_id")


@query(
    "image_id long, region_id long",
    f"""WITH {_FEATURES}, txt AS (SELECT * FROM feat WHERE {_TEXT_LIKE} AND region_id % 3 = 0) SELECT image_id, region_id FROM feat f WHERE region_id % 3 <> 0 AND width * height / 4096 BETWEEN 0.001 AND 0.45 AND width / height BETWEEN 0.05 AND 20
        AND (density >= 0.008 OR width * height / 4096 >= 0.02) AND NOT EXISTS (SELECT 1 FROM txt c WHERE c.image_id = f.image_id AND {_common('f', 'c')} / greatest(f.width * f.height, 1) >= 0.65)""",
)
def image_region_filter(t: Relations) -> DataFrame:
    """Picture regions that don't lie inside a text region. Each side sums its own boxes, text regions at one place once."""
    text = _text_like(features(t, t.feature_box.filter("region_id % 3 = 0").drop("region_id")))
    area, aspect = F.col("width") * F.col("height") / 4096, F.col("width") / F.greatest("height", F.lit(1))
    rest = features(t, t.feature_box.filter("region_id % 3 <> 0")).filter(area.between(0.001, 0.45) & aspect.between(0.05, 20) & ((F.col("density") >= 0.008) | (area >= 0.02)))
    inside = (F.col("f.image_id") == F.col("c.image_id")) & (g.containment(g.xywh(boxes._named("f")), g.xywh(boxes._named("c"))) >= 0.65)
    return rest.alias("f").join(text.alias("c"), inside, "left_anti")


@query(
    "page_index long, region_id long",
    f"""WITH d AS (SELECT * FROM diff_box), r AS (SELECT page_index, x, y, width, height FROM region_candidate WHERE class_id = 1 AND region_id % 40 < 20 UNION ALL
        SELECT page_index, x * 1.1::DOUBLE, y * 0.9::DOUBLE, width * 1.1::DOUBLE, height * 0.9::DOUBLE FROM region_candidate WHERE class_id = 1 AND region_id % 40 >= 20)
        SELECT page_index, region_id FROM d WHERE EXISTS (SELECT 1 FROM r WHERE r.page_index = d.page_index AND ((d.x + d.width / 2 BETWEEN r.x AND r.x + r.width AND d.y + d.height / 2 BETWEEN r.y AND r.y + r.height)
        OR {_common('d', 'r')} / greatest(d.width * d.height, 1) >= 0.1 OR {_common('d', 'r')} / greatest(r.width * r.height, 1) >= 0.1))""",
)
def diff_box_region_semijoin(t: Relations) -> DataFrame:
    """Difference boxes that meet a picture region of either side; the second side is scaled to the first."""
    d = t.diff_box
    pictures = t.region_candidate.filter("class_id = 1")
    scale = {"x": 1.1, "y": 0.9, "width": 1.1, "height": 0.9}
    one = pictures.filter("region_id % 40 < 20").select("page_index", *[F.col(c).cast("double").alias(c) for c in scale])
    two = pictures.filter("region_id % 40 >= 20").select("page_index", *[(F.col(c) * s).alias(c) for c, s in scale.items()])
    a, b = g.xywh(boxes._named("d")), g.xywh(boxes._named("r"))
    cx, cy = F.col("d.x") + F.col("d.width") / 2, F.col("d.y") + F.col("d.height") / 2
    centre = cx.between(b[0], b[2]) & cy.between(b[1], b[3])
    meets = (F.col("d.page_index") == F.col("r.page_index")) & (centre | (g.containment(a, b) >= 0.1) | (g.containment(b, a) >= 0.1))
    return d.alias("d").join(one.unionByName(two).alias("r"), meets, "left_semi")


@query(
    "cand_id long, x1 double, y1 double, x2 double, y2 double",
    """WITH b AS (SELECT *, 10 + cand_id % 50 AS bx, 5 + cand_id % 30 AS bym, 20 + cand_id % 11 AS bw, 8 + cand_id % 7 AS bh, 200 AS w, 100 AS h FROM match_candidate),
    r AS (SELECT *, CASE rotation WHEN 0 THEN bx WHEN 180 THEN w - (bx + bw) WHEN 90 THEN bym ELSE h - (bym + bh) END AS cx, CASE rotation WHEN 0 THEN bym WHEN 180 THEN h - (bym + bh) WHEN 90 THEN w - (bx + bw) ELSE bx END AS cy,
      CASE WHEN rotation IN (0, 180) THEN bw ELSE bh END AS cw, CASE WHEN rotation IN (0, 180) THEN bh ELSE bw END AS ch, CASE WHEN rotation IN (0, 180) THEN w ELSE h END AS iw, CASE WHEN rotation IN (0, 180) THEN h ELSE w END AS ih FROM b)
    SELECT cand_id, x1 + cx / iw * (x2 - x1) AS x1, y1 + cy / ih * (y2 - y1) AS y1, x1 + (cx + cw) / iw * (x2 - x1) AS x2, y1 + (cy + ch) / ih * (y2 - y1) AS y2 FROM r""",
)
def page_box_mapping(t: Relations) -> DataFrame:
    """Boxes found in an upright crop, as page coordinates of the turned crop."""
    k = F.col("cand_id")
    x, y, w, h, iw, ih = g.rotated_box(F.col("rotation"), 10 + k % 50, 5 + k % 30, 20 + k % 11, 8 + k % 7, F.lit(200), F.lit(100))
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return t.match_candidate.select("cand_id", (F.col("x1") + x / iw * wide).alias("x1"), (F.col("y1") + y / ih * high).alias("y1"), (F.col("x1") + (x + w) / iw * wide).alias("x2"), (F.col("y1") + (y + h) / ih * high).alias("y2"))


@query(
    "image_id long, rotation long, y long, x long, v long",
    """SELECT image_id, rotation, CASE rotation WHEN 0 THEN y WHEN 90 THEN x WHEN 180 THEN 63 - y ELSE 63 - x END AS y, CASE rotation WHEN 0 THEN x WHEN 90 THEN 63 - y WHEN 180 THEN 63 - x ELSE y END AS x, v
        FROM (SELECT *, image_id % 4 * 90 AS rotation FROM pixel)""",
)
def rotation_normalize(t: Relations) -> DataFrame:
    """Each image turned back by its rotation, without loss: 90 degrees found are turned clockwise."""
    r, last = F.col("image_id") % 4 * 90, 63
    y = F.when(r == 0, F.col("y")).when(r == 90, F.col("x")).when(r == 180, last - F.col("y")).otherwise(last - F.col("x"))
    x = F.when(r == 0, F.col("x")).when(r == 90, last - F.col("y")).when(r == 180, last - F.col("x")).otherwise(F.col("y"))
    return t.pixel.select("image_id", r.alias("rotation"), y.alias("y"), x.alias("x"), "v")


@query(
    "cand_id long, width long, height long, scale double, out_width long, out_height long, resampled boolean, page_scale double",
    """SELECT cand_id, x2 - x1 AS width, y2 - y1 AS height, s AS scale, round_even((x2 - x1) * s, 0) AS out_width, round_even((y2 - y1) * s, 0) AS out_height, s > 1.01 AS resampled, least(1.5, 3200.0::DOUBLE / greatest(900 + page_index * 100, 1200)) AS page_scale
        FROM (SELECT *, least(3.0, greatest(1.0, 2200.0::DOUBLE / greatest((x2 - x1) * (1 + cand_id % 20), (y2 - y1) * (1 + cand_id % 20)))) AS s FROM match_candidate)""",
)
def roi_render_geometry(t: Relations) -> DataFrame:
    """How a selection is enlarged for reading, and a page for searching."""
    w, h, k = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 1 + F.col("cand_id") % 20
    s = F.least(F.lit(3.0), F.greatest(F.lit(1.0), F.lit(2200.0) / F.greatest(w * k, h * k)))
    page = F.least(F.lit(1.5), F.lit(3200.0) / F.greatest(900 + F.col("page_index") * 100, F.lit(1200)))
    return t.match_candidate.select("cand_id", w.alias("width"), h.alias("height"), s.alias("scale"), F.rint(w * s).alias("out_width"), F.rint(h * s).alias("out_height"), (s > 1.01).alias("resampled"), page.alias("page_scale"))


@query(
    "image_id long, region_id long, path string, n long, total long",
    """SELECT b.image_id, region_id, format('panel_{:02d}_text_{:04d}.png', b.image_id, r) AS path, count(*) AS n, sum(v) AS total FROM
        (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x, region_id) AS r FROM feature_box) b
        JOIN pixel p ON p.image_id = b.image_id AND p.x >= b.x AND p.x < b.x + b.width AND p.y >= b.y AND p.y < b.y + b.height GROUP BY ALL""",
)
def crop_patches(t: Relations) -> DataFrame:
    """Patches of the text regions: their file names and the sums of their samples."""
    order = Window.partitionBy("image_id").orderBy("y", "x", "region_id")
    df = t.feature_box.withColumn("r", F.row_number().over(order))
    path = F.format_string("panel_%02d_text_%04d.png", "image_id", "r")
    return images.box_sums(df.withColumn("path", path), t.image_row, "a")


@query(
    "page_index long, document_text long, image_content long, mean_confidence double",
    "SELECT page_index, count(*) FILTER (class_id = 0) AS document_text, count(*) FILTER (class_id = 1) AS image_content, avg(confidence) AS mean_confidence FROM region_candidate GROUP BY page_index",
)
def region_count_pivot(t: Relations) -> DataFrame:
    name = F.when(F.col("class_id") == 0, "document_text").otherwise("image_content")
    counts = t.region_candidate.withColumn("class_name", name).groupBy("page_index").pivot("class_name", ["document_text", "image_content"]).agg(F.count("region_id"))
    mean = t.region_candidate.groupBy("page_index").agg(F.avg("confidence").alias("mean_confidence"))
    return counts.na.fill(0).join(mean, "page_index")
