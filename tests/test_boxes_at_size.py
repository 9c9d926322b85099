"""Boxes of many pictures: sums without expanded boxes, and groups that stay whole."""

import re

import duckdb
import numpy as np
import pytest

from proofsheet.operators import boxes, images, pixels
from proofsheet.plans import catalogue

SMALL = "/root/testdata/sf0.001"
BOXES = "image_id long, region_id long, x long, y long, width long, height long"


def test_box_features_equal_plain_loops(spark):
    """Pictures over several bands, with missing, short and null rows; boxes over edges, without samples, repeated, very wide."""
    rng = np.random.default_rng(5)
    rows = [(k, y, rng.integers(0, 2, 5 if y % 7 == 3 else 9).tolist() if y % 11 else None) for k in (1, 2) for y in range(2 * images.BAND + 20) if y % 5]
    found = [(k, int(rng.integers(-3, 9)), int(rng.integers(-3, 2 * images.BAND + 20)), int(rng.integers(0, 12)), int(rng.integers(0, 300))) for k in (1, 2, 3) for _ in range(20)]
    found += [(1, 0, 3, 10**11, 40), (1, 200, 0, 5, 5), (2, 0, 0, 1, 1)]
    boxes = [(k, i, x, y, w, h) for i, (k, x, y, w, h) in enumerate(found)]
    marked = spark.createDataFrame(rows, "image_id long, y long, on array<int>")
    got = {r["region_id"]: r for r in pixels.box_features(spark.createDataFrame([*boxes, boxes[-3]], BOXES), marked).collect()}
    want = {}
    for k, i, x, y, w, h in boxes:
        inside = [v for m, py, line in rows if m == k and y <= py < y + h for v in (line or ())[max(x, 0) : max(x + w, 0)]]
        if inside:
            want[i] = (np.mean(inside), np.std(inside) * 255, min(np.mean(inside), 1 - np.mean(inside)))
    assert 30 < len(want) < len(boxes) and sorted(got) == sorted(want)
    assert all((got[i]["density"], got[i]["spread"], got[i]["balance"]) == pytest.approx(v, abs=1e-9) for i, v in want.items())


@pytest.mark.parametrize("name", ["region_box_features", "text_region_filter", "character_candidates", "crop_patches", "image_region_filter"])
def test_pixels_of_boxes_are_not_broadcast(spark, name):
    plan = catalogue.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_text_regions_at_one_place_are_compared_once(spark, tmp_path):
    """Copies of regions (the same place in the same picture) stay in the result, but a text region meets pictures once."""
    rng = np.random.default_rng(7)
    spark.createDataFrame([(k, rng.normal(0, 0.3, 64).tolist()) for k in range(128)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(k, 1 + k % 504 % 50) for k in range(3 * 504)], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = catalogue.queries()["image_region_filter"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = sorted(map(tuple, df.collect())), sorted(con.execute(catalogue.oracle_sql()["image_region_filter"]).fetchall())
    ids = {r[1] for r in got}
    assert got == want and 0 < len(got) < 2 * 504 and all((k + 504 in ids) == (k in ids) for k in range(2 * 504))
    plan = df._jdf.queryExecution().optimizedPlan().toString().split("Join LeftAnti")[1].split("\n")
    texts = next(line for line in plan if "Aggregate" in line and ":" not in line)
    assert set(re.findall(r"(\w+)#", texts.split("]")[0])) == {"image_id", "x", "y", "width", "height"}


@pytest.mark.parametrize("name", ["match_select", "match_select_seeded"])
def test_groups_after_a_join_are_dealt_anew(spark, name):
    """A join by the same keys, whose large partitions adaptive execution may cut, must not stand for the dealing by keys."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        df = catalogue.queries()[name](spark, SMALL)
        assert "REPARTITION_BY_COL" in df._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[-1].split("Join")[0]
        per_template = df.groupBy("template").count().collect()
        assert per_template and all(r["count"] <= boxes.MATCH_LIMIT for r in per_template)
    finally:
        spark.conf.set(key, before)


def test_fits_of_many_pairs_count_whole_turns(spark, tmp_path):
    pairs = [0, 180, 181, 359, 400, 725]
    vectors = [(100 * k + i, [0.1] * 64) for k in pairs for i in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["image_pair"]: r for r in catalogue.queries()["similarity_fit"](spark, str(tmp_path)).collect()}
    assert {k: (r["rotation"], r["scale"]) for k, r in got.items()} == {k: (float(k), round(1 + k / 100, 6)) for k in pairs}
