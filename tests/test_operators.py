"""Formulas and rules against small plain versions, and properties that must hold."""

import json
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofsheet.functions import text as tx
from proofsheet.operators import alignment as al
from proofsheet.operators import boxes, comparison, decisions, images, panels, pictures, pixels, regions, templates, texts
from proofsheet.plans import feeds as whole
from proofsheet.sources import images as files

RNG = np.random.default_rng(3)


def test_blur_equals_plain_convolution():
    v, k = RNG.integers(0, 256, (9, 12)).astype(float), images.gaussian(5)
    p = np.pad(v, 2, "reflect")
    plain = [[(p[y : y + 5, x : x + 5] * np.outer(k, k)).sum() for x in range(12)] for y in range(9)]
    assert np.allclose(images.blur(v, k), plain)


def test_ssim_of_equal_images_is_one():
    v = RNG.integers(0, 256, (40, 30)).astype(float)
    assert np.allclose(images.ssim_map(v, v), 1)
    assert min(images.ssim_cells(v, 255 - v)["ssim"]) < 0.5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=7, max_size=7), min_size=1, max_size=7))
def test_components_equal_flood_fill(rows):
    mask = np.array(rows, float)
    seen, count = np.zeros(mask.shape, bool), 0
    found = images.labelled(mask)
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        count += 1
        stack, members = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            members.append(found[a, b])
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = True
                        stack.append((c, d))
        assert len(set(members)) == 1
    assert found.max(initial=0) == count and ((found > 0) == (mask > 0)).all()


def test_template_is_found_where_it_was_cut():
    v = RNG.integers(0, 256, (30, 40)).astype(float)
    s = images.match_scores(v, v[7:15, 11:23])
    assert np.unravel_index(s.argmax(), s.shape) == (7, 11) and s.max() == pytest.approx(1)
    assert (images.match_scores(np.ones((9, 9)), np.ones((3, 3))) == 0).all()


def test_edges_of_a_square():
    v = np.zeros((20, 20))
    v[5:15, 5:15] = 255
    e = images.edges(v)
    assert e.any() and not e[9:11, 9:11].any() and not e[:3].any()


def test_heat_leaves_unchanged_places():
    b, d, m = np.full((4, 4), 100.0), np.arange(16.0).reshape(4, 4), np.zeros((4, 4))
    m[3, 3] = 1
    h = images.heat(b, d, m)
    assert (h[0, 0] == 100).all() and (h[3, 3] != 100).any() and h.min() >= 0 and h.max() <= 255


@pytest.mark.parametrize("value,level", [(0.0004999, "low"), (0.0005, "medium"), (0.005, "high"), (0.02, "critical")])
def test_severity_limits(spark, value, level):
    assert spark.range(1).select(pixels.area_severity(F.lit(value))).first()[0] == level


def test_overall_severity_limits(spark):
    cases = [(None, 0.9, 0.0, "none"), (1, 0.0, 0.85, "low"), (1, 0.0, 0.8499, "medium"), (1, 0.02, 0.9, "high"), (3, 0.0, 0.9, "high"), (1, 0.05, 0.9, "critical")]
    df = spark.createDataFrame(cases, "r int, rate double, ssim double, expected string")
    assert [r[0] for r in df.select(decisions.overall_severity(F.col("r"), F.col("rate"), F.col("ssim")) == F.col("expected")).collect()] == [True] * len(cases)


def plain_nms(rows, iou, inside):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[3] * r[4], r[0])):
        def common(a, b):
            return max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
        if not any(common(r, k) / max(r[3] * r[4] + k[3] * k[4] - common(r, k), 1) >= iou or common(r, k) / (r[3] * r[4]) >= inside for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def test_dedup_equals_loop_and_is_idempotent(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(60), rng.randrange(60), rng.randrange(5, 40), rng.randrange(5, 40), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "region_id long, x long, y long, width long, height long, page_index long")
    fields = ["region_id", "x", "y", "width", "height"]
    once = boxes.deduplicated(df, ["page_index"], fields, "region_id")
    assert {r["region_id"] for r in once.collect()} == plain_nms(rows, 0.72, 0.88)
    assert once.count() == boxes.deduplicated(once, ["page_index"], fields, "region_id").count()


def test_groups_equal_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        x, y = rng.randrange(300), rng.randrange(600)
        rows.append((i, 0, x, y, x + rng.randrange(10, 80), y + rng.randrange(5, 30)))
    df = spark.createDataFrame(rows, "pos long, doc_id long, x1 long, y1 long, x2 long, y2 long")
    for rule in (boxes.paragraph_rule, boxes.region_rule):
        root = list(range(len(rows)))
        for a in rows:
            for b in rows:
                if a[0] < b[0] and rule(tuple(map(float, a[2:])), tuple(map(float, b[2:]))):
                    lo, hi = sorted((root[a[0]], root[b[0]]))
                    root = [lo if r == hi else r for r in root]
        got = {r["pos"]: r["root"] for r in boxes.joined_groups(df, ["doc_id"], "pos", rule, 1.0).collect()}
        assert got == dict(enumerate(root))


def test_text_differences(spark):
    pairs = spark.createDataFrame([(1, "LOT 12 of 3", "LOT 13 of 3 new"), (2, "same", "same"), (3, "", ""), (4, "a b c", "a c")], "k long, a string, b string")
    pairs = pairs.select("k", tx.tokens(F.col("a")).alias("a"), tx.tokens(F.col("b")).alias("b"))
    got = [tuple(r) for r in texts.differences(pairs, ["k"]).orderBy("k", "number").collect()]
    assert got == [(1, 1, "replace", "12", "13"), (1, 2, "added", "", "new"), (4, 1, "missing", "b", "")]
    ratio = {r["k"]: r["ratio"] for r in texts.similarity(pairs, ["k"]).collect()}
    assert ratio[2] == ratio[3] == 1 and ratio[4] == pytest.approx(SequenceMatcher(None, "abc", "ac").ratio())
    assert {r["k"]: r["similar"] for r in texts.similar(pairs, ["k"], 0.85).collect()} == {1: False, 2: True, 3: True, 4: False}


def test_languages(spark):
    cases = {"产品 A": "zh+latin", "产品": "zh", "Привет": "conflict", "12 %": "numeric", "der und die": "de", "le chat avec": "fr", "el niño": "es", "the und": "latin", "plain words": "en", "word": "latin", "": "unknown"}
    df = texts.analysed(spark.createDataFrame(list(cases.items()), "text string, expected string"))
    assert {r["text"]: r["language"] for r in df.collect()} == cases


def test_canonical_spelling_keeps_case(spark):
    df = spark.createDataFrame([("FUR Kuhl grose", "de"), ("Espana", "es"), ("für", "de"), ("fur", "en")], "t string, l string")
    got = [[tuple(x) for x in r[0]] for r in df.select(tx.replacements(F.col("t"), F.col("l"))).collect()]
    assert got == [[("FUR", "FÜR"), ("Kuhl", "Kühl")], [("Espana", "España")], [], []]


def test_critical_lines(spark):
    cases = [("区域 3：替换：原图「a」 → 重排图「b」", False), ("区域 3：替换：原图「a」 → 重排图「1」", True), ("重排图缺少：「Warning」", True), ("重排图新增：「日期」", True), ("LOT 3", False)]
    df = spark.createDataFrame(cases, "line string, expected boolean")
    assert all(r[0] for r in df.select(tx.critical(F.col("line")) == F.col("expected")).collect())


def test_fit_gives_planted_transform(spark):
    rows = []
    for i in range(40):
        x, y = float(RNG.integers(0, 500)), float(RNG.integers(0, 500))
        a, b = 1.05 * np.cos(0.1), 1.05 * np.sin(0.1)
        rows.append((0, i, x, y, a * x - b * y + 7 + 90 * (i % 5 == 0), b * x + a * y - 4))
    r = al.fitted(spark.createDataFrame([tuple(map(float, x[2:])) + x[:2] for x in rows], "bx double, by double, ax double, ay double, k long, pair_id long"), ["k"]).first()
    assert (r["scale"], r["rotation"], r["x"], r["y"]) == pytest.approx((1.05, np.degrees(0.1), 7, -4), abs=1e-6) and r["inliers"] == 32


def test_equal_pairs_pass(spark):
    v = RNG.integers(0, 256, 400).astype(float).tolist()
    other = list(v)
    other[105:115] = [255 - x for x in other[105:115]]
    for k in range(6):
        other[105 + 20 * k : 115 + 20 * k] = [(x + 128) % 256 for x in v[105 + 20 * k : 115 + 20 * k]]
    pairs = spark.createDataFrame([(1, 20, 20, v, v), (2, 20, 20, v, other)], "image_id long, height long, width long, a array<double>, b array<double>")
    got = {r["image_id"]: r for r in whole.compared(pairs).collect()}
    assert got[1]["status"] == "PASS" and got[1]["score"] == pytest.approx(100) and got[1]["severity"] == "none"
    assert got[2]["status"] == "ERROR" and got[2]["score"] < 80 and got[2]["severity"] == "critical"


def test_png_round_trip_through_the_image_source(spark, tmp_path):
    grey, colour = RNG.integers(0, 256, (5, 7)), RNG.integers(0, 256, (4, 3, 3))
    (tmp_path / "g.png").write_bytes(files.encode_png(grey))
    (tmp_path / "c.png").write_bytes(files.encode_png(colour))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    df = files.read_images(spark, str(tmp_path))
    assert {r["origin"].rsplit("/", 1)[1]: r["error"] for r in df.collect()} == {"g.png": None, "c.png": None, "bad.png": "undecodable"}
    got = {(r["origin"].rsplit("/", 1)[1], r["y"], r["x"]): r["v"] for r in files.pixels_of(df).collect()}
    assert all(got["g.png", y, x] == grey[y, x] for y in range(5) for x in range(7))
    b, g, r = colour[2, 1].tolist()
    assert got["c.png", 2, 1] == int(0.299 * r + 0.587 * g + 0.114 * b + 0.5) and len(got) == 35 + 12


def test_run_config_is_written_once(spark, tmp_path):
    path = str(tmp_path / "config")
    first = files.write_run_config(spark, path, {"mode": "fusion"}, "a1")
    assert files.write_run_config(spark, path, {"mode": "other"}, "a1") == first
    with pytest.raises(ValueError):
        files.write_run_config(spark, path, {"mode": "fusion"}, "b2")


def test_fit_with_alternating_outliers(spark):
    rng, rows = np.random.default_rng(8), []
    for pair in range(5):
        for i in range(12):
            x, y = map(float, rng.uniform(0, 500, 2))
            ax, ay = (1.1 * x + 7, 1.1 * y - 4) if i % 2 == 0 else map(float, rng.uniform(0, 500, 2))
            rows.append((pair, i, ax, ay, x, y))
    pairs = spark.createDataFrame(rows, "image_pair long, pair_id long, ax double, ay double, bx double, by double")
    got = al.fitted(pairs, ["image_pair"]).collect()
    assert len(got) == 5 and all(r["inliers"] >= 6 and abs(r["scale"] - 1.1) < 0.01 and abs(r["x"] - 7) < 3 and abs(r["y"] + 4) < 3 for r in got)


def test_over_budget_image_keeps_its_row(spark):
    rows = spark.createDataFrame([(1, 0, [1, 2, 3]), (1, 1, [4, 5, 6]), (2, 0, [7, 8]), (2, 1, [9, 10])], "image_id long, y long, a array<int>")
    got = {r["image_id"]: r for r in images.gather(rows, "a", max_pixels=4).collect()}
    assert got[1]["error"] == "over_budget" and got[1]["a"] is None and got[2]["error"] is None and got[2]["a"] == [7, 8, 9, 10]
    found = {r["image_id"]: r for r in images.map_images(images.gather(rows, "a", max_pixels=4), lambda v: {"s": [v.sum()]}, "s double", "a").collect()}
    assert (found[1]["s"], found[1]["error"], found[2]["s"], found[2]["error"]) == (None, "over_budget", 34.0, None)


def test_tall_lines_have_their_neighbours_anywhere(spark):
    for top in (0, 350, 700):
        rows = [(top, 0, "der und die", 0, top, 200, top + 300), (top, 1, "plain", 0, top + 1100, 200, top + 1400)]
        df = spark.createDataFrame(rows, "doc_id long, pos long, text string, x1 long, y1 long, x2 long, y2 long")
        assert {r["pos"]: r["context"] for r in texts.context_languages(df, ["doc_id"], "pos").collect()}[1] == "de"


def test_plain_letters_follow_the_rule(spark):
    some = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c).isalpha()] + ["é", "straße", "ﬁne", "Ǆ", "plain", "Ａ"]
    df = spark.createDataFrame([(x, tx.plain_word(x)) for x in some], "t string, expected string")
    bad = [(r["t"], r["expected"], r["p"]) for r in df.withColumn("p", tx.plain(F.col("t"))).collect() if r["p"] != r["expected"]]
    assert len(bad) <= 2, bad  # capital letters whose small form has a mark of its own


def plain_pictures(found, width, height):
    """Union of boxes that meet, last box first, then removal of what lies in a larger one: loops over tuples."""
    gx, gy, whole = max(3, round(width * 0.008)), max(3, round(height * 0.008)), width * height
    todo = [b for b in found if b[2] * b[3] / whole <= 0.45]
    before = None
    while before != len(todo):
        before, done, todo = len(todo), [], list(todo)
        while todo:
            x, y, w, h = todo.pop()
            left = []
            for o in todo:
                u = (min(x, o[0]), min(y, o[1]))
                u += (max(x + w, o[0] + o[2]) - u[0], max(y + h, o[1] + o[3]) - u[1])
                near = min(x + w + gx, o[0] + o[2]) > max(x - gx, o[0]) and min(y + h + gy, o[1] + o[3]) > max(y - gy, o[1])
                if near and u[2] * u[3] / whole <= 0.35:
                    x, y, w, h = u
                else:
                    left.append(o)
            done.append((x, y, w, h))
            todo = left
        todo = done
    rows = [(i, *b) for i, b in enumerate(sorted(todo, key=lambda b: -b[2] * b[3]))]
    kept = plain_nms(rows, 0.72, 0.88)
    return [r[1:] for r in rows if r[0] in kept]


def test_pictures_are_united_like_loops(spark):
    rng = random.Random(12)
    cases = [[(0, 0, 600, 600), (50, 50, 500, 500)]]
    cases += [[(rng.randrange(900), rng.randrange(900), rng.randrange(5, 120), rng.randrange(5, 120)) for _ in range(rng.randrange(1, 60))] for _ in range(25)]
    rows = [(p, i, *b) for p, found in enumerate(cases) for i, b in enumerate(found)]
    df = spark.createDataFrame(rows, "page_index long, region_id long, x long, y long, width long, height long")
    got = {}
    for r in boxes.merged_pictures(df, ["page_index"], "region_id", 1000, 1000).orderBy("page_index", "number").collect():
        got.setdefault(r["page_index"], []).append((r["x"], r["y"], r["width"], r["height"]))
    for p, found in enumerate(cases):
        assert got.get(p, []) == plain_pictures(found, 1000, 1000)


def test_grid_finds_all_clashes(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(-50, 900), rng.randrange(-50, 900), rng.choice([3, 30, 700]), rng.choice([3, 30, 700]), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "region_id long, x long, y long, width long, height long, page_index long")
    got = boxes.deduplicated(df, ["page_index"], ["region_id", "x", "y", "width", "height"], "region_id").collect()
    assert {r["region_id"] for r in got} == plain_nms(rows, 0.72, 0.88)


def test_template_search_finds_turned_and_resized_parts(spark):
    rng = np.random.default_rng(5)
    page = np.floor(images.blur(rng.integers(0, 256, (90, 100)).astype(float), images.gaussian(5)))
    for rotation, (h, w) in ((0, (30, 24)), (90, (24, 30)), (180, (30, 24))):
        part = np.rot90(page[20 : 20 + h, 40 : 40 + w], -rotation // 90)
        template = images.resized(part, part.shape[0] * 2, part.shape[1] * 2, "cubic")
        pages = spark.createDataFrame([(0, 7, 90, 100, None, page.ravel().tolist())], "template long, image_id long, height long, width long, error string, a array<double>")
        asked = spark.createDataFrame([(0, *template.shape, template.ravel().tolist(), float(part.shape[1]), float(part.shape[0]))], "template long, t_height long, t_width long, t array<double>, on_width double, on_height double")
        best = max(templates.search(pages, asked, ["template"]).collect(), key=lambda r: r["score"])
        assert (best["rotation"], best["scale"]) == (rotation, 1.0) and abs(best["x"] - 40) <= 1 and abs(best["y"] - 20) <= 1 and best["rank"] == 1
        assert (best["width"], best["height"]) == (w, h)


def test_match_scores_equal_plain_correlation():
    rng = np.random.default_rng(6)
    v, t = rng.integers(0, 256, (15, 18)).astype(float), rng.integers(0, 256, (4, 5)).astype(float)
    v[:6, :7] = 9
    for y in range(12):
        for x in range(14):
            w = v[y : y + 4, x : x + 5]
            a, b = w - w.mean(), t - t.mean()
            expected = (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) if (a * a).sum() > 0 else 0
            assert images.match_scores(v, t)[y, x] == pytest.approx(expected, abs=1e-9)


def test_resampling_and_warping():
    v = RNG.integers(0, 256, (12, 16)).astype(float)
    assert (images.resized(v, 6, 8, "area") == np.floor(v.reshape(6, 2, 8, 2).mean((1, 3)) + 0.5)).all()
    assert (images.resized(v, 12, 16, "cubic") == v).all() and images.resized(np.full((5, 7), 9.0), 11, 3, "linear").tolist() == [[9.0] * 3] * 11
    assert (images.warped(v, 1.0, 0.0, 3, -2, 12, 16)[:10, 3:] == v[2:, :13]).all()
    big = images.warped(images.resized(v, 24, 32, "linear"), 0.5, 0.0, 0, 0, 12, 16)
    assert big.shape == v.shape
    flat = images.contrasted(np.full((64, 64), 77.0))
    assert flat.shape == (64, 64) and np.ptp(flat) == 0
    dim = np.floor(RNG.integers(0, 256, (80, 96)) / 8) + 100
    assert np.ptp(images.contrasted(dim)) > 2 * np.ptp(dim)


def test_regions_of_a_drawn_page():
    v = np.full((300, 400), 235.0)
    rng = np.random.default_rng(2)
    for line in range(3):
        for k in range(14):
            x, y = 30 + 12 * k, 30 + 24 * line
            v[y : y + 10, x : x + 3] = 20
            v[y + 4 : y + 6, x : x + 7] = 20
    v[150:260, 220:360] = rng.integers(0, 2, (110, 140)) * 200 + 20
    found = regions.separated(v)
    kinds = {k: [(x, y, w, h) for kk, x, y, w, h in zip(found["kind"], found["x"], found["y"], found["width"], found["height"], strict=True) if kk == k] for k in ("text", "picture")}
    assert sum(w > 100 and h < 20 and y < 110 for x, y, w, h in kinds["text"]) >= 3
    assert any(abs(x - 220) < 12 and abs(y - 150) < 12 and abs(w - 140) < 24 and abs(h - 110) < 24 for x, y, w, h in kinds["picture"])
    assert len(regions.candidates(v)["x"]) >= len(kinds["text"])
    assert not len(regions.separated(np.full((50, 60), 200.0))["kind"])


def test_readings_follow_each_other(spark):
    lines = spark.createDataFrame([(1, "Zutaten fur alle", 0.80, None), (2, "plain words", 0.95, None), (3, "keep this", 0.90, None)], "k long, text string, confidence double, context string")
    readings = spark.createDataFrame([(1, "Zutaten für alle", 0.90), (1, "Zutaten für allen", 0.92), (2, "plain word", 0.94)], "k long, candidate string, candidate_score double")
    got = {r["k"]: r for r in panels.reviewed(lines, readings, ["k"]).collect()}
    # The surer reading is taken first; the other one then keeps the language and is less than 0.02 worse, so not taken.
    assert (got[1]["text"], got[1]["reviewed"], got[1]["primary_text"]) == ("Zutaten für allen", True, "Zutaten fur alle")
    assert (got[2]["text"], got[2]["reviewed"], got[3]["text"], got[3]["primary_text"]) == ("plain words", False, "keep this", None)


def test_reader_must_give_a_group_for_each_patch(spark):
    pictures = spark.createDataFrame([(1, 4, 5, None, list(range(20)))], "image_id long, height long, width long, error string, a array<int>")
    regions_ = spark.createDataFrame([(1, 3, 1, 1, 2, 2), (1, 4, 0, 0, 5, 4)], "image_id long, region_id long, x long, y long, width long, height long")
    got = sorted(tuple(r) for r in panels.recognised(pictures, regions_, "a", batch=1).collect())
    assert got == [(1, 3, 0, "LOT 2 2 36", 0.36, 1, 1, 3, 3), (1, 4, 0, "LOT 5 4 190", 0.9, 0, 0, 5, 4)]
    with pytest.raises(Exception, match="groups"):
        panels.recognised(pictures, regions_, "a", lambda: lambda patches: []).collect()


def test_failed_sample_has_a_result(spark):
    samples = spark.createDataFrame([(1, "fusion", "over_budget"), (2, "ocr", None)], "sample_id long, mode string, error string")
    boxes_ = spark.createDataFrame([], "sample_id long, region int, x long, y long, width long, height long")
    lines = spark.createDataFrame([(2, 1, 5, "a \"b\"")], "sample_id long, region int, at long, line string")
    records = spark.createDataFrame([(2, 0)], "sample_id long, n long")
    moved = spark.createDataFrame([(2, True, "moved")], "sample_id long, success boolean, status string")
    got = {r["sample_id"]: r for r in comparison.compared_samples(samples, boxes_, lines, records, moved).withColumn("j", comparison.as_json("result")).collect()}
    one, two = (json.loads(got[k]["j"]) for k in (1, 2))
    assert one["status"]["completed"] is False and one["status"]["error_type"] == "over_budget" and one["summary"]["final_status"] is None
    assert two["summary"] == {"detection_count": 1, "final_status": "ERROR", "fusion_method": None} and two["warnings"] == [comparison.NO_RECORDS]
    assert two["detections"][0] == {"detection_id": "ocr-1-1", "type": "ocr_text_difference", "bbox": None, "region_index": 1, "description": 'a "b"'}


def test_pictures_of_a_comparison():
    a = np.full((40, 40), 100.0)
    b = a.copy()
    b[10:20, 10:25] = 220
    found = pictures.of_comparison(a, b)
    assert list(found) == list(pictures.NAMES) and all(files.encode_png(v)[:4] == b"\x89PNG" for v in found.values())
    assert found["mask"][12, 12] == 255 and found["difference_pixels"][12, 12].tolist() == [0, 0, 255] and (found["result"][10, 10] != b[10, 10]).any()


def test_alignment_finds_a_planted_transform():
    rng = np.random.default_rng(7)
    a = np.floor(images.blur(rng.integers(0, 256, (160, 200)).astype(float), images.gaussian(9, 2.0)) * 3 - 250).clip(0, 255)
    turn, at = 1.02 * np.exp(1j * np.radians(2.0)), 5 - 4j
    back = 1 / turn
    b = images.warped(a, abs(back), np.degrees(np.angle(back)), (-at * back).real, (-at * back).imag, 160, 200)
    moved, record = al.aligned(a, b)
    assert record["success"] and record["scale"] == pytest.approx(1.02, abs=0.01) and record["rotation_degrees"] == pytest.approx(2, abs=0.4)
    assert (record["x"], record["y"]) == pytest.approx((5, -4), abs=1.5)
    assert np.abs(moved - a)[20:-20, 20:-20].mean() < np.abs(b - a)[20:-20, 20:-20].mean() / 2
    same, record = al.aligned(a, np.full((160, 200), 9.0))
    assert not record["success"] and record["reason"] == "too few matches" and (same == 9).all()
