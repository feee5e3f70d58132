import itertools

import numpy as np
import pytest

from pavestat.functions import raster
from pavestat.operators import frames


def test_png_goes_there_and_back_and_damage_is_told():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (6, 3, 3), (1, 1)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        data = raster.write_png(image)
        assert (raster.read_png(data) == image).all()
    with pytest.raises(ValueError, match="damaged"):
        raster.read_png(data[:20] + b"\xff" + data[21:])
    with pytest.raises(ValueError, match="not a PNG"):
        raster.read_png(b"")


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_row_filters(kind):
    import zlib

    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (6, 5)).astype(int)
    rows = []
    for y in range(6):
        line = [kind]
        for x in range(5):
            a = image[y, x - 1] if x else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            paeth = min((a, b, c), key=lambda v: (abs(a + b - c - v), [a, b, c].index(v)))
            line.append((image[y, x] - {1: a, 2: b, 3: (a + b) // 2, 4: paeth}[kind]) % 256)
        rows.append(bytes(line))
    plain = raster.write_png(image)
    body = zlib.compress(b"".join(rows))
    chunk = len(body).to_bytes(4, "big") + b"IDAT" + body + zlib.crc32(b"IDAT" + body).to_bytes(4, "big")
    assert (raster.read_png(plain[:33] + chunk + plain[-12:]) == image).all()


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for share in (0.1, 0.3, 0.5, 0.9):
        mask = rng.random((23, 31)) < share
        want, n = np.zeros(mask.shape, int), 0
        for start in zip(*np.nonzero(mask), strict=True):
            if want[start]:
                continue
            n += 1
            todo = [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 23 and 0 <= x < 31 and mask[y, x] and not want[y, x]:
                    want[y, x] = n
                    todo += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        assert (raster.components(mask) == want).all()
    assert raster.components(np.zeros((0, 0))).size == 0 and raster.component_count(np.zeros((4, 4))) == 0


def test_assignment_has_the_greatest_sum():
    rng = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 6), repeat=2):
        for _ in range(5):
            gain = rng.integers(0, 5, (n, m)) / 4
            pairs = raster.assign(gain)
            assert len(pairs) == min(n, m) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
            rows, cols = (range(n), range(m)) if n <= m else (range(m), range(n))
            g = gain if n <= m else gain.T
            best = max(sum(g[i, p[i]] for i in rows) for p in itertools.permutations(cols, len(rows)))
            assert sum(gain[i, j] for i, j in pairs) == pytest.approx(best)


def test_dilation_reaches_an_ellipse():
    dot = np.zeros((31, 31))
    dot[15, 15] = 1
    assert raster.dilate(dot, 1).sum() == 1
    five = raster.dilate(dot, 5)
    assert five[13:18, 13:18].sum() == five.sum() and five[13, 15] and five[15, 13] and not five[13, 13]
    big = raster.dilate(dot, 21)
    assert big[5, 15] and big[25, 15] and big[15, 5] and not big[5, 5] and (big == big.T).mean() > 0.9
    corner = np.zeros((4, 4))
    corner[0, 0] = 1
    assert raster.dilate(corner, 21).all()


def test_lanes_drawn_and_read_back():
    lane = [(30.0, 0.0), (30.0, 99.0)]
    mask = raster.rasterise([lane, [(5, 5)], [(900, 900), (901, 901)]], 100, 80, 6)
    assert mask[50, 27:34].all() and not mask[50, :27].any() and not mask[50, 34:].any()
    assert raster.mask_lanes(mask) == [[30] * 9]
    assert raster.polyline_lanes([lane, [(1, 1)], [(0, 41), (9, 49)]], 100) == [[30] * 9]
    assert raster.polyline_lanes([[(10, 20), (30, 40)]], 60) == [[-2, 10, 20, 30, -2]]


def test_line_scores():
    rows = list(range(10, 101, 10))
    gt = [[100] * 10, [300] * 10]
    assert raster.line_scores(gt, gt, rows) == (1.0, 0.0, 0.0)
    assert raster.line_scores([], gt, rows) == (0.0, 0.0, 1.0)
    assert raster.line_scores([[300] * 10], [[100] * 10], rows) == (0.0, 1.0, 1.0)
    assert raster.line_scores([[0] * 10] * 5, gt, rows) == (0.0, 0.0, 1.0)
    assert raster.line_scores([[100] * 2], [[100] * 10], rows, [10, 100]) == (1.0, 0.0, 0.0)


def test_lane_matches():
    lane = lambda x: [(x, y) for y in range(10, 101, 10)]
    assert raster.lane_matches([lane(100)], [lane(100), lane(300)], 120, 500) == (1, 0, 1)
    assert raster.lane_matches([lane(450)], [lane(100)], 120, 500) == (0, 1, 1)
    assert raster.lane_matches([], [lane(100)], 120, 500) == (0, 0, 1)
    assert raster.lane_matches([lane(1)], [], 120, 500) == (0, 1, 0)


def test_image_measures_of_flat_paint():
    mask = np.zeros((80, 80), np.uint8)
    mask[:, 38:42] = 1
    image = np.where(mask, 200, 100).astype(np.uint8)
    assert raster.contrast(image, mask) == pytest.approx(100 / 255)
    assert raster.sharpness(image, mask) > 0.9
    assert raster.sharpness(np.full((80, 80), 9, np.uint8), mask) == 0
    assert raster.contrast(image, mask * 0) is None and raster.sharpness(image, mask * 0) is None
    assert raster.contrast(np.ones((9, 9)), np.ones((9, 9))) is None


def test_width_stability():
    y = np.arange(0, 200.0)
    straight = [np.stack([100 + 0 * y, y], 1), np.stack([200 + 0.5 * y, y], 1)]
    assert raster.width_stability(straight, 1000) == pytest.approx(1.0)
    waves = [straight[0], np.stack([200 + 40 * np.sin(y / 9), y], 1)]
    assert raster.width_stability(waves, 1000) < 0.6
    assert raster.width_stability([], 100) is None and raster.width_stability(straight[:1], 1000) is None


def test_frames_on_rows(spark):
    gt = np.zeros((100, 100), np.uint8)
    gt[:, 10:20] = 255
    pred = np.zeros((100, 100), np.uint8)
    pred[50:, 10:15] = 255
    rows = [("a", raster.write_png(pred), raster.write_png(gt)), ("b", None, raster.write_png(gt)), ("c", raster.write_png(gt), raster.write_png(gt * 0)), ("d", b"junk", raster.write_png(gt)), ("e", None, None)]
    df = spark.createDataFrame(rows, "id string, pred binary, gt binary")
    got = {r["id"]: r for r in frames.detection(frames.mask_counts(df)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["tp"], a["fp"], a["fn"], a["near_tp"], a["near_fn"]) == (250, 0, 750, 75, 75)
    assert (a["iou"], a["precision"], a["recall"], a["f1"]) == (0.25, 1.0, 0.25, 0.4)
    assert (a["near_iou"], a["missed_ratio"], a["count_match"], a["detected"]) == (0.5, 0.75, 1.0, 1)
    assert (b["detected"], b["precision"], b["recall"], b["f1"], b["missed_ratio"]) == (0, None, 0.0, 0.0, 1.0)
    assert (c["iou"], c["f1"], c["count_match"], c["missed_ratio"], c["fp"]) == (None, None, None, None, 1000)
    assert got["d"]["tp"] is None and got["d"]["reason"].startswith("ValueError") and got["e"]["reason"]
    assert frames.mask_counts(df.limit(0)).count() == 0


def test_lanes_on_rows(spark):
    lane = [[30.0, 0.0], [30.0, 99.0]]
    df = spark.createDataFrame([(1, [lane], 100, 80), (2, [], 100, 80), (3, None, 100, 80)], "id int, lanes array<array<array<double>>>, height int, width int")
    drawn = frames.draw_lanes(df)
    got = {r["id"]: r for r in frames.mask_to_lanes(drawn.drop("reason")).collect()}
    assert got[1]["grid_xs"] == [[30] * 9] == got[1]["mask_xs"] and got[2]["mask_xs"] == [] and got[3]["mask"] is None
    pairs = df.selectExpr("id", "lanes AS pred_lanes", "lanes AS gt_lanes", "height", "width")
    assert [tuple(r) for r in frames.lane_matching(pairs).orderBy("id").select("lane_tp", "lane_fp", "lane_fn").collect()] == [(1, 0, 0), (0, 0, 0), (None, None, None)]
    line = spark.createDataFrame([([[10, 20]], [[10, 20]], [5, 10])], "pred_xs array<array<int>>, gt_xs array<array<int>>, rows array<int>")
    assert tuple(frames.line_accuracy(line).select("accuracy", "fp_share", "fn_share").first()) == (1.0, 0.0, 0.0)


def test_lane_width_on_rows(spark):
    side = lambda x: [[float(x), float(y)] for y in range(0, 200, 5)]
    df = spark.createDataFrame([(1, [side(100), side(300)], 1000), (2, [side(100)], 1000), (3, None, 1000)], "id int, lanes array<array<array<double>>>, width int")
    one, two, three = frames.lane_width(df).orderBy("id").collect()
    assert one["width_stability"] == pytest.approx(1.0) and two["width_stability"] is None and two["reason"] is None and three["reason"].startswith("TypeError")
