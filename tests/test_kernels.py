import numpy as np
import pytest

from tessera.operators import engines
from tessera.operators import kernels as k
from tessera.sources import masks as m


def test_components_and_holes():
    a = np.zeros((9, 9), np.uint8)
    a[0, 0] = a[1, 1] = 255
    a[4:8, 4:8] = 255
    a[5, 5] = 0
    labels, areas = k.components(a)
    assert sorted(areas.tolist()) == [2, 15] and labels.max() == 2
    assert k.largest_component(a) == 15 and k.largest_component(a * 0) == 0
    assert (k.drop_small(a, 3) > 0).sum() == 15
    assert k.fill_holes(a)[5, 5] == 255 and k.fill_holes(a)[3, 3] == 0


def test_morphology_against_brute_force():
    rng = np.random.default_rng(1)
    a, e = rng.integers(0, 255, (12, 14)).astype(np.uint8), k.ellipse(2)
    for y in range(12):
        for x in range(14):
            near = [a[y + dy, x + dx] for dy in range(-2, 3) for dx in range(-2, 3) if e[dy + 2, dx + 2] and 0 <= y + dy < 12 and 0 <= x + dx < 14]
            assert k.dilate(a, e)[y, x] == max(near) and k.erode(a, e)[y, x] == min(near)


def test_registration_finds_a_shift():
    rng = np.random.default_rng(42)
    base = np.zeros((120, 160), np.uint8)
    for y, x in zip(rng.integers(15, 105, 20), rng.integers(15, 145, 20), strict=True):
        base[y - 2 : y + 3, x - 2 : x + 3] = 220
    moved, _ = k.warp(base, 7, -4)
    dx, dy, _ = k.register(base, moved)
    assert abs(dx - 7) <= 2 and abs(dy + 4) <= 2


def test_clean_plate_recovers_what_other_frames_show():
    clip = list(k.generate_clip(5, 120, 72, (40, 30, 80, 50)))
    clean = [clip[0][1]] * 5
    masks = [np.zeros((72, 120), np.uint8) for _ in range(5)]
    masks[2][30:50, 40:80] = 255
    burned = [c.copy() for c in clean]
    burned[2][masks[2] > 0] = 250
    out, left = k.clean_plate(burned, masks, 2)
    assert not left.any() and np.abs(out.astype(int) - clean[2].astype(int)).mean() < 1


def test_composite_keeps_outside_exactly():
    _, clean, burned, mask = next(k.generate_clip(1))
    out = k.composite_exact(burned, clean, mask)
    assert (out[mask == 0] == burned[mask == 0]).all() and (out[mask > 0] != burned[mask > 0]).any()
    assert (k.composite_exact(burned, clean, mask * 0) == burned).all()


def test_alpha_and_fill():
    mask = np.zeros((20, 20), np.uint8)
    mask[5:15, 5:15] = 255
    a = k.soft_alpha(mask, 3)
    assert a[mask == 0].max() == 0 and a[10, 10] > 0.9 and a[5, 5] < 0.6
    image = np.full((20, 20), 90, np.uint8)
    image[mask > 0] = 250
    assert abs(k.diffuse(image, mask).astype(int) - 90).max() <= 1


def test_text_and_panel_detection():
    image = np.full((90, 160), 60, np.uint8)
    image[60:80, 20:140] = 20
    for x in range(40, 120, 6):
        image[65:75, x : x + 3] = 240
    boxes = k.detect_text(image)
    assert any(b[0] <= 45 and b[2] >= 115 and b[1] >= 55 and b[3] <= 85 for b in boxes)
    assert k.detect_panel(image, (40, 65, 121, 75)) is not None
    seed = k.text_seed(image, np.where(image > 0, 255, 0).astype(np.uint8), 10)
    grown = k.grow_text(seed, 10, 0.2, 1, 5)
    assert (grown[seed > 0] == 255).all()


def test_mask_rasters_and_archives(spark):
    assert (m.binarize(np.array([[0, 7], [9, 255]])) > 0).tolist() == [[False, False], [True, True]]
    assert (m.binarize(np.array([[0.0, 0.04], [0.06, 1.0]])) > 0).tolist() == [[False, False], [True, True]]
    plane = np.eye(4, dtype=np.uint8) * 255
    df = spark.createDataFrame([("a.npz", bytearray(m.export_archive([(3, 1000, plane), (4, 2000, plane.T)])))], "path string, content binary")
    got = m.import_archive(df).orderBy("frame_index").collect()
    assert [(r.frame_index, r.pts_us, r.height) for r in got] == [(3, 1000, 4), (4, 2000, 4)] and bytes(got[0].mask) == plane.tobytes()


def test_back_ends_fall_through():
    image, mask = np.full((8, 8), 50, np.uint8), np.zeros((8, 8), np.uint8)
    mask[3:5, 3:5] = 255
    assert engines.execute(["lama", "telea"], image, mask)[0] == "telea"
    with pytest.raises(engines.ModelUnavailable):
        engines.execute(["lama", "sttn"], image, mask)

    def broken(*_):
        raise ValueError

    with pytest.raises(ValueError):
        engines.execute(["x", "telea"], image, mask, {**engines.REGISTRY, "x": engines.Engine("x", True, broken)})
