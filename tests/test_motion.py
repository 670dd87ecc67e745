"""Registration and flow against known movements."""

import numpy as np
import pytest

from tessera.operators import kernels, motion


def texture(seed, h=140, w=200):
    rng = np.random.default_rng(seed)
    soft = np.exp(-(np.fft.fftfreq(h)[:, None] ** 2 + np.fft.fftfreq(w)[None, :] ** 2) * 600)
    out = np.real(np.fft.ifft2(np.fft.fft2(rng.normal(size=(h, w))) * soft))
    return (out - out.min()) / np.ptp(out) * 255


def seen(matrix, seed=0):
    """A source and the target that the matrix makes of it."""
    big, (x, y) = texture(seed), motion.grid((90, 160))
    u, v = (matrix[i, 0] * x + matrix[i, 1] * y + matrix[i, 2] for i in (0, 1))
    return big[20:110, 20:180], motion.sample(big, 20 + u, 20 + v)[0], np.stack([u - x, v - y], axis=-1)


byte = lambda p: np.rint(p).astype(np.uint8)


def test_same_frames_are_at_rest():
    source, _, _ = seen(motion.shift(0, 0))
    found = motion.register(byte(source), byte(source))
    assert found.method == "identity" and found.error == 0 and found.score == 1


@pytest.mark.parametrize("dx, dy", [(3, -2), (2.5, 1.25), (-6, 4)])
def test_translations(dx, dy):
    source, target, _ = seen(motion.shift(dx, dy))
    found = motion.register(byte(source), byte(target))
    assert np.abs(found.matrix[:, 2] - (-dx, -dy)).max() < 1.2 and found.error <= motion.FAST_ERROR
    assert np.abs(motion.refine(source, target, found.matrix) - motion.shift(dx, dy)).max() < 0.05


def test_affine_is_recovered():
    want = np.array([[1.02, 0.03, 3.3], [-0.025, 0.98, -2.7]])
    source, target, _ = seen(want, 3)
    assert np.abs(motion.refine(source, target, motion.shift(0, 0)) - want).max() < 0.02
    found = motion.register(byte(source), byte(target))
    assert found.error < motion.error_of(source, target, motion.shift(0, 0))[0]


def test_exposure_is_no_motion():
    source, target, _ = seen(motion.shift(1.5, -0.5), 5)
    got = motion.refine(source, target * 0.9 + 20, motion.shift(0, 0))
    assert np.abs(got - motion.shift(1.5, -0.5)).max() < 0.25


def test_flow_follows_a_shear():
    source, target, want = seen(np.array([[1.0, 0.02, 1.0], [0.0, 1.01, -1.0]]), 7)
    miss = np.hypot(*np.moveaxis(motion.flow(target, source) - want, -1, 0))[12:-12, 12:-12]
    assert np.median(miss) < 0.5


def test_confidence_is_zero_where_nothing_can_be_known():
    source, target, _ = seen(motion.shift(8, 0), 9)
    covered = np.zeros(source.shape, np.uint8)
    covered[30:50, 60:90] = 255
    a = motion.align(byte(source), byte(target), covered, np.zeros_like(covered))
    assert (a.confidence[:, :6] == 0).all() and (a.confidence[32:48, 72:92] == 0).all() and a.confidence[60:, 40:].mean() > 0.6
    assert np.abs(a.image.astype(int) - byte(target))[a.confidence > 0].mean() < 6


def test_flow_only_where_a_ring_differs():
    source, target, _ = seen(motion.shift(2, 0), 2)
    mask = np.zeros(source.shape, np.uint8)
    mask[40:60, 40:120] = 255
    assert not motion.align(byte(source), byte(target), np.zeros_like(mask), mask).local
    assert motion.align(byte(source), byte(target), np.zeros_like(mask), mask, local=True).local


def test_flicker():
    still = byte(texture(1)[:60, :90])
    mask = np.zeros(still.shape, np.uint8)
    mask[20:40, 20:60] = 255
    assert motion.flicker([still] * 4, [mask] * 4) == (0.0, 0.0)
    assert motion.flicker([still] * 4, [mask * 0] * 4) == (0.0, 0.0) and motion.flicker([still], [mask]) == (0.0, 0.0)
    lit = [np.where(mask > 0, np.clip(still.astype(int) + 30 * (i % 2), 0, 255), still).astype(np.uint8) for i in range(4)]
    ratio, p95 = motion.flicker(lit, [mask] * 4)
    assert ratio > 5 and 0.1 < p95 < 0.13


def test_residual_score_against_pairs():
    rng = np.random.default_rng(4)
    box = lambda n: np.column_stack([rng.integers(0, 3, n), (a := rng.integers(0, 40, (n, 2))), a + rng.integers(5, 30, (n, 2))])
    found, boxes = np.column_stack([box(12), rng.random(12)]), box(5)
    want = 0.0
    for f in found:
        for b in boxes:
            if f[0] == b[0]:
                w, h = min(f[3], b[3]) - max(f[1], b[1]), min(f[4], b[4]) - max(f[2], b[2])
                both = max(0, w) * max(0, h)
                iou = both / ((f[3] - f[1]) * (f[4] - f[2]) + (b[3] - b[1]) * (b[4] - b[2]) - both)
                want = max(want, f[5] * min(1, 4 * iou) if iou > 0.01 else 0)
    assert abs(kernels.residual_score(found, boxes) - want) < 1e-12
    assert kernels.residual_score(found[:0], boxes) == 0.0


def test_samples_of_several_images_are_those_of_each():
    images = [texture(1, 30, 40), texture(2, 30, 40), np.stack([texture(i, 30, 40) for i in range(3)], axis=-1)]
    x, y = motion.grid((30, 40))
    got, inside = motion.samples(images, x * 1.1 - 1, y * 0.9 + 0.3)
    for image, one in zip(images, got, strict=True):
        want, there = motion.sample(image, x * 1.1 - 1, y * 0.9 + 0.3)
        assert (one == want).all() and (there == inside).all()
    assert np.allclose(motion._box(np.ones((2, 5, 6)), 2), 25)
