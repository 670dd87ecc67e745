"""Registration and dense flow in NumPy: sub-pixel warps, affine refinement, pyramid flow, and how far an aligned frame can be trusted.

Transforms are 2 x 3 matrices that take a target's (x, y, 1) to the place in the source that belongs there, so a warp samples.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tessera.operators.kernels import dilate, ellipse, gray, lab, phase_shift

# Acceptance of a registration without a costlier one, and the shares of a pixel's confidence.
FAST_ERROR, FAST_OVERLAP, FINE_ERROR = 0.095, 0.70, 0.075
LOCAL_ERROR, LOCAL_SCORE, RETURN_PX = 0.105, 0.82, 1.8
SHARES = {"return": 0.48, "photo": 0.28, "gradient": 0.14, "registration": 0.10}
PHOTO_SCALE, GRADIENT_SCALE, PHOTO_FLOOR, LEAST_CONFIDENCE = 0.16, 0.55, 0.62, 0.12
LEAST_OVERLAP = 0.35


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values at real places, and which of them lie inside the image."""
    (out,), inside = samples([image], x, y)
    return out, inside


def samples(images: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``sample`` of images of one size at the same places, which are worked out once."""
    h, w = images[0].shape[:2]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1) & (y <= h - 1)
    x0, y0 = np.clip(np.floor(x), 0, max(w - 2, 0)).astype(int), np.clip(np.floor(y), 0, max(h - 2, 0)).astype(int)
    fx, fy = np.clip(x - x0, 0, 1), np.clip(y - y0, 0, 1)
    top = y0 * w + x0
    right, below = (1 if w > 1 else 0), (w if h > 1 else 0)
    at = (top, top + right, top + below, top + (below + right))
    weights, out = (1 - fx, fx, 1 - fy, fy), []
    for image in images:
        gx, hx, gy, hy = (k[..., None] for k in weights) if image.ndim == 3 else weights
        v = np.ascontiguousarray(image, np.float64).reshape(h * w, *image.shape[2:])
        a, b, c, d = (v.take(k, axis=0) for k in at)
        out.append((a * gx + b * hx) * gy + (c * gx + d * hx) * hy)
    return out, inside


def grid(shape: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]].astype(np.float64)
    return x, y


def warp(image: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The image as the target sees it, and where it has pixels."""
    x, y = grid(image.shape)
    return sample(image, matrix[0, 0] * x + matrix[0, 1] * y + matrix[0, 2], matrix[1, 0] * x + matrix[1, 1] * y + matrix[1, 2])


def shift(dx: float, dy: float) -> np.ndarray:
    """The matrix of a source moved by (dx, dy)."""
    return np.array([[1.0, 0.0, -dx], [0.0, 1.0, -dy]])


def halved(image: np.ndarray) -> np.ndarray:
    h, w = image.shape[0] // 2 * 2, image.shape[1] // 2 * 2
    return image[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))


def refine(source: np.ndarray, target: np.ndarray, start: np.ndarray, use: np.ndarray | None = None, rounds: int = 25) -> np.ndarray:
    """Gauss-Newton steps on the six parameters from ``start``, on the difference of gray values where ``use``; from coarse to fine."""
    matrix, levels = start.copy(), []
    a, b, on = source.astype(float), target.astype(float), np.ones(target.shape) if use is None else use.astype(float)
    while True:
        levels.append((a, b, on))
        if min(a.shape) < 48 or len(levels) == 3:
            break
        a, b, on = halved(a), halved(b), halved(on)
    for level in reversed(range(len(levels))):
        a, b, on = levels[level]
        scale = 2.0**level
        m = matrix.copy()
        m[:, 2] /= scale
        gy, gx = np.gradient(a)
        x, y = grid(b.shape)
        for _ in range(rounds):
            u, v = m[0, 0] * x + m[0, 1] * y + m[0, 2], m[1, 0] * x + m[1, 1] * y + m[1, 2]
            (moved, ix, iy), inside = samples([a, gx, gy], u, v)
            w = (inside & (on > 0.5)).ravel()
            if w.sum() < 64:
                break
            j = np.stack([ix * x, ix * y, ix, iy * x, iy * y, iy], axis=-1).reshape(-1, 6)[w]
            e = (b - moved).ravel()[w]
            e -= np.median(e)  # a change of exposure is no motion
            step = np.linalg.lstsq(j.T @ j + 1e-3 * np.eye(6), j.T @ e, rcond=None)[0]
            m += step.reshape(2, 3)
            if np.abs(step[[2, 5]]).max() < 1e-3:
                break
        m[:, 2] *= scale
        if np.isfinite(m).all():
            matrix = m
    return matrix


@dataclass(frozen=True)
class Registration:
    method: str
    matrix: np.ndarray
    error: float
    overlap: float

    @property
    def score(self) -> float:
        return float(np.clip((1 - self.error / 0.35) * min(1.0, self.overlap / 0.9), 0, 1))


def sane(matrix: np.ndarray) -> bool:
    """Finite, and neither collapsed nor blown up."""
    return bool(np.isfinite(matrix).all()) and 0.15 <= abs(np.linalg.det(matrix[:, :2])) <= 6.0


def error_of(source: np.ndarray, target: np.ndarray, matrix: np.ndarray, use: np.ndarray | None = None) -> tuple[float, float]:
    """(error, overlap): .45 median, .35 upper quartile and .20 mean of the gray difference where both have pixels."""
    moved, have = warp(source, matrix)
    overlap = float(have.mean())
    on = have if use is None else have & use
    if overlap < LEAST_OVERLAP or on.sum() < 16:
        return np.inf, overlap
    d = np.abs(moved - target)[on] / 255
    return float(0.45 * np.median(d) + 0.35 * np.percentile(d, 75) + 0.20 * d.mean()), overlap


def register(source: np.ndarray, target: np.ndarray, exclude: np.ndarray | None = None) -> Registration:
    """The best of no move, the phase shift and, only if these leave an error, affine refinements of both; pixels of ``exclude`` don't count."""
    a, b = gray(source).astype(float), gray(target).astype(float)
    use = None if exclude is None else exclude == 0

    def tried(method: str, matrix: np.ndarray) -> Registration:
        error, overlap = error_of(a, b, matrix, use) if sane(matrix) else (np.inf, 0.0)
        return Registration(method, matrix, error, overlap)

    still = tried("identity", shift(0, 0))
    if still.error <= 1e-9:
        return still
    dx, dy, _ = phase_shift(source, target)
    cheap = [still, tried("phase", shift(dx, dy)), tried("phase", shift(round(dx), round(dy)))]
    best = min(cheap, key=lambda r: r.error)
    if best.error <= FAST_ERROR and best.overlap >= FAST_OVERLAP:
        return best
    for start in (best.matrix, shift(0, 0)):
        finer = tried("affine", refine(a, b, start, use))
        best = min(best, finer, key=lambda r: r.error)
        if best.error <= FINE_ERROR and best.overlap >= FAST_OVERLAP:
            break
    return best


def _box(image: np.ndarray, radius: int) -> np.ndarray:
    """Sums over a square around each pixel of the last two axes."""
    h, w = image.shape[-2:]
    edge = lambda n: np.clip(np.arange(-radius - 1, n + radius), 0, n - 1)
    c = np.cumsum(image.take(edge(h), axis=-2), axis=-2)
    c = np.cumsum((c[..., 2 * radius + 1 :, :] - c[..., :h, :]).take(edge(w), axis=-1), axis=-1)
    return c[..., 2 * radius + 1 :] - c[..., :w]


def flow(target: np.ndarray, source: np.ndarray, radius: int = 5, rounds: int = 4) -> np.ndarray:
    """(h, w, 2): for each pixel of the target how far away it stands in the source; least squares over windows, from coarse to fine."""
    pyramid = [(target.astype(float), source.astype(float))]
    while min(pyramid[-1][0].shape) >= 32 and len(pyramid) < 4:
        pyramid.append(tuple(halved(x) for x in pyramid[-1]))
    d = np.zeros((*pyramid[-1][0].shape, 2))
    for b, a in reversed(pyramid):
        if d.shape[:2] != b.shape:
            x, y = grid(b.shape)
            coarse = samples([d[..., 0], d[..., 1]], np.clip((x - 0.5) / 2, 0, d.shape[1] - 1), np.clip((y - 0.5) / 2, 0, d.shape[0] - 1))[0]
            d = 2 * np.stack(coarse, axis=-1)
        x, y = grid(b.shape)
        gy, gx = np.gradient(a)
        for _ in range(rounds):
            u, v = np.clip(x + d[..., 0], 0, b.shape[1] - 1), np.clip(y + d[..., 1], 0, b.shape[0] - 1)
            moved, ix, iy = samples([a, gx, gy], u, v)[0]
            e = b - moved
            xx, xy, yy, xe, ye = _box(np.stack([ix * ix, ix * iy, iy * iy, ix * e, iy * e]), radius)
            xx, yy = xx + 30.0, yy + 30.0  # flat windows stay where they are
            det = xx * yy - xy * xy
            step = np.stack([(yy * xe - xy * ye) / det, (xx * ye - xy * xe) / det], axis=-1)
            d = d + np.clip(step, -2, 2)
    return d


@dataclass(frozen=True)
class Aligned:
    image: np.ndarray
    mask: np.ndarray
    confidence: np.ndarray
    flow: np.ndarray
    local: bool


#: Lab of the 256 grays.
_GRAYS = lab(np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1))


def _laplacian(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def align(source: np.ndarray, target: np.ndarray, source_mask: np.ndarray, target_mask: np.ndarray, found: Registration | None = None, local: bool | None = None) -> Aligned:
    """The source in the target's place with a confidence for each pixel, 0 where the source is masked, missing or not to be trusted.

    Dense flow follows the registration only where the ring around the target's mask still differs, or ``local`` asks for it.
    """
    found = found or register(source, target, target_mask)
    x, y = grid(target.shape)
    m = found.matrix
    u, v = m[0, 0] * x + m[0, 1] * y + m[0, 2], m[1, 0] * x + m[1, 1] * y + m[1, 2]
    image, have = sample(source, u, v)
    covered = sample((source_mask > 0).astype(float), u, v)[0] > 0
    goal, on = gray(target).astype(float), target_mask > 0
    seen = gray(np.rint(image).astype(np.uint8)).astype(float)
    if local is None:
        ring = (dilate(on.astype(np.uint8), ellipse(max(3, round(min(target.shape[:2]) * 0.035)))) > 0) & ~on if on.any() else on
        fair = ring & have & ~covered
        if fair.sum() < 96:
            fair = have & ~covered & ~on
        left = float(np.median(np.abs(goal - seen)[fair]) / 255) if fair.sum() >= 96 else 1.0
        local = found.score < LOCAL_SCORE or left > LOCAL_ERROR
    d, back = np.zeros((*goal.shape, 2)), np.ones(goal.shape)
    if local and min(goal.shape) >= 12:
        d = flow(goal, seen)
        tx, ty = x + d[..., 0], y + d[..., 1]
        there = flow(seen, goal)
        (bx, by, image, hidden, whole), inside = samples([there[..., 0], there[..., 1], image, covered, have], tx, ty)
        miss = np.hypot(d[..., 0] + bx, d[..., 1] + by)
        covered = (hidden > 0) | ~inside
        have = (whole >= 1) & inside & (miss <= max(2 * RETURN_PX, 2.0))
        back = np.exp(-np.square(miss / RETURN_PX))
    plate = np.clip(np.rint(image), 0, 255).astype(np.uint8)
    color = lambda p: lab(p) if p.ndim == 3 else _GRAYS[p] if p.dtype == np.uint8 else lab(np.repeat(p[..., None], 3, 2))
    photo = np.exp(-np.square(np.abs(color(target) - color(plate)).mean(axis=2) / 255 / PHOTO_SCALE))
    one, other = _laplacian(goal), _laplacian(gray(plate).astype(float))
    maps = {
        "return": back, "photo": np.where(on, np.maximum(photo, PHOTO_FLOOR), photo),
        "gradient": np.exp(-np.square(np.abs(one - other) / (np.abs(one) + np.abs(other) + 12) / GRADIENT_SCALE)), "registration": np.full(goal.shape, found.score),
    }
    trust = sum(SHARES[k] * maps[k] for k in SHARES)
    trust = np.where(have & ~covered & (trust > LEAST_CONFIDENCE), np.clip(trust, 0, 1), 0.0)
    return Aligned(plate, np.where(covered, 255, 0).astype(np.uint8), trust, d, bool(local))


def changes(frames: list[np.ndarray], masks: list[np.ndarray]) -> np.ndarray:
    """(frames - 1, h, w): each frame's gray difference of 0 to 1 to the one before, aligned to it; 0 where that has no pixels."""
    nothing = np.zeros(masks[0].shape, np.uint8) if masks else np.zeros((0, 0), np.uint8)
    out = np.zeros((max(0, len(frames) - 1), *nothing.shape))
    for i, plane in enumerate(out):
        moved = align(frames[i], frames[i + 1], nothing, nothing)
        plane[...] = np.where(moved.mask == 0, np.abs(gray(moved.image).astype(float) - gray(frames[i + 1])) / 255, 0)
    return out


def flicker(frames: list[np.ndarray], masks: list[np.ndarray], ring: int = 8) -> tuple[float, float]:
    """(ratio, 95th percentile) of change inside masks, the ratio to the ring around them, as means over the frames with a mask; (0, 0) without any.

    A ring without pixels gives way to all that is unmasked, and where there is none either to 0.01.
    """
    with_mask = np.array([i for i, m in enumerate(masks[1:]) if (m > 0).any()], int)
    if not len(with_mask):
        return 0.0, 0.0
    d = changes(frames, masks)[with_mask]
    inside = np.stack([masks[i + 1] > 0 for i in with_mask])
    near = np.stack([dilate(x.astype(np.uint8), ellipse(ring)) > 0 for x in inside]) & ~inside
    near = np.where(near.any(axis=(1, 2), keepdims=True), near, ~inside)
    flat = lambda keep: np.where(keep, d, np.nan).reshape(len(d), -1)
    own = flat(inside)
    around = np.where(near.any(axis=(1, 2)), np.nanmedian(np.where(near.reshape(len(d), -1), flat(near), np.where(near.any(axis=(1, 2))[:, None], np.nan, 0.01)), axis=1), 0.01)
    return float((np.nanmedian(own, axis=1) / np.maximum(around, 1 / 255)).mean()), float(np.nanpercentile(own, 95, axis=1).mean())
