import numpy as np
import pytest

from tessera.plans import repair as r


@pytest.fixture(scope="module")
def done(spark):
    clip = r.synthetic(spark, frames=8).persist()
    out = r.run(clip.drop("clean", "truth"), r.Options(160, 90, chunk_frames=4, max_attempts=2))
    return out, out["frames"].join(clip.select("job_id", "frame_index", "clean", "truth"), ["job_id", "frame_index"]).collect()


def plane(row, name, *shape):
    return np.frombuffer(row[name], np.uint8).reshape(row.height, row.width, *shape).astype(int)


def test_every_frame_once_in_order(done):
    assert sorted(x.frame_index for x in done[1]) == list(range(8))


def test_outside_masks_nothing_changes(done):
    for x in done[1]:
        off = plane(x, "mask") == 0
        assert (plane(x, "pixels", 3)[off] == plane(x, "output", 3)[off]).all()


def test_text_is_covered_and_mostly_recovered(done):
    for x in done[1]:
        truth = plane(x, "truth") > 0
        assert (plane(x, "mask")[truth] > 0).mean() > 0.6
        error = lambda n: np.abs(plane(x, n, 3) - plane(x, "clean", 3))[truth].mean()
        assert error("output") < 0.6 * error("pixels")


def test_attempts_end(done):
    attempts = done[0]["attempts"].collect()
    assert {(x.chunk, x.attempt) for x in attempts} >= {(0, 0), (1, 0)} and all(x.attempt < 2 for x in attempts)
    assert done[0]["best"].count() == 2
