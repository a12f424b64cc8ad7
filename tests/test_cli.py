"""The command line, polynomials and stage times."""

import time

import numpy as np

from tessella.__main__ import main
from tessella.functions import polynomial
from tessella.plans import detect as plan
from tessella.sources import readers, synthetic


def test_jobs(spark, tmp_path, capsys):
    scenes = synthetic.scenes(spark, "tag16h5", 10, 30).where("image_id in ('tag16h5-3-0', 'tag16h5-7-2')")
    readers.write_images(scenes, str(tmp_path), "png")
    (tmp_path / "broken.png").write_bytes(b"nothing")
    assert main(["detect", str(tmp_path), "-x", "1", "-d"], spark) == 0
    out, err = capsys.readouterr()
    assert "tag16h5 3, 0 wrong bits" in out and "tag16h5 7, 0 wrong bits" in out and "markers 2, by wrong bits [2, 0]" in out
    assert "broken.png" in err and all(f"{name}: " in out for name in plan.STEPS)
    assert main(["time", str(tmp_path), "-x", "1", "-q", "-i", "2"], spark) == 0
    out, _ = capsys.readouterr()
    assert out.count("markers 2") == 2 and "2 runs, mean" in out and "tag16h5 3" not in out


def test_polynomials():
    assert np.allclose(polynomial.roots([6, -5, 1]), [2, 3])
    assert polynomial.roots([1, 0, 1]) == [] and polynomial.roots([5]) == [] and polynomial.roots([-1e9, 1]) == []
    assert np.allclose(polynomial.roots([1, -2, 1]), [1])
    assert np.allclose(polynomial.roots(np.polynomial.polynomial.polyfromroots([-3, -1, 0.5, 2, 7])), [-3, -1, 0.5, 2, 7])


def test_debug_times():
    d = plan.Detector("tag16h5", debug=True)
    d.detect(np.zeros((40, 40), np.uint8))
    assert [name for name, _ in d.stamps] == list(plan.STEPS) and all(t >= 0 for _, t in d.stamps)


def test_roots_of_many_polynomials():
    """All rows at once give what each has, whatever its degree, in time that does not grow by a Python loop for each number."""
    rng = np.random.default_rng(4)
    made = [np.sort(rng.choice(np.arange(-40, 41) / 4, n, replace=False)) for n in (1, 2, 3, 4) for _ in range(2000)]
    p = np.zeros((len(made), 6))
    for row, r in zip(p, made):
        row[: len(r) + 1] = np.polynomial.polynomial.polyfromroots(r)
    began = time.process_time()
    found = polynomial.roots_of(p)
    assert time.process_time() - began < 5
    assert all(len(f) == len(r) and np.allclose(f, r, atol=1e-6) for f, r in zip(found, made))
    assert polynomial.roots_of(np.array([[0.0, 0, 0], [0, 0, 1], [-1, 0, 1], [5, 0, 0], [np.nan, 1, 0]]))[:4] == [[], [0.0], [-1.0, 1.0], []]
