import numpy as np
import pytest

from tessella.config import DetectorConfig
from tessella.functions import linalg
from tessella.functions.geometry import convex_hull, polygons_overlap
from tessella.functions.pose import estimate
from tessella.operators import quads
from tessella.operators.compare import report_diff
from tessella.operators.regions import label
from tessella.plans.detect import Detector, detect, detect_image, reconcile, rotate_code
from tessella.sources import codecs, readers, synthetic
from tessella.sources.families import family, register_codes

SMALL = ("tag16h5", "tag25h9", "tagCircle21h7")


@pytest.mark.parametrize("name", SMALL)
@pytest.mark.parametrize("decimate", [1.0, 1.5, 2.0])
def test_every_turn(name, decimate):
    f, cfg = family(name), DetectorConfig(families=(name,), quad_decimate=decimate, max_hamming=1)
    for i in range(0, len(f.codes), 7):
        centres = set()
        for r in range(4):
            found = detect_image(synthetic.scene(f, i, 12, 36, r), cfg, [f])
            assert [(d["id"], d["hamming"]) for d in found] == [(i, 0)]
            centres.add((round(found[0]["cx"]), round(found[0]["cy"])))
        assert len(centres) == 1


def warp(im, h, size):
    y, x = np.mgrid[0:size, 0:size] + 0.5
    u, v = quads.project(np.linalg.inv(h), x, y)
    out = np.full((size, size), 200, np.uint8)
    ok = (u >= 0) & (v >= 0) & (u < im.shape[1]) & (v < im.shape[0])
    out[ok] = im[v[ok].astype(int), u[ok].astype(int)]
    return out


def test_projective_scene_and_pose():
    f = family("tag25h9")
    im = synthetic.scene(f, 5, 20, 40)
    n = im.shape[0]
    # a camera of 400 px focal length sees the marker (0.1 m, 140 px here) turned about all axes
    turn = linalg.quat_to_matrix(linalg.rpy_to_quat(0.35, -0.3, 0.2))
    camera, unit = np.array([[400, 0, 190], [0, 400, 190], [0, 0, 1.0]]), 0.1 / 140
    h = camera @ np.column_stack([turn[:, 0], turn[:, 1], [0.01, -0.005, 0.25]]) @ np.array([[unit, 0, -unit * n / 2], [0, unit, -unit * n / 2], [0, 0, 1]])
    found = detect_image(warp(im, h, 380), DetectorConfig(families=("tag25h9",), quad_decimate=1.0), [f])
    assert [d["id"] for d in found] == [5]
    a, b = 40 + 20, n - 60
    want = np.array(quads.project(h, [a, b, b, a], [a, a, b, b])).T
    got = np.array(found[0]["corners"])
    assert max(np.min(np.hypot(*(want - c).T)) for c in got) < 0.7
    r, t, err = estimate(np.array(found[0]["h"]).reshape(3, 3), 0.1, 400, 400, 190, 190)
    assert np.allclose(r @ r.T, np.eye(3), atol=1e-9) and np.isclose(np.linalg.det(r), 1) and t[2] > 0
    p = np.array([[-1, 1], [1, 1], [1, -1], [-1, -1]]) * 0.05 @ r[:, :2].T + t
    assert np.abs(400 * p[:, :2] / p[:, 2:] + 190 - got).max() < 1 and err < 1e-5
    assert np.allclose(t, [0.01, -0.005, 0.25], atol=0.005) and abs(abs(r[:, 2] @ turn[:, 2]) - 1) < 0.01


def test_wrong_bits_are_corrected():
    f = family("tag25h9")
    im = synthetic.marker(f, 3)
    for x, y in f.bits[2:4]:
        im[y + 1, x + 1] ^= 255
    big = np.pad(np.kron(im, np.ones((12, 12), np.uint8)), 36, constant_values=200)
    for k, want in ((2, [(3, 2)]), (1, [])):
        assert [(d["id"], d["hamming"]) for d in detect_image(big, DetectorConfig(families=("tag25h9",), quad_decimate=1.0, max_hamming=k), [f])] == want


def test_four_turns_give_the_code_again():
    for name in SMALL:
        f = family(name)
        for c in f.codes:
            t = c
            for _ in range(4):
                t = rotate_code(t, f.nbits)
            assert t == c


def test_labels_white_diagonals_only():
    for value, parts in ((255, 1), (0, 6)):
        t = np.full((8, 8), 127, np.int32)
        for i in range(1, 7):
            t[i, i] = value
        assert len(set(label(t)[t != 127].tolist())) == parts


def test_reconcile_keeps_the_better_of_overlapping():
    square = lambda o: [(o, o), (o + 10.0, o), (o + 10.0, o + 10), (o, o + 10)]
    row = lambda o, k, m: {"family": "f", "id": 1, "hamming": k, "decision_margin": m, "corners": square(o)}
    assert reconcile([row(0.0, 1, 9.0), row(2.0, 0, 5.0)]) == [row(2.0, 0, 5.0)]
    assert len(reconcile([row(0.0, 0, 9.0), row(50.0, 0, 5.0)])) == 2


def test_frames(spark):
    images = synthetic.scenes(spark, "tag16h5")
    found = detect(images, DetectorConfig(families=("tag16h5",)))
    assert found.count() == 120
    assert report_diff(found, found).where("status <> 'same'").count() == 0
    assert Detector("tag16h5").detect(synthetic.scene(family("tag16h5"), 4))[0]["id"] == 4
    with pytest.raises(ValueError):
        Detector("tag16h5", maxhamming=4)
    with pytest.raises(ValueError, match="unrecognized"):
        Detector("nothing")
    with pytest.raises(ValueError):
        Detector("tag16h5").detect(np.zeros((2, 2), float))


def test_registered_codes(tmp_path, monkeypatch):
    monkeypatch.setattr("tessella.sources.families._registered", {})
    with pytest.raises(ValueError):
        family("tag36h10")
    (tmp_path / "codes").write_text("d5d628584\nd97f18b49\n")
    register_codes("tag36h10", str(tmp_path / "codes"))
    assert len(family("tag36h10").codes) == 2


def test_formats_round_trip():
    r = np.random.default_rng(1)
    gray, rgb = r.integers(0, 256, (13, 17), dtype=np.uint8), r.integers(0, 256, (9, 5, 3), dtype=np.uint8)
    for a in (gray, rgb):
        assert (codecs.decode_pnm(codecs.encode_pnm(a)) == a).all()
        assert (codecs.decode_pam(codecs.encode_pam(a)) == a).all()
        assert (codecs.decode_png(codecs.encode_png(a)) == a).all()
        assert (codecs.decode_npy(codecs.encode_npy(a)) == a).all()
    assert (codecs.decode_tmp(codecs.encode_tmp(gray))[0, 0] == gray).all()
    assert (codecs.decode_pnm(b"P4\n# c\n3 2\n\xa0\x40") == [[0, 255, 0], [255, 0, 255]]).all()
    for bad in (b"", b"P5\n3 3\n255\n\x00", b"P6"):
        with pytest.raises(codecs.FormatError):
            codecs.decode_pnm(bad)


def test_files_and_stream(spark, tmp_path):
    from tessella.streaming import detect_stream, image_stream

    (tmp_path / "in").mkdir()
    f = family("tag16h5")
    for i in range(3):
        (tmp_path / "in" / f"{i}.png").write_bytes(codecs.encode_png(synthetic.scene(f, i)))
    (tmp_path / "in" / "bad.png").write_bytes(b"no image")
    images = readers.read_images(spark, str(tmp_path / "in"))
    assert readers.rejects(images).count() == 1 and images.count() == 4
    (tmp_path / "out").mkdir()
    readers.write_images(images, str(tmp_path / "out"), "pgm")
    assert len(list((tmp_path / "out").glob("*.pgm"))) == 3
    seen = []
    query = detect_stream(image_stream(spark, str(tmp_path / "in")), DetectorConfig(), lambda d, i: seen.extend(r.id for r in d.collect()), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [0, 1, 2]


def test_matrices():
    a, b = np.array([[2.0, 1], [1, 3]]), np.array([[1.0, 2], [3, 4]])
    assert np.allclose(linalg.evaluate("M*M'+2(M-M)^-1", a, b, a, b), a @ b.T + 2 * np.linalg.inv(a - b))
    p, low, up = linalg.plu(b)
    assert np.allclose(p @ low @ up, b) and linalg.inverse(np.ones((2, 2))) is None
    u = linalg.cholesky(a)
    assert np.allclose(linalg.cholesky_solve(u, np.array([1.0, 2])), np.linalg.solve(a, [1, 2]))
    x, s, v = linalg.svd(b)
    assert np.allclose(x @ s @ v.T, b)
    q = linalg.rpy_to_quat(0.1, 0.2, 0.3)
    assert np.allclose(linalg.quat_to_rpy(q), [0.1, 0.2, 0.3]) and np.allclose(linalg.quat_from_matrix(linalg.quat_to_matrix(q)), q)


def test_polygons():
    a, c, d = (np.array(p, float) for p in ([(0, 0), (4, 0), (2, 2), (1, 2), (1, 5), (-2, 4)], [(3, 0), (5, 0), (5, 1)], [(5, 5), (6, 6), (5, 6)]))
    assert polygons_overlap(a, c) and not polygons_overlap(a, d)
    assert len(convex_hull(np.array([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2), (1, 1)]))) == 4
