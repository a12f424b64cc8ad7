"""The detector as a query: packed images in, detections out.

Images travel packed and each is worked on where it is read: one Arrow map without a shuffle, so a cluster takes as many
images at once as it has cores. The relational stages in ``operators`` give the same intermediate tables where they are wanted.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schema
from ..config import DetectorConfig
from ..functions.geometry import polygons_overlap
from ..operators import quads as q
from ..operators.pixels import gaussian_kernel, kernel_size
from ..operators.regions import label
from ..sources.families import Family, family


def decimate(gray: np.ndarray, f: float) -> np.ndarray:
    if f == 1.5:
        h, w = gray.shape[0] // 3 * 3, gray.shape[1] // 3 * 3
        b = gray[:h, :w].astype(np.int64).reshape(h // 3, 3, w // 3, 3).transpose(0, 2, 1, 3)
        out = np.empty((h // 3, w // 3, 2, 2), np.int64)
        for dy in (0, 1):
            for dx in (0, 1):
                out[:, :, dy, dx] = (4 * b[:, :, 2 * dy, 2 * dx] + 2 * b[:, :, 2 * dy, 1] + 2 * b[:, :, 1, 2 * dx] + b[:, :, 1, 1]) // 9
        return out.transpose(0, 2, 1, 3).reshape(h // 3 * 2, w // 3 * 2).astype(np.uint8)
    return gray[:: int(f), :: int(f)]


def blur(gray: np.ndarray, sigma: float) -> np.ndarray:
    k = kernel_size(sigma)
    if k <= 1:
        return gray
    weights = gaussian_kernel(abs(sigma), k)
    out = gray.astype(np.int64)
    for axis in (1, 0):
        line = np.moveaxis(out, axis, 0)
        n = len(line)
        if n > k:
            new = line.copy()
            new[k // 2 : n - k + k // 2] = sum(c * line[j : j + n - k] for j, c in enumerate(weights)) >> 8
            out = np.moveaxis(new, 0, axis)
    soft = out.astype(np.uint8)
    return soft if sigma > 0 else np.clip(2 * gray.astype(np.int64) - soft, 0, 255).astype(np.uint8)


def threshold(gray: np.ndarray, min_diff: int, deglitch: bool = False) -> np.ndarray:
    h, w = gray.shape
    th, tw = h // 4, w // 4
    if not th or not tw:
        return np.full((h, w), 127, np.int32)
    tiles = gray[: th * 4, : tw * 4].astype(np.int32).reshape(th, 4, tw, 4)
    mn, mx = (np.pad(f(tiles, axis=(1, 3)), 1, mode="edge") for f in (np.min, np.max))
    mn = np.min([mn[dy : dy + th, dx : dx + tw] for dy in range(3) for dx in range(3)], axis=0)
    mx = np.max([mx[dy : dy + th, dx : dx + tw] for dy in range(3) for dx in range(3)], axis=0)
    ty, tx = np.minimum(np.arange(h) // 4, th - 1), np.minimum(np.arange(w) // 4, tw - 1)
    lo, hi = mn[ty][:, tx], mx[ty][:, tx]
    t = np.where(gray > lo + (hi - lo) // 2, 255, 0)
    full = (np.arange(h) < th * 4)[:, None] & (np.arange(w) < tw * 4)[None, :]
    t[(hi - lo < min_diff) & full] = 127
    if deglitch and h > 2 and w > 2:
        wide = np.zeros_like(t)
        wide[1:-1, 1:-1] = np.max([t[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        t[1:-1, 1:-1] = np.min([wide[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    return t.astype(np.int32)


def boundary(t: np.ndarray, min_size: int) -> dict[tuple[int, int], np.ndarray]:
    """Points (x, y, gx, gy; doubled) of each pair of touching components."""
    h, w = t.shape
    if h < 3 or w < 3:
        return {}
    rep = label(t)
    size = np.bincount(rep.ravel(), minlength=h * w)
    good = (t != 127) & (size[rep] >= min_size)
    rows = []
    left_gave = np.zeros((h, w), bool)
    yy, xx = np.mgrid[1 : h - 1, 1 : w - 1]
    for dx, dy in ((1, 1), (1, 0), (0, 1), (-1, 1)):
        v0, v1 = t[1 : h - 1, 1 : w - 1], t[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]
        hit = good[1 : h - 1, 1 : w - 1] & good[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx] & (v0 + v1 == 255)
        if (dx, dy) == (1, 1):
            left_gave[1 : h - 1, 2:w] = hit[:, : w - 2]
        elif (dx, dy) == (-1, 1):
            hit = hit & ~left_gave[1 : h - 1, 1 : w - 1]
        y, x = yy[hit], xx[hit]
        a, b, d = rep[y, x], rep[y + dy, x + dx], v1[hit] - v0[hit]
        rows.append(np.stack([np.minimum(a, b), np.maximum(a, b), 2 * x + dx, 2 * y + dy, dx * d, dy * d], axis=1))
    p = np.concatenate(rows)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    cut = np.flatnonzero((np.diff(p[:, :2], axis=0) != 0).any(1)) + 1
    return {(int(g[0, 0]), int(g[0, 1])): g[:, 2:] for g in np.split(p, cut) if len(g)}


def find_quads(gray: np.ndarray, fams: list[Family], cfg: DetectorConfig) -> list[tuple[np.ndarray, bool]]:
    """Candidate quads of the decimated, filtered image, in the decimated image's coordinates."""
    width = max(3, int(min(f.width_at_border for f in fams) / max(cfg.quad_decimate, 1)))
    polarities = (any(not f.reversed_border for f in fams), any(f.reversed_border for f in fams))
    t = threshold(gray, cfg.min_white_black_diff, cfg.deglitch)
    out = []
    for _, g in sorted(boundary(t, cfg.min_component).items()):
        found = q.fit_quad(*g.T, gray, width, polarities, cfg)
        if found:
            out.append(found)
    return out


def rotate_code(code: int, nbits: int) -> int:
    odd = nbits % 4
    p = nbits - odd
    w = code >> odd
    turned = ((w << (p // 4)) | (w >> (3 * p // 4))) & ((1 << p) - 1)
    return turned << 1 | code & 1 if odd else turned


def _plane(xy: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    if len(v) < 3:
        return None
    return np.linalg.lstsq(np.column_stack([xy, np.ones(len(v))]), v, rcond=None)[0]


def decode(h: np.ndarray, gray: np.ndarray, fam: Family, cfg: DetectorConfig) -> tuple[int, int, int, float] | None:
    """(id, hamming, rotation, margin) of a quad, or None."""
    n = fam.width_at_border
    i = np.arange(n)
    models = {}
    for white, d in ((True, -0.5), (False, 0.5)):
        near, far, along = np.full(n, d), np.full(n, n - d), i + 0.5
        u = 2 * (np.concatenate((near, far, along, along)) / n - 0.5)
        v = 2 * (np.concatenate((along, along, near, far)) / n - 0.5)
        px, py = (np.trunc(c).astype(np.int64) for c in q.project(h, u, v))
        ok = (px >= 0) & (py >= 0) & (px < gray.shape[1]) & (py < gray.shape[0])
        models[white] = _plane(np.column_stack([u, v])[ok], gray[py[ok], px[ok]].astype(float))
    if models[True] is None or models[False] is None:
        return None
    if (models[True][2] - models[False][2] < 0) != fam.reversed_border:
        return None
    bx, by = np.array(fam.bits).T
    u, v = 2 * ((bx + 0.5) / n - 0.5), 2 * ((by + 0.5) / n - 0.5)
    value = q.bilinear(gray, *q.project(h, u, v))
    mid = sum(m[0] * u + m[1] * v + m[2] for m in models.values()) / 2
    grid = np.zeros((fam.total_width + 2, fam.total_width + 2))
    off = 1 - (n - fam.total_width) // 2
    grid[by + off, bx + off] = np.where(np.isnan(value), 0, value - mid)
    sharp = grid[1:-1, 1:-1] + cfg.decode_sharpening * (4 * grid[1:-1, 1:-1] - grid[:-2, 1:-1] - grid[2:, 1:-1] - grid[1:-1, :-2] - grid[1:-1, 2:])
    bit = sharp[by + off - 1, bx + off - 1]
    code = int("".join("1" if b > 0 else "0" for b in bit), 2)
    white, black = bit[bit > 0], -bit[bit <= 0]
    margin = min(white.sum() / (1 + len(white)), black.sum() / (1 + len(black)))
    codes = np.array(fam.codes, np.int64)
    for r in range(4):
        wrong = np.bitwise_count(codes ^ code)
        k = np.flatnonzero(wrong <= cfg.max_hamming)
        if len(k):
            return int(k[0]), int(wrong[k[0]]), r, float(np.float32(margin))
        code = rotate_code(code, fam.nbits)
    return None


def reconcile(found: list[dict]) -> list[dict]:
    """Of overlapping detections of one identity keep the better: fewer wrong bits, larger margin, then smaller corners.

    Detections are taken in a fixed order; each meets those kept before it, and a loser goes out.
    """
    kept: list[dict] = []
    for d in sorted(found, key=lambda d: (d["family"], d["id"], d["corners"])):
        rivals = [k for k in kept if k["family"] == d["family"] and k["id"] == d["id"] and polygons_overlap(np.array(k["corners"]), np.array(d["corners"]))]
        rank = lambda k: (k["hamming"], -k["decision_margin"], k["corners"])
        if all(rank(d) < rank(r) for r in rivals):
            kept = [k for k in kept if not any(k is r for r in rivals)] + [d]
    return kept


#: The steps of one image that ``stamp`` is told of, in their order.
STEPS = ("init", "decimate", "blur", "quads", "decode and refinement", "reconcile")


def detect_image(gray: np.ndarray, cfg: DetectorConfig, fams: list[Family], stamp: Callable[[str], None] = lambda name: None) -> list[dict]:
    """All markers in one gray image (uint8, h x w); ``stamp`` is called at the end of each of ``STEPS``."""
    stamp("init")
    if not fams or min(gray.shape) < 4:
        return []
    f = cfg.quad_decimate
    small = decimate(gray, f) if f > 1 else gray
    stamp("decimate")
    small = blur(small, cfg.quad_sigma) if cfg.quad_sigma else small
    stamp("blur")
    found = find_quads(small, fams, cfg)
    stamp("quads")
    out = []
    for p, rev in found:
        p = (p * np.float32(f) if f > 1 else p).astype(float)
        if cfg.refine_edges:
            p = q.refine_edges(p, rev, gray, cfg)
        h = q.homography(p)
        if h is None:
            continue
        for fam in fams:
            if fam.reversed_border != rev:
                continue
            got = decode(h, gray, fam, cfg)
            if got is None or got[3] < 0:
                continue
            i, hamming, r, margin = got
            c, s = (1, 0, -1, 0)[r], (0, 1, 0, -1)[r]
            turned = h @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]])
            cx, cy = (float(v) for v in q.project(turned, 0, 0))
            corners = [tuple(float(v) for v in q.project(turned, x, y)) for x, y in ((-1, 1), (1, 1), (1, -1), (-1, -1))]
            out.append({"family": fam.name, "id": i, "hamming": hamming, "decision_margin": margin, "h": turned.ravel().tolist(), "cx": cx, "cy": cy, "corners": corners})
    stamp("decode and refinement")
    out = sorted(reconcile(out), key=lambda d: (d["id"], d["family"], d["corners"]))
    stamp("reconcile")
    return out


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_ARROW = pa.schema([("image_id", pa.string()), ("family", pa.string()), ("id", pa.int32()), ("hamming", pa.int32()), ("decision_margin", pa.float32()), ("h", pa.list_(pa.float64())), ("cx", pa.float64()), ("cy", pa.float64()), ("corners", pa.list_(_POINT))])


def detect(images: DataFrame, cfg: DetectorConfig | None = None) -> DataFrame:
    """Detections of packed gray images (image_id, width, height, data); images that failed to decode (null data) give none."""
    cfg = cfg or DetectorConfig()
    fams = [family(n) for n in cfg.families]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["data"] is None or not r["width"] or not r["height"]:
                    continue
                gray = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"])
                rows += [{"image_id": r["image_id"], **d, "corners": [{"x": x, "y": y} for x, y in d["corners"]]} for d in detect_image(gray, cfg, fams)]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return images.select("image_id", "width", "height", "data").mapInArrow(run, schema.DETECTIONS)


_STAMPS = pa.schema([("image_id", pa.string()), ("seq", pa.int32()), ("name", pa.string()), ("utime", pa.int64())])


def stage_stamps(images: DataFrame, cfg: DetectorConfig | None = None) -> DataFrame:
    """(image_id, seq, name, utime): when each step of each image's detection ended, in microseconds; ``compare.stage_deltas`` gives the durations."""
    cfg = cfg or DetectorConfig()
    fams = [family(n) for n in cfg.families]

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for r in batch.to_pylist():
                if r["data"] is None or not r["width"] or not r["height"]:
                    continue
                names: list[tuple[str, int]] = []
                detect_image(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]), cfg, fams, lambda name: names.append((name, time.time_ns() // 1000)))
                rows += [{"image_id": r["image_id"], "seq": k, "name": name, "utime": at} for k, (name, at) in enumerate(names)]
            yield pa.RecordBatch.from_pylist(rows, schema=_STAMPS)

    return images.select("image_id", "width", "height", "data").mapInArrow(run, "image_id string, seq int, name string, utime bigint")


class Detector:
    """The keyword facade: ``Detector('tag16h5', maxhamming=1).detect(images)``."""

    def __init__(self, family: str, threads: int = 1, maxhamming: int = 1, decimate: float = 2.0, blur: float = 0.0, refine_edges: bool = True, debug: bool = False):
        from ..sources.families import family as known

        known(family)  # an unknown name lists the known ones
        self.debug, self.stamps = debug, []  # with debug, the steps of the last array and their seconds; threads are Spark's own
        self.config = DetectorConfig(families=(family,), max_hamming=maxhamming, quad_decimate=decimate, quad_sigma=blur, refine_edges=refine_edges)

    def detect(self, images):
        """A DataFrame of packed images gives a DataFrame; one uint8 array gives a list of dicts."""
        if isinstance(images, DataFrame):
            return detect(images, self.config)
        a = np.asarray(images)
        if a.ndim != 2:
            raise ValueError(f"the image must have 2 dimensions, not {a.ndim}")
        if a.dtype != np.uint8:
            raise ValueError(f"the image must hold uint8, not {a.dtype}")
        if a.size and a.strides[1] != 1:
            raise ValueError("the image's rows must be contiguous")
        at = [("", time.perf_counter())]
        found = detect_image(a, self.config, [family(n) for n in self.config.families], (lambda name: at.append((name, time.perf_counter()))) if self.debug else lambda name: None)
        self.stamps = [(name, t - before) for (_, before), (name, t) in zip(at, at[1:])]
        return [{"hamming": d["hamming"], "margin": d["decision_margin"], "id": d["id"], "center": (d["cx"], d["cy"]), "lb-rb-rt-lt": d["corners"]} for d in found]
