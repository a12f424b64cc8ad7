"""Pose of a planar square marker from its homography: orthogonal iteration from two starts.

A plane seen in perspective has up to two minima. The second start is the first pose with the plane's normal mirrored at the
viewing ray; it counts as another minimum if its iteration ends over 0.1 rad away.
"""

from __future__ import annotations

import numpy as np


def from_homography(h: np.ndarray, fx: float, fy: float, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest rotation and translation of a homography, the marker in front of the camera."""
    m = np.linalg.inv(np.array([[fx, 0, cx], [0, fy, cy], [0, 0, 1.0]])) @ h
    k = 1 / np.sqrt(np.linalg.norm(m[:, 0]) * np.linalg.norm(m[:, 1]))
    m = m * (k if m[2, 2] > 0 else -k)
    r = np.column_stack([m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1])])
    return nearest_rotation(r), m[:, 2]


def nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, v = np.linalg.svd(m)
    r = u @ v
    if np.linalg.det(r) < 0:
        r[:, 2] = -r[:, 2]
    return r


def orthogonal_iteration(rays: np.ndarray, points: np.ndarray, r: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation, translation and object-space error of points (n x 3) seen along rays (n x 3)."""
    f = rays[:, :, None] * rays[:, None, :] / (rays**2).sum(1)[:, None, None]
    eye = np.eye(3)
    inverse = np.linalg.inv(eye - f.mean(0))
    centred = points - points.mean(0)

    def translation(r):
        return inverse @ np.einsum("nij,nj->ni", f - eye, points @ r.T).mean(0)

    t = translation(r)
    for _ in range(steps):
        q = np.einsum("nij,nj->ni", f, points @ r.T + t)
        r = nearest_rotation((q - q.mean(0)).T @ centred)
        t = translation(r)
    gap = np.einsum("nij,nj->ni", eye - f, points @ r.T + t)
    return r, t, float((gap**2).sum())


def other_start(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The rotation whose plane normal is mirrored at the viewing ray."""
    ray = t / np.linalg.norm(t)
    n = r[:, 2]
    mirrored = 2 * (ray @ n) * ray - n
    axis = np.cross(n, mirrored)
    s, c = np.linalg.norm(axis), n @ mirrored
    if s < 1e-9:
        return r
    axis = axis / s
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return (np.eye(3) + s * k + (1 - c) * k @ k) @ r


def angle(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.arccos(np.clip((np.trace(a.T @ b) - 1) / 2, -1, 1)))


def both(h: np.ndarray, tag_size: float, fx: float, fy: float, cx: float, cy: float, steps: int = 50):
    """The two poses (r, t, err); the second is None where there is one minimum."""
    s = tag_size / 2
    tag = np.array([[-1, 1], [1, 1], [1, -1], [-1, -1]], float)
    z = tag @ h[2, :2] + h[2, 2]
    px, py = (tag @ h[0, :2] + h[0, 2]) / z, (tag @ h[1, :2] + h[1, 2]) / z
    rays = np.column_stack([(px - cx) / fx, (py - cy) / fy, np.ones(4)])
    points = np.column_stack([tag * s, np.zeros(4)])
    r0, _ = from_homography(h, fx, fy, cx, cy)
    first = orthogonal_iteration(rays, points, r0, steps)
    second = orthogonal_iteration(rays, points, other_start(first[0], first[1]), steps)
    return first, second if angle(first[0], second[0]) > 0.1 else None


def estimate(h: np.ndarray, tag_size: float, fx: float, fy: float, cx: float, cy: float) -> tuple[np.ndarray, np.ndarray, float]:
    a, b = both(h, tag_size, fx, fy, cx, cy)
    return b if b is not None and b[2] < a[2] else a
