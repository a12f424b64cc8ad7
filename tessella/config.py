"""Detector parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class DetectorConfig:
    """Defaults of the library entry point; the keyword facade in ``plans.detect`` has its own."""

    families: tuple[str, ...] = ("tag16h5",)
    max_hamming: int = 2
    quad_decimate: float = 2.0
    quad_sigma: float = 0.0
    refine_edges: bool = True
    decode_sharpening: float = 0.25
    max_nmaxima: int = 10
    min_cluster_pixels: int = 5
    max_line_fit_mse: float = 10.0
    cos_critical_rad: float = math.cos(math.radians(10))
    deglitch: bool = False
    min_white_black_diff: int = 5
    min_component: int = 25

    def __post_init__(self):
        if self.max_hamming > 3:
            raise ValueError("max_hamming must be at most 3")
        f = self.quad_decimate
        if f > 1 and f != 1.5 and f != int(f):
            raise ValueError("quad_decimate must be 1.5 or a whole number")
