"""Point-target echoes as DataFrames of lines, made in parallel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.operators.lines import map_lines
from rastrum.sources.params import RadarParams

#: range offset (m), azimuth offset (m), amplitude
Target = tuple[float, float, float]


def demo_scene(n: int, p: RadarParams) -> list[Target]:
    swath, strip = n * p.c / (2 * p.fs), n * p.vr / p.prf
    return [(0.0, 0.0, 1.0), (-0.15 * swath, -0.2 * strip, 0.8), (0.2 * swath, 0.15 * strip, 1.2)]


def target_pixel(n: int, p: RadarParams, target: Target) -> tuple[float, float]:
    """(row, column) where a target focuses."""
    return n / 2 + target[1] * p.prf / p.vr, p.t_shift * p.fs + target[0] * 2 * p.fs / p.c


def _rows(spark: SparkSession, n: int, parts: int) -> DataFrame:
    zero = F.array(F.lit(0.0))
    return spark.range(0, n, 1, parts).select(F.col("id").alias("row"), zero.alias("re"), zero.alias("im"))


def stripmap_echo(spark: SparkSession, n: int, p: RadarParams, targets: Sequence[Target], parts: int = 8) -> DataFrame:
    """n pulses of n samples: a chirp from each target along its range history."""
    tau = p.fast_time(n)

    def run(rows: np.ndarray, _: np.ndarray) -> np.ndarray:
        eta = (rows[:, None] - n / 2) / p.prf
        out = np.zeros((len(rows), n), complex)
        for dr, da, amplitude in targets:
            distance = np.hypot(p.r0 + dr, p.vr * (eta - da / p.vr))
            t = tau - 2 * distance / p.c
            phase = np.pi * p.kr * t**2 - 4 * np.pi * p.fc / p.c * distance
            out += amplitude * (np.abs(t) <= p.pulse_len / 2) * np.exp(1j * phase)
        return out

    return map_lines(_rows(spark, n, parts), run)


# Fixed value: tangent of half the aperture of the spotlight collection.
TAN_HALF_APERTURE = 0.115


class Geometry:
    """A polar collection that covers an n x n grid of wavenumbers."""

    def __init__(self, n: int):
        step = 2 * np.pi / n
        self.n = n
        self.u = step * (np.arange(n) - n / 2)
        self.v = step * (n / 2 / TAN_HALF_APERTURE + np.arange(n))
        edge = 1.02 * np.arctan(TAN_HALF_APERTURE)
        self.theta = np.linspace(-edge, edge, n)
        self.k = np.linspace(0.999 * self.v[0], 1.001 * self.v[-1] / np.cos(edge), n)

    def demo_targets(self) -> list[tuple[float, float]]:
        return [(0.0, 0.0), (-0.2 * self.n, 0.15 * self.n), (0.25 * self.n, -0.1 * self.n)]

    def echo(self, spark: SparkSession, targets: Sequence[tuple[float, float]], parts: int = 8) -> DataFrame:
        """Phase history of unit scatterers at (x, y) pixels from the middle."""
        theta, k = self.theta, self.k

        def run(rows: np.ndarray, _: np.ndarray) -> np.ndarray:
            a = theta[rows][:, None]
            return sum(np.exp(-1j * k * (np.cos(a) * x + np.sin(a) * y)) for x, y in targets)

        return map_lines(_rows(spark, self.n, parts), run)
