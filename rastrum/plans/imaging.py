"""Imaging chains over lines: raw echoes in, image lines out.

A chain is a few passes over whole lines with corner turns between them; what
depends on axes and parameters only is a driver-side vector in the pass.
Every chain ends row-major.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from rastrum.operators.lines import corner_turn, interpolate, map_lines
from rastrum.raster import stolt_block
from rastrum.sources.params import RadarParams, band_windows
from rastrum.sources.simulate import Geometry

PI = np.pi


def _centred_fft(x: np.ndarray) -> np.ndarray:
    return np.fft.fftshift(np.fft.fft(x, axis=1), axes=1)


def _centred_ifft(x: np.ndarray) -> np.ndarray:
    return np.fft.ifft(np.fft.ifftshift(x, axes=1), axis=1)


def omega_k(raw: DataFrame, n: int, p: RadarParams) -> DataFrame:
    """Wavenumber-domain focusing: bulk compression, then a straight wavenumber grid."""
    fa, fr = p.doppler(n), p.range_frequency(n)
    win_r, win_a = band_windows(n, p)

    def focus(rows, x):
        f = fa[rows][:, None]
        root = np.sqrt(np.maximum((p.fc + fr) ** 2 - (p.c * f / (2 * p.vr)) ** 2, 1e-10))
        bulk = 4 * PI * p.r0 / p.c * (root - (p.fc + fr)) + PI * fr**2 / p.kr
        y = stolt_block(x * np.exp(1j * bulk), fa[rows], fr, p.c, p.fc, p.vr, p.t_shift)
        return _centred_ifft(y * win_r * win_a[rows][:, None])

    spectrum = corner_turn(map_lines(raw, lambda rows, x: _centred_fft(x)))
    spectrum = corner_turn(map_lines(spectrum, lambda rows, x: _centred_fft(x)))
    turned = corner_turn(map_lines(spectrum, focus))
    return corner_turn(map_lines(turned, lambda rows, x: np.abs(_centred_ifft(x))))


def range_doppler(raw: DataFrame, n: int, p: RadarParams) -> DataFrame:
    """Range compression, migration correction by interpolation, azimuth compression."""
    fa, tau, lam = p.doppler(n), p.fast_time(n), p.wavelength
    win_r, win_a = band_windows(n, p)
    reference = np.conj(np.fft.fft(np.roll(p.chirp_replica(n), -(n // 2)))) * np.fft.ifftshift(win_r)

    def straighten(rows, x):
        f2 = fa[rows][:, None] ** 2
        y = interpolate(x, np.arange(n) + lam**2 * p.fs / (8 * p.vr**2) * f2 * tau)
        return y * np.exp(-1j * PI * lam * p.c / (4 * p.vr**2) * f2 * tau) * win_a[rows][:, None]

    compressed = map_lines(raw, lambda rows, x: np.fft.ifft(np.fft.fft(x, axis=1) * reference, axis=1))
    doppler = corner_turn(map_lines(corner_turn(compressed), lambda rows, x: _centred_fft(x)))
    turned = corner_turn(map_lines(doppler, straighten))
    return corner_turn(map_lines(turned, lambda rows, x: np.abs(_centred_ifft(x))))


def chirp_scaling(raw: DataFrame, n: int, p: RadarParams) -> DataFrame:
    """Migration equalised by a phase before range compression; no interpolation."""
    fa, fr, tau, lam = p.doppler(n), p.range_frequency(n), p.fast_time(n), p.wavelength
    win_r, win_a = band_windows(n, p)

    def scale(rows, x):
        f = fa[rows][:, None]
        d = np.sqrt(np.maximum(1 - (f * lam / (2 * p.vr)) ** 2, 1e-10))
        km = p.kr / (1 - p.kr * p.c * p.r0 / (2 * p.vr**2 * p.fc**3) * f**2 / d**3)
        x = x * np.exp(1j * PI * km * (1 / d - 1) * (tau - 2 * p.r0 / p.c / d) ** 2)
        x = _centred_fft(x) * np.exp(1j * (PI * fr**2 * d / km + (1 / d - 1) * fr * 4 * PI * p.r0 / p.c)) * win_r
        return _centred_ifft(x) * np.exp(1j * tau * (d - 1) * (4 * PI * p.fc / p.c) * p.c / 2) * win_a[rows][:, None]

    doppler = corner_turn(map_lines(corner_turn(raw), lambda rows, x: _centred_fft(x)))
    turned = corner_turn(map_lines(doppler, scale))
    return corner_turn(map_lines(turned, lambda rows, x: np.abs(_centred_ifft(x))))


def sva(x: np.ndarray) -> np.ndarray:
    """Spatially variant apodisation along lines; two samples at each end pass."""
    out = np.array(x, float)
    c, q = x[:, 2:-2], x[:, :-4] + x[:, 4:]
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(q == 0, 0.0, -c / q)
    out[:, 2:-2] = np.where(a <= 0, c, np.where(a >= 0.5, c + 0.5 * q, 0.0))
    return out


def _sva_parts(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sva(x.real) + 1j * sva(x.imag)


def polar_format(history: DataFrame, g: Geometry, apodise: bool = True) -> DataFrame:
    """Polar to rectangular wavenumbers, then a padded inverse transform; 2n x 2n."""
    n = g.n
    padded = lambda x: _centred_shifted(np.pad(x, ((0, 0), (n // 2, n // 2))))

    def _centred_shifted(x):
        return np.fft.fftshift(np.fft.ifft(np.fft.ifftshift(x, axes=1), axis=1), axes=1)

    def keystone(rows, x):
        return interpolate(x, (g.v[None] / np.cos(g.theta[rows][:, None]) - g.k[0]) / (g.k[1] - g.k[0]))

    def cross(rows, x):  # rows are columns of the history here
        at = (np.arctan2(g.u[None], g.v[rows][:, None]) - g.theta[0]) / (g.theta[1] - g.theta[0])
        return padded(interpolate(x, at))

    wave = corner_turn(map_lines(history, keystone))
    image = map_lines(corner_turn(map_lines(wave, cross)), lambda rows, x: padded(x))
    if not apodise:
        return map_lines(image, lambda rows, x: np.abs(x))
    turned = corner_turn(map_lines(image, _sva_parts))
    return corner_turn(map_lines(turned, lambda rows, x: np.abs(_sva_parts(rows, x))))


CHAINS = {"omega_k": omega_k, "range_doppler": range_doppler, "chirp_scaling": chirp_scaling}
